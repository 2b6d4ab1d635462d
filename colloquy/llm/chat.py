"""Chat formatting from event logs, in DataFrame functions only.

``fold`` rebuilds the final messages of a conversation from its log; ``render`` writes them in a template that
marks turns, with control strings inside texts escaped; ``parse`` reads turns and the loss mask back.

Log rows: conv_id, seq, kind, the columns that name the message (``by``), role, text. Kinds, in order of seq:

* ``message``: the message begins, or begins anew, with this text;
* ``delta``: text that follows what the message has so far;
* ``edit``: the text becomes this one, and the role stays unless the edit names one;
* ``regenerate``: the message begins anew with this text, and what was logged before for later messages of the
  conversation is void.

Edge cases: the last role logged counts; null text is the empty text, no role the empty role; rows of other kinds or without kind are left
out; deltas without a beginning begin the message; rows of equal seq count as beginning first, then by text; equal
rows count each time. A null conv_id is a conversation of its own, a null ``by`` sorts first. No rows give no
conversations. Columns besides are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's own marks.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common templates, by their first character. Texts that hold them are escaped.
ANGLE = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>"
SQUARE = r"/?INST\]"
#: A backslash goes behind the first character of a control string, also where backslashes stand there already;
#: no control string holds another's first character, so matches never overlap and the inverse is exact.
ESCAPE = (rf"(?:(<)(\\*)({ANGLE})|(\[)(\\*)({SQUARE}))", r"$1$4\\$2$5$3$6")
UNESCAPE = (rf"(?:(<)\\(\\*)({ANGLE})|(\[)\\(\\*)({SQUARE}))", r"$1$4$2$5$3$6")

BEGINS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def fold(events: DataFrame, by: Sequence[str] = ("turn",)) -> DataFrame:
    """The final messages: conv_id, ``by``, role, text.

    A message's own log is sorted and folded first. Then the messages of each conversation are put in order, and a running
    maximum tells the last regeneration of an earlier message, which voids what a message had before.
    """
    events = events.filter(F.col("kind").isin(*BEGINS, "delta"))
    begins = F.col("kind") != "delta"
    entry = F.struct("seq", (~begins).alias("later"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role"))
    messages = events.groupBy("conv_id", *by).agg(
        F.collect_list(entry).alias("log"), F.max(F.when(begins, F.col("seq"))).alias("begun"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again")
    )
    earlier = Window.partitionBy("conv_id").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    valid = messages.withColumn("void", F.max("again").over(earlier)).withColumn("log", F.filter(F.array_sort("log"), lambda e: F.col("void").isNull() | (e["seq"] >= F.col("void"))))
    texts = F.transform(F.filter("log", lambda e: F.col("begun").isNull() | (e["seq"] >= F.col("begun"))), lambda e: e["text"])
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return valid.filter(F.size("log") > 0).select(
        "conv_id",
        *by,
        F.coalesce(F.element_at(F.when(F.size(roles) > 0, roles), -1), F.lit("")).alias("role"),
        F.array_join(texts, "").alias("text"),
    )


def render(messages: DataFrame, by: Sequence[str] = ("turn",), learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, ``segments`` (array of text and loss) in order, ``formatted`` (them joined).

    The texts of ``learned`` roles are under the loss mask, everything else is not. Each turn is written before
    the rows of a conversation meet.
    """
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    turn = F.array(
        part(F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), F.lit(False)),
        part(escape(F.col("text")), F.col("role").isin(*learned)),
        part(F.lit(END + "\n"), F.lit(False)),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.struct(*by).alias("at"), turn.alias("parts"))))
    return (
        messages.groupBy("conv_id")
        .agg(ordered.alias("turns"))
        .select("conv_id", F.flatten(F.transform("turns", lambda t: t["parts"])).alias("segments"))
        .select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    halves = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(F.substring(p, len(START) + 1, 1 << 30), r"<\|im_sep\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
