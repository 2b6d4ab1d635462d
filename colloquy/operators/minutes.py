"""Minutes: chunks for a model, rule-based extraction, merging, grounding in evidence, safety."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as st
from ..functions import text as tx
from .similar import similar_pairs


def format_transcript(utterances: DataFrame) -> DataFrame:
    line = tx.format_line(F.col("utterance_index"), F.col("start_ms"), F.col("speaker"), F.col("primary_language"), F.col("text"))
    rows = utterances.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("utterance_index", line.alias("l")))).alias("r"))
    return rows.select("meeting_id", F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("transcript"))


def chunk_utterances(utterances: DataFrame, budget: int, overlap: int = 2) -> DataFrame:
    """Consecutive chunks of at most ``budget`` tokens (n_tokens per utterance): meeting_id, chunk, utterance_index.

    A chunk begins with the last ``overlap`` utterances of the one before if the next fits with them; an utterance
    above the budget is a chunk of its own. Where one begins depends on the one before: an ordered fold.
    """
    rows = utterances.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("utterance_index", F.col("n_tokens").cast("bigint").alias("n_tokens")))).alias("r"))
    item = "array<struct<i:bigint,n:bigint>>"
    kind = "array<struct<chunk:int,i:bigint>>"
    seed = F.struct(F.lit(0).alias("chunk"), F.array().cast(item).alias("now"), F.array().cast(kind).alias("out"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])

    def step(a: Column, x: Column) -> Column:
        own = F.array(F.struct(x["utterance_index"].cast("bigint").alias("i"), x["n_tokens"].alias("n"))).cast(item)
        full = (F.size(a["now"]) > 0) & (total(a["now"]) + x["n_tokens"] > budget)
        tail = F.slice(a["now"], F.greatest(F.size(a["now"]) - overlap + 1, F.lit(1)), overlap) if overlap else F.array().cast(item)
        kept = F.when(total(tail) + x["n_tokens"] <= budget, tail).otherwise(F.array().cast(item))
        now = F.when(full, F.concat(kept, own)).otherwise(F.concat(a["now"], own))
        chunk = a["chunk"] + F.when(full, 1).otherwise(0)
        added = F.when(full, F.concat(kept, own)).otherwise(own)
        return F.struct(chunk.alias("chunk"), now.alias("now"), F.concat(a["out"], F.transform(added, lambda u: F.struct(chunk.alias("chunk"), u["i"].alias("i")))).alias("out"))

    return rows.select("meeting_id", F.explode(F.aggregate("r", seed, step)["out"]).alias("x")).select("meeting_id", "x.chunk", F.col("x.i").alias("utterance_index"))


def detect_injections(utterances: DataFrame) -> DataFrame:
    return utterances.withColumn("pattern", tx.injection(F.col("text"))).filter("pattern IS NOT NULL").select("meeting_id", "utterance_index", "speaker", "pattern", "text")


def extract_items(utterances: DataFrame) -> DataFrame:
    """Key points, decisions, action items and questions by cue words: a row per item with its evidence."""
    # In columns below the window, so that each pattern goes over a text once.
    said = utterances.withColumn("_t", tx.strip(F.col("text")))
    said = said.select("*", F.col("_t").endswith("?").alias("_asks"), F.col("_t").rlike(tx.DECISION).alias("_decision"), F.col("_t").rlike(tx.ACTION).alias("_action"))
    text, asks, decision, action = F.col("_t"), F.col("_asks"), F.col("_decision"), F.col("_action")
    first = F.row_number().over(Window.partitionBy("meeting_id", "speaker").orderBy("utterance_index")) == 1
    due = F.regexp_extract(text, tx.DUE, 1)
    none = F.lit(None).cast("string")
    item = lambda kind, topic, owner, conf, raw: F.struct(F.lit(kind).alias("kind"), text.alias("text"), topic.alias("topic"), owner.alias("owner"), conf.alias("confidence"), raw.alias("due"))
    found = F.array(
        F.when(F.col("_first"), item("key_point", tx.short(text, 6), F.col("speaker"), none, none)),
        F.when(decision, item("decision", tx.short(text, 4), F.lit("group"), F.lit("high"), none)),
        F.when(~decision & action & ~asks, item("action_item", none, F.col("speaker"), F.lit("medium"), F.when(due != "", due))),
        F.when(asks, item("open_question", none, F.col("speaker"), none, none)),
    )
    rows = said.withColumn("_first", first).withColumn("_i", F.explode(F.filter(found, lambda x: x.isNotNull())))
    return rows.select("meeting_id", "utterance_index", "speaker", "_i.*", F.substring(text, 1, 80).alias("quote"))


def extract_header(utterances: DataFrame) -> DataFrame:
    """Per meeting: title, agenda_topics (the first five utterances that name one), participants, n_utterances. Without a
    topic the title is ``Meeting summary``; the sentiment is always neutral."""
    text = tx.strip(F.col("text"))
    named = F.when(text.rlike(tx.TOPIC), F.struct("utterance_index", tx.short(text, 6).alias("topic")))
    nth = F.row_number().over(Window.partitionBy("meeting_id", named.isNotNull()).orderBy("utterance_index"))
    rows = utterances.withColumn("_topic", F.when(nth <= 5, named))
    out = rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list("_topic")).alias("t"), F.array_sort(F.collect_set("speaker")).alias("participants"), F.count("*").alias("n_utterances"))
    topics = F.transform("t", lambda x: x["topic"])
    return out.select("meeting_id", F.coalesce(F.get(topics, F.lit(0)), F.lit("Meeting summary")).alias("title"), topics.alias("agenda_topics"), "participants", "n_utterances", F.lit("neutral").alias("overall_sentiment"))


def normalize(text: Column) -> Column:
    """Lower case with white space collapsed; punctuation stays."""
    return tx.squeeze(F.lower(tx.nfc(text)))


_RANKS = ("low", "medium", "high")
UNASSIGNED, GROUP = "Unassigned", "group"


def dedupe_items(items: DataFrame, same: float = 85.0, close: float = 70.0) -> DataFrame:
    """Groups items of one kind that say the same: meeting_id, kind, idx, kept (the item that it joins, or itself).

    Items are taken in order of their first utterance. Two are the same from ``same`` on, or from ``close`` if they share an
    utterance; an item that others have joined has their utterances as well. Actions also need one owner or none; one
    without an owner takes that of the first that joins it. Which item is joined thus depends on the joins before it, so the
    items of a meeting and kind that are similar to another one are folded in order; all pairs are compared (``similar``).
    """
    ids = F.coalesce("utterance_ids", F.array().cast("array<bigint>")).cast("array<bigint>")
    base = items.select("meeting_id", "kind", F.col("idx").cast("long").alias("idx"), F.coalesce("owner", F.lit(UNASSIGNED)).alias("owner"), ids.alias("ids"), normalize(F.col("text")).alias("c"))
    side = lambda x: base.select("meeting_id", "kind", F.col("idx").alias(x), F.col("c").alias(f"{x}_c"))
    alike = similar_pairs(side("i"), side("j"), ["meeting_id", "kind"], close, where=F.col("i") < F.col("j"), exact=True).select("meeting_id", "kind", "i", "j", "score")
    some = alike.select("meeting_id", "kind", F.explode(F.array("i", "j")).alias("idx")).distinct()
    rows = base.join(some, ["meeting_id", "kind", "idx"]).select("meeting_id", "kind", "idx", "owner", "ids")

    def fold(g: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        scores = {(i, j): x for i, j, x in zip(pairs["i"], pairs["j"], pairs["score"], strict=True)}
        partners: dict = {}
        for i, j in scores:
            partners.setdefault(i, set()).add(j)
            partners.setdefault(j, set()).add(i)
        order = sorted((min(r.ids, default=0), r.idx, r.owner, set(r.ids), r.kind) for r in g.itertuples(index=False))
        place, into = {}, {}
        kept: dict = {}  # owner and utterances by item
        for n, (_, idx, owner, own, kind) in enumerate(order):
            match = None
            for k in sorted((x for x in partners.get(idx, ()) if x in kept), key=place.get):
                score = scores[min(idx, k), max(idx, k)]
                fits = kind != "action_item" or kept[k][0] == owner or UNASSIGNED in (kept[k][0], owner)
                if fits and (score >= same or kept[k][1] & own):
                    match = k
                    break
            if match is None:
                kept[idx], place[idx] = [owner, own], n
            else:
                kept[match][1] |= own
                if kept[match][0] == UNASSIGNED:
                    kept[match][0] = owner
                into[idx] = match
        return pd.DataFrame([(g["meeting_id"].iloc[0], g["kind"].iloc[0], j, i) for j, i in into.items()], columns=["meeting_id", "kind", "idx", "kept"])  # no items, no rows

    kind = items.schema["meeting_id"].dataType.simpleString()
    alike = alike.withColumnsRenamed({"meeting_id": "pair_meeting", "kind": "pair_kind"})
    into = rows.groupBy("meeting_id", "kind").cogroup(alike.groupBy("pair_meeting", "pair_kind")).applyInPandas(fold, f"meeting_id {kind}, kind string, idx long, kept long")
    return base.select("meeting_id", "kind", "idx").join(into, ["meeting_id", "kind", "idx"], "left").withColumn("kept", F.coalesce("kept", "idx"))


def merge_items(items: DataFrame, groups: DataFrame) -> DataFrame:
    """One item for each of ``groups`` (see ``dedupe_items``), in its first one's words, with what the others add.

    ``evidence`` has the distinct lists of utterances of all, in order. The rest depends on the kind: decisions take the highest
    confidence and the first rationale that is given; actions the highest priority, the first due date and the first owner
    that are given; key points (``speakers_involved``) the speakers of all, in order, each once. Anything else is the
    first item's own. Columns that ``items`` lacks are left out.
    """
    at = F.struct(F.coalesce(F.array_min("utterance_ids"), F.lit(0)).alias("first"), F.col("idx").cast("long").alias("idx"))
    rows = items.join(groups, ["meeting_id", "kind", "idx"]).withColumn("_at", at)
    first = lambda c, ok: F.min(F.when(ok, F.struct("_at", c)))[c]
    own = lambda c: first(c, F.col("idx") == F.col("kept"))
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    ranks = F.array(*map(F.lit, _RANKS))
    highest = lambda c: F.get(ranks, F.max(F.array_position(ranks, F.col(c))).cast("int") - 1)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_at", c))), lambda x: x[c])
    merged = {
        "text": (None, None),
        "topic": (None, None),
        "confidence": ("decision", lambda: highest("confidence")),
        "rationale": ("decision", lambda: first("rationale", given("rationale"))),
        "priority": ("action_item", lambda: highest("priority")),
        "due": ("action_item", lambda: first("due", given("due"))),
        "owner": ("action_item", lambda: first("owner", F.col("owner") != UNASSIGNED)),
    }
    aggs = [F.array_distinct(listed("utterance_ids")).alias("evidence"), F.count("*").alias("n_merged")]
    for c, (kind, of_all) in merged.items():
        if c in items.columns:
            value = F.when(F.col("kind") == kind, F.coalesce(of_all(), own(c))).otherwise(own(c)) if kind else own(c)
            aggs.append((F.coalesce(value, F.lit(UNASSIGNED)) if c == "owner" else value).alias(c))
    if "speaker" in items.columns:
        aggs.append(F.when(F.col("kind") == "key_point", F.array_distinct(listed("speaker"))).otherwise(F.array_compact(F.array(own("speaker")))).alias("speakers_involved"))
    return rows.groupBy("meeting_id", "kind", F.col("kept").alias("idx")).agg(*aggs)


def resolve_supersession(decisions: DataFrame, same: float = 85.0) -> DataFrame:
    """Adds superseded_by, supersedes, status and note to decisions (meeting_id, idx, topic, text) in order of idx.

    A decision is superseded by the first later one on its topic; ``supersedes`` is the last that a decision replaced. The note
    of a superseded one names its successor, that of others what they replace. Decisions without a topic stay active.
    """
    base = decisions.select("meeting_id", "idx", normalize(F.col("topic")).alias("c")).filter("c <> ''")
    side = lambda x: base.select("meeting_id", F.col("idx").alias(x), F.col("c").alias(f"{x}_c"))
    pairs = similar_pairs(side("i"), side("j"), ["meeting_id"], same, where=F.col("i") < F.col("j"))
    by = pairs.groupBy("meeting_id", F.col("i").alias("idx")).agg(F.min("j").alias("superseded_by"))
    of = by.groupBy("meeting_id", F.col("superseded_by").alias("idx")).agg(F.max("idx").alias("supersedes"))
    text = lambda x: decisions.select("meeting_id", F.col("idx").alias(x), F.col("text").alias(f"_{x}"))
    out = decisions.join(by, ["meeting_id", "idx"], "left").join(of, ["meeting_id", "idx"], "left")
    out = out.join(text("superseded_by"), ["meeting_id", "superseded_by"], "left").join(text("supersedes"), ["meeting_id", "supersedes"], "left")
    note = F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit("Superseded later in the meeting by: "), "_superseded_by")).when(F.col("supersedes").isNotNull(), F.concat(F.lit("Replaces an earlier decision: "), "_supersedes"))
    out = out.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise("active")).withColumn("note", note)
    return out.select(*decisions.columns, "superseded_by", "supersedes", "status", "note")


def check_evidence(evidence: DataFrame, utterances: DataFrame, least: float = 80.0) -> DataFrame:
    """Adds reason (null if good) to evidence (evidence_id, meeting_id, utterance_ids, speaker, quote, start_ms, end_ms).

    The utterances exist, the speaker said one of them, times given are within a second of theirs, and the quote, which may
    not be empty, is found in their texts, joined in the order cited. Good evidence gets the utterances' times; failed
    evidence keeps what was given.
    """
    each = evidence.select("evidence_id", "meeting_id", F.posexplode("utterance_ids").alias("at", "utterance_index"))
    u = utterances.select("meeting_id", "utterance_index", F.col("speaker").alias("u_speaker"), F.col("start_ms").alias("u_start"), F.col("end_ms").alias("u_end"), F.col("text").alias("u_text"), F.lit(True).alias("there"))
    met = each.join(u, ["meeting_id", "utterance_index"], "left").groupBy("evidence_id").agg(
        F.count(F.when(F.col("there").isNull(), 1)).alias("missing"), F.collect_set("u_speaker").alias("speakers"), F.min("u_start").alias("s"), F.max("u_end").alias("e"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "u_text"))), lambda x: F.coalesce(x["u_text"], F.lit(""))), " ").alias("said"),
    )
    out = evidence.join(met, "evidence_id", "left")
    # In columns, so that each is normalised once.
    out = out.withColumn("_quote", normalize(F.coalesce("quote", F.lit("")))).withColumn("_said", normalize(F.coalesce("said", F.lit(""))))
    quote, said = F.col("_quote"), F.col("_said")
    empty, inside = quote == "", said.contains(quote)
    ask = ~empty & ~inside
    score = F.when(empty, 0.0).when(inside, 100.0).otherwise(st.partial_similarity(F.when(ask, quote), F.when(ask, said)))
    off = F.coalesce(F.abs(F.col("start_ms") - F.col("s")) > 1000, F.lit(False)) | F.coalesce(F.abs(F.col("end_ms") - F.col("e")) > 1000, F.lit(False))
    reason = (
        F.when(F.coalesce(F.col("missing"), F.lit(0)) > 0, "unknown_utterance")
        .when(~F.coalesce(F.array_contains("speakers", F.col("speaker")), F.lit(False)), "wrong_speaker")
        .when(off, "wrong_time")
        .when(score < least, "quote_not_found")
    )
    good = F.col("reason").isNull()
    return out.withColumn("reason", reason).withColumn("start_ms", F.when(good, F.col("s")).otherwise(F.col("start_ms"))).withColumn("end_ms", F.when(good, F.col("e")).otherwise(F.col("end_ms"))).drop("missing", "speakers", "s", "e", "said", "_quote", "_said")


def _judged(items: DataFrame, checked: DataFrame, speakers: DataFrame) -> DataFrame:
    """Every item with its counts of evidence, the reasons of what failed, the first good speaker and whether its owner is reset."""
    good = F.col("reason").isNull()
    counts = checked.groupBy("item_id").agg(
        F.count(F.when(good, 1)).alias("good"), F.count("*").alias("all"), F.min(F.when(good, F.struct("evidence_id", "speaker")))["speaker"].alias("quoted"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~good, F.struct("evidence_id", "reason")))), lambda x: x["reason"]), "; ").alias("reasons"),
    )
    known = speakers.groupBy("meeting_id").agg(F.collect_set("label").alias("known"))
    out = items.join(counts, "item_id", "left").join(known, "meeting_id", "left")
    free = F.when(F.col("kind") == "action_item", UNASSIGNED).when(F.col("kind") == "decision", GROUP)
    fine = F.coalesce(F.array_contains("known", F.col("owner")), F.lit(False)) | F.coalesce(F.col("owner") == free, F.lit(False)) | (F.col("kind") == "key_point")
    return out.withColumn("good", F.coalesce("good", F.lit(0))).withColumn("all", F.coalesce("all", F.lit(0))).withColumn("reset", ~fine).withColumn("free", F.coalesce(free, F.col("quoted")))


def verify_items(items: DataFrame, checked: DataFrame, speakers: DataFrame) -> DataFrame:
    """Items (item_id, meeting_id, kind, owner, confidence, due_iso, and speakers_involved if there) with good evidence.

    Owners whom nobody bears become Unassigned (actions), group (decisions) or the quoted speaker (questions); key points
    keep the speakers that exist; invalid dates become null. A decision or action that lost evidence or its owner has its
    confidence lowered a step.
    """
    out = _judged(items, checked, speakers).filter("good > 0")
    lower = F.create_map(F.lit("high"), F.lit("medium"), F.lit("medium"), F.lit("low"), F.lit("low"), F.lit("low"))
    changed = (F.col("reset") | (F.col("good") < F.col("all"))) & F.col("kind").isin("decision", "action_item")
    date = F.expr("date_format(try_to_timestamp(due_iso, 'yyyy-MM-dd'), 'yyyy-MM-dd')")
    out = out.withColumn("owner", F.when(F.col("reset"), F.col("free")).otherwise(F.col("owner"))).withColumn("due_iso", date)
    out = out.withColumn("confidence", F.when(changed, F.element_at(lower, F.col("confidence"))).otherwise(F.col("confidence")))
    if "speakers_involved" in items.columns:
        out = out.withColumn("speakers_involved", F.array_intersect("speakers_involved", F.coalesce("known", F.array().cast("array<string>"))))
    return out.select(items.columns)


def verification_report(items: DataFrame, checked: DataFrame, speakers: DataFrame) -> DataFrame:
    """Per meeting: items checked, passed unchanged, dropped and downgraded; evidence checked and passed, and its ratio (1 if
    there was none)."""
    j = _judged(items, checked, speakers)
    lost, dropped = F.col("good") < F.col("all"), F.col("good") == 0
    changed = lost | F.col("reset")
    n = lambda c: F.count(F.when(c, 1))
    out = j.groupBy("meeting_id").agg(
        F.count("*").alias("checked"), n(~dropped & ~changed).alias("passed"), n(dropped).alias("dropped"), n(~dropped & changed & F.col("kind").isin("decision", "action_item")).alias("downgraded"),
        F.sum("all").alias("evidence_checked"), F.sum("good").alias("evidence_passed"),
    )
    return out.withColumn("grounding_rate", F.when(F.col("evidence_checked") > 0, F.col("evidence_passed") / F.col("evidence_checked")).otherwise(1.0))


def verification_issues(items: DataFrame, checked: DataFrame, speakers: DataFrame) -> DataFrame:
    """A row for everything that was changed: meeting_id, item_id, item_type, item (the first 120 characters), action, reason."""
    j = _judged(items, checked, speakers)
    issue = lambda when, action, reason: F.when(when, F.struct(F.lit(action).alias("action"), reason.alias("reason")))
    kept = F.col("good") > 0
    found = F.array_compact(
        F.array(
            issue(~kept, "dropped", F.when(F.coalesce("reasons", F.lit("")) != "", F.col("reasons")).otherwise("no evidence")),
            issue(kept & (F.col("good") < F.col("all")), "evidence_removed", F.col("reasons")),
            issue(kept & F.col("reset"), "owner_reset", F.concat(F.coalesce("owner", F.lit("nobody")), F.lit(" is no speaker"))),
        )
    )
    return j.select("meeting_id", "item_id", F.col("kind").alias("item_type"), F.substring("text", 1, 120).alias("item"), F.explode(found).alias("i")).select("meeting_id", "item_id", "item_type", "item", "i.*")


def source_languages(utterances: DataFrame) -> DataFrame:
    """Per meeting: the distinct languages present, sorted."""
    return utterances.groupBy("meeting_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages_present")))).alias("source_languages"))


def usage_totals(calls: DataFrame, input_cost: float, output_cost: float) -> DataFrame:
    """Per meeting, from model calls (meeting_id, prompt_tokens, completion_tokens, latency_ms, attempts): their sums, repairs,
    and the cost at so much for a million tokens, to six decimals."""
    cost = (F.col("prompt_tokens") * input_cost + F.col("completion_tokens") * output_cost) / 1_000_000
    return calls.groupBy("meeting_id").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum(cost), 6).alias("cost_usd"),
        F.sum("latency_ms").alias("latency_ms"), F.sum(F.col("attempts") - 1).alias("repair_attempts"),
    )


def chunk_strategy(tokens: DataFrame, single: int = 12_000) -> DataFrame:
    total = F.col("n_tokens")
    return tokens.withColumn("strategy", F.when(total <= 0, "empty").when(total <= single, "single_pass").otherwise("map_reduce"))


def parse_extractions(replies: DataFrame, schema: str) -> DataFrame:
    """The outermost object of a model's reply; invalid ones are flagged and stay."""
    raw = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    return replies.withColumn("parsed", F.from_json(raw, schema)).withColumn("valid", (raw != "") & F.col("parsed").isNotNull() & F.expr("try_parse_json(regexp_extract(reply, '(?s)[{].*[}]', 0)) is not null"))
