"""Structured Streaming over run events and arriving turns."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ops import WEIGHTS


#: States in which all keys are held. A key of its own costs a call and a frame for each batch of events; a state of many keys is read
#: and written whole where one of them has events. More states suit streams of very many keys in small batches.
STATES = 4096
#: Rows in a frame that a state yields.
_ROWS = 10_000
_NAN = float("nan")


def _told(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, Callable[[pd.DataFrame], Iterator[tuple]]]:
    """The columns as tasks get them, and how rows are read there: pandas would make fractions of whole numbers where some are null."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    flagged = [c for c in columns if isinstance(kinds[c], T.NumericType) and not isinstance(kinds[c], T.DecimalType)]
    floats = {c for c in flagged if isinstance(kinds[c], T.FractionalType)}
    sent = rows.select(
        *[F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) if c in flagged else F.col(c) for c in rows.columns], *[F.col(c).isNull().alias(f"_null_{c}") for c in flagged]
    )

    def read(b: pd.DataFrame) -> Iterator[tuple]:
        out = []
        for c in columns:
            values = b[c].tolist()
            if c in floats:
                values = [v if v == v else _NAN for v in values]
            out.append([None if n else v for v, n in zip(values, b[f"_null_{c}"].tolist())] if c in flagged else values)
        return zip(*out)

    return sent, read


def _held_together(events: DataFrame, keys: list[str], fields: list[str], absorb: Callable, tell: Callable, lapse: Callable, out: list[str], schema: str, states: int) -> DataFrame:
    """State by key, in update mode, with the keys dealt over ``states`` states.

    ``absorb(value, rows, mark)``: what is held of a key (None: nothing) after more of its rows (tuples of ``fields``), at the
    watermark ``mark`` in ms; ``tell(key, value, mark)``: value, when it is due in event time, and rows for the output, once for a key with events
    in a batch; ``lapse(value, mark)``: what stays of a value that is due and when it is due next, or None.
    """
    events, read = _told(events.withColumn("_state", F.pmod(F.xxhash64(*keys), F.lit(states)).cast("int")), [*keys, *fields])

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, held = state.getCurrentWatermarkMs(), pickle.loads(state.get[0]) if state.exists else {}
        met: dict[tuple, object] = {}
        for b in () if state.hasTimedOut else batches:
            rows: dict[tuple, list[tuple]] = {}
            for r in read(b):
                rows.setdefault(r[: len(keys)], []).append(r[len(keys) :])
            for k, own in rows.items():
                met[k] = absorb(met[k] if k in met else held.get(k, (None,))[0], own, mark)
        told = []
        for k, value in met.items():
            value, due, own = tell(k, value, mark)
            held[k] = value, due
            told += own
        for k in [k for k, (_, due) in held.items() if due < mark and k not in met]:
            left = lapse(held[k][0], mark)
            if left is None:
                del held[k]
            else:
                held[k] = left
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(min(due for _, due in held.values()), mark + 1))
        elif state.exists:
            state.remove()
        for i in range(0, len(told), _ROWS):
            yield pd.DataFrame(told[i : i + _ROWS], columns=out, dtype=object)

    return events.groupBy("_state").applyInPandasWithState(update, schema, "held binary", "update", GroupStateTimeout.EventTimeTimeout)


def live_progress(events: DataFrame, lateness: str = "1 hour", keep_ms: int = 86_400_000, states: int = STATES) -> DataFrame:
    """Weighted progress of each run (run_id, ts, stage_name, status), as its stage events arrive. What is known of a run goes
    once event time has moved on by ``keep_ms`` without an event of it."""

    def absorb(value: tuple | None, rows: list[tuple], mark: int) -> tuple:
        done, last = value or (frozenset(), 0)
        return done | {stage for stage, status, _ in rows if status == "completed"}, max(last, *(ms for _, _, ms in rows))

    def tell(key: tuple, value: tuple, mark: int) -> tuple:
        done, last = value
        part = sum(WEIGHTS.get(s, 0) for s in done) / sum(WEIGHTS.values())
        return value, max(last + keep_ms, mark + 1), [(*key, len(done), part if part >= 1 else min(part, 0.99))]

    timed = events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", lateness)
    columns = ["run_id", "stages", "fraction"]
    return _held_together(timed, ["run_id"], ["stage_name", "status", "ms"], absorb, tell, lambda value, mark: None, columns, "run_id long, stages int, fraction double", states)


def stale_heartbeats(beats: DataFrame, silence_ms: int = 600_000, lateness: str = "0 seconds") -> DataFrame:
    """Runs (run_id, ts) without an event for ``silence_ms`` of event time, once each; times in ms since 1970, whatever the
    session's time zone."""
    beats = beats.withColumn("ms", F.unix_millis("ts"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "last_ms": [last]})
            return
        last = state.get[0] if state.exists else 0
        for b in batches:
            last = max(last, int(b["ms"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + silence_ms, state.getCurrentWatermarkMs() + 1))

    return beats.withWatermark("ts", lateness).groupBy("run_id").applyInPandasWithState(update, "run_id long, last_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def first_events(events: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def idempotent_events(events: DataFrame, keys: list[str], shape: list[str], order: str, lateness: str = "1 hour", keep_ms: int = 86_400_000, states: int = STATES) -> DataFrame:
    """What each key was first used for, as events (keys, shape, order, ts) arrive, in update mode: keys, the smallest ``order``
    and the ``shape`` of that event (whatever came first, the earliest counts), whether any other of the key's events differs
    from it (conflict), and how many there were.

    A key is forgotten once event time has moved on by ``keep_ms`` without an event of it. What is held of a key is one
    event and whether a second shape was seen, however often it is used. Keys that are null are a key as any other.
    """
    fields = [order, *shape]
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *fields]) + ", conflict boolean, events long"

    def absorb(value: tuple | None, rows: list[tuple], mark: int) -> tuple:
        first, conflict, n, last = value or (None, False, 0, 0)
        found = [r[:-1] for r in rows] + ([first] if first else [])
        least = min(found, key=lambda r: [(x is None, x) for x in r])
        return least, conflict or len({r[1:] for r in found}) > 1, n + len(rows), max(last, *(r[-1] for r in rows))

    def tell(key: tuple, value: tuple, mark: int) -> tuple:
        first, conflict, n, last = value
        return value, max(last + keep_ms, mark + 1), [(*key, *first, conflict, n)]

    timed = events.withColumn("_ms", F.unix_millis("ts")).withWatermark("ts", lateness)
    return _held_together(timed, keys, [*fields, "_ms"], absorb, tell, lambda value, mark: None, [*keys, *fields, "conflict", "events"], out, states)


def sliding_counts(events: DataFrame, key: str, width: str = "1 minute", step: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", lateness).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


#: Days by which no turn is late.
_FAR = 36_500


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def live_conversation_stats(turns: DataFrame, bucket_ms: int = 60_000, lateness: str = "5 minutes", states: int = STATES) -> DataFrame:
    """Speaking time of each speaker in each bucket of time, as turns (meeting_id, speaker_label, ts: when it begins, start_ms and
    end_ms since 1970) arrive in any order; in update mode: meeting_id, speaker_label, start_ms (of the bucket), turns
    (that begin in it), speaking_ms (length of the union of the speaker's turns, cut at the bucket's ends), late.

    A bucket is closed once the watermark has passed its end; until then its totals are those of the batch operators. Of a
    speaker the union of the turns in open buckets is held, and no turn. What a turn has in closed buckets is lost: turns that
    begin in one are counted in a row of their own (start_ms null, late: how many so far). A speaker's state goes with the last
    of its open buckets.
    """

    def open_from(mark: int) -> int:
        return max(mark, 0) // bucket_ms * bucket_ms

    def trimmed(value: tuple, closed: int) -> tuple:
        spans, began, late = value
        return [(max(s, closed), e) for s, e in spans if e > closed], {at: n for at, n in began.items() if at >= closed}, late

    def due(value: tuple, closed: int) -> int:
        spans, began, _ = value
        ends = [e for _, e in spans] + [at + bucket_ms for at in began]
        return max(-(-max(ends, default=0) // bucket_ms) * bucket_ms, closed + bucket_ms)

    def absorb(value: tuple | None, rows: list[tuple], mark: int) -> tuple:
        """Besides what is held: the buckets touched and whether turns were late since it was last told."""
        closed = open_from(mark)
        going_on = value is not None and isinstance(value[1], set)
        (spans, began, late), touched, newly = value if going_on else (trimmed(value or ([], {}, 0), closed), set(), False)
        for s, e in rows:
            if s < closed:
                late, newly = late + 1, True
            else:
                at = s // bucket_ms * bucket_ms
                began[at] = began.get(at, 0) + 1
                touched.add(at)
            if e > max(s, closed):
                spans.append((max(s, closed), e))
                touched.update(range(max(s, closed) // bucket_ms * bucket_ms, e, bucket_ms))
        return (_union(spans), began, late), touched, newly

    def tell(key: tuple, value: tuple, mark: int) -> tuple:
        (spans, began, late), touched, newly = value
        spoken = dict.fromkeys(touched, 0)
        for s, e in spans:
            for at in range(s // bucket_ms * bucket_ms, e, bucket_ms):
                if at in spoken:
                    spoken[at] += min(e, at + bucket_ms) - max(s, at)
        rows = [(*key, at, began.get(at, 0), spoken[at], None) for at in sorted(touched)]
        rows += [(*key, None, None, None, late)] if newly else []
        return value[0], due(value[0], open_from(mark)), rows

    def lapse(value: tuple, mark: int) -> tuple | None:
        left = trimmed(value, open_from(mark))
        return (left, due(left, open_from(mark))) if left[0] or left[1] else None

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    schema = f"meeting_id {kinds['meeting_id']}, speaker_label {kinds['speaker_label']}, start_ms long, turns long, speaking_ms long, late long"
    # Event time and the watermark's delay are both put off by as much: the watermark stays what it is, and Spark, which would
    # drop late turns uncounted, takes none for late.
    marked = turns.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {_FAR} DAYS")).withWatermark("ts", f"{_FAR} days {lateness}")
    return _held_together(marked, ["meeting_id", "speaker_label"], ["start_ms", "end_ms"], absorb, tell, lapse, ["meeting_id", "speaker_label", "start_ms", "turns", "speaking_ms", "late"], schema, states)
