"""Similar texts against all pairs: no common word is needed."""

import random

from colloquy.functions import strings as st
from colloquy.operators import evaluate as ev
from colloquy.operators import minutes as mi
from colloquy.operators import similar

STEMS = ["budget", "review", "deploy", "release", "plan", "we", "agreed", "टीम", "größe", "x", "42", "data", "base", "zzzzzzzzzzzzzzzz"]


def texts(n, seed):
    dice = random.Random(seed)
    out = ["budget review", "budgets reviews", "deploy release", "deployed releases", "", "we", "we agreed", "data base", "database", "e " * 3 + "e" * 40]
    while len(out) < n:
        out.append(dice.choice([" ", ""]).join(dice.choice(STEMS) + dice.choice(["", "", "s", "ed"]) for _ in range(dice.randrange(1, 6))))
    return out


def test_letter_bound():
    said = texts(150, 1)
    for a in said:
        for b in said:
            x, y = st.letter_counts(a), st.letter_counts(b)
            both = sum(((p & q) & (1 << 64) - 1).bit_count() for p, q in zip(x[:-1], y[:-1], strict=True)) + min(x[-1], y[-1])
            assert both >= st.lcs(a, b)


def test_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 40)
    said = texts(160, 2)
    one = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(said)], "m int, i long, i_c string")
    two = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(said)], "m int, j long, j_c string")
    for least in (60.0, 70.0, 85.0, 100.0):
        want = {(i, j): s for i, a in enumerate(said) for j, b in enumerate(said) if i % 2 == j % 2 and (s := st.token_set_ratio(a, b)) >= least}
        got = similar.similar_pairs(one, two, ["m"], least, exact=True).collect()
        assert len(got) == len(want) and {(r.i, r.j): r.score for r in got} == want
        fast = similar.similar_pairs(one, two, ["m"], least).collect()
        assert len(fast) == len(want) and {(r.i, r.j) for r in fast} == want.keys()


def test_items_without_a_common_word(spark):
    said = ["budget review", "deploy release", "budgets reviews", "deployed releases"]
    items = spark.createDataFrame([("m", "decision", k, t, t, "A", [k]) for k, t in enumerate(said)], "meeting_id string, kind string, idx long, text string, topic string, owner string, utterance_ids array<long>")
    assert {r.idx: r.kept for r in mi.dedupe_items(items).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    got = {r.idx: (r.superseded_by, r.supersedes, r.status) for r in mi.resolve_supersession(items).collect()}
    assert got == {0: (2, None, "superseded"), 1: (3, None, "superseded"), 2: (None, 0, "active"), 3: (None, 1, "active")}
    scored = ev.precision_recall(items.filter("idx < 2"), items.filter("idx >= 2")).first()
    assert (scored.hits, scored.precision, scored.recall) == (2, 1.0, 1.0)
