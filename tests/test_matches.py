"""Items matched one to one, the perfect pairs first, against a plain loop over all pairs."""

import random

from colloquy.functions import strings as st
from colloquy.operators import evaluate as ev
from colloquy.operators import minutes as mi
from colloquy.operators import similar

from test_similar import texts

KIND = "meeting_id long, kind string, idx long, text string, owner string"


def plain_ratio(a, b):
    """By sorted words: both in common with either, and either with the other."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    pairs = [(one, two)] + ([(both, one), (both, two)] if both else [])
    return max(st.ratio(p, q) for p, q in pairs) if x and y else 0.0


def drawn(n, seed):
    dice, said = random.Random(seed), texts(60, seed)
    return [(k % 2, dice.choice("ab"), k, dice.choice(said), dice.choice("AB")) for k in range(n)]


def test_ratio_without_its_common_beginning():
    for a in texts(80, 3):
        for b in texts(80, 4):
            assert st.token_set_ratio(a, b) == plain_ratio(a, b)


def test_matches_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 10)
    gold, found = drawn(90, 5), drawn(70, 6)
    want = {}
    for key in {r[:2] for r in gold + found}:
        one, two = ([r[2:] for r in rows if r[:2] == key] for rows in (gold, found))
        pairs = sorted(((plain_ratio(a, b), i, j, p == q) for i, a, p in one for j, b, q in two), reverse=True)
        used_i, used_j, hits, owners = set(), set(), 0, 0
        for score, i, j, same in pairs:
            if score >= 60 and i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                hits, owners = hits + 1, owners + same
        want[key] = (len(one), len(two), hits, owners)
    got = ev.precision_recall(spark.createDataFrame(gold, KIND), spark.createDataFrame(found, KIND)).collect()
    assert {(r.meeting_id, r.kind): (r.gold, r.found, r.hits, r.owner_hits) for r in got} == want


def test_python_runs_once_and_not_by_group(spark):
    items = spark.createDataFrame(drawn(20, 7), KIND)
    plan = ev.precision_recall(items, items.filter("idx % 2 = 0"))._jdf.queryExecution().executedPlan().toString()
    calls = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
    assert "InPandas" not in plan
    assert [sum(f" [{f}(" in x for x in calls) for f in ("token_set_similarity", "letter_bits")] == [1, 2]


def test_evidence_is_normalised_once(spark):
    evidence = spark.createDataFrame([(1, 1, [1], "A", "a  b", None, None)], "evidence_id long, meeting_id long, utterance_ids array<long>, speaker string, quote string, start_ms long, end_ms long")
    said = spark.createDataFrame([(1, 1, "A", 0, 900, "An A  B")], "meeting_id long, utterance_index long, speaker string, start_ms long, end_ms long, text string")
    out = mi.check_evidence(evidence, said)
    assert out._jdf.queryExecution().executedPlan().toString().count("lower(CASE") == 2  # of the quote and of what was said
    assert out.select("reason", "start_ms", "end_ms").first() == (None, 0, 900)
