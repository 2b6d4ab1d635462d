"""String kernels against their definitions, without Spark."""

import random

import pytest
from colloquy.functions import strings as st
from colloquy.operators import evaluate as ev


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a or a in b:
        return 100.0 if a or not b else 0.0
    parts = [b[max(k, 0) : k + len(a)] for k in range(1 - len(a), len(b))]
    return max(200.0 * plain_lcs(a, p) / (len(a) + len(p)) for p in parts)


@pytest.mark.parametrize("size", [6, 63, 64, 65, 130])
def test_partial_ratio(size, monkeypatch):
    monkeypatch.setattr(st, "PARTS", 7)
    dice = random.Random(size)
    for _ in range(300 if size < 10 else 12):
        a, b = ("".join(dice.choices("abcé😀", k=n)) for n in (dice.randint(max(0, size - 3), size), dice.randint(0, size + 30)))
        assert st.partial_ratio(a, b) == plain_partial(a, b)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edits():
    dice = random.Random(4)
    for n in range(400):
        a = [dice.randint(0, 4) for _ in range(dice.randint(0, 80))]
        b = [dice.randint(0, 4) for _ in range(dice.randint(0, 80))] if n % 2 else [x for x in a if dice.random() > 0.1] + a[:2]
        assert st.edits(a, b) == plain_edits(a, b)
    assert st.edits(list("kitten"), list("sitting")) == 3


def test_assignment_by_all_permutations():
    import itertools

    dice = random.Random(5)
    for n in range(7):
        cost = [[dice.randint(-9, 9) for _ in range(n)] for _ in range(n)]
        assert ev._assignment(cost) == min((sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(n))), default=0)
