"""Hard negatives against brute force, over several cells, with ties, gaps and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, windows string"


def mined(spark, rows, anchor=lambda i: i % 10 == 0, **kw):
    given = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    usable = negatives.usable(given, F.col("vec_id"), F.col("label"), F.col("embedding"), lambda x: F.floor(256 * x))
    return sorted(tuple(r) for r in negatives.mine(usable, F.col("vec_id") % 10 == 0, **kw).collect())


def brute(rows, positives=5, negatives_=10):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        best[i] = min(best.get(i, (label, ints)), (label, ints))
    out = []
    for a, (label, v) in best.items():
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in best.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(inside[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024), (128, 16)])
def test_against_brute_force(spark, blocks):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 2), [rng.gauss(0.3, 1) for _ in range(6)]) for i in range(240)]
    # Many equal vectors, so that scores tie across cells, and vectors of a few small numbers.
    rows += [(1000 + i, i % 3, [0.5, 0.25, 0.0, 0.0, 1.0, -0.5]) for i in range(90)]
    rows += [(2000 + i, i % 2, [float(rng.randint(-1, 1)) for _ in range(6)]) for i in range(90)]
    rng.shuffle(rows)
    found = mined(spark, rows, row_block=blocks[0], anchor_block=blocks[1])
    assert found == brute(rows) and len(found) > 300


def test_odd_rows_and_empty(spark):
    good = [(10 * i + j, j % 2, [1.0 + i, 0.5 * j]) for i in range(3) for j in range(5)]
    odd = [
        (None, 0, [1.0, 1.0]), (50, None, [1.0, 1.0]), (60, 0, None), (61, 1, [1.0, None]), (62, 1, [float("nan"), 1.0]),
        (63, 1, [float("inf"), 1.0]), (64, 1, []), (70, 0, [0.0, 0.0]), (65, 1, [1.0]),
    ]
    repeated = [good[3], good[3], (3, 9, [5.0, 5.0])]
    assert mined(spark, good + odd + repeated) == brute(
        [(i, label, v if v is None else [*v, 0.0, 0.0][:2] if None not in v else v) for i, label, v in good + odd + repeated]
    )
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(0, 0, [1.0]), (2, 1, [1.0])]) == []


def test_large_components_are_exact(spark):
    big = float(2**20)
    rows = [(10, 0, [big, 1.0]), (11, 0, [big, 0.25]), (12, 1, [big / 2, 1.0]), (13, 1, [big / 2, 1.5]), (14, 1, [-big, 0.0])]
    assert mined(spark, rows) == brute(rows) != []


def test_search_stops_early_and_stays_whole():
    rng = np.random.default_rng(1)
    # One strong dimension: the lists come to low values long before their ends.
    rows = np.column_stack([rng.permutation(3000), rng.integers(0, 3, 3000)]).astype(np.int64)
    weights = np.array([[5, 1], [-5, 0], [0, 0]])
    eligible = np.ones((3, 3000), bool)
    low, high = np.full((3, 1), -(10**9)), np.full((3, 1), 10**9)
    calls = []
    kept = negatives._product

    def counted(a, b):
        calls.append(a.shape[0] * b.shape[0])
        return kept(a, b)

    negatives._product = counted
    try:
        ((_, a, r, s),) = negatives.threshold_search(weights, rows, eligible, low, high, 4)
    finally:
        negatives._product = kept
    for i in range(3):
        want = sorted(range(3000), key=lambda x: (-int(weights[i] @ rows[x]), x))[:4]
        assert list(r[a == i]) == want and list(s[a == i]) == [int(weights[i] @ rows[x]) for x in want]
    assert sum(calls) < 3 * 3000
