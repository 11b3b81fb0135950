"""Whitening and hard negatives against brute force in whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from settlespark.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, d string, n string, key string, rank string, Slot int, row_block int"


def _table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, k, "x", "d", "n", "k", "r", 1, 2) for i, v, k in rows], SCHEMA).repartition(parts)


def _vectors(seed, n=240, d=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, d))
    made = (centres[rnd.integers(0, 6, n)] + rnd.normal(size=(n, d)) * 0.6).astype(np.float32)
    rows = [(i, made[i].tolist(), int(i % 4)) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 4) for i in range(40)]  # copies of one vector
    rows += [(n + 50, None, 1), (n + 51, [float("nan")] * d, 1), (n + 52, [1.0] * (d - 1) + [None], 2), (n + 53, [float("inf")] * d, 2)]
    rows += [(n + 54, [0.0] * d, 1), (n + 55, rows[3][1], None), (n + 56, [1.0, 2.0], 1), (n + 57, [], 1), (None, rows[5][1], 1)]
    return rows


def _whole(vector, scale=256):
    return [math.floor(float(np.float32(c)) * scale) for c in vector]


def _finite(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


# whitening


def test_whitening_equals_exact_covariances(spark):
    rows = _vectors(1)
    found = whitening.whiten(_table(spark, rows)).collect()
    kept = [(i, _whole(v)) for i, v, _ in rows if _finite(v) and len(v) == 12]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), 12
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = [[Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3) for b in range(d)] for a in range(d)]
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, axes = values[::-1][:4], axes.T[::-1][:4]
    assert len(found) == 4 * len(kept)
    assert {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-9
    trace = float(sum(cov[a][a] for a in range(d)))
    signs = {}
    expected = {}
    for i, x in kept:
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        expected.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(x, sums)), centred @ axes.T / np.sqrt(values)))
    for r in found:
        far, white = expected[r.vec_id][0]
        assert int(r.deviation) == far
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        sign = signs.setdefault(r.component, 1 if r.whitened * white[r.component - 1] > 0 else -1)
        assert r.whitened * sign == pytest.approx(white[r.component - 1], abs=1e-8)


def test_whitening_of_large_values_is_exact(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) * 10.0**9 for _ in range(3)], 0) for i in range(50)]
    found = whitening.whiten(_table(spark, rows)).where("component = 1").collect()
    fit = [_whole(v) for _, v, _ in rows]
    sums = [sum(x[k] for x in fit) for k in range(3)]
    assert {r.vec_id: int(r.deviation) for r in found} == {i: sum((50 * c - s) ** 2 for c, s in zip(x, sums)) for i, x in enumerate(fit)}
    assert found[0].identity_error < 1e-9


def test_whitening_without_variance_or_rows_is_empty(spark):
    assert whitening.whiten(_table(spark, [])).collect() == []
    assert whitening.whiten(_table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)])).collect() == []
    assert whitening.whiten(_table(spark, [(1, [], 0), (2, None, 1)])).collect() == []
    # Two vectors span one direction only.
    assert {r.component for r in whitening.whiten(_table(spark, [(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 1)])).collect()} == {1}


# hard negatives


def _brute(rows, every, positives=5, negatives=3):
    usable = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] and _finite(r[1])), key=lambda r: (r[0], r[2], _whole(r[1]))):
        usable.setdefault(i, (label, _whole(v)))
    out = []
    for a, (label, x) in usable.items():
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in usable.items() if i != a and len(x) == len(y)]
        same = sorted(s[:2] for s in scores if s[2] == label)[:positives]
        rest = sorted(s[:2] for s in scores if s[2] != label)
        for score, i in same:
            fit = [s for s in rest if -50 * score <= -100 * s[0] <= -95 * score][:negatives]
            out += [(a, i, r + 1, s[1], -score, -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed,blocks", [(2, (2048, 4096, 512)), (3, (4, 30, 8))])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, blocks):
    for name, value in zip(("ANCHORS", "ROWS", "AT_ONCE"), blocks):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = _vectors(seed) + [(20, [0.5] * 12, 0), (20, [0.5] * 12, 0)]  # repeated ids and rows
    found = hard_negatives.mine(_table(spark, rows), F.col("vec_id") % 10 == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = _brute(rows, 10)
    assert len(expected) > 60
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == expected


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.mine(_table(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    alone = _table(spark, [(0, [1.0, 0.0], 1)])
    assert hard_negatives.mine(alone, F.col("vec_id") % 2 == 0).collect() == []
    # A positive score of nought leaves room for a score of nought; a negative one for none.
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, -1.0], 2), (10, [1.0], 3), (11, [-1.0], 3), (12, [-1.0], 4)]
    found = hard_negatives.mine(_table(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in found] == [(0, 1, 2)]


def test_bounds_hold_and_tighten():
    rnd = np.random.default_rng(5)
    x, y = rnd.integers(-300, 300, (40, 13)), rnd.integers(-300, 300, (50, 13))
    exact = x @ y.T
    widths = []
    for n in (1, 4, 16):
        least, most = hard_negatives.Summary(x.astype(float), n).bounds(slice(None), hard_negatives.Summary(y.astype(float), n), slice(None))
        assert (least <= exact).all() and (exact <= most).all()
        widths.append((most - least).mean())
    assert widths[0] > widths[1] > widths[2]


@pytest.mark.parametrize("sparse", [0.0, 2.0])
def test_search_with_and_without_pairs_one_by_one(monkeypatch, sparse):
    monkeypatch.setattr(hard_negatives, "SPARSE", sparse)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 7)
    rnd = np.random.default_rng(6)
    a, r = rnd.integers(-9, 9, (6, 8)), rnd.integers(-9, 9, (60, 8))
    r[30:40] = r[3]
    scores = a @ r.T
    owner, low, high = np.array([0, 0, 2, 3, 5]), np.array([-50, 0, 10, -999, 20]), np.array([50, 60, 80, 999, 90])
    best = hard_negatives.search(a, r, np.arange(60) * 3, lambda some: np.ones((6, len(some)), bool), low, high, owner, 4)
    for slot, o in enumerate(owner):
        expected = sorted((-int(s), 3 * i) for i, s in enumerate(scores[o]) if low[slot] <= s <= high[slot])[:4]
        held = [(-int(s), int(v)) for s, v in zip(best.scores[slot], best.vec_ids[slot]) if s > hard_negatives.NEVER]
        assert held == expected
