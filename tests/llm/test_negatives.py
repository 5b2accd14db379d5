"""Hard negatives against a plain search over all rows."""

import math
import random

import numpy as np
import pytest

from filinglens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, lane string, score string, block string"


def rows_for(seed, n, dims, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        c = r.choice(centres)
        out.append((i, [float(np.float32(x * spread + r.gauss(0, 0.3))) for x in c], r.randrange(4), "x", None, "y", ""))
    return out


def plain(rows):
    sound = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        sound.append((i, [math.floor(256 * x) for x in v], label))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, q, label) in enumerate(sound):
        if i is None or i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(q, p)), j, m == label) for b, (j, p, m) in enumerate(sound) if b != a]
        for score, j, _ in sorted([s for s in scored if s[2]], key=key)[:5]:
            window = sorted([s for s in scored if not s[2] and 50 * score <= 100 * s[0] <= 95 * score], key=key)[:3]
            out += [(i, j, rank, k, score, s) for rank, (s, k, _) in enumerate(window, 1)]
    return sorted(map(str, out))


ODD = [(50, None, 1, "", "", "", ""), (100, [1.0, float("nan"), 0.0], 1, "", "", "", ""), (150, [1.0, None, 0.0], 1, "", "", "", ""), (200, [0.5, 0.5, 0.1], None, "", "", "", ""),
       (None, [1.0, 1.0, 1.0], 2, None, None, None, None), (None, [1.0, 1.0, 1.0], 1, None, None, None, None), (50, [1.0, 0.9, 0.8], 1, "", "", "", ""), (50, [1.0, 0.9, 0.8], 1, "", "", "", ""),
       (51, [1.0, 0.9, 0.7], 1, "", "", "", ""), (52, [0.8, 0.8, 0.6], 2, "", "", "", ""), (53, [0.8, 0.8, 0.6], 3, "", "", "", ""), (54, [], 3, "", "", "", ""), (55, [0.7], 1, "", "", "", ""),
       (300, [0.0, 0.0, 0.0], 1, "", "", "", ""), (301, [0.1, 0.2, 0.3], 1, "", "", "", ""), (302, [0.1, 0.2, 0.3], 4, "", "", "", ""), (350, [float("inf"), 0.0, 0.0], 1, "", "", "", ""),
       (400, [-2.6e5, 2.0, 1.0], 2, "", "", "", ""), (401, [-2.5e5, 2.0, 1.0], 2, "", "", "", ""), (402, [-2.0e5, 1.0, 1.0], 1, "", "", "", "")]


@pytest.mark.parametrize("size,lane", [(512, 4096), (7, 3)])
def test_equals_plain_search(spark, size, lane):
    for rows in (rows_for(1, 400, 6), rows_for(2, 260, 17, 0.2), ODD, ODD * 2):
        out = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), size=size, lane=lane)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        wide = [(i, v if v is None else v + [0.0] * (3 - len(v)), *rest) for i, v, *rest in rows] if rows[0] is ODD[0] else rows
        assert sorted(str(tuple(r)) for r in out.collect()) == plain(wide)


def test_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1, "", "", "", "")], SCHEMA)).collect() == []


def test_curve_steps_to_a_neighbour():
    """Consecutive places differ by one in one dimension: the order is a Hilbert curve."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        walk = cells[np.argsort(negatives.hilbert(cells, bits))].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_leave_blocks_out():
    rng = np.random.default_rng(3)
    a, q = rng.integers(-300, 300, (20, 9)), rng.integers(-300, 300, (50, 9))
    least, most = negatives.bounds(a, q.min(0), q.max(0))
    s = a @ q.T
    assert (s.min(1) >= least).all() and (s.max(1) <= most).all()
    rows = [{"row": i, "label": 0, "vector": v.astype(np.int32).tobytes()} for i, v in enumerate(a)]
    far = negatives.Lane(rows, 9, [[(10**9, 10**10)]] * 20, 3, False)
    assert not far.wanted(q.min(0), q.max(0), np.array([1])).any()
    assert not negatives.Lane(rows, 9, [[(-(10**9), 10**9)]] * 20, 3, True).wanted(q.min(0), q.max(0), np.array([1])).any()


def test_large_scores_are_exact():
    a = np.array([[1 << 26, 3, -(1 << 26)]])
    assert negatives.products(a, a)[0, 0] == (1 << 53) + 9
