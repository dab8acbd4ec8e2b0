import math
import random

import numpy as np
import pytest

from folioscan.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100):
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        use.append((i, [math.floor(256 * x) for x in v], label))
    last = lambda i: math.inf if i is None else i
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in use if i is not None and i % every == 0}:
        scored = sorted(((-dot(v, w), last(j), j, k) for j, w, k in use), key=lambda x: x[:2])
        pairs = dict.fromkeys([(-s, j) for s, _, j, k in scored if k == label and j != i][:5])
        for ps, p in pairs:
            good = [(-s, j) for s, _, j, k in scored if k != label and 30 * ps <= -100 * s <= 90 * ps]
            out += [(i, p, n, j, ps, s) for n, (s, j) in enumerate(good[:10], 1)]
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = negatives.hard_negatives(df, **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=repr)


def vectors(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 0.4
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(i, (x * scale).tolist(), int(rng.integers(0, 10))) for i, x in enumerate(v)]


@pytest.mark.parametrize("scale,tile,group", [(1.0, 4096, 65_536), (1.0, 16, 2), (1e5, 64, 3)])
def test_equals_brute_force(spark, scale, tile, group):
    rows = vectors(700, 8, 1, scale)
    want = brute(rows)
    assert want and got(spark, rows, tile_rows=tile, group_anchors=group) == want


def test_edges(spark):
    rows = vectors(260, 4, 2)
    rows += [(200, None, 1), (300, [1.0, None, 0.0, 0.0], 1), (400, [float("nan")] * 4, 1), (500, [float("inf")] * 4, 2)]
    rows += [(600, [0.5] * 4, None), (None, [0.5] * 4, 3), (None, [0.5] * 4, 3), (700, [], 4), (701, [], 4), (702, [0.2, 0.1], 4)]
    rows += [(100, *rows[100][1:])] * 2 + [(8, *rows[8][1:])] * 3  # repeated rows
    rows += [(1000 + i, [0.3, 0.3, 0.3, 0.3], i % 2) for i in range(60)]  # ties
    assert got(spark, rows, tile_rows=32) == brute(rows)
    assert got(spark, [(1, [0.5], 1)]) == [] and got(spark, []) == []


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = vectors(300, 4, 3)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("v", "anchor", "slot", "ids", "score", "rank")])
    assert sorted(map(tuple, negatives.hard_negatives(df).collect()), key=repr) == brute(rows)


def test_wide_fields_are_exact():
    rng = random.Random(5)
    for size in (3, 300, 1 << 20, 1 << 40, 1 << 70):
        for _ in range(20):
            dim, n = rng.randint(1, 6), rng.randint(1, 40)
            rows = [[rng.randint(-size, size) for _ in range(dim)] for _ in range(n)]
            anchor = [rng.randint(-size, size) for _ in range(dim)]
            columns = [np.array(c, np.int64 if size < 1 << 60 else object) for c in zip(*rows)]
            exact = [sum(a * b for a, b in zip(anchor, r)) for r in rows]
            most = negatives.LAST
            assert negatives.Tile(columns).scores(anchor).tolist() == [max(-most, min(most, s)) for s in exact]


def test_numbers_as_bytes():
    for values in ([], [0, -5], [40_000, -1], [1 << 40], [1 << 80, -(1 << 90)]):
        a = np.array(values, object if values and max(values) > 1 << 62 else np.int64)
        assert negatives.from_bytes(negatives.to_bytes(a)).tolist() == values
    assert negatives.whole(np.array([0.999, -0.001, 1e300])).tolist() == [255, -1, math.floor(256 * 1e300)]
