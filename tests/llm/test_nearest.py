"""The block matrix join against all distances, computed plainly."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from siftworks.llm import nearest as nn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=10, every=100, kind=np.float32):
    ok = []
    for vec_id, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v):
            ok.append((vec_id, np.array(v, kind).astype(float)))
    out = []
    for i, (q, a) in enumerate(ok):
        if q is not None and q % every == 0:
            near = sorted((float(nn.distances(a[None], b[None])[0]), c is None, c or 0) for j, (c, b) in enumerate(ok) if j != i and len(b) == len(a))[:k]
            out += [(q, rank, None if no_id else c, score) for rank, (score, no_id, c) in enumerate(near, 1)]
    return sorted(out, key=str)


def odd(rng, n, dim=16):
    """Clusters, equal vectors under many ids, ties, null and repeated ids, vectors that take no part, other lengths, huge and tiny ones."""
    hot = [rng.gauss(0, 1) for _ in range(dim)]
    for i in range(n):
        center = rng.choice([0, 5, -5])
        yield i, hot if rng.random() < 0.3 else [float(rng.randrange(-1, 2)) for _ in range(dim)] if rng.random() < 0.2 else [center + rng.gauss(0, 1) for _ in range(dim)]
    yield from [(None, hot), (100, hot), (100, hot), (200, None), (300, []), (400, [0.0] * dim), (500, [None] * dim), (600, [float("nan")] + hot[1:]), (700, [float("inf")] + hot[1:])]
    yield from [(1100, hot[:5]), (1101, hot[1:6]), (1200, hot[:3]), (1300, [1e30] * dim), (1301, [3e38] * dim), (1400, [1e-30] * dim), (1401, [1e-40] * dim), (-100, [-x for x in hot])]


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_same_as_all_pairs(spark, monkeypatch):
    rows = list(odd(random.Random(4), 900))
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    for name in ("block", "query", "cell", "row", "ids", "dim"):
        df = df.withColumn(name, df.label)
    monkeypatch.setattr(nn, "table", lambda *_: df)
    assert found(nn.op12_nearest(spark, "")) == plain(rows)
    assert found(nn.nearest(df, F.col("vec_id") % 50 == 0, k=3, block=64, side_bytes=1500)) == plain(rows, 3, 50)


def test_double_vectors_few_and_none(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(8)]
    schema = "vec_id long, embedding array<double>"
    assert found(nn.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0)) == plain(rows, kind=np.float64)
    assert found(nn.nearest(spark.createDataFrame(rows[:1], schema), F.col("vec_id") % 100 == 0)) == []
    assert found(nn.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0)) == []


def block_of(rng, n, dim, scale):
    """A packed and unpacked block of vectors about a few centers."""
    centers = rng.normal(size=(5, dim)) * scale
    v = (centers[rng.integers(0, 5, n)] + rng.normal(size=(n, dim))).astype(np.float32)
    s = np.abs(v).max(1).astype(float) / 127
    codes = np.rint(v / s[:, None]).astype(np.int8)
    left = np.sqrt(((v - codes * s[:, None]) ** 2).sum(1))
    fields = {"rows": np.arange(n), "ids": np.arange(n), "known": np.ones(n, bool), "codes": codes, "scale": s, "left_out": left, "vectors": v}
    return nn.unpacked({"n": n, "dim": dim} | {k: x.tobytes() for k, x in fields.items()}, "float32")


def test_bounds_leave_few_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    c = block_of(rng, 4000, 64, 2.0)
    heaps = nn.Heaps({k: x[:40] for k, x in c.items()}, 10)
    heaps.meet(c)
    assert heaps.pairs < 40 * 4000 / 20
    for i, best in enumerate(heaps.best):
        d = nn.distances(np.repeat(c["vectors"][i : i + 1], 4000, 0), c["vectors"])
        d[i] = np.inf
        assert [b[2] for b in best] == sorted(range(4000), key=lambda j: (d[j], j))[:10]


def test_products_of_long_codes_are_exact():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-127, 128, (3, 5000)) for _ in range(2))
    assert (nn.products(a.astype(np.float32), b.astype(np.float32)) == a @ b.T).all()
    full = np.full((1, nn.EXACT), 127.0, np.float32)
    assert nn.products(full, full)[0, 0] == 127 * 127 * nn.EXACT
