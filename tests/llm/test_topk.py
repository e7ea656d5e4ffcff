"""Top-k against plain sorting: ties, repeated rows, nulls, widths, and that blocks are really left out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def plain(rows, k, asked=lambda i: i is not None and i % 20 == 0, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (q, x) in enumerate(kept):
        if asked(q):
            scores = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i is None, i or 0) for m, (i, y) in enumerate(kept) if m != n))
            out += [(q, r + 1, None if z else i, -s) for r, (s, z, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 7, "x") for i, v in rows], SCHEMA).repartition(parts)


def got(df, k, **kw):
    found = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k, **kw)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"block": 4, "shard_rows": 16}, {"block": 8, "shard_rows": 64, "route_bytes": 0}])
def test_same_as_sorting(spark, kw):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, -0.5, 0, 0.25, 1]) for _ in range(5)]) for i in range(300)]  # many ties
    rows += [(20, [1.0] * 5), (20, [1.0] * 5), (21, [1.0] * 5), (None, [1.0] * 5), (None, None), (1000, None), (1020, [1.0, None, 0, 0, 0]), (1040, [math.nan] + [0.0] * 4), (1060, [math.inf] * 5)]
    rows += [(2000, [0.5, -0.25]), (2001, [0.1]), (2020, []), (2040, [1e-9, 3.7, -2.2, 0.0, 1.0, 9.0, -9.0])]
    for k in (1, 20):
        assert got(table(spark, rows), k, **kw) == plain(rows, k)
    assert got(table(spark, rows[:3]), 20, **kw) == plain(rows[:3], 20) and len(plain(rows[:3], 20)) == 2


def test_tables_without_rows_or_queries(spark):
    assert got(table(spark, [(1, [1.0])] * 3), 5) == got(table(spark, []), 5) == got(table(spark, [(20, None)]), 5) == got(table(spark, [(20, [1.0])]), 5) == []


def test_a_third_of_all_rows_alike(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [0.5] * 8 if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(900)] + [(7, [0.5] * 8)] * 5
    assert got(table(spark, rows), 20, block=16, shard_rows=128) == plain(rows, 20)


def test_large_weights(spark):
    rows = [(20, [3e6, -1.0]), (21, [2e7, 5e6]), (22, [1e6, 0.3])]
    assert got(table(spark, rows), 2) == plain(rows, 2)
    with pytest.raises(Exception, match="do not fit a long"):
        got(table(spark, [(20, [1e12]), (21, [1e12])]), 2)


def test_bounds_hold_and_blocks_are_left_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 40
    x = np.sort(np.repeat(np.arange(20), 64))
    rows = np.floor(centres[x] + rng.normal(size=(1280, 16)) * 4).astype(np.int64)
    at = np.arange(0, 1280, 64)
    tops, lows = np.maximum.reduceat(rows, at), np.minimum.reduceat(rows, at)
    queries = rows[::50]
    bound = topk.bounds(queries, tops, lows)
    assert (bound >= np.maximum.reduceat(queries @ rows.T, at, axis=1)).all()
    shard = topk.Shard({"shard": 0, "ids": list(range(1280)), "width": 16, "vectors": topk._pack(rows), "tops": topk._pack(tops), "lows": topk._pack(lows)}, 64)
    best = topk.Best(20, np.full(len(queries), np.iinfo(np.int64).min))
    scored = topk.search(shard, queries, best)
    assert scored < 0.3 * bound.size
    want = [sorted(zip((-(q @ rows.T)).tolist(), range(1280), strict=True))[:20] for q in queries]
    ids, scores = best.lists()
    assert ids == [[i for _, i in w] for w in want] and scores == [[-s for s, _ in w] for w in want]


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11(spark, "/root/testdata/sf0.001").collect()), key=repr) == plain(rows, 20)
