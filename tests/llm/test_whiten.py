"""Whitening against numpy on whole tables, exact deviations, and tables without variance."""

import math

import numpy as np
import pytest

from foliospark.llm import queries, whiten


def plain(rows, top=8):
    """Kept ids, exact deviations, and whitened values up to sign, from the contract's words."""
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, width = len(kept), max(len(x) for _, x in kept)
    x = [v + [100_000] * (width - len(v)) for _, v in kept]
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    return [i for i, _ in kept], n, deviation, centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(found, rows):
    ids, n, deviation, whitened, explained = plain(rows)
    found = sorted(found, key=lambda r: (repr(r["vec_id"]), r["deviation"], r["component"]))
    k = whitened.shape[1]
    order = sorted(((repr(i), d, c + 1, j) for j, (i, d) in enumerate(zip(ids, deviation, strict=True)) for c in range(k)))
    assert len(found) == len(ids) * k and {r["n"] for r in found} == {n}
    assert [(repr(r["vec_id"]), int(r["deviation"]), r["component"]) for r in found] == [o[:3] for o in order]
    got, want = np.full((len(found), k), 0.0), np.full((len(found), k), 0.0)
    for row, (r, (_, _, c, j)) in enumerate(zip(found, order, strict=True)):
        got[row, c - 1], want[row, c - 1] = r["whitened"], whitened[j, c - 1]
    signs = np.sign((got * want).sum(0))
    assert np.abs(got - want * signs).max() < 1e-8
    assert np.allclose([next(r["explained"] for r in found if r["component"] == c + 1) for c in range(k)], explained, rtol=1e-9)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    found = queries.op13(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(found.collect(), rows)


SCHEMA = "vec_id string, embedding array<double>, n int, whitened string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def test_nulls_repeats_and_widths(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{i:03}", (rng.normal(size=5) * [4, 3, 2, 1, 0.5]).tolist()) for i in range(80)]
    rows += [("r", [0.1] * 5)] * 40 + [(None, [0.2, 0.3, 0.1, 0.0, 1.0]), ("s", [0.5, 0.25]), ("e", [])]
    bad = [("a", None), ("b", [None, 1.0, 1.0, 1.0, 1.0]), ("c", [math.nan] * 5), ("d", [1.0, math.inf, 0.0, 0.0, 0.0])]
    check(whiten.whiten(table(spark, rows + bad), "vec_id", "embedding").collect(), rows)


def test_without_variance(spark):
    run = lambda rows, **kw: whiten.whiten(table(spark, rows), "vec_id", "embedding", **kw).collect()
    assert run([]) == run([("a", None)]) == run([("a", []), ("b", [])]) == []
    one = run([("a", [1.0, 2.0])])
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(1, None, None, None, 0), (2, None, None, None, 0)]
    line = sorted(run([("a", [0.0, 1.0]), ("b", [2.0, 1.0])]), key=lambda r: (r["vec_id"], r["component"]))
    assert [r["whitened"] for r in line] == [pytest.approx(-1), None, pytest.approx(1), None] and line[0]["explained"] == 1 and line[0]["identity_error"] < 1e-12
    with pytest.raises(ValueError, match="name of a result"):
        whiten.whiten(table(spark, []).withColumnRenamed("vec_id", "component"), "component", "embedding")


def test_deviation_beyond_a_long(spark):
    rows = [(str(i), [4e5 * (i % 2), 1.0 * i]) for i in range(40)]
    check(whiten.whiten(table(spark, rows), "vec_id", "embedding").collect(), rows)
    assert max(plain(rows)[2]) > 2**63
