"""Exact top-k by inner product, with block-at-a-time pruning.

Vectors are rows of integer weights, their dimensions the terms. Rows are ordered by their strongest terms and cut into
shards, and a shard into blocks of neighbouring rows. A block keeps its rows as a forward index and, for each
term, the largest and the smallest weight. For a query the terms' maxima add up to a bound that no row of the block can pass;
blocks are taken by falling bound and scored through their forward index until the bound falls below the query's k-th score.

A shard is one row of a stored table. Queries first meet the shard that they lie in, which gives a k-th score to start from; then
all of a shard's queries travel together to those tasks where the bounds let one of them find more. A task holds a bounded number
of shards and of queries, however many rows there are; both meet there by equal keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from foliospark.llm.shared import stored
from foliospark.llm.whiten import usable

SCALE, BLOCK, SHARD = 64, 256, 16_384
#: A task holds the shards of this many index partitions at most, and the queries of about this many shards.
SPAN, GROUP = 16, 64
_LONGS = pa.list_(pa.int64())
SHARDS_ARROW = pa.schema({"shard": pa.int64(), "width": pa.int32(), "ids": _LONGS, "asked": pa.list_(pa.bool_()), "vectors": pa.binary(), "tops": pa.binary(), "lows": pa.binary()})
CHUNKS_ARROW = pa.schema({"shard": pa.int64(), "width": pa.int32(), "numbers": _LONGS, "query_ids": _LONGS, "vectors": pa.binary(), "least": _LONGS, "ids": pa.list_(_LONGS), "scores": pa.list_(_LONGS), "visit": _LONGS})
FOUND_ARROW = pa.schema({"shard": pa.int64(), "number": pa.int64(), "query_id": pa.int64(), "ids": _LONGS, "scores": _LONGS})
BOUNDS_ARROW = pa.schema({"shard": pa.int64(), "tops": _LONGS, "lows": _LONGS})
SHARDS, CHUNKS, FOUND, BOUNDS = map(from_arrow_schema, (SHARDS_ARROW, CHUNKS_ARROW, FOUND_ARROW, BOUNDS_ARROW))


def weights(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def _strongest(x: str, terms: int = 3) -> Column:
    """The numbers of the strongest terms; a negative weight is a term of its own."""
    by_strength = F.array_sort(F.transform(F.col(x), lambda v, i: F.struct((-F.abs(v)).alias("s"), (2 * i + F.when(v < 0, 1).otherwise(0)).alias("t"))))
    return F.transform(F.slice(by_strength, 1, terms), lambda s: s["t"])


def _pack(a: np.ndarray) -> bytes:
    """A matrix of integers in the narrowest type; the first byte is the type's sign."""
    for kind in ("b", "h", "i", "q"):
        limit = np.iinfo(kind)
        if not a.size or (a.min() >= limit.min and a.max() <= limit.max):
            return kind.encode() + a.astype("<" + kind).tobytes()
    raise AssertionError("int64 holds all")


def _unpack(b: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(b, "<" + chr(b[0]), rows * width, 1).reshape(rows, width).astype(np.int64)


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which all inner products of rows of ``a`` and ``b`` are exact."""
    most = max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most >= 2**63:
        raise ValueError("scores of such weights do not fit a long")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def bounds(queries: np.ndarray, tops: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For each query and block the sum over terms of the most that a weight between ``lows`` and ``tops`` adds."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    wide = np.maximum(np.abs(tops), np.abs(lows))
    kind = _kind(queries, wide)
    return (up.astype(kind) @ tops.T.astype(kind) + down.astype(kind) @ lows.T.astype(kind)).astype(np.int64)


class Shard:
    """Rows of one shard with the maxima of its blocks. ``ids`` may hold nulls, which come after all others."""

    def __init__(self, row: dict, block: int):
        self.number, self.block = row["shard"], block
        n, width = len(row["ids"]), row["width"]
        self.raw = row["ids"]
        self.nulls = np.array([i is None for i in self.raw], bool)
        self.ids = np.array([0 if i is None else i for i in self.raw], np.int64)
        blocks = -(-n // block)
        self.rows = _unpack(row["vectors"], width, n)
        self.tops, self.lows = _unpack(row["tops"], width, blocks), _unpack(row["lows"], width, blocks)


class Best:
    """The k best rows found for each query: score, id, and the id's null mark. ``least``: the score that a row must reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids, null = np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
        keep = order[place < self.k]
        self.query, self.score, self.id, self.null = query[keep], score[keep], ids[keep], null[keep]
        last = order[place == self.k - 1]
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])

    def lists(self) -> tuple[list, list]:
        """Ids and scores of each query, the best first."""
        cuts = np.cumsum(np.bincount(self.query, minlength=len(self.least)))[:-1]
        ids = [[None if z else i for i, z in zip(a.tolist(), b.tolist(), strict=True)] for a, b in zip(np.split(self.id, cuts), np.split(self.null, cuts), strict=True)]
        return ids, [s.tolist() for s in np.split(self.score, cuts)]


def search(shard: Shard, queries: np.ndarray, best: Best, own: np.ndarray | None = None) -> int:
    """Adds to ``best`` what the shard holds for the queries, and returns how many of all (query, block) pairs were scored.
    ``own``: the queries' own rows, which are no candidates.

    The blocks of each query are in falling order of bounds. In round r its r-th block is scored, unless the bound is below the
    k-th score: then no later block can matter. A bound equal to the k-th score may still hold a smaller id.
    """
    width = max(queries.shape[1], shard.rows.shape[1])
    queries, rows = _widened(queries, width), _widened(shard.rows, width)
    bound = bounds(queries, _widened(shard.tops, width), _widened(shard.lows, width))
    order = np.argsort(-bound, axis=1, kind="stable")
    kind = _kind(queries, rows)
    fast = queries.astype(kind), rows.astype(kind)
    active, scored = np.arange(len(queries)), 0
    for r in range(bound.shape[1]):
        block = order[active, r]
        going = bound[active, block] >= best.least[active]
        active, block = active[going], block[going]
        if not len(active):
            break
        scored += len(active)
        parts = []
        for b in np.unique(block):
            who = active[block == b]
            begin = int(b) * shard.block
            scores = fast[0][who] @ fast[1][begin : begin + shard.block].T
            enough = scores >= best.least[who][:, None]
            if own is not None:
                enough &= own[who][:, None] != np.arange(begin, begin + enough.shape[1])
            q, d = np.nonzero(enough)
            parts.append((who[q], scores[q, d].astype(np.int64), d + begin))
        query, score, at = (np.concatenate(p) for p in zip(*parts, strict=True))
        best.add(query, score, shard.ids[at], shard.nulls[at])
    return scored


def _make_shards(block: int, shard_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(number: int, rows: pa.Table) -> pa.RecordBatch:
        lists = rows.column("__x").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        width = int(sizes.max(initial=0))
        x = np.zeros((len(sizes), width), np.int64)
        x[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.arange(0, len(x), block)
        tops, lows = np.maximum.reduceat(x, at), np.minimum.reduceat(x, at)
        one = {"shard": number, "width": width, "ids": rows.column("__id").to_pylist(), "asked": rows.column("__asked").to_pylist(), "vectors": _pack(x), "tops": _pack(tops), "lows": _pack(lows)}
        return pa.RecordBatch.from_pylist([one], SHARDS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, shard_rows - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == shard_rows:
                    yield made(number, pa.Table.from_batches(held))
                    number, held, n = number + 1, [], 0
        if n:
            yield made(number, pa.Table.from_batches(held))

    return run


def shards(df: DataFrame, key: str, vector: str, asked: Column, scale: int = SCALE, block: int = BLOCK, shard_rows: int = SHARD) -> DataFrame:
    """The stored index: rows with a usable vector, in order of their strongest terms, ``shard_rows`` at most a shard.
    The order's last key is the row's own number, so rows that are all alike are still dealt out evenly.
    """
    picked = df.select(F.col(f"`{key}`").cast("long").alias("__id"), F.col(f"`{vector}`").alias("__v"), F.coalesce(asked, F.lit(False)).alias("__asked"))
    rows = picked.filter(usable(F.col("__v"))).select("__id", "__asked", weights(F.col("__v"), scale).alias("__x"))
    n = rows.count()
    parts = max(-(-n // shard_rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // block)), 1)
    keyed = rows.withColumn("__terms", _strongest("__x")).withColumn("__row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parts, "__terms", "__row").sortWithinPartitions("__terms", "__row")
    return stored(ranged.select("__id", "__asked", "__x").mapInArrow(_make_shards(block, shard_rows), SHARDS), "shards")


def _routes(index: DataFrame, span: int, most_bytes: int) -> dict[int, tuple[np.ndarray, np.ndarray]] | None:
    """Each task's number and the bounds of its shards, if those of all shards fit ``most_bytes``; else None."""
    n, width = index.agg(F.count(F.lit(1)), F.max("width")).first()
    if n * (width or 0) * 16 > most_bytes:
        return None

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                packed = [np.frombuffer(row[c], "<" + chr(row[c][0]), offset=1) for c in ("tops", "lows")]
                tops, lows = (a.reshape(-1, row["width"]).astype(np.int64) if row["width"] else np.zeros((1, 0), np.int64) for a in packed)
                yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "tops": tops.max(0).tolist(), "lows": lows.min(0).tolist()}], BOUNDS_ARROW)

    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in index.select("shard", "width", "tops", "lows").mapInArrow(maxima, BOUNDS).toLocalIterator():
        tops, lows = (np.pad(np.array(a, np.int64), (0, width - len(a)))[None] for a in (r["tops"], r["lows"]))
        task = (r["shard"] >> 32) // span
        before = found.get(task, (tops, lows))
        found[task] = np.maximum(tops, before[0]), np.minimum(lows, before[1])
    return found


def _own_round(block: int, k: int, tasks: range, routes: dict | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each shard's queries meet their own shard; a row for them all, with the tasks where they may find more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.array(row["asked"], bool))
                if not len(at):
                    continue
                shard = Shard(row, block)
                queries, best = shard.rows[at], Best(k, np.full(len(at), np.iinfo(np.int64).min))
                search(shard, queries, best, at)
                visit = list(tasks) if routes is None else [t for t, (tops, lows) in routes.items() if _may_help(queries, tops, lows, best.least)]
                ids, scores = best.lists()
                yield pa.RecordBatch.from_pylist([{"shard": shard.number, "width": row["width"], "numbers": at.tolist(), "query_ids": [shard.raw[i] for i in at], "vectors": _pack(queries), "least": best.least.tolist(), "ids": ids, "scores": scores, "visit": visit}], CHUNKS_ARROW)

    return run


def _may_help(queries: np.ndarray, tops: np.ndarray, lows: np.ndarray, least: np.ndarray) -> bool:
    width = max(queries.shape[1], tops.shape[1])
    return bool((bounds(_widened(queries, width), _widened(tops, width), _widened(lows, width))[:, 0] >= least).any())


def _other_shards(block: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A task's shards meet a group of query rows, one shard after the other, so the k-th scores of one count in the next."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunks = right.to_pylist()
        queries = [_unpack(c["vectors"], c["width"], len(c["numbers"])) for c in chunks]
        best = [Best(k, np.array(c["least"], np.int64)) for c in chunks]
        for row in left.to_pylist():
            shard = Shard(row, block)
            for c, q, b in zip(chunks, queries, best, strict=True):
                if c["shard"] != shard.number:
                    search(shard, q, b)
        out = []
        for c, b in zip(chunks, best, strict=True):
            ids, scores = b.lists()
            out += [{"shard": c["shard"], "number": m, "query_id": q, "ids": i, "scores": s} for m, q, i, s in zip(c["numbers"], c["query_ids"], ids, scores, strict=True) if i]
        return pa.Table.from_pylist(out, FOUND_ARROW)

    return run


def top_k(df: DataFrame, key: str, vector: str, asked: Column, k: int = 20, scale: int = SCALE, block: int = BLOCK, shard_rows: int = SHARD, route_bytes: int = 64_000_000) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` best rows for each row where ``asked`` holds.

    A score is the inner product of the vectors' weights, ``floor(scale * c)`` of each component, exact; ties go to the smaller
    ``key``, which is cast to a long, and a null key comes last. Candidates are all rows but the query's own: of rows with the
    same key the others stay candidates. With fewer than ``k`` candidates all come back. Vectors that are null or hold a null or
    non-finite component take no part; a shorter vector has weight 0 in the terms that it lacks, one without components scores 0
    everywhere. Repeated rows are queries and candidates each. An empty table, or one without queries, gives no rows. Other columns are
    ignored. Weights whose scores could pass a long are an error.

    ``route_bytes`` bounds the shards' term maxima that the driver gathers to send queries past tasks that cannot help;
    where they are larger, queries go to all of them. The result is the same. Queries are shuffled once for each task that
    they visit, at most a ``SPAN``-th of the shards, and shards once for each ``GROUP`` shards' queries.
    """
    index = shards(df, key, vector, asked, scale, block, shard_rows)
    parts = (index.agg(F.max("shard")).first()[0] or 0) // 2**32 + 1
    span = max(1, min(SPAN, parts // df.sparkSession.sparkContext.defaultParallelism))
    chunks = stored(index.mapInArrow(_own_round(block, k, range(-(-parts // span)), _routes(index, span, route_bytes)), CHUNKS), "queries")
    groups = -(-max(1, chunks.count()) // GROUP)
    sent = chunks.select(F.explode("visit").alias("task"), F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("group"), "shard", "width", "numbers", "query_ids", "vectors", "least")
    there = index.select(F.floor(F.shiftright("shard", 32) / span).alias("task"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "shard", "width", "ids", "vectors", "tops", "lows")
    further = there.groupBy("task", "group").cogroup(sent.groupBy("task", "group")).applyInArrow(_other_shards(block, k), FOUND)
    first = chunks.select("shard", F.explode(F.arrays_zip("numbers", "query_ids", "ids", "scores")).alias("q")).select("shard", F.col("q.numbers").alias("number"), F.col("q.query_ids").alias("query_id"), "q.ids", "q.scores")
    rows = first.unionByName(further).select("shard", "number", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("c"))
    order = Window.partitionBy("shard", "number").orderBy(F.desc("c.scores"), F.asc_nulls_last("c.ids"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("c.ids").alias("vec_id"), F.col("c.scores").alias("score"))
