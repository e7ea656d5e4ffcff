"""Sequence packing by non-negative least squares.

Documents are cut at the window, so only remainders need packing. Remainder
lengths are counted in steps of ``grain``; the combinations of at most
``depth`` steps that fill a window exactly are the columns of a small matrix,
and non-negative least squares gives how often to use each for this histogram.
The counts are rounded, pieces are dealt out, and the residual pieces are
packed greedily: they are cut to fill what rounding left open, then each other.

Each task packs the documents that it reads, block by block, so nothing is
shuffled and memory is bounded by a block. What one block leaves goes on in
the next; a task's last sequences have lengths that are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm import tokens
from foliospark.llm.shared import own_name, slices

COLUMNS = "start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"


@lru_cache(maxsize=4)
def combinations(window: int, depth: int) -> np.ndarray:
    """One column for each multiset of at most ``depth`` lengths in 1..window that add up to ``window``: their counts."""
    found: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            found.append(parts)
        elif len(parts) < depth:
            for part in range(parts[-1] if parts else 1, rest + 1):
                grow((*parts, part), rest - part)

    grow((), window)
    out = np.zeros((window, len(found)))
    for j, parts in enumerate(found):
        for part in parts:
            out[part - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that makes ``|a x - b|`` least: coordinates enter by largest gradient and leave at zero."""
    x = np.zeros(a.shape[1])
    inside = np.zeros(a.shape[1], bool)
    gram, right = a.T @ a, a.T @ b
    for _ in range(rounds):
        slope = right - gram @ x
        slope[inside] = -np.inf
        if inside.all() or slope.max() <= 1e-9 * max(1.0, np.abs(right).max()):
            break
        inside[slope.argmax()] = True
        while inside.any():
            own = np.flatnonzero(inside)
            goal = np.linalg.lstsq(gram[np.ix_(own, own)], right[own], rcond=None)[0]
            if (goal > 0).all():
                x[own] = goal
                break
            low = own[goal <= 0]
            part = goal[goal <= 0]
            move = (x[low] / np.maximum(x[low] - part, 1e-300)).min()
            x[own] += move * (goal - x[own])
            gone = own[(x[own] <= 1e-12) & (goal <= 0)]
            x[gone], inside[gone] = 0.0, False
            if not len(gone):
                break
    return x


class Packer:
    """Packs pieces into windows of ``limit`` ids. A piece: (document row, ids, start in its document, ids of its document)."""

    def __init__(self, limit: int, grain: int, depth: int, first_id: int):
        self.limit, self.grain, self.next = limit, grain, first_id
        self.matrix = combinations(limit // grain, depth)
        self.open: list[tuple] = []  # pieces that wait for the next block
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, ids, start, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    @staticmethod
    def cut(pieces: list[tuple], want: int) -> list[tuple]:
        """Takes ``want`` ids off the end of the list; the last piece taken may be cut, its rest stays."""
        out = []
        while want:
            doc, ids, start, total = pieces.pop()
            if len(ids) > want:
                pieces.append((doc, ids[want:], start + want, total))
                ids = ids[:want]
            out.append((doc, ids, start, total))
            want -= len(ids)
        return out

    def add(self, docs: list[tuple]) -> None:
        """Packs a block of documents (row, ids)."""
        rest = self.open
        for doc, ids in docs:
            whole = len(ids) - len(ids) % self.limit
            for start in range(0, whole, self.limit):
                self.emit([(doc, ids[start : start + self.limit], start, len(ids))])
            if whole < len(ids):
                rest.append((doc, ids[whole:], whole, len(ids)))
        bins: list[list[tuple]] = [[] for _ in range(self.limit // self.grain)]
        for piece in sorted(rest, key=lambda p: len(p[1])):
            bins[(len(piece[1]) - 1) // self.grain].append(piece)
        counts = np.array([len(b) for b in bins])
        times = np.rint(nnls(self.matrix, counts.astype(float))).astype(int)
        planned: list[list[tuple]] = []
        for j in np.argsort(-times, kind="stable"):
            parts = np.flatnonzero(self.matrix[:, j])
            need = self.matrix[parts, j].astype(int)
            for _ in range(times[j]):
                if any(len(bins[p]) < n for p, n in zip(parts, need, strict=True)):
                    break
                planned.append([bins[p].pop() for p, n in zip(parts, need, strict=True) for _ in range(n)])
        left = [piece for b in bins for piece in b]
        spare = sum(len(p[1]) for p in left)
        slack = [self.limit - sum(len(p[1]) for p in s) for s in planned]
        gap = sum(slack)
        while gap > spare:  # too little is left to fill the plan: take sequences back
            last, own = planned.pop(), slack.pop()
            left += last
            spare, gap = spare + self.limit - own, gap - own
        for s, own in zip(planned, slack, strict=True):
            self.emit(s + self.cut(left, own))
        while sum(len(p[1]) for p in left[-self.limit :]) >= self.limit:
            self.emit(self.cut(left, self.limit))
        self.open = left

    def finish(self) -> None:
        """What is open becomes sequences whose lengths are powers of two."""
        left, self.open = self.open, []
        total = sum(len(p[1]) for p in left)
        while total:
            size = min(self.limit, 1 << (total.bit_length() - 1))
            self.emit(self.cut(left, size))
            total -= size

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(df: DataFrame, key: str, text: str, tokenizer: str, limit: int = 2048, grain: int = 64, depth: int = 3, end_id: int = 1, block_chars: int = 2_000_000, table_words: int = 250_000) -> DataFrame:
    """One row for each piece of a document: ``key``, start, length, CRC-32 of its ids, its document's ids,
    sequence and offset there. ``limit`` and ``grain`` are powers of two. A worker keeps the ids of ``table_words`` words at hand.

    A null text counts as empty: its only id is ``end_id``. Repeated rows are packed once each.
    A null key stays null. An empty table gives no rows. Other columns are ignored; a key with the name of a result is an
    error. Pieces of equal length are packed in the order they come in. A long text is cut, never shortened; memory is
    bounded by ``block_chars`` bytes of text, or by the longest text.
    """
    source = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    schema = T._parse_datatype_string(COLUMNS)
    schema = T.StructType([T.StructField(own_name(key, schema.names), df.schema[key].dataType), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limit, grain, depth, TaskContext.get().partitionId() << 40)
        end, kind = np.array([end_id], "<u4"), None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.take(), strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], schema.names)

        with tokens.encoder(tokenizer, table_words) as coder:
            for batch in batches:
                kind = batch.column("__key").type
                keys, texts = batch.column("__key").to_pylist(), batch.column("__text")
                for a, b in slices([len(t.as_buffer()) if t.is_valid else 0 for t in texts], block_chars):
                    flat, bounds = coder.encode([texts[i].as_py() or "" for i in range(a, b)])
                    flat = flat.astype("<u4")
                    packer.add([(keys[a + i], np.concatenate([flat[s:e], end])) for i, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False))])
                    yield out()
        packer.finish()
        if kind is not None:
            yield out()

    return source.mapInArrow(run, schema)
