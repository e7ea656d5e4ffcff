"""Token-id output: best-fit-decreasing packing into id matrices.

Documents longer than a row are split without loss. Pieces, longest first, go
to the fullest row that still has room; a segment tree over the room left
finds that row. The result is a table whose rows are matrix rows: the ids
(padded), the cumulative segment lengths, the positions that start anew at each
segment, and which part of which document each segment is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm import tokens
from foliospark.llm.shared import shared_path, slices


class RoomTree:
    """Rows by the room they have left: a segment tree over 0..limit that tells which rooms some row has."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.there = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        there, i = self.there, room + self.size
        while i and not there[i]:  # beyond a node that is set, all are
            there[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room that is ``need`` at least, and that room."""
        there, i = self.there, need + self.size
        if not there[i]:
            while i > 1 and (i & 1 or not there[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if there[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            there[i] = 0
            while i > 1 and not there[i ^ 1]:
                i >>= 1
                there[i] = 0
        return row, room


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers, longest first (equal lengths keep their order), and the row of each of them. Lengths are 1 to ``limit``."""
    order = np.argsort(-lengths, kind="stable")
    tree, n_rows = RoomTree(limit), int((lengths == limit).sum())
    rows = np.arange(len(lengths))  # pieces that fill a row come first
    for at, length in enumerate(lengths[order[n_rows:]].tolist(), n_rows):
        found = tree.take(length)
        row, room = found or (n_rows, limit)
        n_rows += found is None
        rows[at] = row
        if room > length:
            tree.put(row, room - length)
    return order, rows


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _binaries(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of the matrix."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def packed(keys: pa.Array, flat: np.ndarray, bounds: np.ndarray, limit: int, end_id: int, pad_id: int, kind: str, first: int) -> list[pa.Array]:
    """The matrix rows of a block of documents, column by column. ``flat[bounds[i]:bounds[i + 1]]`` are the ids of document i
    without its ``end_id``; sequences are numbered from ``first`` on.
    """
    ids = np.insert(flat, bounds[1:], end_id)
    totals = np.diff(bounds) + 1
    n_pieces = -(-totals // limit)
    doc = np.repeat(np.arange(len(totals)), n_pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * limit
    order, row = best_fit_decreasing(np.minimum(limit, totals[doc] - start), limit)
    by_row = np.argsort(row, kind="stable")  # within a row the longest piece first
    piece, row = order[by_row], row[by_row]
    doc, start = doc[piece], start[piece]
    length = np.minimum(limit, totals[doc] - start)
    n_rows = int(row[-1]) + 1
    n_segments = np.bincount(row, minlength=n_rows)
    segment_offsets = np.concatenate([[0], np.cumsum(n_segments)])
    before = np.concatenate([[0], np.cumsum(length)])  # ids laid out before each piece
    row_before = before[segment_offsets]
    within = np.arange(before[-1]) - np.repeat(before[:-1], length)
    target = np.arange(before[-1]) + np.repeat(np.arange(n_rows) * limit - row_before[:-1], np.diff(row_before))
    source = np.repeat((np.cumsum(totals) - totals)[doc] + start, length) + within
    matrix = np.full(n_rows * limit, pad_id, kind)
    positions = np.zeros(n_rows * limit, "<u2" if limit <= 1 << 16 else "<u4")
    matrix[target], positions[target] = ids[source], within
    cuts = np.zeros(len(piece) + n_rows, np.int32)
    cuts[np.arange(len(piece)) + row + 1] = before[1:] - row_before[row]
    width = matrix.itemsize
    return [
        pa.array(first + np.arange(n_rows)), pa.array(np.diff(row_before), pa.int32()), pa.array(np.full(n_rows, width), pa.int32()),
        _binaries(matrix.reshape(n_rows, limit)), _binaries(positions.reshape(n_rows, limit)), _lists(segment_offsets + np.arange(n_rows + 1), pa.array(cuts)),
        _lists(segment_offsets, keys.take(pa.array(doc))), _lists(segment_offsets, pa.array(start, pa.int64())), _lists(segment_offsets, pa.array(totals[doc], pa.int64())),
    ]


def write_bins(df: DataFrame, key: str, text: str, tokenizer: str, path: str | None = None, limit: int = 2048, end_id: int = 1, pad_id: int = 0, block_chars: int = 3_000_000, table_words: int = 250_000) -> DataFrame:
    """Writes the packed rows as Parquet under ``path`` (a new shared folder by default) and reads them again.

    Columns: sequence_id, n_tokens, ids (``limit`` little-endian 16-bit numbers, 32-bit for larger vocabularies),
    positions (likewise 16-bit), cu_seqlens, doc_ids, starts, doc_tokens. A null text counts as empty (``end_id`` only).
    Repeated rows are packed once each; null keys stay null; an empty table gives an empty result. A key column may have
    any name, other columns are ignored. Memory is bounded by ``block_chars`` of text, or by the longest text.
    """
    source = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    many = lambda t: T.ArrayType(t)
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("id_bytes", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("positions", T.BinaryType()), T.StructField("cu_seqlens", many(T.IntegerType())), T.StructField("doc_ids", many(df.schema[key].dataType)), T.StructField("starts", many(T.LongType())), T.StructField("doc_tokens", many(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokens.encoder(tokenizer, table_words) as coder:
            yield from rows_of(batches, coder)

    def rows_of(batches: Iterator[pa.RecordBatch], coder: tokens.Encoder) -> Iterator[pa.RecordBatch]:
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        kind, sequence = f"<u{width}", TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, texts = batch.column("__key"), batch.column("__text")
            for a, b in slices([len(t.as_buffer()) if t.is_valid else 0 for t in texts], block_chars):
                flat, bounds = coder.encode([texts[i].as_py() or "" for i in range(a, b)])
                made = packed(keys.slice(a, b - a), flat, bounds, limit, end_id, pad_id, kind, sequence)
                sequence += len(made[0])
                yield pa.RecordBatch.from_arrays(made, schema.names)

    path = path or shared_path(df.sparkSession, "token-bins")
    source.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def segments(bins: DataFrame, key: str, limit: int = 2048, names: dict[str, str] | None = None) -> DataFrame:
    """One row for each segment of the matrix rows, with the CRC-32 of its stored ids and whether its stored positions are
    0, 1, 2 and so on to its end. ``limit`` is that of ``write_bins``; longer matrix rows are an error. ``names`` gives
    other names to result columns; ``key`` must not be among the names.
    """
    width = 2 if limit <= 1 << 16 else 4
    count = F.lit(np.arange(limit, dtype=f"<u{width}").tobytes())
    fits = F.octet_length("positions") <= width * limit
    parts = bins.select("sequence_id", "n_tokens", "id_bytes", "ids", "positions", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "starts", "doc_tokens")).alias("i", "part"))
    begin, end = F.col("cu_seqlens")[F.col("i")], F.col("cu_seqlens")[F.col("i") + 1]
    own = F.expr("substring(ids, cu_seqlens[i] * id_bytes + 1, (cu_seqlens[i + 1] - cu_seqlens[i]) * id_bytes)")
    reset = F.substring("positions", begin * width + 1, (end - begin) * width) == F.substring(count, F.lit(1), (end - begin) * width)
    reset = F.when(fits, reset).otherwise(F.raise_error(F.lit("segments: a longer limit was used in writing")).cast("boolean"))
    names = names or {}
    made = {"start": F.col("part.starts"), "length": (end - begin).cast("long"), "ids_crc32": F.crc32(own), "doc_tokens": F.col("part.doc_tokens"), "sequence_id": F.col("sequence_id"), "offset": begin.cast("long"), "position_reset": reset}
    if key in {names.get(c, c) for c in made}:
        raise ValueError(f"the key {key!r} has the name of a result")
    return parts.select(F.col("part.doc_ids").alias(key), *[c.alias(names.get(name, name)) for name, c in made.items()])
