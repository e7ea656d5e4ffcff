"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most three bits, cut in two halves, have a
half in which they differ in one bit at most. So each fingerprint is indexed
under 64 signatures: each half with each one of its bits taken out. Such
neighbours meet under an equal signature; an equality join finds them and the
distance of the whole fingerprints decides. Equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.components import components
from foliospark.llm.shared import give_back, own_name, sized, stored

SEED, SHINGLE, DISTANCE = 42, 3, 3


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles (repeats count): a bit is 1 if set in over half the hashes.

    A-Z are lower-cased, words are cut at ASCII white space; fewer words than ``size`` are one shingle, none gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(size, len(words)) - 1 :]
    shingles = map(joined.__getitem__, map(slice, begins[:n].tolist(), last.tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed 64-bit number, for each row."""
    source = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter((fingerprint(t.as_py()) for t in batch.column("__text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(own.view(np.int64))], [key, "fp"])
        give_back()

    return source.mapInArrow(run, schema)


def signatures(fp: Column) -> Column:
    """Array of the 64 signatures: the 32-bit half without one of its bits, marked by half and bit."""
    made = []
    for half in range(2):
        part = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(0xFFFFFFFF)
        for bit in range(32):
            made.append(part.bitwiseAND(0xFFFFFFFF ^ (1 << bit)).bitwiseOR((half * 32 + bit) << 32))
    return F.array(*made)


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, distance_: int = DISTANCE) -> DataFrame:
    """Pairs u < v of distinct fingerprints (column fp) that differ in 1 to ``distance_`` (3 at most) bits, each once. The index has 64 times
    as many rows as Spark takes it for, so it is never broadcast.
    """
    if not 0 <= distance_ <= 3:
        raise ValueError("two halves find distances up to 3")
    index = fps.select("fp", F.explode(signatures(F.col("fp"))).alias("sig"))
    a, b = index.select("sig", F.col("fp").alias("u")), index.select("sig", F.col("fp").alias("v")).hint("merge")
    met = a.join(b, (a["sig"] == b["sig"]) & (F.col("u") < F.col("v")) & (distance("u", "v") <= distance_))
    return met.select("u", "v").distinct()


def near_duplicates(df: DataFrame, key: str, text: str, distance_: int = DISTANCE) -> DataFrame:
    """For each row: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give a row each. A null
    key is never the smallest unless all keys of the component are null. An empty table gives no rows. Other columns are
    ignored; a key with the name of a result is an error. A text of any length is one fingerprint, made whole.

    Equal fingerprints are one node, so the work grows with distinct fingerprints alone. A signature leaves 31 bits of a half, so n
    random fingerprints make ``64 * n`` index rows and meet in about ``n * n / 2**26`` pairs: fewer pairs than index rows up to
    ``2**32`` fingerprints, six times as many at 25 billion. A pair costs one comparison of bits inside the join, and only linked
    ones are shuffled again; a random signature then has about a dozen fingerprints.
    """
    docs = stored(fingerprints(df, own_name(key, ("fp", "fingerprint", "component_id")), text), "simhash")
    nodes = stored(docs.groupBy("fp").agg(F.min(F.col(f"`{key}`")).alias("least")), "simhash-nodes")
    n = nodes.count()
    roots = sized(components(links(nodes.select("fp"), distance_)), n)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "simhash-roots")
    smallest = sized(placed.groupBy("root").agg(F.min("least").alias("component_id")), n)
    found = stored(placed.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return docs.join(sized(found, n), "fp").select(F.col(f"`{key}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
