"""Language identification by compression.

For each language, a bounded sample of labelled text is a raw-content zstandard
dictionary. A text is cut into blocks, each block is compressed once with each
dictionary, and the language whose dictionary gives the fewest bytes wins. A
narrow margin over the second language is a rejection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import give_back

UNKNOWN = "und"
OUTPUT = "lang_pred STRING, score DOUBLE, rejected BOOLEAN"


@dataclass(frozen=True)
class Profiles:
    """One dictionary for each language (the most frequent first), and how all texts are compressed with them."""

    samples: dict[str, bytes]
    block: int = 8192
    level: int = 9
    min_margin: float = 0.002

    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        """Their tables are as large as a block and a dictionary need, not as large as the level allows."""
        out = {}
        most = max(map(len, self.samples.values()), default=0)
        params = zstandard.ZstdCompressionParameters.from_level(self.level, source_size=self.block, dict_size=most, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        for lang, sample in self.samples.items():
            words = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            out[lang] = zstandard.ZstdCompressor(dict_data=words, compression_params=params)
        return out


def letters(text: Column) -> Column:
    """Lower-cased words of letters only: case, digits and punctuation say little about the language."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}]+", " "))


def fit(docs: DataFrame, text: str, lang: str, key: str, usable: Column, buckets: int = 128, passage_chars: int = 2000, sample_bytes: int = 48_000, floor_bytes: int = 8_000, max_langs: int = 200, **settings) -> Profiles:
    """A sample of each language's ``letters``: of each of ``buckets`` hash buckets of ``key`` the row with the smallest hash,
    and of that row a passage of ``passage_chars`` characters whose place the hash chooses (the whole text if it is shorter).
    Passages are taken in order of their hash up to ``sample_bytes`` bytes, so short rows are made up for by more of them. A
    dictionary is bounded at any input size, and depends on the rows alone, not on their order.
    A language with fewer bytes sets the size of all dictionaries, down to ``floor_bytes``; with less than that it keeps
    what it has. More than ``max_langs`` languages are an error. Null languages and texts teach nothing.
    """
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"), usable.alias("usable"))
    rows = rows.filter(F.col("usable") & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n")).limit(max_langs * buckets + 1).collect()
    if len(least) > max_langs * buckets:
        raise ValueError(f"more than {max_langs} languages")
    wanted = {(r["lang"], r["h"]) for r in least}
    cleaned = rows.filter(F.col("h").isin([r["h"] for r in least])).withColumn("text", letters(F.col("text")))
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - passage_chars + 1, F.lit(1))).cast("int") + 1
    picked = cleaned.groupBy("lang", "h").agg(F.min(F.col("text").substr(place, F.lit(passage_chars))).alias("text")).collect()
    samples: dict[str, list[tuple[int, str]]] = {}
    for r in picked:
        if (r["lang"], r["h"]) in wanted:
            samples.setdefault(r["lang"], []).append((r["h"], r["text"]))
    # the same amount for each language, else the larger dictionary would win by size
    joined = {k: "\n".join(t for _, t in sorted(v)).encode()[:sample_bytes] for k, v in samples.items()}
    size = max(min(map(len, joined.values()), default=0), min(floor_bytes, max(map(len, joined.values()), default=0)))
    common: dict[str, int] = {}
    for r in least:
        common[r["lang"]] = common.get(r["lang"], 0) + r["n"]
    return Profiles({k: joined[k][:size] for k in sorted(joined, key=lambda k: (-common[k], k))}, **settings)


def predict(df: DataFrame, text: str, profiles: Profiles, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred``, ``score`` and ``rejected`` for each row.

    The whole text counts, in blocks. A null text, or one without a letter, is ``und`` with
    score 0 and rejected, and so is any text if there is no profile. ``score`` is the best language's
    share when a byte less counts e times as likely; ties go to the more frequent language and are rejected.
    Kept columns with the names of results are replaced. Repeated rows give a row each, an empty table none.
    All texts, short or long, are compressed alike.
    """
    names = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    source = df.select(*[F.col(f"`{c}`") for c in names], letters(F.col(f"`{text}`")).alias("__text"), F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False)).alias("__letter"))
    schema = source.select(*[F.col(f"`{c}`") for c in names]).schema
    for field in OUTPUT.split(", "):
        schema = schema.add(field.split()[0], field.split()[1].lower())

    def judge(raw: bytes, machines: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
        blocks = [raw[i : i + profiles.block] for i in range(0, len(raw), profiles.block)]
        sizes = [sum(len(m.compress(b)) for b in blocks) for _, m in machines]
        best = min(sizes)  # the first of equal ones counts
        score = 1.0 / sum(math.exp(max(-700.0, best - s)) for s in sizes)
        rest = sorted(sizes)[1:]
        narrow = bool(rest) and rest[0] - best <= profiles.min_margin * rest[0]
        return machines[sizes.index(best)][0], score, narrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = list(profiles.compressors().items())
        for batch in batches:
            texts, has = batch.column("__text"), batch.column("__letter").to_pylist()
            raws = (texts[i].as_py().encode() if has[i] and machines else b"" for i in range(len(has)))
            out = [judge(raw, machines) if raw else (UNKNOWN, 0.0, True) for raw in raws]
            made = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "lang_pred", "score", "rejected"])
        give_back()

    return source.mapInArrow(run, schema)
