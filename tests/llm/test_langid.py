"""Language ID against plain code: samples, sizes, scores; ties, sizes of texts, clashing columns."""

import math
import zlib
from collections import Counter, defaultdict

import regex
import xxhash
import zstandard
from pyspark.sql import functions as F

from foliospark.llm import langid, queries

SF = "/root/testdata/sf0.001"


def cleaned(text):
    return regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip(" ")


def plain_samples(docs, usable, buckets=128, chars=2000, most=48_000):
    """The passages by language, the most frequent language first."""
    rows, common = defaultdict(list), Counter()
    for key, text, lang in docs:
        if lang is not None and usable(key) and text and regex.search(r"\p{L}", text):
            h = xxhash.xxh64_intdigest(str(key).encode(), 42)
            rows[lang, (h - (h >> 63 << 64)) % buckets].append((h - (h >> 63 << 64), cleaned(text)))
            common[lang] += 1
    picked = defaultdict(list)
    for (lang, _), own in rows.items():
        h, text = min(own)
        at = h % max(1, len(text) - chars + 1)
        picked[lang].append((h, text[at : at + chars]))
    joined = {k: "\n".join(t for _, t in sorted(v)).encode()[:most] for k, v in picked.items()}
    size = max(min(map(len, joined.values())), min(8_000, max(map(len, joined.values()))))
    return {k: joined[k][:size] for k in sorted(joined, key=lambda k: (-common[k], k))}


def plain_judge(text, samples):
    if not text or not regex.search(r"\p{L}", text):
        return "und", 0.0, True
    raw, sizes = cleaned(text).encode(), {}
    for lang, sample in samples.items():
        params = zstandard.ZstdCompressionParameters.from_level(9, source_size=8192, dict_size=max(map(len, samples.values())), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        sizes[lang] = sum(len(coder.compress(raw[i : i + 8192])) for i in range(0, len(raw), 8192))
    best = min(sizes, key=sizes.get)
    score = 1 / sum(math.exp(max(-700.0, sizes[best] - s)) for s in sizes.values())
    second = sorted(sizes.values())[1]
    return best, score, second - sizes[best] <= 0.002 * second


def test_query_against_plain_code(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    samples = plain_samples(docs, lambda k: not held(k))
    assert queries.profiles(spark.read.parquet(f"{SF}/documents.parquet")).samples == samples
    got = {r["doc_id"]: r for r in queries.op2(spark, SF).collect()}
    assert set(got) == {k for k, _, _ in docs}
    for key, text, _ in docs:
        lang, score, rejected = plain_judge(text, samples)
        assert (got[key]["lang_pred"], got[key]["rejected"], got[key]["held_out"]) == (lang, rejected, held(key)) and math.isclose(got[key]["score"], score)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.op2(spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id")
    right, narrow = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double"))).first()
    print("right", right, "rejected", narrow)
    assert right > 0.98 and narrow < 0.02


def test_one_byte_more_changes_no_regime(spark):
    profiles = queries.profiles(spark.read.parquet(f"{SF}/documents.parquet"))
    machines = profiles.compressors()
    text = next(s for s in profiles.samples.values())[5_000:7_100]
    for m in machines.values():
        sizes = [len(m.compress(text[:n])) for n in range(1_000, 1_050)]
        assert max(abs(a - b) for a, b in zip(sizes, sizes[1:], strict=False)) <= 6


def test_short_rows_are_made_up_for_by_more_of_them(spark):
    rows = [(i, "ein kurzer satz ist das hier", "de") for i in range(3_000)] + [(i, "this is a rather long text of one language " * 60, "en") for i in range(3_000, 6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = {k: len(v) for k, v in langid.fit(docs, "text", "lang", "doc_id", F.lit(True), floor_bytes=0).samples.items()}
    assert sizes == {"de": 128 * 29 - 1, "en": 128 * 29 - 1}  # all 128 buckets, equal sizes


def test_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "abc", "x", 1.0, True), (1, "abc", "x", 1.0, True), (2, "7", None, None, None)], "doc_id long, text string, lang_pred string, score double, rejected boolean")
    same = langid.Profiles({"bb": b"some sample text of a language", "aa": b"some sample text of a language"})
    got = langid.predict(docs, "text", same, docs.columns).collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in got] == [("bb", 0.5, True)] * 2 + [("und", 0.0, True)]
    assert len(got[0].__fields__) == 5
    none = langid.predict(docs, "text", langid.Profiles({}), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
