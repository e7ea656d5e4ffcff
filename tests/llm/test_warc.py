"""WARC: odd keys and payloads, filtered reads, partitions by bytes, and what counts as damage."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from foliospark.llm import warc


def index_of(spark, rows, schema="page_id string, url string, html string, file string", **kw):
    return warc.write(spark.createDataFrame(rows, schema), "page_id", "url", "html", **kw)


def test_odd_keys_come_back(spark):
    keys = ["a b", "x\r\ny", "100%", "%41", "<urn>", "é😀", "", "\x00\x7f", "z" * 3000]
    rows = [("!first", "http://x/\r\n", "same", "f")] + [(k, None, "same", None) for k in keys]
    index = index_of(spark, rows)
    got = {r["key"]: r for r in warc.read(index, originals=index).collect()}
    least = min([*keys, "!first"])
    assert set(got) == {*keys, "!first"} and {r["refers_to"] for k, r in got.items() if k != least} == {least}
    odd = [("\r\n% <a>", None, "p", None), ("\r\n% <a>~", None, "p", None)]
    assert {r["refers_to"] for r in warc.read(index_of(spark, odd)).collect()} == {None, "\r\n% <a>"}


def test_filtered_reads_and_partitions_by_bytes(spark):
    rows = [(f"{i:04}", f"http://h/{i}", f"page {i} " * (i % 50 * 40 + 1), None) for i in range(600)]
    index = index_of(spark, rows, file_bytes=300_000)
    assert index.select("file").distinct().count() > 4
    read = warc.read(index, stretch=200_000)
    total = sum(r["length"] for r in index.collect())
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > total // 200_000 // 2
    html = {k: h.encode() for k, _, h, _ in rows}
    assert {r["key"]: r["payload"] for r in read.collect()} == html
    some = warc.read(index.filter("key LIKE '%7'"), gap=0, most=1_000)
    assert {r["key"]: r["payload"] for r in some.collect()} == {k: h for k, h in html.items() if k.endswith("7")}


def test_long_null_and_repeated_payloads(spark):
    rows = [("b", None, None, None), ("a", None, "", None), ("c", None, "x" * 30_000_000, None), ("d", None, "x" * 30_000_000, None), ("c", None, "x" * 30_000_000, None), (None, None, "", None)]
    index = index_of(spark, rows)
    got = sorted(((r["key"] or "~", r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(index, originals=index).collect()), key=str)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    long = (30_000_000, sha(b"x" * 30_000_000))
    assert got == sorted([("a", "response", None, 0, sha(b"")), ("b", "revisit", "a", 0, sha(b"")), ("~", "revisit", "a", 0, sha(b"")), ("c", "response", None, *long), ("c", "response", None, *long), ("d", "revisit", "c", *long)], key=str)


@pytest.mark.parametrize("change", [{"payload_digest": "'X'"}, {"payload_bytes": "payload_bytes + 1"}, {"record_type": "'response'"}])
def test_a_record_unlike_its_index_is_an_error(spark, change):
    index = index_of(spark, [("a", None, "same", None), ("b", None, "same", None)]).filter("key = 'b'")
    with pytest.raises(Exception, match="not that of the index"):
        warc.read(index.withColumns({k: F.expr(v) for k, v in change.items()})).collect()


def test_a_revisit_without_its_original_is_an_error(spark):
    index = index_of(spark, [("a", None, "same", None), ("b", None, "same", None)])
    assert warc.read(index.filter("key = 'b'"), originals=index).first()["refers_to"] == "a"
    with pytest.raises(Exception, match="no original"):
        warc.read(index.filter("key = 'b'"), originals=index.filter("key = 'b'")).collect()
