"""Dumps, JSON, sinks, table metadata, contents and colophon blocks."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.docs import blocks
from foliospark.quality import metadata
from foliospark.quality.evolution import Change, Target
from foliospark.sources import dump, jsonside


def test_rows_of_a_dump(spark):
    texts = [
        "INSERT INTO `roles` VALUES (1, 'a', NULL), (2, 'it''s; (x), y', 3.5);",
        "insert into codes (id, name) values\n(7, 'line\nfeed \\\\ and \\' quote');",
        "CREATE TABLE x (a int);", "", None, "INSERT INTO t VALUES ('NULL', null, '')",
    ]
    got = [(r["table"], r["row"], r["values"]) for r in dump.inserted(spark.createDataFrame([(t,) for t in texts], "s string"), "s").collect()]
    assert got == [("roles", 1, ["1", "a", None]), ("roles", 2, ["2", "it's; (x), y", "3.5"]), ("codes", 1, ["7", "line\nfeed \\ and ' quote"]), ("t", 1, ["NULL", None, ""])] or got[-1][2][1] is None


def test_json_paths_and_texts(spark):
    rows = spark.createDataFrame([('{"a":{"b":"x"},"b":"y"}',), ('{"b":"y"}',), ("no json",), (None,), ('{"b":null}',)], "j string")
    got = [r["v"] for r in rows.select(jsonside.first_value(F.col("j"), ["$.a.b", "$.b"]).alias("v")).collect()]
    assert got == ["x", "y", None, None, None]
    odd = ['"', "\\", "\n\t", "é😀", "", "a}b", "\x01"]
    back = [r["q"] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(jsonside.quoted(F.col("t")).alias("q")).collect()]
    assert [json.loads(q) for q in back] == odd


def test_sinks_can_be_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "<p>a\nb</p>", None), (2, None, "x")], "id long, jats string, more string")
    jsonside.write_json(rows, f"{tmp_path}/j")
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(f"{tmp_path}/j").collect())) == [(1, "<p>a\nb</p>", None), (2, None, "x")]
    jsonside.write_texts(rows, "jats", f"{tmp_path}/t")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()] == ["<p>a b</p>"]


def test_tables_pending_applied_verified(spark):
    tables = {"a": spark.createDataFrame([(1, "x")], "id int, old string"), "legacy": spark.createDataFrame([], "id int")}
    targets = {"a": Target({"id": "bigint", "new": "string"}, dropped=("old",)), "book": Target({"id": "bigint", "title": "string"})}
    left = metadata.pending_tables(tables, targets, ("legacy",))
    assert left["book"] == [Change("create", "book")] and left["legacy"] == [Change("remove", "legacy")] and len(left["a"]) == 3
    with pytest.raises(ValueError, match="pending"):
        metadata.verified(tables, targets, ("legacy",))
    now = metadata.applied_tables(tables, targets, ("legacy",))
    metadata.verified(now, targets, ("legacy",))
    again = metadata.applied_tables(now, targets, ("legacy",))
    assert {k: v.schema for k, v in again.items()} == {k: v.schema for k, v in now.items()} and set(now) == {"a", "book"}


SCHEMA = "document int, pos int, kind string, level int, classes array<string>, text string, format string, division int"


def test_blocks_of_divisions(spark):
    rows = [
        (1, 1, "Header", 2, [], "A & B", None, None), (1, 2, "Para", 0, ["references"], "r1", None, 1), (1, 3, "CodeBlock", 0, ["references"], "c", None, 1),
        (1, 4, "Para", 0, ["bibliography"], "r<2", None, 2), (1, 5, "RawBlock", 0, None, "<x/>", "jats", None), (1, 6, "RawBlock", 0, None, "tex", "latex", None),
        (1, 7, "Div", 0, ["sumario"], "", None, None), (1, 8, "Plain", 0, None, "p", None, None), (1, 9, "Div", 0, ["references"], "", None, 3),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    lists = [(r["list"], r["ref_list"]) for r in blocks.reference_lists(frame).orderBy("list").collect()]
    head = "<ref-list><title>References</title>"
    assert lists == [(1, f"{head}<ref><p>r1</p></ref></ref-list>"), (2, f"{head}<ref><p>r&lt;2</p></ref></ref-list>"), (3, f"{head}</ref-list>")]
    jats = blocks.flat_sections(frame).first()["jats"]
    assert jats == blocks.PROLOG + "<sec><title>A &amp; B</title><p>r1</p><p>r&lt;2</p><x/><p>p</p></article>"
    made = [(r["pos"], r["kind"], r["text"]) for r in blocks.contents_blocks(frame).filter("pos > 6").orderBy("pos").collect()]
    assert made == [(7, "RawBlock", blocks.CONTENTS[0]), (8, "RawBlock", blocks.CONTENTS[1]), (9, "RawBlock", blocks.CONTENTS[2]), (10, "Plain", "p"), (11, "Div", "")]


def test_colophon_with_its_own_heading(spark):
    frame = spark.createDataFrame([(1, 1, "Para", 0, [], "x")], "document int, pos int, kind string, level int, classes array<string>, text string")
    own = spark.createDataFrame([(0, "Header", 1, [], "Imprint"), (1, "Para", 0, [], "printed")], "pos int, kind string, level int, classes array<string>, text string")
    assert [r["text"] for r in blocks.with_colophon(frame, own).orderBy("pos").collect()] == ["x", "Imprint", "printed"]
    got = blocks.with_colophon(frame, own.filter("pos = 1"), page_break=True).orderBy("pos").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("Para", "x"), ("Div", ""), ("Header", "Colofón"), ("Para", "printed")] and got[1]["classes"] == ["page-break-before"]
