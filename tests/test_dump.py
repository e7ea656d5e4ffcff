"""Dumps in both directions: definitions, constraints, odd values, split files; constraints as data."""

import datetime
import decimal

import pytest

from foliospark.quality import catalogue
from foliospark.sources import dump

DUMP = r"""-- made by hand
/*!40101 SET NAMES utf8 */;
DROP TABLE IF EXISTS `works`;
/*!40101 SET @saved = 1 */;
CREATE TABLE `works` (
  `id` int NOT NULL AUTO_INCREMENT COMMENT 'the key; NOT NULL, of course (DEFAULT 7)',
  `kind` enum('book','it''s; (x), y','a,b') COLLATE utf8mb4_unicode_ci DEFAULT 'book' COMMENT 'see `kind`',
  `pages` smallint unsigned DEFAULT '0',
  `big` bigint unsigned DEFAULT NULL,
  `many` int unsigned DEFAULT NULL,
  `price` decimal(10,2) DEFAULT '1.50',
  `day` date DEFAULT NULL,
  `made` datetime DEFAULT CURRENT_TIMESTAMP,
  `seen` timestamp NULL DEFAULT NULL ON UPDATE CURRENT_TIMESTAMP,
  `raw` blob,
  `extra` json DEFAULT NULL,
  `text` text,
  PRIMARY KEY (`id`),
  UNIQUE KEY `u` (`kind`,`text`(20)) COMMENT 'both',
  KEY `k` (`day`),
  CONSTRAINT `f1` FOREIGN KEY (`many`, `pages`) REFERENCES `parents` (`a`, `b`) ON DELETE SET NULL ON UPDATE CASCADE,
  CONSTRAINT `f2` FOREIGN KEY (`many`,`pages`) REFERENCES `parents` (`a`,`b`) ON DELETE SET NULL
) ENGINE=InnoDB AUTO_INCREMENT=3 DEFAULT CHARSET=utf8mb4 COMMENT='a; (b)';
LOCK TABLES `works` WRITE;
/*!40000 ALTER TABLE `works` DISABLE KEYS */;
INSERT INTO `works` VALUES (1,'it\'s; (x), y',3,18446744073709551615,4294967295,-2.25,'2020-02-29','2020-01-02 03:04:05','2020-01-02 03:04:05',0x00FF,'{\"a\": [1, \"x\"]}','a\\nb\nc \\\' d''e\t\"f\" \% 100');
INSERT INTO `works` (`text`, `id`) VALUES (_utf8mb4'only (two)',2),('',3),(NULL,4);
INSERT INTO `works` VALUES (5,'none',NULL,NULL,NULL,NULL,'0000-00-00',NULL,NULL,NULL,NULL,NULL);
UNLOCK TABLES;
CREATE TABLE `empty` (
  `a` int DEFAULT NULL,
  `b` int DEFAULT NULL
) ENGINE=InnoDB;
"""


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "d.sql"
    path.write_text(DUMP)
    return dump.load(dump.statements(spark, str(path))), dump.statements(spark, str(path))


def test_typed_rows(loaded):
    rows = {r["id"]: r for r in loaded[0].tables["works"].collect()}
    assert dict(loaded[0].tables["works"].dtypes) == {"id": "int", "kind": "string", "pages": "int", "big": "decimal(20,0)", "many": "bigint", "price": "decimal(10,2)", "day": "date", "made": "timestamp_ntz", "seen": "timestamp", "raw": "binary", "extra": "string", "text": "string"}
    one = rows[1].asDict()
    assert one.pop("seen").year == 2020
    assert one == {"id": 1, "kind": "it's; (x), y", "pages": 3, "big": decimal.Decimal(2**64 - 1), "many": 2**32 - 1, "price": decimal.Decimal("-2.25"), "day": datetime.date(2020, 2, 29), "made": datetime.datetime(2020, 1, 2, 3, 4, 5), "raw": b"\x00\xff", "extra": '{"a": [1, "x"]}', "text": "a\\nb\nc \\' d'e\t\"f\" \\% 100"}
    assert [(rows[i]["text"], rows[i]["kind"], rows[i]["pages"], rows[i]["price"], rows[i]["made"]) for i in (2, 3, 4)] == [(t, "book", 0, decimal.Decimal("1.50"), None) for t in ("only (two)", "", None)]
    assert rows[5]["day"] is None and loaded[0].tables["empty"].count() == 0 and loaded[0].tables["empty"].columns == ["a", "b"]
    assert [tuple(r) for r in dump.rejected(loaded[1]).collect()] == [("works", "day", "0000-00-00")]


def test_definitions_and_constraints(loaded):
    own = {r["column"]: r for r in loaded[0].definitions.filter("`table` = 'works'").collect()}
    assert [own[c]["place"] for c in own] == list(range(1, 13)) and not own["id"]["nullable"] and own["text"]["nullable"]
    assert own["id"]["default"] is None and own["kind"]["default"] == "book" and own["made"]["default"] is None and own["kind"]["domain"] == ["book", "it's; (x), y", "a,b"]
    rules = {(r["rule"], tuple(r["columns"]), r["parent"], tuple(r["parent_columns"] or ()), r["on_delete"]) for r in loaded[0].constraints.collect()}
    assert rules == {("primary", ("id",), None, (), None), ("unique", ("kind", "text"), None, (), None), ("reference", ("many", "pages"), "parents", ("a", "b"), "set null")}
    assert loaded[0].constraints.count() == 3
    found = {(r["rule"], r["columns"]): r["n"] for r in catalogue.broken(loaded[0].tables, loaded[0].constraints, loaded[0].definitions).collect()}
    assert found == {("primary", "id"): 0, ("unique", "kind,text"): 0, ("domain", "kind"): 1, ("required", "id"): 0}
    with pytest.raises(ValueError, match=r"works domain \(kind\): 1"):
        catalogue.verified(loaded[0].tables, loaded[0].constraints, loaded[0].definitions)


def test_wrong_number_of_values(spark):
    bad = spark.createDataFrame([("CREATE TABLE `t` (\n  `a` int,\n  `b` int\n)",), ("INSERT INTO `t` VALUES (1,2),(3)",), ("",), (None,), ("SELECT 1",)], "statement string")
    with pytest.raises(Exception, match="another number of values"):
        dump.load(bad).tables["t"].collect()
    assert dump.load(bad.filter("statement LIKE 'S%'")).tables == {} and dump.inserted(bad.limit(0), "statement").count() == 0


def test_round_trip_of_a_split_file(spark, tmp_path):
    odd = ["", "a;\nb", "';\n--", "\\", "\\n", "\\\\'", "\r\n\t\x00\x1a", "(1),(2)", "NULL", "é😀", "x" * 200_000, None]
    rows = [(i, odd[i % len(odd)] if odd[i % len(odd)] is None else f"{odd[i % len(odd)]}", None if i % 3 else i / 7, datetime.date(2000, 1, 1 + i % 28), b"\x00'\\" if i % 2 else None) for i in range(120)]
    table = spark.createDataFrame(rows, "id long, t string, x double, d date, b binary").repartition(3)
    dump.write({"t": table, "none": table.limit(0)}, f"{tmp_path}/d", {"t": ["PRIMARY KEY (`id`)"]}, rows_each=7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = dump.statements(spark, f"{tmp_path}/d")
        assert read.rdd.getNumPartitions() > 6
        back = dump.load(read)
        assert sorted(map(tuple, back.tables["t"].collect())) == sorted(rows) and back.tables["none"].count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_compressed_dump_without_a_shuffle(spark, tmp_path, capsys):
    rows = [(i, f"it's {i % 7};\n" if i % 5 else None) for i in range(1003)]
    table = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    dump._filled(dump._lines(table), "t", 7).explain()
    assert "Exchange" not in capsys.readouterr().out
    dump.write({"t": table, "none": table.limit(0)}, f"{tmp_path}/d", rows_each=7, compression="gzip", statements_each=50)
    dump.write({"t": table}, f"{tmp_path}/plain", rows_each=7)
    files = sorted(p for p in (tmp_path / "d").glob("part-*"))
    size = lambda folder: sum(p.stat().st_size for p in (tmp_path / folder).glob("part-*"))
    assert all(p.name.endswith(".gz") for p in files) and len(files) >= 3 and size("d") < size("plain") / 3
    read = dump.statements(spark, f"{tmp_path}/d")
    assert read.filter("statement LIKE 'INSERT%'").count() == 144
    assert sorted(map(tuple, dump.load(read).tables["t"].collect())) == rows and dump.load(read).tables["none"].count() == 0


def test_columns_kept_by_one_pass(loaded, tmp_path):
    kept = dump.kept(loaded[1], {"works": ["id", "day", "text"], "empty": {"b"}, "missing": ["x"], None: ()}, f"{tmp_path}/k")
    whole = loaded[0].tables["works"].select("id", "day", "text")
    assert kept["works"].dtypes == whole.dtypes and sorted(map(str, kept["works"].collect())) == sorted(map(str, whole.collect()))
    assert list(kept) == ["empty", "works"] and kept["empty"].count() == 0 and kept["empty"].dtypes == [("b", "int")]
    assert dump.kept(loaded[1], {}, f"{tmp_path}/none") == {}


def test_catalogue_pending_applied_and_deletions(spark):
    have = catalogue.declared(spark, [("a", "primary", ["id"], None, None, None), ("b", "reference", ["a"], "a", ["id"], "restrict")])
    want = catalogue.declared(spark, [("a", "primary", ["id"], None, None, None), ("b", "primary", ["id"], None, None, None), ("b", "reference", ["a"], "a", ["id"], "cascade"), ("c", "reference", ["b"], "b", ["id"], "set null"), ("d", "reference", ["b"], "b", ["id"], "restrict")])
    change = catalogue.pending(have, want)
    assert sorted((r["change"], r["table"], r["rule"]) for r in change.collect()) == [("add", "b", "primary"), ("add", "b", "reference"), ("add", "c", "reference"), ("add", "d", "reference"), ("drop", "b", "reference")]
    now = catalogue.applied(have, change)
    assert catalogue.pending(now, want).count() == 0 and now.count() == want.count() == catalogue.applied(now, change).count()
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    tables = {"a": frame([(1,), (2,)], "id int"), "b": frame([(10, 1), (20, 2), (30, None)], "id int, a int"), "c": frame([(1, 10), (2, 20), (3, None)], "id int, b int")}
    left = catalogue.after_deletion(tables, want, "a", tables["a"].filter("id = 1"))
    rows = lambda t: sorted(map(tuple, t.collect()), key=repr)
    assert rows(left["a"]) == [(2,)] and rows(left["b"]) == [(20, 2), (30, None)] and rows(left["c"]) == [(1, None), (2, 20), (3, None)]
    with pytest.raises(Exception, match="d.b restricts the deletion in b"):
        catalogue.after_deletion({**tables, "d": frame([(1, 10)], "id int, b int")}, want, "a", tables["a"].filter("id = 1"))["d"].collect()
    kept = catalogue.after_deletion({**tables, "d": frame([(1, 20)], "id int, b int")}, want, "a", tables["a"].filter("id = 1"))["d"]
    assert rows(kept) == [(1, 20)]
    counted = {(r["table"], r["column"]): (r["n_rows"], r["n_null"]) for r in catalogue.statistics(tables).collect()}
    assert counted == {("a", "id"): (2, 0), ("b", "id"): (3, 0), ("b", "a"): (3, 1), ("c", "id"): (3, 0), ("c", "b"): (3, 1)}
    broken = {(r["table"], r["columns"]): r["n"] for r in catalogue.broken({**tables, "a": frame([(1,), (1,), (None,)], "id int")}, want).collect()}
    assert broken == {("a", "id"): 2, ("b", "id"): 0, ("b", "a"): 1, ("c", "b"): 0}


def test_work_on_a_row_does_not_grow_with_columns(spark, capsys):
    names = [f"c{i}" for i in range(30)]
    made = spark.createDataFrame([("CREATE TABLE `t` (\n  " + ",\n  ".join(f"`{n}` text" for n in names) + "\n)",), ("/* x */ insert into `t` (`c1`,`c0`) VALUES ('a\\\\'';b',_utf8mb4 'it''s'),(null,'NULL');",)], "statement string")
    back = dump.load(made).tables["t"]
    assert sorted(map(tuple, back.select("c0", "c1", "c2").collect()), key=str) == [("it's", "a\\';b", None), ("NULL", None, None)]
    back.explain()
    assert capsys.readouterr().out.count("raise_error") <= 2
    dump._lines(back).explain()
    assert capsys.readouterr().out.count("replace(") < 4 * len(names)
