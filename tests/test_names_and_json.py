"""Name lists and lenient JSON, value by value."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.docs import names
from foliospark.sources import lenient

NAMES = [
    ("Jan van der Berg", ("Berg", "Jan", "van der", None)), ("van der Berg, Jan", ("Berg", "Jan", "van der", None)), ("King, Jr., Martin Luther", ("King", "Martin Luther", None, "Jr.")),
    ("Ana", ("Ana", None, None, None)), ("{Grupo de Trabajo, S.A.}", ("Grupo de Trabajo, S.A.", None, None, None)), ("Jean de la {Fontaine y} Sol", ("Fontaine y Sol", "Jean", "de la", None)), ("{de la Cruz}, Juana", ("de la Cruz", "Juana", None, None)),
    ("ludwig van", ("van", None, "ludwig", None)), ("María José  Pérez~López", ("López", "María José Pérez", None, None)), ("Éric d'Orsay", ("d'Orsay", "Éric", None, None)),
]


@pytest.mark.parametrize("text, want", NAMES)
def test_one_name(text, want):
    assert tuple(names.parse(text)[c] for c in ("family", "given", "prefix", "suffix")) == want


def test_lists():
    family = lambda t: [p["family"] for p in names.people(t)]
    assert family("A B and {C and D} AND E, F\nand others") == ["B", "C and D", "E"] and family("Anderson, Sand and Rand") == ["Anderson", "Rand"]
    assert family(None) == family("") == family("  ") == family("and") == family("others") == [] and family("and X") == ["X"]
    assert family("{unclosed and X") == ["unclosed and X"] and family("X} and Y") == ["X", "Y"]


def test_index_order_and_counts(spark):
    rows = spark.createDataFrame([("b B and A a", None, 1), ("b B and A a", "A a", 1), ("A a", "", 2), (None, None, 3)], "author string, editor string, place int")
    got = [(r["family"], r["given"], r["mentions"], r["places"]) for r in names.person_index(rows, ["author", "editor"], "place").collect()]
    assert got == [("a", "A", 4, 2), ("B", None, 2, 1)] and names.person_index(rows.limit(0), ["author"], "place").count() == 0


READ = [
    ('{"a": 1 "b": [1 2,3,] /* c */, "c": .5, // x\n "d": 1., "e": -1e3}', {"a": 1, "b": [1, 2, 3], "c": 0.5, "d": 1.0, "e": -1000.0}), ("\ufeff [true false null]", [True, False, None]), ('"\\u00e9\\n\\/\\q" tail', "é\n/q"), ("1 2", 1),
    ('{"a": 1, "a": 2, 3: 4}', {"a": 2, "3": 4}), ('{"a": {"b": [], "c": {}}}', {"a": {"b": [], "c": {}}}), ('"\\ud83d\\ude42"', "🙂"), ("[" * 3000 + "]" * 3000, ...), ('"http://x /* no */"', "http://x /* no */"),
]
UNREADABLE = ["", "  ", "[1", '{"a"}', '{"a":}', "[,1]", "[1,,2]", "]", '{"a": 1]', '"open', "truex", "nil", "1e999", "--1", "/* open", '{"a": 1 : 2}', "1.2.3"]


def test_lenient_reading():
    for text, want in READ:
        if want is ...:
            own, depth = lenient.read(text), 0
            while own:
                own, depth = own[0], depth + 1
            assert depth == 2999
        else:
            assert lenient.read(text) == want, text
    assert [lenient._strict(t) for t in [*UNREADABLE, None]] == [None] * (len(UNREADABLE) + 1)


def test_columns(spark):
    rows = spark.createDataFrame([('{"a": [1 {"b": "x"}]}',), ("no",), (None,)], "t string").select(lenient.variant(F.col("t")).alias("v"))
    assert [r["b"] for r in rows.select(F.try_variant_get("v", "$.a[1].b", "string").alias("b")).collect()] == ["x", None, None]
    odd = ["\x7f\x80\x9f\xad", "\u0600\u0605\u070f\u17b4", "\u200b\u200c\u2028\u202f\u2060", "\ufeff\uffef\ufff0", "a\"\\\n\x01é😀", "", None]
    got = [r["q"] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(lenient.escaped(F.col("t")).alias("q")).collect()]
    assert [q and json.loads(q) for q in got[:-2]] == odd[:-2] and got[-2:] == ['""', None]
    assert got[:3] == ['"\\u007f\\u0080\\u009f\\u00ad"', '"\\u0600\u0605\\u070f\\u17b4"', '"\u200b\\u200c\\u2028\\u202f\\u2060"'] and got[3] == '"\\ufeff\uffef\\ufff0"'


def test_arrays_with_holes(spark):
    maps = [{1: "a", 3: "c"}, {10: "x"}, {11: "x"}, {11: "x", **{i: "y" for i in range(1, 6)}}, {0: "x", 1: "y"}, {}, None, {2: None}]
    rows = spark.createDataFrame([(m,) for m in maps], "m map<long,string>").select(lenient.array_or_object(F.col("m")).alias("j"))
    assert [r["j"] for r in rows.collect()] == ["[a,null,c]", "[" + "null," * 9 + "x]", '{"11":x}', "[" + "y," * 5 + "null," * 5 + "x]", '{"0":x,"1":y}', "[]", None, "[null,null]"]
