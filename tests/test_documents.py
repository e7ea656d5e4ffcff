from pyspark.sql import functions as F

from foliospark.docs import blocks, marks
from foliospark.functions.columns import leading_int
from foliospark.quality import constraints, evolution


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_marks(spark):
    assert one(spark, marks.em_dashes, "x @rdm{a\nb} y") == "x —a\nb— y"
    assert one(spark, marks.quotes, "@q{a} and @q{b}") == "«a» and «b»"
    assert one(spark, marks.quotes, "@q{a @q{b} c}") == "«a “b” c»"
    assert tuple(one(spark, marks.caption, "Figura 3: Mapa")) == ("Figura 3:", "Mapa")
    assert tuple(one(spark, marks.caption, "Mapa")) == ("", "Mapa")
    assert one(spark, marks.tex_escape, "a_b & 50%") == r"a\_b \& 50\%"
    assert one(spark, lambda c: leading_int(c), "20ab") == 20 and one(spark, lambda c: leading_int(c), "x") == 0


def test_quotes_by_own_depth(spark):
    cases = {
        "@q{x} and @q{a @q{b} c}": "«x» and «a “b” c»",
        "@q{a @q{b} c @q{d @q{e}}}": "«a “b” c “d ‘e’”»",
        "@q{1 @q{2 @q{3 @q{4 @q{5}}}}} @q{6}": "«1 “2 ‘3 ‘4 ‘5’’’”» «6»",
        "a} @q{b\n\nc} d}": "a} «b\n\nc» d}",
        "@q{open @q{a @q{b}}": "@q{open «a “b”»",
        "@q{}@q{": "«»@q{",
        "": "",
        None: None,
        "@q{" + "x " * 20_000 + "}": "«" + "x " * 20_000 + "»",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", marks.quotes(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases


def test_template_and_order(spark):
    row = spark.range(1).select(marks.filled(F.lit('<fig id="{{id}}">{{caption}}</fig>'), F.create_map(F.lit("id"), F.lit("f1"), F.lit("caption"), F.lit("C"))).alias("x")).first()
    assert row["x"] == '<fig id="f1">C</fig>'
    names = spark.createDataFrame([(n,) for n in ("bm-01", "a-02", "fm-01", "a-01")], "n string")
    assert [r["n"] for r in names.orderBy(*marks.chapter_order(F.col("n"))).collect()] == ["fm-01", "a-01", "a-02", "bm-01"]


SCHEMA = "document int, pos int, kind string, level int, classes array<string>, text string"


def test_blocks(spark):
    rows = [(1, 0, "Header", 1, ["unnumbered"], "A"), (1, 1, "Header", 2, [], "B"), (1, 2, "Header", 2, [], "C & D"), (1, 3, "Para", 0, ["references"], "see @k1 and @k1"), (1, 4, "Header", 1, [], "E"), (1, 5, "CodeBlock", 0, ["references"], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    jats = blocks.nested_sections(df).first()["jats"]
    assert jats.count("<sec") == jats.count("</sec>") == 4
    assert "</sec></sec><sec sec-type=\"level1\"><title>E" in jats and "C &amp; D" in jats
    assert blocks.reference_lists(df).orderBy("list").first()["ref_list"] == "<ref-list><title>References</title><ref><p>see @k1 and @k1</p></ref></ref-list>"
    assert blocks.contents_classes(df).filter("pos = 0").first()["classes"] == ["unnumbered", "unlisted"]
    refs = spark.createDataFrame([("k1", "Entry"), ("k2", "Other")], "key string, entry string")
    assert [tuple(r) for r in blocks.section_bibliographies(df, refs).collect()] == [(1, 1, "k1", "Entry")]
    colophon = spark.createDataFrame([(0, "Para", 0, [], "printed")], "pos int, kind string, level int, classes array<string>, text string")
    assert [r["text"] for r in blocks.with_colophon(df, colophon).orderBy("pos").collect()][-2:] == ["Colofón", "printed"]


def test_constraints_and_evolution(spark):
    links = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 9, 0), (2, 9, None)], "id_articulo int, id_autor int, es_correspondencia int")
    authors = spark.createDataFrame([(1, "x"), (2, "activo")], "id_autor int, estado string")
    assert [r["id_articulo"] for r in constraints.several_correspondents(links).collect()] == [1]
    assert constraints.repeated_keys(links, "id_articulo", "id_autor").count() == 1
    assert constraints.orphans(links, "id_autor", authors, "id_autor").count() == 2
    assert constraints.cascaded(links, "id_autor", authors.filter("id_autor = 1"), "id_autor").count() == 1
    assert constraints.outside_domain(authors, "estado", ["activo"]).count() == 1
    target = evolution.Target({"id_autor": "int", "rol": "string"}, dropped=("estado",), domains={"estado": (("activo",), "inactivo")})
    assert {c.kind for c in evolution.pending(authors.schema, target)} == {"add", "drop"}
    assert evolution.pending(evolution.applied(authors, target).schema, target) == []
