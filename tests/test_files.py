"""JATS files and side files on small inputs."""

import datetime

import pytest

from foliospark.docs import blocks
from foliospark.quality import books, catalogue
from foliospark.sources import jats, sidefiles


def own_articles(spark, titles):
    make = spark.createDataFrame
    dates = "fecha_recepcion date, fecha_aceptacion date, fecha_publicacion_online date"
    articulos = make([(i, 7 if i % 2 else None, None if i == 3 else "review", t, "" if i == 1 else None, datetime.date(1999, 2, i), None, None if i == 2 else datetime.date(9, 1, 1)) for i, t in enumerate(titles, 1)], f"id_articulo long, id_revista long, tipo_articulo string, titulo_articulo string, doi string, {dates}")
    revistas = make([(7, "J & Co", None, "")], "id_revista long, titulo_revista string, issn_impreso string, e_issn string")
    autores = make([(1, "Ñandú", "0000", None), (2, None, "", "S")], "id_autor long, apellidos string, orcid string, scopus_id string")
    links = make([(1, 2), (1, 1), (1, 9), (99, 1)], "id_articulo long, id_autor long")
    cited = make([(5, 1, None, "</title>", "", None), (4, 1, "book", None, None, "2"), (6, None, "x", "y", "z", None), (8, 2, None, None, None, None)], "id long, id_articulo long, tipo_de_entrada string, title string, year string, volume string")
    return jats.articles(articulos, revistas, autores, links, cited)


def test_jats_comes_back(spark, tmp_path):
    titles = ["<a> & \"b\" ]]> 'c'", " two \t\r\n lines ", "", None, "x\x00y\x1fz￾", "𝔸 &amp;  ", "w" * 1_000_000]
    rows = own_articles(spark, titles)
    jats.write(rows, str(tmp_path / "x"))
    back = jats.read(spark, str(tmp_path / "x"))
    heads = {r["id_articulo"]: r for r in jats.heads(back).collect()}
    assert [heads[i]["titulo_articulo"] for i in range(1, 8)] == [*titles[:4], "x�y�z�", *titles[5:]]
    assert [heads[i]["doi"] for i in (1, 2)] == ["", None] and [heads[i]["tipo_articulo"] for i in (1, 3)] == ["review", None]
    assert (heads[1]["titulo_revista"], heads[1]["issn_impreso"], heads[1]["e_issn"]) == ("J & Co", None, "") and heads[2]["id_revista"] is None
    assert (heads[1]["fecha_recepcion"], heads[1]["fecha_aceptacion"], heads[1]["fecha_publicacion_online"], heads[2]["fecha_publicacion_online"]) == (datetime.date(1999, 2, 1), None, datetime.date(9, 1, 1), None)
    people = sorted(map(tuple, jats.contributors(back).collect()))
    assert people == [(1, 1, 1, "Ñandú", "0000", None), (1, 2, 2, None, "", "S"), (1, 3, 9, None, None, None)]
    assert sorted(map(tuple, jats.references(back).collect()), key=lambda r: r[:2]) == [(1, 4, "book", None, None, "2"), (1, 5, None, "</title>", "", None), (2, 8, None, None, None, None)]
    jats.write(rows.coalesce(1), str(tmp_path / "small"), articles_per_file=3)
    assert len(list((tmp_path / "small").glob("part-*"))) == 3 and jats.read(spark, str(tmp_path / "small")).count() == 7
    with pytest.raises(Exception, match="already exists"):
        jats.write(rows, str(tmp_path / "x"))


def test_jats_files_are_small(spark, tmp_path):
    rows = own_articles(spark, ["A title"] * 27 + ["w"]).coalesce(1)
    many = rows.crossJoin(spark.range(300).select(jats.F.col("id").alias("n"))).drop("n").coalesce(1)
    jats.write(many, str(tmp_path / "x"))
    written, back = sum(p.stat().st_size for p in (tmp_path / "x").glob("part-*")), jats.read(spark, str(tmp_path / "x"))
    text = back.select(jats.F.sum(jats.F.length(jats.F.to_json(jats.F.struct("*"))))).first()[0]
    assert back.count() == 28 * 300 and written < text / 10


def test_article_with_many_references_goes_on(spark, tmp_path):
    make, dates = spark.createDataFrame, "fecha_recepcion date, fecha_aceptacion date, fecha_publicacion_online date"
    articulos = make([(i, None, "t", f"A{i}", None, None, None, None) for i in (0, 1, 1, 2)], f"id_articulo long, id_revista long, tipo_articulo string, titulo_articulo string, doi string, {dates}")
    revistas, autores = make([], "id_revista long, titulo_revista string, issn_impreso string, e_issn string"), make([], "id_autor long, apellidos string, orcid string, scopus_id string")
    links = make([(0, 5), (1, 6)], "id_articulo long, id_autor long")
    kept = [(i, i % 2, "x", None, None, "1") for i in range(23)]
    cited = make([*kept, *[(i, 99, None, None, None, None) for i in range(23, 40)]], "id long, id_articulo long, tipo_de_entrada string, title string, year string, volume string")
    rows = jats.articles(articulos, revistas, autores, links, cited, refs_each=5)
    assert rows.select(jats.F.max(jats.F.size("back.ref-list.ref"))).first()[0] == 5 and rows.count() == 1 + 1 + 1 + 1 + 2 + 2 * 2
    jats.write(rows, str(tmp_path / "x"))
    back = jats.read(spark, str(tmp_path / "x"))
    assert sorted((r["id_articulo"], r["titulo_articulo"]) for r in jats.heads(back).collect()) == [(0, "A0"), (1, "A1"), (1, "A1"), (2, "A2")]
    assert sorted((r["id_articulo"], r["id"]) for r in jats.references(back).collect()) == sorted((a, i) for i, a, *_ in kept for _ in range(1 + a))
    assert sorted((r["id_articulo"], r["id_autor"]) for r in jats.contributors(back).collect()) == [(0, 5), (1, 6), (1, 6)]


def test_jats_of_others_and_of_none(spark, tmp_path):
    (tmp_path / "other.xml").write_text('<?xml version="1.0"?><articles><article id="3" xml:lang="es"><front><article-meta><article-title>T</article-title><subject>no</subject></article-meta></front></article></articles>')
    assert [(r["id_articulo"], r["titulo_articulo"], r["doi"]) for r in jats.heads(jats.read(spark, str(tmp_path / "other.xml"))).collect()] == [(3, "T", None)]
    (tmp_path / "bad.xml").write_text('<articles><article id="three"></article></articles>')
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        jats.heads(jats.read(spark, str(tmp_path / "bad.xml"))).collect()
    jats.write(own_articles(spark, ["x"]).limit(0), str(tmp_path / "none"))
    assert jats.heads(jats.read(spark, str(tmp_path / "none"))).count() == 0


def test_side_files(spark, tmp_path):
    assert sidefiles.markdown_blocks(sidefiles.texts(spark, str(tmp_path / "missing.md"))).collect() == []
    (tmp_path / "99.md").write_text("# Colofón ñ {.unlisted}\r\n\r\nprinted\r\nhere\r\n")
    (tmp_path / "empty.md").write_text("")
    rows = sidefiles.markdown_blocks(sidefiles.texts(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r["pos"], r["kind"], r["level"], r["classes"], r["text"]) for r in rows] == [(1, "Header", 1, ["unlisted"], "Colofón ñ"), (2, "Para", 0, [], "printed here")]
    base = spark.createDataFrame([(1, 1, "Para", 0, [], "x")], "document long, pos int, kind string, level int, classes array<string>, text string")
    none = sidefiles.markdown_blocks(sidefiles.texts(spark, str(tmp_path / "missing.md"))).select("pos", "kind", "level", "classes", "text")
    assert blocks.with_colophon(base, none).count() == 2


def test_markdown_on_odd_texts(spark):
    odd = {"a": None, "b": "", "c": "\n \n\t\n", "d": "#no\n# yes #\n####### no", "e": "```\n```\n```{.r}\nx", "f": "para\n```\n# c\n```\npara\n# para", "g": "# a\n# b {#i .x .y}\nt\n# c", "h": "w " * 200_000}
    rows = spark.createDataFrame(list(odd.items()), "document string, text string").withColumn("pos", sidefiles.F.lit(9))
    got = {}
    for r in sidefiles.markdown_blocks(rows).orderBy("document", "pos").collect():
        got.setdefault(r["document"], []).append((r["kind"], r["level"], r["id"], r["classes"], r["text"]))
    para = lambda t: ("Para", 0, None, [], t)
    code = lambda t, c=(): ("CodeBlock", 0, None, list(c), t)
    assert got == {
        "d": [para("#no # yes # ####### no")],
        "e": [code(""), code("x", ["r"])],
        "f": [para("para"), code("# c"), para("para # para")],
        "g": [("Header", 1, None, [], "a"), ("Header", 1, "i", ["x", "y"], "b"), para("t # c")],
        "h": [para(odd["h"].strip())],
    }


def test_rules_of_the_book_model(spark):
    make = spark.createDataFrame
    tables = {
        "libros_md": make([(1, None), (2, None)], "id_libro long, id_serie long"),
        "partes_libro": make([(5, 1), (6, 2)], "id_parte long, id_libro long"),
        "capitulos": make([(50, 1, 5), (51, 2, 5), (52, 2, 6), (53, 1, 6)], "id_capitulo long, id_libro long, id_parte long"),
        "capitulo_autor": make([(1, 50), (2, 51), (3, 53), (4, None)], "id_relacion long, id_capitulo long"),
    }
    left = catalogue.after_deletion(tables, books.rules(spark), "libros_md", tables["libros_md"].filter("id_libro = 1"))
    rows = lambda t: sorted(map(tuple, left[t].collect()), key=str)
    assert rows("partes_libro") == [(6, 2)] and rows("capitulos") == [(51, 2, None), (52, 2, 6)] and rows("capitulo_autor") == [(2, 51), (4, None)]
    assert all(len(r["columns"]) == 1 for r in books.rules(spark).collect()) and books.rules(spark).count() == 18
