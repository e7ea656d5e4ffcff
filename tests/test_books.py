"""The book model on small tables."""

import pytest

from foliospark.quality import books, constraints


def model(spark):
    make = spark.createDataFrame
    return {
        "colecciones": make([(1, "a"), (2, "a"), (3, None), (4, None)], "id_coleccion long, issn string"),
        "series": make([(10, 1), (11, 2), (11, 9), (None, 1)], "id_serie long, id_coleccion long"),
        "libros_md": make([(100, 1, 10, "manual"), (101, 2, 11, "x"), (102, None, None, None), (103, 2, 10, "actas")], "id_libro long, id_coleccion long, id_serie long, tipo_libro string"),
        "partes_libro": make([(5, 100), (6, 101)], "id_parte long, id_libro long"),
        "capitulos": make([(50, 100, 5), (51, 101, 6), (52, 103, 6), (53, 102, None)], "id_capitulo long, id_libro long, id_parte long"),
    }


def test_violations(spark):
    got = {(r["tabla"], r["columna"], r["regla"]): r["n"] for r in books.violations(model(spark)).collect()}
    assert {k: n for k, n in got.items() if n} == {("series", "id_serie", "primary"): 2, ("colecciones", "issn", "unique"): 1, ("series", "id_coleccion", "reference"): 1, ("libros_md", "tipo_libro", "domain"): 1}
    assert got["capitulos", "id_parte", "reference"] == 0 and ("series", "issn", "unique") not in got
    assert all(r["n"] == 0 for r in books.violations({k: t.limit(0) for k, t in model(spark).items()}).collect())
    with pytest.raises(ValueError, match="no table"):
        books.violations({})


def test_deletion_goes_on_or_clears(spark):
    tables = model(spark)
    rows = lambda t: sorted(map(tuple, t.collect()), key=str)
    out = books.after_deletion(tables, "colecciones", tables["colecciones"].filter("id_coleccion = 2"))
    assert rows(out["colecciones"].select("id_coleccion")) == [(1,), (3,), (4,)]
    assert rows(out["series"]) == [(10, 1), (11, 9), (None, 1)]
    assert rows(out["libros_md"].select("id_libro", "id_coleccion", "id_serie")) == [(100, 1, 10), (101, None, None), (102, None, None), (103, None, 10)]
    out = books.after_deletion(tables, "libros_md", tables["libros_md"].filter("id_libro = 101"))
    assert rows(out["partes_libro"]) == [(5, 100)] and rows(out["capitulos"]) == [(50, 100, 5), (52, 103, None), (53, 102, None)]


def test_widths(spark):
    assert books.wrong_widths({"series": model(spark)["series"]}) == {name: (2 if name == "series" else None) for name in books.WIDTHS}


def test_corresponding_author_of_updates(spark):
    schema = "id_articulo long, id_autor long, es_correspondencia int"
    links = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, None), (2, 1, 0), (2, 2, None)], schema)
    updates = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1), (1, 2, 0), (9, 9, 1)], schema)
    assert sorted(map(tuple, constraints.refused_correspondents(links, updates).collect())) == [(1, 2, 1), (1, 3, 1)]
