import pytest

from conftest import SF, plain
from foliospark.catalog import registry
from foliospark.catalog.expected import EXPECTED
from foliospark.catalog.spec import Listing, for_spark, for_sql
from foliospark.functions.collation import DATABASE

#: Forms of all kinds; the driver compares all queries.
CODES = sorted({*(c for i, c in enumerate(sorted(EXPECTED)) if i % 4 == 0), "AUT-REV-003", "AUT-BIB-002", "ART-WF-002", "ART-STD-001", "ART-PROD-003", "REV-META-002", "REV-AUD-003", "CROSS-001", "CROSS-002", "CROSS-004", "CROSS-006", "CROSS-006-STRICT", "BIB-006", "BIB-ART-002", "BIB-CAL-001"})


@pytest.mark.parametrize("code", CODES)
def test_same_as_sql(spark, duck, code):
    frame = registry.run(spark, SF, code)
    other = duck.sql(registry.expected_sql(registry.CATALOGUE[code]))
    order = [other.columns.index(c) for c in frame.columns]
    assert plain(frame.collect()) == plain([r[i] for i in order] for r in other.fetchall())


def test_catalogue_is_whole():
    assert len(registry.CATALOGUE) == 83 and set(registry.CATALOGUE) == set(EXPECTED)
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_short_forms():
    assert for_spark("days(AS_OF, a)", "2001-01-01") == "CAST(datediff(DATE '2001-01-01', a) AS BIGINT)"
    assert for_sql("days(AS_OF, a)", "2001-01-01") == "date_diff('day', a, DATE '2001-01-01')"


def test_strict_reading_has_fewer_rows(spark):
    assert registry.run(spark, SF, "CROSS-006-STRICT").count() <= registry.run(spark, SF, "CROSS-006").count()


AUTHORS = "id_autor long, apellidos string, apellidos_nombre string, email_principal string, area_investigacion string, estado_autor string, disponible_revision int, pais_afiliacion string, clasificacion_oecd string, h_index long"
REFERENCES = "id long, id_articulo long, author string, year string, date string, location string, publisher string"


def tables(spark, **rows):
    made = {}
    for name, (schema, values) in rows.items():
        made[name] = spark.createDataFrame(values, schema)
    return made.__getitem__


def test_equal_names_blanks_and_ties(spark):
    author = lambda i, name, area, **kw: (i, name, name, None, area, kw.get("state", "activo"), 1, kw.get("land"), "O", kw.get("h"))
    people = [author(1, "Paz", "a", land=""), author(2, "Paz", "a", land=""), author(3, "Ruiz", "b"), author(4, "x", "c"), author(5, "y", "c"), author(6, "z", "c"), author(7, "w", "d", state="inactivo"), author(8, None, "e")]
    t = tables(spark, autores=(AUTHORS, people))
    run = lambda code: [tuple(r) for r in registry.CATALOGUE[code].frame(t).collect()]
    assert run("AUT-REV-003") == [("b", 1, "Ruiz"), ("e", 1, None), ("a", 2, "Paz; Paz")]
    assert run("AUT-DISC-003") == [("O", 7, "")]
    refs = [(i, 1 + i % 2, a, y, d, None, p) for i, (a, y, d, p) in enumerate([("A", "1999", None, "P"), ("A", "2005", None, "P"), ("A", "1999", "2001-03", "P"), ("", None, None, ""), ("", None, None, "Q"), ("B", None, None, None)])]
    t = tables(spark, bibtex=(REFERENCES, refs))
    assert run("BIB-006") == [("A", 3, 2, "2005, 2001, 1999"), ("", 2, 2, None), ("B", 1, 1, None)]
    assert run("BIB-005") == [("P", 3, None), ("", 1, None), ("Q", 1, None)]


def test_h_index_ranges(spark):
    people = [(i, "n", "n", None, "a", "activo", 1, None, None, h) for i, h in enumerate([None, -1, 0, 5, 6, 10, 11, 20, 21, 90])]
    found = {r["rango"]: r["autores"] for r in registry.CATALOGUE["AUT-BIB-002"].frame(tables(spark, autores=(AUTHORS, people))).collect()}
    assert found == {"Sin datos": 2, "0-5 (Emergentes)": 2, "6-10 (Intermedios)": 2, "11-20 (Consolidados)": 2, "21+ (Líderes)": 2}


def test_collation_of_the_database(spark):
    person = lambda i, area, state, land=None: (i, "n", f"N{i}", None, area, state, 1, land, "Ó ", None)
    people = [person(1, "Física", "ACTIVO", "Perú"), person(2, "fisica ", "activo", "peru"), person(3, "FÍSICA", "Activo ", "Chile"), person(4, "fisica", "inactivo", "x")]
    t = tables(spark, autores=(AUTHORS, people))
    run = lambda code, c: [tuple(r) for r in registry.frame(code, t, collation=c).collect()]
    assert run("AUT-REV-003", None) == [("fisica ", 1, "N2")]
    assert run("AUT-REV-003", DATABASE) == []  # three reviewers of one area
    assert [r[1:] for r in run("AUT-DISC-003", DATABASE)] == [(3, "Chile, Perú")]
    journal = "id_revista long, titulo_revista string, issn_impreso string, e_issn string, estado_publicacion string"
    t = tables(spark, revistas_md=(journal, [(1, "t", "1234-567x", "abcd-1234", "Activa"), (2, "t", "1234-567x", None, "activa")]))
    assert [r[4:] for r in run("REV-META-002", None)] == [("FORMATO INVÁLIDO", "OK")]
    assert sorted(r[4:] for r in run("REV-META-002", DATABASE)) == [("OK", "FORMATO INVÁLIDO"), ("OK", "OK")]


def test_all_queries_have_a_plan_under_collations(spark):
    for code in registry.CATALOGUE:
        assert registry.run(spark, SF, code, collation=DATABASE).columns == registry.run(spark, SF, code).columns


def test_removed_queries_leave_a_row(spark):
    own = Listing("OWN-1", "One's own", "autores", {"id": "id_autor"})
    registry.register(own)
    row = registry.remove(spark, "OWN-1", "ana", "2001-12-31 10:00:00").first()
    assert row[:4] == ("OWN-1", "One's own", "autores", "ana") and str(row["removed_at"]) == "2001-12-31 10:00:00" and "OWN-1" not in registry.CATALOGUE
    with pytest.raises(KeyError):
        registry.remove(spark, "OWN-1", "ana", "2001-12-31 10:00:00")


def test_one_scan_for_each_table_of_a_dashboard(spark):
    for code, most in (("AUT-ID-002", 1), ("ART-STD-001", 1), ("ART-MET-003", 1)):
        plan = registry.run(spark, SF, code)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("customer.parquet") <= most and plan.count("orders.parquet") <= most, code
