"""The book model: its keys, references and domains, and one table of what breaks them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.quality import catalogue, constraints

# Names, widths and domains of the book tables.
WIDTHS = {"colecciones": 20, "series": 14, "libros_md": 68, "partes_libro": 11, "capitulos": 79, "libro_autor": 16, "capitulo_autor": 18}
#: Table and column that no two rows may share; the primary keys may not be null either.
PRIMARY = {"colecciones": "id_coleccion", "series": "id_serie", "libros_md": "id_libro", "partes_libro": "id_parte", "capitulos": "id_capitulo", "libro_autor": "id_relacion", "capitulo_autor": "id_relacion"}
UNIQUE = (("colecciones", "issn"), ("series", "issn"), ("libros_md", "id_proyecto"))
#: Table, column, the table it leads to, and what a deletion there does.
REFERENCES = (
    ("series", "id_coleccion", "colecciones", "cascade"),
    ("libros_md", "id_coleccion", "colecciones", "set null"),
    ("libros_md", "id_serie", "series", "set null"),
    ("partes_libro", "id_libro", "libros_md", "cascade"),
    ("capitulos", "id_libro", "libros_md", "cascade"),
    ("capitulos", "id_parte", "partes_libro", "set null"),
    ("libro_autor", "id_libro", "libros_md", "cascade"),
    ("capitulo_autor", "id_capitulo", "capitulos", "cascade"),
)
DOMAINS = {
    ("libros_md", "tipo_libro"): ("monografia", "obra_colectiva", "compilacion", "traduccion", "referencia", "manual", "actas"),
    ("libros_md", "lugar_bibliografia"): ("consolidada", "por_capitulo"),
    ("libros_md", "estado_publicacion"): ("en_preparacion", "publicado", "agotado", "descatalogado"),
    ("libros_md", "tipo_acceso"): ("abierto", "venta", "mixto", "embargado"),
    ("capitulos", "crossref_estado"): ("pendiente", "sandbox", "produccion"),
    ("capitulos", "estado_capitulo"): ("borrador", "en_revision", "aceptado", "en_produccion", "publicado"),
    ("libro_autor", "rol_libro"): ("autor", "editor", "compilador", "coordinador", "prologuista_externo", "traductor", "ilustrador", "director_coleccion"),
    ("capitulo_autor", "rol_autor"): ("autor", "coautor", "autor_correspondencia", "editor", "revisor", "traductor", "ilustrador"),
}


def rules(spark: SparkSession) -> DataFrame:
    """The model's keys and references as constraints of the catalogue, which check, compare and delete by them."""
    primary = [(t, "primary", [c], None, None, None) for t, c in PRIMARY.items()]
    unique = [(t, "unique", [c], None, None, None) for t, c in UNIQUE]
    return catalogue.declared(spark, [*primary, *unique, *[(t, "reference", [c], to, [PRIMARY[to]], action) for t, c, to, action in REFERENCES]])


def violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``tabla``, ``columna``, ``regla`` (primary, unique, reference, domain) and ``n``, the rows that break it (for repeated keys the
    keys); one row for each rule that the given tables and columns allow to check, 0 included. Each rule is a count, so nothing
    but counts leaves the executors.
    """
    has = lambda table, column: table in tables and column in tables[table].columns
    found: list[tuple[str, str, str, DataFrame]] = []
    for table, key in PRIMARY.items():
        if has(table, key):
            own = tables[table].select(key)
            found.append((table, key, "primary", constraints.repeated_keys(own, key).select(key).unionAll(own.filter(F.col(key).isNull()))))
    found += [(t, c, "unique", constraints.repeated_keys(tables[t], c)) for t, c in UNIQUE if has(t, c)]
    found += [(t, c, "reference", constraints.orphans(tables[t], c, tables[to], PRIMARY[to])) for t, c, to, _ in REFERENCES if has(t, c) and has(to, PRIMARY[to])]
    found += [(t, c, "domain", constraints.outside_domain(tables[t], c, list(domain))) for (t, c), domain in DOMAINS.items() if has(t, c)]
    if not found:
        raise ValueError("no table of the book model")
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tabla"), F.lit(c).alias("columna"), F.lit(rule).alias("regla"), "n") for t, c, rule, rows in found]
    return reduce(DataFrame.unionAll, counts)


def wrong_widths(tables: Mapping[str, DataFrame]) -> dict[str, int | None]:
    """Tables of the model whose number of columns is not the expected one, with theirs; None where the table is missing."""
    have = {name: len(tables[name].columns) if name in tables else None for name in WIDTHS}
    return {name: n for name, n in have.items() if n != WIDTHS[name]}


def after_deletion(tables: Mapping[str, DataFrame], table: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables once the rows with the keys of ``deleted`` are gone: rows that lead to them go too, level by level, or lose the
    reference, as the model says.
    """
    keys = deleted.select(F.col(PRIMARY[table]).alias("__gone")).distinct()
    kept = tables[table].join(keys, F.col(PRIMARY[table]) == F.col("__gone"), "left_anti")
    return _followed({**tables, table: kept}, table, keys)


def _followed(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    for child, column, parent, action in REFERENCES:
        if parent != table or child not in tables:
            continue
        rows, gone = tables[child], F.col(column) == F.col("__gone")
        if action == "cascade":
            lost = rows.join(keys, gone, "left_semi").select(F.col(PRIMARY[child]).alias("__gone")).distinct()
            tables = _followed({**tables, child: rows.join(keys, gone, "left_anti")}, child, lost)
        else:
            cleared = F.when(F.col("__gone").isNull(), F.col(column))
            tables = {**tables, child: rows.join(keys, gone, "left").withColumn(column, cleared).select(rows.columns)}
    return tables
