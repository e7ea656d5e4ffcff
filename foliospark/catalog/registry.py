"""The catalogue by code, and its queries by function name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalog import articles, authors, bibliography, crossed, journals
from foliospark.catalog.expected import EXPECTED
from foliospark.catalog.spec import Built, Grouping, Listing, Tables
from foliospark.functions.collation import collated
from foliospark.sources.bridge import AS_OF, editorial_tables, sql_views

Query = Listing | Grouping | Built
CATALOGUE: dict[str, Query] = {q.code: q for part in (authors, articles, journals, crossed, bibliography) for q in part.QUERIES}


def register(query: Query) -> None:
    """Adds a query of one's own; a code is taken once."""
    if query.code in CATALOGUE:
        raise ValueError(f"{query.code} is taken")
    CATALOGUE[query.code] = query


def remove(spark: SparkSession, code: str, by: str, at: str) -> DataFrame:
    """Takes a query out of the catalogue. What it was, by whom and when (a timestamp as text) it was removed comes back as a
    row, to be appended to the table of removed queries. A code that is not there is an error.
    """
    query = CATALOGUE[code]
    row = (query.code, query.title, ",".join(query.needs()), by, at)
    out = spark.createDataFrame([row], "code string, title string, tables string, removed_by string, at string")
    out = out.select("code", "title", "tables", "removed_by", F.col("at").cast("timestamp").alias("removed_at"))
    del CATALOGUE[code]
    return out


def name(code: str) -> str:
    return code.lower().replace("-", "_")


def run(spark: SparkSession, sf_dir: str, code: str, as_of: str = AS_OF, collation: str | None = None) -> DataFrame:
    """A query's rows. Texts compare by code point, or under ``collation`` if one is given."""
    return frame(code, editorial_tables(spark, sf_dir).table, as_of, collation)


def frame(code: str, tables: Tables, as_of: str = AS_OF, collation: str | None = None) -> DataFrame:
    """The same over one's own tables."""
    own = (lambda name: collated(tables(name), collation)) if collation else tables
    return CATALOGUE[code].frame(own, as_of, collation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name(c): (lambda spark, sf_dir, c=c: run(spark, sf_dir, c)) for c in CATALOGUE}


def oracle_sql() -> dict[str, str]:
    return {name(c): expected_sql(q) for c, q in CATALOGUE.items()}


def expected_sql(query: Query) -> str:
    """SQL written by hand where there is some, else that made from the query's own text."""
    if query.code in EXPECTED:
        body = EXPECTED[query.code].strip()
        return sql_views(list(query.needs())) + (",\n" + body.removeprefix("WITH ") if body.startswith("WITH ") else "\n" + body)
    return query.sql()


def listing(spark: SparkSession) -> DataFrame:
    """The catalogue as a table."""
    return spark.createDataFrame([(q.code, q.title, ",".join(q.needs())) for q in CATALOGUE.values()], "code string, title string, tables string")
