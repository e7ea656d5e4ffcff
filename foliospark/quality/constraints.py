"""Keys, references, domains and the rule of one corresponding author, each as a query for its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(table: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with how often. Keys with a null are exempt, as in SQL."""
    whole = table
    for column in key:
        whole = whole.filter(F.col(column).isNotNull())
    return whole.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(table: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is set and leads nowhere."""
    keys = parent.select(F.col(parent_key).alias("__key"))
    return table.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")


def cascaded(table: DataFrame, column: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """Rows that a deletion takes along."""
    keys = deleted.select(F.col(deleted_key).alias("__key"))
    return table.join(keys, F.col(column) == F.col("__key"), "left_semi")


def outside_domain(table: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return table.filter(F.col(column).isNotNull() & ~F.col(column).isin(domain))


def several_correspondents(links: DataFrame, article: str = "id_articulo", flag: str = "es_correspondencia") -> DataFrame:
    """Articles with more than one corresponding author."""
    return links.groupBy(article).agg(F.sum(F.coalesce(flag, F.lit(0))).alias("n")).filter("n > 1")


def refused_correspondents(links: DataFrame, updates: DataFrame, article: str = "id_articulo", author: str = "id_autor", flag: str = "es_correspondencia") -> DataFrame:
    """Updates that would make an author the corresponding one although another author of the article is.

    ``links`` has a row for each article and author; ``updates`` are rows of the same three columns with the new flag. An update
    counts only where the flag goes from 0 or null to 1, so the row itself is never the other one. Each is held against the
    links as they stand, not against other updates; updates of rows that are not there are none.
    """
    unset = links.filter(F.coalesce(flag, F.lit(0)) == 0).select(article, author)
    taken = links.filter(F.col(flag) == 1).select(article)
    return updates.filter(F.col(flag) == 1).join(unset, [article, author], "left_semi").join(taken, article, "left_semi")
