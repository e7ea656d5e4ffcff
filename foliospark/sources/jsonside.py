"""Metadata beside documents as JSON text: values by paths in order, lenient, and texts as JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_value(text: Column, paths: Sequence[str]) -> Column:
    """The value of the first path that is there; null if none is, or if the text is no JSON."""
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])


def quoted(text: Column) -> Column:
    """The text as a JSON string: quotes, backslashes and control characters escaped. Null stays null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def first_values(rows: DataFrame, column: str, paths: Mapping[str, Sequence[str]]) -> DataFrame:
    """``rows`` with a column for each name in ``paths``, and ``quoted``, the first of them as a JSON string."""
    out = rows.withColumns({name: first_value(F.col(column), own) for name, own in paths.items()})
    name = next(iter(paths))
    return out.withColumn("quoted", F.when(F.col(name).isNotNull(), quoted(F.col(name))))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields included; an existing folder is an error."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_texts(rows: DataFrame, column: str, path: str) -> None:
    """One text (such as a document's JATS) a line, line feeds in it as spaces, as text files; null texts are left out."""
    rows.select(F.regexp_replace(column, "[\r\n]+", " ").alias("value")).dropna().write.text(path)
