"""Text compared as the catalogue's own database compares it: case, accents and blanks at the end do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATABASE = "UNICODE_CI_AI_RTRIM"


def collated(table: DataFrame, collation: str = DATABASE) -> DataFrame:
    """``table`` with its text columns under ``collation``: ``=``, IN, keys of groups and joins, DISTINCT, order, least and
    greatest follow it. A group shows one of its spellings. Conditions on such columns do not reach the files.
    """
    return table.select(*[_column(f, collation) for f in table.schema])


def _column(field: T.StructField, collation: str) -> Column:
    column = F.col(f"`{field.name}`")
    return F.collate(column, collation).alias(field.name) if isinstance(field.dataType, T.StringType) else column
