"""Schema evolution: what of a target is pending, applied so that a second run finds nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Change:
    kind: str  # add, drop, retype or remap
    column: str
    detail: str = ""


@dataclass(frozen=True)
class Target:
    """Columns that a table shall have, columns that it shall not, and domains with the value for all else."""

    columns: dict[str, str]
    dropped: tuple[str, ...] = ()
    domains: dict[str, tuple[tuple[str, ...], str]] | None = None


def pending(schema: T.StructType, target: Target) -> list[Change]:
    """From the schema alone: columns to add, retype and drop."""
    have = {f.name: f.dataType.simpleString() for f in schema}
    out = [Change("add", c, kind) for c, kind in target.columns.items() if c not in have]
    out += [Change("retype", c, kind) for c, kind in target.columns.items() if c in have and have[c] != kind]
    return out + [Change("drop", c) for c in target.dropped if c in have]


def applied(table: DataFrame, target: Target) -> DataFrame:
    """Values outside a domain first become its default, then columns change. Applying twice is applying once."""
    for column, (domain, default) in (target.domains or {}).items():
        if column in table.columns:
            table = table.withColumn(column, F.when(F.col(column).isNull() | F.col(column).isin(*domain), F.col(column)).otherwise(F.lit(default)))
    for change in pending(table.schema, target):
        if change.kind == "add":
            table = table.withColumn(change.column, F.lit(None).cast(change.detail))
        elif change.kind == "retype":
            table = table.withColumn(change.column, F.col(change.column).try_cast(change.detail))
        else:
            table = table.drop(change.column)
    return table
