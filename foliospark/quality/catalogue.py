"""Constraints as data: rows that say what must hold drive the checks, the comparison with a target, and deletions.

A constraint is a row of ``table``, ``rule`` (primary, unique, reference), ``columns``, ``parent``, ``parent_columns`` and ``on_delete``, as
``dump.constraints`` reads them from a dump or ``declared`` makes them; enumerations and required columns come from definitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "`table` string, rule string, columns array<string>, parent string, parent_columns array<string>, on_delete string"
FIELDS = ("table", "rule", "columns", "parent", "parent_columns", "on_delete")


def declared(spark: SparkSession, rows: Iterable[tuple[str, str, Sequence[str], str | None, Sequence[str] | None, str | None]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def _whole(columns: Sequence[str]):
    """No column is null; references and unique keys with a null are exempt."""
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])


def _repeated(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    keys = [F.col(f"`{c}`") for c in columns]
    return table.filter(_whole(columns)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(1))


def _orphans(table: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    keys = parent.select(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(parent_columns)])
    equal = reduce(lambda a, b: a & b, [F.col(f"`{c}`") == F.col(f"__p{i}") for i, c in enumerate(columns)])
    return table.filter(_whole(columns)).join(keys, equal, "left_anti").select(F.lit(1))


def broken(tables: Mapping[str, DataFrame], constraints: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """``table``, ``rule``, ``columns`` (joined by commas) and ``n``: a row for each constraint on the given tables, with how many rows break it
    (repeated keys count once each; a primary key also counts its nulls). With ``definitions`` also ``domain`` and ``required``.
    References to tables that are not given are left out. Constraints are read on the driver, of the tables only counts leave the executors.
    """
    found: list[tuple[str, str, Sequence[str], DataFrame]] = []
    for r in constraints.orderBy("table", "rule", "columns", "parent").collect():
        if r["table"] not in tables:
            continue
        own = tables[r["table"]]
        if r["rule"] == "reference":
            if r["parent"] in tables:
                found.append((r["table"], "reference", r["columns"], _orphans(own, r["columns"], tables[r["parent"]], r["parent_columns"])))
            continue
        rows = _repeated(own, r["columns"])
        found.append((r["table"], r["rule"], r["columns"], rows.unionAll(own.filter(~_whole(r["columns"])).select(F.lit(1))) if r["rule"] == "primary" else rows))
    for d in definitions.orderBy("table", "place").collect() if definitions is not None else ():
        if d["table"] not in tables:
            continue
        own, column = tables[d["table"]], F.col(f"`{d['column']}`")
        if d["domain"] is not None:
            found.append((d["table"], "domain", [d["column"]], own.filter(column.isNotNull() & ~column.isin(d["domain"])).select(F.lit(1))))
        if not d["nullable"]:
            found.append((d["table"], "required", [d["column"]], own.filter(column.isNull()).select(F.lit(1))))
    if not found:
        return constraints.sparkSession.createDataFrame([], "`table` string, rule string, columns string, n long")
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), F.lit(rule).alias("rule"), F.lit(",".join(c)).alias("columns"), "n") for t, rule, c, rows in found]
    return reduce(DataFrame.unionAll, counts)


def statistics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table``, ``place``, ``column``, ``kind``, ``n_rows`` and ``n_null`` for each column, counted over all rows, one pass a table."""
    parts = []
    for name, table in tables.items():
        nulls = [F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("kind"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("n_null")) for i, f in enumerate(table.schema, 1)]
        counted = table.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*nulls).alias("c"))
        parts.append(counted.select("n_rows", F.explode("c").alias("c")).select(F.lit(name).alias("table"), "c.place", "c.column", "c.kind", "n_rows", "c.n_null"))
    return reduce(DataFrame.unionAll, parts)


def pending(have: DataFrame, want: DataFrame) -> DataFrame:
    """Constraints with ``change``: ``add`` for those that only ``want`` holds, ``drop`` for those that only ``have`` holds."""
    a, b = have.select(*FIELDS).distinct(), want.select(*FIELDS).distinct()
    missing, more = b.exceptAll(a), a.exceptAll(b)
    return missing.withColumn("change", F.lit("add")).unionByName(more.withColumn("change", F.lit("drop")))


def applied(have: DataFrame, change: DataFrame) -> DataFrame:
    """``have`` after the changes. Applying what is pending leaves nothing pending; applying twice is applying once."""
    kept = have.select(*FIELDS).distinct().exceptAll(change.filter("change = 'drop'").select(*FIELDS))
    return kept.unionByName(change.filter("change = 'add'").select(*FIELDS)).distinct()


def verified(tables: Mapping[str, DataFrame], constraints: DataFrame, definitions: DataFrame | None = None) -> None:
    """An error that names the constraints that rows break."""
    bad = broken(tables, constraints, definitions).filter("n > 0").collect()
    if bad:
        raise ValueError("broken: " + "; ".join(f"{r['table']} {r['rule']} ({r['columns']}): {r['n']}" for r in bad))


def after_deletion(tables: Mapping[str, DataFrame], constraints: DataFrame, table: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables once the rows of ``deleted`` (the primary key's columns) are gone. Rows that lead to them go too (cascade), level by
    level, or lose the reference (set null). A restricting reference from a row that stays is an error when its table is read.
    References in a circle are followed once.
    """
    rules = constraints.collect()
    primary = {r["table"]: r["columns"] for r in rules if r["rule"] == "primary"}
    keys = deleted.select(*[F.col(f"`{c}`") for c in primary[table]]).distinct()
    kept = tables[table].join(keys, list(primary[table]), "left_anti")
    return _followed({**tables, table: kept}, rules, primary, table, tables[table].join(keys, list(primary[table]), "left_semi"), (table,))


def _followed(tables: dict[str, DataFrame], rules: list[T.Row], primary: dict[str, Sequence[str]], table: str, gone: DataFrame, path: tuple[str, ...]) -> dict[str, DataFrame]:
    for r in rules:
        child = r["table"]
        if r["rule"] != "reference" or r["parent"] != table or child not in tables or child in path:
            continue
        rows = tables[child]
        keys = gone.select(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(r["parent_columns"])]).distinct()
        hit = reduce(lambda a, b: a & b, [F.col(f"`{c}`") == F.col(f"__p{i}") for i, c in enumerate(r["columns"])])
        if r["on_delete"] == "cascade":
            lost = rows.join(keys, hit, "left_semi")
            tables = _followed({**tables, child: rows.join(keys, hit, "left_anti")}, rules, primary, child, lost, (*path, child))
            continue
        met = rows.join(keys, hit, "left")
        if r["on_delete"] == "set null":
            new = {c: F.when(F.col("__p0").isNull(), F.col(f"`{c}`")).alias(c) for c in r["columns"]}
        else:
            refusal = F.raise_error(F.lit(f"{child}.{','.join(r['columns'])} restricts the deletion in {table}"))
            first = r["columns"][0]
            new = {first: F.when(F.col("__p0").isNull(), F.col(f"`{first}`")).otherwise(refusal.cast(rows.schema[first].dataType)).alias(first)}
        tables = {**tables, child: met.select(*[new.get(c, F.col(f"`{c}`")) for c in rows.columns])}
    return tables
