"""SQL dumps as a source and a sink: ``CREATE TABLE`` gives schemas and constraints, ``INSERT ... VALUES`` gives typed rows.

A dump is read by Spark's text source with the end of a statement as the line separator, so it is split like any text file, in
any store that Spark reads. Each statement is then parsed on its own, by regular expressions in the plan. Only the
definitions, a row a column, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ends a statement. Dumps write a line feed within a text as an escape, so a text holds no such end.
END = ";\n"
#: Comments and blank lines before a statement.
BLANK = r"(?:\s++|--[^\n]*+(?:\n|$)|/\*.*?\*/;?)"
LEAD = rf"(?s)^{BLANK}++"
#: What stands before the rows of a statement, comments included: its match ends at the first row, however long the statement is.
HEAD = rf"(?is)^{BLANK}*+INSERT\s++(?:IGNORE\s++)?INTO\s++[`\"]?([A-Za-z_]\w*+)[`\"]?\s*+(\([^()']*+\))?\s*+VALUES\s*+"
# Possessive: a text of any length is matched in a loop, not by recursion.
TEXT = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
#: A quoted text (quotes doubled or escaped), perhaps with its character set, or a bare value.
VALUE = rf"(?:_[a-z]\w*+\s*+)?{TEXT}|[^\s,()']++"
ROW = rf"(?s)\(\s*+(?:{VALUE})(?:\s*+,\s*+(?:{VALUE}))*+\s*+\)"
NAME = r"[`\"]([^`\"]++)[`\"]"
#: Matches any statement at its start, so that the text of a long one is not searched; the group is empty for others than definitions.
DEFINES = rf"(?is)^{BLANK}*+(CREATE|)"
CREATE = rf"(?is)^\s*+CREATE\s++TABLE\s++(?:IF\s++NOT\s++EXISTS\s++)?{NAME}\s*+\((.*)\)[^)]*?$"
COLUMN = rf"(?is)^\s*+{NAME}\s++([a-z]++(?:\s*+\((?:{TEXT}|[^')])*+\))?+(?:\s++unsigned)?+)(.*)$"
KEY = rf"(?is)^\s*+(?:CONSTRAINT\s++{NAME}\s++)?+(PRIMARY|UNIQUE|FOREIGN)\s++(?:KEY|INDEX)?\s*+(?:{NAME})?\s*+\(((?:[^()]|\(\d++\))*+)\)(.*)$"
PARENT = rf"(?is)REFERENCES\s++{NAME}\s*+\(([^)]*+)\)"
#: Kinds of columns by the first word of their type. Texts, enumerations and JSON are strings.
KINDS = {
    "tinyint": "int", "smallint": "int", "mediumint": "int", "int": "int", "integer": "int", "year": "int", "bigint": "bigint", "float": "float", "double": "double",
    "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp", "binary": "binary", "varbinary": "binary", "blob": "binary", "tinyblob": "binary", "mediumblob": "binary", "longblob": "binary",
}
CURRENT = ("CURRENT_TIMESTAMP", "NOW()", "CURRENT_DATE")


def inserted(statements: DataFrame, column: str) -> DataFrame:
    """One row for each row that the statements insert: the statement's other columns, ``table``, ``row`` (its number in the
    statement, from 1), ``values`` (texts without quotes and escapes, null for NULL), ``fields``, the same joined by ``|``, and ``columns``, the
    names that the statement lists, or null.

    Text that is no such statement, and null, give no rows.
    """
    rest = [F.col(f"`{c}`") for c in statements.columns if c != column]
    head = F.regexp_extract(column, HEAD, 0)
    found = statements.select(*rest, F.col(f"`{column}`").alias("__text"), head.alias("__head"), F.regexp_extract(head, HEAD, 1).alias("table")).filter("table <> ''")
    listed = F.regexp_extract("__head", HEAD, 2)
    body = F.expr("substring(__text, length(__head) + 1)")
    rows = found.select(*rest, "table", F.when(listed != "", _names(listed)).alias("columns"), F.posexplode(F.regexp_extract_all(body, F.lit(ROW), F.lit(0))).alias("__i", "__row"))
    raw = F.regexp_extract_all(F.expr("substring(__row, 2, length(__row) - 2)"), F.lit(f"(?s){VALUE}"), F.lit(0))
    parsed = rows.select(*rest, "table", (F.col("__i") + 1).cast("long").alias("row"), F.transform(raw, _value).alias("values"), "columns")
    return parsed.withColumn("fields", F.array_join("values", "|", "NULL"))


def _names(listed: Column) -> Column:
    return F.split(F.regexp_replace(listed, r"\(\d+\)|[`\"()\s]", ""), ",")


def _unescaped(inner: Column) -> Column:
    """Between pairs of backslashes, which are one each, a backslash stands before a letter or sign."""
    out = F.regexp_replace(inner, r"(?<!\\)''", "'")
    for sign, value in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("0", "\x00"), ("b", "\b"), ("Z", "\x1a")):
        out = F.replace(out, F.lit("\\" + sign), F.lit(value))
    return F.regexp_replace(out, r"(?s)\\(?![%_])(.)", "$1")


def _value(value: Column) -> Column:
    """Few values have a character set or a backslash, and only these go through the patterns."""
    text = F.when(value.startswith("_"), F.regexp_replace(value, r"(?s)^_[a-z]\w*+\s*+(?=')", "")).otherwise(value)
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    escaped = F.array_join(F.transform(F.split(inner, r"\\\\"), _unescaped), "\\")
    plain = F.when(inner.contains("\\"), escaped).otherwise(F.replace(inner, F.lit("''"), F.lit("'")))
    return F.when(text.startswith("'"), plain).when(F.upper(text) != "NULL", text)


def statements(spark: SparkSession, path: str) -> DataFrame:
    """The dump's statements (column ``statement``), comments before them included; several files are one dump."""
    return spark.read.text(path, lineSep=END).select(F.col("value").alias("statement"))


def _bodies(dump: DataFrame, column: str) -> DataFrame:
    text = F.regexp_replace(column, LEAD, "")
    found = dump.filter(F.regexp_extract(column, DEFINES, 1) != "").select(F.regexp_extract(text, CREATE, 1).alias("table"), F.regexp_extract(text, CREATE, 2).alias("body")).filter("`table` <> ''")
    return found.select("table", F.posexplode(F.split("body", r",[ \t]*\r?\n")).alias("at", "line"))


def definitions(dump: DataFrame, column: str = "statement") -> DataFrame:
    """One row for each column of each ``CREATE TABLE``: ``table``, ``place`` (from 1), ``column``, ``type`` as written, ``kind`` (the type here),
    ``nullable``, ``default`` (null if none, or if it is the time of writing) and ``domain``, the values of an enumeration or null.
    Each definition is on a line of its own, as dumps write them.
    """
    lines = _bodies(dump, column).select("table", "at", *[F.regexp_extract("line", COLUMN, i).alias(c) for i, c in enumerate(("column", "type", "rest"), 1)]).filter("`column` <> ''")
    first = F.lower(F.regexp_extract("type", "^([A-Za-z]+)", 1))
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[first], F.lit("string"))
    kind = F.when(first.isin("decimal", "numeric"), F.concat(F.lit("decimal"), F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract("type", r"\(.*\)", 0), r"\s", ""), F.lit("")), F.lit("(10,0)")))).otherwise(kind)
    kind = F.when((kind == "int") & F.lower("type").rlike("^int.*unsigned"), "bigint").when((kind == "bigint") & F.lower("type").contains("unsigned"), "decimal(20,0)").otherwise(kind)
    bare = F.regexp_replace("rest", f"(?s)\\bCOMMENT\\s++{TEXT}", "")
    raw = F.regexp_extract(bare, rf"(?is)\bDEFAULT\s++({VALUE})", 1)
    default = F.when((raw != "") & ~F.upper(raw).isin(*CURRENT), _value(raw))
    domain = F.when(first == "enum", F.transform(F.regexp_extract_all("type", F.lit(TEXT), F.lit(0)), _value))
    place = F.row_number().over(Window.partitionBy("table").orderBy("at")).alias("place")
    return lines.select("table", place, "column", "type", kind.alias("kind"), (~bare.rlike(r"(?i)\bNOT\s+NULL\b")).alias("nullable"), default.alias("default"), domain.alias("domain"))


def constraints(dump: DataFrame, column: str = "statement") -> DataFrame:
    """One row for each different constraint: ``table``, ``rule`` (primary, unique, reference), ``columns``, and for references ``parent``,
    ``parent_columns`` and ``on_delete`` (restrict if nothing is said). Constraints that say the same under several names are one.
    """
    parts = [F.regexp_extract("line", KEY, i).alias(c) for i, c in ((2, "word"), (4, "listed"), (5, "rest"))]
    lines = _bodies(dump, column).select("table", *parts).filter("word <> ''")
    rule = F.when(F.upper("word") == "PRIMARY", "primary").when(F.upper("word") == "UNIQUE", "unique").otherwise("reference")
    parent = F.nullif(F.regexp_extract("rest", PARENT, 1), F.lit(""))
    action = F.lower(F.regexp_extract("rest", r"(?i)ON\s+DELETE\s+(CASCADE|SET\s+NULL|RESTRICT|NO\s+ACTION)", 1))
    on_delete = F.when(parent.isNotNull(), F.when(action.isin("", "no action"), "restrict").otherwise(F.regexp_replace(action, r"\s+", " ")))
    return lines.select("table", rule.alias("rule"), _names(F.col("listed")).alias("columns"), parent.alias("parent"), F.when(parent.isNotNull(), _names(F.regexp_extract("rest", PARENT, 2))).alias("parent_columns"), on_delete.alias("on_delete")).distinct()


@dataclass(frozen=True)
class Loaded:
    """``tables`` by name, typed; ``definitions`` and ``constraints`` as tables."""

    tables: dict[str, DataFrame]
    definitions: DataFrame
    constraints: DataFrame


def _typed(value: Column, kind: str) -> Column:
    if kind == "string":
        return value
    if kind == "binary":
        return F.when(value.rlike("(?i)^0x[0-9a-f]*$"), F.unhex(F.substring(value, F.lit(3), F.length(value)))).otherwise(value.cast("binary"))
    return value.try_cast(kind)


def _placed(own: Sequence[T.Row]) -> Column:
    """A row's ``values`` in the order of the table's columns, put by the statement's list of names or by place."""
    wanted = F.array(*[F.struct(F.lit(d["column"]).alias("name"), F.lit(d["default"]).cast("string").alias("default")) for d in own])
    named = F.transform(wanted, lambda d: F.when(F.array_position("columns", d["name"]) > 0, F.get("values", (F.array_position("columns", d["name"]) - 1).cast("int"))).otherwise(d["default"]))
    wrong = F.raise_error(F.concat(F.lit(f"a row of {own[0]['table']} has another number of values than columns: "), F.array_join("values", "|", "NULL"))).cast("array<string>")
    right = F.size("values") == F.coalesce(F.size("columns"), F.lit(len(own)))
    return F.when(~right, wrong).when(F.col("columns").isNull(), F.col("values")).otherwise(named)


def _cells(own: Sequence[T.Row], of: Sequence[str] | None = None) -> list[Column]:
    """The typed columns of ``__placed``, or those that ``of`` names."""
    return [_typed(F.get("__placed", F.lit(i)), d["kind"]).alias(d["column"]) for i, d in enumerate(own) if of is None or d["column"] in of]


def _rows(found: DataFrame, own: Sequence[T.Row]) -> DataFrame:
    """The rows of a table. A row is looked at once for all its columns."""
    return found.select(_placed(own).alias("__placed")).select(*_cells(own))


def _by_table(known: DataFrame) -> dict[str, list[T.Row]]:
    own: dict[str, list[T.Row]] = {}
    for r in known.orderBy("table", "place").collect():  # as many as the dump has columns
        own.setdefault(r["table"], []).append(r)
    return own


def load(dump: DataFrame, column: str = "statement") -> Loaded:
    """All tables that the dump defines, with the rows that it inserts.

    Values that their type cannot hold, such as the date of zeros, are null; ``rejected`` lists them. A row with another number of
    values than its columns is an error. A table without rows is empty. Columns that a statement does not list have their default.
    """
    known = definitions(dump, column)
    rows = inserted(dump.select(column), column)
    return Loaded({name: rows.filter(F.col("table") == name).transform(_rows, d) for name, d in _by_table(known).items()}, known, constraints(dump, column))


def kept(dump: DataFrame, wanted: Mapping[str, Sequence[str]], path: str, column: str = "statement") -> dict[str, DataFrame]:
    """The ``wanted`` columns of the tables that the dump defines, as ``load`` makes them, by one pass over the dump that stores them at
    ``path``: rows of Parquet with a struct for each table, null in rows of others.
    """
    own = {name: d for name, d in _by_table(definitions(dump, column)).items() if name in wanted}
    if not own:
        return {}
    is_of = {name: F.col("table") == name for name in own}
    placed = F.coalesce(*[F.when(is_of[name], _placed(d)) for name, d in own.items()])
    rows = inserted(dump.select(column), column).filter(F.col("table").isin(*own)).select("table", placed.alias("__placed"))
    parts = rows.select("table", *[F.when(is_of[name], F.struct(*_cells(d, wanted[name]))).alias(name) for name, d in own.items()])
    parts.write.parquet(path)
    stored = dump.sparkSession.read.schema(parts.schema).parquet(path)
    return {name: stored.filter(is_of[name]).select(f"`{name}`.*") for name in own}


def rejected(dump: DataFrame, column: str = "statement") -> DataFrame:
    """``table``, ``column`` and ``value`` of what ``load`` makes null although it is not."""
    known = definitions(dump, column).select("table", "place", "column", "kind")
    cells = inserted(dump.select(column), column).select("table", "columns", F.posexplode("values").alias("i", "value")).filter("value IS NOT NULL")
    named = cells.join(F.broadcast(known), (cells["table"] == known["table"]) & F.when(F.col("columns").isNull(), F.col("i") + 1 == F.col("place")).otherwise(F.get("columns", F.col("i")) == F.col("column")))
    bad = F.lit(False)
    for kind in sorted({"int", "bigint", "float", "double", "date", "timestamp_ntz", "timestamp"}):
        bad = bad | ((F.col("kind") == kind) & F.col("value").try_cast(kind).isNull())
    bad = bad | (F.col("kind").startswith("decimal") & F.col("value").try_cast("decimal(38,18)").isNull())
    return named.filter(bad).select(cells["table"], "column", "value")


def _quoted(value: Column) -> Column:
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    for sign, name in (("\n", "\\n"), ("\r", "\\r"), ("\x00", "\\0"), ("\x1a", "\\Z")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return F.concat(F.lit("'"), out, F.lit("'"))


#: Signs that a text in a dump does not hold as they are.
ESCAPED = "[\\\\'\n\r\\x00\\x1a]"


def _plain(field: T.StructField) -> Column:
    """A value that needs no quotes."""
    value = F.col(f"`{field.name}`")
    return F.coalesce(F.concat(F.lit("0x"), F.hex(value)) if isinstance(field.dataType, T.BinaryType) else value.cast("string"), F.lit("NULL"))


def _lines(table: DataFrame) -> DataFrame:
    """``row``, the values of each row in parentheses. A row's texts are searched once for signs to escape, and few rows have any; all texts go
    through one short expression, as one for each column makes code that the JVM does not compile.
    """
    quoted = [f for f in table.schema if not isinstance(f.dataType, (T.BinaryType, T.NumericType))]
    texts = F.array(*[F.col(f"`{f.name}`").cast("string") for f in quoted]).cast("array<string>")
    own = lambda quote: F.transform("__texts", lambda v: F.coalesce(quote(v), F.lit("NULL")))
    escaped = F.when(F.array_join("__texts", "").rlike(ESCAPED), own(_quoted)).otherwise(own(lambda v: F.concat(F.lit("'"), v, F.lit("'"))))
    rows = table.select("*", texts.alias("__texts")).withColumn("__quoted", escaped)
    at = {f.name: i for i, f in enumerate(quoted)}
    return rows.select(F.concat(F.lit("("), F.concat_ws(",", *[F.get("__quoted", F.lit(at[f.name])) if f.name in at else _plain(f) for f in table.schema]), F.lit(")")).alias("row"))


#: Types of a dump by kind; others are texts.
TYPES = {"int": "int", "bigint": "bigint", "float": "float", "double": "double", "date": "date", "timestamp_ntz": "datetime", "timestamp": "timestamp", "binary": "longblob"}


def created(name: str, schema: T.StructType, keys: Sequence[str] = ()) -> str:
    """``CREATE TABLE`` for a schema, with further lines (``PRIMARY KEY ...``)."""
    lines = []
    for f in schema:
        kind = f.dataType.simpleString()
        lines.append(f"  `{f.name}` {kind if kind.startswith('decimal') else TYPES.get(kind, 'longtext')}{'' if f.nullable else ' NOT NULL'}")
    return f"CREATE TABLE `{name}` (\n" + ",\n".join([*lines, *(f"  {k}" for k in keys)]) + "\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4"


def _filled(rows: DataFrame, name: str, rows_each: int) -> DataFrame:
    """``value``, an ``INSERT`` for each ``rows_each`` neighbouring rows of a task at most: rows are not shuffled for it."""
    head = f"INSERT INTO `{name}` VALUES "

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cuts = np.append(np.arange(0, batch.num_rows, rows_each), batch.num_rows)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(0)), ",")
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.scalar(head, joined.type), joined, pa.scalar("", joined.type))], ["value"])

    return rows.mapInArrow(run, "value string")


def write(tables: Mapping[str, DataFrame], path: str, keys: Mapping[str, Sequence[str]] | None = None, rows_each: int = 500, compression: str | None = None, statements_each: int = 400) -> None:
    """The tables as a dump: a folder of text files, with ``rows_each`` rows a statement at most. An existing folder is an error. Compressed
    files (``gzip``, say) are not split when they are read, so a task begins a further one after ``statements_each`` statements.
    """
    parts = []
    for name, table in tables.items():
        spark = table.sparkSession
        parts += [spark.createDataFrame([(created(name, table.schema, (keys or {}).get(name, ())),)], "value string"), _filled(_lines(table), name, rows_each)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    packed = {"compression": compression, "maxRecordsPerFile": statements_each} if compression else {}
    whole.write.options(**packed).text(path, lineSep=END)
