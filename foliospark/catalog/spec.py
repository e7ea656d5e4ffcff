"""Two shapes of catalogue query, each with its DataFrame plan and its SQL for comparison.

Expressions are SQL text that Spark and the comparing engine read alike, with
these short forms: ``days(a, b)`` is a - b in days, ``blank(c)`` null or empty,
``n_if(p)`` counts rows, ``total(e)`` sums integers, ``joined(e, sep)`` the distinct values in order as one text (null if there
is none), ``joined_down`` the same from last to first, ``listed`` all values in order, repeats included,
``AS_OF`` the date of the report, ``like_issn(c)`` whether a text has the form of an ISSN. The date is a parameter, never the
clock. Under a ``collation`` (see ``functions.collation``) texts that it holds equal are one in lists, and the form of an ISSN
ignores case. SQL made from these forms says whether the plan is right, not whether the form is: ``expected`` holds SQL written
by hand for all queries of the catalogue; the forms serve queries that users register.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.bridge import AS_OF, sql_views

Tables = Callable[[str], DataFrame]
ISSN = "^[0-9]{4}-[0-9]{3}[0-9X]$"
#: An argument: text without commas, or with commas inside one level of brackets or quotes.
_ARG = r"((?:[^(),']|'[^']*'|\((?:[^()]|\([^()]*\))*\))+)"


def _common(text: str, as_of: str) -> str:
    text = text.replace("AS_OF", f"DATE '{as_of}'")
    text = re.sub(rf"\bblank\({_ARG}\)", r"(\1 IS NULL OR \1 = '')", text)
    text = re.sub(rf"\bn_if\({_ARG}\)", r"count(CASE WHEN \1 THEN 1 END)", text)
    return re.sub(rf"\btotal\({_ARG}\)", r"CAST(sum(\1) AS BIGINT)", text)


def for_spark(text: str, as_of: str, collation: str | None = None) -> str:
    text = re.sub(rf"\blike_issn\({_ARG}\)", rf"regexp_like(CAST(\1 AS STRING), '{'(?i)' if collation else ''}{ISSN}')", text)
    text = re.sub(rf"\bdays\({_ARG}, {_ARG}\)", r"CAST(datediff(\1, \2) AS BIGINT)", _common(text, as_of))
    some = r"collect_set(\1)"
    if collation:  # equal spellings first by code point, so that the one that stays does not depend on the order of rows
        some = rf"array_distinct(transform(array_sort(collect_set(CAST(\1 AS STRING))), v -> collate(v, '{collation}')))"
    for form, values in (("joined", f"array_sort({some})"), ("joined_down", f"sort_array({some}, false)"), ("listed", r"array_sort(collect_list(\1))")):
        text = re.sub(rf"\b{form}\({_ARG}, {_ARG}\)", rf"CASE WHEN count(\1) > 0 THEN array_join({values}, \2) END", text)
    return text


def for_sql(text: str, as_of: str) -> str:
    text = re.sub(rf"\blike_issn\({_ARG}\)", rf"regexp_matches(\1, '{ISSN}')", text)
    text = re.sub(rf"\bdays\({_ARG}, {_ARG}\)", r"date_diff('day', \2, \1)", _common(text, as_of).replace("regexp_like(", "regexp_matches("))
    for form, values in (("joined", r"DISTINCT \1, \2 ORDER BY \1"), ("joined_down", r"DISTINCT \1, \2 ORDER BY \1 DESC"), ("listed", r"\1, \2 ORDER BY \1")):
        text = re.sub(rf"\b{form}\({_ARG}, {_ARG}\)", rf"string_agg({values})", text)
    return text


@dataclass(frozen=True)
class Listing:
    """Rows of a source that meet a condition, some columns of them, perhaps only the first ``limit``."""

    code: str
    title: str
    source: str  # a view, or SQL text for a join of ``views``
    columns: dict[str, str]
    where: str = "TRUE"
    order: str = ""
    limit: int | None = None
    views: tuple[str, ...] = ()
    plan: Callable[[Tables], DataFrame] | None = None  # the join as a DataFrame

    def needs(self) -> tuple[str, ...]:
        return self.views or (self.source,)

    def frame(self, tables: Tables, as_of: str = AS_OF, collation: str | None = None) -> DataFrame:
        own = lambda text: for_spark(text, as_of, collation)
        rows = (self.plan(tables) if self.plan else tables(self.source)).filter(own(self.where))
        if self.order:
            rows = rows.orderBy(*[_ordered(part, own) for part in self.order.split("; ")])
        if self.limit:
            rows = rows.limit(self.limit)
        return rows.select(*[F.expr(own(e)).alias(name) for name, e in self.columns.items()])

    def sql(self, as_of: str = AS_OF) -> str:
        own = lambda text: for_sql(text, as_of)
        columns = ", ".join(f"{own(e)} AS {name}" for name, e in self.columns.items())
        tail = f" ORDER BY {_order_sql(self.order, own)}" if self.order else ""
        return f"{sql_views(list(self.needs()))}\nSELECT {columns} FROM {self.source} WHERE {own(self.where)}{tail}" + (f" LIMIT {self.limit}" if self.limit else "")


@dataclass(frozen=True)
class Grouping:
    """Aggregates by key; ``share`` adds the percentage of all rows that meet ``share_of``; ``hidden`` ones only serve order and having.
    ``late`` measures (lists, distinct counts) are made only for the groups that ``having`` and ``limit`` leave; keys are not null then.
    """

    code: str
    title: str
    source: str
    keys: dict[str, str]
    measures: dict[str, str]
    where: str = "TRUE"
    having: str = ""
    order: str = ""
    limit: int | None = None
    share: str | None = None
    share_of: str = "TRUE"
    hidden: tuple[str, ...] = ()
    views: tuple[str, ...] = ()
    plan: Callable[[Tables], DataFrame] | None = None
    extra: dict[str, str] = field(default_factory=dict)  # from the result's columns
    late: tuple[str, ...] = ()

    def needs(self) -> tuple[str, ...]:
        return self.views or (self.source,)

    def frame(self, tables: Tables, as_of: str = AS_OF, collation: str | None = None) -> DataFrame:
        own = lambda text: for_spark(text, as_of, collation)
        source = self.plan(tables) if self.plan else tables(self.source)
        rows = source.filter(own(self.where))
        keys = [F.expr(own(e)).alias(name) for name, e in self.keys.items()]
        measures = {name: F.expr(own(e)).alias(name) for name, e in self.measures.items()}
        out = rows.groupBy(*keys).agg(*[m for name, m in measures.items() if name not in self.late])
        if self.having:
            out = out.filter(own(self.having))
        if self.share:
            whole = source.filter(own(self.share_of)).agg(F.count(F.lit(1))).scalar()
            out = out.withColumn(self.share, F.round(F.col(next(iter(self.measures))).cast("double") * 100.0 / whole.cast("double"), 2))
        for name, e in self.extra.items():
            out = out.withColumn(name, F.expr(own(e)))
        if self.order:
            out = out.orderBy(*[_ordered(part, own) for part in self.order.split("; ")])
        if self.limit:
            out = out.limit(self.limit)
        if self.late:
            # a limit bounds the groups, which then may be broadcast; else Spark chooses by size
            few = F.broadcast(out) if self.limit else out
            of_few = rows.withColumns({f"__{name}": F.expr(own(e)) for name, e in self.keys.items()})
            of_few = of_few.join(few.select(*[F.col(name).alias(f"__{name}") for name in self.keys]), [f"__{name}" for name in self.keys], "left_semi")
            lists = of_few.groupBy(*[F.col(f"__{name}").alias(name) for name in self.keys]).agg(*[measures[name] for name in self.late])
            out = lists.join(few, list(self.keys)).select(*self.keys, *self.measures, *([self.share] if self.share else []), *self.extra)
            if self.order:
                out = out.orderBy(*[_ordered(part, own) for part in self.order.split("; ")])
        return out.drop(*self.hidden)

    def sql(self, as_of: str = AS_OF) -> str:
        own = lambda text: for_sql(text, as_of)
        columns = [f"{own(e)} AS {name}" for name, e in {**self.keys, **self.measures}.items()]
        if self.share:
            columns.append(f"round(CAST({own(next(iter(self.measures.values())))} AS DOUBLE) * 100.0 / (SELECT count(*) FROM {self.source} WHERE {own(self.share_of)}), 2) AS {self.share}")
        by = f" GROUP BY {', '.join(map(str, range(1, len(self.keys) + 1)))}" if self.keys else ""
        inner = f"SELECT {', '.join(columns)} FROM {self.source} WHERE {own(self.where)}{by}"
        extra = "".join(f", {own(e)} AS {name}" for name, e in self.extra.items())
        outer = f"SELECT *{f' EXCLUDE ({", ".join(self.hidden)})' if self.hidden else ''}{extra} FROM grouped" + (f" WHERE {own(self.having)}" if self.having else "")
        tail = f" ORDER BY {_order_sql(self.order, own)}" if self.order else ""
        return f"{sql_views(list(self.needs()))},\ngrouped AS ({inner})\n{outer}{tail}" + (f" LIMIT {self.limit}" if self.limit else "")


def _ordered(part: str, own: Callable[[str], str]):
    down = part.endswith(" DESC")
    column = F.expr(own(part.removesuffix(" DESC")))
    return column.desc_nulls_last() if down else column.asc_nulls_first()


def _order_sql(order: str, own: Callable[[str], str]) -> str:
    return ", ".join(f"{own(p)} NULLS LAST" if p.endswith(" DESC") else f"{own(p)} NULLS FIRST" for p in order.split("; "))


@dataclass(frozen=True)
class Built:
    """A query whose plan is a function of the tables, the date and the collation; its SQL is in ``expected``."""

    code: str
    title: str
    views: tuple[str, ...]
    build: Callable[[Tables, str, str | None], DataFrame]

    def needs(self) -> tuple[str, ...]:
        return self.views

    def frame(self, tables: Tables, as_of: str = AS_OF, collation: str | None = None) -> DataFrame:
        return self.build(tables, as_of, collation)

    def sql(self, as_of: str = AS_OF) -> str:
        raise NotImplementedError(f"{self.code}: see expected")


def unpivoted(one: DataFrame, columns: list[str], rows: list[tuple[str, ...]]) -> DataFrame:
    """A table from one row: each of ``rows`` gives the expressions of ``columns`` over it."""
    return one.selectExpr(f"stack({len(rows)}, {', '.join(e for row in rows for e in row)}) AS ({', '.join(columns)})")
