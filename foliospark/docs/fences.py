"""Shortcodes in running text: fences of colons, several and nested in one text, put into their templates.

A fence opens with three colons or more, then ``name key="value"`` or ``{.name #id key="value"}``, and a line of colons alone closes
the innermost one. Each text is read once with a stack of open fences (Arrow batches); templates are met by a join on the names
that a text uses, so any number of them will do.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

OPEN = re.compile(r""" {0,3}:::+[ \t]*(?:\{(?P<braced>(?:"[^"]*"|'[^']*'|[^}"'])*)\}|(?P<name>[A-Za-z][\w-]*)(?P<rest>[^\n]*?))[ \t]*:*[ \t]*\r?""")
CLOSE = re.compile(r" {0,3}:::+[ \t]*\r?")
#: ``key="value"``, ``key='value'``, ``key=value``, ``.class`` or ``#id``.
PART = re.compile(r"""([A-Za-z][\w:-]*)=(?:"([^"]*)"|'([^']*)'|([^\s"'}]+))|\.([A-Za-z][\w-]*)|\#([\w:.-]+)""")
HOLE = re.compile(r"\{\{([A-Za-z][\w:-]*)\}\}")
FENCE = "first int, last int, level int, parent int, name string, attributes array<struct<key:string,value:string>>"
CONTENT = "contenido"


def head(line: str) -> tuple[str, dict[str, str]] | None:
    """Name and attributes of an opening line; None for other lines. Of equal keys the last counts; ``#id`` gives an ``id`` where no pair does."""
    met = OPEN.fullmatch(line)
    if not met:
        return None
    name, own, mark = met["name"] or "", {}, None
    for key, double, single, bare, css, identifier in PART.findall(met["braced"] if met["braced"] is not None else met["rest"]):
        if key:
            own[key] = double or single or bare
        elif css:
            name = name or css
        elif identifier and mark is None:
            mark = identifier
    return (name, own if mark is None else {"id": mark} | own) if name else None


def fences(text: str) -> list[dict]:
    """Fences in order of their first lines, from 0: ``last`` is the closing line, or None. A closing line without an open fence is text.
    An unclosed fence takes no other with it: levels and parents are those of closed fences alone.
    """
    found, stack = [], []
    for at, line in enumerate(text.split("\n")):
        if CLOSE.fullmatch(line):
            if stack:
                stack.pop()["last"] = at
        elif own := head(line):
            found.append({"first": at, "last": None, "name": own[0], "attributes": own[1]})
            stack.append(found[-1])
    around: list[dict] = []
    for f in found:
        while around and around[-1]["last"] < f["first"]:
            around.pop()
        f |= {"level": len(around) + 1, "parent": around[-1]["first"] if around else None}
        if f["last"] is not None:
            around.append(f)
    return found


def fence_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row a fence: ``key``, ``first``, ``last``, ``level`` (from 1), ``parent`` (the first line of the fence around it), ``name`` and
    ``attributes`` (a map). Null texts have none.
    """
    found = texts.select(F.col(key), F.explode(_parsed()(F.col(text))).alias("f"))
    return found.select(key, *[f"f.{c}" for c in ("first", "last", "level", "parent", "name")], F.map_from_entries("f.attributes").alias("attributes"))


def _parsed():
    @pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in FENCE.split(', '))}>>")
    def parse(texts: pd.Series) -> pd.Series:
        pairs = lambda f: f | {"attributes": [{"key": k, "value": v} for k, v in f["attributes"].items()]}
        return pd.Series([[pairs(f) for f in fences(t)] if t and ":::" in t else [] for t in texts], dtype=object)

    return parse


def fill(template: str, values: dict[str, str]) -> str:
    """Holes that have a value are filled, once; others stay."""
    return HOLE.sub(lambda m: values.get(m[1], m[0]), template)


def expand(text: str, templates: dict[str, tuple[str | None, list[str], str]], context: str | None) -> tuple[str, list[tuple[int, str, str]]]:
    """The text with its fences in their templates, from the inside to the outside, and what was wrong: line, name and ``unclosed``,
    ``unknown`` (no template), ``missing`` (a required attribute) or ``context``. Such a fence stays as it is, but those within are expanded.
    """
    lines, problems = text.split("\n"), []
    found = fences(text)
    for f in reversed(found):
        template, required, allowed = templates.get(f["name"], (None, [], "any"))
        wrong = "unclosed" if f["last"] is None else "unknown" if template is None else "missing" if any(not f["attributes"].get(a) for a in required) else "context" if context is not None and allowed not in ("any", context) else None
        if wrong:
            problems.append((f["first"], f["name"], wrong))
            continue
        inner = "\n".join(x for x in lines[f["first"] + 1 : f["last"]] if x is not None)
        lines[f["first"]] = fill(template, f["attributes"] | {CONTENT: inner})
        lines[f["first"] + 1 : f["last"] + 1] = [None] * (f["last"] - f["first"])
    return "\n".join(x for x in lines if x is not None), problems[::-1]


def _known(templates: DataFrame) -> DataFrame:
    """One row for each name or alias: of ``name``, and of the name or first class in ``opening``, names come before aliases."""
    column = lambda c, kind: F.col(c).cast(kind) if c in templates.columns else F.lit(None).cast(kind)
    required = F.filter(F.transform(F.split(F.coalesce(column("required", "string"), F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    opening = column("opening", "string")
    alias = F.coalesce(F.nullif(F.regexp_extract(opening, r"^:::+\s*([A-Za-z][\w-]*)", 1), F.lit("")), F.nullif(F.regexp_extract(opening, r"^:::+\s*\{[^}]*?\.([A-Za-z][\w-]*)", 1), F.lit("")))
    plain = templates.select(F.col("name").alias("first_name"), alias.alias("alias"), "template", required.alias("required"), F.coalesce(column("context", "string"), F.lit("any")).alias("context"))
    every = plain.select("first_name", "template", "required", "context", F.posexplode(F.array("first_name", "alias")).alias("rank", "used")).filter("used IS NOT NULL")
    best = every.groupBy("used").agg(F.min_by(F.struct("template", "required", "context"), F.struct("rank", "first_name")).alias("t"))
    return best.select("used", "t.template", "t.required", "t.context")


def expanded(texts: DataFrame, templates: DataFrame, key: str = "document", text: str = "text", context: str | None = None) -> DataFrame:
    """``texts`` with the fences in ``text`` expanded, and ``problems`` (array of line, name, what).

    ``templates``: ``name``, ``template`` with ``{{contenido}}`` and ``{{key}}`` holes (other holes stay), and perhaps ``opening`` (as in
    ``::: {.fig #id}``, whose name counts too), ``required`` (attributes, by commas) and ``context`` (front, body, back, any). ``context`` names
    the column of ``texts`` that says where a text stands; without it, or where it is null, every template fits. Null texts stay null.
    """
    rows = texts.withColumn("__f", _parsed()(F.col(text)))
    used = rows.select(F.col(key).alias("__k"), F.explode(F.array_distinct(F.transform("__f", lambda f: f["name"]))).alias("used")).distinct()
    own = used.join(_known(templates), "used").groupBy("__k").agg(F.collect_list(F.struct("used", "template", "required", "context")).alias("__t"))
    joined = rows.join(own, F.col(key).eqNullSafe(F.col("__k")), "left")

    @pandas_udf("struct<text:string,problems:array<struct<line:int,name:string,what:string>>>")
    def run(bodies: pd.Series, known: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for body, templates, place in zip(bodies, known, places, strict=True):
            table = {x["used"]: (x["template"], list(x["required"]), x["context"]) for x in (templates if templates is not None else ())}
            out.append((body, []) if not body or ":::" not in body else expand(body, table, place))
        return pd.DataFrame({"text": [t for t, _ in out], "problems": [[{"line": a, "name": n, "what": w} for a, n, w in p] for _, p in out]})

    found = run(F.col(text), F.col("__t"), F.col(context) if context else F.lit(None).cast("string"))
    return joined.withColumn("__x", found).select(*[F.col("__x.text").alias(text) if c == text else F.col(f"`{c}`") for c in texts.columns], F.col("__x.problems").alias("problems"))
