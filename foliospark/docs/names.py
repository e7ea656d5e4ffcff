"""Lists of names as reference files hold them: ``A and B and others``, with braces, prefixes, given and family names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

NAME = "struct<family:string,given:string,prefix:string,suffix:string>"
OTHERS = "others"


def cut(text: str, at: str) -> list[str]:
    """The text cut at the matches of a pattern that stand outside of braces."""
    depth, ends, out = 0, [], 0
    levels = []
    for c in text:
        depth = max(depth - 1, 0) if c == "}" else depth
        levels.append(depth)
        depth += c == "{"
    for m in re.finditer(at, text, re.I):
        if levels[m.start()] == 0 and text[m.start()] not in "{}":
            ends += [(out, m.start())]
            out = m.end()
    return [text[a:b] for a, b in [*ends, (out, len(text))]]


def _bare(word: str) -> str:
    return " ".join(word.replace("{", "").replace("}", "").split())


def _small(word: str) -> bool:
    """Whether a word is part of a prefix: its first letter outside of braces is a small one."""
    first = next((c for c in cut(word, r"\{[^{}]*\}")[0] if c.isalpha()), "") if not word.startswith("{") else ""
    return first.islower()


def _family(words: list[str]) -> tuple[list[str], list[str]]:
    """Prefix and family name of ``von Last``: the prefix is all up to the last small word, but the last word is never in it."""
    n = max((i + 1 for i, w in enumerate(words[:-1]) if _small(w)), default=0)
    return words[:n], words[n:]


def parse(name: str) -> dict[str, str | None] | None:
    """``First von Last``, ``von Last, First`` or ``von Last, Suffix, First``; a name in braces is one family name. None if it is blank."""
    parts = [[w for w in cut(p, r"[\s~]+") if w] for p in cut(name.strip(), ",")]
    if not any(parts):
        return None
    if len(parts) > 1:
        prefix, family = _family(parts[0])
        given, suffix = parts[-1], parts[1] if len(parts) > 2 else []
    else:
        words = parts[0]
        begin = next((i for i, w in enumerate(words[:-1]) if _small(w)), len(words) - 1)
        given, (prefix, family), suffix = words[:begin], _family(words[begin:]), []
    text = lambda words: _bare(" ".join(words)) or None
    return {"family": text(family), "given": text(given), "prefix": text(prefix), "suffix": text(suffix)}


def people(text: str | None) -> list[dict[str, str | None]]:
    """The names of a list in order; ``others`` stands for people without a name and is left out."""
    every = [parse(n) for n in cut(f" {text} ", r"(?<=\s)and(?=\s)")] if text else []
    return [p for p in every if p and not (p["family"] == OTHERS and not p["given"])]


def parsed(text: Column) -> Column:
    """A list of names as an array of ``NAME``; null and blank texts have none."""

    @pandas_udf(f"array<{NAME}>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([people(t) for t in texts], dtype=object)

    return run(text)


def person_index(references: DataFrame, columns: list[str], place: str) -> DataFrame:
    """Each person in the name lists of any of the columns, with ``mentions``, how often, and ``places``, at how many different places, ordered by
    family name without case, prefix, given name and suffix, nulls first. Lists recur, so equal ones are parsed once, after counting.
    """
    lists = references.select(F.explode(F.array(*columns)).alias("list"), F.col(place).alias("place")).filter("list IS NOT NULL AND trim(list) <> ''")
    counted = lists.groupBy("list", "place").agg(F.count(F.lit(1)).alias("n"))
    names = counted.select("list").distinct().select("list", F.explode(parsed(F.col("list"))).alias("p")).groupBy("list", "p").agg(F.count(F.lit(1)).alias("times"))
    every = counted.join(names, "list").select("p.*", "place", (F.col("n") * F.col("times")).alias("n"))
    found = every.groupBy("family", "given", "prefix", "suffix").agg(F.sum("n").alias("mentions"), F.countDistinct("place").alias("places"))
    return found.withColumn("sort", F.lower("family")).orderBy(*[F.col(c).asc_nulls_first() for c in ("sort", "prefix", "given", "suffix", "family")]).drop("sort")

