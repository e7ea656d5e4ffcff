"""Marks in running text, captions, escapes and templates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Opening and closing quotes by depth.
QUOTES = (("«", "»"), ("“", "”"), ("‘", "’"))


def em_dashes(text: Column) -> Column:
    """``@rdm{x}`` becomes x between em dashes; x may span lines and ends at the first closing brace."""
    return F.regexp_replace(text, r"(?s)@rdm\{(.*?)\}", "—$1—")


def quotes(text: Column) -> Column:
    """``@q{x}`` becomes quoted text, in the quotes of its own depth, counted from the outermost mark; levels beyond three
    reuse the last pair. A mark ends at the first closing brace that no mark within it takes; one without an end is
    text and no level.
    """
    parts = F.split(text, r"(?=@q\{|\})|(?<=@q\{|\})")

    def known(state: Column, part: Column) -> Column:
        """From the end: 1 for a mark that a later brace ends, -1 for a brace, else 0."""
        opens = (part == "@q{") & (state["braces"] > 0)
        kind = F.when(opens, 1).when(part == "}", -1).otherwise(0)
        return F.struct((state["braces"] - kind).alias("braces"), F.concat(F.array(F.struct(kind.alias("kind"), part.alias("part"))), state["parts"]).alias("parts"))

    def quoted(state: Column, item: Column) -> Column:
        level, kind = state["level"], item["kind"]
        sign = lambda side, depth: F.element_at(F.array(*[F.lit(q[side]) for q in QUOTES]), F.least(F.greatest(depth, F.lit(1)), F.lit(len(QUOTES))))
        out = F.when(kind == 1, sign(0, level + 1)).when((kind == -1) & (level > 0), sign(1, level)).otherwise(item["part"])
        return F.struct(F.greatest(level + kind, F.lit(0)).alias("level"), F.concat(state["out"], F.array(out)).alias("out"))

    start = F.struct(F.lit(0).alias("braces"), F.array().cast("array<struct<kind:int,part:string>>").alias("parts"))
    marked = F.aggregate(F.reverse(parts), start, known, lambda s: s["parts"])
    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("out"))
    return F.when(text.contains("@q{"), F.aggregate(marked, start, quoted, lambda s: F.array_join(s["out"], ""))).otherwise(text)


def caption(text: Column) -> Column:
    """A figure's label (``Figura 3:``) and the rest; a text without one has an empty label."""
    pattern = r"(?s)^(Figura\s+\d+:)\s*(.*)$"
    label = F.regexp_extract(text, pattern, 1)
    return F.struct(label.alias("label"), F.when(label != "", F.regexp_extract(text, pattern, 2)).otherwise(text).alias("rest"))


def tex_escape(text: Column) -> Column:
    """Text for TeX: the backslash first, then the signs that need one; null is empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\textbackslash "))
    out = F.regexp_replace(out, r"([#$%&_{}])", r"\\$1")
    return F.replace(F.replace(out, F.lit("~"), F.lit("\\textasciitilde ")), F.lit("^"), F.lit("\\textasciicircum "))


def xml_escape(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def filled(template: Column, values: Column) -> Column:
    """The template with ``{{name}}`` replaced by the map's values; names without a value stay."""
    return F.aggregate(F.map_entries(values), template, lambda out, e: F.replace(out, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def chapter_order(file_name: Column) -> tuple[Column, Column]:
    """Sort keys of ``fm-NN-…`` (front), ``a-NN-…`` (body), ``bm-NN-…`` (back): part, then number."""
    part = F.regexp_extract(file_name, r"^(fm|a|bm)-(\d+)", 1)
    rank = F.when(part == "fm", 1).when(part == "a", 2).when(part == "bm", 3).otherwise(9)
    return rank, F.nullif(F.regexp_extract(file_name, r"^(?:fm|a|bm)-(\d+)", 1), F.lit("")).cast("int")
