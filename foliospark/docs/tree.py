"""Documents as block trees: one row a block, its place in the tree as a path of numbers, which sorts in document order.

A tree's rows have document, path (array of numbers from 1), kind, level, id, classes, text. A block's parent has its path without the last
number. Rewriting works on rows at any depth at once, by windows over a document's order; nothing recurses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.docs.marks import caption, xml_escape

CITED = r"@([A-Za-z][\w:-]*)"
#: Levels of headers, and depths of divisions, that are told apart.
MOST_LEVELS = 100


def levels(rows: DataFrame, column: str, most_levels: int = MOST_LEVELS) -> range:
    """All levels from the least to the largest that occurs; these two numbers reach the driver."""
    least, most = rows.agg(F.min(column), F.max(column)).first()
    if least is None:
        return range(0)
    if most - least >= most_levels:
        raise ValueError(f"{column} goes from {least} to {most}")
    return range(least, most + 1)


def counted(rows: DataFrame, name: str, level: str, where: Column, every: range, order: Window) -> DataFrame:
    """``rows`` with ``name``, an array: for each level up to a row's own how many rows of that level came since the last one of a
    lower level, itself included. Section numbers and paths of nested blocks are of this kind. Rows where ``where`` does not hold
    neither count nor have an array.
    """
    here = F.coalesce(where, F.lit(False))
    runs = {k: F.sum((here & (F.col(level) == k)).cast("int")).over(order) for k in every}
    rows = rows.withColumns({f"__run{k}": c for k, c in runs.items()})
    bases = {k: F.coalesce(F.max(F.when(here & (F.col(level) < k), F.col(f"__run{k}"))).over(order), F.lit(0)) for k in every}
    parts = F.array(*[(F.col(f"__run{k}") - F.col(f"__base{k}")).cast("int") for k in every]) if every else F.array().cast("array<int>")
    rows = rows.withColumns({f"__base{k}": c for k, c in bases.items()})
    first = every.start if every else 0
    return rows.withColumn(name, F.when(here, F.slice(parts, F.lit(1), F.col(level) - first + 1))).drop(*[f"__{c}{k}" for k in every for c in ("run", "base")])


def from_depths(blocks: DataFrame, depth: str = "depth") -> DataFrame:
    """A tree from blocks in order (``pos``) with their ``depth`` (0 for an outermost one, one more than its parent's for any other): ``path``
    stands in place of both.
    """
    every = levels(blocks, depth)
    order = Window.partitionBy("document").orderBy("pos")
    return counted(blocks, "path", depth, F.lit(True), every, order).drop("pos", depth)


def bold_captions(tree: DataFrame) -> DataFrame:
    """The tree with ``label`` and ``rest`` for figures: the text of a figure's caption, which is its own text and that of all blocks below its
    Caption children, in order, cut into ``Figura N:`` and what follows. Both are null for other blocks, for figures whose
    caption has no such label, and for figures within figures, which stay as they are.
    """
    figures = tree.filter("kind = 'Figure'").select("document", F.col("path").alias("figure"))
    above = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda n: F.slice(c, F.lit(1), n))
    inner = figures.filter(F.size("figure") > 1).select("document", "figure", F.explode(above(F.col("figure"))).alias("outer"))
    inner = inner.join(figures.select("document", F.col("figure").alias("outer")), ["document", "outer"], "left_semi").select("document", "figure").distinct()
    outermost = figures.join(inner, ["document", "figure"], "left_anti")
    captions = tree.filter("kind = 'Caption'").select("document", F.col("path").alias("caption"), F.slice("path", F.lit(1), F.size("path") - 1).alias("figure"))
    texts = tree.filter("text <> ''").select("document", "path", "text")
    below = texts.filter(F.size("path") > 1).select("document", "path", "text", F.explode(F.array_append(above(F.col("path")), F.col("path"))).alias("caption")).distinct()
    of_captions = below.join(captions, ["document", "caption"]).select("document", "figure", "path", "text")
    own = tree.filter("kind = 'Figure' AND text <> ''").select("document", F.col("path").alias("figure"), "path", "text")
    whole = own.unionByName(of_captions).groupBy("document", "figure").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("parts"))
    cut = whole.join(outermost, ["document", "figure"], "left_semi").select("document", "figure", caption(F.concat_ws(" ", "parts.text")).alias("c")).filter("c.label <> ''")
    found = cut.select(F.col("document").alias("__d"), F.col("figure").alias("__p"), F.col("c.label").alias("label"), F.col("c.rest").alias("rest"))
    return tree.join(found, (F.col("document") == F.col("__d")) & (F.col("path") == F.col("__p")), "left").drop("__d", "__p")


def with_bibliographies(blocks: DataFrame, references: DataFrame, level: int = 1, title: str | None = None) -> DataFrame:
    """Blocks in order (``pos``; flat documents) as a tree in which each section at or above ``level`` has a bibliography of its own.

    A section of ``level`` gets what all its blocks cite, deeper ones included, at its end; one above gets what its own blocks
    cite, before its first subsection. Sections below are untouched, and blocks before the first header have none. A bibliography is a Div of id
    ``refs-N``, N the section's number, with a Para for each entry (``references``: key, entry) as children, by key; with ``title`` a
    Header ``bibliography-N`` one level below the section's stands before it. Sections of class unnumbered have no number: N is then ``x`` and
    the header's place. Earlier results (a Header of id bibliography, a Div of id refs) go. Sections that cite nothing known get none.
    Numbers count sections of each level since the last higher one, with 0 for levels that are passed over.
    """
    header = F.col("kind") == "Header"
    stale = (header & F.coalesce(F.col("id") == "bibliography", F.lit(False))) | ((F.col("kind") == "Div") & F.coalesce(F.col("id") == "refs", F.lit(False)))
    rows = blocks.filter(~stale)
    order = Window.partitionBy("document").orderBy("pos")
    every = range(1, max([*levels(rows.filter(header), "level"), 1]) + 1)
    numbered = header & ~F.coalesce(F.array_contains("classes", "unnumbered"), F.lit(False))
    rows = counted(rows, "__number", "level", numbered, every, order)
    name = F.coalesce(F.array_join("__number", "."), F.concat(F.lit("x"), F.col("pos").cast("string")))
    mine = F.struct(F.col("pos").alias("pos"), F.col("level").alias("level"), name.alias("name"))
    last = lambda where: F.last(F.when(where, mine), ignorenulls=True).over(order)
    rows = rows.withColumn("__near", last(header)).withColumn("__high", last(header & (F.col("level") <= level)))
    own = F.when((F.col("__high.level") == level) | (F.col("__near.pos") == F.col("__high.pos")), F.col("__high"))
    rows = rows.withColumn("__section", own)
    inside = rows.filter("__section IS NOT NULL")
    ends = inside.groupBy("document", "__section").agg(F.max("pos").alias("__end"))
    cited = inside.select("document", "__section", F.explode(F.regexp_extract_all("text", F.lit(CITED), F.lit(1))).alias("key")).distinct()
    entries = cited.join(references.select("key", "entry"), "key").groupBy("document", "__section").agg(F.array_sort(F.collect_set(F.struct("key", "entry"))).alias("__entries"))
    made = entries.join(ends, ["document", "__section"])
    fields = lambda kind, lv, id_, classes, text, depth: F.struct(F.lit(kind).alias("kind"), lv.cast("int").alias("level"), id_.alias("id"), F.array(*map(F.lit, classes)).cast("array<string>").alias("classes"), text.alias("text"), F.lit(depth).alias("depth"))
    n = F.col("__section.name")
    blank = F.lit(None).cast("string")
    division = F.array(fields("Div", F.lit(0), F.concat(F.lit("refs-"), n), ["references"], F.lit(""), 0))
    head = F.array(fields("Header", F.col("__section.level") + 1, F.concat(F.lit("bibliography-"), n), [], F.lit(title), 0)) if title else None
    items = F.transform("__entries", lambda e: fields("Para", F.lit(0), blank, [], e["entry"], 1))
    added = made.select("document", F.col("__end").alias("pos"), F.posexplode(F.concat(*([head] if head is not None else []), division, items)).alias("sub", "b")).select("document", "pos", (F.col("sub") + 1).alias("sub"), *[f"b.{c}" for c in ("kind", "level", "id", "classes", "text", "depth")])
    plain = rows.select("document", "pos", F.lit(0).alias("sub"), "kind", F.col("level").cast("int").alias("level"), "id", "classes", "text", F.lit(0).alias("depth"))
    whole = plain.unionByName(added)
    return counted(whole, "path", "depth", F.lit(True), range(2), Window.partitionBy("document").orderBy("pos", "sub")).select("document", "path", "kind", "level", "id", "classes", "text")


def rendered(tree: DataFrame) -> DataFrame:
    """``document`` and ``xml``: each block an element of its kind in lower case, with id and class where it has them, its text, and its children.

    A block's end tags follow from its own depth and the next block's, so one ordered pass makes the text.
    """
    order = Window.partitionBy("document").orderBy("path")
    depth = F.size("path")
    closing = depth - F.coalesce(F.lead(depth).over(order), F.lit(1)) + 1
    tag = F.lower("kind")
    # the tags of a row's own chain of parents, of which the innermost are closed after it
    chain = F.col("__chain")
    every = levels(tree.select(F.size("path").alias("d")), "d")
    rows = tree.withColumn("__closing", closing)
    parents = {k: F.last(F.when(depth == k, tag), ignorenulls=True).over(order) for k in every}
    rows = rows.withColumn("__chain", F.slice(F.array(*parents.values()) if every else F.array().cast("array<string>"), F.lit(1), depth - (every.start - 1 if every else 0)))
    attribute = lambda name, value: F.coalesce(F.concat(F.lit(f' {name}="'), F.replace(xml_escape(value), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit(""))
    css = F.when(F.size("classes") > 0, F.array_join("classes", " "))
    ends = F.array_join(F.transform(F.reverse(F.slice(chain, F.greatest(F.size(chain) - F.col("__closing") + 1, F.lit(1)), F.greatest(F.col("__closing"), F.lit(0)))), lambda t: F.concat(F.lit("</"), t, F.lit(">"))), "")
    part = F.concat(F.lit("<"), tag, attribute("id", F.col("id")), attribute("class", css), F.lit(">"), xml_escape(F.coalesce("text", F.lit(""))), ends)
    parts = rows.select("document", F.struct("path", part.alias("part")).alias("p")).groupBy("document").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("document", F.array_join("p.part", "").alias("xml"))
