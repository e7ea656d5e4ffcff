"""Transforms of documents held as one row per block: document, pos, kind, level, id, classes, text.

``kind`` is Header, Para, Plain, Div, CodeBlock or RawBlock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.docs.marks import xml_escape
from foliospark.docs.tree import levels


def nested_sections(blocks: DataFrame) -> DataFrame:
    """One row per document with ``jats``: headers open sections and close all open ones of their level or deeper.

    A section of level k is open after a block if the last header of level k or higher up has level k. So a header's closing tags
    are counted by windows over the document's order, one for each level, and the parts are joined once.
    """
    header, order = F.col("kind") == "Header", Window.partitionBy("document").orderBy("pos")
    every = levels(blocks.filter(header), "level")
    open_after = {k: F.coalesce(F.last(F.when(header & (F.col("level") <= k), F.col("level")), ignorenulls=True).over(order) == k, F.lit(False)).cast("int") for k in every}
    rows = blocks.withColumns({f"__open{k}": c for k, c in open_after.items()})
    before = {k: F.coalesce(F.lag(f"__open{k}").over(order), F.lit(0)) for k in every}
    total = lambda counts: F.aggregate(F.array(F.lit(0), *counts), F.lit(0), lambda a, x: a + x)
    closed = total([F.when(F.col("level") <= k, before[k]).otherwise(0) for k in every])
    rows = rows.withColumn("__closed", closed).withColumn("__left", total([F.col(f"__open{k}") for k in every]))
    text, tag = xml_escape(F.col("text")), F.lit("</sec>")
    head = F.concat(F.repeat(tag, F.col("__closed")), F.lit('<sec sec-type="level'), F.col("level").cast("string"), F.lit('"><title>'), text, F.lit("</title>"))
    part = F.when(header, head).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))
    whole = rows.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"), F.max_by("__left", "pos").alias("left"))
    return whole.select("document", F.concat(F.concat_ws("", "parts.part"), F.repeat(tag, F.col("left"))).alias("jats"))


#: How a flat article begins, and the formats whose raw blocks are its own.
PROLOG = '<?xml version="1.0" encoding="UTF-8"?><article xmlns="http://jats.nlm.nih.gov">'
OWN_FORMATS = ("jats", "xml")


def flat_sections(blocks: DataFrame) -> DataFrame:
    """One row per document with ``jats``: headers open sections that stay open, paragraphs follow, and raw blocks stay as
    they are if their ``format`` is jats or xml; others go. Without that column all raw blocks are taken as xml.
    """
    text = xml_escape(F.col("text"))
    raw = F.col("kind") == "RawBlock"
    if "format" in blocks.columns:
        raw &= F.col("format").isin(*OWN_FORMATS)
    part = F.when(F.col("kind") == "Header", F.concat(F.lit("<sec><title>"), text, F.lit("</title>"))).when(F.col("kind").isin("Para", "Plain"), F.concat(F.lit("<p>"), text, F.lit("</p>"))).when(raw, F.col("text"))
    whole = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(part, F.lit("")).alias("part"))))
    return blocks.groupBy("document").agg(whole.alias("parts")).select("document", F.concat(F.lit(PROLOG), F.concat_ws("", "parts.part"), F.lit("</article>")).alias("jats"))


def reference_lists(blocks: DataFrame, title: str = "References") -> DataFrame:
    """``document``, ``list`` and ``ref_list``: a list for each references or bibliography division, numbered in order from 1.

    Neighbouring blocks of such classes are one division, or those with the same ``division`` if there is that column.
    Its paragraphs are the entries; other blocks in it are dropped, and a division without paragraphs is an empty list.
    """
    of_list = F.array_contains("classes", "references") | F.array_contains("classes", "bibliography")
    own = Window.partitionBy("document").orderBy("pos")
    before = F.lag(of_list).over(own)
    begins = of_list & ~F.coalesce(before, F.lit(False))
    if "division" in blocks.columns:
        begins = of_list & (begins | ~F.col("division").eqNullSafe(F.lag("division").over(own)))
    inside = blocks.withColumn("list", F.sum(begins.cast("int")).over(own)).filter(of_list)
    entry = F.when(F.col("kind") == "Para", F.concat(F.lit("<ref><p>"), xml_escape(F.col("text")), F.lit("</p></ref>")))
    entries = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(entry, F.lit("")).alias("ref"))))
    lists = inside.groupBy("document", "list").agg(entries.alias("refs"))
    return lists.select("document", "list", F.concat(F.lit(f"<ref-list><title>{title}</title>"), F.concat_ws("", F.transform("refs", lambda r: r["ref"])), F.lit("</ref-list>")).alias("ref_list"))


def contents_classes(blocks: DataFrame) -> DataFrame:
    """Headers of level 1 that are unnumbered become unlisted too."""
    hidden = (F.col("kind") == "Header") & (F.col("level") == 1) & F.array_contains("classes", "unnumbered")
    return blocks.withColumn("classes", F.when(hidden, F.array_union("classes", F.array(F.lit("unlisted")))).otherwise(F.col("classes")))


def section_bibliographies(blocks: DataFrame, references: DataFrame, level: int = 1) -> DataFrame:
    """References (key, entry) cited as ``@key`` in each section of ``level``, once each: document, section number, key, entry.

    Blocks before the first such header are section 0. Deeper sections belong to theirs.
    """
    opens = ((F.col("kind") == "Header") & (F.col("level") <= level)).cast("int")
    numbered = blocks.withColumn("section", F.sum(opens).over(Window.partitionBy("document").orderBy("pos")))
    cited = numbered.select("document", "section", F.explode(F.regexp_extract_all("text", F.lit(r"@([A-Za-z][\w:-]*)"), F.lit(1))).alias("key")).distinct()
    return cited.join(references.select("key", "entry"), "key").select("document", "section", "key", "entry")


#: What stands where a contents division was, fixed values: black links, chapters only, then the contents.
CONTENTS = ("\\hypersetup{linkcolor=black}", "\\setcounter{tocdepth}{0}", "\\tableofcontents")


def contents_blocks(blocks: DataFrame, css_class: str = "sumario") -> DataFrame:
    """Each division of class ``css_class`` (a block of kind Div) becomes the three raw LaTeX blocks of the contents, whose places are
    counted anew; other blocks keep their order. Null classes are none.
    """
    here = (F.col("kind") == "Div") & F.coalesce(F.array_contains("classes", css_class), F.lit(False))
    made = F.array(*[F.struct(F.lit("RawBlock").alias("kind"), F.lit(text).alias("text")) for text in CONTENTS])
    rows = blocks.withColumn("__made", F.when(here, made).otherwise(F.array(F.struct("kind", "text")))).select("*", F.posexplode("__made").alias("__i", "__block"))
    place = F.row_number().over(Window.partitionBy("document").orderBy("pos", "__i"))
    new = {"kind": F.col("__block.kind"), "text": F.col("__block.text"), "pos": F.col("__pos").cast(blocks.schema["pos"].dataType)}
    return rows.withColumn("__pos", place).select(*[new.get(c, F.col(c)).alias(c) for c in blocks.columns])


def with_colophon(blocks: DataFrame, colophon: DataFrame, title: str = "Colofón", page_break: bool = False) -> DataFrame:
    """Each document followed by the colophon's blocks (pos, kind, level, classes, text). If these do not begin with a
    heading, one with ``title`` is added. ``page_break`` puts an empty division of class page-break-before ahead, as
    electronic books need it. An empty colophon gives the heading alone.
    """
    first = colophon.orderBy("pos").limit(1).filter("kind = 'Header'")
    added = [] if not first.isEmpty() else [(-1, "Header", 1, ["unnumbered"], title)]
    if page_break:
        added = [(-2, "Div", 0, ["page-break-before"], ""), *added]
    if added:
        colophon = colophon.sparkSession.createDataFrame(added, colophon.schema).unionByName(colophon)
    whole = colophon.agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in colophon.columns if c != "pos"])))).scalar()
    last = blocks.groupBy("document").agg((F.max("pos") + 1).alias("last")).withColumn("whole", whole)
    added = last.select("document", "last", F.posexplode("whole").alias("i", "block"))
    own = {"document": F.col("document"), "pos": (F.col("last") + F.col("i")).cast(blocks.schema["pos"].dataType), **{c: F.col(f"block.{c}") for c in colophon.columns if c != "pos"}}
    return blocks.unionByName(added.select(*[own.get(c, F.lit(None).cast(blocks.schema[c].dataType)).alias(c) for c in blocks.columns]))
