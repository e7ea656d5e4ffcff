"""Texts in files beside the tables, such as a colophon, and their Markdown as block rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A heading's marks, text, and attributes in braces.
HEADING = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*(?:\{([^{}]*)\})?[ \t]*$"
FENCE = r"^ {0,3}```+"
SCHEMA = "document string, text string"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``document`` (the file's path) and ``text``, one row a file, whole. A path that is missing has no rows, as a side file may be absent;
    any other failure is an error. An empty file is an empty text or, as Spark skips it, no row: either has no blocks.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    return files.select(F.col("_metadata.file_path").alias("document"), F.col("value").alias("text"))


def markdown_blocks(rows: DataFrame) -> DataFrame:
    """The blocks of each ``document``'s Markdown ``text``: document, pos (from 1), kind, level, id, classes, text. Other columns go.

    Header: a line of one to six ``#`` and a text, which does not follow a paragraph's line directly; ``{.class #id -}`` at its end gives its
    classes and id, ``-`` the class unnumbered. CodeBlock: what stands between two lines that begin with three backticks, lines kept; the word
    after the first is its class; an open one goes to the end. Para: lines up to a blank one, a code block or the end, as one line. Inline marks stay as they
    are. Lines end with LF, CR LF or CR. Documents are told apart by ``document``; null and empty texts have no blocks.
    """
    lines = rows.select("document", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("i", "line"))
    order = Window.partitionBy("document").orderBy("i")
    fence = F.col("line").rlike(FENCE)
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(fence.cast("int")).over(order))
    code = F.col("fence") | (F.col("fences") % 2 == 1)
    seems = ~code & F.col("line").rlike(HEADING)
    lines = lines.withColumn("sort", F.when(code, "code").when(F.trim(F.regexp_replace("line", "\t", " ")) == "", "blank").when(seems, "heading").otherwise("text"))
    before = F.last(F.when(F.col("sort") != "heading", F.col("sort")), ignorenulls=True).over(order)
    kind = F.when(F.col("sort") == "code", "CodeBlock").when((F.col("sort") == "heading") & F.coalesce(before != "text", F.lit(True)), "Header").when(F.col("sort") != "blank", "Para")
    lines = lines.withColumn("kind", kind)
    apart = F.coalesce(F.col("kind") != "Para", F.lit(True)).cast("int")
    group = F.when(F.col("kind") == "CodeBlock", F.floor((F.col("fences") + 1) / 2)).when(F.col("kind") == "Header", F.col("i")).otherwise(F.sum(apart).over(order))
    whole = lines.withColumn("group", group.cast("long")).filter("kind IS NOT NULL").groupBy("document", "kind", "group").agg(F.array_sort(F.collect_list(F.struct("i", "line", "fence"))).alias("l"))
    first = F.col("l")[0]["line"]
    part = lambda n: F.regexp_extract(first, HEADING, n)
    header, is_code = F.col("kind") == "Header", F.col("kind") == "CodeBlock"
    inner = F.transform(F.filter("l", lambda x: ~x["fence"]), lambda x: x["line"])
    text = F.when(header, part(2)).when(is_code, F.array_join(inner, "\n")).otherwise(F.trim(F.regexp_replace(F.array_join(inner, " "), r"[ \t]+", " ")))
    attributes = F.filter(F.split(part(3), r"[ \t]+"), lambda a: a.rlike(r"^\.[^.]|^-$"))
    classes = F.transform(attributes, lambda a: F.when(a == "-", "unnumbered").otherwise(F.substring(a, 2, 1 << 30)))
    info = F.regexp_extract(first, FENCE + r"[ \t]*\{?\.?([\w+#-]*)", 1)
    css = F.when(header, classes).when(is_code & (info != ""), F.array(info)).otherwise(F.array().cast("array<string>"))
    own = F.when(header, F.nullif(F.regexp_extract(part(3), r"(?:^|[ \t])#([^ \t]+)", 1), F.lit("")))
    level = F.when(header, F.length(part(1))).otherwise(0).cast("int")
    place = F.row_number().over(Window.partitionBy("document").orderBy(F.col("l")[0]["i"]))
    return whole.select("document", place.alias("pos"), "kind", level.alias("level"), own.alias("id"), css.alias("classes"), text.alias("text"))
