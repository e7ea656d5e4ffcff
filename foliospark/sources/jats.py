"""Articles as JATS files and back: nested rows, written and read by Spark's XML format with one schema for both ways.

A file has many articles below one root and is read whole by one task, as a stream, so the sink bounds the articles of a file. A null is an
element or attribute that is left out, an empty text one that is there and empty. Characters that XML cannot hold become U+FFFD; everything
else comes back as it was. An article with more than ``REFS_EACH`` references goes on in further elements with its id, marked as continued.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dates are texts here, as Spark writes a date in an attribute as a number of days. Attributes begin with an underscore, ``_VALUE`` is the text of an element that has attributes.
MARKED = "array<struct<_VALUE:string,`{}`:string>>"
CONTRIB = f"array<struct<`_contrib-type`:string,`_rid`:bigint,`contrib-id`:{MARKED.format('_contrib-id-type')},name:struct<surname:string>>>"
CITATION = "struct<`_publication-type`:string,`article-title`:string,year:string,volume:string>"
SCHEMA = f"""`_id` bigint, `_article-type` string, `_specific-use` string,
front struct<`journal-meta`:struct<`journal-id`:bigint,`journal-title`:string,issn:{MARKED.format('_pub-type')}>,
`article-meta`:struct<`article-id`:{MARKED.format('_pub-id-type')},`article-title`:string,`contrib-group`:struct<contrib:{CONTRIB}>,
history:struct<date:array<struct<`_date-type`:string,`_iso-8601-date`:string>>>>>,
back struct<`ref-list`:struct<ref:array<struct<`_id`:bigint,`element-citation`:{CITATION}>>>>"""
#: What no XML 1.0 file may hold.
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
#: References of an element at most, and what marks an element that only has further references of an article.
REFS_EACH, CONTINUED = 1_000, "continued"
DATES = (("received", "fecha_recepcion"), ("accepted", "fecha_aceptacion"), ("pub", "fecha_publicacion_online"))


def legal(text: Column) -> Column:
    return F.regexp_replace(text, ILLEGAL, "�")


def _marked(attribute: str, **values: Column) -> Column:
    """A list of texts with the name of each as an attribute; nulls are left out, and a list of none is null."""
    every = F.filter(F.array(*[F.struct(legal(v).alias("_VALUE"), F.lit(name).alias(attribute)) for name, v in values.items()]), lambda x: x["_VALUE"].isNotNull())
    return F.when(F.size(every) > 0, every)


def articles(articulos: DataFrame, revistas: DataFrame, autores: DataFrame, links: DataFrame, references: DataFrame, refs_each: int = REFS_EACH) -> DataFrame:
    """A row of ``SCHEMA`` for each article, with its journal, its authors by id and its references by id. An article without a known
    journal keeps the journal's id alone; links to unknown authors keep the author's id alone; references without an article go. An article with
    more than ``refs_each`` references has a further row, continued, for each so many, so no row grows with an article's references. Repeated
    articles are written as often.
    """
    journals = revistas.select("id_revista", F.struct(legal("titulo_revista").alias("title"), _marked("_pub-type", ppub=F.col("issn_impreso"), epub=F.col("e_issn")).alias("issn")).alias("journal"))
    known = autores.select("id_autor", legal("apellidos").alias("surname"), _marked("_contrib-id-type", orcid=F.col("orcid"), scopus=F.col("scopus_id")).alias("ids"))
    contrib = F.struct(F.lit("author").alias("_contrib-type"), F.col("id_autor").alias("_rid"), F.col("ids").alias("contrib-id"), F.when(F.col("surname").isNotNull(), F.struct("surname")).alias("name"))
    people = links.select("id_articulo", "id_autor").join(known, "id_autor", "left").groupBy("id_articulo").agg(F.sort_array(F.collect_list(F.struct(F.col("id_autor"), contrib.alias("c")))).alias("c"))
    people = people.select(F.col("id_articulo").alias("__a"), F.struct(F.col("c.c").alias("contrib")).alias("people"))
    citation = F.struct(legal("tipo_de_entrada").alias("_publication-type"), legal("title").alias("article-title"), legal("year").alias("year"), legal("volume").alias("volume"))
    place = F.row_number().over(Window.partitionBy("id_articulo").orderBy("id")) - 1
    numbered = references.filter("id_articulo IS NOT NULL").withColumn("__part", F.floor(place / refs_each))
    cited = numbered.groupBy(F.col("id_articulo").alias("__r"), "__part").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("_id"), citation.alias("element-citation")))).alias("ref"))
    cited = cited.select("__r", "__part", F.struct(F.struct("ref").alias("ref-list")).alias("back"))
    dates = F.filter(F.array(*[F.struct(F.lit(kind).alias("_date-type"), F.col(c).cast("string").alias("_iso-8601-date")) for kind, c in DATES]), lambda d: d["_iso-8601-date"].isNotNull())
    journal = F.struct(F.col("id_revista").alias("journal-id"), F.col("journal.title").alias("journal-title"), F.col("journal.issn").alias("issn"))
    meta = F.struct(_marked("_pub-id-type", doi=F.col("doi")).alias("article-id"), legal("titulo_articulo").alias("article-title"), F.col("people").alias("contrib-group"), F.when(F.size(dates) > 0, F.struct(dates.alias("date"))).alias("history"))
    whole = articulos.join(journals, "id_revista", "left").join(people, F.col("id_articulo") == F.col("__a"), "left").join(cited.filter("__part = 0"), F.col("id_articulo") == F.col("__r"), "left")
    first = whole.select(F.col("id_articulo").alias("_id"), legal("tipo_articulo").alias("_article-type"), F.lit(None).cast("string").alias("_specific-use"), F.struct(journal.alias("journal-meta"), meta.alias("article-meta")).alias("front"), "back")
    # Further rows are on the left, as a join by sorting keeps what the right has for a key; then they are dealt out, as one article may have most.
    further = cited.filter("__part > 0").join(articulos.select("id_articulo").hint("merge"), F.col("__r") == F.col("id_articulo")).repartition("__r", "__part")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema}
    return first.unionByName(further.select(F.col("__r").alias("_id"), none["_article-type"], F.lit(CONTINUED).alias("_specific-use"), none["front"], "back"))


def write(rows: DataFrame, path: str, articles_per_file: int = 20_000) -> None:
    """Files of articles below a root ``articles``, compressed and without indentation; an existing folder is an error. No row gives a folder
    without an article. A task that has more articles than ``articles_per_file`` begins further files.
    """
    rows.write.format("xml").options(rootTag="articles", rowTag="article", maxRecordsPerFile=articles_per_file, compression="gzip", indent="").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The articles of such files, or of others of this form: what ``SCHEMA`` does not name is passed over, what is missing is null. An
    article that is no XML or has a number or date that is none is an error.
    """
    return spark.read.format("xml").schema(SCHEMA).options(rowTag="article", ignoreSurroundingSpaces="false", mode="FAILFAST").load(path)


def _value(of: Column, attribute: str, name: str) -> Column:
    """The text of the first element whose attribute is ``name``: null if there is none, empty if it is empty."""
    first = F.get(F.filter(of, lambda x: x[attribute] == name), F.lit(0))
    return F.when(first.isNotNull(), F.coalesce(first["_VALUE"], F.lit("")))


def heads(rows: DataFrame) -> DataFrame:
    """One row an article, continued or not: id_articulo, tipo_articulo, titulo_articulo, doi, id_revista, titulo_revista, issn_impreso, e_issn and the three dates."""
    journal, meta = F.col("front.journal-meta"), F.col("front.article-meta")
    date = lambda kind: F.get(F.filter(meta["history"]["date"], lambda d: d["_date-type"] == kind), F.lit(0))["_iso-8601-date"].cast("date")
    plain = {"id_articulo": F.col("_id"), "tipo_articulo": F.col("_article-type"), "titulo_articulo": meta["article-title"], "doi": _value(meta["article-id"], "_pub-id-type", "doi")}
    of_journal = {"id_revista": journal["journal-id"], "titulo_revista": journal["journal-title"], "issn_impreso": _value(journal["issn"], "_pub-type", "ppub"), "e_issn": _value(journal["issn"], "_pub-type", "epub")}
    whole = rows.filter(~F.col("_specific-use").eqNullSafe(CONTINUED))
    return whole.select(*[c.alias(n) for n, c in {**plain, **of_journal, **{name: date(kind) for kind, name in DATES}}.items()])


def contributors(rows: DataFrame) -> DataFrame:
    """One row an article's author, ``place`` from 1: id_articulo, place, id_autor, apellidos, orcid, scopus_id."""
    each = rows.select(F.col("_id").alias("id_articulo"), F.posexplode("front.article-meta.contrib-group.contrib").alias("i", "c"))
    ids = {name: _value(F.col("c.contrib-id"), "_contrib-id-type", kind) for name, kind in (("orcid", "orcid"), ("scopus_id", "scopus"))}
    return each.select("id_articulo", (F.col("i") + 1).alias("place"), F.col("c._rid").alias("id_autor"), F.col("c.name.surname").alias("apellidos"), *[c.alias(n) for n, c in ids.items()])


def references(rows: DataFrame) -> DataFrame:
    """One row a reference: id_articulo, id, tipo_de_entrada, title, year, volume."""
    each = rows.select(F.col("_id").alias("id_articulo"), F.explode("back.ref-list.ref").alias("r"))
    c = F.col("r.element-citation")
    return each.select("id_articulo", F.col("r._id").alias("id"), c["_publication-type"].alias("tipo_de_entrada"), c["article-title"].alias("title"), c["year"].alias("year"), c["volume"].alias("volume"))
