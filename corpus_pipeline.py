"""A training corpus in five stages: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes what its predecessor wrote. All but the last return the columns of ``documents``, further ones included,
whatever their names. In all stages a null or empty text is a text without words, null values in other columns stay, an
empty table stays empty, texts of any length are whole, and a row is told by its id and its text, so that null or
repeated ids do no harm. What a stage does with repeated rows and ties is said there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, langid, nnls_pack, pii, simhash
from foliospark.llm.queries import profiles, tokenizer_path
from foliospark.llm.shared import shared_path, sized, stored, working_tables

#: While the stages run, this many rows go to a Python worker at once, which bounds the memory beside the heap.
BATCH_ROWS = 500


def _identity() -> Column:
    """Rows with an id come first, by id."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))


def _matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with a stored table of identities, column ``id``. Spark may broadcast that table if it has few rows."""
    marked = docs.withColumn("__id", _identity())
    rows = sized(rows, rows.count())
    return marked.join(rows, marked["__id"].eqNullSafe(rows["id"]), how).drop("__id")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language; those without a letter (null and empty texts among them), or with no margin between
    languages, go. Repeated rows have the same fate. Languages are learned from the rows with a label; without any, all go.
    """
    whole = docs.select(F.struct(*_columns(docs)).alias("__row"), F.col("text").alias("__text"))
    return langid.predict(whole, "__text", profiles(docs), ["__row"]).filter(~F.col("rejected")).select("__row.*")


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of rows with its id in the group, that with
    the smallest hash of its text; of rows alike in both, one. Documents without words are near-duplicates of each other.
    Rows without an id stay only where no row of their group has one.
    """
    found = simhash.near_duplicates(docs.withColumn("__id", _identity()), "__id", "text")
    first = found.filter(F.col("__id") == F.col("component_id")).groupBy(F.col("__id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    first = stored(first, "first-of-group")
    once = _matching(docs, first.filter("n = 1").select("id"), "left_semi")
    if first.filter("n > 1").isEmpty():
        return once
    return once.unionByName(_matching(docs, first.filter("n > 1").select("id"), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark passages stay, and all without words, or without a
    benchmark. Repeated rows have the same fate.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scan(docs.withColumn("__id", _identity()), "__id", "text", bench, "item_id", "text")
    bad = stored(found.filter("contaminated").select(F.col("__id").alias("id")).distinct(), "contaminated")
    return _matching(docs, bad, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; ``n_chars`` follows the text where it changes. A null text stays null,
    repeated rows are masked each.
    """
    whole = docs.select(F.struct(*_columns(docs)).alias("__row"), F.col("text").alias("__text"))
    found = pii.find(whole, "__text", ["__row"])
    changed = F.col("n_spans") > 0
    own = {c: F.col("__row").getField(c) for c in docs.columns}
    new = own | {"text": F.col("masked"), "n_chars": F.when(changed, F.length("masked").cast("long")).otherwise(own["n_chars"])}
    return found.select(*[new[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with the columns of ``nnls_pack.pack``. A null or empty text is its
    end id; repeated rows are packed once each.
    """
    return nnls_pack.pack(docs, "doc_id", "text", tokenizer_path(), block_chars=500_000, table_words=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Compression, fingerprints, a random field and a tokenizer are beyond SQL; a test holds ``run`` against plain code.
ORACLE_SQL = None


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """The session's own setting is back at the end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and read again. A stage's own tables are
    removed once its result is written, so the folder keeps the results alone.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with _small_batches(spark):
        for name, stage in STAGES:
            path = shared_path(spark, f"stage-{name}")
            with working_tables(spark, f"working-{name}"):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
