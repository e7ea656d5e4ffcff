"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's words are hashed, every ``GRAM`` neighbouring words make a k-gram hash,
and of every ``SPAN - GRAM + 1`` neighbouring k-grams the smallest is kept with its
position. Two texts that share ``SPAN`` words in a row keep the same k-gram
there, so joining kept hashes finds every such place. Each hit is then extended:
the words around the document's k-gram are compared with those around the item's, and
runs of equal words that are long enough are contaminated. All ``SPAN`` words around a kept
k-gram lie within ``SPAN - GRAM`` words of it, so a k-gram travels with these
neighbours and not with its whole document or item. Items shorter than ``SPAN`` words are
looked up by the hash of all their words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import own_name, stored

GRAM, SPAN = 6, 13
#: Words of a text whose A-Z are lower-cased are the same spans as these, where A-Z still stand.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A kept k-gram is one number: the upper 34 bits of its hash and 30 bits of position.
LOW = 30
#: Stands for the document itself among its kept k-grams, so that the document and its number of words reach the result.
MARK = (1 << 63) - 1


def _after(values: str | Column, by: int) -> Column:
    column = F.col(values) if isinstance(values, str) else values
    return F.slice(column, F.lit(by + 1), F.greatest(F.size(column) - by, F.lit(0)))


def _paired(a: str, b: Column) -> Column:
    return F.zip_with(F.col(a), b, lambda x, y: F.xxhash64(x, y))


def _least(a: str, by: int) -> Column:
    return F.zip_with(F.col(a), _after(a, by), lambda x, y: F.least(x, y))


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``words``, case kept, and the hashes ``w1`` of the lower-cased words. A null text has no words."""
    df = df.withColumn("words", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
    return df.withColumn("w1", F.transform("words", lambda w: F.xxhash64(F.lower(w))))


def with_kept(df: DataFrame) -> DataFrame:
    """Adds ``kept`` from ``w1``: hash and position of the smallest k-gram of each window. The last windows of a
    text are shorter, which adds some k-grams and loses none. Each step is a column of its own, so none is computed twice.
    """
    df = df.withColumn("w2", _paired("w1", _after("w1", 1)))
    df = df.withColumn("w4", _paired("w2", _after("w2", 2)))
    df = df.withColumn("w6", F.zip_with(F.col("w4"), _after("w2", 4), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("p1", F.transform("w6", lambda h, i: F.shiftleft(F.shiftright(h, LOW), LOW).bitwiseOR(i.cast("long"))))
    df = df.withColumn("p2", _least("p1", 1)).withColumn("p4", _least("p2", 2)).withColumn("p8", _least("p4", 4))
    return df.withColumn("kept", F.array_distinct("p8")).drop("w2", "w4", "w6", "p1", "p2", "p4", "p8")


def _chain(words: str, n: int) -> Column:
    """For each position of ``w1`` the hash of ``n`` words from there on, as hash and position."""
    parts = [_after(words, i) for i in range(n)]
    joined = F.arrays_zip(*[p.alias(f"c{i}") for i, p in enumerate(parts)])
    whole = F.slice(joined, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(whole, lambda s, i: F.shiftleft(F.shiftright(F.xxhash64(F.lit(n), s), LOW), LOW).bitwiseOR(i.cast("long")))


def fingerprints(bench: DataFrame, key: str, text: str) -> tuple[DataFrame, list[int]]:
    """The items' kept k-grams, written as a table, and the lengths of short items.

    A row has ``gram``, the neighbourhood ``item_words``, the place ``at`` of the k-gram in it, ``need``, the equal words
    that make a hit, and ``items``, the ids (as strings) of all items with just that: wording that many items share is
    compared once. A row's words are bounded, however long its items are.
    Items without words, or null, give none. Items with the same id are taken together.
    """
    items = with_words(bench.select(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").alias("__t")).distinct(), "__t").filter(F.size("words") > 0)
    items = items.withColumn("n", F.size("words"))
    long = with_kept(items.filter(F.col("n") >= SPAN))
    lengths = sorted(r["n"] for r in items.filter(F.col("n") < SPAN).select("n").distinct().collect())  # 12 at most
    parts = [long.select("item_id", "words", F.col("kept"))]
    parts += [items.filter(F.col("n") == n).withColumn("kept", _chain("w1", n)).select("item_id", "words", "kept") for n in lengths]
    rows = reduce(DataFrame.unionByName, parts).withColumn("need", F.least(F.lit(SPAN), F.size("words")))
    rows = rows.withColumn("words", F.transform("words", lambda w: F.translate(w, UPPER, LOWER)))
    rows = rows.select("item_id", "words", "need", F.explode_outer("kept").alias("k")).filter("k IS NOT NULL")
    first, near = _near(_position(F.col("k")))
    rows = rows.select(F.shiftright("k", LOW).alias("gram"), "item_id", near.alias("item_words"), (_position(F.col("k")) - first).alias("at"), "need")
    rows = rows.groupBy("gram", "item_words", "at", "need").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return stored(rows, "fingerprints"), lengths


def _position(k: Column) -> Column:
    return k.bitwiseAND((1 << LOW) - 1).cast("int")


def _near(position: Column) -> tuple[Column, Column]:
    """The first word, and the words, of a k-gram's neighbourhood."""
    first = F.greatest(position - (SPAN - GRAM), F.lit(0))
    return first, F.slice("words", first + 1, F.lit(2 * SPAN - GRAM))


def _runs() -> Column:
    """Runs of equal words between both neighbourhoods, laid so that the hit's k-grams meet: [start, end) in the document."""
    first, shift = F.greatest(F.col("pos") - (SPAN - GRAM), F.lit(0)), F.col("pos") - F.col("at")
    begin = F.greatest(first, shift)
    length = F.greatest(F.least(first + F.size("near"), shift + F.size("item_words")) - begin, F.lit(0))
    own = F.slice("near", begin - first + 1, length)
    other = F.slice("item_words", begin - shift + 1, length)
    equal = F.zip_with(own, other, lambda a, b: F.translate(a, UPPER, LOWER) == b)
    breaks = F.filter(F.transform(equal, lambda e, i: F.when(~e, i)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(-1)), breaks, F.array(length))
    gaps = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: F.struct((begin + a + 1).alias("s"), (begin + b).alias("e")))
    return F.filter(gaps, lambda g: g["e"] - g["s"] >= F.col("need"))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted [s, e) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(spans, start, lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])


def scan(docs: DataFrame, key: str, text: str, bench: DataFrame, bench_key: str, bench_text: str, broadcast_rows: int = 300_000) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Every document word in an occurrence of ``SPAN`` words in a row of an item (of the whole item, if shorter) is hit;
    contaminated: at least a twentieth of the words, and one at least. Null or empty texts have 0 words.
    Repeated rows give a row each; a null key stays null; a null item id counts for hits but not as an item. No documents
    give no rows; without items no document is hit. Other columns are ignored; a key with the name of a result is an error.
    Texts are whole, up to ``2**30`` words each.

    One pass over the documents: kept k-grams are exploded and joined with the items' table, and only matches
    leave the stage. That table is broadcast if its rows and item ids are ``broadcast_rows`` at most; beyond, hits are found
    first without the words, by a shuffle of k-grams, and then joined with the documents they lie in.
    """
    own_name(key, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    grams, lengths = fingerprints(bench, bench_key, bench_text)
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).withColumn("__row", F.monotonically_increasing_id())
    rows = with_kept(with_words(rows, "__text")).withColumn("n_words", F.size("words"))
    kept = [F.col("kept"), *[_chain("w1", n) for n in lengths], F.array(F.lit(MARK).cast("long"))]
    rows = rows.withColumn("kept", F.concat(*kept)).select("__row", "__key", "n_words", "words", "kept")
    if (grams.agg(F.sum(F.size("items") + 1)).first()[0] or 0) <= broadcast_rows:
        found = _found_by_broadcast(rows, grams)
    else:
        found = _found_by_shuffle(rows, grams)
    marked = F.col("item_words").isNull()
    hits = found.select("__row", "__key", "n_words", "items", F.when(~marked, _runs()).alias("runs"))
    hits = hits.filter(F.col("runs").isNull() | (F.size("runs") > 0)).select("__row", "__key", "n_words", "items", F.explode_outer("runs").alias("run"))
    by_doc = hits.groupBy("__row", "__key", "n_words").agg(F.collect_set("run").alias("runs"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("run").isNotNull(), F.col("items"))))).alias("items"))
    n_hit = _covered(F.array_sort("runs"))
    out = by_doc.select(F.col("__key").alias(key), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


FOUND = ("__row", "__key", "n_words", "pos", "near", "items", "item_words", "at", "need")


def _found_by_broadcast(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Documents' kept k-grams that are in the table, and one row without an item for each document."""
    whole = [F.lit(MARK >> LOW).cast("long").alias("gram"), *(F.lit(None).cast(grams.schema[c].dataType).alias(c) for c in ("items", "item_words", "at", "need"))]
    table = grams.unionByName(rows.sparkSession.range(1).select(*whole))
    placed = F.transform("kept", lambda k: F.struct(k.alias("k"), _near(_position(k))[1].alias("near")))
    # explode_outer, as for explode Spark would put a filter on all that makes ``kept`` next to the scan
    exploded = rows.select("__row", "__key", "n_words", F.explode_outer(placed).alias("x"))
    exploded = exploded.select("__row", "__key", "n_words", F.shiftright("x.k", LOW).alias("gram"), _position(F.col("x.k")).alias("pos"), F.col("x.near").alias("near"))
    return exploded.join(F.broadcast(table), "gram").select(*FOUND)


def _found_by_shuffle(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """The same rows for a table of k-grams that must not be broadcast: k-grams are shuffled without their neighbours,
    which the hits then get from the documents. Neither join is a broadcast, whatever Spark takes its sides for."""
    docs = stored(rows.withColumn("kept", F.slice("kept", F.lit(1), F.size("kept") - 1)), "documents")
    exploded = docs.select("__row", F.explode_outer("kept").alias("k")).select("__row", F.shiftright("k", LOW).alias("gram"), _position(F.col("k")).alias("pos"))
    places = exploded.join(grams.hint("merge"), "gram").select("__row", "pos", "items", "item_words", "at", "need")
    hits = docs.join(places.hint("merge"), "__row").withColumn("near", _near(F.col("pos"))[1]).select(*FOUND)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in hits.schema if f.name not in docs.columns}
    return hits.unionByName(docs.select(*[none.get(c, F.col(c)) for c in FOUND]))
