"""The operators of this package on the test tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import align, decontaminate, html_extract, langid, nnls_pack, pii, quality, simhash, token_bins, topk, url_filter, warc, whiten

#: The tokenizer file of op3 and op5, among the public tokenizers of the box.
TOKENIZER = "word_bpe_49k.json"
#: The two tokenizers that op12 aligns.
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
URL_RULES = [
    url_filter.Rule.domain("block", "net/"),
    url_filter.Rule.domain("allow", "example.net/en/"),
    url_filter.Rule.domain("block", "example.com/de/"),
    url_filter.Rule.domain("allow", "org/fr/"),
    *url_filter.DEFAULT_RULES,
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def profiles(docs: DataFrame) -> langid.Profiles:
    """Language profiles from labelled documents that are not held out."""
    return langid.fit(docs, "text", "lang", "doc_id", F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), "url", URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), "text", profiles(docs), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_pack.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"), "html", ["page_id", "url"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bins.segments(token_bins.write_bins(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path()), "doc_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.read(index, originals=index).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"), "text", ["doc_id"]).drop("masked")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align.align(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return align.with_counts(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten.whiten(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1,
    "op2_language_id": op2,
    "op3_nnls_packing": op3,
    "op4_html_extraction": op4,
    "op5_token_bins": op5,
    "op6_warc_index": op6,
    "op7_decontamination": op7,
    "op8_pii": op8,
    "op9_simhash": op9,
    "op10_quality": op10,
    "op11_top_k": op11,
    "op12_token_alignment": op12,
    "op13_whitening": op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), ruled AS (
    SELECT *, CASE
        WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM parts
), plain AS (
    SELECT page_id, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '.') AS h,
        array_to_string(list_transform(regexp_extract_all(lower(path), '%[0-9a-f]{2}|[\s\S]'), lambda p: CASE WHEN len(p) = 3 AND regexp_matches(p, '^%(2[de]|3[0-9]|[46][1-9a-f]|[57][0-9a]|5f|7e)$') THEN lower(chr(('0x' || p[2:3])::INTEGER)) ELSE p END), '') AS p
    FROM ruled
), stepped AS (
    SELECT page_id, '.' || h AS h, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '/(\./)+', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '^/(\.\./)+', '/') AS p FROM plain
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(h, '[.-](spam|casino|poker|jackpot|cheap-pills|viagra|cialis|payday-loan|replica-watch|porn|xxx-video|warez|torrent)[.-]') THEN 'block'
    WHEN regexp_matches(h || p, '^[^/]*\.(doubleclick|googlesyndication|adserver|adservice|adnxs|scorecardresearch)\.') THEN 'block'
    WHEN regexp_matches(h || p, '/wp-login\.php|/wp-admin/|/xmlrpc\.php|/cgi-bin/|/phpmyadmin|/\.git/|/\.env') THEN 'block'
    WHEN regexp_matches(h || p, '/.*(\.exe|\.msi|\.apk|\.dmg|\.iso|\.zip|\.rar|\.7z|\.tar\.gz|\.mp3|\.mp4|\.avi|\.jpg|\.jpeg|\.png|\.gif|\.css|\.js)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled JOIN stepped USING (page_id)
""",
    "op6_warc_index": """
WITH own AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), coded AS (
    SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY hex) AS original
    FROM own
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM coded
""",
    "op7_decontamination": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
    FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), doc_windows AS (
    SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, item_id, p, n FROM doc_windows JOIN item_windows USING (n, g)
), covered AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op11_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x, row_number() OVER () AS n FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, q.n, d.vec_id, list_inner_product(q.x, d.x)::BIGINT AS score FROM v q JOIN v d ON q.n <> d.n WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank FROM scored) WHERE rank <= 20
""",
}
