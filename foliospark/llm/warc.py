"""WARC archives with an index: payloads that recur become revisit records.

Each task writes archive files of bounded size and returns an index row for
each record: file, offset, length, URL and digest. Only files that the index
names count, so a repeated task leaves no doubt. To read, the index comes
first: files are cut into stretches of equal bytes, a stretch's wanted records
are sorted by offset, neighbouring byte ranges are joined into one read, and
each record is parsed from it and held against the index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import shared_path, stored

INDEX = "file STRING, offset BIGINT, length BIGINT, url STRING, payload_digest STRING, payload_bytes BIGINT, record_type STRING"
RECORD = "payload_bytes BIGINT, payload_digest STRING, record_type STRING"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """A header value on one line; control characters become percent signs and hex."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _named(key: str) -> str:
    """A key as part of a record's id; ``_key`` gives it back."""
    return re.sub(r"[\x00-\x20\x7f%<>]", lambda m: f"%{ord(m[0]):02X}", key)


def _key(record_id: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), record_id.removeprefix("<urn:page:").removesuffix(">"))


def record(key: str, url: str | None, payload: bytes, own_digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC 1.1 record. With ``refers_to`` it is a revisit, which holds the payload's size and digest but not the payload."""
    revisit = refers_to is not None
    body = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_named(key)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{own_digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{_named(refers_to)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_originals(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``df`` without its digest, and ``__first``: the smallest key among equal payloads of ``min_bytes`` at least, null for unique ones.

    Only digests are compared. Payloads that recur are a table of their own: Spark broadcasts it if it is
    small, else both sides are shuffled by digest, where skewed digests are split.
    """
    digests = df.select("__key", "__sha", "__size").filter(F.col("__size") >= min_bytes)
    firsts = digests.groupBy("__sha").agg(F.min("__key").alias("__first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND __first IS NOT NULL").select("__sha", "__first")
    return df.join(stored(firsts, "warc-firsts"), "__sha", "left").drop("__sha", "__size")


def write(df: DataFrame, key: str, url: str, html: str, path: str | None = None, min_bytes: int = 0, file_bytes: int = 128 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows as WARC files below ``path`` (a new shared folder by default); the result is the stored index with the key.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads, those with the smallest key are
    responses and the others revisit it (rows that repeat that key are all responses; a null key never is the original).
    A null url is left out of the record; control characters of a url are percent signs and hex in the record and whole
    in the index. Repeated rows give a record each, an empty table an empty index. Other columns are ignored. A payload
    of any length is one record; a file is closed after the record that fills ``file_bytes``.
    """
    base = path or shared_path(df.sparkSession, "warc")
    rows = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{url}`").alias("__url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("__html"))
    rows = rows.withColumn("__sha", F.sha1(F.encode("__html", "UTF-8"))).withColumn("__size", F.octet_length("__html"))
    source = with_originals(rows, min_bytes).withColumn("__first", F.when(F.col("__first").eqNullSafe(F.col("__key")), F.lit(None)).otherwise(F.col("__first")))
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", key_type), T.StructField("refers_to", key_type), *T._parse_datatype_string(INDEX).fields])
    limit = file_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            made: list[tuple] = []
            for k, u, h, f in zip(*(batch.column(c) for c in ("__key", "__url", "__html", "__first")), strict=True):
                payload = h.as_py().encode("utf-8", "surrogatepass")
                k, u, f = k.as_py(), u.as_py(), f.as_py()
                if out is None or at >= limit:
                    if out is not None:
                        out.close()
                    name, at = f"{root}/{uuid.uuid4().hex}.warc", 0
                    out = store.open_output_stream(name)
                own = digest(payload)
                raw = record(str(k), u, payload, own, None if f is None else str(f), date)
                out.write(raw)
                made.append((k, f, name, at, len(raw), u, own, len(payload), "response" if f is None else "revisit"))
                at += len(raw)
            columns = list(zip(*made, strict=True)) or [()] * len(schema.names)
            kinds = [batch.column("__key").type] * 2 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema.names)
        if out is not None:
            out.close()

    index = source.select("__key", "__url", "__html", "__first").mapInArrow(run, schema)
    return stored(index.withColumn("root", F.lit(base)), "warc-index")


def read(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, stretch: int = 32 << 20, originals: DataFrame | None = None) -> DataFrame:
    """The records that the (perhaps filtered) index names: key, refers_to as stored in the archive, payload_bytes,
    payload_digest, record_type and, for responses, the payload. Ranges at most ``gap`` bytes apart are read
    at once, up to ``most`` bytes. Work is split by bytes: records that begin in the same ``stretch`` bytes of a file stay
    together, and there are as many partitions as the records fill stretches.

    An error is: a record whose type, size or digest is not the index's, a response whose payload does not fit its digest,
    and, with ``originals`` (the whole index), a revisit without a response of that key, size and digest there.
    """
    key = index.schema["key"].dataType
    schema = T.StructType([T.StructField("key", key), T.StructField("refers_id", T.StringType()), *T._parse_datatype_string(RECORD).fields, T.StructField("payload", T.BinaryType())])
    total = index.agg(F.sum("length")).first()[0] or 0
    wanted = index.select("root", "file", "offset", "length", "key", "record_type", "payload_bytes", "payload_digest")
    wanted = wanted.repartition(max(1, -(-total // stretch)), "file", F.floor(F.col("offset") / stretch)).sortWithinPartitions("file", "offset")

    names = wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, handle, opened = None, None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            i = 0
            while i < len(rows):
                root, file, begin, length = rows[i][:4]
                end, j = begin + length, i + 1
                while j < len(rows) and rows[j][1] == file and rows[j][2] - end <= gap and rows[j][2] + rows[j][3] - begin <= most:
                    end, j = max(end, rows[j][2] + rows[j][3]), j + 1
                if file != opened:
                    store = store or fs.FileSystem.from_uri(root)[0]
                    if handle is not None:
                        handle.close()
                    handle, opened = store.open_input_file(file), file
                raw = handle.read_at(end - begin, begin)
                made = []
                for _, _, at, n, k, *indexed in rows[i:j]:
                    fields, payload = parse(raw[at - begin : at - begin + n])
                    kind, size, stated = fields["warc-type"], int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                    if [kind, size, stated] != indexed:
                        raise ValueError(f"{file}: the record at {at} is not that of the index")
                    if kind == "response" and (len(payload), digest(payload)) != (size, stated):
                        raise ValueError(f"{file}: the payload at {at} does not fit its digest")
                    refers = fields.get("warc-refers-to")
                    made.append((k, refers and _key(refers), size, stated, kind, payload if kind == "response" else None))
                kinds = [batch.column("key").type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], schema.names)
                i = j
        if handle is not None:
            handle.close()

    out = wanted.mapInArrow(run, schema).withColumn("refers_to", F.col("refers_id").cast(key)).drop("refers_id")
    if originals is not None:
        first = originals.filter("record_type = 'response'").select(F.col("key").alias("refers_to"), "payload_bytes", "payload_digest", F.lit(True).alias("there")).distinct()
        out = out.join(first, ["refers_to", "payload_bytes", "payload_digest"], "left")
        lost = F.raise_error(F.concat(F.lit("no original of the record "), F.col("key").cast("string"))).cast("string")
        out = out.withColumn("record_type", F.when((F.col("record_type") == "revisit") & F.col("there").isNull(), lost).otherwise(F.col("record_type")))
    return out.select("key", "refers_to", "payload_bytes", "payload_digest", "record_type", "payload")
