"""Pages to WARC archives and back.

Writing: each page is a request, a response and a metadata record; a page whose
payload another page already holds is a revisit of it instead of a response. Archives
are written by Spark's text writer, whose line end is the two line breaks that close a
WARC record.

Reading: archives are parsed record by record, by Content-Length, in the tasks. The
records of a transaction name the response or revisit in WARC-Concurrent-To; they are
joined on it to one nested row per capture.
"""

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, twenty bits at a time."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), HEX_DIGITS, BASE32)


def record_id(kind: str, *of: Column) -> Column:
    """A name-based URN: the same for the same page and kind."""
    text = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("null")) for c in of]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(text, a, n) for a, n in cuts]), F.lit(">"))


def _field(name: str, value: Column | str) -> Column:
    """A header line, left out where the value is null."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    line = F.concat(F.lit(name + ": "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(END))
    return F.coalesce(line, F.lit(""))


def _record(kind: Column | str, fields: list[Column], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit("WARC/1.1" + END),
        _field("WARC-Type", kind),
        *fields,
        _field("WARC-Date", DATE),
        _field("Content-Length", F.octet_length(block)),
        F.lit(END),
        block,
    )


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, bytes, record_type and refers_to of every page.

    Of pages with equal payloads of at least ``least`` bytes, those with the smallest
    id are responses and the others revisits of it. Equality is that of the SHA-256.
    Only ids and digests meet; payloads move once, to their page's row.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.col(html).alias("payload"),
        base32_sha1(body).alias("digest"),
        F.octet_length(body).cast("long").alias("bytes"),
        F.sha2(body, 256).alias("same"),
    )
    narrow = durable(rows.where(F.col("bytes") >= least).select("page_id", "same"))
    groups = durable(
        narrow.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1")
    )
    # Each page that repeats an earlier one, once; a hot payload is one row on the other side.
    again = (
        narrow.join(groups, "same")
        .where("first IS NOT NULL AND NOT page_id <=> first")
        .select(F.col("page_id").alias("_page"), F.col("same").alias("_same"), F.col("first").alias("refers_to"))
        .distinct()
    )
    match = rows["page_id"].eqNullSafe(again["_page"]) & (rows["same"] == again["_same"])
    found = rows.join(again, match, "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return found.select("page_id", "url", "payload", "digest", "bytes", "same", kind.alias("record_type"), "refers_to")


def write(found: DataFrame, path: str) -> None:
    """The captures as gzip archives of request, response or revisit, and metadata records."""
    own = record_id("capture", F.col("page_id"), F.col("same"))
    revisit = F.col("record_type") == "revisit"
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)
    target = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*([^#\r\n]*)", 1)
    asked = F.concat(
        F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1" + END), _field("Host", host), F.lit(END)
    )
    head = F.concat(
        F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END),
        _field("Content-Length", F.col("bytes")),
        F.lit(END),
    )
    said = F.concat(
        _field("page", F.col("page_id")),
        _field("payloadLength", F.col("bytes")),
        _field("refersToPage", F.col("refers_to")),
    )
    uri = _field("WARC-Target-URI", F.col("url"))
    request = _record(
        "request",
        [
            _field("WARC-Record-ID", record_id("request", F.col("page_id"), F.col("same"))),
            _field("WARC-Concurrent-To", own),
            uri,
            _field("Content-Type", "application/http; msgtype=request"),
        ],
        asked,
    )
    response = _record(
        F.col("record_type"),
        [
            _field("WARC-Record-ID", own),
            uri,
            _field("Content-Type", "application/http; msgtype=response"),
            _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            F.when(revisit, _field("WARC-Profile", IDENTICAL)).otherwise(""),
            F.when(revisit, _field("WARC-Refers-To", record_id("capture", F.col("refers_to"), F.col("same")))).otherwise(""),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.coalesce("payload", F.lit("")))),
    )
    metadata = _record(
        "metadata",
        [
            _field("WARC-Record-ID", record_id("metadata", F.col("page_id"), F.col("same"))),
            _field("WARC-Concurrent-To", own),
            uri,
            _field("Content-Type", "application/warc-fields"),
        ],
        said,
    )
    records = found.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", END + END).option("compression", "gzip").text(path)


RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, "
    "digest string, status int, method string, payload_bytes long, payload_digest string, "
    "fields map<string,string>, payload binary"
)


def _parsing(with_payload: bool):
    """Task code: archives to records."""

    def headers(source) -> dict[str, str]:
        found = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        return found

    def records(content: bytes):
        import base64
        import gzip
        import hashlib
        import io

        source = io.BytesIO(content)
        if content[:2] == b"\x1f\x8b":
            source = io.BufferedReader(gzip.GzipFile(fileobj=source))
        while line := source.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = headers(source)
            block = source.read(int(head.get("content-length", 0)))
            kind = head.get("warc-type")
            row = {
                "type": kind,
                "record_id": head.get("warc-record-id"),
                "concurrent_to": head.get("warc-concurrent-to"),
                "refers_to": head.get("warc-refers-to"),
                "uri": head.get("warc-target-uri"),
                "date": head.get("warc-date"),
                "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            }
            if kind in ("request", "response", "revisit"):
                inner = io.BytesIO(block)
                first = inner.readline().decode("utf-8", "replace").split()
                row["fields"] = list(headers(inner).items())
                if kind == "request":
                    row["method"] = first[0] if first else None
                elif len(first) > 1 and first[1].isdigit():
                    row["status"] = int(first[1])
                if kind == "response":
                    payload = inner.read()
                    row["payload_bytes"] = len(payload)
                    row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    row["payload"] = payload if with_payload else None
            elif kind == "metadata":
                row["fields"] = list(headers(io.BytesIO(block)).items())
            yield row

    names = [f.split()[0] for f in RECORD.split(", ")]
    text = pa.string()
    kinds = [text] * 7 + [pa.int32(), text, pa.int64(), text, pa.map_(text, text), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            columns = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in records(content.as_buffer().to_pybytes()):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= 2000 or held > 16_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return parse


def read(spark, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``, plain or gzip, by task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsing(with_payload), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, and its response (or revisit), request
    and metadata, joined through WARC-Concurrent-To.

    A capture without a request or metadata record has a null there, as has a request or
    metadata record whose response is missing. Of several requests or metadata records
    of one capture the one with the least id is taken; a repeated response stays.
    """

    def part(kind: str) -> DataFrame:
        rows = records.where(F.col("type") == kind)
        own = F.struct("record_id", *[c for c in records.columns if c not in ("record_id", "concurrent_to", "payload")])
        picked = F.min_by(own, "record_id").alias(kind)
        return rows.where("concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("capture")).agg(picked)

    answers = records.where(F.col("type").isin("response", "revisit"))
    answers = answers.select(
        F.col("record_id").alias("capture"),
        F.struct(*[c for c in records.columns if c not in ("concurrent_to", "fields")], "fields").alias("response"),
    )
    both = part("request").join(part("metadata"), "capture", "full_outer")
    return answers.join(both, "capture", "full_outer").withColumnRenamed("capture", "record_id")
