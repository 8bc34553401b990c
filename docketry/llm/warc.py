"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record.

Both name the response they derive from (WARC-Refers-To, its target URI and date), keep the source's
HTTP header block and payload digest, carry digests of their own, and name each other
(WARC-Concurrent-To).  Identifiers are derived from the source's, so a re-run task writes the same.

Input: record_id, target_uri, date, http_headers, payload (string or null), as :func:`read` gives them
of WARC files and :func:`responses` of a table of pages.  A null payload counts as empty, a null URI or
header block as the empty string.  Pages that repeat an id, a URL or both are responses of their own
with ids of their own: the row's place in its file is part of an id (of a table that is not read from files, its place in
the partition), so other splits and re-run tasks give the same.  Line ends in header values
become blanks when records are written.  Very long pages are converted whole, extra columns ignored.
An empty table gives no records.
"""

from __future__ import annotations

import gzip
import html
import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketry.llm.common import table

RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload string"
CRAWL_DATE = "2024-01-01T00:00:00Z"
COLUMNS = ("record_type", "record_id", "refers_to", "refers_to_target_uri", "refers_to_date", "concurrent_to", "target_uri", "date", "content_type", "source_headers", "source_payload_digest", "block_digest", "content_length", "content")
# The title goes to the metadata record; what else a head holds has no text, so a head that is not closed hides nothing.
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|template|noscript|title)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
# What is left of a tag: quoted values may hold ">".  All ends at a "<", so markup that is never closed costs no more than its tag.
_INSIDE = r"(?:[^\"'<>]|\"[^\"<]*\"|'[^'<]*')*+>"
_BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|aside|main|form|blockquote|pre|hr|title|body|html|dl|dt|dd|figure|figcaption)\b(?:" + _INSIDE + r"|[^<>]*>)", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z](?:" + _INSIDE + r"|[^<>]*>?)")
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")


def plain_text(page: str | None) -> str:
    """The page's visible text: one line a block, references decoded."""
    text = _HIDDEN.sub(" ", page or "").replace("\n", " ")
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", text)))
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip()


def _plain(pages: pd.Series) -> pd.Series:
    return pages.map(plain_text)


def _plain_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return map(_plain, batches)


def uuid_of(*parts: Column) -> Column:
    """A version-5-shaped URN made from a hash of ``parts``."""
    h = F.sha1(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def _place(pages: DataFrame) -> tuple[Column, ...]:
    """What tells equal rows apart: a row's file and its place in it, where the table is read from files."""
    try:
        columns = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        pages.select(*columns).schema  # noqa: B018
    except AnalysisException:
        return (F.monotonically_increasing_id(),)
    return columns


def responses(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html), carrying page_id."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"))
    record_id = uuid_of(F.lit("response"), F.col("page_id"), F.col("url"), F.sha2(body, 256), *_place(pages))
    return pages.select("page_id", record_id.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), body.alias("payload"))


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The metadata and the conversion record of every response, with ``keep`` columns in front."""
    plain = F.pandas_udf(_plain_batches, StringType())
    payload = F.coalesce(F.col("payload"), F.lit(""))
    base = records.select(
        *keep, F.coalesce("record_id", F.lit("")).alias("source_id"), F.coalesce("target_uri", F.lit("")).alias("uri"), F.coalesce("date", F.lit("")).alias("at"),
        F.coalesce("http_headers", F.lit("")).alias("head"), digest(payload).alias("payload_digest"), plain(payload).alias("plain"),
        F.regexp_extract(payload, r"(?is)<title[^>]*>\s*(.*?)\s*</title", 1).alias("title"),
        F.regexp_extract(payload, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("lang"),
        F.regexp_extract_all(payload, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'\r\n]*)"), F.lit(1)).alias("links"),
    )
    field = lambda name, value: F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n"))
    fields = F.concat(
        F.when(F.col("title") != "", field("title", F.col("title"))).otherwise(""), F.when(F.col("lang") != "", field("languages-html", F.col("lang"))).otherwise(""),
        field("payload-digest", F.col("payload_digest")), F.array_join(F.transform("links", lambda x: field("outlink", x)), ""),
    )
    meta_id, text_id = uuid_of(F.lit("metadata"), F.col("source_id")), uuid_of(F.lit("conversion"), F.col("source_id"))

    def record(kind: str, own: Column, other: Column, content_type: str, content: Column) -> Column:
        values = (F.lit(kind), own, F.col("source_id"), F.col("uri"), F.col("at"), other, F.col("uri"), F.col("at"), F.lit(content_type), F.col("head"), F.col("payload_digest"), digest(content), F.octet_length(content).cast("long"), content)
        return F.struct(*(v.alias(c) for v, c in zip(values, COLUMNS, strict=True)))

    both = F.array(record("metadata", meta_id, text_id, "application/warc-fields", fields), record("conversion", text_id, meta_id, "text/plain; charset=utf-8", F.col("plain")))
    return base.select(*keep, F.explode(both).alias("r")).select(*keep, "r.*")


def serialized(derived: DataFrame) -> DataFrame:
    """One column ``record``: the records in WARC/1.1 form without their closing blank lines (see :func:`save`).
    The source's header lines are kept as WARC-Source-Header fields."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n"))
    angled = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    source = F.array_join(F.transform(F.filter(F.split("source_headers", "\r\n"), lambda h: h != ""), lambda h: line("WARC-Source-Header", h)), "")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", angled("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", angled("refers_to")), line("WARC-Refers-To-Target-URI", F.col("refers_to_target_uri")), line("WARC-Refers-To-Date", F.col("refers_to_date")), line("WARC-Concurrent-To", angled("concurrent_to")),
        source, line("WARC-Source-Payload-Digest", F.col("source_payload_digest")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return derived.select(F.concat(head, F.lit("\r\n"), F.col("content")).alias("record"))


def save(derived: DataFrame, path: str) -> None:
    """Write WARC files: the two line ends that close a record are the writer's line separator."""
    serialized(derived).write.option("lineSep", "\r\n\r\n").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file's bytes (gzip members are unpacked); an error if one is cut off."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        head = dict(h.split(":", 1) for h in lines[1:] if ":" in h)
        head = {k.strip(): v.strip() for k, v in head.items()}
        size = int(head["Content-Length"])
        if end + 4 + size > len(data):
            raise ValueError("a WARC record is cut off")
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._-]+)", re.I)


def _response(head: dict[str, str], block: bytes) -> tuple[str | None, ...]:
    """record_id, target_uri, date, http_headers and payload of a response record."""
    http, _, body = block.partition(b"\r\n\r\n")
    lines = http.decode("latin-1")
    if re.search(r"(?im)^content-encoding:\s*gzip", lines):
        body = gzip.decompress(body)
    found = _CHARSET.search(lines)
    try:
        payload = body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:  # a charset that is unknown
        payload = body.decode("utf-8", "replace")
    return head.get("WARC-Record-ID", "").strip("<>") or None, head.get("WARC-Target-URI", "").strip("<>") or None, head.get("WARC-Date"), lines + "\r\n\r\n", payload


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, plain or gzipped: record_id, target_uri, date, http_headers, payload.  Records
    of other types are skipped.  A file is unpacked by one task, so crawls are best kept in files of some hundred MB."""
    names = RESPONSE.replace(" string", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = (_response(head, block) for head, block in parse(data.as_py()) if head.get("WARC-Type") == "response")
                while some := list(itertools.islice(rows, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")), keep=("page_id",))
