r"""WARC derivatives: metadata and plain-text conversion records for each response record.

A response (record id, target address, date, HTTP header block, payload) gives two records that refer to it by
WARC-Refers-To and keep its address and date: a metadata record of warc-fields with the source's HTTP status and
headers, its digests, title, out-links and sizes; and a conversion record with the page's plain text. Each record's
id is derived from its source's id, so a rerun writes the same records.

The derivation is made of built-in functions row by row: no shuffle, no state. `write_warc` lays records down as WARC
files, each with a warcinfo record first; `read_warc` parses such files and others, plain or of gzip members.

Defined results: a null page is an empty payload and a null address an empty one; a null id gives records of the
source id made from "null"; repeated rows give repeated records; other columns are ignored. An unclosed comment, script
or style hides the rest of its page; a < that begins no tag and unknown entities stay as text. So each pattern
either matches or fails by the next < and the time follows the page's length. Records of a file that can't be read (no
length, a length that isn't a number) are passed over up to the next that can; a truncated last record is left out.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ._common import read, tidy

#: Bytes of records that are passed on at once, and of a record's header at most.
PART, HEAD_BYTES = 1 << 23, 1 << 20
VERSION, DATE, CRLF = "WARC/1.1", "2024-01-01T00:00:00Z", "\r\n"

# fixed values: patterns that both Java and RE2 read alike, and entities in the order they are decoded
HIDDEN = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
TITLE = r"(?is)<title>([^<]*)"
BREAKS = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|title|head|body|html|blockquote|pre)(?:\s[^<>]*)?/?>"
TAGS = r"<[^<>]*>"
BLANKS = r"[ \t\r\f]+"
NEWLINES = r" ?\n[ \n]*"
LINK = r'href="([^"]*)"'
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")]


def _uuid(key: Column) -> Column:
    h = F.md5(key.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def decode(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAKS, "\n")
    text = F.regexp_replace(F.regexp_replace(decode(F.regexp_replace(text, TAGS, "")), BLANKS, " "), NEWLINES, "\n")
    return F.btrim(text, F.lit(" \n"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """pages (page_id, url, html) as response records: record_id, target_uri, date, http_headers, payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    size = F.octet_length(payload).cast("string")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF))
    key = F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("")))
    return pages.select("page_id", _uuid(key).alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"))


def derive(source: DataFrame) -> DataFrame:
    """Two rows per response: page_id, record_id, warc_type, refers_to, target_uri, date, content_type,
    content_length, block_digest, content."""
    block = F.concat("http_headers", F.lit(CRLF), "payload")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    flat = lambda c: F.btrim(F.regexp_replace(decode(F.regexp_replace(c, TAGS, "")), r"[ \t\r\n\f]+", " "), F.lit(" "))
    links = F.regexp_extract_all("payload", F.lit(LINK), F.lit(1))
    fields = F.concat(
        line("source-block-digest", _digest(block)),
        line("source-payload-digest", _digest(F.col("payload"))),
        line("source-content-length", F.octet_length(block).cast("string")),
        line("http-status-line", F.substring_index("http_headers", CRLF, 1)),
        F.regexp_replace(F.expr("substr(http_headers, length(substring_index(http_headers, '\\r\\n', 1)) + 3)"), r"(?m)^([A-Za-z-]+: )", "http-header-$1"),
        line("title", flat(F.regexp_extract("payload", TITLE, 1))),
        line("outlink-count", F.size(links).cast("string")),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("content")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("content")),
    )
    out = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.inline(kinds))
    return out.select(
        "page_id", _uuid(F.concat_ws("|", "warc_type", "refers_to")).alias("record_id"), "warc_type", "refers_to", "target_uri", "date", "content_type",
        F.octet_length("content").cast("long").alias("content_length"), _digest(F.col("content")).alias("block_digest"), "content",
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(read(spark, sf_dir, "pages")))


# Files

_NAMES = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest"}
_FIELDS = {v.lower(): k for k, v in _NAMES.items()}


def record_head(row: dict, size: int) -> bytes:
    head = "".join(f"{name}: {row[c]}{CRLF}" for c, name in _NAMES.items() if row.get(c))
    if row.get("refers_to"):
        head += "".join(f"WARC-Refers-To-{name}: {row[c]}{CRLF}" for c, name in (("target_uri", "Target-URI"), ("date", "Date")) if row.get(c))
    return f"{VERSION}{CRLF}{head}Content-Length: {size}{CRLF}{CRLF}".encode()


def record_bytes(row: dict) -> bytes:
    """A record and the two line ends after it."""
    content = row["content"] or b""
    content = content.encode() if isinstance(content, str) else bytes(content)
    return record_head(row, len(content)) + content + b"\r\n\r\n"


def _chunks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, those of gzip members decompressed, in bounded parts; a broken member ends them."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + size] for at in range(0, len(data), size))
        return
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        try:
            while not d.eof and at < len(data):
                part = data[at : at + size]
                at += len(part)
                out = d.decompress(part, size)
                while out:
                    yield out
                    out = d.decompress(d.unconsumed_tail, size) if not d.eof else b""
        except zlib.error:
            return
        at -= len(d.unused_data)


_MARK = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, whether plain or of gzip members, with their contents as bytes."""
    held, parts, more = bytearray(), _chunks(data), True

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(held) < n:
            part = next(parts, None)
            more = part is not None
            held.extend(part or b"")
        return len(held) >= n

    while fill(1):
        fill(10)
        found = _MARK.search(held)
        while not found and more:
            del held[: max(0, len(held) - 9)]
            fill(len(held) + 1)
            found = _MARK.search(held)
        if not found:
            return
        del held[: found.start()]
        end = held.find(b"\r\n\r\n")
        while end < 0 and more and len(held) < HEAD_BYTES:
            fill(len(held) + 1)
            end = held.find(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in bytes(held[: max(end, 0)]).decode("utf-8", "replace").split(CRLF)[1:])}
        size = fields.get("content-length", "")
        if end < 0 or not re.fullmatch("[0-9]{1,18}", size):
            del held[:1]  # on to the next mark
            continue
        if not fill(end + 4 + int(size)):
            return
        row = {c: fields.get(name) for name, c in _FIELDS.items()}
        yield row | {"content": bytes(held[end + 4 : end + 4 + int(size)]), "content_length": int(size)}
        fill(end + 8 + int(size))
        del held[: end + 4 + int(size)]
        while held[:2] == b"\r\n":
            del held[:2]


def write_warc(records: DataFrame, path: str, software: str = "longview") -> None:
    """Records (the columns of `derive`, content as text or binary) as plain WARC files in the folder path, one per task,
    each beginning with a warcinfo record. The engine's own writer commits them, so a lost task leaves no part of a file;
    they get their suffix afterwards."""
    columns = [*_NAMES, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            rows = [record_bytes(r)[:-4] for r in batch.to_pylist()]  # the writer ends each row with two line ends
            if first and rows:
                told, key = f"software: {software}{CRLF}format: WARC File Format 1.1{CRLF}".encode(), uuid.uuid4()
                rows.insert(0, record_head({"record_id": f"<urn:uuid:{key}>", "warc_type": "warcinfo", "date": DATE, "content_type": "application/warc-fields"}, len(told)) + told)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["data"])

    text = records.select(columns).mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").text(path)
    sc = records.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(f.getPath(), sc._jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".warc"))


_RECORD = pa.schema([*((c, pa.string()) for c in ("record_id", "warc_type", "refers_to", "target_uri", "date", "content_type")), ("content_length", pa.int64()), ("block_digest", pa.string()), ("content", pa.binary())])


def read_warc(files: DataFrame, column: str = "content") -> DataFrame:
    """Records of files held in a binary column, as spark.read.format('binaryFile') gives them; contents are binary. A
    file's bytes are in one row, its records are decompressed and passed on PART bytes at a time."""
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for value in given.column(0):
                rows, size = [], 0
                for row in parse_records(value.as_py() or b""):
                    rows.append(row)
                    size += row["content_length"]
                    if size > PART:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    return files.select(F.col(column).cast("binary")).mapInArrow(tidy(run), from_arrow_schema(_RECORD))


def _sql_decode(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _sql_uuid(key: str) -> str:
    return f"(select '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' from (select md5({key}) as h))"


_SQL_PLAIN = f"""trim(regexp_replace(regexp_replace({_sql_decode(f"regexp_replace(regexp_replace(regexp_replace(payload, '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g')")}, '{BLANKS}', ' ', 'g'), '{NEWLINES}', chr(10), 'g'), ' ' || chr(10))"""
_SQL_TITLE = f"""trim(regexp_replace({_sql_decode(f"regexp_replace(regexp_extract(payload, '{TITLE}', 1), '{TAGS}', '', 'g')")}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')"""

OP6_SQL = f"""
with s as (
  select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload, chr(13) || chr(10) as nl,
    {_sql_uuid("'response|' || coalesce(cast(page_id as varchar), 'null') || '|' || coalesce(url, '')")} as refers_to
  from pages
), b as (
  select *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(payload) || nl || nl || payload as block,
    regexp_extract_all(payload, '{LINK}', 1) as links
  from s
), k as (
  select page_id, refers_to, target_uri, 'metadata' as warc_type, 'application/warc-fields' as content_type,
    'source-block-digest: sha256:' || sha256(block) || nl || 'source-payload-digest: sha256:' || sha256(payload) || nl || 'source-content-length: ' || strlen(block) || nl
    || 'http-status-line: HTTP/1.1 200 OK' || nl || 'http-header-Content-Type: text/html; charset=utf-8' || nl || 'http-header-Content-Length: ' || strlen(payload) || nl
    || 'title: ' || {_SQL_TITLE} || nl || 'outlink-count: ' || len(links) || nl || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || nl), ''), '') as content
  from b
  union all
  select page_id, refers_to, target_uri, 'conversion', 'text/plain', {_SQL_PLAIN} from b
)
select page_id, {_sql_uuid("warc_type || '|' || refers_to")} as record_id, warc_type, refers_to, target_uri, '{DATE}' as date, content_type,
  cast(strlen(content) as bigint) as content_length, 'sha256:' || sha256(content) as block_digest, content
from k
"""
