"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Records are rows.  ``write_warc`` writes them as gzipped WARC files through
Spark's own committer, ``read_warc`` reads such files, and those of others
(one gzip member a record, one a file, or none), back into rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
#: Elements whose content is no text, and elements that begin a new line.
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
_LINES = frozenset("p div article section nav ul ol li table tr h1 h2 h3 h4 h5 h6 head body html title blockquote pre form header footer main aside br".split())
_CLOSE = {name: re.compile(rf"(?ai)</{name}\s*>") for name in (*_HIDDEN, "title")}
_BLANKS = re.compile(r"[^\S\n]+")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([A-Za-z-]+)")
_HREF = re.compile(r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']")
_HUGE = re.compile(r"&#[0-9]{1000,};?")


def digest(block: bytes) -> str:
    """A labelled SHA-1 in base 32, as WARC files carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(name: str) -> str:
    """The same name gives the same id: reruns link alike."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def _unescape(text: str) -> str:
    return html.unescape(_HUGE.sub("\ufffd", text))  # Python refuses numbers of thousands of digits


def read_page(page: str) -> tuple[str, list[tuple[str, str]]]:
    """Visible text of a page, and its title, language and out-links, in one pass.

    Scripts, styles and comments are left out (one that is never closed runs
    to the end, as in browsers), block elements stand on lines of their own,
    entities are decoded.  A ``<`` that opens no tag, or whose tag never ends,
    is text.  Work is in proportion to the page's length, whatever it holds.
    """
    out: list[str] = []
    links: list[tuple[str, str]] = []
    title = lang = None
    titled, at = False, 0
    one_line = lambda x: " ".join(_unescape(x).split())
    while True:
        tag = page.find("<", at)
        if tag < 0:
            out.append(page[at:])
            break
        out.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            if end < 0:
                break
            at = end + 3
            continue
        head = _NAME.match(page, tag + 1)
        if head is None and page[tag + 1 : tag + 2] not in ("/", "!", "?"):
            out.append("<")
            at = tag + 1
            continue
        end = page.find(">", tag + 1)
        if end < 0:
            out.append(page[tag:])
            break
        name, opens = head[1].lower() if head else "", page[tag + 1] != "/"
        at = end + 1
        if name in _LINES:
            out.append("\n")
        if not opens:
            continue
        if name in _HIDDEN:
            shut = _CLOSE[name].search(page, at)
            if shut is None:
                break
            at = shut.end()
        elif name == "a":
            href = _HREF.search(page, tag, at)
            links += [("outlink", one_line(href[1]))] if href else []
        elif name == "html" and lang is None:
            lang = _LANG.search(page, tag, at)
        elif name == "title" and not titled:
            titled, shut = True, _CLOSE["title"].search(page, at)
            title = page[at : shut.start()] if shut else None
    lines = _unescape("".join(out)).split("\n")
    fields = [("title", one_line(title))] if title is not None else []
    fields += [("language", lang[1])] if lang else []
    return "\n".join(x for x in (_BLANKS.sub(" ", line).strip() for line in lines) if x), fields + links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def page_fields(page: str) -> list[tuple[str, str]]:
    """Title, language and out-links for the metadata record."""
    return read_page(page)[1]


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one serialised record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k: v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    return headers, rest[: int(headers["Content-Length"])]


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response rows of a page table: page_id, record_id, target_uri, date, http_headers, body.

    A null url is an empty one, a null page an empty body.
    """

    @F.pandas_udf("string")
    def name(url, page_id):
        return (page_id.fillna("") + "|" + url.fillna("")).map(lambda x: record_id("response|" + x))

    return pages.select(
        F.col(id_col).alias("page_id"), name(F.col(url_col), F.col(id_col).cast("string")).alias("record_id"), F.coalesce(F.col(url_col), F.lit("")).alias("target_uri"), F.lit(date).alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http_headers"), F.coalesce(F.col(html_col), F.lit("")).alias("body"),
    )


DERIVED = "page_id long, response_id string, target_uri string, record_type string, record_id string, refers_to string, concurrent_to string, date string, source_headers string, source_digest string, block_digest string, content_length long, content string"


def derive(rows: DataFrame) -> DataFrame:
    """Two records for each response: metadata (warc-fields) and conversion (text/plain), as page_id and record.

    Both refer to the response's record id and keep its target, date, HTTP
    headers and payload digest; the metadata record is also concurrent to the
    conversion.  Empty bodies give records with an empty conversion.  Repeated
    rows give repeated records; an empty table none.  A null page_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                ids, records = [], []
                for r in batch.slice(lo, 500).to_pylist():
                    body, http, source = r["body"] or "", (r["http_headers"] or "").split("\r\n"), r["record_id"]
                    payload, names = digest(body.encode()), {t: record_id(f"{t}|{source}") for t in ("metadata", "conversion")}
                    kept = " ".join(f"{k.strip()}: {v.strip()};" for k, _, v in (h.partition(":") for h in http[1:]))
                    text, found = read_page(body)
                    fields = [("source-status", http[0]), ("source-headers", kept), ("source-payload-digest", payload), *found]
                    contents = {"metadata": "".join(f"{k}: {v}\r\n" for k, v in fields), "conversion": text}
                    for kind, content in contents.items():
                        block = content.encode()
                        headers = [("WARC-Type", kind), ("WARC-Record-ID", names[kind]), ("WARC-Refers-To", source), ("WARC-Target-URI", " ".join((r["target_uri"] or "").split())), ("WARC-Date", r["date"])]
                        headers += [("WARC-Concurrent-To", names["conversion"])] if kind == "metadata" else []
                        headers += [("WARC-Source-ID", str(r["page_id"]))] if r["page_id"] is not None else []
                        headers += [("WARC-Source-Payload-Digest", payload), ("WARC-Source-Headers", kept), ("WARC-Block-Digest", digest(block))]
                        headers += [("Content-Type", "application/warc-fields" if kind == "metadata" else "text/plain; charset=utf-8"), ("Content-Length", str(len(block)))]
                        ids.append(r["page_id"])
                        records.append(record_bytes(headers, block))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(records, pa.binary())], ["page_id", "record"])

    picked = rows.select(F.col("page_id").cast("long").alias("page_id"), "record_id", "target_uri", "date", "http_headers", "body")
    return picked.mapInArrow(run, "page_id long, record binary")


def response_records(rows: DataFrame) -> DataFrame:
    """A WARC response record (page_id, record) of each row of ``responses``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                records = []
                for r in part.to_pylist():
                    block = f"{r['http_headers'] or ''}\r\n\r\n{r['body'] or ''}".encode()
                    headers = [("WARC-Type", "response"), ("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", " ".join((r["target_uri"] or "").split())), ("WARC-Date", r["date"])]
                    headers += [("WARC-Source-ID", str(r["page_id"]))] if r["page_id"] is not None else []
                    headers += [("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
                    records.append(record_bytes(headers, block))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(records, pa.binary())], ["page_id", "record"])

    picked = rows.select(F.col("page_id").cast("long").alias("page_id"), "record_id", "target_uri", "date", "http_headers", "body")
    return picked.mapInArrow(run, "page_id long, record binary")


#: Records in a file at most.
PER_FILE = 5000


def write_warc(records: DataFrame, path: str) -> None:
    """Write a ``record`` column as gzipped WARC files of at most PER_FILE records; an empty table gives no record.

    A record ends with two line breaks, which is what Spark's text sink puts
    behind each row.  The records must be UTF-8, as all made here are.
    """
    body = F.expr("cast(substring(record, 1, length(record) - 4) as string)").alias("value")
    records.select(body).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", PER_FILE).text(path)


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of plain or gzipped data (any number of members), piece by piece."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + step]
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)


def split_records(data: bytes) -> Iterator[bytes]:
    """Each whole record of a WARC file's bytes, by its Content-Length."""
    held = bytearray()
    for piece in _inflated(data):
        held += piece
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            length = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", held[at : end + 2])
            if not held.startswith(b"WARC/", at) or length is None:
                raise ValueError("not a WARC record")
            stop = end + 4 + int(length[1]) + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("a WARC record is cut off")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers (map), block and record (both binary) of every record of the WARC files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for record in split_records(content.as_buffer().to_pybytes()):
                    rows.append((list(parse_record(record)[0].items()), record))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        headers, records = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(headers), pa.map_(pa.string(), pa.string())), pa.array(list(records), pa.binary())], ["headers", "record"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    found = files.mapInArrow(run, "headers map<string,string>, record binary")
    n = F.try_element_at("headers", F.lit("Content-Length")).cast("int")
    return found.withColumn("block", F.substring("record", F.length("record") - 3 - n, n))


def derived_rows(records: DataFrame) -> DataFrame:
    """The columns of DERIVED, and record, of metadata and conversion records that ``read_warc`` found."""
    h = lambda name: F.try_element_at("headers", F.lit(name))
    return records.where(h("WARC-Type").isin("metadata", "conversion")).select(
        h("WARC-Source-ID").cast("long").alias("page_id"), h("WARC-Refers-To").alias("response_id"), h("WARC-Target-URI").alias("target_uri"), h("WARC-Type").alias("record_type"),
        h("WARC-Record-ID").alias("record_id"), h("WARC-Refers-To").alias("refers_to"), h("WARC-Concurrent-To").alias("concurrent_to"), h("WARC-Date").alias("date"),
        h("WARC-Source-Headers").alias("source_headers"), h("WARC-Source-Payload-Digest").alias("source_digest"), h("WARC-Block-Digest").alias("block_digest"),
        h("Content-Length").cast("long").alias("content_length"), F.col("block").cast("string").alias("content"), "record",
    )


def responses_in(records: DataFrame) -> DataFrame:
    """The columns of ``responses`` of response records that ``read_warc`` found; bodies by their charset, else UTF-8, broken bytes replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, bodies = [], []
            for block in batch.column("block"):
                head, _, body = block.as_py().partition(b"\r\n\r\n")
                head = head.decode("utf-8", "replace")
                named = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", head)
                try:
                    text = body.decode(named[1] if named else "utf-8", "replace")
                except LookupError:
                    text = body.decode("utf-8", "replace")
                heads.append(head)
                bodies.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "record_id", "target_uri", "date")] + [pa.array(heads, pa.string()), pa.array(bodies, pa.string())], ["page_id", "record_id", "target_uri", "date", "http_headers", "body"])

    h = lambda name: F.try_element_at("headers", F.lit(name))
    found = records.where(h("WARC-Type") == "response")
    picked = found.select(h("WARC-Source-ID").cast("long").alias("page_id"), h("WARC-Record-ID").alias("record_id"), F.coalesce(h("WARC-Target-URI"), F.lit("")).alias("target_uri"), h("WARC-Date").alias("date"), "block")
    return picked.mapInArrow(run, "page_id long, record_id string, target_uri string, date string, http_headers string, body string")


def members(records: DataFrame) -> DataFrame:
    """page_id and the gzip member of each record: for writers that append members one by one."""

    @F.pandas_udf("binary")
    def pressed(data):
        return data.map(lambda x: gzip.compress(x, 6, mtime=0))

    return records.select("page_id", pressed("record").alias("member"))
