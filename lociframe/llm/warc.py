"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

Records are written by Spark's own text writer (any file system, committed by
task), whose line separator is the end of a WARC record; with gzip each file is
one member of many records. The reader takes plain and compressed files. A
record or member that fails a check (version line, header, length, end mark,
digest, CRC) ends the plain sailing: the reader looks for the next version line
or member that holds, goes on there and logs the bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, table

#: Payloads below this size are always stored; the record's and its HTTP head's form.
SMALL = 100
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in a file, which the reader takes as one row.
FILE_RECORDS = 2000
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_MEMBER = b"\x1f\x8b\x08"


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, digest, n, refers_to) of revisits: pages whose payload, of ``SMALL`` bytes or more, a smaller id has."""
    html = F.coalesce("html", F.lit(""))
    slim = materialise(pages.select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n")), "payloads")
    first = slim.where(F.col("n") >= SMALL).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1")
    first = materialise(first.select("digest", "refers_to"), "firsts")
    return slim.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archive the rows of ``pages`` (``page_id``, ``url``, ``html``) under ``path``.

    A null payload is empty. Rows of the same id and payload are all responses
    if that id is the smallest; a row without id is always a response, and
    carries no id. Control characters in an url are written as percent codes.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    again = decide(pages).toDF("p", "d", "refers_to")
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    pages = pages.join(again, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    url = F.coalesce("url", F.lit(""))
    url = F.when(url.rlike(r"[\x00-\x20\x7f]"), F.regexp_replace(F.url_encode(url), r"\+", "%20")).otherwise(url)
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    none = F.lit("")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:payload:"), "digest", F.lit(">")))), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(url != "", line("WARC-Target-URI", url)).otherwise(none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(none),
        line("Payload-Length", F.octet_length("html").cast("string")), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    out = pages.select(record.alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_RECORDS)
    out.option("compression", compression).text(path)


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record that starts here, if it is whole and its digest holds."""
    if not _VERSION.match(data, at):
        return None
    head = data.find(END, at, at + (1 << 16))
    if head < 0:  # a very long url, or no end: no header reaches beyond the next version line
        later = _VERSION.search(data, at + 1)
        head = data.find(END, at, later.start() if later else len(data))
    if head < 0:
        return None
    headers = {}
    for text in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or name in headers and name != "warc-concurrent-to":  # a header broke off within another's
            return None
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        return None
    start = head + len(END)
    end = start + int(length)
    if data[end : end + len(END)] != END:
        return None
    block = data[start:end]
    digest = headers.get("warc-payload-digest", "")
    if _checked(headers) and hashlib.sha256(payload(headers, block)).hexdigest() != digest[7:]:
        return None
    return headers, block, end + len(END)


def payload(headers: dict[str, str], block: bytes) -> bytes:
    """The entity in a record's block."""
    return block.partition(END)[2] if headers.get("content-type", "").startswith("application/http") else block


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record" or "gap", start, end, headers, block) in the order of a file's bytes.

    For a record within a member, start and end are the member's. Of a member
    that breaks off or ends badly, the records before the break are kept and
    the whole member is logged as a gap as well. If it is damaged, bytes just
    before zlib sees it may be wrong: kept is what is up to the last record
    whose payload digest holds.
    """
    at, gap = 0, None
    while at < len(data):
        found, end = [], None
        if data.startswith(_MEMBER, at):
            inner, end, whole, damaged = _member(data, at)
            found = list(_plain(inner))
            if damaged:
                found = found[: max((k + 1 for k, x in enumerate(found) if x and _checked(x[0])), default=0)] + [None]
            if not whole or None in found:
                found, end = [x for x in found if x], None
        elif (one := _record(data, at)) is not None:
            found, end = [one], one[2]
        if end is not None or found:
            if gap is not None and gap < at:
                yield "gap", gap, at, {}, b""
            gap = None
        stop = end if end is not None else _next(data, at + 1)
        for headers, block, _ in found:
            yield "record", at, stop, headers, block
        if end is None and gap is None:
            gap = at
        at = stop
    if gap is not None:
        yield "gap", gap, len(data), {}, b""


def _next(data: bytes, at: int) -> int:
    version, member = _VERSION.search(data, at), data.find(_MEMBER, at)
    return min((x for x in (version.start() if version else -1, member) if x >= 0), default=len(data))


def _checked(headers: dict[str, str]) -> bool:
    """Whether a record has a digest that ``_record`` compares with its payload."""
    return headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").startswith("sha256:")


def _member(data: bytes, at: int) -> tuple[bytes, int, bool, bool]:
    """What a gzip member holds, where it ends, whether it is whole, and whether it is damaged rather than cut off.

    A step that fails is taken again in smaller ones, down to single bytes, as
    zlib gives nothing of a call that meets the break.
    """
    unzip, out, k, step = zlib.decompressobj(31), [], at, 1 << 16
    while k < len(data):
        before = unzip.copy()
        try:
            out.append(unzip.decompress(data[k : k + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), len(data), False, True
            unzip, step = before, step >> 8 or 1
            continue
        k = min(k + step, len(data))
        if unzip.eof:
            return b"".join(out), k - len(unzip.unused_data), True, False
    return b"".join(out), len(data), False, False


def _plain(data: bytes):
    """Records of a member; None for a stretch that fails."""
    at = 0
    while at < len(data):
        one = _record(data, at)
        yield one
        if one is None:
            later = _VERSION.search(data, at + 1)
            at = later.start() if later else len(data)
        else:
            at = one[2]


FOUND = "kind string, file string, start long, end long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (kind ``record``) and per quarantined stretch of bytes (kind ``gap``) of the archives under ``path``."""

    def batch(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for file, data in zip(frame["path"], frame["content"]):
                for kind, start, end, headers, block in salvage(bytes(data)):
                    number = lambda name: (lambda m: int(m[1]) if m else None)(re.fullmatch(r"<urn:page:(-?\d+)>", headers.get(name, "")))  # noqa: B023, E731
                    type_ = headers.get("warc-type")
                    body = payload(headers, block)
                    size, digest = len(body), hashlib.sha256(body).hexdigest()
                    if type_ == "revisit":
                        size, digest = int(headers.get("payload-length", "0")), headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    gap = kind == "gap"
                    rows.append((kind, file, start, end, number("warc-record-id"), type_, None if gap else size, None if gap else digest, number("warc-refers-to")))
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in FOUND.split(", ")])
            yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInPandas(batch, FOUND)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read(spark, path).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
