"""WARC archives of pages: written with revisits, read back by verified record boundaries."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.files import NewFile, opened
from tradewind.llm.stored import stored
from tradewind.session import shared_folder

# Bytes of an archive that one task searches for records, and the size from which a task begins a
# new archive.
SPLIT = 4 << 20
ARCHIVE = 256 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
NO_ID = (1 << 63) - 1
CHUNK = 1 << 20

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
PLAIN_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page, url, payload: bytes, refers_to) -> bytes:
    """One record, response or revisit, with the blank lines after it."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", address),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", str(page)),
    ]
    if refers_to is not None:
        head += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and length of the record at the start of ``data``; None if there is none or
    it is not all there."""
    if not PLAIN_MAGIC.match(data):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = head.get("content-length", "")
    if not length.isdigit():
        return None
    after = end + 4 + int(length)
    if data[after : after + 4] != b"\r\n\r\n":
        return None
    return head, data[end + 4 : after], after + 4


class Window:
    """Bytes of an archive from an offset on, fetched as they are needed."""

    def __init__(self, file, size: int, start: int, end: int) -> None:
        self.file, self.size, self.start = file, size, start
        self.data = self._fetch(start, end)

    def _fetch(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(min(end, self.size) - start)

    def upto(self, end: int) -> bytes:
        """All from the start to ``end`` at least, or to the end of the file."""
        have = self.start + len(self.data)
        if end > have and have < self.size:
            self.data += self._fetch(have, max(end, have + CHUNK))
        return self.data


def _member(window: Window, at: int) -> tuple[bytes, int] | None:
    """Content and length of the gzip member at this place of the window; None if it is none."""
    unzip = zlib.decompressobj(wbits=31)
    content, place = b"", at
    try:
        while not unzip.eof:
            data = window.upto(window.start + place + 1)[place : place + CHUNK]
            if not data:
                return None
            content += unzip.decompress(data)
            place += len(data)
    except zlib.error:
        return None
    return content, place - len(unzip.unused_data) - at


def candidates(path: str, size: int, start: int, end: int) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, offset of the successor, header, block) of everything between ``start`` and ``end``
    that reads as a record; magic bytes inside a payload may do so too."""
    system, at_path = opened(path)
    zipped = path.endswith(".gz")
    with system.open_input_file(at_path) as file:
        window = Window(file, size, start, end + 16)
        at = 0
        while True:
            if zipped:
                at = window.data.find(GZIP_MAGIC, at)
            else:
                found = PLAIN_MAGIC.search(window.data, at)
                at = found.start() if found else -1
            if at < 0 or start + at >= end:
                return
            if zipped:
                member = _member(window, at)
                result = parsed(member[0]) if member else None
                if result and result[2] == len(member[0]):
                    yield start + at, start + at + member[1], result[0], result[1]
            else:
                result, more = None, CHUNK
                while result is None:
                    data = window.upto(start + at + more)[at:]
                    result = parsed(data)
                    # A record is longer than what is here, or it is none.
                    if result is None:
                        head = re.search(rb"(?i)\r\ncontent-length: *(\d+)", data[: data.find(b"\r\n\r\n") + 2])
                        need = int(head[1]) + data.find(b"\r\n\r\n") + 8 if head else 0
                        if len(data) >= need or start + at + len(data) >= size:
                            break
                        more = need
                if result:
                    yield start + at, start + at + result[2], result[0], result[1]
            at += 1


def write_archives(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    zipped: bool = True,
    archive: int = ARCHIVE,
) -> DataFrame:
    """Writes a record per page and returns the archives that are complete: (path, size, records).

    Of the pages with an equal payload the one with the smallest id is a response, the others
    revisit it without the payload. Digests are grouped on their own; hot ones are split between
    tasks by the join. Each task writes archives of its own and names them when they are complete;
    those of a lost attempt are never named."""
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    page = F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID))
    digests = stored(
        pages.select(page.alias("page"), F.sha1(payload).alias("digest"), F.length(payload).alias("n")),
        "warc-digests",
    )
    firsts = digests.groupBy("digest", "n").agg(F.min("page").alias("first"), F.count("*").alias("pages"))
    firsts = stored(firsts.where("pages > 1").drop("pages"), "warc-firsts")
    revisits = (
        digests.join(firsts, ["digest", "n"])
        .where("page > first")
        .groupBy("page", "digest", "n")
        .agg(F.first("first").alias("first"))
    )
    rows = pages.select(
        page.alias("page"),
        F.col(url_column).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.length(payload).alias("n"),
    ).join(revisits, ["page", "digest", "n"], "left")

    def write(batches):
        done, now, count = [], None, 0
        for batch in batches:
            for each in zip(*(batch.column(c) for c in ("page", "url", "payload", "first")), strict=True):
                data = record(*(value.as_py() for value in each))
                if zipped:
                    zipper = zlib.compressobj(LEVEL, wbits=31)
                    data = zipper.compress(data) + zipper.flush()
                now = now or NewFile(folder, ".warc.gz" if zipped else ".warc")
                now.write(data)
                count += 1
                if now.size >= archive:
                    now.close()
                    done.append((now.path, now.size, count))
                    now, count = None, 0
        if now:
            now.close()
            done.append((now.path, now.size, count))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*done, strict=True)], ["path", "size", "records"]
            )

    return stored(
        rows.select("page", "url", "payload", "first").mapInArrow(
            write, "path string, size bigint, records bigint"
        ),
        "warc-archives",
    )


def reachable(records: DataFrame) -> DataFrame:
    """The rows of ``records`` (path, at, next, ...) that a reader who starts at the beginning of a
    file comes to.

    Pointer jumping: in round k every candidate knows its 2^k-th successor and the reached set
    doubles, so the rounds grow with the logarithm of the records in a file. All tables hold
    offsets only and are written to the shared folder in each round."""
    jumps = records.select("path", "at", F.col("next").alias("to"))
    known = records.select("path", "at")
    reached = known.where("at = 0")
    count = -1
    while True:
        reached = stored(reached, "warc-reached")
        now = reached.count()
        if now == count:
            break
        count = now
        onward = reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = reached.union(onward.join(known, ["path", "at"])).distinct()
        second = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("further"))
        jumps = stored(
            jumps.join(second, ["path", "to"]).select("path", "at", F.col("further").alias("to")),
            "warc-jumps",
        )
    return records.join(reached, ["path", "at"])


def read_archives(
    archives: DataFrame, split: int = SPLIT, payloads: bool = False
) -> DataFrame:
    """The records of archives (path, size), plain or gzip, one row each.

    Tasks read ``split`` bytes each and beyond them only to the end of their last record. What
    reads as a record is a candidate, and pointer jumping along the successors keeps those that
    the chain from the start of the file reaches. An archive that is damaged is read up to there.

    Columns: path, at, next, page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    and payload if asked for (null for revisits)."""
    splits = archives.where("size > 0").select(
        "path",
        "size",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("start"),
    )
    count = max(archives.sparkSession.sparkContext.defaultParallelism, splits.count())
    spread = splits.repartition(min(count, 100_000), "path", "start")

    def read(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                rows, held = [], 0
                for at, after, head, block in candidates(path, size, start, start + split):
                    http, _, body = block.partition(b"\r\n\r\n")
                    revisit = head.get("warc-type") == "revisit"
                    if revisit:
                        length = re.search(rb"(?i)content-length: *(\d+)", http)
                        n = int(length[1]) if length else None
                        digest = head.get("warc-payload-digest", "").rpartition(":")[2]
                    else:
                        n = len(body)
                        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    refers = head.get("x-refers-to-page-id", "")
                    page = head.get("x-page-id", "")
                    rows.append((
                        path, at, after, int(page) if page.isdigit() or page[1:].isdigit() else None,
                        head.get("warc-target-uri"), head.get("warc-type"), n, digest,
                        int(refers) if refers.lstrip("-").isdigit() else None,
                        body if payloads and not revisit else None,
                    ))
                    held += len(body) * payloads + 200
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    found = spread.mapInArrow(read, ", ".join(f"{name} {kind}" for name, kind, _ in _COLUMNS))
    if not payloads:
        found = stored(found.drop("payload"), "warc-candidates")
        return reachable(found)
    # Offsets alone go through the rounds; the payloads are read with their records.
    index = stored(found.select("path", "at", "next"), "warc-candidates")
    return found.join(reachable(index).select("path", "at"), ["path", "at"])


_COLUMNS = [
    ("path", "string", pa.string()), ("at", "bigint", pa.int64()), ("next", "bigint", pa.int64()),
    ("page_id", "bigint", pa.int64()), ("url", "string", pa.string()),
    ("record_type", "string", pa.string()), ("payload_bytes", "bigint", pa.int64()),
    ("payload_digest", "string", pa.string()), ("refers_to", "bigint", pa.int64()),
    ("payload", "binary", pa.binary()),
]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)],
        [name for name, _, _ in _COLUMNS],
    )


def archive_round(
    spark: SparkSession,
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    zipped: bool = True,
    split: int = SPLIT,
) -> DataFrame:
    """Writes the pages as archives to the shared folder and reads them back: one row per page.

    A null page has an empty payload, and empty payloads are equal too. Rows with the same id and
    payload are each a record of the same kind; a missing id counts as the largest and comes back
    as null. Other columns are ignored; an empty table gives no rows."""
    folder = shared_folder(spark, "warc")
    archives = write_archives(pages, folder, id_column, url_column, html_column, zipped)
    known = F.when(F.col("page_id") != NO_ID, F.col("page_id"))
    return read_archives(archives, split).select(
        known.alias(id_column),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        F.nullif("url", F.lit("")).alias("url"),
    )


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return archive_round(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


_DIGITS = ", ".join(
    f"('0x' || hex[{5 * i + 1}:{5 * i + 5}])::BIGINT" for i in range(8)
)
OP6_SQL = rf"""
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), records AS (
    SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((([{_DIGITS}])[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY payload) AS first
    FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM records
"""
