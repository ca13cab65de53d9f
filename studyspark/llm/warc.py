"""WARC archives written by Spark's text writer and read back by boundary chains.

Writing: a record is one string; the writer's line separator is the CRLF CRLF that
ends a record, so archives come out of Spark's own commit protocol on any store.
Files roll by number of records, which is the smaller the larger the records are: rows
are written by classes of size, so that a file holds about ``file_bytes`` or one record,
whichever is more (a record and its archive stay below the two gigabytes of one value).
Equal payloads
(by SHA-1 of the full payload) are written once, as the response with the smallest
page id; the others become revisit records that refer to it.

Reading: tasks scan an archive's bytes for every place where the magic stands, in
headers and inside payloads alike, and emit for each candidate the offset of the
successor that its header implies, with the fields of the record.  Pointer jumping
from offset 0 of each file then doubles the reached part of the chain in every
round; a candidate that no chain reaches is magic inside a payload and falls out.
The payload itself never leaves the scanning task: digest and length travel.  Reading
fails when an archive does not begin with a record, when a chain ends before its file
does, or when a reached record's payload differs from its header's length or digest.

Edge cases: a null html is an empty payload; payloads of at least ``min_payload``
bytes take part in revisits, smaller ones are all responses; repeated rows (same
page id and payload) stay one record each, the smallest id among equals is the
response and its repetitions are responses too; rows with a null page id are written
as responses with an id of "null" and come back null; an empty table gives an empty
archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, in_arrow, make_folder, new_path, removed, written

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SCHEMA = "file string, at bigint, next bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, sound boolean"

#: Classes of payload sizes: each is four times the one before.
SMALLEST, STEP, LARGEST = 1 << 14, 4, 1 << 30


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: bytes, payload: bytes, refers_to: int | None, date: bytes) -> bytes:
    """One record without the CRLF CRLF that ends it."""
    block = HTTP + (payload if refers_to is None else b"")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%b>" % (b"null" if page is None else b"%d" % page),
        b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url),
        b"WARC-Date: " + date,
        b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode(),
        b"X-Payload-Length: %d" % len(payload),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return b"\r\n".join(head) + b"\r\n\r\n" + block


def candidates(data: bytes) -> list[tuple]:
    """(at, next, page, payload bytes, digest, type, refers, sound) of every place with the magic.

    ``next`` is -1 where the header or the length does not hold up inside the file."""
    out, at = [], data.find(MAGIC)
    while at >= 0:
        row = (at, -1, None, None, None, None, None, False)
        stop = data.find(b"\r\n\r\n", at)
        if stop >= 0:
            fields = {}
            for line in data[at + len(MAGIC) : stop].split(b"\r\n"):
                k, _, v = line.partition(b":")
                fields.setdefault(k.strip().lower(), v.strip())
            size = fields.get(b"content-length", b"")
            begin = stop + 4
            if size.isdigit() and data[(end := begin + int(size)) : end + 4] == b"\r\n\r\n":
                number = lambda k: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(k, b""))) else None
                kind = fields.get(b"warc-type", b"").decode(errors="replace")
                digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode(errors="replace")
                length = fields.get(b"x-payload-length", b"")
                sound = length.isdigit()
                if kind == "response":
                    payload = data[data.find(b"\r\n\r\n", begin, end) + 4 : end]
                    sound = sound and len(payload) == int(length) and base32_sha1(payload) == digest
                row = (at, end + 4, number(b"warc-record-id"), int(length) if length.isdigit() else None, digest, kind, number(b"warc-refers-to"), sound)
        out.append(row)
        at = data.find(MAGIC, at + 1)
    return out


def reached(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches: pointer jumping over sorted offsets.

    The last step of a whole file leads past its end, to no candidate."""
    n = len(at)
    jump = np.searchsorted(at, following)
    jump[(jump >= n) | (at[np.minimum(jump, n - 1)] != following)] = n
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and at[0] == 0
    steps = 1
    while steps <= n:
        seen[jump[np.flatnonzero(seen)]] = True  # all within 2 * steps of the start are known now
        jump = jump[jump]
        steps *= 2
    return seen[:n]


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, file_bytes: int = 1 << 26, date: str = "2024-01-01T00:00:00Z", broadcast_rows: int = 200_000) -> None:
    """Write one record for each row to text files under ``path``, one folder for each class of size."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    marks = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n"))
    known = marks.where(f"page_id is not null and n >= {int(min_payload)}")
    # written, so that both sides of the join are plain shuffles: a payload of very many pages can be split
    shared = written(known.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last"), "payloads")
    later = written(known.join(shared, "sha").where("page_id > first").select("page_id", "sha", "first").distinct(), "revisits")
    keys = later.withColumnsRenamed({"page_id": "later_id", "sha": "later_sha"})
    if later.limit(broadcast_rows + 1).count() <= broadcast_rows:  # proven small, else a shuffle join
        keys = F.broadcast(keys)
    dealt = rows.join(keys, (F.col("page_id") == F.col("later_id")) & (F.sha1(F.col("html").cast("binary")) == F.col("later_sha")), "left").select("page_id", "url", "html", "first")

    def run(batches):
        for b in batches:
            cols = b.column(0).to_pylist(), as_bytes(b.column(1)), as_bytes(b.column(2)), b.column(3).to_pylist()
            made = [record(p, u, h, r, date.encode()) for p, u, h, r in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()).cast(pa.string())], names=["value"])

    # the url counts as well: a record is its payload and a head
    size = F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0))
    top, tiers = SMALLEST, []
    while top < LARGEST:
        tiers.append(top)
        top *= STEP
    own = F.coalesce(*(F.when(size <= t, n) for n, t in enumerate(tiers)), F.lit(len(tiers))).alias("tier")
    make_folder(pages.sparkSession, path)  # there, even if empty
    for r in sorted(rows.select(own).distinct().collect()):  # one row for each class of size
        here = dealt.where(own == r.tier)
        per_file = max(1, file_bytes // tiers[r.tier]) if r.tier < len(tiers) else 1
        in_arrow(here, run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(f"{path}/size-{r.tier}")
    removed(shared, later)


class BrokenArchive(ValueError):
    """An archive is cut off, or a record does not hold what its header says."""


def checked(name: str, data: bytes) -> list[tuple]:
    """The candidates of a whole archive, which begins with a record and ends behind one."""
    found = candidates(data)
    if data and not data.startswith(MAGIC):
        raise BrokenArchive(f"{name} does not begin with a record")
    if data and not any(c[1] == len(data) for c in found):
        raise BrokenArchive(f"{name} does not end behind a record")
    return found


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The reachable records of all archives under ``path``: file, at, and the fields of each record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def scan(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = checked(name, data.as_py())
                cols = list(zip(*found, strict=True)) if found else [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                arrays = [pa.array([name] * len(found), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "at", "next", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"])

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        end = max(t.column("next").to_pylist())  # the end of the file: some candidate ends there, none behind it
        t = t.filter(pa.array(reached(t.column("at").to_numpy(), t.column("next").to_numpy())))
        if t.column("next").to_pylist()[-1] != end:
            raise BrokenArchive(f"the chain of {t.column('file')[0]} ends before the file does")
        if not all(t.column("sound").to_pylist()):
            raise BrokenArchive(f"a record of {t.column('file')[0]} does not hold what its header says")
        return t

    return files.mapInArrow(scan, _SCHEMA).groupBy("file").applyInArrow(chain, _SCHEMA)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write all rows to archives in the shared folder, read them back: one row for each record."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
