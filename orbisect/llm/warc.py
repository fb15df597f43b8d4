"""Operator 3: WARC archives with an index, and reads of byte ranges.

Each task writes one archive of gzip members, a member a record, and an index row (file, offset, length, url, digest)
for each. Readers take rows of the index, sort them by file and offset, merge neighbouring ranges into one read each,
and parse the records out of those bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, workspace, written

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Ranges that lie closer together than GAP are read at once, up to MOST bytes a read.
GAP, MOST = 64 << 10, 8 << 20
#: Bytes of archives that a task reads.
TASK_BYTES = 32 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, is_response: bool) -> bytes:
    """One record, not compressed. A revisit keeps the response's HTTP header, which says how long the payload is."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if is_response else http
    name = "" if page_id is None else page_id
    lines = [
        f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(2, "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if not is_response:
        lines += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The fields of RECORDS from one record; a response's length and digest are taken from its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines)}
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+)>", x)) else None
    known, kind = (number(fields[b"warc-record-id"]), fields.get(b"warc-target-uri")), fields[b"warc-type"]
    sha1 = fields[b"warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
        return (*known, kind, number(fields[b"warc-refers-to"]), size, sha1, None)
    if digest(payload) != sha1:
        raise ValueError(f"payload of {known[0]} doesn't have the digest {sha1}")
    return (*known, kind, None, len(payload), sha1, payload)


def rolled(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, refers_to, is_response: what write_archives() writes.

    Of pages whose payloads are equal and have min_bytes or more, that with the largest page_id is the response and the
    others revisit it. Pages that tie for it (a repeated page_id) are responses all; a null page_id is the smallest.
    Null html is an empty payload, more columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("size", F.octet_length("html"))
    # Only digests that several pages have are joined; the partial counts are merged before they move.
    several = rows.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("kept"))
    joined = rows.join(several.where("n > 1").select("sha1", "kept"), "sha1", "left")
    revisit = (F.col("size") >= min_bytes) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", "sha1", F.when(revisit, F.col("kept")).alias("refers_to"), (~revisit).alias("is_response"))


def write_archives(plan: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write a record for each row of planned() and return the index, a row for each record."""

    def write(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at = TaskContext.get(), None, 0
        # The attempt is in the name that the index carries, so no later attempt replaces a file that is in use.
        uri = f"{folder}/archive-{task.stageId()}-{task.partitionId():08d}-{task.taskAttemptId()}.warc.gz"
        fs, path = filesystem(uri)
        temp = f"{path}.part"
        for part in parts:
            rows = []
            for r in part.to_pylist():
                if out is None:
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(temp)
                sha1 = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                packer = zlib.compressobj(level, wbits=31)
                raw = record(r["page_id"], r["url"], r["html"].encode(), sha1, r["refers_to"], r["is_response"])
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                rows.append((r["page_id"], r["url"], sha1, "response" if r["is_response"] else "revisit", uri, at, len(member)))
                at += len(member)
            if rows:
                yield rolled(rows, INDEX)
        if out:
            out.close()
            fs.move(temp, path)

    return plan.mapInArrow(write, INDEX)


def ranges(spans: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) merged into reads: (begin, end, its spans)."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for at, n in spans:
        if reads and at - reads[-1][1] <= gap and at + n - reads[-1][0] <= most:
            begin, end, own = reads.pop()
            own.append((at, n))
            reads.append((begin, max(end, at + n), own))
        else:
            reads.append((at, at + n, [(at, n)]))
    return reads


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows (file, offset, length) of the index select.

    The rows are dealt by ranges of (file, offset), so that neighbours meet in a task and a large archive is read by
    several.
    """

    def read(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            files: dict[str, list[tuple[int, int]]] = {}
            for f, at, n in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                files.setdefault(f, []).append((at, n))
            for uri, spans in files.items():
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    for begin, end, own in ranges(sorted(spans)):
                        data = f.read_at(end - begin, begin)
                        rows = [parse(zlib.decompress(data[at - begin : at - begin + n], 31)) for at, n in own]
                        yield rolled(rows if payloads else [(*r[:-1], None) for r in rows], RECORDS)

    # As many tasks as the archives' bytes need, not the few that so small an index would get.
    total = index.agg(F.sum("length")).first()[0] or 0
    spans = index.select("file", "offset", "length").repartitionByRange(max(1, total // TASK_BYTES), "file", "offset")
    spans = spans.sortWithinPartitions("file", "offset")
    return spans.mapInArrow(read, RECORDS)


def archived(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write pages (page_id, url, html) as archives, their index as a table, and read every record back."""
    folder = folder or workspace(pages.sparkSession, "warc")
    index = written(write_archives(planned(pages, min_bytes), f"{folder}/archives"), folder, "index")
    return read_records(index, payloads)
