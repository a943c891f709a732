"""Sharded WARC archives, the same bytes at every run, and their reader.

Pages are dealt by ranges of their id and sorted, so archives follow each other in id order.  The borders of the ranges
come from the data alone: they are quantiles of ids sampled by their hash, as many as the payloads' bytes need;
neither the number of tasks nor a run's own sampling moves them, and a range's files are its own.  Of pages with
equal payloads of at least ``least`` bytes the one with the largest id is stored; the others are revisits of
it.  Who revisits whom is settled on narrow rows of id and hash, where a group that holds a third of all pages is not
gathered; the outcome travels to the writer as marker rows that sort right before their page, so payloads are
shuffled once, by id.

Pages without id come before all others, in ranges of their own, dealt by the hash of payload and url.  Such pages that
also agree in payload and url give one and the same record, so they travel as rows that say how many of them there are,
at most ``COPIES`` a row, and no task gets them all however many they are.

Each record is a gzip member with regenerated HTTP and WARC headers, block and payload digests, a fixed date
and a record id derived from page id and digest.  A task rolls to a new file once the compressed size reaches
``roll`` bytes and writes under names of its attempt; the driver renames what successful attempts report, so a task
that runs again never meets a name that is taken.  ``_MANIFEST.json`` names the files of the commit and is written
last; readers take no other file.

Defined cases: null html is an empty payload; null urls read ``about:blank``; very long pages are one record each;
pages without id sort first, can revisit a page with one and are never revisited; of rows that repeat id and payload
one is the response and the others revisit it; an empty table commits a manifest without files; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm._util import Scratch, commit, frugal, shared_dir, table, with_group

ROLL_BYTES, LEVEL = 64 << 20, 3
RANGE_BYTES, RANGES, SAMPLE = 16 << 20, 20_000, 200_000
COPIES = 256
DATE = "2000-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # gzip without a time
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member: the response, or a revisit of page ``refers_to`` with the same payload."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("WARC-X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-X-Refers-To-Page", str(refers_to))]
    return _member(headers, block)


def info_record(name: str) -> bytes:
    block = b"software: driftwell\r\nformat: WARC File Format 1.1\r\n"
    ident = f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"
    return _member(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", ident), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
        block,
    )


def members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The inflated gzip members of a stream; one that is cut short raises ValueError."""
    rest = b""
    while rest or (rest := stream.read(size)):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := stream.read(size)):
                raise ValueError("archive cut short")
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name and the block, whose length and digest are tested."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(headers["content-length"])
    block = rest[:size]
    if not first.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    said = headers.get("warc-block-digest")
    if said and said != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest")
    return headers, block


def page_of(record: bytes) -> tuple | None:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); None for records about the file."""
    headers, block = parse(record)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))[16:])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("payload digest")
    page, refers = headers.get("warc-x-page-id"), headers.get("warc-x-refers-to-page")
    return (page and int(page), size, digest, kind, refers and int(refers))


def dealt(pages: DataFrame, starts: list[int], nameless: int) -> DataFrame:
    """``(page_id, sha, url, html, copies, part)``; pages without id have the first ``nameless`` parts, ids follow by ``starts``."""
    plain = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(plain, 256).alias("sha"), F.coalesce("url", F.lit("about:blank")).alias("url"), plain.alias("html"))
    borders_of = np.array(starts, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(nameless + np.searchsorted(borders_of, ids.astype("int64"), "right"))

    named = rows.filter("page_id is not null").select("*", F.lit(1).cast("long").alias("copies"), range_of("page_id").alias("part"))
    if not nameless:
        return named
    alike = rows.filter("page_id is null").groupBy("sha", "url").agg(F.any_value("html").alias("html"), F.count("*").alias("n"))
    alike = alike.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    copies = F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("k") * COPIES)
    part = F.pmod(F.xxhash64("sha", "url", "k"), F.lit(nameless)).cast("int")
    return named.union(alike.select(F.lit(None).cast("long"), "sha", "url", "html", copies, part))


def with_markers(rows: DataFrame, least: int, tmp: Scratch) -> DataFrame:
    """``(page_id, sha, marks, url, html, copies, part)``: pages as ``dealt``, and before those that revisit another a row that says which."""
    large = tmp.keep(rows.filter(F.octet_length("html") >= least).select("page_id", "sha", "part"), "payloads")
    keepers = large.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null")
    twins = with_group(large, tmp.keep(keepers, "keepers"), "sha", "n", large.count()).filter("page_id is null or page_id < keeper").filter("keeper is not null")
    nothing = [F.lit(None).cast("string").alias(x) for x in ("url", "html")]
    marks = twins.select("page_id", "sha", "keeper", "part").distinct().select("page_id", "sha", F.col("keeper").alias("marks"), *nothing, F.lit(0).cast("long").alias("copies"), "part")
    return rows.select("page_id", "sha", F.lit(None).cast("long").alias("marks"), "url", "html", "copies", "part").union(marks)


def borders(pages: DataFrame, size: int) -> tuple[list[int], int]:
    """Ids that begin a new range and the number of ranges of pages without id, for ranges of about ``size`` bytes.

    At most ``RANGES`` of either, from at most ``SAMPLE`` sampled ids.
    """
    ids = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("id"))
    length, named = F.coalesce(F.octet_length("html"), F.lit(0)), F.col("page_id").isNotNull()
    rows, total, bare, bare_bytes = pages.agg(F.count("page_id"), F.sum(F.when(named, length)), F.count_if(~named), F.sum(F.when(~named, length))).first()
    nameless = min(RANGES, max(1, -(-bare_bytes // size))) if bare else 0
    parts = min(RANGES, -(-(total or 0) // size))
    if parts < 2:
        return [], nameless
    # About half of SAMPLE ids: of equal hashes all or none, which no run, task or machine changes.
    share = -(-2 * rows // SAMPLE)
    picked = ids.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).distinct().orderBy("id").limit(SAMPLE).collect()
    return sorted({picked[i * len(picked) // parts].id for i in range(1, parts)}) if picked else [], nameless


def write_archives(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> list[dict]:
    """Write ``pages(page_id, url, html)`` and commit; the manifest's rows (one for each file) in id order."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        rows, out, part, n, mark, last = [], None, None, 0, None, None

        def close() -> None:
            nonlocal out, n
            out.close()
            rows.append((part, n, temporary, name, count, size))
            out, n = None, n + 1

        for b in batches:
            for page_id, sha, marks, url, html, copies, at in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if at != part:
                    if out is not None:
                        close()
                    part, n = at, 0
                if html is None:
                    mark = (page_id, sha), marks
                    continue
                payload = html.encode()
                refers = mark[1] if mark and mark[0] == (page_id, sha) else None
                if refers is None and page_id is not None and last == (page_id, sha) and len(payload) >= least:
                    refers = page_id
                record = page_record(page_id, url, payload, refers)
                last = page_id, sha
                for _ in range(copies):
                    if out is None:
                        name = f"part-{part:06d}-{n:04d}.warc.gz"
                        temporary = f"_tmp-{part}-{n}-{task.taskAttemptId()}"
                        out, count = files.open_output_stream(f"{root}/{temporary}", compression=None), 0
                        size = out.write(info_record(name))
                    size += out.write(record)
                    count += 1
                    if size >= roll:
                        close()
        if out is not None:
            close()
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if i in (2, 3) else pa.int64()) for i, c in enumerate(cols)], ["part", "n", "temporary", "name", "records", "bytes"]
        )

    starts, nameless = borders(pages, range_bytes)
    rows = with_markers(dealt(pages, starts, nameless), least, Scratch())
    ranged = rows.repartitionById(nameless + len(starts) + 1, F.col("part")).sortWithinPartitions("part", "page_id", "sha", F.col("marks").desc_nulls_last(), "url")
    found = ranged.mapInArrow(run, "part long, n long, temporary string, name string, records long, bytes long").collect()  # a row a file
    found = sorted(found, key=lambda r: (r.part, r.n))
    manifest = [{"name": r.name, "records": r.records, "bytes": r.bytes} for r in found]
    commit(folder, {r.temporary: r.name for r in found}, manifest)
    return manifest


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The committed archives' pages, every digest tested; one task a file."""
    files, root = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/_MANIFEST.json") as f:
        manifest = json.loads(f.read())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows = [r for m in members(f) if (r := page_of(m))]
                if len(rows) != records:
                    raise ValueError(f"{name}: {len(rows)} records, {records} in the manifest")
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    rows = [(m["name"], m["records"]) for m in manifest if m["records"]]
    listed = spark.createDataFrame(rows, "name string, records long").repartition(max(1, len(rows)), "name")
    return listed.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder, least=0)
    return read_archives(spark, folder)
