"""WARC archives: written as one gzip stream a file, normalised to a member a record, read by offset."""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.operators.skew import hot_counts, salted_join
from spikeloom.session import checkpoint

MIN_BYTES = 1000
FILE_BYTES = 32 << 20
STEP = 1 << 18
TASKS = 1 << 14
DATE = "2024-01-01T00:00:00Z"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if top is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def record(kind: str, page: int | None, url: str | None, body: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, only the response's head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (body if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        # Header lines hold no line breaks: they are kept percent-encoded.
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Records:
    """Splits a stream of bytes, fed in any portions, into whole WARC records."""

    def __init__(self) -> None:
        self.held, self.need = bytearray(), -1

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while True:
            if self.need < 0:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                head = bytes(self.held[:end]).split(b"\r\n")
                if not head[0].startswith(b"WARC/"):
                    raise ValueError("not the start of a WARC record")
                self.need = end + 4 + int(next(x for x in head if x.lower().startswith(b"content-length:")).split(b":", 1)[1]) + 4
            if len(self.held) < self.need:
                return
            yield bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = -1

    def close(self) -> None:
        if self.held:
            raise ValueError("the archive ends within a record")


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, ``STEP`` at a time."""
    tool, any_ = zlib.decompressobj(31), False
    while data := source.read(STEP):
        any_ = True
        while data:
            out = tool.decompress(data, 1 << 22)
            if out:
                yield out
            if tool.eof:
                data, tool = tool.unused_data, zlib.decompressobj(31)
                any_ = bool(data)
            else:
                data = tool.unconsumed_tail
    if any_ and not tool.eof:
        raise ValueError("the gzip stream is cut off")


def normalise(fs: pafs.FileSystem, source: str, target: str) -> int:
    """Rewrite an archive with every record as a gzip member of its own, and its sidecar offset index.

    The whole-file stream is inflated once; memory holds one record.  Files appear under their names
    only when complete, so a task that is run again after a lost executor leaves the same files.
    """
    mine = f"{target}.{uuid.uuid4().hex}"
    split, at, n = Records(), 0, 0
    with fs.open_input_stream(source) as raw, fs.open_output_stream(mine) as out, fs.open_output_stream(mine + ".idx") as index:
        for data in inflated(raw):
            for one in split.feed(data):
                tool = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = tool.compress(one) + tool.flush()
                out.write(member)
                index.write(json.dumps({"offset": at, "length": len(member)}).encode() + b"\n")
                at, n = at + len(member), n + 1
        split.close()
    fs.move(mine + ".idx", target + ".idx")
    fs.move(mine, target)
    return n


def parsed(one: bytes) -> dict:
    """Headers and payload of one record."""
    head, block = one.split(b"\r\n\r\n", 1)
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
    body = block[: int(fields["content-length"])].split(b"\r\n\r\n", 1)[1]
    page = lambda s: int(t) if s and (t := s[len("<urn:page:") : -1]) else None
    return {
        "page": page(fields["warc-record-id"]), "kind": fields["warc-type"], "refers": page(fields.get("warc-refers-to")), "size": int(fields["x-payload-length"]),
        "digest": fields["warc-payload-digest"].removeprefix("sha1:"), "body": body, "url": fields.get("warc-target-uri"),
    }


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id with the same payload of MIN_BYTES or more.

    Digests are reduced to their largest page_id map-side; only payloads that occur twice come back,
    by page_id, so the html is shuffled once and no group of copies meets in one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    small = rows.where(F.octet_length("html") >= MIN_BYTES).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"))
    most = small.groupBy("digest").agg(F.max("page_id").alias("most"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & F.col("most").isNotNull())
    back = salted_join(small, most.select("digest", "most"), ["digest"], F.col("page_id"), hot=hot_counts(most.select("digest", "_n"), ["digest"]))
    back = back.select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("_id"), "digest", "most").distinct()
    mine = rows.withColumn("_id", F.coalesce("page_id", F.lit(-(1 << 63))))
    # One page_id may come with several payloads: the digest decides which of its rows is meant.
    per = back.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "most"))).alias("by"))
    own = mine.join(per, "_id", "left")
    refers = F.when(F.col("by").isNotNull() & (F.octet_length("html") >= MIN_BYTES), F.col("by")[F.sha1(F.encode("html", "UTF-8"))])
    return own.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (refers != F.col("page_id")), refers).alias("refers_to"))


def written(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records as monolithic gzip archives, about ``file_bytes`` of records each; returns (path, n)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        tool = out = None
        size = n = 0
        path = ""
        done: list[tuple[str, int]] = []

        def close() -> None:
            out.write(tool.flush())
            out.close()
            done.append((path, n))

        for b in batches:
            for page, url, html, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                body = html.as_py().encode()
                kind = "response" if refers.as_py() is None else "revisit"
                one = record(kind, page.as_py(), url.as_py(), body, hashlib.sha1(body).hexdigest(), len(body), refers.as_py())
                if out is None:
                    path = f"{top}/{uuid.uuid4().hex}.warc.gz"
                    out, tool, size, n = fs.open_output_stream(path), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                out.write(tool.compress(one))
                size, n = size + len(one), n + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "n"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(task, "path string, n long")


def spread(archives: DataFrame) -> DataFrame:
    """An archive a task: their rows hold only paths, so their number, not their bytes, must say how many tasks there are."""
    return archives.repartition(min(max(1, archives.count()), TASKS), "path")


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive of ``archives(path)``; returns (path, n) of the new ones, each with a sidecar index."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs, _ = opened(folder)
            to = [p.as_py().removesuffix(".warc.gz") + ".members.warc.gz" for p in b.column("path")]
            n = [normalise(fs, p.as_py(), t) for p, t in zip(b.column("path"), to)]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.string()), pa.array(n, pa.int64())], ["path", "n"])

    return spread(archives).mapInArrow(task, "path string, n long")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of ``archives(path)``, read member by member at the offsets of its sidecar index."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body_digest"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                with fs.open_input_stream(path + ".idx") as index, fs.open_input_file(path) as data:
                    made = []
                    for line in io.BytesIO(index.read()):
                        at = json.loads(line)
                        data.seek(at["offset"])
                        r = parsed(zlib.decompress(data.read(at["length"]), 31))
                        own = hashlib.sha1(r["body"]).hexdigest() if r["kind"] == "response" else None
                        made.append((r["page"], r["url"], r["size"], r["digest"], r["kind"], r["refers"], own))
                        if len(made) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], names)
                            made = []
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], names)

    return spread(archives).mapInArrow(task, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body_digest string")


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)``, normalise the archives and read them back, one row a record.

    Null html is an empty payload; null page_ids are never a response that others refer to, and rows
    that share the largest page_id of their payload are all responses.  Empty table: no rows.
    """
    first = checkpoint(written(decided(pages), folder))
    second = checkpoint(normalised(first.select("path"), folder))
    return read(second.select("path"), folder)
