"""WARC writer and reader: deterministic sharded archives.

Writing: equal payloads are found by digest (the row with the largest id carries the payload, the others revisit it). A
histogram of the payload bytes over the range of ids cuts it into shards; a stretch of ids that holds more (a frequent id,
or rows without one) is dealt out by digest. Every shard is sorted by id and written as gzip members into files that roll
at a compressed size. Shards follow from the rows alone, not from partitions or the session, and headers, dates, record
ids and digests from the row: a task that runs twice and a writer on another cluster write the same files. Files get
temporary names, are renamed when complete, and count only once the manifest names them; the manifest of the archive is
renamed into place last.

Files go through ``pyarrow.fs`` to the folder that driver and executors share.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import mapped, partition_keys, released, saved, shared_dir, skew_join, small, table

#: Compressed bytes at which a file is closed.
ROLL_BYTES = 64 << 20
#: Payload bytes of a shard, about, and of a record without them.
SHARD_BYTES, RECORD_BYTES = 64 << 20, 512
#: Stretches of ids in the histogram for every shard that the bytes would fill.
STRETCHES = 4
#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_BYTES = 0
#: Date of all records; the input has none, and the clock would make two runs differ.
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122
_MANIFEST = "file string, records long, bytes long, sha256 string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: object, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{payload_digest}')}>"


def _header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    return "".join(c if c > "\x20" and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """A response record, or, with ``refers_to``, a revisit record, which keeps the HTTP header but not the payload."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, own)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Page-ID", page_id),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, own)), ("WARC-Refers-To-Target-URI", _clean(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", refers_to)]
    return _header(fields, block)


def _member(data: bytes) -> bytes:
    """One gzip member; the header holds no time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """The files of some shards, one after the other: written under temporary names, renamed when complete."""

    def __init__(self, root: str, attempt: int, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.attempt, self.roll = attempt, roll_bytes
        self.done: list[tuple[str, int, int, str]] = []
        self.out = self.shard = None

    def write(self, shard: str, data: bytes) -> None:
        member = _member(data)
        if shard != self.shard:
            self.close()
            self.shard, self.files = shard, 0
        if self.out is None:
            self.name = f"part-{shard}-{self.files:05d}.warc.gz"
            self.files += 1
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}.tmp-{self.attempt}", compression=None)
            self.size = self.records = 0
            self.sha = hashlib.sha256()
            info = f"software: quern\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self._put(_member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(self.name, "info")), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{digest(info)}")], info)))
        self._put(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            # an earlier attempt of this task may have left the same file, and not every store renames over one
            if self.fs.get_file_info(f"{self.root}/{self.name}").type != pafs.FileType.NotFound:
                self.fs.delete_file(f"{self.root}/{self.name}")
            self.fs.move(f"{self.root}/{self.name}.tmp-{self.attempt}", f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def _shards(narrow: DataFrame) -> tuple[list[tuple[int, int, int]], Column]:
    """((stretch, shard, slots) of every stretch of ids that has rows, by stretch; the stretch of a row).

    Stretches are joined into shards of about ``SHARD_BYTES``; one that holds more is a shard of several slots. Rows without
    an id are in stretch -1.
    """
    weight = F.sum(F.col("n_bytes") + RECORD_BYTES)
    least, most, total = narrow.agg(F.min("page_id"), F.max("page_id"), weight).first()
    wanted = STRETCHES * -(-(total or 0) // SHARD_BYTES)
    width = 1 if least is None else -(-(most - least + 1) // max(1, wanted))
    # decimals: the range of ids may exceed a long
    number = F.floor((F.col("page_id").cast("decimal(20,0)") - F.lit(least or 0).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long")
    stretch = F.coalesce(number, F.lit(-1).cast("long"))
    out: list[tuple[int, int, int]] = []
    shard, held = -1, SHARD_BYTES
    for at, size in sorted(tuple(r) for r in narrow.groupBy(stretch.alias("stretch")).agg(weight).collect()):
        slots = -(-size // SHARD_BYTES)
        if slots > 1 or at == -1 or held + size > SHARD_BYTES:
            shard, held = shard + 1, 0
        out.append((at, shard, slots))
        held = SHARD_BYTES if slots > 1 or at == -1 else held + size
    return out, stretch


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write one record per row under the URI ``root`` and return the manifest: file, records, bytes, sha256.

    A null body is an empty payload. A row without an id is always a response. Of rows that repeat id and payload the
    first is the response (or revisits the larger id), the others revisit it. Other columns are ignored; an empty table
    makes a manifest without files. Equal rows are written by one task.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("body")).withColumn("sha", F.sha2("body", 256))
    narrow = saved(rows.select("page_id", "url", "sha", F.octet_length("body").alias("n_bytes")))
    own = saved(narrow.where(F.col("page_id").isNotNull() & (F.col("n_bytes") >= least_bytes)).select("page_id", "url", "sha"))
    top = own.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.max(F.struct("page_id", "url"))["url"].alias("refers_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = skew_join(own.select("page_id", "sha"), saved(top), "sha").distinct()
    # Directions to revisit travel in the same shuffle as the rows, ahead of the row that they are for.
    both = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), "sha", "refers_to", "refers_url", F.lit(0).alias("kind")).unionByName(
        rows.select("page_id", "url", "body", "sha", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"), F.lit(1).alias("kind"))
    )
    shards, stretch = _shards(narrow)
    firsts: dict[int, int] = {}
    parts = 0
    for _, shard, slots in shards:
        if shard not in firsts:
            firsts[shard] = parts
            parts += slots
    deal = partition_keys(spark, max(1, parts))
    dealt = [(at, shard, deal[firsts[shard] : firsts[shard] + slots]) for at, shard, slots in shards]
    slot = F.pmod(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"), F.size("dests")).cast("int")
    placed = both.withColumn("stretch", stretch).join(small(spark.createDataFrame(dealt, "stretch long, shard int, dests array<long>")), "stretch").withColumn("slot", slot)
    placed = placed.withColumn("dest", F.get("dests", F.col("slot"))).drop("stretch", "dests").repartition(max(1, parts), "dest").sortWithinPartitions("shard", "slot", "page_id", "kind", "sha", "url")
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files = _Files(root, context.taskAttemptId(), roll_bytes)
        current, told, seen = None, {}, set()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # few payloads at a time
                for r in batch.slice(start, 64).to_pylist():
                    if r["page_id"] != current:
                        current, told, seen = r["page_id"], {}, set()
                    if r["kind"] == 0:
                        told[r["sha"]] = (r["refers_to"], r["refers_url"])
                        continue
                    to, at = told.get(r["sha"], (None, None))
                    if to is not None and to == current and r["sha"] not in seen:
                        to = at = None
                        seen.add(r["sha"])
                    files.write(f"{r['shard']:06d}-{r['slot']:04d}", record(r["page_id"], r["url"], r["body"], to, at))
        files.close()
        released()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in files.done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "records", "bytes", "sha256"])

    files = sorted(tuple(r) for r in placed.mapInArrow(run, _MANIFEST).collect())
    with fs.open_output_stream(f"{path}/manifest.json.tmp", compression=None) as out:
        out.write(json.dumps([dict(zip(("file", "records", "bytes", "sha256"), x)) for x in files]).encode())
    fs.move(f"{path}/manifest.json.tmp", f"{path}/manifest.json")
    return spark.createDataFrame(files, _MANIFEST)


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each gzip member of a stream, one at a time."""
    data = stream.read(chunk)
    while data:
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("a gzip member is cut off")
            out.append(unpacker.decompress(data))
            data = unpacker.unused_data if unpacker.eof else b""
        yield b"".join(out)
        data = data or stream.read(chunk)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of a record; its block digest is checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if fields["warc-block-digest"] != f"sha1:{digest(block)}" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    return fields, block


def read(spark: SparkSession, root: str) -> DataFrame:
    """One row per record of the archive that the manifest under ``root`` names.

    page_id, url, payload (null for a revisit), payload_bytes and payload_digest (both of the full payload), record_type,
    refers_to. Payload digests of responses are checked.
    """
    fs, path = pafs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{path}/manifest.json", compression=None) as stream:
        names = [x["file"] for x in json.loads(stream.read())]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=columns)

    def make():
        own, top = pafs.FileSystem.from_uri(root)

        def step(batch: pa.RecordBatch):
            rows, held = [], 0
            for name in batch.column("file").to_pylist():
                with own.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        fields, block = parse(member)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        own_digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        first = fields["warc-type"] == "response"
                        if first and (len(payload) != size or digest(payload) != own_digest):
                            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                        page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append((page and int(page), fields["warc-target-uri"], payload if first else None, size, own_digest, fields["warc-type"], to and int(to)))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5_000:
                            yield batch_of(rows)
                            rows, held = [], 0
            if rows:
                yield batch_of(rows)

        return step

    files = spark.createDataFrame([(x,) for x in names], "file string").repartition(max(1, len(names))) if names else spark.createDataFrame([], "file string")
    return mapped(files, make, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), root)
    return read(spark, root).drop("url", "payload")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), t AS (
  SELECT body, max(page_id) AS top FROM p GROUP BY body
)
SELECT page_id, octet_length(body) AS payload_bytes,
  -- base32: five hexadecimal digits of the SHA-1 are four characters
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(body), 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id != top THEN top END AS refers_to
FROM p JOIN t USING (body)
"""
