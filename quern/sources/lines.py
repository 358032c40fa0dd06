"""Text lines as a data source of byte ranges and a sink that commits an ordered set of files.

Files are reached through ``pyarrow.fs`` (local folders and the stores that it knows, by URI). ``transactions.read_lines``
reads the same lines from whatever else Spark can open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range, lines of a batch, and bytes that are read at once.
RANGE, BATCH, CHUNK = 64 << 20, 4096, 1 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[ByteRange]:
        """Ranges of every file, from their sizes alone."""
        fs, path = _opened(self.path)
        own = fs.get_file_info(path)
        found = [own] if own.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and x.size and not x.base_name.startswith(("_", ".")))
        return [ByteRange(name, at, min(at + self.range, size)) for name, size in files for at in range(0, size, self.range)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range; the last one is read to its end, wherever that is."""
        if partition.end == 0:
            return
        held: list[str] = []
        place = 0
        for line in self._lines(partition):
            held.append(line.decode(errors="replace"))
            if len(held) == BATCH:
                yield self._batch(partition, place, held)
                place, held = place + len(held), []
        if held:
            yield self._batch(partition, place, held)

    @staticmethod
    def _batch(own: ByteRange, place: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([own.file] * n), pa.array([own.start] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array(lines, pa.string())], names=["file", "start", "place", "line"])

    def _lines(self, own: ByteRange) -> Iterator[bytes]:
        fs, _ = _opened(self.path)
        with fs.open_input_file(own.file) as file:
            at = max(own.start - 1, 0)  # a line begins at ``start`` if the byte before ends one
            file.seek(at)
            skip = own.start > 0
            rest, begin = b"", at  # bytes that are read but not handed on, and where they begin
            while data := file.read(CHUNK):
                *whole, rest = (rest + data).split(b"\n")
                for line in whole:
                    if skip:
                        skip = False
                    elif begin >= own.end:
                        return
                    else:
                        yield line
                    begin += len(line) + 1
                if not skip and begin >= own.end:
                    return
            if rest and not skip and begin < own.end:
                yield rest


class LineSource(DataSource):
    """``format("quern_lines")``: file, start (of the byte range), place (in the range) and line of text files.

    Reading takes ``path`` and ``rangeBytes``. Writing takes a column ``line`` and appends nothing: a folder is written as a whole.
    """

    @classmethod
    def name(cls) -> str:
        return "quern_lines"

    def schema(self) -> str:
        return "file string, start long, place long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LineSink(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    lines: int


class LineSink(DataSourceArrowWriter):
    """One file for each task, under a temporary name that readers pass over; files get their names, in the order of the
    partitions, when all tasks are done. What other attempts left is deleted then, so every line is there once."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _opened(self.path)
        fs.create_dir(path, recursive=True)
        number = TaskContext.get().partitionId()
        name, lines = f"{path}/_{number}-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(name) as out:
            for batch in iterator:
                for line in batch.column("line").to_pylist():
                    out.write((line or "").encode() + b"\n")
                    lines += 1
        return Written(number, name, lines)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _opened(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        mine = {m.file for m in done}
        for x in fs.get_file_info(pafs.FileSelector(path)):
            if x.path not in mine and x.type == pafs.FileType.File:
                fs.delete_file(x.path)
        names = []
        for k, m in enumerate(m for m in done if m.lines):
            names.append([f"part-{k:06d}.txt", m.lines])
            fs.move(m.file, f"{path}/{names[-1][0]}")
        for m in done:
            if not m.lines:
                fs.delete_file(m.file)
        with fs.open_output_stream(f"{path}/_MANIFEST.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _opened(self.path)
        for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if x.base_name.startswith("_") and x.type == pafs.FileType.File:
                fs.delete_file(x.path)


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """line_no (from 0, over all files by path, blank lines counted) and line, read in byte ranges."""
    spark.dataSource.register(LineSource)
    lines = spark.read.format("quern_lines").option("rangeBytes", range_bytes).load(path)
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("file", "start", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file", "start")) - F.col("n")).alias("before"))
    return lines.join(before, ["file", "start"]).select((F.col("before") + F.col("place")).alias("line_no"), "line")


def write_ordered(lines: DataFrame, path: str, order: str = "doc_idx") -> None:
    """Write the column ``line`` as text, in order across the files, all of them or none. The folder is replaced."""
    lines.sparkSession.dataSource.register(LineSource)
    lines.orderBy(order).select("line").write.format("quern_lines").mode("overwrite").save(path)
