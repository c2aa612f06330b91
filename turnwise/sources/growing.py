"""Logs that are still being written, read as a stream: ``root/<project>/<session>.jsonl``.

A micro-batch holds the whole lines that each file has gained; a line whose end is not written yet waits for the next one. Offsets are bytes
per file, so a restart goes on at the byte where the last batch ended, and ``seq`` of a line is the byte at which it starts. The driver lists
the files and reads back from their ends to the last line end, no more; lines are read by tasks, in splits of ``split`` bytes.
"""
import io
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from turnwise import lexicons as lx
from turnwise.sources.sessions import parsed_lines

SCHEMA = "file_path string, seq bigint, value string"
SPLIT = 64 << 20  # bytes of a file that one task reads
BLOCK = 1 << 20  # bytes read at once, and held before they are handed on


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a path or URI, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", root))


def whole_lines(file: pa.NativeFile, first: int, size: int) -> int:
    """The byte after the last line end in [first, size); ``first`` if there is none."""
    stop = size
    while stop > first:
        start = max(first, stop - BLOCK)
        file.seek(start)
        at = file.read(stop - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return first


def lines_from(file: pa.NativeFile, first: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """The lines that start in [start, stop), with the byte of their start; a line starts at ``first`` and ``stop`` is at most the end of whole lines."""
    at = start
    if start > first:
        at = start - 1
    file.seek(at)
    reader = io.BufferedReader(file, BLOCK)
    if start > first:
        at += len(reader.readline())
    while at < stop:
        line = reader.readline()
        yield at, line
        at += len(line)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix, self.split = options["path"], options.get("suffix", ".jsonl"), int(options.get("split", SPLIT))
        self.known: dict[str, tuple[int, int]] = {}  # size and end of whole lines when last seen

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        system, root = file_system(self.root)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            parts = info.path[len(root):].strip("/").split("/")
            if info.type != fs.FileType.File or len(parts) != 2 or not parts[1].endswith(self.suffix) or parts[1][0] in "._":
                continue
            size, end = self.known.get(info.path, (0, 0))
            if info.size < end:
                raise ValueError(f"{info.path} shrank from {end} to {info.size} bytes; logs only grow")
            if info.size > size:
                with system.open_input_file(info.path) as file:
                    end = whole_lines(file, end, info.size)
            found[info.path] = (info.size, end)
        self.known = found
        return {path: end for path, (_, end) in found.items() if end}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        out = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            if stop < first:
                raise ValueError(f"{path} shrank from {first} to {stop} bytes; logs only grow")
            out += [InputPartition((path, first, at, min(at + self.split, stop))) for at in range(first, stop, self.split)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, first, start, stop = partition.value
        name = quote(path)
        system, _ = file_system(self.root)
        with system.open_input_file(path) as file:
            held, size = [], 0
            for at, line in lines_from(file, first, start, stop):
                held.append((at, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
                size += len(line)
                if size >= BLOCK:
                    yield _batch(name, held)
                    held, size = [], 0
            if held:
                yield _batch(name, held)


def _batch(name: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
        ["file_path", "seq", "value"])


class GrowingLogs(DataSource):
    """``spark.readStream.format("growing_logs").load(root)``; options ``suffix`` (of the files) and ``split`` (bytes per task)."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def stream_lines(spark: SparkSession, root: str, **options: str | int) -> DataFrame:
    """(file_path, seq, value) of all whole lines under ``root``; a file that is deleted is forgotten, one that shrinks ends the stream with an error."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").options(**options).load(root)


def follow_sessions(spark: SparkSession, root: str, project: str = "", **options: str | int) -> DataFrame:
    """The growing logs as a stream with the columns of ``read_sessions``; ``seq`` is the byte at which a line starts.

    Lines end with LF or CR LF. An empty line is a bad one, as in the batch reader.
    """
    rows = stream_lines(spark, root, **options)
    folder = F.regexp_extract(F.url_decode(F.regexp_replace("file_path", r"\+", "%2B")), r"([^/]*)/[^/]*$", 1)
    return parsed_lines(rows.where(folder.contains(project) & ~F.col("file_path").contains(lx.PRIVATE)))
