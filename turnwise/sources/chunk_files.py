"""Session chunks as text files that a manifest publishes.

``out/data-<id>/`` takes the files of one write, ``out/manifest.jsonl`` names those that count, in order, with their lines. Tasks write files
of their own; the commit writes the manifest beside its place and moves it there, after all tasks are done. Until then a reader
sees nothing, and files of tasks that failed, ran twice or were lost are never named. An aborted write removes its folder.
"""
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from turnwise.sources.growing import file_system

ROWS = "shelf string, chunk bigint, text string"
MANIFEST = "shelf string, chunk bigint, file string, first_line bigint, last_line bigint, bytes bigint"
NAME = "manifest.jsonl"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str | None, int, str, int, int]]  # shelf, chunk, file, lines, bytes


class ChunkWriter(DataSourceArrowWriter):
    """Rows come sorted by shelf, chunk and place; a task's run of rows of one chunk is one file."""

    def __init__(self, out: str, overwrite: bool):
        self.out, self.overwrite, self.folder = out, overwrite, f"data-{uuid.uuid4().hex}"
        system, root = file_system(out)
        if not overwrite and system.get_file_info(f"{root}/{NAME}").type != fs.FileType.NotFound:
            raise ValueError(f"{out} already holds chunks")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.out)
        context = TaskContext.get()
        task = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        files: list[tuple[str | None, int, str, int, int]] = []
        now, sink, lines, size = None, None, 0, 0

        def close() -> None:
            if sink is not None:
                sink.close()
                files.append((*now, name, lines, size))

        try:
            for batch in batches:
                for shelf, chunk, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (shelf, chunk) != now:
                        close()
                        now, lines, size = (shelf, chunk), 0, 0
                        if not files:
                            system.create_dir(f"{root}/{self.folder}")
                        name = f"{self.folder}/{task}-{len(files):06d}.txt"
                        sink = system.open_output_stream(f"{root}/{name}")
                    data = f"{text or ''}\n".encode("utf-8", "replace")
                    sink.write(data)
                    lines, size = lines + data.count(b"\n"), size + len(data)
            close()
        except BaseException:
            if sink is not None and not sink.closed:
                sink.close()
            raise
        return Written(context.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.out)
        found = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for f in m.files]
        upto: dict[str | None, int] = {}
        rows = []
        for shelf, chunk, name, lines, size in found:
            first = upto.get(shelf, 0) + 1
            upto[shelf] = first + lines - 1
            rows.append({"shelf": shelf, "chunk": chunk, "file": name, "first_line": first, "last_line": upto[shelf], "bytes": size})
        system.create_dir(f"{root}/{self.folder}")
        draft = f"{root}/{self.folder}/{NAME}"
        with system.open_output_stream(draft) as sink:
            sink.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        system.move(draft, f"{root}/{NAME}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.out)
        if system.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.folder}")


class ChunkFiles(DataSource):
    """``df.write.format("session_chunks").mode("append").save(out)``; columns shelf, chunk, text."""

    @classmethod
    def name(cls) -> str:
        return "session_chunks"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"], overwrite)


def publish_chunks(rows: DataFrame, chunks: DataFrame, out: str, keys: tuple[str, str] = ("project", "session"), order: tuple[str, ...] = ("seq",),
                   overwrite: bool = False) -> DataFrame:
    """Write ``rows`` (keys, order columns, text) into their chunks (keys, chunk) at once and return the manifest.

    Lines count along the first key, from 1, as in ``chunk_ranges``. A chunk may lie in several files, in the manifest's order. A null text is an
    empty line; rows whose session has no chunk are not written. ``out`` with a manifest is an error unless ``overwrite``, which replaces
    the manifest at once.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ChunkFiles)
    shelf, session = keys
    placed = rows.select(*keys, *order, "text").join(chunks.select(*keys, "chunk"), list(keys))
    sort = [shelf, "chunk", session, *order]
    sorted_rows = placed.repartitionByRange(*sort).sortWithinPartitions(*sort)
    cast = sorted_rows.select(F.col(shelf).cast("string").alias("shelf"), F.col("chunk").cast("bigint").alias("chunk"), F.col("text").cast("string").alias("text"))
    cast.write.format("session_chunks").mode("overwrite" if overwrite else "append").save(out)
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{out}/{NAME}")


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    """(shelf, chunk, line, value): every line of the published files under its number along the shelf."""
    manifest = read_manifest(spark, out).withColumn("_name", F.regexp_extract("file", "([^/]*)$", 1))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    names = F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1)
    lines = spark.read.option("lineSep", "\n").text(f"{out}/data-*").select(
        "value", names.alias("_name"), (F.col("_metadata.file_block_start") + place).alias("_at"))
    in_file = F.row_number().over(Window.partitionBy("_name").orderBy("_at"))
    return lines.join(manifest, "_name", "left_semi").withColumn("_line", in_file).join(manifest, "_name").select(
        "shelf", "chunk", (F.col("first_line") + F.col("_line") - 1).alias("line"), "value")
