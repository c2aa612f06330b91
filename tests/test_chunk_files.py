"""Chunks published by a manifest: agreement, order, failed and aborted writes."""
import json
import os

import pytest
from pyspark.sql import functions as F

from turnwise.operators import chunks
from turnwise.sources import chunk_files

ROWS = "project string, session string, seq long, text string"


def sample(spark):
    rows = [(p, f"s{s:02d}", i, f"{p} {s} {i}" + "\nmore é" * (i % 3)) for p in ("a b", "c") for s in range(20) for i in range(1 + s % 4)]
    df = spark.createDataFrame(rows, ROWS).repartition(5, "seq")
    sizes = df.groupBy("project", "session").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))
    return rows, df, chunks.chunk_assign(sizes, 15)


def published(out):
    """(shelf, chunk, text) of the manifest's files, joined in its order."""
    text = {}
    for line in open(f"{out}/manifest.jsonl"):
        m = json.loads(line)
        data = open(f"{out}/{m['file']}", "rb").read()
        assert len(data) == m["bytes"] and data.count(b"\n") == m["last_line"] - m["first_line"] + 1
        text[(m["shelf"], m["chunk"])] = text.get((m["shelf"], m["chunk"]), "") + data.decode()
    return text


def test_manifest_and_files_agree(spark, tmp_path):
    out = str(tmp_path / "out")
    rows, df, cut = sample(spark)
    got = chunk_files.publish_chunks(df, cut, out)
    ranges = {(r.project, r.chunk): (r.first_line, r.last_line) for r in chunks.chunk_ranges(cut).collect()}
    by = got.groupBy("shelf", "chunk").agg(F.min("first_line").alias("a"), F.max("last_line").alias("b")).collect()
    assert {(r.shelf, r.chunk): (r.a, r.b) for r in by} == ranges and len(ranges) > 6
    of = {(r.project, r.session): r.chunk for r in cut.collect()}
    want = {}
    for p, s, _, text in sorted(rows):
        want[(p, of[(p, s)])] = want.get((p, of[(p, s)]), "") + text + "\n"
    assert published(out) == want
    lines = sorted((r.shelf, r.line, r.chunk, r.value) for r in chunk_files.read_chunks(spark, out).collect())
    flat = [(p, c, line) for (p, c), text in sorted(want.items()) for line in text[:-1].split("\n")]
    assert [(p, c, v) for p, _, c, v in lines] == flat
    with pytest.raises(Exception, match="already holds chunks"):
        chunk_files.publish_chunks(df, cut, out)
    assert published(out) == want
    chunk_files.publish_chunks(df.where("project = 'c'"), cut, out, overwrite=True)
    assert published(out) == {k: v for k, v in want.items() if k[0] == "c"}
    assert {r.shelf for r in chunk_files.read_chunks(spark, out).collect()} == {"c"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    _, df, cut = sample(spark)
    fail = F.when((F.col("session") == "s19") & (F.col("seq") == 3), F.raise_error(F.lit("lost"))).otherwise(F.col("text"))
    held = cut.persist()
    held.count()
    with pytest.raises(Exception):
        chunk_files.publish_chunks(df.withColumn("text", fail), held, out)
    assert not os.path.exists(f"{out}/manifest.jsonl")
    assert not os.path.exists(out) or not [f for f in os.listdir(out) if f.startswith("data-")]
    chunk_files.publish_chunks(df, held, out)
    assert len(published(out)) > 6


def test_files_of_lost_tasks_do_not_count(spark, tmp_path):
    out = str(tmp_path / "out")
    _, df, cut = sample(spark)
    chunk_files.publish_chunks(df, cut, out)
    before = chunk_files.read_chunks(spark, out).count()
    folder = next(f for f in os.listdir(out) if f.startswith("data-"))
    (tmp_path / "out" / folder / "000000-999-000000.txt").write_text("half a chu")
    assert chunk_files.read_chunks(spark, out).count() == before


def test_no_rows_and_null_texts(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    cut = spark.createDataFrame([("a", "s", 0)], "project string, session string, chunk long")
    assert chunk_files.publish_chunks(none, cut, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("a", "s", 1, None), ("a", "s", 2, "x"), ("a", "t", 1, "no chunk"), (None, "s", 1, "no shelf")], ROWS)
    got = chunk_files.publish_chunks(rows, cut, str(tmp_path / "nulls"))
    assert sum(r.last_line - r.first_line + 1 for r in got.collect()) == 2
    assert "".join(published(str(tmp_path / "nulls")).values()) == "\nx\n"
