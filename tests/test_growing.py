"""Logs read while they grow: half lines, restarts, splits, odd files."""
import json
import random

import pytest

from turnwise.sources import growing, sessions
from turnwise.streaming import live


def drained(stream, out):
    """All lines so far, by a query that goes on from its checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(
        availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def plain(root):
    """(file, byte, line) of every whole line."""
    out = set()
    for path in root.glob("*/[!.]*.jsonl"):
        at = 0
        for line in path.read_bytes().split(b"\n")[:-1]:
            out.add((path.name, at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(line) + 1
    return out


def got(rows):
    found = [(r.file_path.rsplit("/", 1)[1], r.seq, r.value) for r in rows.collect()]
    assert len(found) == len(set(found))  # exactly once
    return set(found)


def test_half_lines_wait_and_restarts_go_on(spark, tmp_path):
    root, out = tmp_path / "logs", tmp_path / "out"
    (root / "p").mkdir(parents=True)
    one, two = root / "p" / "one.jsonl", root / "p" / "two.jsonl"
    read = lambda: got(drained(growing.stream_lines(spark, str(root), split=7), out))
    one.write_bytes(b'{"n":1}\n{"n":2}\r\n\n{"n":')
    (root / "p" / ".hidden.jsonl").write_text("no\n")
    (root / "p" / "other.txt").write_text("no\n")
    (root / "top.jsonl").write_text("no\n")
    assert read() == plain(root) == {("one.jsonl", 0, '{"n":1}'), ("one.jsonl", 8, '{"n":2}'), ("one.jsonl", 17, "")}
    with one.open("ab") as file:
        file.write("3, \"é\"".encode())
    two.write_bytes(b"")
    assert len(read()) == 3
    with one.open("ab") as file:
        file.write(b"}\n")
    two.write_bytes(b"\xff bad\n")
    assert read() == plain(root) and len(plain(root)) == 5
    assert len(read()) == 5


def test_a_shrunk_file_is_an_error(spark, tmp_path):
    root, out = tmp_path / "logs", tmp_path / "out"
    (root / "p").mkdir(parents=True)
    (root / "p" / "s.jsonl").write_text("a\nb\n")
    drained(growing.stream_lines(spark, str(root)), out)
    (root / "p" / "s.jsonl").write_text("a\n")
    with pytest.raises(Exception, match="shrank"):
        drained(growing.stream_lines(spark, str(root)), out)


@pytest.mark.parametrize("seed", range(5))
def test_splits_cover_every_line_once(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(growing, "BLOCK", 16)
    (tmp_path / "p").mkdir()
    path = tmp_path / "p" / "s.jsonl"
    path.write_bytes(b"".join(bytes(rng.choice(b"abc\r\n") for _ in range(rng.randint(0, 60))) + b"\n" for _ in range(40)) + b"rest")
    reader = growing.GrowingReader({"path": str(tmp_path), "split": str(rng.randint(1, 50))})
    end = reader.latestOffset()
    assert end == {str(path): path.stat().st_size - 4}
    for start in ({}, {str(path): path.read_bytes().index(b"\n", 100) + 1}):
        parts = reader.partitions(start, end)
        rows = [(s, v) for p in parts for b in reader.read(p) for s, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        assert rows == sorted((at, line) for _, at, line in plain(tmp_path) if at >= start.get(str(path), 0))
        assert len(parts) > 10


def test_the_driver_reads_only_the_end(tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    path = tmp_path / "p" / "s.jsonl"
    path.write_bytes(b"x" * 99 + b"\n")
    with path.open("ab") as file:
        file.truncate(1 << 30)
        file.seek(0, 2)
        file.write(b"\nlast\nhalf")
    reads = []
    real = growing.whole_lines

    class Counted:
        def __init__(self, file):
            self.file = file

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            reads.append(n)
            return self.file.read(n)

    monkeypatch.setattr(growing, "whole_lines", lambda file, first, size: real(Counted(file), first, size))
    reader = growing.GrowingReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    assert end == {str(path): (1 << 30) + 6} and sum(reads) <= growing.BLOCK
    assert len(reader.partitions({}, end)) == 17
    assert reader.latestOffset() == end and len(reads) == 1


def test_same_columns_as_the_batch_reader(spark, tmp_path):
    for project, session in (("pro ject+1", "abcdefgh-1"), ("q", "zz%41")):
        folder = tmp_path / "logs" / project
        folder.mkdir(parents=True)
        lines = [json.dumps({"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": f"say {i}"}}) for i in range(30)] + ["not json"]
        (folder / f"{session}.jsonl").write_text("\n".join(lines) + "\n")
    stream = growing.follow_sessions(spark, f"file:{tmp_path}/logs", split=200)
    kept = lambda df: sorted((r.project, r.session, r.value, r.bad) for r in df.select("project", "session", "value", "bad").collect())
    batch = sessions.read_sessions(spark, str(tmp_path / "logs"))
    assert stream.columns == batch.columns
    rows = live.drain(stream.drop("v"), "growing")
    assert kept(rows) == kept(batch)
    assert rows.select("session", "seq").distinct().count() == 62
    order = lambda df: [r.value for r in df.where("project = 'q'").orderBy("seq").collect()]
    assert order(rows) == order(batch)
