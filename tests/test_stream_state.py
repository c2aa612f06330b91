"""Stream state: out-of-order rows, restarts, expiry, and how much a micro-batch writes."""
import os
import random
import time

from turnwise.streaming import live, state

MARKS = "session string, seq long, skill string, hits long"


def add(spark, src, rows):
    spark.createDataFrame(rows, MARKS).coalesce(1).write.mode("append").parquet(src)


def stream(spark, src):
    return spark.readStream.schema(MARKS).option("maxFilesPerTrigger", 1).parquet(src)


def test_out_of_order_rows_inside_the_lateness(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["s", "t", None]), i, rng.choice([None, None, "a", "b", ""]), rng.randint(0, 2)) for i in range(120)]
    want = {tuple(r) for r in live.corrections_so_far(spark.createDataFrame(rows, MARKS)).collect()}
    near = sorted(rows, key=lambda r: r[1] + rng.randint(0, 25))
    src = str(tmp_path / "src")
    for i in range(0, 120, 30):
        add(spark, src, near[i:i + 30] + near[:1])  # a row may come again
    assert {tuple(r) for r in state.follow_corrections(stream(spark, src), late=60).collect()} == want


def sizes(folder):
    return {d: sum(os.path.getsize(f"{folder}/{d}/{f}") for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")) for d in os.listdir(folder) if d.startswith("batch=")}


def held(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state")


def test_restart_lateness_and_small_writes(spark, tmp_path):
    """A run goes on from the state of the one before; rows too late are reported; a batch writes its own changes only; old rows leave the state."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    add(spark, src, [(f"s{i}", 1, "a", 0) for i in range(300)] + [(f"s{i}", 2, None, 1) for i in range(300)])
    assert state.follow_corrections(stream(spark, src), out, late=10).count() == 300
    add(spark, src, [("s1", 100, None, 2), ("s1", 1000, None, 1)])
    add(spark, src, [("s1", 50, "b", 5), ("s2", 3, "b", 0), ("s2", 4, None, 1)])
    got = {(r.session, r.skill): r.n for r in state.follow_corrections(stream(spark, src), out, late=10).collect()}
    assert got[("s1", "a")] == 4 and got[("s2", "a")] == 1 and got[("s2", "b")] == 1 and ("s1", "b") not in got and len(got) == 301
    changes = spark.read.parquet(f"{out}/changes").collect()
    assert sum(r.late for r in changes) == 1
    assert sum(r.first for r in changes) == 301  # every skill of a session is announced once
    assert [len([r for r in changes if r.batch == b]) for b in (0, 1, 2)] == [300, 1, 2]
    of_s1 = held(spark, out, "recent").where("key.session = '=s1'").selectExpr("user_map_key.seq as seq").collect()
    assert [r.seq for r in of_s1] == [1000]


def test_state_of_a_silent_session_goes(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    add(spark, src, [(f"s{i}", 1, "a", 1) for i in range(50)])
    state.follow_corrections(stream(spark, src), out, ttl_ms=1500)
    assert held(spark, out, "counts").count() == 50
    time.sleep(2)
    add(spark, src, [("new", 1, "a", 1)])
    state.follow_corrections(stream(spark, src), out, ttl_ms=600_000)
    add(spark, src, [("s3", 2, None, 1), ("s3", 3, "b", 0), ("s3", 4, None, 1)])
    got = {(r.session, r.skill): r.n for r in state.follow_corrections(stream(spark, src), out, ttl_ms=600_000).collect()}
    assert {r.session for r in held(spark, out, "counts").selectExpr("key.session as session").collect()} == {"=new", "=s3"}
    assert got[("s3", "b")] == 1 and got[("s3", "a")] == 1 and len(got) == 52  # s3 began anew: its first row after the pause has no skill
