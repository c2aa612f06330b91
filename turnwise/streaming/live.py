"""Streaming twins: corrections, mode verdicts, gate and usage as the events arrive."""
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.calls import OFF
from turnwise.functions.text import present, utf16_length
from turnwise.lineage import durable, new_folder
from turnwise.operators.ordered import carry, int_segment
from turnwise.operators.mining import command_started, is_rejected, skill_started
from turnwise.operators.policy import shift_verdict, with_need
from turnwise.operators.usage import burn_rate

WEEK = "7 days"


def correction_marks(events: DataFrame, shipped: Mapping[str, str], correction: str = lx.CORRECTION) -> DataFrame:
    """session, seq, started skill ('' for an unknown one) and corrections per event, without state."""
    is_user = (F.col("type") == "user") & command_started().isNull()
    said = (present("said") & ~F.col("said").startswith("<") & (utf16_length("said") <= lx.MAX_USER_CHARS)
            & (F.col("said").contains(lx.INTERRUPT) | F.col("said").rlike(correction)))
    refused = F.size(F.filter("results", lambda r: is_rejected(r["text"])))
    return events.select("session", "seq", skill_started(shipped).alias("skill"),
                         F.when(is_user, refused + said.cast("int")).otherwise(0).cast("bigint").alias("hits"))


def corrections_so_far(marks: DataFrame) -> DataFrame:
    """(session, skill, n): corrections while a skill was the last one started. ``marks``: session, seq, skill, hits."""
    rows = carry(marks, ["session"], ["seq"], int_segment("seq"), last={"active": F.col("skill")})
    return rows.where("active <> '' and hits > 0").groupBy("session", F.col("active").alias("skill")).agg(F.sum("hits").alias("n"))


def stream_corrections(marks: DataFrame, folder: str | None = None, ttl: str = WEEK) -> DataFrame:
    """Corrections of each (session, skill) after all marks that are there now.

    The same for any cut of the marks into files and any order of these. A session without marks for a
    week starts anew. ``folder`` keeps what was read between calls.
    """
    return follow(marks, corrections_so_far, "session", "corrections", folder, ttl)


def verdicts_so_far(actions: DataFrame) -> DataFrame:
    """(session, seq, agent, verdict, by) of every call of the ``actions`` there are: 'user', 'own' or 'above' says whose mode refuses it.

    The user's mode and the agent's own are carried along the session in segments, so a session of any length is spread over tasks.
    Calls that pass both climb the agents above them, one level a round, with the links and modes in force at the call. ``seq`` is unique
    within a session.
    """
    named = actions.withColumn("_key", F.coalesce(F.concat(F.lit("="), "agent"), F.lit("")))
    rank = lambda kind, scope=None: F.when((F.col("kind") == kind) & (F.lit(True) if scope is None else F.col("scope") == scope), F.col("rank"))
    user = carry(named, ["session"], ["seq"], int_segment("seq"), last={"_user": rank("mode")})
    calls = carry(user, ["session", "_key"], ["seq"], int_segment("seq"), last={"_own": rank("agent_mode", "self")}).where("kind = 'call'")
    by = F.when(F.col("rank") > F.coalesce("_user", F.lit(OFF)), "user").when(F.col("rank") > F.coalesce("_own", F.lit(OFF)), "own")
    judged = durable(calls.select("session", "seq", "agent", "rank", "_key", by.alias("by")))
    above = refused_above(judged.where("by is null").select("session", "seq", "rank", "_key"), named)
    out = judged.join(above.withColumn("_above", F.lit("above")), ["session", "seq"], "left").withColumn("by", F.coalesce("by", "_above"))
    return out.select("session", "seq", "agent", F.when(F.col("by").isNull(), "pass").otherwise("deny").alias("verdict"), "by")


def refused_above(calls: DataFrame, actions: DataFrame) -> DataFrame:
    """(session, seq) of the ``calls`` (session, seq, rank, _key) that the mode of an agent above theirs refuses.

    A round looks up the mode and the parent of the agent each call has reached, as of the call. A call ends at an agent without a
    parent, or at one it has met before.
    """
    key = F.coalesce(F.concat(F.lit("="), "parent"), F.lit(""))
    facts = actions.where("kind = 'spawn' or (kind = 'agent_mode' and scope = 'subagents')").select(
        "session", "seq", F.col("_key").alias("_at"), F.when(F.col("kind") == "spawn", key).alias("_up"),
        F.when(F.col("kind") == "agent_mode", F.col("rank")).alias("_subs"))
    facts = durable(facts)
    spawned = facts.where("_up is not null").select("session", "_at").distinct()
    going = calls.select("session", "seq", "rank", F.col("_key").alias("_at"), F.array("_key").alias("_seen"))
    going = durable(going.join(spawned, ["session", "_at"], "left_semi"))
    found = []
    while not going.isEmpty():
        marked = going.withColumn("_asked", F.lit(True)).unionByName(facts.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
        known = carry(marked, ["session", "_at"], ["seq"], int_segment("seq"), last={"_over": F.col("_up"), "_mode": F.col("_subs")}).where("_asked")
        refused = (F.size("_seen") > 1) & (F.col("rank") > F.coalesce("_mode", F.lit(OFF)))
        known = durable(known.select("session", "seq", "rank", F.col("_over").alias("_at"), "_seen", refused.alias("_refused")))
        found.append(known.where("_refused").select("session", "seq"))
        going = durable(known.where(~F.col("_refused") & F.col("_at").isNotNull() & ~F.array_contains("_seen", F.col("_at"))).select(
            "session", "seq", "rank", "_at", F.concat("_seen", F.array("_at")).alias("_seen")))
    out = calls.select("session", "seq").limit(0)
    for part in found:
        out = out.unionByName(part)
    return out


def stream_mode_verdicts(actions: DataFrame, folder: str | None = None, ttl: str = WEEK) -> DataFrame:
    """Verdict per call after all actions that are there now.

    ``actions``: session, seq, kind ('mode', 'agent_mode', 'spawn' or 'call'), agent, scope, parent
    and rank: the mode that is set, or the mode a call needs. The same for any cut of the actions into files
    and any order of these; a touched session is judged anew as a whole. A session without actions for a week starts anew.
    """
    named = actions.withColumn("session", F.coalesce(F.concat(F.lit("="), "session"), F.lit("")))  # a null session is one, too
    judged = follow(named, verdicts_so_far, "session", "verdicts", folder, ttl)
    return judged.withColumn("session", F.when(F.col("session") != "", F.expr("substring(session, 2)")))


def stream_needs(calls: DataFrame) -> DataFrame:
    """Calls of a stream with the mode they need; no state."""
    return with_need(calls)


def stream_gate(calls: DataFrame, **config) -> DataFrame:
    """Tracker calls of a stream that the gate does not let pass; no state."""
    return shift_verdict(calls, **config).where("verdict <> 'pass'")


def stream_burn_rate(samples: DataFrame, window: str = "five_hour", late: str = "10 minutes") -> DataFrame:
    """Burn rate per session and tumbling window, from the window's last sample.

    ``samples``: ts, session, used_pct, reset (epoch seconds). The clock is the sample's own time.
    """
    seconds, least, gap = lx.RATE_WINDOWS[window]
    last = samples.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "session").agg(
        F.max_by(F.struct("ts", "used_pct", "reset"), "ts").alias("s"))
    now = F.unix_seconds(F.col("s.ts"))
    return last.select("session", F.unix_seconds("w.start").alias("window_start"),
                       burn_rate(F.col("s.used_pct"), F.col("s.reset"), now, seconds, least, gap).alias("r")).select(
        "session", "window_start", "r.*")


def announce_once(counts: DataFrame) -> DataFrame:
    """First row of every (session, skill) of a stream."""
    return counts.dropDuplicates(["session", "skill"])


# --- running ------------------------------------------------------------------------------------
def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, glob: str | None = None) -> DataFrame:
    """A Parquet folder or glob as a stream, with the schema of what lies there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(glob or path)


def follow(stream: DataFrame, view: Callable[[DataFrame], DataFrame], key: str, name: str, folder: str | None = None, ttl: str = WEEK) -> DataFrame:
    """``view`` of all rows of a growing table, worked out anew for the keys that a micro-batch touches.

    Each micro-batch adds its rows to a table, then the view of its keys is computed from all of their rows, so
    late rows and any cut into batches give what one batch would. Nothing is held in Python, and a batch that is
    run again overwrites its own folders. Rows of a key from before a pause longer than ``ttl`` no longer count.
    """
    spark = stream.sparkSession
    out = folder or new_folder(spark, name)
    kept = f"{stream.schema.simpleString()[7:-1]},batch:bigint".replace(":", " ")

    def step(batch: DataFrame, number: int) -> None:
        part = f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{out}/rows/{part}")
        touched = spark.read.schema(stream.schema).parquet(f"{out}/rows/{part}").select(key).distinct()
        touched.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/keys/{part}")
        seen = spark.read.parquet(f"{out}/keys").join(touched, key, "left_semi")
        before = F.lag("at").over(Window.partitionBy(key).orderBy("batch"))
        starts = seen.withColumn("_new", F.col("at") - before > F.expr(f"interval {ttl}")).groupBy(key).agg(
            F.coalesce(F.max(F.when(F.col("_new"), F.col("batch"))), F.lit(0)).alias("_from"))
        rows = spark.read.schema(kept).parquet(f"{out}/rows").where(F.col("batch") <= number).join(starts, key)
        view(rows.where("batch >= _from").drop("batch", "_from")).write.mode("overwrite").parquet(f"{out}/view/{part}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{out}/keys").groupBy(key).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/view").join(last, [key, "batch"], "left_semi").drop("batch")


def drain(stream: DataFrame, name: str, idle_batches: bool = True) -> DataFrame:
    """Run a stream over all that is there now into Parquet in the shared folder, and read it back.

    ``idle_batches`` closes windows behind the watermark. A stream with processing-time timeouts
    asks for idle batches without end, so it is drained without them.
    """
    spark = stream.sparkSession
    out = new_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).outputMode(
        "append").trigger(availableNow=True)
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(setting)
    spark.conf.set(setting, str(idle_batches).lower())
    try:
        running = writer.start()
    finally:
        spark.conf.set(setting, was)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
