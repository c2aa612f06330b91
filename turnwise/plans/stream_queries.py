"""Streaming queries: the events table is read as a stream and drained to a table."""
from pyspark.sql import functions as F

from turnwise.lineage import new_folder
from turnwise.plans.log_queries import SPAN
from turnwise.plans.registry import query, table
from turnwise.sources import growing
from turnwise.streaming import live, state


def event_stream(spark, sf_dir):
    ev = live.table_stream(spark, f"{sf_dir}/events.parquet", glob=f"{sf_dir}/event[s].parquet")
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
                     F.get_json_object("props", "$.k").cast("int").alias("k"))


CORRECTIONS = """
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
s AS (SELECT *, LAST_VALUE(CASE WHEN event_type = 'view' THEN k % 10 END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM e)
SELECT CAST(user_id AS VARCHAR) AS session, CAST(active AS VARCHAR) AS skill, COUNT(*) AS n FROM s
WHERE event_type = 'error' AND active IS NOT NULL GROUP BY 1, 2"""


def correction_marks(spark, sf_dir):
    is_view = F.col("event_type") == "view"
    return event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"),
        F.when(is_view, (F.col("k") % 10).cast("string")).alias("skill"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("bigint").alias("hits"))


@query(CORRECTIONS)
def stream_corrections(spark, sf_dir):
    """Errors per user and open view, each pair announced once."""
    return live.stream_corrections(correction_marks(spark, sf_dir)).select("session", "skill", "n")


@query(CORRECTIONS)
def session_corrections(spark, sf_dir):
    """The same counts, kept in a state store per session."""
    return state.follow_corrections(correction_marks(spark, sf_dir), late=10_000).select("session", "skill", "n")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
s AS (SELECT *, COALESCE(LAST_VALUE(CASE WHEN event_type = 'signup' THEN k % 5 END IGNORE NULLS) OVER w, 4) AS um,
  COALESCE(LAST_VALUE(CASE WHEN event_type = 'purchase' THEN (k * 3) % 5 END IGNORE NULLS) OVER w, 4) AS own FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, CASE WHEN k % 4 > um OR k % 4 > own THEN 'deny' ELSE 'pass' END AS verdict,
  CASE WHEN k % 4 > um THEN 'user' WHEN k % 4 > own THEN 'own' END AS by FROM s WHERE event_type IN ('view', 'click', 'error')""")
def stream_mode_verdicts(spark, sf_dir):
    """Calls against modes that signups and purchases set."""
    t, k = F.col("event_type"), F.col("k")
    actions = event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"),
        F.when(t == "signup", "mode").when(t == "purchase", "agent_mode").otherwise("call").alias("kind"),
        F.lit("main").alias("agent"), F.lit("self").alias("scope"), F.lit("").alias("parent"),
        F.when(t == "signup", k % 5).when(t == "purchase", (k * 3) % 5).otherwise(k % 4).cast("int").alias("rank"))
    return live.stream_mode_verdicts(actions).select("session", "seq", "verdict", "by")


@query("""
SELECT event_id, 'deny' AS verdict FROM events WHERE event_type = 'error' AND NOT hour(ts) BETWEEN 9 AND 17
UNION ALL SELECT event_id, 'ask' FROM events WHERE event_type = 'error' AND hour(ts) BETWEEN 9 AND 17 AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0""")
def stream_gate(spark, sf_dir):
    """Tracker writes of the stream that are refused or asked about."""
    calls = event_stream(spark, sf_dir).select(
        "event_id", "ts", F.when(F.col("event_type") == "error", "mcp__linear-server__save_issue").otherwise("Read").alias("tool"),
        F.when(F.col("k") % 10 == 0, "Canceled").otherwise("Done").alias("state"), F.lit(True).alias("has_surface"))
    return live.drain(live.stream_gate(calls).select("event_id", "verdict"), "gate")


@query(SPAN + """SELECT DISTINCT CAST(user_id AS VARCHAR) AS session, event_type AS skill FROM s""")
def stream_announce(spark, sf_dir):
    """Every kind of event of a user once."""
    marks = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("skill"))
    return live.drain(live.announce_once(marks), "announce")


@query("""
WITH e AS (SELECT epoch(ts)::BIGINT AS t, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS session, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
l AS (SELECT session, us // 18000000000 * 18000 AS start, arg_max(us // 1000000, us) AS now, arg_max(k, us) AS u FROM e GROUP BY 1, 2),
c AS (SELECT * FROM l WHERE start + 18000 <= (SELECT MAX(us) FROM e) / 1000000.0 - 600),
x AS (SELECT *, start + 18000 AS fin, now - start AS el, CASE WHEN u > 0 THEN start + (now - start) * 100 // u END AS out_at FROM c),
y AS (SELECT *, u > 0 AND u < 100 AND el >= 1800 AS paced FROM x)
SELECT session, start AS window_start, CAST(u AS BIGINT) AS used,
  CASE WHEN u >= 100 THEN 'red' WHEN paced AND out_at < fin AND (fin - out_at >= 1800 OR u >= 90) THEN 'red' WHEN paced AND out_at < fin THEN 'yellow' ELSE 'calm' END AS state,
  CASE WHEN paced AND out_at < fin THEN out_at END AS run_out FROM y""")
def stream_burn_rate(spark, sf_dir):
    """Burn rate per user in closed five-hour windows."""
    samples = event_stream(spark, sf_dir).select(
        "ts", F.col("user_id").cast("string").alias("session"), F.col("k").cast("double").alias("used_pct"),
        (F.floor(F.unix_seconds("ts") / 18_000) * 18_000 + 18_000).alias("reset"))
    return live.drain(live.stream_burn_rate(samples), "burn").select("session", "window_start", "used", "state", "run_out")


@query("""
WITH l AS (SELECT event_id // 10000 AS part, event_id AS n, CAST(user_id AS VARCHAR) AS session, event_type AS kind,
  strlen('{"session":"' || user_id || '","n":' || event_id || ',"kind":"' || event_type || '"}') + 1 AS size FROM events)
SELECT part, CAST(SUM(size) OVER (PARTITION BY part ORDER BY n) - size AS BIGINT) AS seq, n, session, kind FROM l""")
def stream_growing_sessions(spark, sf_dir):
    """Events written as log files of 10,000 lines, read as growing logs: every line with the byte at which it starts."""
    root = new_folder(spark, "logs")
    line = F.concat(F.lit('{"session":"'), F.col("user_id").cast("string"), F.lit('","n":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), "event_type", F.lit('"}'))
    lines = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10_000).alias("part"), "event_id", line.alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(root)
    rows = growing.stream_lines(spark, root, suffix=".txt", split=1 << 18).select(
        F.regexp_extract("file_path", r"part%3D(\d+)/", 1).cast("bigint").alias("part"), "seq",
        F.get_json_object("value", "$.n").cast("bigint").alias("n"), F.get_json_object("value", "$.session").alias("session"),
        F.get_json_object("value", "$.kind").alias("kind"))
    return live.drain(rows, "growing")
