"""Usage queries: events stand for usage samples, benchmark runs and screen changes."""
from pyspark.sql import functions as F

from turnwise.operators import usage
from turnwise.plans.log_queries import kind_events
from turnwise.plans.registry import query, table
from turnwise.sources.usage import read_usage

NOW = 1_704_672_000  # 2024-01-08 00:00 UTC


def samples(spark, sf_dir):
    """Each event as a usage payload in JSON, read back by the source."""
    ev = kind_events(spark, sf_dir)
    cents = F.round(F.col("value") * 100).cast("bigint")
    payload = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("session_id"),
        F.struct(F.struct(cents.alias("input_tokens"), (F.col("k") * 50).cast("bigint").alias("cache_read_input_tokens"),
                          F.lit(10).cast("bigint").alias("cache_creation_input_tokens")).alias("current_usage"),
                 F.lit(9000).cast("bigint").alias("context_window_size")).alias("context_window"),
        F.struct(F.struct(F.col("k").cast("double").alias("used_percentage"),
                          (F.lit(NOW) + (F.col("k") % 6) * 3600).cast("bigint").alias("resets_at")).alias("five_hour"),
                 F.struct((F.col("k") * 1.0 + 5).alias("used_percentage"),
                          (F.lit(NOW) + (F.col("k") % 8) * 86400 - 3600).cast("bigint").alias("resets_at")).alias("seven_day")).alias("rate_limits")))
    return read_usage(ev.select("event_id", F.struct("ts", "event_id").alias("ts"), payload.alias("value")))


SAMPLES = f"""
WITH e AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                  CAST(round(value * 100) AS BIGINT) AS cents FROM events),
l AS (SELECT session, arg_max(k, (ts, event_id)) AS k, arg_max(cents, (ts, event_id)) AS cents FROM e GROUP BY 1),
w AS (SELECT session, 'five_hour' AS win, k AS used, {NOW} + (k % 6) * 3600 AS fin, 18000 AS ws, 1800 AS ms, 1800 AS gs FROM l
      UNION ALL SELECT session, 'seven_day', k + 5, {NOW} + (k % 8) * 86400 - 3600, 604800, 43200, 86400 FROM l),
x AS (SELECT *, CASE WHEN fin > {NOW} THEN fin - ws ELSE 0 END AS start,
             CASE WHEN fin > {NOW} THEN least(greatest({NOW} - (fin - ws), 0), ws) ELSE -1 END AS el,
             CASE WHEN fin > {NOW} THEN fin - {NOW} ELSE 0 END AS rest FROM w),
y AS (SELECT *, used > 0 AND used < 100 AND el >= ms AS paced, CASE WHEN used > 0 THEN start + el * 100 // used END AS out_at FROM x)
"""


@query(SAMPLES + """
SELECT session, win AS window, CAST(used AS BIGINT) AS used,
  CASE WHEN used >= 100 THEN 'red' WHEN paced AND out_at < fin AND (fin - out_at >= gs OR used >= 90) THEN 'red'
       WHEN paced AND out_at < fin THEN 'yellow' ELSE 'calm' END AS state,
  CAST(CASE WHEN paced AND out_at < fin THEN out_at END AS BIGINT) AS run_out,
  CAST(CASE WHEN paced AND out_at >= fin THEN ((100 - used) * 86400 * 2 + rest) // (2 * rest) END AS BIGINT) AS per_day,
  CAST(rest AS BIGINT) AS left FROM y""")
def burn_rate(spark, sf_dir):
    """Burn rate of two windows per user from the last sample."""
    return usage.rate_windows(samples(spark, sf_dir), F.lit(NOW))


@query("""
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) * 50 AS cr, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
p AS (SELECT event_id, cents + cr + 10 AS used, CASE WHEN event_id % 3 = 0 THEN 6000 ELSE 9000 END AS win FROM e)
SELECT event_id, used * 100 // win AS pct, CASE WHEN used * 100 // win >= 90 THEN 'red' WHEN used * 100 // win >= 70 THEN 'yellow' ELSE 'calm' END AS level,
       CAST(greatest(win - used, 0) AS BIGINT) AS left FROM p""")
def context_pressure(spark, sf_dir):
    """Context in use per sample, with a smaller budget for every third."""
    return usage.context_pressure(samples(spark, sf_dir), F.when(F.col("event_id") % 3 == 0, 6000)).select("event_id", "pct", "level", "left")


@query("""
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) * 50 AS cr, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
p AS (SELECT event_id, CAST(cr * 100 // (cents + cr + 10) AS BIGINT) AS cache_pct FROM e)
SELECT event_id, cache_pct, CASE WHEN cache_pct >= 80 THEN 'calm' WHEN cache_pct >= 40 THEN 'yellow' ELSE 'red' END AS cache_level FROM p""")
def cache_rate(spark, sf_dir):
    """Cache share per sample."""
    return usage.cache_hit_rate(samples(spark, sf_dir)).select("event_id", "cache_pct", "cache_level")


@query("""
WITH c AS (SELECT user_id AS pr, CASE event_type WHEN 'error' THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 = 0 THEN 3 ELSE 1 END
   WHEN 'click' THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 9 = 0 THEN 2 ELSE 1 END ELSE 1 END AS r FROM events)
SELECT pr, CASE MAX(r) WHEN 3 THEN 'fail' WHEN 2 THEN 'pend' ELSE 'ok' END AS state FROM c GROUP BY 1""")
def ci_rollup(spark, sf_dir):
    """Check state per user."""
    k = F.col("k")
    return usage.ci_rollup(kind_events(spark, sf_dir).select(
        F.col("user_id").alias("pr"),
        F.when((F.col("event_type") == "click") & (k % 9 == 0), "in_progress").otherwise("COMPLETED").alias("status"),
        F.when((F.col("event_type") == "error") & (k % 20 == 0), "timed_out").otherwise("success").alias("conclusion")))


@query("""
WITH t AS (SELECT DISTINCT user_id AS source, epoch_us(ts) / 1000000.0 AS t FROM events),
g AS (SELECT *, LAG(t) OVER (PARTITION BY source ORDER BY t) AS p FROM t),
m AS (SELECT MAX(t) AS fin FROM t)
SELECT source, ROUND(p, 3) AS start, ROUND(t, 3) AS stop, FALSE AS tail FROM g WHERE t - p > 36000
UNION ALL SELECT source, ROUND(MAX(t), 3), ROUND(ANY_VALUE(fin), 3), TRUE FROM t, m GROUP BY source HAVING ANY_VALUE(fin) - MAX(t) > 36000""")
def still_gaps(spark, sf_dir):
    """Ten quiet hours or more per user, the time to the end included."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    ends = ev.select("source").distinct().withColumn("end", ev.agg(F.max("t")).scalar())
    return usage.still_gaps(ev, ends, F.floor(F.col("t") / 86_400), 36_000).select(
        "source", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"), "tail")


@query("""
WITH r AS (SELECT CASE WHEN user_id % 40 = 0 THEN 'rare' ELSE event_type END AS bench, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS side,
                  value + CASE WHEN event_id % 2 = 0 AND event_type = 'view' THEN 100000 ELSE 0 END AS value,
                  CASE WHEN user_id % 13 = 0 THEN 1 ELSE 0 END AS errors FROM events),
s AS (SELECT bench, side, COUNT(*) AS n, median(value) AS med, MIN(value) AS lo, MAX(value) AS hi FROM r WHERE errors = 0 GROUP BY 1, 2),
w AS (SELECT bench, MAX(CASE WHEN side = 'before' THEN n END) AS bn, MAX(CASE WHEN side = 'after' THEN n END) AS an,
             MAX(CASE WHEN side = 'before' THEN med END) AS bm, MAX(CASE WHEN side = 'after' THEN med END) AS am, MAX(hi - lo) AS spread FROM s GROUP BY 1)
SELECT b.bench, bn AS before_n, an AS after_n, ROUND(bm, 6) AS before_median, ROUND(am, 6) AS after_median,
       CASE WHEN COALESCE(bn, 0) < 5 OR COALESCE(an, 0) < 5 THEN 'inconclusive' WHEN abs(am - bm) <= spread THEN 'none' WHEN am < bm THEN 'faster' ELSE 'slower' END AS verdict
FROM (SELECT DISTINCT bench FROM r) b LEFT JOIN w USING (bench)""")
def ab_verdict(spark, sf_dir):
    """Even against odd events as two sides of a benchmark per type."""
    e = F.col("event_id") % 2 == 0
    runs = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 40 == 0, "rare").otherwise(F.col("event_type")).alias("bench"),
        F.when(e, "before").otherwise("after").alias("side"),
        (F.col("value") + F.when(e & (F.col("event_type") == "view"), 100_000).otherwise(0)).alias("value"),
        F.when(F.col("user_id") % 13 == 0, 1).otherwise(0).alias("errors"), F.lit(1).alias("work"))
    return usage.ab_benchmark(runs).select(
        "bench", "before_n", "after_n", F.round("before_median", 6).alias("before_median"),
        F.round("after_median", 6).alias("after_median"), "verdict")
