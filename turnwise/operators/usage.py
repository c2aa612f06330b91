"""Usage analytics: burn rate, context pressure, cache use, CI state, benchmarks and gaps."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.text import unroll
from turnwise.operators.ordered import carry, lookup, range_segments


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, cut off toward zero; null by zero."""
    a, b = a.cast("bigint"), b.cast("bigint")
    b = F.nullif(b, F.lit(0).cast("bigint"))
    return ((a - F.call_function("mod", a, b)) / b).cast("bigint")


def latest(samples: DataFrame, keys: Sequence[str] = ("session",), ts: str = "ts") -> DataFrame:
    """The last sample per key."""
    rest = [c for c in samples.columns if c not in keys]
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("s")).select(*keys, "s.*")


def burn_rate(used_pct: Column, reset: Column, now: Column, window_s: int, min_s: int, gap_s: int) -> Column:
    """Struct(used, state, run_out, per_day, left) for one rate window; times are epoch seconds.

    The run-out is start + elapsed * 100 / used. ``state`` is red at 100 %, or when the run-out lies
    ``gap_s`` or more before the reset, or with 90 % used and a run-out before the reset; yellow
    when it only lies before the reset; else calm. ``per_day`` is the percentage left per day.
    """
    used = F.coalesce(F.bround(used_pct, 0).cast("bigint"), F.lit(0).cast("bigint"))
    end = F.coalesce(reset, F.lit(0)).cast("bigint")
    running = end > now
    start = F.when(running, end - window_s).otherwise(0)
    elapsed = F.when(running, F.least(F.greatest(now - start, F.lit(0)), F.lit(window_s))).otherwise(-1).cast("bigint")
    left = F.when(running, end - now).otherwise(0).cast("bigint")
    paced = (used < 100) & (used > 0) & (elapsed >= min_s)
    out_at = start + _div(elapsed * 100, used)
    early = paced & (out_at < end)
    state = F.when(used >= 100, "red").when(early & ((end - out_at >= gap_s) | (used >= 90)), "red").when(early, "yellow").otherwise("calm")
    per_day = F.when(paced & ~early, _div((100 - used) * 86_400 * 2 + left, 2 * left))
    return F.struct(used.alias("used"), state.alias("state"), F.when(early, out_at).alias("run_out"), per_day.alias("per_day"),
                    left.alias("left"))


def rate_windows(samples: DataFrame, now: Column, windows: dict = lx.RATE_WINDOWS) -> DataFrame:
    """Burn rate of each window from the last sample per session."""
    last = latest(samples)
    parts = [F.struct(F.lit(n).alias("window"), burn_rate(F.col(f"{n}_pct"), F.col(f"{n}_reset"), now, *w).alias("r"))
             for n, w in windows.items()]
    known = {n: F.col(f"{n}_pct").isNotNull() for n in windows}
    rows = unroll(last, ["session"], F.array_compact(F.array(*[F.when(known[n], p) for n, p in zip(windows, parts)])), "w")
    return rows.select("session", "w.window", "w.r.*")


def context_pressure(samples: DataFrame, candidate: Column | None = None) -> DataFrame:
    """Share of the context window in use. ``candidate`` is a smaller budget, if any."""
    used = F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")
    size, cand = F.coalesce("window_size", F.lit(0)), F.coalesce(candidate if candidate is not None else F.lit(0), F.lit(0))
    win = F.when((cand > 0) & ((size == 0) | (cand < size)), cand).otherwise(size)
    has = F.col("has_usage") if "has_usage" in samples.columns else F.lit(True)
    given = F.coalesce(F.col("used_pct"), F.lit(0)).cast("bigint") if "used_pct" in samples.columns else F.lit(0).cast("bigint")
    pct = F.when(win > 0, F.when(has, _div(used * 100, win)).otherwise(0)).otherwise(given)
    level = F.when(pct >= 90, "red").when(pct >= 70, "yellow").otherwise("calm")
    return samples.withColumns({"pct": pct, "level": level, "left": F.when(win > 0, F.greatest(win - used, F.lit(0)))})


def cache_hit_rate(samples: DataFrame) -> DataFrame:
    """Cache reads as a share of the tokens in use."""
    used = F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")
    rows = samples.where(used > 0).withColumn("cache_pct", _div(F.col("cache_read") * 100, used))
    return rows.withColumn("cache_level", F.when(F.col("cache_pct") >= 80, "calm").when(F.col("cache_pct") >= 40, "yellow").otherwise("red"))


def ci_state(checks: Column) -> Column:
    """none, fail, pend or ok of an array of (status, conclusion)."""
    done = lambda c: F.upper(F.coalesce(c["conclusion"], F.lit("")))
    failed = F.exists(checks, lambda c: done(c).isin(lx.CI_FAIL))
    open_ = F.exists(checks, lambda c: done(c).isin(lx.CI_OPEN_CONCLUSION) | F.upper(F.coalesce(c["status"], F.lit(""))).isin(lx.CI_OPEN_STATUS))
    return F.when(F.coalesce(F.size(checks), F.lit(0)) <= 0, "none").when(failed, "fail").when(open_, "pend").otherwise("ok")


def ci_rollup(checks: DataFrame) -> DataFrame:
    """CI state per pull request from one row per check (pr, status, conclusion; both null for none)."""
    done, status = F.upper(F.coalesce("conclusion", F.lit(""))), F.upper(F.coalesce("status", F.lit("")))
    none = F.col("conclusion").isNull() & F.col("status").isNull()
    rank = F.when(none, 0).when(done.isin(lx.CI_FAIL), 3).when(done.isin(lx.CI_OPEN_CONCLUSION) | status.isin(lx.CI_OPEN_STATUS), 2).otherwise(1)
    return checks.groupBy("pr").agg(F.max(rank).alias("r")).select(
        "pr", F.element_at(F.array(*[F.lit(s) for s in ("none", "ok", "pend", "fail")]), F.col("r") + 1).alias("state"))


# --- gaps and benchmarks ------------------------------------------------------------------------
def still_gaps(changes: DataFrame, ends: DataFrame, segment: Column, seconds: float = lx.STILL_SECONDS) -> DataFrame:
    """Stretches without a change longer than ``seconds``, the one before the end included.

    ``changes``: source, t (seconds). ``ends``: source, end.
    """
    rows = carry(changes.select("source", "t").distinct(), ["source"], ["t"], segment, prior={"start": F.col("t")})
    between = rows.where(F.col("t") - F.col("start") > seconds).select("source", "start", F.col("t").alias("stop"), F.lit(False).alias("tail"))
    last = changes.groupBy("source").agg(F.max("t").alias("start")).join(ends, "source")
    tail = last.where(F.col("end") - F.col("start") > seconds).select("source", "start", F.col("end").alias("stop"), F.lit(True).alias("tail"))
    return between.unionByName(tail).withColumn("secs", F.col("stop") - F.col("start"))


def exact_medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median per key without gathering a key in one task.

    Equal values fold first; the rest is range-partitioned by value and each partition adds the
    count before it, which gives every value its ranks.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cut = range_segments(counts, [*keys, value])
    ranked = carry(cut, keys, [value], F.col("_seg"), total={"_upto": F.col("_n")})
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    at = lookup(ranked, sizes, keys, [value], "inner")
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col("_n") < r)
    return at.where(holds(low) | holds(high)).groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"))


def ab_benchmark(runs: DataFrame, min_runs: int = 5, lower_is_better: bool = True) -> DataFrame:
    """Verdict per benchmark from runs of two sides (bench, side 'before' or 'after', value, errors, work).

    Runs with errors or less work than the most done are left out. Fewer than ``min_runs`` on a
    side is inconclusive; a difference inside the wider spread is none.
    """
    most = runs.groupBy("bench").agg(F.max("work").alias("_most"))
    good = lookup(runs, most, ["bench"], ["value", "side"], "inner").where((F.col("errors") == 0) & (F.col("work") == F.col("_most")))
    facts = good.groupBy("bench", "side").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    sides = facts.join(exact_medians(good, ["bench", "side"], "value"), ["bench", "side"])
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = sides.groupBy("bench").agg(*[pick(s, c).alias(f"{s}_{c}") for s in ("before", "after") for c in ("n", "median", "low", "high")])
    spread = F.greatest(F.col("before_high") - F.col("before_low"), F.col("after_high") - F.col("after_low"))
    delta = F.col("after_median") - F.col("before_median")
    better = delta < 0 if lower_is_better else delta > 0
    few = (F.coalesce("before_n", F.lit(0)) < min_runs) | (F.coalesce("after_n", F.lit(0)) < min_runs)
    verdict = F.when(few, "inconclusive").when(F.abs(delta) <= spread, "none").when(better, "faster").otherwise("slower")
    benches = runs.select("bench").distinct()
    return benches.join(wide, "bench", "left").withColumns({"delta": delta, "verdict": verdict})
