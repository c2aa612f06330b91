"""Tool calls against the rules in force."""
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.calls import (gate_verdict, glob_pattern, mode_name, path_allowed, prefixes, required_mode,
                                      working_file_reason)
from turnwise.functions.text import unroll
from turnwise.operators.ordered import SALTS, lookup


def with_need(calls: DataFrame) -> DataFrame:
    """Calls (tool, command, path, action) with the rank of the mode they need."""
    return calls.withColumn("need", required_mode(F.col("tool"), F.col("command"), F.col("path"), F.col("action")))


def mode_verdict(calls: DataFrame, bound: DataFrame, user_mode: str = "off") -> DataFrame:
    """Calls with verdict and reason. ``bound``: agent, rank, source from ``chains.inherited_mode``.

    An agent without a row is bound by the user's mode alone.
    """
    user = lx.MODES.index(user_mode)
    rows = lookup(with_need(calls), bound.withColumnRenamed("agent", "agent_id"), ["agent_id"], ["tool", "command", "path"])
    rank, source = F.coalesce("rank", F.lit(user)), F.coalesce("source", F.lit("user"))
    denied = F.col("need") > rank
    return rows.withColumns({
        "verdict": F.when(denied, "deny").otherwise("pass"),
        "mode": mode_name(rank), "needs": mode_name(F.col("need")), "by": F.when(denied, source),
    }).drop("rank", "source")


def shift_verdict(calls: DataFrame, **config) -> DataFrame:
    """Tracker calls (ts, tool, state, has_surface) with deny, ask or pass."""
    return calls.withColumn("verdict", gate_verdict(F.col("tool"), F.col("ts"), F.col("state"), F.col("has_surface"), **config))


def verdict_profile(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    base = verdicts.groupBy(*by, "verdict").agg(F.count("*").alias("n"))
    return base.rollup(*by, "verdict").agg(F.sum("n").alias("n"))


# --- paths --------------------------------------------------------------------------------------
def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The deepest root above each path. Prefixes meet by equality, so nothing is compared pair by pair.

    ``paths``: path. ``roots``: root. A path below no root is left out.
    """
    up = unroll(paths, ["path"], prefixes(F.col("path")), "root").drop("_pos").where(F.col("root") != F.col("path"))
    up = up.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    known = roots.select("root").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    best = up.join(known, ["root", "_salt"], "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return best.select("path", "root", F.expr("substring(path, length(root) + 2)").alias("rel"))


def allow_list_join(paths: DataFrame, allow: DataFrame) -> DataFrame:
    """Paths (root, rel) that no list of their root covers. ``allow``: root, allow (prefixes and globs)."""
    lists = allow.groupBy("root").agg(F.array_distinct(F.flatten(F.collect_list("allow"))).alias("allow"))
    salted = paths.withColumn("_salt", F.pmod(F.xxhash64("rel"), F.lit(SALTS)).cast("int"))
    lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = salted.join(lists, ["root", "_salt"], "left").drop("_salt")
    return rows.where(~path_allowed(F.col("rel"), F.col("allow"))).drop("allow")


def working_files(paths: DataFrame, allow: DataFrame) -> DataFrame:
    """New paths that belong in a work folder, with the rule."""
    rows = paths.withColumn("reason", working_file_reason(F.col("rel"))).where("reason is not null")
    return allow_list_join(rows, allow)


def path_to_feature(changed: DataFrame, feature_paths: DataFrame) -> DataFrame:
    """Changed paths with the features that list them. ``feature_paths``: feature, pattern.

    A pattern is a path, a prefix that ends in '/', or a glob. All meet the changed paths by
    equality on the folder before the first '*', then a glob is tested.
    """
    fixed = F.regexp_replace("pattern", r"\*[\s\S]*", "")
    is_glob = F.col("pattern").contains("*")
    folder = F.when(is_glob, F.regexp_replace(fixed, r"/?[^/]*$", "")).otherwise(F.regexp_replace("pattern", "/$", ""))
    listed = feature_paths.select("feature", "pattern", folder.alias("at"), is_glob.alias("glob"),
                                  F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    up = unroll(changed.distinct(), ["path"], F.concat(F.array(F.lit("")), prefixes(F.col("path"))), "at").drop("_pos")
    up = up.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    pairs = up.join(listed, ["at", "_salt"])
    whole = (F.col("at") == F.col("path")) & ~F.col("pattern").endswith("/")
    hit = F.when(F.col("glob"), F.regexp_like(F.col("path"), glob_pattern(F.col("pattern")))).otherwise(
        whole | (F.col("pattern").endswith("/") & (F.col("at") != F.col("path"))))
    return pairs.where(hit).select("path", "feature").distinct()


def unlisted_surface(changed: DataFrame, feature_paths: DataFrame) -> DataFrame:
    """Changed user-facing paths that no feature lists."""
    return changed.join(path_to_feature(changed, feature_paths).select("path").distinct(), "path", "left_anti")


def expire_entries(entries: DataFrame, now, keep_days: float | None = lx.KEEP_DAYS) -> DataFrame:
    """Tops in which nothing changed for ``keep_days``.

    ``entries``: top, path, mtime, kind, is_link, depth (0 is the top). An entry exactly at the cutoff is stale. 0 keeps all,
    a bad setting does nothing. Nothing below a linked folder counts, so such rows carry no mtime.
    """
    valid = isinstance(keep_days, (int, float)) and not isinstance(keep_days, bool) and keep_days == keep_days and 0 < keep_days < float("inf")
    tops = entries.groupBy("top").agg(F.max(F.col("mtime").cast("timestamp")).alias("last"))
    if not valid:
        return tops.where(F.lit(False))
    return tops.where(~F.coalesce(F.unix_micros("last") > F.unix_micros(now.cast("timestamp")) - F.lit(int(keep_days * 86_400_000_000)), F.lit(False)))


# --- hooks and settings -------------------------------------------------------------------------
def matcher_cross(actions: DataFrame, matchers: Sequence[tuple[str, str]]) -> DataFrame:
    """Actions with the hooks whose matcher covers their tool.

    ``matchers`` is the hook setting itself, (hook, matcher) pairs. '' and '*' cover all; else one
    of the '|' parts must match the whole name. The list sits in the plan, so nothing is joined.
    """
    def covers(m: str):
        if m in ("", "*"):
            return F.lit(True)
        parts = [F.col("tool").rlike(rf"\A(?:{p})\z") for p in m.split("|")]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out

    hooks = F.array_compact(F.array(*[F.when(covers(m), F.lit(h)) for h, m in matchers]))
    return unroll(actions, actions.columns, hooks, "hook").drop("_pos")


def settings_drift(source: DataFrame, live: DataFrame) -> DataFrame:
    """Keys of the source that are missing in the live settings or differ. Both: machine, key, value."""
    got = live.select("machine", "key", F.col("value").alias("got"), F.lit(True).alias("there"))
    rows = source.withColumnRenamed("value", "want").join(got, ["machine", "key"], "left")
    return rows.where(F.col("there").isNull() | ~F.col("want").eqNullSafe(F.col("got"))).select("machine", "key", "want", "got")
