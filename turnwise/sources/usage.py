"""Usage payloads: one nested JSON sample per row, flattened to typed columns."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = """
session_id STRING, cwd STRING, workspace STRUCT<current_dir: STRING>, model STRUCT<id: STRING, display_name: STRING>,
vim STRUCT<mode: STRING>, output_style STRUCT<name: STRING>, effort STRUCT<level: STRING>, fast_mode BOOLEAN,
thinking STRUCT<enabled: BOOLEAN>, worktree STRUCT<name: STRING, branch: STRING, original_cwd: STRING>,
agent STRUCT<name: STRING>, pr STRUCT<number: BIGINT, review_state: STRING>, cost STRUCT<total_duration_ms: BIGINT>,
context_window STRUCT<used_percentage: DOUBLE, context_window_size: BIGINT,
  current_usage: STRUCT<input_tokens: BIGINT, cache_read_input_tokens: BIGINT, cache_creation_input_tokens: BIGINT>>,
rate_limits STRUCT<five_hour: STRUCT<used_percentage: DOUBLE, resets_at: BIGINT>,
  seven_day: STRUCT<used_percentage: DOUBLE, resets_at: BIGINT>>
"""


def forward_slashes(path: Column) -> Column:
    """Paths that start with a drive letter use forward slashes."""
    return F.when(path.rlike(r"^[A-Za-z]:[\\/]"), F.replace(path, F.lit("\\"), F.lit("/"))).otherwise(path)


def read_usage(samples: DataFrame, payload: str = "value") -> DataFrame:
    """``ts`` and the payload to columns. A false stays false; only a missing value is null."""
    rest = [c for c in samples.columns if c != payload]
    v = samples.select(*rest, F.from_json(payload, SCHEMA).alias("v"))
    usage = F.col("v.context_window.current_usage")
    return v.select(
        *rest, F.col("v.session_id").alias("session"),
        forward_slashes(F.coalesce("v.workspace.current_dir", "v.cwd")).alias("cwd"),
        F.col("v.model.id").alias("model_id"), F.col("v.model.display_name").alias("model_name"),
        F.col("v.effort.level").alias("effort"), F.col("v.fast_mode").alias("fast_mode"),
        F.col("v.thinking.enabled").alias("thinking"), F.col("v.worktree.name").alias("wt_name"),
        F.col("v.worktree.branch").alias("wt_branch"), forward_slashes(F.col("v.worktree.original_cwd")).alias("wt_orig"),
        F.col("v.agent.name").alias("agent_name"), F.col("v.pr.number").alias("pr_num"),
        F.col("v.pr.review_state").alias("pr_state"), F.col("v.context_window.used_percentage").alias("used_pct"),
        F.col("v.context_window.context_window_size").alias("window_size"), usage.isNotNull().alias("has_usage"),
        F.coalesce(usage["input_tokens"], F.lit(0)).alias("input_tokens"),
        F.coalesce(usage["cache_read_input_tokens"], F.lit(0)).alias("cache_read"),
        F.coalesce(usage["cache_creation_input_tokens"], F.lit(0)).alias("cache_write"),
        F.coalesce("v.cost.total_duration_ms", F.lit(0)).alias("dur_ms"),
        F.col("v.rate_limits.five_hour.used_percentage").alias("five_hour_pct"),
        F.col("v.rate_limits.five_hour.resets_at").alias("five_hour_reset"),
        F.col("v.rate_limits.seven_day.used_percentage").alias("seven_day_pct"),
        F.col("v.rate_limits.seven_day.resets_at").alias("seven_day_reset"))
