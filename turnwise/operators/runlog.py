"""Audit of a loop's pass log: progress, stalls, budget and what the trace shows."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.ordered import carry


def check_progress(log: DataFrame, segment: Column, lower_is_better: bool = True) -> DataFrame:
    """Passes with the change of the check, the best value so far and the kept and reverted counts.

    ``log``: run, pass, before, after (numbers), result ('kept' or 'reverted').
    """
    sign = -1 if lower_is_better else 1
    kept, reverted = F.col("result") == "kept", F.col("result") == "reverted"
    rows = carry(log, ["run"], ["pass"], segment,
                 total={"kept": kept.cast("int"), "reverted": reverted.cast("int")},
                 best={"_best": F.when(kept, F.col("after") * sign)})
    return rows.withColumns({"delta": F.col("after") - F.col("before"), "best": F.col("_best") * sign}).drop("_best")


def stuck_run(log: DataFrame, segment: Column, n: int = 3) -> DataFrame:
    """Stretches of ``n`` or more reverted passes, or of passes with the same check value."""
    look = F.struct((F.col("result") == "reverted").alias("no"), F.col("after").alias("value"))
    seen = carry(log.withColumn("_now", look), ["run"], ["pass"], segment, prior={"_was": F.col("_now")})
    first = F.col("_was").isNull()
    flags = seen.withColumns({
        "_a": (first | (F.col("_was.no") != F.col("_now.no"))).cast("int"),
        "_b": (first | ~F.col("_was.value").eqNullSafe(F.col("_now.value"))).cast("int")})
    runs = carry(flags, ["run"], ["pass"], segment, total={"_ra": F.col("_a"), "_rb": F.col("_b")})
    shape = [F.min("pass").alias("from_pass"), F.max("pass").alias("to_pass"), F.count("*").alias("n")]
    reverted = runs.where("_now.no").groupBy("run", "_ra").agg(*shape).withColumn("kind", F.lit("reverted"))
    unchanged = runs.groupBy("run", "_rb").agg(*shape).withColumn("kind", F.lit("unchanged"))
    return reverted.drop("_ra").unionByName(unchanged.drop("_rb")).where(F.col("n") >= n)


def floor_and_budget(log: DataFrame, segment: Column, floor: int = 0, max_passes: int | None = None,
                     max_hours: float | None = None, max_spend: float | None = None) -> DataFrame:
    """Passes with ``may_stop`` (the floor is reached) and ``must_stop`` (a budget is used up).

    ``log``: run, pass, hours, spend.
    """
    rows = carry(log, ["run"], ["pass"], segment, total={
        "passes": F.lit(1), "hours_used": F.coalesce("hours", F.lit(0.0)), "spend_used": F.coalesce("spend", F.lit(0.0))})
    over = F.lit(False)
    for used, limit in (("passes", max_passes), ("hours_used", max_hours), ("spend_used", max_spend)):
        if limit is not None:
            over = over | (F.col(used) >= limit)
    return rows.withColumns({"may_stop": F.col("passes") >= floor, "must_stop": over})


def log_vs_trace(log: DataFrame, trace: DataFrame) -> DataFrame:
    """Unsupported log rows and unlogged actions. Both: run, item, evidence."""
    said = log.groupBy("run", "item").agg(F.min("evidence").alias("said"))
    did = trace.groupBy("run", "item").agg(F.min("evidence").alias("did"))
    rows = said.withColumn("_s", F.lit(1)).join(did.withColumn("_d", F.lit(1)), ["run", "item"], "full")
    flag = F.when(F.col("_d").isNull(), "Unsupported").when(F.col("_s").isNull(), "Unlogged")
    return rows.select("run", "item", flag.alias("flag"), F.coalesce("said", "did").alias("evidence")).where("flag is not null")
