"""Scored evaluation: graders over traces, pass rates and trigger confusion."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.ordered import SALTS


def grader_trace(runs: DataFrame, graders: DataFrame) -> DataFrame:
    """Every run (case, run) with the graders of its case."""
    few = graders.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return runs.withColumn("_salt", F.pmod(F.xxhash64("run"), F.lit(SALTS)).cast("int")).join(few, ["case", "_salt"]).drop("_salt")


def grade_tool_used(runs: DataFrame, graders: DataFrame, trace: DataFrame) -> DataFrame:
    """Calls of a tool whose input matches, their number inside [min, max].

    ``trace``: case, run, seq, tool, input. Without bounds one call is needed; no max means any number.
    """
    tools = graders.where("type = 'tool_used'")
    wanted = tools.select("case", "grader", "tool", "input_match", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    calls = trace.withColumn("_salt", F.pmod(F.xxhash64("run", "seq"), F.lit(SALTS)).cast("int"))
    hit = F.col("input_match").isNull() | F.regexp_like("input", F.col("input_match"))
    counts = calls.join(wanted, ["case", "tool", "_salt"]).where(hit).groupBy("case", "run", "grader").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    low = F.coalesce("min", F.when(F.col("max").isNull(), 1).otherwise(0))
    ok = (n >= low) & F.coalesce(n <= F.col("max"), F.lit(True))
    return grader_trace(runs, tools).join(counts, ["case", "run", "grader"], "left").select("case", "run", "grader", ok.alias("passed"))


def grade_regex(graders: DataFrame, texts: DataFrame) -> DataFrame:
    """A pattern found, or with match 'not_contains' not found, in the target's text.

    ``texts``: case, run, target, text; the default target is 'trace'.
    """
    rules = graders.where("type = 'regex'").select(
        "case", "grader", F.coalesce("target", F.lit("trace")).alias("target"), "pattern",
        (F.coalesce("match", F.lit("contains")) == "not_contains").alias("_not"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = texts.withColumn("_salt", F.pmod(F.xxhash64("run"), F.lit(SALTS)).cast("int")).join(rules, ["case", "target", "_salt"])
    return rows.select("case", "run", "grader", (F.regexp_like("text", F.col("pattern")) != F.col("_not")).alias("passed"))


def grade_rollup(grades: DataFrame, suites: DataFrame) -> DataFrame:
    """Pass rate per case and suite; a run passes when all its graders pass. ``suites``: suite, case."""
    runs = grades.groupBy("case", "run").agg(F.bool_and("passed").alias("passed"))
    per_case = runs.groupBy("case").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passes"))
    rows = per_case.join(suites, "case")
    up = rows.rollup("suite", "case").agg(F.sum("runs").alias("runs"), F.sum("passes").alias("passes")).where("suite is not null")
    return up.withColumn("pass_rate", F.col("passes") / F.col("runs"))


def trigger_confusion(labels: DataFrame, fired: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision and recall per skill.

    ``labels``: skill, query, should_trigger. ``fired``: skill, query, one row if the skill loaded.
    """
    did = fired.select("skill", "query").distinct().withColumn("did", F.lit(True))
    rows = labels.join(did, ["skill", "query"], "left")
    should, fire = F.col("should_trigger"), F.col("did").isNotNull()
    out = rows.groupBy("skill").agg(
        F.count_if(should & fire).alias("tp"), F.count_if(~should & fire).alias("fp"),
        F.count_if(should & ~fire).alias("fn"), F.count_if(~should & ~fire).alias("tn"))
    return out.withColumns({
        "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})
