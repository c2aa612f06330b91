"""Measured motion against its plan."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.curves import control_points, curve_value, easing_family
from turnwise.functions.text import unroll
from turnwise.lineage import durable
from turnwise.operators.ordered import carry, lookup


def motion_residual(samples: DataFrame, segment: Column) -> DataFrame:
    """Error, overshoot and direction per motion. ``samples``: motion, duration, easing, t (ms), p."""
    timed = samples.withColumn("_x", F.col("t") / F.col("duration"))
    points = timed.select("easing", "_x").distinct()  # frames repeat, so a curve is solved once per time share
    solved = durable(points.select("easing", "_x", curve_value(control_points(F.col("easing")), F.col("_x")).alias("_planned")))
    rows = carry(lookup(timed, solved, ["easing", "_x"], ["motion", "t"]), ["motion"], ["t"], segment, prior={"_was": F.col("p")})
    rows = rows.withColumn("err", F.col("p") - F.col("_planned"))
    return rows.groupBy("motion").agg(
        F.count("*").alias("samples"), F.max(F.abs("err")).alias("max_err"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rms"),
        F.greatest(F.max("p") - 1, F.lit(0.0)).alias("overshoot"),
        F.bool_and(F.coalesce(F.col("p") >= F.col("_was"), F.lit(True))).alias("monotonic"))


def duration_band(motions: DataFrame, bands: dict[str, tuple[float, float]] = lx.DURATION_BANDS) -> DataFrame:
    """Whether a motion (motion, kind, duration) lies in the band of its kind. The bands sit in the plan."""
    pairs = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in bands.items()])
    rows = unroll(motions, motions.columns, F.filter(pairs, lambda b: b["band"] == F.col("kind")), "b")
    return rows.select("motion", "b.band", "duration", F.col("duration").between(F.col("b.lo"), F.col("b.hi")).alias("inside"))


def motion_rules(motions: DataFrame, stagger_ms: tuple[int, int] = lx.STAGGER_MS) -> DataFrame:
    """Broken rules: (motion, rule).

    ``motions``: motion, component, phase ('enter', 'exit', 'move', 'hover' or 'constant'), easing,
    duration, item (place in a staggered group, null alone), delay (ms).
    """
    family, phase = easing_family(F.col("easing")), F.col("phase")
    moving = phase.isin("enter", "exit")
    broken = F.array_compact(F.array(
        F.when(family == "in", "ease-in"),
        F.when(moving & (family != "out") & (family != "in"), "enter and exit ease out"),
        F.when((family == "linear") & ~moving & (phase != "constant"), "linear without constant motion")))
    easing = unroll(motions, ["motion"], broken, "rule").drop("_pos")
    pairs = motions.groupBy("component").agg(
        F.max(F.when(phase == "exit", F.col("duration"))).alias("exit"), F.min(F.when(phase == "enter", F.col("duration"))).alias("enter"))
    slow = motions.where("phase = 'exit'").join(pairs, "component").where(F.col("duration") >= F.col("enter"))
    steps = carry(motions.where("item is not null"), ["component", "phase"], ["item"], F.shiftright(F.col("item").cast("bigint"), 16),
                  prior={"_was": F.col("delay")})
    off = steps.where(F.col("_was").isNotNull() & ~(F.col("delay") - F.col("_was")).between(*stagger_ms))
    return easing.unionByName(slow.select("motion", F.lit("exit not shorter than entrance").alias("rule"))).unionByName(
        off.select("motion", F.lit("stagger").alias("rule")))
