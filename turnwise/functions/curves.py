"""Easing curves."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise import lexicons as lx

STEPS = 40


def control_points(easing: Column) -> Column:
    """The four numbers of ``cubic-bezier(...)`` or of a keyword; null for an unknown easing."""
    inside = F.regexp_extract(easing, r"cubic-bezier\(([^)]*)\)", 1)
    given = F.transform(F.split(inside, ","), lambda s: F.trim(s).try_cast("double"))
    named = None
    for name, points in lx.CURVES.items():
        value = F.array(*[F.lit(p) for p in points])
        named = F.when(F.trim(easing) == name, value) if named is None else named.when(F.trim(easing) == name, value)
    return F.when((inside != "") & (F.size(given) == 4), given).otherwise(named)


def curve_value(points: Column, x: Column) -> Column:
    """Progress of the curve at time share ``x``, all in columns.

    The curve's parameter solves time(s) = x, which rises on [0, 1]. Newton steps start at x and stay in a
    bracket that every step narrows; a step that would leave it goes to its middle instead.
    """
    def bezier(a: Column, b: Column, s: Column) -> Column:
        return s * (3 * a + s * (3 * b - 6 * a + s * (1 + 3 * a - 3 * b)))

    def slope(a: Column, b: Column, s: Column) -> Column:
        return 3 * a + s * (6 * b - 12 * a + 3 * s * (1 + 3 * a - 3 * b))

    def step(state: Column, _: Column) -> Column:
        s, p, at = state["s"], state["p"], state["at"]
        miss = bezier(p[0], p[2], s) - at
        low, high = F.when(miss < 0, s).otherwise(state["low"]), F.when(miss < 0, state["high"]).otherwise(s)
        steep = slope(p[0], p[2], s)
        newton = s - F.when(F.abs(steep) > 1e-12, miss / steep)
        ahead = F.when(F.abs(miss) < 1e-15, s).when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        return F.struct(ahead.alias("s"), low.alias("low"), high.alias("high"), p.alias("p"), at.alias("at"))

    at = x.cast("double")
    start = F.struct(at.alias("s"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), points.alias("p"), at.alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda end: bezier(end["p"][1], end["p"][3], end["s"]))


def easing_family(easing: Column) -> Column:
    """linear, ease, in, out or in-out, from how the curve leaves and arrives."""
    p = control_points(easing)
    slow_start, slow_end = p[1] < p[0], p[3] > p[2]
    return (
        F.when(F.trim(easing) == "ease", "ease")
        .when((p[0] == p[1]) & (p[2] == p[3]), "linear")
        .when(slow_start & slow_end, "in-out").when(slow_start, "in").when(p.isNotNull(), "out"))
