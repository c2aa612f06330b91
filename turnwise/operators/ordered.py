"""Ordered scans that no single key can overload.

A plain window sorts all rows of a key in one task. Here a key's rows are cut into segments that
follow the order; each segment is scanned on its own, one small row per segment carries the state
on, and the carried state joins back. Rows shuffle once, by (key, segment).
"""
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.lineage import durable

SEGMENT_BITS = 20
SALTS = 16


def int_segment(order: str, bits: int = SEGMENT_BITS) -> Column:
    """Segment of a whole-number order column that is unique within its key: at most 2^bits rows."""
    return F.shiftright(F.col(order).cast("bigint"), bits)


def time_segment(ts: str, seconds: int = 3600) -> Column:
    """Segment of a time column; choose ``seconds`` so that one key's rows in it fit a task."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000))


def range_segments(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Add ``_seg``, the range partition of ``order``, fixed by a durable write.

    For orders that have no natural whole-number or time segment. ``order`` starts with the key.
    """
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_seg", F.spark_partition_id())
    return durable(ranged)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    *,
    last: Mapping[str, Column] | None = None,
    prior: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    best: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per key in order.

    ``last``: latest non-null value up to and including the row. ``prior``: the same, before the
    row. ``total``: running sum including the row. ``best``: running maximum including the row.
    """
    last, prior, total, best = dict(last or {}), dict(prior or {}), dict(total or {}), dict(best or {})
    keys, order = list(keys), list(order)
    cut = df.withColumn("_segment", segment)
    place = F.struct(*order)

    inside = Window.partitionBy(*keys, "_segment").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_l_{n}": F.last(e, ignorenulls=True).over(upto) for n, e in last.items()}
    local |= {f"_l_{n}": F.last(e, ignorenulls=True).over(before) for n, e in prior.items()}
    local |= {f"_l_{n}": F.sum(e).over(upto) for n, e in total.items()}
    local |= {f"_l_{n}": F.max(e).over(upto) for n, e in best.items()}

    tails = {n: F.max_by(e, F.when(e.isNotNull(), place)) for n, e in {**last, **prior}.items()}
    tails |= {n: F.sum(e) for n, e in total.items()}
    tails |= {n: F.max(e) for n, e in best.items()}
    summary = cut.groupBy(*keys, "_segment").agg(*[c.alias(f"_t_{n}") for n, c in tails.items()])
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    moved = [F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in {**last, **prior}]
    moved += [F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in total]
    moved += [F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in best]
    state = summary.select(*keys, "_segment", *moved)

    joined = cut.withColumns(local).join(state, [*keys, "_segment"], "left")
    out = {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in {**last, **prior}}
    out |= {n: F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in total}
    out |= {n: F.greatest(f"_l_{n}", f"_c_{n}") for n in best}
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], spread: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Join to a table of few rows per key; many rows of ``df`` may share one.

    Without ``spread`` the join is plain: adaptive skew handling splits a hot key of ``df`` at run
    time. For a ``dim`` of far fewer rows than ``df``, name in ``spread`` columns that differ between
    rows of one key: their hash deals the key over 16 tasks, each with its copy of the ``dim`` row.
    """
    if not spread:
        return df.join(dim, list(on), how)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
