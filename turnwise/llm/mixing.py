"""Mixing sources to target weights by entropy balancing.

The mix that is closest to taking every document once, in relative entropy, and whose words of a
source add up to the source's target takes a document at the rate min(most, exp(dual * size / mean)).
The dual variable of each source is found by Newton steps; each step is one aggregate over counts of
equal sizes. Rates are then rounded into copies so that the words of a source meet its target.
"""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.lineage import durable, stored
from turnwise.llm.common import boxed, unboxed, whole, words
from turnwise.operators.ordered import lookup

WEIGHTS = (3.0, 1.0, 2.0)  # of sources by code point, repeating
SHARE = 1.5  # of all words that the mix has
MOST = 2  # copies of a document
STEPS = 12  # Newton steps at most
CLOSE = 1e-7  # relative miss of a target that ends the steps
BUCKETS = 4096  # of the rounding order


def key_of(source: str | Column = "source") -> Column:
    """The source as a key that is never null: a null source differs from every string."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` of each source of ``sizes`` (key, source_size).

    Targets follow the weights and stop at ``most`` times the source's size. Sharing the excess again
    until none is above ends at one level L with target = min(most * size, weight * L): sources are
    sorted by the level at which they fill up, and running sums give the level between two of them.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_null", (F.col("key") == "n").cast("int")).withColumn(
        "_rank", F.row_number().over(Window.orderBy("_null", "key")) - 1).withColumn("weight", cycle)
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_fills", F.col("_cap") / F.col("weight"))
    before = Window.orderBy("_fills", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_fills", "_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("_fills", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = ranked.withColumn("_level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                                / F.sum("weight").over(after))
    level = F.max("_level").over(everything)  # filling up a source too few or too many lowers it
    return leveled.withColumn("_at", level).withColumn(
        "target", F.coalesce(F.least(F.col("_cap"), F.col("weight") * F.col("_at")), F.col("_cap"))
    ).select("key", "source_size", "target")


def _rate(dual: Column, size: Column, mean: Column, most: int) -> Column:
    """Rate of a document; a source that must be taken in full has no finite dual."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), dual * size / mean))))


def duals(counts: DataFrame, goals: DataFrame, most: int = MOST, steps: int = STEPS, close: float = CLOSE) -> DataFrame:
    """Dual variable of each source: key, source_size, target, mean, full, dual.

    ``counts`` (key, size, n) holds equal sizes once. A step joins the duals to the counts, adds up the
    words and their slope per source and moves each dual; a dual that leaves its bracket halves it.
    """
    mean = counts.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    state = goals.join(mean, "key").select(
        "key", "source_size", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"),
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.when(F.col("target") > 0, F.ln(F.col("target") / F.col("source_size"))).otherwise(0.0).alias("dual"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(1.0).alias("miss"))
    state = durable(state)
    for _ in range(steps):
        rate = _rate(F.col("dual"), F.col("size"), F.col("mean"), most)
        worded = counts.join(state.select("key", "dual", "mean", "full"), "key").withColumn("_w", F.col("n") * F.col("size") * rate)
        sums = worded.groupBy("key").agg(
            F.sum("_w").alias("_sum"),
            F.sum(F.when(rate < most, F.col("_w") * F.col("size") / F.col("mean")).otherwise(0.0)).alias("_slope"))
        under = F.col("_sum") < F.col("target")
        low, high = F.when(under, F.col("dual")).otherwise(F.col("low")), F.when(under, F.col("high")).otherwise(F.col("dual"))
        newton = F.col("dual") - F.when(F.col("_slope") > 0, F.col("_sum") * F.ln(F.col("_sum") / F.col("target")) / F.col("_slope"))
        half = F.when((low > -1e5) & (high < 1e5), (low + high) / 2).when(under, F.greatest(F.lit(1.0), low * 2 + 1)).otherwise(F.least(F.lit(-1.0), high * 2 - 1))
        ready = F.col("full") | (F.col("target") <= 0) | (F.abs(F.col("_sum") / F.col("target") - 1) <= close)
        moved = F.when(ready, F.col("dual")).when((newton > low) & (newton < high), newton).otherwise(half)
        miss = F.when(F.col("full") | (F.col("target") <= 0), 0.0).otherwise(F.abs(F.col("_sum") / F.col("target") - 1))
        state = durable(state.join(sums, "key").select(
            "key", "source_size", "target", "mean", "full", moved.alias("dual"), low.alias("low"), high.alias("high"), miss.alias("miss")))
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= close:
            break
    return state.select("key", "source_size", "target", "mean", "full", F.round("dual", 9).alias("dual"))


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, partial: bool = True) -> DataFrame:
    """``documents`` (doc_id, source, text) with size, source_size, target, rate, copies and taken.

    ``copies`` are whole ones; ``taken`` are words. Rates are rounded down, then the documents whose
    hash lies furthest below their rate's fraction get one copy more until the target is met. The order
    is cut into buckets, so only sums of buckets are compared: in the bucket where the target is met each document gives the same share
    of its words (``partial``), or that share of the documents gives a whole copy. A null text has
    size 0; a null source is a source of its own; repeated rows are documents of their own; an empty
    table gives no rows. Results depend on the rows alone, so a rerun agrees.
    """
    sized = stored(documents.select("doc_id", key_of().alias("key"), F.size(words(whole())).cast("bigint").alias("size")))
    counts = durable(sized.groupBy("key", "size").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = durable(targets(sizes, weights, share, most))
    state = duals(counts, goals, most)
    uniform = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = lookup(sized, state, ["key"], ["doc_id"], "inner").withColumn("rate", _rate(F.col("dual"), F.col("size"), F.col("mean"), most))
    rated = rated.withColumn("_low", F.floor("rate")).withColumn("_bucket", F.when(
        F.col("_low") < most, F.floor((uniform(1) - (F.col("rate") - F.col("_low")) + 1) * (BUCKETS / 2))
    ).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))))  # no more copies: dealt over buckets that ask for none
    sums = rated.groupBy("key", "_bucket").agg(F.sum("size").alias("_sum"), F.sum(F.col("_low") * F.col("size")).alias("_whole"),
                                              F.first("target").alias("_target"))
    inside = Window.partitionBy("key")
    sums = sums.withColumn("_left", F.col("_target") - F.sum("_whole").over(inside)).withColumn(
        "_before", F.coalesce(F.sum(F.when(F.col("_bucket") >= 0, F.col("_sum"))).over(inside.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_left") - F.col("_before")) / F.greatest(F.col("_sum"), F.lit(1))))
    sums = sums.where("_bucket >= 0").select("key", "_bucket", part.alias("_part"))
    placed = rated.join(sums, ["key", "_bucket"], "left").withColumn("_part", F.coalesce("_part", F.lit(0.0)))
    more = F.when(F.col("_part") >= 1, 1).when(F.col("_part") <= 0, 0).otherwise((uniform(2) < F.col("_part")).cast("int"))
    words_of = F.floor(F.col("_part") * F.col("size") + 0.5) if partial else more * F.col("size")
    return placed.select(
        "doc_id", "key", "size", "source_size", "target", "rate",
        (F.col("_low") + (F.when(F.col("_part") >= 1, 1).otherwise(0) if partial else more)).cast("bigint").alias("copies"),
        (F.col("_low") * F.col("size") + words_of).cast("bigint").alias("taken"))


def copies(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them, in whole copies; a row it does not take goes.

    Copies are decided by doc_id, source and size, so rows that share these are taken alike. Rows without a word are kept once: they
    weigh nothing.
    """
    taken = mix(documents, weights, share, most, partial=False).select(F.col("doc_id").alias("_id"), "key", "size", "copies").distinct()
    sized = boxed(documents, "doc_id", key_of().alias("_key"), F.size(words(whole())).cast("bigint").alias("_size"))
    on = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("_key")) & (F.col("size") == F.col("_size"))
    times = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.coalesce("copies", F.lit(0))).cast("int")
    chosen = sized.join(taken, on, "left").select("_row", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy"))
    return unboxed(chosen, documents.columns)
