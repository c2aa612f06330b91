"""Small helpers the operators share."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the word-based operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text in order; empty for a text without one."""
    parts = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")
    return F.array_compact(F.transform(parts, lambda w: F.when(w != "", w)))


def boxed(df: DataFrame, *names: str) -> DataFrame:
    """Rows as ``_row`` beside copies of the named columns, so that columns an operator adds meet no other of their name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *names)


def unboxed(df: DataFrame, columns: Sequence[str], **changed: Column) -> DataFrame:
    """The columns of the boxed rows, some of them changed."""
    return df.select(*[(changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in columns])


def running_start(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, start: str,
                  bucket: Column, coarse: Column) -> DataFrame:
    """Add ``start``: the sum of ``size`` over the earlier rows of the key.

    Rows are ordered by (``bucket``, ``order``). Only one bucket's rows meet in a task; the sums of
    buckets run on per coarse bucket, and those of coarse buckets per key, so a key of any size
    is spread. ``bucket`` must grow with ``order`` and ``coarse`` with ``bucket``.
    """
    keys, order = list(keys), list(order)
    cut = df.withColumns({"_b": bucket}).withColumn("_c", coarse)
    sums = cut.groupBy(*keys, "_c", "_b").agg(F.sum(size).alias("_s"))
    far = sums.groupBy(*keys, "_c").agg(F.sum("_s").alias("_s"))
    before = lambda by, at: Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    far = far.select(*keys, "_c", F.coalesce(F.sum("_s").over(before(keys or [F.lit(0)], ["_c"])), F.lit(0)).alias("_from"))
    near = sums.join(far, [*keys, "_c"]).select(
        *keys, "_c", "_b", (F.col("_from") + F.coalesce(F.sum("_s").over(before([*keys, "_c"], ["_b"])), F.lit(0))).alias("_from"))
    inside = F.coalesce(F.sum(size).over(before([*keys, "_c", "_b"], order)), F.lit(0))
    return (cut.withColumn(start, inside).join(near, [*keys, "_c", "_b"])
            .withColumn(start, F.col(start) + F.col("_from")).drop("_b", "_c", "_from"))
