"""Cutting sessions into chunks of about n lines, never inside a session."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.lineage import durable
from turnwise.operators.ordered import carry, range_segments

REACH = 1 << 20


def chunk_assign(sizes: DataFrame, n: int, shelf: str = "project", session: str = "session") -> DataFrame:
    """Chunk number and line range of every session.

    ``sizes``: shelf, session, lines (1 or more), one row per session. Sessions are taken in order;
    a chunk closes at the first session change at which it holds ``n`` lines or more. Each session
    knows where the next chunk would start if one started at it; following these links from line 0,
    twice as far each round, marks the starts. No task sees more than a segment of a shelf.
    """
    if n < 1:
        raise ValueError("a chunk takes 1 line or more")
    cut = range_segments(sizes.select(shelf, session, F.col("lines").cast("bigint").alias("lines")), [shelf, session])
    placed = carry(cut, [shelf], [session], F.col("_seg"), total={"_upto": F.col("lines")})
    placed = durable(placed.select(shelf, session, "lines", "_seg", (F.col("_upto") - F.col("lines")).alias("start")))

    # The first start at or after start + n: scan downwards, points before questions at the same line.
    points = placed.select(shelf, "start", (-F.col("start")).alias("_v"), F.lit(0).alias("_ask"))
    asks = placed.select(shelf, "start", (-(F.col("start") + n)).alias("_v"), F.lit(1).alias("_ask"))
    scan = carry(points.unionByName(asks), [shelf], ["_v", "_ask", "start"], F.floor(F.col("_v") / REACH),
                 last={"next": F.when(F.col("_ask") == 0, F.col("start"))})
    jump = durable(scan.where("_ask = 1 and next is not null").select(shelf, "start", "next"))

    starts = durable(placed.where("start = 0").select(shelf, "start"))
    while not jump.isEmpty():
        landed = starts.join(jump, [shelf, "start"]).select(shelf, F.col("next").alias("start"))
        starts = durable(starts.unionByName(landed).distinct())
        far = jump.select(shelf, F.col("start").alias("next"), F.col("next").alias("_far"))
        jump = durable(jump.join(far, [shelf, "next"]).select(shelf, "start", F.col("_far").alias("next")))

    marked = placed.join(starts.withColumn("_first", F.lit(1)), [shelf, "start"], "left")
    numbered = carry(marked, [shelf], [session], F.col("_seg"), total={"_chunk": F.coalesce("_first", F.lit(0))})
    return numbered.select(shelf, session, "lines", "start", (F.col("_chunk") - 1).alias("chunk"))


def chunk_ranges(assigned: DataFrame, shelf: str = "project") -> DataFrame:
    """First and last line of each chunk, counted from 1."""
    return assigned.groupBy(shelf, "chunk").agg(
        (F.min("start") + 1).alias("first_line"), F.max(F.col("start") + F.col("lines")).alias("last_line"),
        F.count("*").alias("sessions"))
