"""Document fingerprints by consistent weighted sampling.

A document's terms are its word shingles, weighted by their counts. A weight is cut into pieces of at most
one, (term, 0), (term, 1) and so on, which leaves generalised Jaccard similarity as it is and keeps a heavy
term from filling a bin. Each piece draws two Gamma(2, 1) values and an offset from its own hash; they give its level and its rank, and
the piece of least rank is a sample that two documents share with the probability of
their generalised Jaccard similarity. Pieces are dealt over ``BINS`` bins and each bin keeps its own sample, so
a piece is drawn once, not once per sample. A bin without terms takes the sample of the next filled bin,
changed by its distance, so that two empty bins agree if the bins that they borrow from do.

All of it is column expressions; ``_let`` evaluates a value once and names it.
"""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.lineage import new_folder
from turnwise.llm.common import whole, words

SHINGLE = 5  # words
BINS = 128  # a power of two
BITS = 15  # of a sample in the fingerprint
BLOCK_BITS = 12  # doc_ids of a block share all bits but these


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(text: Column, width: int = SHINGLE) -> Column:
    """Sorted hashes of the shingles, repeats kept; with fewer words the whole sequence is one term; none without a word."""
    def cut(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) >= width, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(_let(F.transform(words(text), lambda w: F.xxhash64(w)), cut))


def _uniform(bits: Column, part: int) -> Column:
    """One of the three 21-bit parts of a hash, in (0, 1)."""
    return (F.shiftrightunsigned(bits, 21 * part).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / float(1 << 21)


def _sample(piece: Column, bins: int) -> Column:
    """bin, rank and mark of one piece of weight one, packed so that order is by bin, then rank.

    With r and c from Gamma(2, 1) and a uniform offset beta, weight w has the level t = floor(ln w / r + beta) and the rank
    ln c - r (t - beta) - r. A piece weighs one, so its level is 0.
    """
    def packed(h: Column) -> Column:
        r = -F.ln(_uniform(h["a"], 0) * _uniform(h["a"], 1))
        c = -F.ln(_uniform(h["a"], 2) * _uniform(h["b"], 0))
        rank = F.ln(c) - r * (1 - _uniform(h["b"], 1))
        place = F.floor((F.greatest(F.lit(-95.0), rank) + 96) * float(1 << 26))
        rest = F.shiftrightunsigned(h["b"], 42)
        return F.shiftleft(rest.bitwiseAND(F.lit(bins - 1)), 33 + BITS) + F.shiftleft(place, BITS) + F.shiftrightunsigned(rest, 22 - BITS)

    return _let(F.struct(F.xxhash64(F.lit(1), piece).alias("a"), F.xxhash64(F.lit(2), piece).alias("b")), packed)


def samples(text: Column, bins: int = BINS, width: int = SHINGLE) -> Column:
    """The sample of each bin; an empty array for a text without a word."""
    def weighted(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        def pieces(f: Column) -> Column:
            weight = lambda at, k: F.coalesce(F.get(f, k + 1), F.size(s)) - at
            heavy = F.filter(F.transform(f, lambda at, k: F.struct(F.get(s, at).alias("t"), weight(at, k).alias("w"))), lambda x: x["w"] > 1)
            more = F.transform(heavy, lambda x: F.transform(F.sequence(F.lit(1), x["w"] - 1), lambda j: _sample(F.xxhash64(x["t"], j), bins)))
            firsts = F.transform(f, lambda at: _sample(F.get(s, at), bins))
            return F.sort_array(F.when(F.size(f) < F.size(s), F.concat(firsts, F.flatten(more))).otherwise(firsts))

        return _let(first, pieces)

    def least(p: Column) -> Column:
        return F.filter(p, lambda x, k: (k == 0) | (F.shiftright(x, 33 + BITS) != F.shiftright(F.get(p, k - 1), 33 + BITS)))

    def filled(kept: Column) -> Column:
        """Each bin's mark; a bin without one takes the next filled bin's, changed by how far that is, the last ones the first's."""
        at = lambda x: F.shiftright(x, 33 + BITS).cast("int")
        lent = lambda x, far: F.transform(F.sequence(far, F.lit(0)), lambda t: (
            x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + t * 40503) % (1 << BITS))
        runs = F.transform(kept, lambda x, k: lent(x, at(x) - F.coalesce(at(F.get(kept, k - 1)) + 1, F.lit(0))))
        over = F.lit(bins - 1) - at(F.element_at(kept, -1))
        first = F.get(kept, F.lit(0))
        rest = F.when(over > 0, F.slice(lent(first, at(first) + over), 1, over)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.flatten(runs), rest)

    none = F.array().cast("array<int>")
    return _let(terms(text, width), lambda s: F.when(F.size(s) > 0, _let(_let(weighted(s), least), filled)).otherwise(none))


def fingerprint(sampled: Column) -> Column:
    """Samples as a string of four hexadecimal digits each."""
    return F.array_join(F.transform(sampled, lambda m: F.lpad(F.lower(F.hex(m)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without a word, 0 for one."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda t, x: t + x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(same / F.size(a).cast("double"))


def edited_text(text: Column, n_chars: Column, after: Column) -> Column:
    """The last third replaced by as much of the start of the next text."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars.cast("int") - third), F.substring(after, F.lit(1), third))


def _compared(df: DataFrame) -> DataFrame:
    """Result columns of rows that know the next text and its samples; null where these are."""
    edited = df.withColumn("_edited", edited_text(F.col("text"), F.col("n_chars"), F.col("_after")))
    edited = edited.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256)).withColumn("_edited", samples(whole("_edited")))
    known = F.col("_after").isNotNull()
    return edited.withColumns({
        "fingerprint": fingerprint(F.col("_own")), "edited_fingerprint": F.when(known, fingerprint(F.col("_edited"))),
        "near_edited": F.when(known, likeness(F.col("_own"), F.col("_edited"))),
        "near_next": F.when(known, likeness(F.col("_own"), F.col("_next")))})


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _blocks_before(blocks: DataFrame) -> DataFrame:
    """(block, before): the next smaller block there is, for the smallest the largest. Ordered within runs of 4096 blocks, and runs by their ends."""
    coarse = blocks.withColumn("_run", F.shiftright("block", 12))
    ends = coarse.groupBy("_run").agg(F.max("block").alias("_top"))
    down = Window.orderBy(F.desc("_run"))
    ends = ends.select("_run", F.coalesce(F.lead("_top").over(down), F.max("_top").over(Window.partitionBy(F.lit(0)))).alias("_below"))
    inside = Window.partitionBy("_run").orderBy(F.desc("block"))
    return coarse.join(ends, "_run").select("block", F.coalesce(F.lead("block").over(inside), F.col("_below")).alias("before"))


def compare_with_next(documents: DataFrame) -> DataFrame:
    """RESULT of each row of ``documents`` (doc_id, text), compared with its edited text and the next document.

    Next is the one with the next smaller doc_id, for the smallest the largest; rows of one doc_id follow
    each other by the hash of their text; rows without doc_id come last. A null text is empty. A single row is its own next. An empty
    table gives no rows. Rows meet in blocks of doc_ids, each with its texts in one task; only the ends of
    blocks meet across blocks.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    docs = docs.withColumns({
        "n_chars": F.char_length("text").cast("bigint"), "_own": samples(F.col("text")),
        "block": F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(-(1 << 52)))})
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    near = docs.withColumns({"_after": F.lead("text").over(order), "_next": F.lead("_own").over(order), "_place": F.row_number().over(order)})
    inner = _compared(near).withColumn("text", F.when(F.col("_after").isNull() | (F.col("_place") == 1), F.col("text")))
    path = new_folder(spark, "fingerprints")
    inner.select("block", "_place", "text", F.col("_after").isNull().alias("_tail"), *RESULT).write.option("compression", "zstd").parquet(path)
    done = spark.read.parquet(path)

    heads = done.where("_place = 1").select(F.col("block").alias("before"), F.col("text").alias("_after"), samples(F.col("text")).alias("_next"))
    tails = done.where("_tail").select("block", "doc_id", "n_chars", "text", samples(F.col("text")).alias("_own"))
    ends = tails.join(_blocks_before(done.where("_place = 1").select("block")), "block").join(heads, "before")
    return done.where("not _tail").select(*RESULT).union(_compared(ends).select(*RESULT))
