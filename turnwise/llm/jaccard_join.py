"""N-gram Jaccard join over parity sketches.

A document's set holds its distinct word shingles as 64-bit hashes. Shingles are dealt over segments
by hash, and each segment keeps the XOR of its shingles. Two sets that differ in d shingles differ in d
segments at most, so by pigeonhole two sets close enough agree in a segment whenever there are more
segments than allowed differences. Segment counts belong to bands of set sizes; a set is sketched for each band
in which it may have a partner. Equal (band, segment, XOR) keys give candidates, one bit per shingle gives
a sketch whose Hamming distance is at most the difference and rejects most of the rest, and the sets decide.

Within a key's bucket all sets are compared to one leader, the set with the most matches, never all with
all. Only buckets that are still in several components afterwards compare their sets in blocks.
"""
from collections.abc import Callable, Iterator
from functools import cache
from math import ceil, exp, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.lineage import durable, removed, stored
from turnwise.llm.common import boxed, unboxed, whole

SHINGLE = 4  # words
ALIKE, OF = 85, 100  # linked from OF * intersection >= ALIKE * union
RATIO = 1.5  # sizes of a band
SEEDS = 8  # deals tried before a set with too many empty segments meets its like directly
SKETCH = 1024  # bits; sets of more shingles also have a wide sketch
BLOCK = 256  # sets of a block in the last comparison
FEW = 4_000_000  # ids of 8 bytes each that are broadcast at most
FEW_NODES = 500_000  # nodes with their labels that are broadcast at most

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; with fewer words the whole sequence is one; empty without words."""
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in text.lower().split()], dtype=np.uint64)
    n = len(hashes)
    if n == 0:
        return hashes
    take = min(width, n)
    total = np.full(n - take + 1, take, dtype=np.uint64)
    for k in range(take):
        total = _mixed(total * _ODD[k % 4] + hashes[k:k + n - take + 1])
    return np.unique(total)


def bands(alike: int = ALIKE, of: int = OF, ratio: float = RATIO) -> Iterator[tuple[int, int, int, int]]:
    """(first size, past the last size of the smaller set, last size of the larger, differences allowed), without end."""
    low = 1
    while True:
        high = max(low + 1, int(low * ratio))
        smaller = high - 1
        # a partner of x has at most x * of / alike shingles; a pair differs in at most (of - alike) / (of + alike) of both
        allowed = max((of - alike) * (x + x * of // alike) // (of + alike) for x in range(max(low, smaller - 1), high))
        yield low, high, smaller * of // alike, allowed
        low = high


@cache
def _segments(largest: int, allowed: int) -> int:
    """Segments of a band: enough that a set of ``largest`` shingles seldom fills no more than ``allowed`` of them.

    Of S segments S exp(-largest / S) are empty on average; three deviations more are left room for. Where no number of segments
    leaves it, as in the lowest bands, sets are dealt anew more often.
    """
    for segments in range(allowed + 3, 2 * max(largest, allowed) + 4):
        empty = segments * exp(-largest / segments)
        if segments - empty - 3 * sqrt(empty) >= allowed + 1:
            return segments
    return allowed + 3 + allowed // 24


_known: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
_more: dict[tuple[int, int], Iterator[tuple[int, int, int, int]]] = {}


def _bands_of(n: int, alike: int = ALIKE, of: int = OF) -> list[tuple[int, int, int]]:
    """(band, segments, differences from n's partners there) of the bands in which a set of n shingles may have an unequal partner."""
    known, more = _known.setdefault((alike, of), []), _more.setdefault((alike, of), bands(alike, of))
    while not known or known[-1][0] <= n:
        known.append(next(more))
    out = []
    for i, (low, high, last, allowed) in enumerate(known):
        # the band's smaller set is n itself, or one below its end
        differ = (of - alike) * (n + (n * of // alike if n < high else high - 1)) // (of + alike)
        if low <= n <= last and differ > 0:
            out.append((i, _segments(high - 1, allowed), differ))
    return out


def segment_keys(shingles: np.ndarray, alike: int = ALIKE, of: int = OF) -> np.ndarray:
    """Keys of which two linked, unequal sets share at least one.

    Of S segments at least S - D agree if the sets differ in D shingles, and of these at least F - D are filled, F being the filled
    ones of either. So many common keys lie among the first D + 1 of both in any order that both share, here that of
    their hashes, and no others are kept. A set that fills fewer segments than that is dealt again with the next seed; the first deal
    in which one of the two fills enough has a key of both.
    """
    keys = []
    for band, segments, differ in _bands_of(len(shingles), alike, of):
        for seed in range(SEEDS):
            dealt = _mixed(shingles + _ODD[:1] * np.uint64(seed + 1))
            place = (dealt % np.uint64(segments)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, values = place[order], dealt[order]
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            parity = np.bitwise_xor.reduceat(values, starts)
            tag = np.uint64((band * SEEDS + seed) << 32) + place[starts].astype(np.uint64)
            made = _mixed(parity + _mixed(tag + np.uint64(1)) * _ODD[1])
            keys.append(np.partition(made, differ)[:differ + 1] if len(made) > differ + 1 else made)
            if len(starts) > differ:
                break
        else:
            keys.append(_mixed(np.array([(band << 32) + 0xFFFFFFFF], dtype=np.uint64)))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def bit_sketch(shingles: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """``bits`` bits; each shingle flips one, so the Hamming distance of two sketches is at most the sets' difference."""
    at = (_mixed(shingles ^ _ODD[2]) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide_sketch(shingles: np.ndarray) -> np.ndarray | None:
    """For more than SKETCH shingles, a sketch of a power of two of bits, one per shingle at least; its halves, XORed, are the sketch of half as many bits.

    In SKETCH bits the distance of two sets that differ in many more shingles is about SKETCH / 2 whether they are linked or not.
    """
    return bit_sketch(shingles, 1 << (len(shingles) - 1).bit_length()) if len(shingles) > SKETCH else None


def _set_id(shingles: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sketched(width: int, alike: int, of: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, sizes, sets, sketches, wide, keys = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = shingle_set(text, width)
                ids.append(doc_id)
                sizes.append(len(found))
                sets.append(_set_id(found) if len(found) else None)
                sketches.append(bit_sketch(found))
                wide.append(wide_sketch(found))
                keys.append(segment_keys(found, alike, of).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()),
                pa.array(sketches, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())),
                pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set", "sketch", "wide", "keys"])
    return batches


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [shingle_set(t, width) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([_set_id(f) for f in found], pa.int64()),
                pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["set", "shingles"])
    return batches


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of ``links``; label is the smallest node reachable.

    Each round takes the smallest label next door and then the label's own label, so chains shorten
    by halves and stars end at once.
    """
    both = durable(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(
        links.select(F.col(b), F.col(a))).where(F.col("node") != F.col("other")).distinct())
    labels = durable(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    nodes = labels.count()
    near = F.broadcast if nodes <= FEW_NODES else lambda table: table
    # each round starts several jobs, and the driver keeps a record of every task: few rows are read in few tasks
    dealt = lambda table: table.coalesce(max(16, nodes // 100_000))
    both, labels = dealt(both), dealt(labels)
    while True:
        least = both.join(near(labels.select(F.col("node").alias("other"), F.col("label").alias("_l"))), "other").groupBy("node").agg(F.min("_l").alias("_near"))
        nearer = least.join(near(labels), "node").select("node", "label", F.least("label", "_near").alias("_to"))
        ends = labels.select(F.col("node").alias("_to"), F.col("label").alias("_end"))
        moved = durable(dealt(nearer.join(near(ends), "_to").select("node", F.least("_to", "_end").alias("new"), "label")))
        changed = moved.where("new <> label").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _alike(inter, left, right, alike, of):
    return of * inter >= alike * (left + right - inter)


def _few(ids: DataFrame) -> DataFrame:
    """The ids, to be broadcast if their number shows that they take little memory; else joined as Spark sees fit."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def _halved(sketch: Column, words: Column) -> Column:
    """The sketch of half as many bits if it has more than ``words`` words."""
    half = F.size(sketch) / 2
    return F.when(F.size(sketch) > words, F.zip_with(
        F.slice(sketch, F.lit(1), half.cast("int")), F.slice(sketch, (half + 1).cast("int"), half.cast("int")), lambda x, y: x.bitwiseXOR(y))).otherwise(sketch)


def _verified(pairs: DataFrame, sizes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], alike: int, of: int) -> DataFrame:
    """The pairs (a, b) of sets that are linked; the sketch's bound comes first, and only sets it lets through are fetched."""
    best = F.coalesce("wide", "sketch")
    one = sizes.select(F.col("set").alias("a"), F.col("n_shingles").alias("n_a"), best.alias("s_a"))
    two = sizes.select(F.col("set").alias("b"), F.col("n_shingles").alias("n_b"), best.alias("s_b"))
    met = pairs.join(one, "a").join(two, "b").where(of * F.least("n_a", "n_b") >= alike * F.greatest("n_a", "n_b"))
    for _ in range(ceil(log2(of / alike))):  # sizes that pass are at most this often doubled
        met = met.withColumns({"s_a": _halved(F.col("s_a"), F.size("s_b")), "s_b": _halved(F.col("s_b"), F.size("s_a"))})
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = stored(met.where((of + alike) * apart <= (of - alike) * (F.col("n_a") + F.col("n_b"))).select("a", "b", "n_a", "n_b"))
    needed = stored(near.select(F.col("a").alias("set")).union(near.select("b")).distinct())
    sets = sets_of(needed)
    inter = F.size(F.array_intersect("_x", "_y"))
    linked = durable(near.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("_x")), "a")
                     .join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("_y")), "b")
                     .where(_alike(inter, F.col("n_a"), F.col("n_b"), alike, of)).select("a", "b").distinct())
    removed(near, needed)
    return linked


def _block_pairs(pdf: pd.DataFrame, alike: int = ALIKE, of: int = OF) -> pd.DataFrame:
    """Pairs between the two sides of a block that are in different components and that sizes and sketches allow to be linked."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    bits = np.stack([np.asarray(s, dtype=np.int64) for s in left["sketch"]]).view(np.uint64)
    size, comp, name = (left[c].to_numpy() for c in ("n_shingles", "label", "set"))
    out = []
    for mine, n, label, other in zip(right["sketch"], right["n_shingles"], right["label"], right["set"], strict=True):
        apart = np.bitwise_count(bits ^ np.asarray(mine, dtype=np.int64).view(np.uint64)).sum(axis=1, dtype=np.int64)
        good = ((of + alike) * apart <= (of - alike) * (size + n)) & (of * np.minimum(size, n) >= alike * np.maximum(size, n)) & (comp != label)
        out += [(int(a), int(other)) for a in name[good]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _rest(buckets: DataFrame, classes: DataFrame, alike: int, of: int) -> DataFrame:
    """Candidates (a, b) that leaders have not met: in each leader's circle, the sketches outside its largest
    component are compared in blocks with all others of the circle. buckets: leader, set, label."""
    circle = buckets.select("leader", "set", "label").distinct()
    counts = circle.groupBy("leader", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("leader").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    marked = circle.join(main, "leader").withColumn("few", F.col("label") != F.col("m.label"))
    blocks_few = F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int")
    blocks_all = F.ceil(F.col("all") / BLOCK).cast("int")
    at = lambda n: F.pmod(F.xxhash64("set"), n).cast("int")
    sides = (marked.where("few").select("leader", "set", "label", F.lit(0).alias("side"), at(blocks_few).alias("f"),
                                        F.explode(F.sequence(F.lit(0), blocks_all - 1)).alias("c"))
             .union(marked.select("leader", "set", "label", F.lit(1).alias("side"),
                                  F.explode(F.sequence(F.lit(0), blocks_few - 1)).alias("f"), at(blocks_all).alias("c")).select("leader", "set", "label", "side", "f", "c")))
    rows = sides.join(classes.select("set", "n_shingles", "sketch"), "set")
    pairs = rows.groupBy("leader", "f", "c").applyInPandas(lambda pdf: _block_pairs(pdf, alike, of), "a bigint, b bigint")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join_alike(documents: DataFrame, width: int = SHINGLE, alike: int = ALIKE, of: int = OF) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``documents`` (doc_id, text).

    Sets of shingles of ``width`` words are linked from a Jaccard similarity of ``alike`` / ``of``.

    component_id is the smallest doc_id reachable over links. A document without a word has no shingles and is linked with
    nothing, so it is its own component, as is a null text. Equal sets are one class, so copies and repeated
    rows are never paired. A row without doc_id takes part in links; it has the component of the
    others and null if there are none. An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    found = stored(docs.mapInArrow(
        _sketched(width, alike, of), "doc_id bigint, n_shingles bigint, set bigint, sketch array<bigint>, wide array<bigint>, keys array<bigint>"))

    keyed = found.where(F.col("set").isNotNull()).select("set", F.explode("keys").alias("key"))
    bucket = Window.partitionBy("key")
    shared = stored(keyed.withColumn("_least", F.min("set").over(bucket)).withColumn("_most", F.max("set").over(bucket))
                    .where("_least <> _most").select("key", "set").distinct())
    sketched = stored(found.drop("keys"))
    removed(found)  # nearly as many bytes as the documents
    sizes_of = shared.groupBy("key").agg((F.count("*") - 1).alias("_met"))
    fame = shared.join(sizes_of, "key").groupBy("set").agg(F.sum("_met").alias("fame"))
    led = shared.join(fame, "set")
    leaders = led.groupBy("key").agg(F.max(F.struct("fame", "set")).alias("m")).select(
        "key", F.col("m.set").alias("leader"), F.col("m.fame").alias("lead"))
    circles = stored(shared.join(leaders, "key"))
    removed(shared)

    wanted = circles.select("set").distinct()
    classes = (sketched.join(wanted, "set").groupBy("set").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")))
    classes = stored(classes)

    def sets_of(needed: DataFrame) -> DataFrame:
        """The shingles of the needed sets, made anew from one document of each: kept for all classes they would take as much disk as the texts."""
        near = F.broadcast if needed.count() <= FEW else lambda ids: ids
        named = docs.join(near(classes.join(near(needed), "set", "left_semi").select("doc_id")), "doc_id", "left_semi")
        texts = named.unionByName(docs.where(F.col("doc_id").isNull()))  # a set may only be in rows without doc_id
        made = texts.select("text").mapInArrow(_sets(width), "set bigint, shingles array<bigint>")
        return made.join(near(needed), "set", "left_semi").dropDuplicates(["set"])

    best = circles.groupBy("set").agg(F.max(F.struct("lead", "leader")).alias("m")).select(F.col("set").alias("a"), F.col("m.leader").alias("b")).where("a <> b")
    links = _verified(best, classes, sets_of, alike, of)
    labels = components(links)

    def open_circles(labels: DataFrame) -> DataFrame:
        """Rows of buckets that are still in several components."""
        named = circles.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
        split = named.groupBy("key").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).where("_x <> _y").select("key")
        return named.join(split, "key", "left_semi")

    still = durable(open_circles(labels).select("leader", "set", "label").distinct())
    if not still.isEmpty():
        lead_label = still.where("leader = set").select("leader", F.col("label").alias("_lead"))
        second = still.join(lead_label, "leader").where("label <> _lead").select(F.col("set").alias("a"), F.col("leader").alias("b"))
        more = _verified(second.join(best, ["a", "b"], "left_anti").distinct(), classes, sets_of, alike, of)
        if not more.isEmpty():
            links = durable(links.union(more))
            labels = components(links)
            still = durable(open_circles(labels).select("leader", "set", "label").distinct())
        last = _verified(_rest(still, classes, alike, of), classes, sets_of, alike, of)
        if not last.isEmpty():
            labels = components(links.union(last))

    rows = sketched.select("doc_id", "n_shingles", "set").join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = stored(rows.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
    removed(sketched, circles, classes)
    return named


def one_of_each(documents: DataFrame, width: int = SHINGLE, alike: int = ALIKE, of: int = OF) -> DataFrame:
    """``documents`` without all but the smallest doc_id of each component; a row that is repeated stays once.

    Documents without a word stay, and so do rows without doc_id.
    """
    fate = join_alike(documents, width, alike, of).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    odd = stored(fate.where(~F.col("stays") | (F.col("n") > 1)))  # few beside the rows that stay as they are, whose texts need not move
    named = boxed(documents.where(F.col("doc_id").isNotNull()), "doc_id")
    repeated = named.join(_few(odd.where("stays").select("doc_id")), "doc_id", "left_semi")
    first = repeated.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("_row"))).where("_nth = 1").drop("_nth")
    once = named.join(_few(odd.select("doc_id")), "doc_id", "left_anti")
    return unboxed(once.unionByName(first), documents.columns).unionByName(documents.where(F.col("doc_id").isNull()))
