"""Merkle manifest of a table, with proofs by checkpoint and recomputation.

Leaves are digests of rows, in order within a tree. Of the tree's levels only every ``STEP``-th is
persisted: a group of 2^STEP stored nodes is an aligned subtree, which one small task folds into its root.
A proof needs the nodes in between, so proof extraction takes each aligned subtree again, from
the top of the tree down: it regenerates the missing nodes from the stored ones, emits the siblings of every
path, puts those that the level above has already given behind them, and forgets the rest.
"""
import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from turnwise.lineage import stored
from turnwise.operators.ordered import lookup

STEP = 8  # levels from one persisted level to the next; a task sees 2^STEP nodes at a time


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, or a mark for null, so that neighbours cannot be shifted."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in ``order`` within the tree from 0, and ``size``, the tree's rows.

    Rows are cut into ranges of (tree, order) and numbered in their range; one small row per tree and range carries
    on how many came before. Nulls come first. The result is stored.
    """
    sort = [tree, *order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    cut = stored(ranged).withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sums = cut.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moves = sums.select(tree, "_part", (before - F.col("_first")).alias("_move"), F.sum("_n").over(whole).alias("size"))
    placed = lookup(cut, moves, [tree, "_part"], how="inner")
    return stored(placed.select(*rows.columns, (F.col("_at") + F.col("_move")).alias("pos"), "size"))


def folded(nodes: list[str]) -> list[str]:
    """The level above: each two neighbours as one, a last one without neighbour alone."""
    return [hashlib.sha256("".join(nodes[i:i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]


def _levels(size: int, step: int) -> int:
    """Levels to fold in an aligned subtree of a tree that has ``size`` nodes here: to the next stored level or the tree's root."""
    return min(step, (size - 1).bit_length())


def _sorted(table: pa.Table) -> tuple[pa.Table, list[list[str]], np.ndarray]:
    """A subtree's nodes by place, the regenerated levels from them upwards, and their places."""
    table = table.sort_by("pos")
    return table, [table["hash"].to_pylist()], table["pos"].to_numpy()


def subtree_roots(nodes: DataFrame, step: int = STEP) -> DataFrame:
    """The next stored level of ``nodes`` (tree, pos, size, hash)."""
    def fold(table: pa.Table) -> pa.Table:
        table, levels, pos = _sorted(table)
        size, level = table["size"][0].as_py(), levels[0]
        for _ in range(_levels(size, step)):
            level = folded(level)
        return pa.table({"tree": [table["tree"][0].as_py()], "pos": pa.array([int(pos[0]) >> step], pa.int64()),
                         "size": pa.array([-(-size >> step)], pa.int64()), "hash": level})

    block = F.shiftright("pos", step)
    return nodes.select("tree", "pos", "size", "hash").groupBy("tree", block.alias("_block")).applyInArrow(fold, "tree string, pos bigint, size bigint, hash string")


def stored_levels(leaves: DataFrame, step: int = STEP) -> list[DataFrame]:
    """``leaves`` (tree, pos, size, hash, ...) and each persisted level above them; the last one has the roots."""
    most = leaves.agg(F.max("size")).first()[0] or 1
    levels = [leaves]
    while most > 1:
        levels.append(stored(subtree_roots(levels[-1], step)))
        most = -(-most >> step)
    return levels


def _padded(flat: pa.Array, rows: int, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), flat)


def _proved(nodes: DataFrame, above: DataFrame, carried: Sequence[str], step: int) -> DataFrame:
    """``nodes`` with their proofs, given those of the next stored level (tree, pos, before, after, carried columns)."""
    kept = nodes.columns
    texts = ArrayType(StringType())
    schema = StructType([*nodes.schema.fields, StructField("before", texts), StructField("after", texts), *[StructField(c, StringType()) for c in carried]])

    def extract(table: pa.Table, known: pa.Table) -> pa.Table:
        table, levels, pos = _sorted(table)
        count = _levels(table["size"][0].as_py(), step)
        for _ in range(count - 1):
            levels.append(folded(levels[-1]))
        base = (int(pos[0]) >> step) << step
        sides = []
        for shift in (-1, 1):  # the sibling to the left of odd places, to the right of even ones
            columns = []
            for k in range(count):
                at = (pos - base) >> k
                there = at + shift
                wanted = ((at & 1) == (shift < 0)) & (there < len(levels[k]))
                names = pa.array([*levels[k], ""])
                columns.append(names.take(pa.array(np.where(wanted, there, len(levels[k])))).to_numpy(zero_copy_only=False))
            far = known["before" if shift < 0 else "after"][0].as_py()
            columns += [np.full(table.num_rows, name, dtype=object) for name in far]
            flat = np.stack(columns, axis=1).ravel() if columns else np.zeros(0, dtype=object)
            sides.append(_padded(pa.array(flat, pa.string()), table.num_rows, len(columns)))
        out = table.select(kept).append_column("before", sides[0]).append_column("after", sides[1])
        for name in carried:
            out = out.append_column(name, pa.array([known[name][0].as_py()] * table.num_rows, pa.string()))
        return out

    blocked = nodes.withColumn("_block", F.shiftright("pos", step)).groupBy("tree", "_block")
    return blocked.cogroup(above.withColumnRenamed("pos", "_block").groupBy("tree", "_block")).applyInArrow(extract, schema)


def proofs(levels: list[DataFrame], top: DataFrame, carried: Sequence[str], step: int = STEP) -> DataFrame:
    """The rows of ``levels[0]`` with ``before`` and ``after``: per level from the leaf on the sibling on either side, '' for none.

    ``top`` (tree, pos, before, after, carried columns) says how each tree's root goes on; the carried columns are given to every row.
    """
    for at, nodes in enumerate(reversed(levels[:-1])):
        last = at == len(levels) - 2
        top = _proved(nodes if last else nodes.select("tree", "pos", "size", "hash"), top, carried, step)
        if not last:
            top = stored(top.select("tree", "pos", "before", "after", *carried))
    if len(levels) == 1:
        top = levels[0].join(top, ["tree", "pos"])
    return top


def fold_proof(start: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.arrays_zip(before.alias("b"), after.alias("a")), start, lambda h, s: digest(s["b"], h, s["a"]))


def siblings(before: Column, after: Column) -> Column:
    """The siblings of a proof from the leaf on; levels without one give nothing."""
    return F.transform(F.arrays_zip(before.alias("b"), after.alias("a")), lambda s: F.concat(s["b"], s["a"]))


def manifest(leaves: DataFrame, order: Sequence[str], step: int = STEP) -> DataFrame:
    """Every row of ``leaves`` (tree, hash, ...) with pos, size, subroot, root and its proof (before, after).

    Rows make a binary tree per ``tree``, in ``order`` and then by hash, and the roots of the trees, in order of ``tree``, make
    one more. ``tree`` must not be null. Null order values come first; rows that are equal are leaves of their own, and which of
    them comes first changes nothing. A tree of one row is that row. An empty table gives no rows.
    """
    low = stored_levels(numbered(leaves, "tree", [*order, "hash"]), step)
    roots = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("_of"), "hash")
    high = stored_levels(numbered(roots, "tree", ["_of"]), step)
    none = F.array().cast("array<string>")
    start = high[-1].select("tree", "pos", none.alias("before"), none.alias("after"), F.col("hash").alias("root"))
    paths = stored(proofs(high, start, ["root"], step))
    top = paths.select(F.col("_of").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "before", "after", F.col("hash").alias("subroot"), "root")
    return proofs(low, top, ["subroot", "root"], step)


def lang_key(lang: Column) -> Column:
    """The tree of a language: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("s"), lang), F.lit("n"))


def verify_documents(documents: DataFrame, step: int = STEP) -> DataFrame:
    """Manifest of ``documents`` (doc_id, source, lang, n_chars, text) and what a check finds after tampering.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Rows whose id's crc32 is a multiple of 7 are tampered with: their
    length is one more. Nulls are part of a leaf; a row without doc_id comes first in its language and stays as it is, as does a
    row without n_chars. Repeated rows are leaves of their own. Languages are trees, a null one among them. An empty table
    gives no rows; other columns are not part of a leaf.
    """
    doc_id, n_chars = F.col("doc_id").cast("bigint"), F.col("n_chars").cast("bigint")
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    hashed = lambda n: leaf(doc_id, F.col("source"), F.col("lang"), n, F.col("text"))
    leaves = stored(documents.select(doc_id.alias("doc_id"), lang_key(F.col("lang")).alias("tree"), hashed(n_chars).alias("hash"),
                                     F.when(tampered & n_chars.isNotNull(), hashed(n_chars + 1)).alias("tampered")))
    proved = manifest(leaves, ["doc_id"], step)
    found = proved.withColumn("folded_root", fold_proof(F.coalesce("tampered", "hash"), F.col("before"), F.col("after")))
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root",
                        digest(F.array_join(siblings(F.col("before"), F.col("after")), "")).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))




#: DuckDB SQL for the rows of ``verify_documents``; the innermost list adds up a crc32 byte by byte.
SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *, coalesce('s' || lang, 'n') AS tree, doc_id::VARCHAR AS id, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384))) AS crc FROM documents),
f AS (SELECT *, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  coalesce(strlen(text) || ':' || text, '-') AS b, n_chars::VARCHAR AS n, (n_chars + 1)::VARCHAR AS m FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
  SELECT r, doc_id, tree, sha256(a || coalesce(strlen(n) || ':' || n, '-') || b) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(a || coalesce(strlen(m) || ':' || m, '-') || b) END AS tampered FROM f)),
up(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM l
  UNION ALL SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 2),
s AS (SELECT tree, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
hi(lvl, pos, h, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM s
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM hi WHERE n > 1 GROUP BY lvl, pos // 2),
top AS (SELECT h AS root, lvl AS height FROM hi WHERE n = 1),
k AS (SELECT r, l.tree, i.lvl, l.pos >> i.lvl AS spot FROM l JOIN s ON s.tree = l.tree, (SELECT unnest(range(64)) AS lvl) i WHERE i.lvl < depth),
g AS (SELECT l.r, s.depth + i.lvl AS lvl, s.pos >> i.lvl AS spot, i.lvl AS high FROM l JOIN s ON s.tree = l.tree, top, (SELECT unnest(range(64)) AS lvl) i WHERE i.lvl < height),
p AS (SELECT r, k.lvl, spot, h AS sib FROM k LEFT JOIN up ON up.tree = k.tree AND up.lvl = k.lvl AND up.pos = xor(spot, 1)
  UNION ALL SELECT r, g.lvl, spot, h FROM g LEFT JOIN hi ON hi.lvl = high AND hi.pos = xor(spot, 1)),
fold(r, lvl, h) AS (
  SELECT r, 0, coalesce(tampered, leaf) FROM l
  UNION ALL SELECT fold.r, fold.lvl + 1, sha256(CASE WHEN spot % 2 = 1 THEN coalesce(sib, '') || h ELSE h || coalesce(sib, '') END)
  FROM fold JOIN p ON p.r = fold.r AND p.lvl = fold.lvl),
q AS (SELECT r, string_agg(sib, '' ORDER BY lvl) AS sibs FROM p GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(sibs, '')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM l JOIN s ON s.tree = l.tree CROSS JOIN top JOIN fold ON fold.r = l.r AND fold.lvl = depth + height LEFT JOIN q ON q.r = l.r
"""
