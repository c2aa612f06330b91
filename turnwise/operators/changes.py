"""Checks of a change: what moved, what was added, what was lost."""
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.code import cut_blocks, first_lost_line, strip_imports, tidy_lines
from turnwise.functions.rules import any_match, matching
from turnwise.functions.text import unroll
from turnwise.operators.ordered import lookup

OLD, NEW = "old", "new"


def blocks(files: DataFrame) -> DataFrame:
    """One row per block of a file version. ``files``: rev ('old' or 'new'), path, text.

    ``block_id`` is a digest of the block; the block's text stays out of every later shuffle but
    for its first line.
    """
    code = files.withColumn("_code", strip_imports("path", "text")).withColumn("_code", tidy_lines("_code"))
    cut = unroll(code, ["rev", "path"], cut_blocks("path", "_code"), "block", "pos")
    return cut.select(
        "rev", "path", "pos", F.sha2("block", 256).alias("block_id"),
        F.trim(F.substring_index("block", "\n", 1)).alias("first_line"),
        (F.length("block") - F.length(F.replace("block", F.lit("\n"), F.lit(""))) + 1).alias("lines"))


def _sign() -> Column:
    return F.when(F.col("rev") == NEW, 1).otherwise(-1)


def block_multiset(blocks_df: DataFrame) -> DataFrame:
    """Blocks whose number changed over all files; ``delta`` > 0 is extra, < 0 is lost."""
    return blocks_df.groupBy("block_id").agg(
        F.sum(_sign()).alias("delta"), F.min("first_line").alias("first_line"), F.max("lines").alias("lines")).where("delta <> 0")


def block_paths(blocks_df: DataFrame, deltas: DataFrame) -> DataFrame:
    """The files in which a changed block appears more, or less, often than before; one row each."""
    per = blocks_df.groupBy("block_id", "path").agg(F.sum(_sign()).alias("here")).where("here <> 0")
    return per.join(deltas.select("block_id", "delta"), "block_id").where(
        F.signum("here") == F.signum("delta")).select("block_id", "path", "here", "delta")


def extra_blocks(blocks_df: DataFrame) -> DataFrame:
    return block_multiset(blocks_df).where("delta > 0").withColumnRenamed("delta", "n")


def lost_blocks(blocks_df: DataFrame) -> DataFrame:
    return block_multiset(blocks_df).where("delta < 0").withColumn("n", -F.col("delta")).drop("delta")


def moved_lines(blocks_df: DataFrame) -> DataFrame:
    """Lines that left some file."""
    per = blocks_df.groupBy("path", "block_id").agg(F.sum(-_sign()).alias("gone"), F.max("lines").alias("lines"))
    return per.agg(F.coalesce(F.sum(F.col("lines") * F.greatest("gone", F.lit(0))), F.lit(0)).alias("lines"))


def changed_paths(files: DataFrame) -> DataFrame:
    """Paths whose text differs between the versions; a missing version is an empty text."""
    per = files.groupBy("path").agg(
        F.coalesce(F.max(F.when(F.col("rev") == OLD, F.sha2("text", 256))), F.lit("")).alias("old"),
        F.coalesce(F.max(F.when(F.col("rev") == NEW, F.sha2("text", 256))), F.lit("")).alias("new"))
    return per.where("old <> new").select(
        "path", F.when(F.col("old") == "", "added").when(F.col("new") == "", "removed").otherwise("changed").alias("change"))


def move_verdict(files: DataFrame) -> DataFrame:
    """One row: moves only, logic edits, or nothing to check."""
    cut = blocks(files)
    n_paths = changed_paths(files).agg(F.count("*"))
    edits = block_multiset(cut).agg(F.count("*").alias("edits"))
    rows = edits.select("edits", n_paths.scalar().alias("files"), moved_lines(cut).scalar().alias("lines"))
    verdict = F.when(F.col("files") == 0, "nothing to check").when(F.col("edits") > 0, "logic edits").otherwise("moves only")
    return rows.select(verdict.alias("verdict"), "files", "edits", F.when(F.col("edits") == 0, F.col("lines")).alias("moved_lines"))


# --- lines --------------------------------------------------------------------------------------
def lines_of(files: DataFrame) -> DataFrame:
    return unroll(files, ["rev", "path"], F.split("text", r"\r?\n"), "line", "pos")


def signed_lines(lines_df: DataFrame, keys=("line",)) -> DataFrame:
    """Lines as a bag: those whose count differs between the versions."""
    return lines_df.groupBy(*keys).agg(F.sum(_sign()).alias("delta")).where("delta <> 0")


def added_lines(lines_df: DataFrame) -> DataFrame:
    """New lines whose text is not among the old lines of the same path; repeats stay."""
    new = lines_df.where(F.col("rev") == NEW)
    old = lines_df.where(F.col("rev") == OLD).select("path", "line").distinct()
    return new.join(old, ["path", "line"], "left_anti").select("path", "pos", "line")


def is_test_path(path: Column) -> Column:
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    segments = F.split(plain, "/")
    folders = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    return plain.rlike(lx.TEST_NAME) | F.arrays_overlap(folders, F.array(*[F.lit(f) for f in lx.TEST_FOLDERS]))


def lost_test_lines(pairs: DataFrame, tests_only: bool = True) -> DataFrame:
    """First lost line per file. ``pairs``: path, head_text, new_text."""
    rows = pairs.where(is_test_path(F.col("path"))) if tests_only else pairs
    lost = rows.withColumn("lost", first_lost_line(F.col("head_text"), F.col("new_text"))).where("lost is not null")
    return lost.select("path", F.trim("lost").alias("line"))


def weak_assertion(lines_df: DataFrame, rules: Mapping[str, str] = lx.WEAK_ASSERTIONS) -> DataFrame:
    """Test lines that prove nothing."""
    rows = lines_df.where(any_match("line", list(rules.values())))
    rest = [c for c in lines_df.columns if c != "line"]
    return unroll(rows, [*rest, "line"], matching("line", rules), "rule").drop("_pos")


def unnamed_test_change(lines_df: DataFrame, named: DataFrame, assertion: str = r"(?i)\b(assert|expect|should)\b") -> DataFrame:
    """Changed or removed assertion lines that the change note does not name.

    ``lines_df``: rev, path, line. ``named``: path, line. A line that only moved inside its file stays.
    """
    per = lines_df.where(F.col("line").rlike(assertion)).groupBy("path", F.trim("line").alias("line")).agg(
        F.sum(-_sign()).alias("gone")).where("gone > 0")
    return per.join(named.select("path", F.trim("line").alias("line")).distinct(), ["path", "line"], "left_anti")


def latest_patch(pushes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts with ``void``: a later push of the same pull request has another patch id.

    ``pushes``: pr, seq, patch. ``verdicts``: pr, seq, patch, verdict.
    """
    last = pushes.groupBy("pr").agg(F.max_by(F.struct("seq", "patch"), "seq").alias("last"))
    rows = lookup(verdicts, last, ["pr"], ["seq"])
    later = F.coalesce((F.col("last.seq") > F.col("seq")) & (F.col("last.patch") != F.col("patch")), F.lit(False))
    return rows.select("pr", "seq", "patch", "verdict", later.alias("void"))
