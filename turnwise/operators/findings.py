"""Findings, claims and their evidence; bug-hunt rounds; feature verification."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.lineage import durable
from turnwise.operators.ordered import carry, lookup, range_segments


def proof_rank(level: Column) -> Column:
    """0 stated, 1 pointed at the line, 2 walked through, 3 run."""
    return F.array_position(F.array(*[F.lit(p) for p in lx.PROOF_LEVELS]), F.lower(level)).cast("int") - 1


def normal_defect(defect: Column) -> Column:
    """Case, punctuation and spacing do not tell defects apart."""
    return F.trim(F.regexp_replace(F.lower(defect), r"[^\p{L}\p{N}]+", " "))


def finding_dedupe_join(findings: DataFrame) -> DataFrame:
    """The same defect at the same place once, with its reviewers and the best proof.

    Reviewers are folded before they are listed, so a list is as long as there are reviewers.
    """
    per = findings.withColumn("key", normal_defect(F.col("defect"))).groupBy("file", "line", "key", "reviewer").agg(
        F.max(proof_rank(F.col("proof_level"))).alias("proof"), F.min("defect").alias("defect"))
    return per.groupBy("file", "line", "key").agg(
        F.min("defect").alias("defect"), F.max("proof").alias("proof"),
        F.array_sort(F.collect_list("reviewer")).alias("reviewers"))


def known_bug_filter(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings that the ledger (file, line, defect) does not hold as fixed or rejected."""
    known = ledger.select("file", "line", normal_defect(F.col("defect")).alias("key")).distinct()
    rows = findings if "key" in findings.columns else findings.withColumn("key", normal_defect(F.col("defect")))
    return rows.join(known, ["file", "line", "key"], "left_anti")


def finding_route(findings: DataFrame) -> DataFrame:
    """Act on, Consider, Noted or Dismissed.

    ``findings``: proof (rank), reality ('real', 'plausible' or 'wrong'), in_scope, minor.
    """
    real, scoped = F.col("reality") == "real", F.col("in_scope") & ~F.col("minor")
    group = (
        F.when(F.col("reality") == "wrong", "Dismissed")
        .when(real & ~scoped, "Noted")
        .when(real & (F.coalesce("proof", F.lit(0)) >= 2), "Act on")
        .otherwise("Consider"))
    return findings.withColumn("group", group)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in lx.SEVERITIES]), F.lower(severity)).cast("int")


def ranked_findings(findings: DataFrame) -> DataFrame:
    """Worst first; how many reviewers agree is not a key."""
    return findings.withColumn("rank", severity_rank(F.col("severity"))).orderBy("rank", "file", "line")


def evidence_tier(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Direct, Supported, Inferred, Speculative or Unknown per claim.

    ``claims``: claim, searched. ``citations``: claim, source, direct, agrees.
    """
    agreeing = citations.where("agrees").select("claim", "source").distinct().groupBy("claim").agg(F.count("*").alias("sources"))
    facts = citations.groupBy("claim").agg(F.bool_or("direct").alias("direct"), F.count("*").alias("cites"))
    rows = claims.join(facts, "claim", "left").join(agreeing, "claim", "left")
    tier = (
        F.when(F.coalesce("direct", F.lit(False)), "Direct").when(F.coalesce("sources", F.lit(0)) >= 2, "Supported")
        .when(F.coalesce("cites", F.lit(0)) > 0, "Inferred").when(F.col("searched"), "Unknown").otherwise("Speculative"))
    return rows.select("claim", "searched", tier.alias("tier"))


def evidence_resolves(claims: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence pointers (claim, ref) that are neither a known commit (any 7 or more first digits) nor a file.

    Digests and pointers are laid out in one order, a pointer after all digests that begin with it: if there are any, the last digest
    before it is one of them. So a row of either moves once, however many digests begin alike. A null pointer resolves nowhere.
    """
    full = commits.select("sha").where("sha is not null").distinct()
    exact = files.select(F.col("path").alias("ref")).unionByName(full.where(F.length("sha") < 7).select(F.col("sha").alias("ref"))).distinct()
    left = claims.select("claim", "ref").join(exact, "ref", "left_anti").select("claim", "ref")
    none = F.lit(None)
    line = left.where("ref is not null").select(F.concat("ref", F.lit("~")).alias("key"), none.cast("string").alias("sha"), "claim", "ref").unionByName(
        full.select(F.col("sha").alias("key"), "sha", none.cast(claims.schema["claim"].dataType).alias("claim"), none.cast("string").alias("ref")))
    cut = range_segments(line.withColumn("_all", F.lit(0)), ["_all", "key"])
    before = carry(cut, ["_all"], ["key"], F.col("_seg"), last={"_sha": F.col("sha")}).where("ref is not null")
    known = (F.length("ref") >= 7) & F.coalesce(F.col("_sha").startswith(F.col("ref")), F.lit(False))
    return before.where(~known).select("claim", "ref").unionByName(left.where("ref is null"))


# --- bug-hunt rounds ----------------------------------------------------------------------------
def shard_plan(files: DataFrame, n: int = 3, round_no: int = 0) -> DataFrame:
    """Files in ``n`` shards of about equal lines; an area stays in one shard, shards rotate by round.

    Areas in order lie end to end on a line of all lines; the middle of an area picks its shard, so
    a shard is off by less than one area. ``files``: path, area, lines.
    """
    areas = files.groupBy("area").agg(F.sum("lines").cast("bigint").alias("lines")).withColumn("_all", F.lit(0))
    cut = range_segments(areas, ["area"])
    run = carry(cut, ["_all"], ["area"], F.col("_seg"), total={"upto": F.col("lines")})
    whole = areas.agg(F.sum("lines")).scalar()
    middle = F.col("upto") - F.col("lines") / 2
    shard = F.least(F.floor(middle * n / whole), F.lit(n - 1))
    placed = run.select("area", F.pmod(shard + round_no, F.lit(n)).cast("int").alias("shard"))
    return lookup(files, placed, ["area"], ["path"], "inner").select("path", "area", "lines", "shard")


def largest_first(files: DataFrame, n: int = 3, round_no: int = 0) -> DataFrame:
    """Files in ``n`` shards, the fullest at most 4/3 of the best possible; an area stays in one shard, shards rotate by round.

    ``files``: path, area, lines (null: 0). Areas of more than a third of a shard's even part are fewer than 3 n: the largest first, each goes to the
    emptiest shard, all within one row. The others lie end to end on a line, in order, and fill the shards up to one level like
    water; an area goes where its first line lies, so a shard rises over the level by less than one of them. The level is at
    most the even part, which no plan stays under. Ties go by area, then by shard; a null area is an area.
    """
    if n < 1:
        raise ValueError("files go into 1 shard or more")
    areas = durable(files.groupBy("area").agg(F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("lines")))
    whole = F.coalesce(areas.agg(F.sum("lines")).scalar(), F.lit(0))
    is_large = F.col("lines") * (3 * n) > whole
    zero, key = F.lit(0).cast("bigint"), F.struct((-F.col("lines")).alias("less"), "area")

    def place(state: Column, item: Column) -> Column:
        emptiest = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        loads = F.transform(state["loads"], lambda load, i: F.when(i == emptiest, load - item["less"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.array_append(state["shards"], emptiest).alias("shards"))

    def first(values: Column, k: Column) -> Column:
        return F.aggregate(F.slice(values, 1, k), zero, lambda total, v: total + v)

    start = F.struct(F.array_repeat(zero, n).alias("loads"), F.array().cast("array<bigint>").alias("shards"))
    counts = F.sequence(F.lit(1), F.lit(n))
    plan = areas.where(is_large).agg(F.sort_array(F.collect_list(key)).alias("items")).withColumn("state", F.aggregate("items", start, place))
    plan = plan.select("items", "state.shards", F.col("state.loads").alias("loads"), F.sort_array("state.loads").alias("rising"))
    rest = whole - F.aggregate("loads", zero, lambda total, v: total + v)
    # With the k emptiest shards filled the level would be (rest + their loads) / k; the least of these is the level.
    plan = plan.withColumn("rest", rest).withColumn("level", F.array_min(F.transform(
        counts, lambda k: F.floor((F.col("rest") + first(F.col("rising"), k) + k - 1) / k))))
    plan = plan.withColumn("room", F.transform("loads", lambda load: F.greatest(zero, F.col("level") - load)))
    plan = durable(plan.withColumn("ends", F.transform(counts, lambda k: first(F.col("room"), k))))

    large = plan.select(F.explode(F.arrays_zip("items", "shards")).alias("x")).select("x.items.area", F.col("x.shards").alias("shard"))
    cut = range_segments(areas.where(~is_large).withColumn("_all", F.lit(0)), ["area"])
    run = carry(cut, ["_all"], ["area"], F.col("_seg"), total={"upto": F.col("lines")})
    passed = F.size(F.filter("ends", lambda end: end <= F.col("upto") - F.col("lines"))).cast("bigint")
    small = run.withColumn("ends", plan.select("ends").scalar()).select("area", F.least(passed, F.lit(n - 1)).alias("shard"))
    placed = large.unionByName(small).select(F.struct("area").alias("_area"), F.pmod(F.col("shard") + round_no, F.lit(n)).cast("int").alias("shard"))
    return lookup(files.withColumn("_area", F.struct("area")), placed, ["_area"], ["path"], "inner").select("path", "area", "lines", "shard")


def coverage_percent(scope: DataFrame, read: DataFrame) -> DataFrame:
    """Files read as a percentage of the files in scope, per round. ``read``: round, path."""
    want = scope.select("path").distinct()
    total = want.agg(F.count("*")).scalar()
    seen = read.select("round", "path").distinct().join(want, "path", "left_semi").groupBy("round").agg(F.count("*").alias("files_read"))
    return seen.select("round", "files_read", total.alias("files"), F.floor(F.col("files_read") * 100 / total).alias("percent"))


def clean_round(rounds: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rounds in which every hunter (round, hunter, bugs) found none and every file was read."""
    bugs = rounds.groupBy("round").agg(F.bool_and(F.col("bugs") == 0).alias("quiet"))
    full = coverage.select("round", (F.col("files_read") == F.col("files")).alias("full"))
    return bugs.join(full, "round", "left").select("round", (F.col("quiet") & F.coalesce("full", F.lit(False))).alias("clean"))


def verify_rollup(results: DataFrame) -> DataFrame:
    """VERIFIED, NOT VERIFIED or BLOCKED per feature from its test results (feature, outcome; null outcome: none ran)."""
    per = results.groupBy("feature").agg(
        F.count("outcome").alias("ran"), F.count_if(F.col("outcome").isin("skipped", "timeout", "missing")).alias("blocked"),
        F.count_if(F.col("outcome") == "failed").alias("failed"))
    verdict = F.when(F.col("blocked") > 0, "BLOCKED").when((F.col("ran") == 0) | (F.col("failed") > 0), "NOT VERIFIED").otherwise("VERIFIED")
    return per.select("feature", "ran", verdict.alias("verdict"))

