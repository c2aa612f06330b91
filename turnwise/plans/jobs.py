"""The jobs a user runs: tables in, a table out.

Log jobs read the JSON once: the columns they need go to the shared folder as a narrow table, and
every later scan reads that.
"""
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.code import first_lost_line
from turnwise.lineage import durable, stored
from turnwise.operators import chains, changes, chunks, evals, findings, lenses, mining, motion, policy, prose, records, runlog, trees, usage
from turnwise.operators.ordered import int_segment
from turnwise.sources import sessions, sinks
from turnwise.sources.plans import read_plans


def log_tables(spark: SparkSession, root: str, project: str = "", since: str | None = None,
               headless: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw lines and the narrow event table of a log folder."""
    raw = sessions.read_sessions(spark, root, project, since)
    events = stored(sessions.events(raw))
    return raw, events if headless else sessions.skip_headless(events)


def turn_table(events: DataFrame) -> DataFrame:
    """One row per turn with its tool calls."""
    return mining.turn_rollup(events)


def correction_report(events: DataFrame, skill: str | None = None, correction: str = lx.CORRECTION) -> DataFrame:
    """Exchanges of all five kinds, once per project and wording."""
    state = durable(mining.with_state(events))
    asked = mining.ask_answer(sessions.blocks_of(events))
    found = mining.union_kinds(mining.result_exchanges(state, asked), mining.reply_exchanges(state, correction))
    if skill:
        found = mining.skill_span_filter(found, skill)
    return mining.dedupe_exchanges(found)


def skill_scorecard(events: DataFrame, shipped: Mapping[str, str], announced: DataFrame | None = None) -> DataFrame:
    """Corrections per session and known skill, without those announced before."""
    counts = mining.corrections_by_skill(events, shipped)
    return counts if announced is None else mining.nudge_once(counts, announced)


def lens_findings(events: DataFrame) -> DataFrame:
    """Findings of the lenses that look at one turn or one session."""
    calls = mining.turn_calls(events)
    wasted = lenses.wasted_calls(calls).select(
        F.lit("wasted calls").alias("lens"), "session", "seq", F.col("line").alias("pattern"), F.col("line").alias("quote"))
    lines = calls.select("session", "seq", "line", F.col("session").alias("started"))
    again = lenses.rediscovered(lines).select(
        F.lit("rediscovered").alias("lens"), F.col("later_session").alias("session"), "seq", F.col("line").alias("pattern"),
        F.col("line").alias("quote"))
    return reduce(DataFrame.unionByName, [
        lenses.no_artifact_claim(events), lenses.skipped_check(events), lenses.pasted_context(events), wasted, again])


def missed_triggers(events: DataFrame, triggers: DataFrame, min_share: float = 0.6) -> DataFrame:
    """Prompts whose words match a labelled query (trigger, skill, query) of a skill their turn did not load."""
    facts = mining.turn_facts(events, {})
    request = F.struct("file", "turn_id")
    asked = facts.select(request.alias("request"), F.col("user").alias("text"))
    loads = mining.turn_calls(events).where(F.col("name") == lx.SKILL_TOOL).select(
        request.alias("request"), F.regexp_extract("line", r"^\S+ (?:\S*[:/])?(\S+)$", 1).alias("skill"))
    return lenses.missed_trigger(asked, triggers, loads, min_share)


def lens_report(events: DataFrame, min_sessions: int = 2) -> DataFrame:
    return lenses.recurring(lens_findings(events), min_sessions)


def plan_audit(spark: SparkSession, path: str, launch: bool = False) -> tuple[DataFrame, DataFrame]:
    """Findings and one report row per tree of a folder of outlines."""
    t = read_plans(spark, path).stored()
    trees_df = t.products.select("tree").unionByName(t.projects.select("tree"))
    found = trees.plan_findings(t, launch)
    return found, trees.tree_report(trees_df, found)


def prose_audit(docs: DataFrame) -> DataFrame:
    """Rule hits of documents (doc, folder, expected, text): headings, long sentences, banned terms, tells."""
    schema = prose.heading_schema(docs, F.col("folder"), F.col("expected")).select("doc", F.lit(0).alias("line_no"), "rule", F.lit(1).alias("hits"))
    plain = docs.select("doc", "text")
    long = prose.long_sentences(plain).select("doc", "line_no", F.lit("sentence length").alias("rule"), F.lit(1).alias("hits"))
    banned = prose.banned_terms(plain).select("doc", "line_no", F.lit("banned term").alias("rule"), F.lit(1).alias("hits"))
    tells = prose.tell_catalogue(plain).select("doc", F.lit(0).alias("line_no"), F.concat(F.lit("tell "), F.col("rule").cast("string")).alias("rule"), "hits")
    return reduce(DataFrame.unionByName, [schema, long, banned, tells])


def change_audit(files: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdict of a change, and its rows: changed blocks, lost test lines, unnamed assertion changes.

    ``files``: rev, path, text. ``named``: path, line the change note names.
    """
    cut = durable(changes.blocks(files))
    deltas = changes.block_multiset(cut)
    where = changes.block_paths(cut, deltas).join(deltas.select("block_id", "first_line"), "block_id").select(
        "path", F.when(F.col("delta") > 0, "extra block").otherwise("lost block").alias("rule"), F.col("first_line").alias("line"))
    tests = files.where(changes.is_test_path(F.col("path")))
    pairs = tests.groupBy("path").agg(
        F.coalesce(F.max(F.when(F.col("rev") == changes.OLD, F.col("text"))), F.lit("")).alias("head_text"),
        F.coalesce(F.max(F.when(F.col("rev") == changes.NEW, F.col("text"))), F.lit("")).alias("new_text"))
    lost = pairs.select("path", F.lit("lost test line").alias("rule"), F.trim(first_lost_line(F.col("head_text"), F.col("new_text"))).alias("line")).where("line is not null")
    unnamed = changes.unnamed_test_change(changes.lines_of(tests), named).select("path", F.lit("unnamed test change").alias("rule"), "line")
    return changes.move_verdict(files), where.unionByName(lost).unionByName(unnamed)


def policy_audit(calls: DataFrame, edges: DataFrame, modes: DataFrame, user_mode: str = "off", **gate) -> DataFrame:
    """Calls with the mode verdict and the gate verdict."""
    judged = policy.mode_verdict(calls, chains.inherited_mode(edges, modes, user_mode), user_mode)
    return policy.shift_verdict(judged.withColumnRenamed("verdict", "mode_verdict"), **gate).withColumnRenamed("verdict", "gate")


def usage_report(samples: DataFrame, now: Column) -> DataFrame:
    """Burn rate per window with the context and cache use of the last sample."""
    last = usage.context_pressure(usage.latest(samples)).select("session", "pct", "level", F.col("left").alias("tokens_left"))
    cache = usage.cache_hit_rate(usage.latest(samples)).select("session", "cache_pct", "cache_level")
    return usage.rate_windows(samples, now).join(last, "session", "left").join(cache, "session", "left")


def eval_report(runs: DataFrame, graders: DataFrame, trace: DataFrame, texts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pass rates per suite and case; ``verdicts`` (case, run, grader, passed) come from outside graders."""
    grades = evals.grade_tool_used(runs, graders, trace).unionByName(evals.grade_regex(graders, texts)).unionByName(verdicts)
    return evals.grade_rollup(grades, graders.select("suite", "case").distinct())


def findings_report(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Merged, new, routed and ranked findings. ``rows`` also hold reality, in_scope, minor and severity per defect."""
    merged = findings.known_bug_filter(findings.finding_dedupe_join(rows), ledger)
    facts = rows.groupBy("file", "line", findings.normal_defect(F.col("defect")).alias("key")).agg(
        F.max_by("reality", "judged").alias("reality"), F.bool_or("in_scope").alias("in_scope"), F.bool_and("minor").alias("minor"),
        F.max_by("severity", "judged").alias("severity"))
    return findings.ranked_findings(findings.finding_route(merged.join(facts, ["file", "line", "key"])))


def record_report(decisions: DataFrame, edges: DataFrame, items: DataFrame, labels: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The decisions in force, and what needs attention."""
    return chains.current_decision(decisions, edges), records.attention_list(items, labels, comments)


def run_log_audit(log: DataFrame, trace: DataFrame, n: int = 3) -> DataFrame:
    """Unsupported and unlogged rows and stuck stretches as one list of flags."""
    flags = runlog.log_vs_trace(log.withColumn("item", F.col("change")), trace).select("run", "flag", "item", "evidence")
    number = lambda c: F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    passes = log.withColumns({"before": number("before"), "after": number("after")})
    stuck = runlog.stuck_run(passes, int_segment("pass"), n).select(
        "run", F.concat(F.lit("Stuck: "), "kind").alias("flag"),
        F.concat(F.col("from_pass").cast("string"), F.lit("-"), F.col("to_pass").cast("string")).alias("item"),
        F.col("n").cast("string").alias("evidence"))
    return flags.unionByName(stuck)


def benchmark_verdict(runs: DataFrame) -> DataFrame:
    return usage.ab_benchmark(runs)


def motion_report(samples: DataFrame, motions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Residuals per motion, and broken bands and rules."""
    bands = motion.duration_band(motions).where(~F.col("inside")).select("motion", F.concat(F.lit("outside band "), "band").alias("rule"))
    return motion.motion_residual(samples, F.floor(F.col("t") / 60_000)), bands.unionByName(motion.motion_rules(motions))


def export_chunks(exchanges: DataFrame, n: int, out: str) -> DataFrame:
    """Exchanges as text in chunks of about ``n`` lines; gives the line range of every chunk.

    ``chunk`` numbers start at 0 in each project, so the folders are per project and chunk.
    """
    if n < 1:
        raise ValueError("a chunk takes 1 line or more")
    text = sinks.exchange_text(F.col("kind"), F.col("session"), F.col("project"), F.col("before"), F.col("user"))
    rows = durable(exchanges.select("project", "session", "seq", "part", "pos", text.alias("text")))
    sizes = rows.groupBy("project", "session").agg(F.sum(sinks.line_count(F.col("text"))).alias("lines"))
    cut = durable(chunks.chunk_assign(sizes, n))
    named = cut.withColumn("chunk", F.concat(F.regexp_replace("project", r"[^\w.-]", "_"), F.lit("."), F.lpad(F.col("chunk").cast("string"), 6, "0")))
    sinks.write_session_chunks(rows, named, out, order=("seq", "part", "pos"))
    return chunks.chunk_ranges(cut)
