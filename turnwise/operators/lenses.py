"""Lens detectors: things that went wrong in a turn without anyone saying so."""
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.text import head, lines, strip, unroll, words
from turnwise.operators.mining import turn_facts
from turnwise.operators.ordered import lookup

FINDING = ["lens", "session", "seq", "pattern", "quote"]


def any_call(pattern: str, field: str = "line") -> Column:
    """True if a tool call of the event matches."""
    return F.exists("calls", lambda b: b[field].rlike(pattern))


def _finding(df: DataFrame, lens: str, pattern: Column, quote: Column) -> DataFrame:
    return df.select(F.lit(lens).alias("lens"), "session", "seq", pattern.alias("pattern"), head(quote, 200).alias("quote"))


def no_artifact_claim(events: DataFrame, claim: str = lx.CLAIM, run: str = lx.RUN_TOOL) -> DataFrame:
    """Turns whose last text claims success while no call could have shown it."""
    facts = turn_facts(events, {"ran": any_call(run)})
    found = facts.where(F.col("claude").rlike(claim) & ~F.col("ran"))
    return _finding(found, "no artifact", F.lower(F.regexp_extract("claude", claim, 1)), F.col("claude"))


def skipped_check(events: DataFrame, checks: Mapping[str, tuple[str, str]] = lx.CHECKS) -> DataFrame:
    """Turns that report a check's result without a call that runs it."""
    flags = {f"ran_{n}": any_call(run) for n, (_, run) in checks.items()}
    facts = turn_facts(events, flags)
    missed = F.array_compact(F.array(*[
        F.when(F.col("claude").rlike(says) & ~F.col(f"ran_{n}"), F.lit(n)) for n, (says, _) in checks.items()]))
    found = unroll(facts, facts.columns, missed, "_check")
    return _finding(found, "skipped check", F.col("_check"), F.col("claude"))


def pasted_context(events: DataFrame, marker: str = lx.PASTE, fetch: str = lx.FETCH_TOOL, min_lines: int = 8) -> DataFrame:
    """Prompts that carry a pasted ticket, trace or log in a turn that fetched nothing."""
    facts = turn_facts(events, {"fetched": any_call(fetch)})
    found = facts.where((F.size(lines("user", every_break=False)) >= min_lines) & F.col("user").rlike(marker) & ~F.col("fetched"))
    return _finding(found, "pasted context", strip(F.regexp_extract("user", marker, 0)), F.col("user"))


def normal_line(line: Column | str) -> Column:
    return F.lower(F.regexp_replace(strip(line), r"\s+", " "))


def rediscovered(tool_lines: DataFrame, search: str = lx.SEARCH_TOOL) -> DataFrame:
    """Search lines seen in an earlier session: one row per line and later session.

    ``tool_lines``: session, seq, line and ``started``, which orders the sessions. A line is
    compared with its first session only, never pair by pair.
    """
    seen = tool_lines.where(F.col("line").rlike(search)).groupBy(normal_line("line").alias("line"), "session").agg(
        F.min(F.struct("started", "seq")).alias("at"))
    first = seen.groupBy("line").agg(F.min(F.struct(F.col("at.started").alias("started"), F.col("session").alias("session"))).alias("first"),
                                     F.count("*").alias("sessions")).where("sessions > 1").drop("sessions")
    found = lookup(seen, first, ["line"], ["session"], "inner").where(F.col("session") != F.col("first.session"))
    return found.select("line", F.col("first.session").alias("first_session"), F.col("session").alias("later_session"),
                        F.col("at.seq").alias("seq"))


def wasted_calls(tool_lines: DataFrame, n: int = 3) -> DataFrame:
    """Tool lines repeated at least ``n`` times in one session."""
    return tool_lines.groupBy("session", normal_line("line").alias("line")).agg(
        F.count("*").alias("n"), F.min("seq").alias("seq")).where(F.col("n") >= n)


def missed_trigger(requests: DataFrame, triggers: DataFrame, loads: DataFrame, min_share: float = 0.6,
                   min_chars: int = 3) -> DataFrame:
    """Requests that hold at least ``min_share`` of a labelled query's words while its skill stayed unloaded.

    ``requests``: request, text. ``triggers``: trigger, skill, query. ``loads``: request, skill.
    A query with k words that needs m of them shares one of its k-m+1 rarest words with every
    match, so only those are joined on. The filter loses no match; common words never meet.
    """
    said = requests.select("request", F.array_sort(words("text", min_chars)).alias("_words")).withColumn(
        "_text", F.sha2(F.array_join("_words", " "), 256))
    asked = said.select("request", "_text")
    texts = said.groupBy("_text").agg(F.any_value("_words").alias("_words"))  # copies are compared once
    tokens = unroll(texts, ["_text"], "_words", "word").drop("_pos")
    wanted = triggers.select("trigger", "skill", words("query", min_chars).alias("_query")).where(F.size("_query") > 0)

    query_words = wanted.select("trigger", F.explode("_query").alias("word"))
    often = tokens.groupBy("word").agg(F.count("*").alias("df"))
    weighed = query_words.join(often, "word", "left").groupBy("trigger").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("by_rarity"))
    need = F.ceil(F.size("by_rarity") * F.lit(min_share))
    prefix = weighed.select("trigger", F.explode(
        F.slice("by_rarity", F.lit(1), (F.size("by_rarity") - need + 1).cast("int"))).alias("w")).select(
        "trigger", F.col("w.word").alias("word"))

    near = lookup(tokens, prefix, ["word"], ["_text"], "inner").select("_text", "trigger").distinct()
    scored = lookup(near, wanted, ["trigger"], ["_text"], "inner").join(texts, "_text").select(
        "_text", "trigger", "skill", F.size(F.array_intersect("_query", "_words")).alias("shared"), F.size("_query").alias("of"))
    hits = scored.where(F.col("shared") >= F.ceil(F.col("of") * F.lit(min_share))).groupBy("_text", "skill").agg(
        F.max(F.struct((F.col("shared") / F.col("of")).alias("score"), -F.col("trigger"))).alias("best"))
    per_skill = lookup(asked, hits, ["_text"], ["request"], "inner").select(
        "request", "skill", F.col("best.score").alias("score"), (-F.col("best.col2")).alias("trigger"))
    return per_skill.join(loads.select("request", "skill"), ["request", "skill"], "left_anti")


def recurring(findings: DataFrame, min_sessions: int = 2, quotes: int = 3, costly: Column | None = None) -> DataFrame:
    """Patterns seen in at least ``min_sessions`` sessions, or marked costly, with a few sample quotes."""
    per = findings.groupBy("lens", "pattern", "session").agg(
        F.min(F.struct("seq", "quote")).alias("q"), F.count("*").alias("n"),
        F.max((costly if costly is not None else F.lit(False)).cast("int")).alias("costly"))
    kept = per.groupBy("lens", "pattern").agg(
        F.count("*").alias("sessions"), F.sum("n").alias("n"), F.max("costly").alias("costly")).where(
        (F.col("sessions") >= min_sessions) | (F.col("costly") == 1)).drop("costly")
    w = Window.partitionBy("lens", "pattern").orderBy("session")
    sample = per.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= quotes).groupBy("lens", "pattern").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col("q.quote").alias("quote")))), lambda s: s["quote"]).alias("quotes"))
    return kept.join(sample, ["lens", "pattern"])


def theme_repeat(tagged: DataFrame, min_sources: int = 2) -> DataFrame:
    """Themes that show up across at least ``min_sources`` sources."""
    per = tagged.groupBy("theme", "source").agg(F.count("*").alias("n"))
    return per.groupBy("theme").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).where(F.col("sources") >= min_sources)


def review_lessons(commits: DataFrame, comments: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reverts, review comments and corrections of a project as one table of lessons."""
    reverts = commits.where(F.col("message").rlike("^Revert")).select(
        "project", F.lit("revert").alias("kind"), F.col("sha").alias("ref"), F.col("message").alias("text"))
    reviews = comments.select("project", F.lit("review").alias("kind"), F.col("ref").cast("string").alias("ref"), "text")
    fixes = corrections.select("project", F.lit("correction").alias("kind"), F.col("session").cast("string").alias("ref"),
                               F.col("user").alias("text"))
    return reverts.unionByName(reviews).unionByName(fixes)


def recall_brief(records: DataFrame, topic: str, now: Column, days: int | None = 7, k: int = 5) -> DataFrame:
    """Topic hits inside a window: all decisions and at most ``k`` of each other kind, newest first.

    ``records``: ts, kind, ref, text. ``days=None`` reads everything.
    """
    hit = records.where(F.lower("text").contains(topic.lower()))
    if days is not None:
        hit = hit.where(F.col("ts") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    newest = Window.partitionBy("kind").orderBy(F.desc("ts"), "ref")
    few = hit.where("kind <> 'decision'").withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k).drop("rank")
    return few.unionByName(hit.where("kind = 'decision'"))
