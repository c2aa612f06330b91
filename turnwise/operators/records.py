"""Trackers, branches, wiki pages: what is in which state and what needs a person."""
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.rules import matching


def one_state_check(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Triaged items without exactly one state and one category. ``labels``: item, label."""
    kinds = labels.distinct().groupBy("item").agg(
        F.count_if(F.col("label").isin(lx.TRIAGE_STATES)).alias("states"),
        F.count_if(F.col("label").isin(lx.TRIAGE_CATEGORIES)).alias("categories"))
    rows = items.select("item").join(kinds, "item", "left")
    states, cats = F.coalesce("states", F.lit(0)), F.coalesce("categories", F.lit(0))
    return rows.select("item", states.alias("states"), cats.alias("categories")).where("states <> 1 or categories <> 1")


def newest_triage_reply(items: DataFrame, labels: DataFrame, comments: DataFrame) -> DataFrame:
    """``needs-info`` items with a reporter reply after the last triage note.

    ``items``: item, reporter. ``comments``: item, ts, author, is_note.
    """
    waiting = items.join(labels.where("label = 'needs-info'").select("item").distinct(), "item", "left_semi")
    folded = comments.groupBy("item", "author", "is_note").agg(F.max("ts").alias("ts"))
    rows = folded.join(waiting.select("item", "reporter"), "item")
    last = rows.groupBy("item").agg(
        F.max(F.when(F.col("is_note"), F.col("ts"))).alias("note"),
        F.max(F.when(~F.col("is_note") & (F.col("author") == F.col("reporter")), F.col("ts"))).alias("reply"))
    return last.where(F.col("reply").isNotNull() & (F.col("note").isNull() | (F.col("reply") > F.col("note")))).select("item", "reply")


def attention_list(items: DataFrame, labels: DataFrame, comments: DataFrame) -> DataFrame:
    """Items that need attention in three groups, oldest first.

    ``items``: item, kind ('issue' or 'PR'), created, reporter, outside. Pull requests count only
    from authors outside the team.
    """
    open_items = items.where((F.col("kind") != "PR") | F.col("outside"))
    state = labels.where(F.col("label").isin(lx.TRIAGE_STATES)).select("item", "label").distinct()
    bare = open_items.join(state.select("item").distinct(), "item", "left_anti").withColumn("group", F.lit(1))
    fresh = open_items.join(state.where("label = 'needs-triage'").select("item"), "item", "left_semi").withColumn("group", F.lit(2))
    replied = open_items.join(newest_triage_reply(items, labels, comments).select("item"), "item", "left_semi").withColumn("group", F.lit(3))
    return bare.unionByName(fresh).unionByName(replied).select("group", "item", "kind", "created").orderBy("group", "created", "item")


def attention_counts(attention: DataFrame) -> DataFrame:
    return attention.groupBy("group").agg(F.count("*").alias("items"), F.min("created").alias("oldest"))


def readiness_route(items: DataFrame, needs: Mapping[str, str] = lx.NEEDS_PERSON) -> DataFrame:
    """ready-for-human when a check (item, checks array) needs a person, with what it needs."""
    reasons = F.array_sort(F.array_distinct(F.flatten(F.transform("checks", lambda c: matching(c, needs)))))
    rows = items.withColumn("reasons", reasons)
    return rows.withColumn("state", F.when(F.size("reasons") > 0, "ready-for-human").otherwise("ready-for-agent")).drop("checks")


def branch_pr(branches: DataFrame, prs: DataFrame, me: Column | str) -> DataFrame:
    """Remove, Keep or Ask per branch, with the reason.

    ``branches``: name, tip, remote, dirty, live, unpushed (commits not on the main branch).
    ``prs``: head, number, state, head_oid, author; the latest pull request of a name counts.
    """
    last = prs.groupBy("head").agg(F.max_by(F.struct("number", "state", "head_oid", "author"), "number").alias("pr"))
    rows = branches.join(last, F.col("name") == F.col("head"), "left")
    me = F.lit(me) if isinstance(me, str) else me
    has, over = F.col("pr").isNotNull(), F.col("pr.state").isin("MERGED", "CLOSED")
    rule = [
        (F.col("live"), "Keep", "a live session uses it"),
        (F.col("dirty"), "Keep", "uncommitted changes"),
        (F.col("remote") & has & (F.col("pr.author") != me), "Keep", "someone else's pull request"),
        (has & ~over, "Keep", "open pull request"),
        (has & (F.col("tip") != F.col("pr.head_oid")), "Keep", "tip moved after the pull request"),
        (has, "Remove", "pull request is over"),
        (F.col("remote"), "Ask", "remote without a pull request"),
        (F.col("unpushed") > 0, "Ask", "unique commits without a pull request"),
    ]
    pick = lambda i, last_value: F.coalesce(*[F.when(r[0], F.lit(r[i])) for r in rule], F.lit(last_value))
    return rows.select("name", pick(1, "Remove").alias("class"), pick(2, "no unique commits").alias("reason"))


def thread_live_state(threads: DataFrame, branches: DataFrame, prs: DataFrame) -> DataFrame:
    """One tag per remembered thread; the live branch and pull request win over what was said.

    ``threads``: thread, branch, said. ``branches``: name, uncommitted. ``prs``: head, number, state, reverted.
    """
    pr = prs.groupBy(F.col("head").alias("branch")).agg(F.max_by(F.struct("number", "state", "reverted"), "number").alias("pr"))
    live = branches.groupBy(F.col("name").alias("branch")).agg(F.bool_or("uncommitted").alias("uncommitted"))
    rows = threads.join(pr, "branch", "left").join(live, "branch", "left")
    no = F.concat(F.lit(" #"), F.col("pr.number").cast("string"))
    tag = (
        F.when((F.col("pr.state") == "MERGED") & F.col("pr.reverted"), F.concat(F.lit("reverted"), no))
        .when(F.col("pr.state") == "MERGED", F.concat(F.lit("merged"), no))
        .when(F.col("pr.state") == "OPEN", F.concat(F.lit("open PR"), no))
        .when(F.col("uncommitted"), "verified, uncommitted")
        .when(F.col("uncommitted").isNotNull(), F.concat(F.lit("in flight "), F.col("branch"))))
    return rows.select("thread", F.coalesce(tag, F.col("said"), F.lit("planned, not started")).alias("tag"))


def link_resolves(pages: DataFrame, links: DataFrame, home: str = "Home") -> DataFrame:
    """Links without a page, and pages the home page does not list. ``links``: page, target."""
    known = pages.select(F.col("page").alias("target")).distinct()
    broken = links.distinct().join(known, "target", "left_anti").select(F.lit("broken").alias("rule"), "page", "target")
    listed = links.where(F.col("page") == home).select(F.col("target").alias("page")).distinct()
    unlisted = pages.where(F.col("page") != home).join(listed, "page", "left_anti").select(
        F.lit("unlisted").alias("rule"), "page", F.lit(None).cast("string").alias("target"))
    return broken.unionByName(unlisted)
