"""Chains and trees: pointers are doubled, so a chain of n links takes log2(n) joins."""
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.calls import mode_rank
from turnwise.lineage import durable
from turnwise.operators.ordered import carry, range_segments

_RANK = "array<struct<rank:int,holder:string>>"


def climb(links: DataFrame) -> DataFrame:
    """For every node its root, the links to it and the two lowest ranks above it.

    ``links``: node, parent (null or unknown at a root), rank (own value or null), one row per
    node. ``above`` holds (rank, holder) pairs, lowest first; with two of them a node in a cycle
    can leave itself out. ``root`` is null in or below a cycle. Each round joins only the nodes that are still
    climbing, and is written out, so a lost executor repeats one round.
    """
    known = links.select(F.col("node").alias("parent"), F.col("rank").alias("_rank"))
    start = links.where("parent is not null").join(known, "parent", "left").select(
        "node", F.col("parent").alias("jump"), F.lit(1).cast("bigint").alias("hops"), F.col("parent").alias("root"),
        F.when(F.col("_rank").isNotNull(), F.array(F.struct(F.col("_rank").cast("int").alias("rank"), F.col("parent").cast("string").alias("holder"))))
        .otherwise(F.array().cast(_RANK)).alias("above"))
    roots = links.where("parent is null").select(
        "node", F.col("parent").alias("jump"), F.lit(0).cast("bigint").alias("hops"), F.col("node").alias("root"),
        F.array().cast(_RANK).alias("above"))
    state = durable(start.unionByName(roots))
    rounds = ceil(log2(max(state.count(), 2))) + 1
    for _ in range(rounds):
        active = state.where("jump is not null")
        if active.isEmpty():
            break
        far = state.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("hops").alias("_hops"),
                           F.col("root").alias("_root"), F.col("above").alias("_above"))
        both = F.concat("above", F.coalesce("_above", F.array().cast(_RANK)))
        moved = active.join(far, "jump", "left").select(
            "node", F.col("_jump").alias("jump"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.coalesce("_root", "root").alias("root"), F.slice(F.array_sort(F.array_distinct(both)), 1, 2).alias("above"))
        state = durable(moved.unionByName(state.where("jump is null")))
    looped = F.col("jump").isNotNull()
    return state.select("node", F.when(~looped, F.col("root")).alias("root"), F.when(~looped, F.col("hops")).alias("hops"), "above")


def parent_chain(links: DataFrame) -> DataFrame:
    """node, root and depth from a (node, parent) table."""
    return climb(links.withColumn("rank", F.lit(None).cast("int"))).select("node", "root", F.col("hops").alias("depth"))


# --- decisions ----------------------------------------------------------------------------------
def current_decision(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """Each decision with the one in force at the end of its chain and its place in that chain.

    ``decisions``: id. ``edges``: id, superseded_by, part (null: all of it). Partly superseded
    decisions stay in force. ``hops`` 0 is the decision in force; it orders the chain.
    """
    whole = edges.where("part is null").groupBy("id").agg(F.max("superseded_by").alias("parent"))
    links = decisions.select("id").join(whole, "id", "left").select(F.col("id").alias("node"), "parent")
    return parent_chain(links).select(F.col("node").alias("id"), F.col("root").alias("current"), F.col("depth").alias("hops"))


def replaced_parts(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """Parts of a decision that another replaced, with the decision now in force for each."""
    parts = edges.where("part is not null").select("id", "part", F.col("superseded_by").alias("by"))
    now = chains.select(F.col("id").alias("by"), F.col("current"))
    return parts.join(now, "by", "left").select("id", "part", F.coalesce("current", "by").alias("current"))


def newest_first_index(decisions: DataFrame) -> DataFrame:
    """Decisions by date, the newest first; the number only breaks ties."""
    return decisions.orderBy(F.desc("date"), F.desc("id"))


def revert_chain(commits: DataFrame) -> DataFrame:
    """Each commit with the commit its reverts lead back to and whether that one is live.

    ``commits``: sha, ts, message. The last revert of a chain decides: an even place means the
    change is back in.
    """
    target = F.regexp_extract("message", r"This reverts commit ([0-9a-zA-Z]+)", 1)
    links = commits.select(F.col("sha").alias("node"), F.when(target != "", target).alias("parent"))
    chain = parent_chain(links).join(commits.select(F.col("sha").alias("node"), "ts"), "node")
    last = chain.groupBy("root").agg(F.max_by("depth", F.struct("ts", "depth", "node")).alias("depth"))
    return chain.select(F.col("node").alias("sha"), "root").join(
        last.select("root", (F.col("depth") % 2 == 0).alias("live")), "root").select("sha", "root", "live")


# --- modes of agents ----------------------------------------------------------------------------
def inherited_mode(edges: DataFrame, modes: DataFrame, user_mode: str = "off") -> DataFrame:
    """The strictest mode that binds each agent, and where it comes from.

    ``edges``: child, parent. ``modes``: agent, scope ('self' or 'subagents'), mode. An agent is
    bound by the user's mode, its own, and the 'subagents' mode of every agent above it.
    """
    user = lx.MODES.index(user_mode)
    held = modes.groupBy("agent").agg(
        F.min(F.when(F.col("scope") == "self", mode_rank(F.col("mode")))).alias("own"),
        F.min(F.when(F.col("scope") == "subagents", mode_rank(F.col("mode")))).alias("rank"))
    agents = edges.select(F.col("child").alias("agent")).union(edges.select("parent")).union(modes.select("agent")).distinct()
    parent = edges.groupBy(F.col("child").alias("agent")).agg(F.max("parent").alias("parent"))
    links = agents.join(parent, "agent", "left").join(held, "agent", "left").select(
        F.col("agent").alias("node"), "parent", "rank")
    above = climb(links).select(F.col("node").alias("agent"), F.try_element_at(F.filter(
        "above", lambda p: p["holder"] != F.col("node").cast("string")), F.lit(1))["rank"].alias("from_above"))
    rows = above.join(held.select("agent", "own"), "agent", "left")
    rank = F.least(F.lit(user), F.coalesce("own", F.lit(user)), F.coalesce("from_above", F.lit(user)))
    source = F.when(rank == user, "user").when(rank == F.col("own"), "own").otherwise("above")
    return rows.select("agent", rank.alias("rank"), source.alias("source"))


def uncovered_mode(held: DataFrame, user_mode: str) -> DataFrame:
    """Agent-set modes that are stricter than the user's; the others have no effect."""
    return held.where(mode_rank(F.col("mode")) < lx.MODES.index(user_mode))


# --- stacks -------------------------------------------------------------------------------------
def blocker_levels(items: DataFrame, plain: int = 24) -> DataFrame:
    """Length of the longest chain of blockers below each item; null in or above a cycle.

    ``items``: id, blocked_by. A round settles the items whose blockers all have a level. After ``plain`` rounds each one also
    contracts chains: an item with one blocker left takes its level from the nearest one below that has none or several, found by
    doubling, so a chain of n items takes log2(n) joins.
    """
    ids = items.select("id").distinct()
    links = items.select("id", F.explode("blocked_by").alias("by")).distinct()
    every = links = durable(links.join(ids.withColumnRenamed("id", "by"), "by", "left_semi").select("id", "by"))
    fresh = ids.join(links.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(0))
    done, level = [fresh], 0
    while level < plain and not links.isEmpty():
        level += 1
        rest = durable(links.join(fresh.select(F.col("id").alias("by")), "by", "left_anti"))
        touched = links.select("id").distinct().join(rest.select("id").distinct(), "id", "left_anti")
        fresh, links = durable(touched.withColumn("level", F.lit(level))), rest
        if fresh.isEmpty():
            return items.join(_all(done), "id", "left")  # only cycles are left
        done.append(fresh)
    if links.isEmpty():
        return items.join(_all(done), "id", "left")
    return items.join(_deep_levels(every, links, fresh, done), "id", "left")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _deep_levels(every: DataFrame, links: DataFrame, fresh: DataFrame, done: list[DataFrame]) -> DataFrame:
    """id, level of the items ``done`` and of those with ``links`` left to them or to each other; ``fresh`` are the ones done last."""
    low = durable(_all(done)).select(F.col("id").alias("by"), "level")
    left = links.select("id").distinct()
    known = every.join(left, "id", "left_semi").join(low, "by").groupBy("id").agg((F.max("level") + 1).alias("up"))
    floors = durable(left.join(known, "id", "left").select("id", F.coalesce("up", F.lit(0)).alias("floor")))
    links, done, follows = links.withColumn("w", F.lit(1)), [*done], []
    while not links.isEmpty():
        met = links.join(fresh.withColumnRenamed("id", "by"), "by", "left")
        raised = met.where("level is not null").groupBy("id").agg(F.max(F.col("level") + F.col("w")).alias("up"))
        links = durable(met.where("level is null").select("id", "by", "w"))
        floors = durable(floors.join(raised, "id", "left").select("id", F.greatest("floor", "up").alias("floor")))
        fresh = durable(floors.join(links.select("id").distinct(), "id", "left_anti").select("id", F.col("floor").alias("level")))
        floors = floors.join(fresh, "id", "left_anti")
        done.append(fresh)
        links, floors, follow = contract(links, floors)
        if fresh.isEmpty() and follow.isEmpty():
            break  # only cycles are left
        follows.append(follow)
    out = _all(done)
    for follow in reversed(follows):
        low = out.select(F.col("id").alias("by"), "level")
        out = durable(out.unionByName(follow.join(low, "by").select("id", F.greatest("floor", F.col("level") + F.col("w")).alias("level"))))
    return out


def contract(links: DataFrame, floors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links and floors without the items that have one link, and these as ``follow``: id, by, w, floor.

    The level of such an item is the larger of ``floor`` and ``w`` above the level of ``by``, and ``by`` is none of them. Items of a
    cycle of single links, and those above it, are in none of the three.
    """
    one = links.groupBy("id").agg(F.count("*").alias("n"), F.first("by").alias("by"), F.first("w").alias("w")).where("n = 1")
    state = durable(one.join(floors, "id").select("id", "by", "w", "floor"))
    single = state.select("id")
    for _ in range(ceil(log2(max(state.count(), 2))) + 1):
        low = state.select(F.col("id").alias("by"), F.col("by").alias("_by"), F.col("w").alias("_w"), F.col("floor").alias("_floor"))
        met = state.join(low, "by", "left")
        if met.where("_by is not null").isEmpty():
            break
        state = durable(met.select("id", F.coalesce("_by", "by").alias("by"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
                                   F.greatest("floor", F.col("_floor") + F.col("w")).alias("floor")))
    follow = durable(state.join(single.withColumnRenamed("id", "by"), "by", "left_anti").select("id", "by", "w", "floor"))
    rest = links.join(single, "id", "left_anti").join(
        follow.select(F.col("id").alias("by"), F.col("by").alias("_by"), F.col("w").alias("_w"), F.col("floor").alias("_floor")), "by", "left")
    rest = durable(rest.select("id", F.coalesce("_by", "by").alias("by"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
                               (F.col("_floor") + F.col("w")).alias("up")))
    raised = rest.groupBy("id").agg(F.max("up").alias("up"))
    kept = floors.join(single, "id", "left_anti").join(raised, "id", "left").select("id", F.greatest("floor", "up").alias("floor"))
    return rest.groupBy("id", "by").agg(F.max("w").alias("w")), durable(kept), follow


def stack_order(items: DataFrame, trunk: str = "main") -> DataFrame:
    """One bottom-to-top order per slice, every blocker below what it blocks.

    ``items``: slice, id, branch, blocked_by. ``base`` is the branch directly below, the trunk at
    the bottom. Items in or above a cycle have no place: their pos, level and base are null.
    """
    placed = durable(blocker_levels(items).select("slice", "level", "id", "branch"))
    levels = placed.where("level is not null")
    cut = range_segments(levels, ["slice", "level", "id"])
    out = carry(cut, ["slice"], ["level", "id"], F.col("_seg"), total={"pos": F.lit(1)}, prior={"base": F.col("branch")})
    stacked = out.select("slice", "id", "pos", "level", "branch", F.coalesce("base", F.lit(trunk)).alias("base"))
    none = lambda name: F.lit(None).cast(stacked.schema[name].dataType).alias(name)
    return stacked.unionByName(placed.where("level is null").select("slice", "id", none("pos"), "level", "branch", none("base")))


def riskiest_first(items: DataFrame, risk: Column) -> DataFrame:
    """Items that can start now, the riskiest first. ``items``: id, blocked_by, done."""
    open_items = items.where("not done").select(F.col("id").alias("by"))
    waiting = items.select("id", F.explode("blocked_by").alias("by")).join(open_items, "by", "left_semi").select("id").distinct()
    return items.where("not done").join(waiting, "id", "left_anti").withColumn("risk", risk).orderBy(F.desc("risk"), "id")
