"""Constraint checks over many plan trees at once.

Each rule is a join or an aggregate over the flat plan tables and gives rows
(tree, rule, level, place, detail); ``level`` is problem or note. Rules over the same rows share one pass.
"""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import present
from turnwise.lineage import stored
from turnwise.operators.ordered import lookup
from turnwise.sources.plans import PlanTables

MAX_CHARS = 1500
MAX_CHECKS = 5
# Join keys begin with what tells most rows apart: a sort that begins with the few trees compares whole rows.
PROJECT = ["project", "tree"]
REQ = ["project", "req", "tree"]
ITEM = ["project", "item", "tree"]
# Fixed value: the line an item quotes a requirement with.
QUOTE = '- [ ] {id}: "{text}"\n'
QUOTE_FRAME = len(QUOTE.format(id="", text=""))


def _row(df: DataFrame, rule: str, place: Column, detail: Column | None = None, level: str = "problem") -> DataFrame:
    return df.select("tree", F.lit(rule).alias("rule"), F.lit(level).alias("level"), place.alias("place"),
                     (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def _project() -> Column:
    return F.col("project")


def _item() -> Column:
    return F.concat_ws("/", "project", "item")


def _found(rows: DataFrame, *rules: tuple[str, Column, Column, Column | None]) -> DataFrame:
    """The problems of ``rows`` by several rules (name, condition, place, detail), all from one pass over them.

    Only the conditions enter the explode: places and details are made for what is found, and not at all where nobody reads them.
    """
    rules = [(F.lit(name), holds, place, F.lit(None) if detail is None else detail) for name, holds, place, detail in rules]
    hits = rows.select("*", F.posexplode_outer(F.array(*[holds for _, holds, _, _ in rules])).alias("_nth", "_hit")).where("_hit")
    chosen = lambda part: reduce(lambda at, i: at.when(F.col("_nth") == i, rules[i][part].cast("string")), range(len(rules)), F)
    return hits.select("tree", chosen(0).alias("rule"), F.lit("problem").alias("level"), chosen(2).alias("place"), chosen(3).alias("detail"))


def project_feature(t: PlanTables) -> DataFrame:
    """Projects without their feature, features that name another project, features not yet shaped."""
    features = t.features.groupBy("tree", "feature").agg(F.lit(True).alias("known"))
    named = t.features.where("project is not null").groupBy("tree", "project").agg(F.lit(True).alias("named"))
    has_product = t.products.groupBy("tree").agg(F.lit(True).alias("has_product"))
    rows = lookup(t.projects, has_product, ["tree"], ["project"], "inner")
    rows = lookup(rows, features, ["feature", "tree"])
    rows = rows.join(named, PROJECT, "left")
    waiting = t.features.where("project is null and not deferred")
    return _found(
        rows,
        ("serves no feature", F.expr("known is null"), _project(), F.col("feature")),
        ("feature does not name it", F.expr("known is not null and named is null"), _project(), F.col("feature")),
    ).unionByName(_row(waiting, "not yet shaped", F.col("feature"), level="note"))


def cited_requirements(t: PlanTables) -> DataFrame:
    """Distinct citations by items that are no prototypes, with ``dropped`` and ``req_chars`` of the requirement; null where the spec lacks it."""
    reqs = t.requirements.groupBy(*REQ).agg(
        F.bool_or("dropped").alias("dropped"), F.max(F.length("text")).alias("req_chars"))
    return lookup(t.citations.where("kind <> 'prototype'").distinct(), reqs, REQ)


def orphan_citation(t: PlanTables, cites: DataFrame | None = None) -> DataFrame:
    """Items that cite a requirement the spec lacks or has dropped. ``cites``: ``cited_requirements``, if at hand."""
    return _found(
        cited_requirements(t) if cites is None else cites,
        ("cites a missing requirement", F.expr("dropped is null"), _item(), F.col("req")),
        ("cites a dropped requirement", F.col("dropped"), _item(), F.col("req")))


def uncovered_requirement(t: PlanTables, launch: bool = False, cites: DataFrame | None = None) -> DataFrame:
    """Live requirements of a confirmed spec that no item cites; prototypes cover nothing."""
    cites = t.citations.where("kind <> 'prototype'") if cites is None else cites
    covered = cites.select("tree", "project", "req").distinct()
    confirmed = t.projects.where("spec_status = 'Confirmed'").select("tree", "project").distinct()
    live = t.requirements.where("not dropped and not deferred")
    open_reqs = lookup(live, confirmed, PROJECT, how="inner").join(
        covered, REQ, "left_anti")
    return _row(open_reqs, "no item yet", _project(), F.col("req"), "problem" if launch else "note")


def item_budget(t: PlanTables, max_chars: int = MAX_CHARS, max_checks: int = MAX_CHECKS, cites: DataFrame | None = None) -> DataFrame:
    """Items with too many checks, or too long after the quoted lines of the requirements they cite."""
    cites = cited_requirements(t) if cites is None else cites
    quoted = cites.where("req_chars is not null").groupBy(*ITEM).agg(
        F.sum(F.length("req") + F.col("req_chars") + QUOTE_FRAME).alias("quoted"))
    items = t.items.where("kind <> 'prototype'")
    checks = items.where(F.col("done_when").isNotNull() & ~F.col("done_when").between(1, max_checks))
    # quotes only shorten a body, so only those over the limit with them meet their quotes
    long = items.where(F.col("chars") > max_chars).join(quoted, ITEM, "left").withColumn(
        "quoted", F.coalesce("quoted", F.lit(0))).where(F.col("chars") - F.col("quoted") > max_chars)
    return _row(checks, "number of checks", _item(), F.col("done_when")).unionByName(
        _row(long, "body too long", _item(), F.concat_ws(" of ", F.col("quoted").cast("string"), F.col("chars").cast("string"))))


def spec_completeness(t: PlanTables) -> DataFrame:
    """What a confirmed product or spec must have, and what an item must say."""
    blank_product = t.products.where((F.col("status") == "Confirmed") & ~present("worth_it"))
    yes = F.lit(True)
    confirmed = t.projects.where("spec_status = 'Confirmed'")
    draft = t.products.where("status is distinct from 'Confirmed'").select("tree").distinct().withColumn("draft", yes)
    live = t.requirements.where("not dropped").select("tree", "project").distinct().withColumn("live", yes)
    specs = lookup(confirmed, draft, ["tree"], ["project"]).join(live, PROJECT, "left")
    sure = confirmed.select("tree", "project").distinct().withColumn("sure", yes)
    items = lookup(t.items.where("kind <> 'prototype'"), sure, PROJECT)
    return reduce(DataFrame.unionByName, [
        _row(blank_product, "confirmed with worth it blank", F.lit("product")),
        _found(
            specs,
            ("confirmed under a draft product", F.col("draft"), _project(), None),
            ("no requirements", F.expr("live is null"), _project(), None),
            ("empty out of scope", F.col("out_of_scope") == 0, _project(), None),
            ("open questions", F.col("open_questions") > 0, _project(), None)),
        _found(
            items,
            ("item under a draft spec", F.expr("sure is null"), _item(), F.col("kind")),
            ("cites no requirement", F.expr("kind <> 'chore' and n_cited = 0"), _item(), None),
            ("no 'you see' line", F.col("kind").isin("build", "bug") & ~present("you_see"), _item(), None))])


def plan_findings(t: PlanTables, launch: bool = False) -> DataFrame:
    """All rules; citations meet their requirements once, and what comes of it is written to the shared folder."""
    cites = stored(cited_requirements(t))
    return reduce(DataFrame.unionByName, [
        project_feature(t), orphan_citation(t, cites), uncovered_requirement(t, launch, cites), item_budget(t, cites=cites), spec_completeness(t)])


def tree_report(trees: DataFrame, findings: DataFrame) -> DataFrame:
    """Problems and notes per tree; a tree without problems is ok."""
    counts = findings.groupBy("tree").agg(
        F.count_if(F.col("level") == "problem").alias("problems"), F.count_if(F.col("level") == "note").alias("notes"))
    zero = F.lit(0).cast("bigint")
    return trees.select("tree").distinct().join(counts, "tree", "left").select(
        "tree", F.coalesce("problems", zero).alias("problems"), F.coalesce("notes", zero).alias("notes"),
        (F.coalesce("problems", zero) == 0).alias("ok"))


def rollup_status(items: DataFrame) -> DataFrame:
    """Done share per milestone, project and product from the items' own state.

    ``items``: product, project, milestone, done. A level is closed when all below it is. Items without a
    milestone are a milestone row of their own, with a null.
    """
    base = items.groupBy("product", "project", "milestone").agg(
        F.count("*").alias("items"), F.count_if("done").alias("done"))
    up = base.rollup("product", "project", "milestone").agg(
        F.grouping_id().alias("_left_out"), F.sum("items").alias("items"), F.sum("done").alias("done"))
    level = F.element_at(F.create_map(F.lit(0), F.lit("milestone"), F.lit(1), F.lit("project"), F.lit(3), F.lit("product")), F.col("_left_out").cast("int"))
    return up.withColumn("level", level).where("level is not null").withColumn("closed", F.col("items") == F.col("done")).drop("_left_out")


def flag_downstream(t: PlanTables, changed_requirements: DataFrame, changed_features: DataFrame) -> DataFrame:
    """Items that cite a changed requirement, and specs whose feature changed (back to Draft)."""
    reqs = changed_requirements.select("tree", "project", "req").distinct()
    cites = lookup(t.citations.distinct(), reqs, ["tree", "project", "req"], how="inner")
    feats = changed_features.select("tree", "feature").distinct()
    specs = lookup(t.projects, feats, ["tree", "feature"], how="inner")
    return cites.select("tree", F.lit("item").alias("level"), _item().alias("place"), F.col("req").alias("cause")).unionByName(
        specs.select("tree", F.lit("spec").alias("level"), _project().alias("place"), F.col("feature").alias("cause")))
