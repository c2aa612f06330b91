"""Plan outlines: one JSON tree per file, flattened to tables."""
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.lineage import stored

SCHEMA = """
product STRUCT<name: STRING, status: STRING, worth_it: STRING,
  features: ARRAY<STRUCT<id: STRING, title: STRING, project: STRING, deferred: BOOLEAN>>>,
projects ARRAY<STRUCT<name: STRING, feature: STRING, spec_status: STRING, out_of_scope: ARRAY<STRING>,
  open_questions: ARRAY<STRING>,
  requirements: ARRAY<STRUCT<id: STRING, text: STRING, dropped: BOOLEAN, deferred: BOOLEAN>>,
  items: ARRAY<STRUCT<id: STRING, title: STRING, kind: STRING, requirements: ARRAY<STRING>, you_see: STRING,
    done_when: INT, chars: INT, blocked_by: ARRAY<STRING>>>>>
"""


@dataclass
class PlanTables:
    """products(tree, status, worth_it), features(tree, feature, project, deferred),
    projects(tree, project, feature, spec_status, out_of_scope, open_questions),
    requirements(tree, project, req, text, dropped, deferred),
    items(tree, project, item, kind, n_cited, you_see, done_when, chars, blocked_by),
    citations(tree, project, item, kind, req)."""

    products: DataFrame
    features: DataFrame
    projects: DataFrame
    requirements: DataFrame
    items: DataFrame
    citations: DataFrame

    def stored(self) -> "PlanTables":
        """The same tables, written once to the shared folder, for jobs that join them many times."""
        return PlanTables(*[stored(getattr(self, f.name)) for f in fields(self)])


def read_plans(spark: SparkSession, path: str) -> PlanTables:
    trees = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(
        F.col("_metadata.file_path").alias("tree"), "product", "projects")
    no = F.lit(False)
    products = trees.where("product is not null").select("tree", "product.status", "product.worth_it")
    features = trees.where("product is not null").select("tree", F.explode("product.features").alias("f")).select(
        "tree", F.col("f.id").alias("feature"), F.col("f.project").alias("project"), F.coalesce("f.deferred", no).alias("deferred"))
    each = trees.select("tree", F.explode("projects").alias("p"))
    name = F.coalesce("p.name", F.lit("?")).alias("project")
    projects = each.select(
        "tree", name, F.col("p.feature").alias("feature"), F.col("p.spec_status").alias("spec_status"),
        F.coalesce(F.size("p.out_of_scope"), F.lit(0)).alias("out_of_scope"),
        F.coalesce(F.size("p.open_questions"), F.lit(0)).alias("open_questions"))
    requirements = each.select("tree", name, F.explode("p.requirements").alias("r")).select(
        "tree", "project", F.col("r.id").alias("req"), F.coalesce("r.text", F.lit("")).alias("text"),
        F.coalesce("r.dropped", no).alias("dropped"), F.coalesce("r.deferred", no).alias("deferred"))
    rows = each.select("tree", name, F.explode("p.items").alias("i")).select(
        "tree", "project", F.coalesce("i.id", F.lit("?")).alias("item"), F.coalesce("i.kind", F.lit("build")).alias("kind"),
        F.coalesce("i.requirements", F.array().cast("array<string>")).alias("cited"), F.col("i.you_see").alias("you_see"),
        F.col("i.done_when").alias("done_when"), F.coalesce("i.chars", F.lit(0)).alias("chars"),
        F.coalesce("i.blocked_by", F.array().cast("array<string>")).alias("blocked_by"))
    items = rows.withColumn("n_cited", F.size("cited")).drop("cited")
    citations = rows.select("tree", "project", "item", "kind", F.explode("cited").alias("req"))
    return PlanTables(products, features, projects, requirements, items, citations)
