"""Plan checks on the star schema.

An order is a project, its lines are items, parts are requirements, the customer is the feature
and the customer's market segment the tree.
"""
from pyspark.sql import functions as F

from turnwise.operators import trees
from turnwise.plans.registry import query, table
from turnwise.sources.plans import PlanTables


def plan_tables(spark, sf_dir) -> PlanTables:
    s = lambda c: F.col(c).cast("string")
    customer, orders, line, part = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    product = customer.groupBy(F.col("c_mktsegment").alias("tree")).agg(F.max("c_acctbal").alias("top"))
    products = product.select("tree", F.when(F.col("tree") < "F", "Draft").otherwise("Confirmed").alias("status"),
                              F.when(F.col("tree") != "MACHINERY", F.lit("worth it")).alias("worth_it"))
    features = customer.where("c_custkey % 7 <> 0").select(
        F.col("c_mktsegment").alias("tree"), s("c_custkey").alias("feature"),
        F.when(F.col("c_custkey") % 3 == 0, s("c_custkey")).alias("project"), (F.col("c_custkey") % 5 == 0).alias("deferred"))
    seg = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tree"))
    project = orders.join(seg, "o_custkey")
    projects = project.select(
        "tree", s("o_orderkey").alias("project"), s("o_custkey").alias("feature"),
        F.when(F.col("o_orderstatus") == "F", "Confirmed").otherwise("Draft").alias("spec_status"),
        (F.col("o_orderkey") % 4).cast("int").alias("out_of_scope"), (F.col("o_orderkey") % 2).cast("int").alias("open_questions"))
    tree_of = project.select(F.col("o_orderkey").alias("l_orderkey"), "tree")
    lines = line.join(tree_of, "l_orderkey")
    parts = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text"),
                        (F.col("p_size") > 40).alias("dropped"), (F.col("p_size") < 5).alias("deferred")).distinct()
    # A project owns the requirements of its returned and open lines; accepted lines cite without one.
    # Rows are made distinct while they still lie by order key, before the parts' texts join and keys become strings.
    requirements = lines.where("l_returnflag <> 'A'").select("tree", "l_orderkey", "l_partkey").distinct().join(parts, "l_partkey").select(
        "tree", s("l_orderkey").alias("project"), s("l_partkey").alias("req"), "text", "dropped", "deferred")
    kind = F.when(F.col("l_linenumber") == 7, "prototype").when(F.col("l_linenumber") == 6, "chore").otherwise("build")
    item = F.concat_ws("-", s("l_linenumber"), s("l_suppkey"), s("l_partkey"))
    rows = lines.select("tree", "l_orderkey", item.alias("item"), kind.alias("kind"), F.when(F.col("l_tax") > 0.02, "x").alias("you_see"),
                        (F.col("l_quantity") / 8).cast("int").alias("done_when"),
                        (F.col("l_extendedprice") / 40).cast("int").alias("chars"), s("l_partkey").alias("req"), "l_linestatus")
    project_of = s("l_orderkey").alias("project")
    items = rows.drop("req").distinct().select(
        "tree", project_of, "item", "kind", F.lit(1).alias("n_cited"), "you_see", "done_when", "chars",
        F.array().cast("array<string>").alias("blocked_by"), "l_linestatus")
    citations = rows.where("l_linestatus = 'O'").select("tree", project_of, "item", "kind", "req")
    return PlanTables(products, features, projects, requirements, items, citations)


BASE = """
WITH products AS (SELECT c_mktsegment AS tree, CASE WHEN c_mktsegment < 'F' THEN 'Draft' ELSE 'Confirmed' END AS status,
                         CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'worth it' END AS worth_it FROM customer GROUP BY 1),
features AS (SELECT c_mktsegment AS tree, c_custkey AS feature, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS project,
                    c_custkey % 5 = 0 AS deferred FROM customer WHERE c_custkey % 7 <> 0),
projects AS (SELECT c_mktsegment AS tree, o_orderkey AS project, o_custkey AS feature,
                    CASE WHEN o_orderstatus = 'F' THEN 'Confirmed' ELSE 'Draft' END AS spec_status,
                    o_orderkey % 4 AS out_of_scope, o_orderkey % 2 AS open_questions FROM orders JOIN customer ON c_custkey = o_custkey),
lines AS (SELECT l.*, p.tree FROM lineitem l JOIN projects p ON p.project = l.l_orderkey),
reqs AS (SELECT DISTINCT tree, l_orderkey AS project, l_partkey AS req, p_name AS text, p_size > 40 AS dropped, p_size < 5 AS deferred
         FROM lines JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A'),
items AS (SELECT DISTINCT tree, l_orderkey AS project, l_linenumber || '-' || l_suppkey || '-' || l_partkey AS item,
                 CASE l_linenumber WHEN 7 THEN 'prototype' WHEN 6 THEN 'chore' ELSE 'build' END AS kind,
                 CASE WHEN l_tax > 0.02 THEN 'x' END AS you_see, CAST(trunc(l_quantity / 8) AS INTEGER) AS done_when,
                 CAST(trunc(l_extendedprice / 40) AS INTEGER) AS chars, l_linestatus FROM lines),
cites AS (SELECT DISTINCT tree, l_orderkey AS project, l_linenumber || '-' || l_suppkey || '-' || l_partkey AS item,
                 CASE l_linenumber WHEN 7 THEN 'prototype' WHEN 6 THEN 'chore' ELSE 'build' END AS kind, l_partkey AS req
          FROM lines WHERE l_linestatus = 'O'),
"""

FEATURE = """
f_feature AS (
  SELECT p.tree, 'serves no feature' AS rule, 'problem' AS level, CAST(p.project AS VARCHAR) AS place, CAST(p.feature AS VARCHAR) AS detail
  FROM projects p LEFT JOIN features f ON f.tree = p.tree AND f.feature = p.feature WHERE f.feature IS NULL
  UNION ALL
  SELECT p.tree, 'feature does not name it', 'problem', CAST(p.project AS VARCHAR), CAST(p.feature AS VARCHAR)
  FROM projects p JOIN features f ON f.tree = p.tree AND f.feature = p.feature
  WHERE NOT EXISTS (SELECT 1 FROM features n WHERE n.tree = p.tree AND n.project = p.project)
  UNION ALL
  SELECT tree, 'not yet shaped', 'note', CAST(feature AS VARCHAR), NULL FROM features WHERE project IS NULL AND NOT deferred),
"""
ORPHAN = """
f_orphan AS (
  SELECT c.tree, CASE WHEN r.req IS NULL THEN 'cites a missing requirement' ELSE 'cites a dropped requirement' END AS rule,
         'problem' AS level, c.project || '/' || c.item AS place, CAST(c.req AS VARCHAR) AS detail
  FROM cites c LEFT JOIN reqs r ON r.tree = c.tree AND r.project = c.project AND r.req = c.req
  WHERE c.kind <> 'prototype' AND (r.req IS NULL OR r.dropped)),
"""
UNCOVERED = """
f_uncovered AS (
  SELECT r.tree, 'no item yet' AS rule, 'note' AS level, CAST(r.project AS VARCHAR) AS place, CAST(r.req AS VARCHAR) AS detail
  FROM reqs r JOIN projects p ON p.tree = r.tree AND p.project = r.project AND p.spec_status = 'Confirmed'
  WHERE NOT r.dropped AND NOT r.deferred AND NOT EXISTS (
    SELECT 1 FROM cites c WHERE c.kind <> 'prototype' AND c.tree = r.tree AND c.project = r.project AND c.req = r.req)),
"""
BUDGET = """
quoted AS (
  SELECT c.tree, c.project, c.item, SUM(length(CAST(c.req AS VARCHAR)) + length(r.text) + 11) AS quoted
  FROM cites c JOIN reqs r ON r.tree = c.tree AND r.project = c.project AND r.req = c.req WHERE c.kind <> 'prototype' GROUP BY 1, 2, 3),
b AS (SELECT i.*, COALESCE(q.quoted, 0) AS quoted FROM items i LEFT JOIN quoted q USING (tree, project, item) WHERE kind <> 'prototype'),
f_budget AS (
  SELECT tree, 'number of checks' AS rule, 'problem' AS level, project || '/' || item AS place, CAST(done_when AS VARCHAR) AS detail
  FROM b WHERE done_when NOT BETWEEN 1 AND 5
  UNION ALL
  SELECT tree, 'body too long', 'problem', project || '/' || item, quoted || ' of ' || chars FROM b WHERE chars - quoted > 1500),
"""
SPEC = """
f_spec AS (
  SELECT tree, 'confirmed with worth it blank' AS rule, 'problem' AS level, 'product' AS place, CAST(NULL AS VARCHAR) AS detail
  FROM products WHERE status = 'Confirmed' AND worth_it IS NULL
  UNION ALL SELECT p.tree, 'confirmed under a draft product', 'problem', CAST(project AS VARCHAR), NULL
  FROM projects p JOIN products d ON d.tree = p.tree AND d.status <> 'Confirmed' WHERE spec_status = 'Confirmed'
  UNION ALL SELECT tree, 'no requirements', 'problem', CAST(project AS VARCHAR), NULL FROM projects p WHERE spec_status = 'Confirmed'
    AND NOT EXISTS (SELECT 1 FROM reqs r WHERE r.tree = p.tree AND r.project = p.project AND NOT r.dropped)
  UNION ALL SELECT tree, 'empty out of scope', 'problem', CAST(project AS VARCHAR), NULL FROM projects WHERE spec_status = 'Confirmed' AND out_of_scope = 0
  UNION ALL SELECT tree, 'open questions', 'problem', CAST(project AS VARCHAR), NULL FROM projects WHERE spec_status = 'Confirmed' AND open_questions > 0
  UNION ALL SELECT i.tree, 'item under a draft spec', 'problem', i.project || '/' || item, kind FROM items i
    JOIN projects p ON p.tree = i.tree AND p.project = i.project AND p.spec_status <> 'Confirmed' WHERE kind <> 'prototype'
  UNION ALL SELECT tree, 'no ''you see'' line', 'problem', project || '/' || item, NULL FROM items WHERE kind = 'build' AND you_see IS NULL),
"""
LAST = "z AS (SELECT 1) "


@query(BASE + FEATURE + LAST + "SELECT tree, rule, level, place, detail FROM f_feature")
def project_feature(spark, sf_dir):
    """Orders against their customers."""
    return trees.project_feature(plan_tables(spark, sf_dir))


@query(BASE + ORPHAN + LAST + "SELECT tree, rule, level, place, detail FROM f_orphan")
def orphan_refs(spark, sf_dir):
    """Lines that cite a part their order does not hold or has dropped."""
    return trees.orphan_citation(plan_tables(spark, sf_dir))


@query(BASE + UNCOVERED + LAST + "SELECT tree, rule, level, place, detail FROM f_uncovered")
def uncovered(spark, sf_dir):
    """Live parts of finished orders that no line cites."""
    return trees.uncovered_requirement(plan_tables(spark, sf_dir))


@query(BASE + BUDGET + LAST + "SELECT tree, rule, level, place, detail FROM f_budget")
def budget_breach(spark, sf_dir):
    """Lines over the check or length budget."""
    return trees.item_budget(plan_tables(spark, sf_dir))


@query(BASE + SPEC + LAST + "SELECT tree, rule, level, place, detail FROM f_spec")
def completeness(spark, sf_dir):
    """What finished orders and their lines lack."""
    return trees.spec_completeness(plan_tables(spark, sf_dir))


@query(BASE + FEATURE + ORPHAN + UNCOVERED + BUDGET + SPEC + """
a AS (SELECT tree, level FROM f_feature UNION ALL SELECT tree, level FROM f_orphan UNION ALL SELECT tree, level FROM f_uncovered
      UNION ALL SELECT tree, level FROM f_budget UNION ALL SELECT tree, level FROM f_spec)
SELECT p.tree, COUNT(*) FILTER (WHERE level = 'problem') AS problems, COUNT(*) FILTER (WHERE level = 'note') AS notes,
       COUNT(*) FILTER (WHERE level = 'problem') = 0 AS ok FROM products p LEFT JOIN a USING (tree) GROUP BY 1""")
def tree_report(spark, sf_dir):
    """Problems and notes per market segment."""
    t = plan_tables(spark, sf_dir).stored()
    return trees.tree_report(t.products, trees.plan_findings(t))


@query("""
WITH i AS (SELECT r_name AS product, n_name AS project, o_orderpriority AS milestone, o_orderstatus = 'F' AS done
           FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
u AS (SELECT product, project, milestone, COUNT(*) AS items, COUNT(*) FILTER (WHERE done) AS done FROM i
      GROUP BY ROLLUP (product, project, milestone))
SELECT *, items = done AS closed, CASE WHEN milestone IS NOT NULL THEN 'milestone' WHEN project IS NOT NULL THEN 'project' ELSE 'product' END AS level
FROM u WHERE product IS NOT NULL""")
def rollup_status(spark, sf_dir):
    """Finished orders per priority, nation and region."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    items = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return trees.rollup_status(items.select(
        F.col("r_name").alias("product"), F.col("n_name").alias("project"), F.col("o_orderpriority").alias("milestone"),
        (F.col("o_orderstatus") == "F").alias("done")))


@query(BASE + """
cr AS (SELECT tree, project, req FROM reqs WHERE dropped),
cf AS (SELECT tree, feature FROM features WHERE project IS NOT NULL)
SELECT c.tree, 'item' AS level, c.project || '/' || c.item AS place, CAST(c.req AS VARCHAR) AS cause FROM cites c JOIN cr USING (tree, project, req)
UNION ALL SELECT p.tree, 'spec', CAST(p.project AS VARCHAR), CAST(p.feature AS VARCHAR) FROM projects p JOIN cf USING (tree, feature)""")
def flag_downstream(spark, sf_dir):
    """Lines and orders below changed parts and customers."""
    t = plan_tables(spark, sf_dir)
    return trees.flag_downstream(t, t.requirements.where("dropped"), t.features.where("project is not null"))
