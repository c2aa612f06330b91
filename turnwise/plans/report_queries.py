"""Evaluation, findings, records, run logs, motion and chunks on the given tables."""
from pyspark.sql import functions as F

from turnwise.lineage import new_folder
from turnwise.operators import chunks, evals, findings, motion, records, runlog
from turnwise.operators.ordered import int_segment
from turnwise.plans.log_queries import kind_events
from turnwise.plans.registry import query, table
from turnwise.sources import chunk_files

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


# --- evaluation ---------------------------------------------------------------------------------
def eval_tables(spark, sf_dir):
    item = F.col("item_id")
    graders = table(spark, sf_dir, "benchmark").select(
        (item % 20).alias("case"), item.alias("grader"), F.when(item % 2 == 0, "tool_used").otherwise("regex").alias("type"),
        F.when(item % 4 == 0, "click").otherwise("view").alias("tool"),
        F.when(item % 3 != 0, F.concat(F.lit('"k": '), (item % 10).cast("string"))).alias("input_match"),
        F.when(item % 5 == 0, (item % 3).cast("int")).alias("min"), F.when(item % 7 < 3, (item % 7).cast("int")).alias("max"),
        F.when(item % 3 == 0, "la ").otherwise("th[ae]").alias("pattern"),
        F.when(item % 8 == 1, "not_contains").alias("match"), F.lit(None).cast("string").alias("target"))
    trace = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("case"), F.col("user_id").alias("run"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("tool"), F.col("props").alias("input"))
    texts = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 20).alias("case"), (F.col("conv_id") * 100 + F.col("turn")).alias("run"), F.lit("trace").alias("target"), "text")
    return graders, trace, texts


GRADERS = """
WITH g AS (SELECT item_id % 20 AS "case", item_id AS grader, item_id % 2 = 0 AS is_tool, CASE WHEN item_id % 4 = 0 THEN 'click' ELSE 'view' END AS tool,
    CASE WHEN item_id % 3 <> 0 THEN '"k": ' || (item_id % 10) ELSE '' END AS m, CASE WHEN item_id % 5 = 0 THEN item_id % 3 END AS lo,
    CASE WHEN item_id % 7 < 3 THEN item_id % 7 END AS hi, CASE WHEN item_id % 3 = 0 THEN 'la ' ELSE 'th[ae]' END AS pattern, item_id % 8 = 1 AS neg FROM benchmark),
runs AS (SELECT DISTINCT user_id % 20 AS "case", user_id AS run FROM events),
n AS (SELECT r."case", r.run, g.grader, lo, hi, (SELECT COUNT(*) FROM events e WHERE e.user_id = r.run AND e.event_type = g.tool
        AND regexp_matches(e.props, g.m)) AS n FROM runs r JOIN g ON g."case" = r."case" AND is_tool),
gt AS (SELECT "case", run, grader, n >= COALESCE(lo, CASE WHEN hi IS NULL THEN 1 ELSE 0 END) AND (hi IS NULL OR n <= hi) AS passed FROM n),
gr AS (SELECT c.conv_id % 20 AS "case", c.conv_id * 100 + c.turn AS run, grader, regexp_matches(text, pattern) <> neg AS passed
       FROM conversations c JOIN g ON g."case" = c.conv_id % 20 AND NOT is_tool)
"""


@query(GRADERS + 'SELECT "case", run, grader, passed FROM gt')
def grade_tool_used(spark, sf_dir):
    """Users as runs graded by their calls."""
    graders, trace, _ = eval_tables(spark, sf_dir)
    return evals.grade_tool_used(trace.select("case", "run").distinct(), graders, trace)


@query(GRADERS + 'SELECT "case", run, grader, passed FROM gr')
def grade_regex(spark, sf_dir):
    """Every turn graded by patterns."""
    graders, _, texts = eval_tables(spark, sf_dir)
    return evals.grade_regex(graders, texts)


@query(GRADERS + """, a AS (SELECT * FROM gt UNION ALL SELECT "case", run + 1000000, grader, passed FROM gr),
r AS (SELECT "case", run, bool_and(passed) AS ok FROM a GROUP BY 1, 2)
SELECT "case" % 3 AS suite, "case", COUNT(*) AS runs, COUNT(*) FILTER (WHERE ok) AS passes, ROUND(COUNT(*) FILTER (WHERE ok) / COUNT(*), 6) AS pass_rate
FROM r GROUP BY GROUPING SETS (("case" % 3, "case"), ("case" % 3))""")
def grade_rollup(spark, sf_dir):
    """Pass rates per case and suite."""
    graders, trace, texts = eval_tables(spark, sf_dir)
    grades = evals.grade_tool_used(trace.select("case", "run").distinct(), graders, trace).unionByName(
        evals.grade_regex(graders, texts).withColumn("run", F.col("run") + 1_000_000))
    suites = graders.select("case").distinct().withColumn("suite", F.col("case") % 3)
    return evals.grade_rollup(grades, suites).withColumn("pass_rate", F.round("pass_rate", 6))


@query(r"""
WITH x AS (SELECT source AS skill, quality = 1 AS s, regexp_matches(text, '\*\*\*|###|@') AS f FROM labels JOIN documents USING (doc_id)),
n AS (SELECT skill, COUNT(*) FILTER (WHERE s AND f) AS tp, COUNT(*) FILTER (WHERE NOT s AND f) AS fp,
             COUNT(*) FILTER (WHERE s AND NOT f) AS fn, COUNT(*) FILTER (WHERE NOT s AND NOT f) AS tn FROM x GROUP BY 1)
SELECT skill, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN ROUND(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN ROUND(tp / (tp + fn), 6) END AS recall FROM n""")
def trigger_confusion(spark, sf_dir):
    """Quality labels against a rule that fires on junk marks."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("skill"), F.col("doc_id").alias("query"), (F.col("quality") == 1).alias("should_trigger"))
    fired = docs.where(F.col("text").rlike(r"\*\*\*|###|@")).select(F.col("source").alias("skill"), F.col("doc_id").alias("query"))
    return evals.trigger_confusion(labels, fired).withColumns(
        {"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


# --- findings -----------------------------------------------------------------------------------
def finding_rows(spark, sf_dir):
    proof = F.element_at(F.array(*[F.lit(p) for p in ("stated", "pointed at the line", "walked through", "run")]), (F.col("event_id") % 4 + 1).cast("int"))
    odd = F.col("event_id") % 2 == 1
    return kind_events(spark, sf_dir).select(
        "event_id", (F.col("user_id") % 7).alias("reviewer"), (F.col("k") % 20).alias("file"), F.col("k").alias("line"),
        F.when(odd, F.concat(F.upper("event_type"), F.lit(" fails!"))).otherwise(F.concat("event_type", F.lit("  fails"))).alias("defect"),
        proof.alias("proof_level"), "k", "event_type")


FINDINGS = f"""
WITH f AS (SELECT event_id, user_id % 7 AS reviewer, {K} % 20 AS file, {K} AS line, {K} AS k, event_type, event_type || ' fails' AS key,
  CASE WHEN event_id % 2 = 1 THEN upper(event_type) || ' fails!' ELSE event_type || '  fails' END AS defect, event_id % 4 AS proof FROM events)
"""


@query(FINDINGS + """SELECT file, line, key, MIN(defect) AS defect, CAST(MAX(proof) AS INTEGER) AS proof,
  string_agg(DISTINCT reviewer, ',' ORDER BY reviewer) AS reviewers FROM f GROUP BY 1, 2, 3""")
def finding_dedupe_join(spark, sf_dir):
    """The same defect from several reviewers once."""
    return findings.finding_dedupe_join(finding_rows(spark, sf_dir)).withColumn(
        "reviewers", F.array_join(F.col("reviewers").cast("array<string>"), ","))


@query(FINDINGS + "SELECT event_id FROM f WHERE NOT (event_type = 'view' AND k < 30)")
def known_bug_filter(spark, sf_dir):
    """Findings the ledger does not hold."""
    rows = finding_rows(spark, sf_dir)
    ledger = rows.where("event_type = 'view' and k < 30").select("file", "line", F.upper("defect").alias("defect"))
    return findings.known_bug_filter(rows, ledger).select("event_id")


@query(FINDINGS + """SELECT event_id, CASE WHEN k % 3 = 2 THEN 'Dismissed' WHEN k % 3 = 0 AND (event_id % 5 = 0 OR event_id % 11 = 0) THEN 'Noted'
  WHEN k % 3 = 0 AND proof >= 2 THEN 'Act on' ELSE 'Consider' END AS "group" FROM f""")
def tier_route(spark, sf_dir):
    """Findings sorted into what to do with them."""
    rows = finding_rows(spark, sf_dir).withColumns({
        "proof": findings.proof_rank(F.col("proof_level")),
        "reality": F.element_at(F.array(F.lit("real"), F.lit("plausible"), F.lit("wrong")), (F.col("k") % 3 + 1).cast("int")),
        "in_scope": F.col("event_id") % 5 != 0, "minor": F.col("event_id") % 11 == 0})
    return findings.finding_route(rows).select("event_id", "group")


@query(FINDINGS + "SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS rank FROM f")
def ranked_findings(spark, sf_dir):
    """Findings by severity."""
    severity = F.when(F.col("event_type") == "error", "broken").when(F.col("event_type") == "view", "ugly").otherwise("Fragile")
    return findings.ranked_findings(finding_rows(spark, sf_dir).withColumn("severity", severity)).select("event_id", "rank")


@query(f"""
WITH c AS (SELECT user_id AS claim, COUNT(*) AS cites, bool_or(event_type = 'purchase' AND {K} % 20 = 0) AS direct,
                  COUNT(DISTINCT CASE WHEN event_type = 'view' THEN {K} % 50 END) AS sources FROM events GROUP BY 1)
SELECT c_custkey AS claim, c_custkey % 2 = 0 AS searched, CASE WHEN direct THEN 'Direct' WHEN sources >= 2 THEN 'Supported' WHEN cites > 0 THEN 'Inferred'
  WHEN c_custkey % 2 = 0 THEN 'Unknown' ELSE 'Speculative' END AS tier FROM customer LEFT JOIN c ON claim = c_custkey""")
def evidence_tier(spark, sf_dir):
    """Customers as claims, events as citations."""
    ev = kind_events(spark, sf_dir)
    cites = ev.select(F.col("user_id").alias("claim"), (F.col("k") % 50).alias("source"),
                      ((F.col("event_type") == "purchase") & (F.col("k") % 20 == 0)).alias("direct"), (F.col("event_type") == "view").alias("agrees"))
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim"), (F.col("c_custkey") % 2 == 0).alias("searched"))
    return findings.evidence_tier(claims, cites)


@query(f"""
WITH c AS (SELECT event_id AS claim, CASE WHEN event_id % 2 = 0 THEN left(md5(CAST({K} * 17 AS VARCHAR)), 6 + {K} % 5) ELSE 'f' || ({K} * 3) || '.txt' END AS ref FROM events)
SELECT claim, ref FROM c WHERE NOT EXISTS (SELECT 1 FROM documents WHERE length(ref) >= 7 AND starts_with(md5(CAST(doc_id AS VARCHAR)), ref))
  AND NOT EXISTS (SELECT 1 FROM customer WHERE ref = 'f' || (c_custkey % 150) || '.txt')""")
def evidence_resolves(spark, sf_dir):
    """Pointers that are neither a known commit nor a file."""
    k = F.col("k")
    ref = F.when(F.col("event_id") % 2 == 0, F.left(F.md5((k * 17).cast("string")), k % 5 + 6)).otherwise(
        F.concat(F.lit("f"), (k * 3).cast("string"), F.lit(".txt")))
    claims = kind_events(spark, sf_dir).select(F.col("event_id").alias("claim"), ref.alias("ref"))
    commits = table(spark, sf_dir, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("sha"))
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), (F.col("c_custkey") % 150).cast("string"), F.lit(".txt")).alias("path"))
    return findings.evidence_resolves(claims, commits, files)


@query("""
WITH a AS (SELECT lpad(CAST(doc_id % 37 AS VARCHAR), 2, '0') AS area, CAST(SUM(n_chars) AS BIGINT) AS n FROM documents GROUP BY 1),
c AS (SELECT area, n, SUM(n) OVER (ORDER BY area) AS upto, SUM(n) OVER () AS whole FROM a)
SELECT doc_id AS path, (least(floor((upto - n / 2) * 3 / whole), 2) + 1) % 3 AS shard FROM documents JOIN c ON area = lpad(CAST(doc_id % 37 AS VARCHAR), 2, '0')""")
def shard_plan(spark, sf_dir):
    """Documents in three shards of about equal size, second round."""
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.lpad((F.col("doc_id") % 37).cast("string"), 2, "0").alias("area"), F.col("n_chars").alias("lines"))
    return findings.shard_plan(files, 3, 1).select("path", "shard")


COVERAGE = """
WITH t AS (SELECT COUNT(DISTINCT user_id) AS n FROM events WHERE user_id % 5 <> 0),
r AS (SELECT CAST(day(ts) AS INTEGER) AS round, COUNT(DISTINCT user_id) AS files_read FROM events WHERE user_id % 5 <> 0 GROUP BY 1)
"""


def coverage(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("round"), F.col("user_id").alias("path"), "event_type", "value")
    return ev, findings.coverage_percent(ev.where("user_id % 5 <> 0").select("path"), ev.select("round", "path"))


@query(COVERAGE + "SELECT round, files_read, n AS files, files_read * 100 // n AS percent FROM r, t")
def coverage_percent(spark, sf_dir):
    """Users seen per day."""
    return coverage(spark, sf_dir)[1]


@query(COVERAGE + """, b AS (SELECT CAST(day(ts) AS INTEGER) AS round, MAX(value) < 99 AS quiet FROM events GROUP BY 1)
SELECT round, quiet AND COALESCE(files_read = n, FALSE) AS clean FROM b LEFT JOIN r USING (round), t""")
def clean_round(spark, sf_dir):
    """Days without a high value on which every user was seen."""
    ev, cover = coverage(spark, sf_dir)
    rounds = ev.select("round", F.col("event_type").alias("hunter"), F.when(F.col("value") >= 99, 1).otherwise(0).alias("bugs"))
    return findings.clean_round(rounds, cover)


@query(f"""
WITH r AS (SELECT user_id AS feature, CASE WHEN {K} < 40 THEN NULL WHEN {K} = 41 THEN 'skipped' WHEN {K} = 42 THEN 'failed' ELSE 'passed' END AS o FROM events WHERE event_type = 'view')
SELECT feature, COUNT(o) AS ran, CASE WHEN COUNT(*) FILTER (WHERE o = 'skipped') > 0 THEN 'BLOCKED' WHEN COUNT(o) = 0 OR COUNT(*) FILTER (WHERE o = 'failed') > 0
  THEN 'NOT VERIFIED' ELSE 'VERIFIED' END AS verdict FROM r GROUP BY 1""")
def verify_rollup(spark, sf_dir):
    """Users as features, their views as test results."""
    k = F.col("k")
    out = F.when(k == 41, "skipped").when(k == 42, "failed").when(k >= 40, "passed")
    return findings.verify_rollup(kind_events(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("feature"), out.alias("outcome")))


# --- records ------------------------------------------------------------------------------------
@query("""
WITH l AS (SELECT DISTINCT o_custkey AS item, CASE o_orderpriority WHEN '1-URGENT' THEN 'needs-triage' WHEN '2-HIGH' THEN 'needs-info' ELSE 'other' END AS label FROM orders
  UNION SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'bug' ELSE 'enhancement' END FROM orders WHERE o_orderkey % 6 = 0),
n AS (SELECT c_custkey AS item, COUNT(*) FILTER (WHERE label LIKE 'needs%') AS states, COUNT(*) FILTER (WHERE label IN ('bug', 'enhancement')) AS categories
      FROM customer LEFT JOIN l ON item = c_custkey GROUP BY 1)
SELECT item, states, categories FROM n WHERE states <> 1 OR categories <> 1""")
def one_state_check(spark, sf_dir):
    """Customers without exactly one state and one category."""
    orders = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    labels = orders.select(F.col("o_custkey").alias("item"), F.when(p == "1-URGENT", "needs-triage").when(p == "2-HIGH", "needs-info").otherwise("other").alias("label"))
    labels = labels.unionByName(orders.where("o_orderkey % 6 = 0").select(
        F.col("o_custkey").alias("item"), F.when(F.col("o_orderstatus") == "F", "bug").otherwise("enhancement").alias("label")))
    return records.one_state_check(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item")), labels)


TRIAGE = """
WITH i AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 3 = 0 THEN 'PR' ELSE 'issue' END AS kind, epoch_us(o_orderdate) AS created,
                  o_custkey % 10 AS reporter, o_orderkey % 2 = 0 AS outside, CASE WHEN o_orderstatus = 'F' THEN 'needs-info'
                  WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'needs-triage' END AS label FROM orders),
c AS (SELECT l_orderkey AS item, MAX(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS note,
             MAX(CASE WHEN l_returnflag <> 'R' AND l_suppkey % 10 = reporter THEN l_shipdate END) AS reply FROM lineitem JOIN i ON item = l_orderkey GROUP BY 1),
p AS (SELECT item FROM c WHERE reply IS NOT NULL AND (note IS NULL OR reply > note)),
a AS (SELECT CASE WHEN label IS NULL THEN 1 WHEN label = 'needs-triage' THEN 2 ELSE 3 END AS "group", item, kind, created, label FROM i
      WHERE (kind <> 'PR' OR outside) AND (label IS NULL OR label = 'needs-triage' OR item IN (SELECT item FROM p)))
"""


def triage_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    items = o.select(key.alias("item"), F.when(key % 3 == 0, "PR").otherwise("issue").alias("kind"),
                     F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created"), (F.col("o_custkey") % 10).alias("reporter"), (key % 2 == 0).alias("outside"))
    label = F.when(F.col("o_orderstatus") == "F", "needs-info").when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), "needs-triage")
    labels = o.select(key.alias("item"), label.alias("label")).where("label is not null")
    comments = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.col("l_shipdate").alias("ts"), (F.col("l_suppkey") % 10).alias("author"), (F.col("l_returnflag") == "R").alias("is_note"))
    return items, labels, comments


@query(TRIAGE + 'SELECT "group", item, kind, created FROM a')
def attention_list(spark, sf_dir):
    """Orders that need attention."""
    return records.attention_list(*triage_tables(spark, sf_dir))


@query(TRIAGE + 'SELECT "group", COUNT(*) AS items, MIN(created) AS oldest FROM a GROUP BY 1')
def attention_counts(spark, sf_dir):
    """How many in each group."""
    return records.attention_counts(records.attention_list(*triage_tables(spark, sf_dir)))


@query(TRIAGE + "SELECT item, epoch_us(reply) AS reply FROM p JOIN c USING (item) JOIN i USING (item) WHERE label = 'needs-info'")
def newest_triage_reply(spark, sf_dir):
    """Waiting orders whose reporter answered."""
    return records.newest_triage_reply(*triage_tables(spark, sf_dir)).select("item", F.unix_micros(F.col("reply").cast("timestamp")).alias("reply"))


@query(r"""
SELECT doc_id AS item, CASE WHEN regexp_matches(text, '@[a-z]+\.|die [a-z]+heit') THEN 'ready-for-human' ELSE 'ready-for-agent' END AS state,
       concat_ws(',', CASE WHEN regexp_matches(text, '@[a-z]+\.') THEN 'mail' END, CASE WHEN regexp_matches(text, 'die [a-z]+heit') THEN 'taste' END) AS reasons FROM documents""")
def readiness_route(spark, sf_dir):
    """Documents whose lines need a person."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.split("text", "\n").alias("checks"))
    return records.readiness_route(items, {"mail": r"@[a-z]+\.", "taste": "die [a-z]+heit"}).withColumn("reasons", F.array_join("reasons", ","))


PRS = f"""
WITH p AS (SELECT user_id AS u, MAX(event_id) AS number, arg_max(CASE event_type WHEN 'view' THEN 'MERGED' WHEN 'click' THEN 'CLOSED' WHEN 'error' THEN 'MERGED' ELSE 'OPEN' END, event_id) AS state,
                  arg_max({K} % 3, event_id) AS oid, arg_max({K} % 2, event_id) AS author FROM events GROUP BY 1)
"""


def pull_requests(spark, sf_dir):
    t = F.col("event_type")
    return kind_events(spark, sf_dir).select(
        F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("head"), F.col("event_id").alias("number"),
        F.when(t.isin("view", "error"), "MERGED").when(t == "click", "CLOSED").otherwise("OPEN").alias("state"),
        (F.col("k") % 3).cast("string").alias("head_oid"), (F.col("k") % 2).cast("string").alias("author"), (F.col("k") % 4 == 0).alias("reverted"))


@query(PRS + """
SELECT 'b' || c_custkey AS name,
  CASE WHEN c_custkey % 17 = 0 OR c_custkey % 13 = 0 OR (c_custkey % 2 = 0 AND author <> 1) OR state = 'OPEN' OR oid <> c_custkey % 3 THEN 'Keep'
       WHEN state IS NOT NULL THEN 'Remove' WHEN c_custkey % 2 = 0 OR c_custkey % 5 > 0 THEN 'Ask' ELSE 'Remove' END AS class FROM customer LEFT JOIN p ON u = c_custkey""")
def branch_pr(spark, sf_dir):
    """Branches to remove, keep or ask about."""
    k = F.col("c_custkey")
    branches = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("b"), k.cast("string")).alias("name"), (k % 3).cast("string").alias("tip"), (k % 2 == 0).alias("remote"),
        (k % 13 == 0).alias("dirty"), (k % 17 == 0).alias("live"), (k % 5).alias("unpushed"))
    return records.branch_pr(branches, pull_requests(spark, sf_dir), "1").select("name", "class")


@query(PRS + f""", r AS (SELECT user_id AS u, arg_max({K} % 4 = 0, event_id) AS reverted FROM events GROUP BY 1)
SELECT c_custkey AS thread, CASE WHEN state = 'MERGED' AND reverted THEN 'reverted #' || number WHEN state = 'MERGED' THEN 'merged #' || number
  WHEN state = 'OPEN' THEN 'open PR #' || number WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'verified, uncommitted' WHEN c_custkey % 2 = 0 THEN 'in flight b' || c_custkey
  WHEN c_custkey % 5 = 0 THEN 'said so' ELSE 'planned, not started' END AS tag FROM customer LEFT JOIN p ON u = c_custkey LEFT JOIN r ON r.u = c_custkey""")
def thread_live_state(spark, sf_dir):
    """Remembered threads against live branches and pull requests."""
    k = F.col("c_custkey")
    cust = table(spark, sf_dir, "customer").withColumn("branch", F.concat(F.lit("b"), k.cast("string")))
    threads = cust.select(k.alias("thread"), "branch", F.when(k % 5 == 0, "said so").alias("said"))
    branches = cust.where("c_custkey % 2 = 0").select(F.col("branch").alias("name"), (k % 3 == 0).alias("uncommitted"))
    return records.thread_live_state(threads, branches, pull_requests(spark, sf_dir))


@query("""
WITH g AS (SELECT 'p' || c_custkey AS page FROM customer), l AS (SELECT DISTINCT 'p' || (o_custkey % 50) AS page, 'p' || (o_orderkey * 7 % 20000) AS target FROM orders)
SELECT 'broken' AS rule, page, target FROM l WHERE target NOT IN (SELECT page FROM g)
UNION ALL SELECT 'unlisted', page, NULL FROM g WHERE page <> 'p0' AND page NOT IN (SELECT target FROM l WHERE page = 'p0')""")
def link_resolves(spark, sf_dir):
    """Broken links and pages the home page does not list."""
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    pages = table(spark, sf_dir, "customer").select(p(F.col("c_custkey")).alias("page"))
    links = table(spark, sf_dir, "orders").select(p(F.col("o_custkey") % 50).alias("page"), p(F.col("o_orderkey") * 7 % 20000).alias("target"))
    return records.link_resolves(pages, links, "p0")


@query("""SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS date FROM orders""")
def newest_first_index(spark, sf_dir):
    """Orders by date, newest first."""
    from turnwise.operators.chains import newest_first_index as index

    return index(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")))


# --- run logs -----------------------------------------------------------------------------------
def passes(spark, sf_dir):
    return kind_events(spark, sf_dir).select(
        F.col("user_id").alias("run"), F.col("event_id").alias("pass"), F.col("k").alias("before"), (F.col("k") % 4).alias("after"),
        F.when(F.col("event_type").isin("error", "view"), "reverted").otherwise("kept").alias("result"),
        F.col("k").cast("double").alias("hours"), F.col("value").alias("spend"))


PASSES = f"""
WITH l AS (SELECT user_id AS run, event_id AS pass, {K} AS before, {K} % 4 AS after, event_type IN ('error', 'view') AS no, {K} AS hours FROM events)
"""


@query(PASSES + """SELECT run, pass, after - before AS delta, MIN(CASE WHEN NOT no THEN after END) OVER w AS best,
  COUNT(*) FILTER (WHERE NOT no) OVER w AS kept, COUNT(*) FILTER (WHERE no) OVER w AS reverted FROM l
WINDOW w AS (PARTITION BY run ORDER BY pass)""")
def progress(spark, sf_dir):
    """Change, best value and counts per pass."""
    return runlog.check_progress(passes(spark, sf_dir), int_segment("pass", 12)).select("run", "pass", "delta", "best", "kept", "reverted")


@query(PASSES + """, d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY pass) AS rn FROM l),
a AS (SELECT *, rn - ROW_NUMBER() OVER (PARTITION BY run, no ORDER BY pass) AS ia, rn - ROW_NUMBER() OVER (PARTITION BY run, after ORDER BY pass) AS ib FROM d)
SELECT run, MIN(pass) AS from_pass, MAX(pass) AS to_pass, COUNT(*) AS n, 'reverted' AS kind FROM a WHERE no GROUP BY run, ia HAVING COUNT(*) >= 3
UNION ALL SELECT run, MIN(pass), MAX(pass), COUNT(*), 'unchanged' FROM a GROUP BY run, after, ib HAVING COUNT(*) >= 3""")
def stuck_runs(spark, sf_dir):
    """Three or more reverted or unchanged passes in a row."""
    return runlog.stuck_run(passes(spark, sf_dir), int_segment("pass", 12))


@query(PASSES + """SELECT run, pass, COUNT(*) OVER w >= 5 AS may_stop, COUNT(*) OVER w >= 60 OR SUM(hours) OVER w >= 1500 AS must_stop FROM l
WINDOW w AS (PARTITION BY run ORDER BY pass)""")
def floor_and_budget(spark, sf_dir):
    """When a run may and must stop."""
    return runlog.floor_and_budget(passes(spark, sf_dir), int_segment("pass", 12), 5, 60, 1500).select("run", "pass", "may_stop", "must_stop")


@query(f"""
WITH l AS (SELECT DISTINCT user_id AS run, {K} AS item FROM events WHERE event_type = 'view'), t AS (SELECT DISTINCT user_id AS run, {K} AS item FROM events WHERE event_type = 'click')
SELECT COALESCE(l.run, t.run) AS run, COALESCE(l.item, t.item) AS item, CASE WHEN t.run IS NULL THEN 'Unsupported' ELSE 'Unlogged' END AS flag
FROM l FULL JOIN t ON l.run = t.run AND l.item = t.item WHERE l.run IS NULL OR t.run IS NULL""")
def log_vs_trace(spark, sf_dir):
    """Views against clicks, both ways."""
    ev = kind_events(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("k").alias("item"), F.col("event_id").cast("string").alias("evidence"), "event_type")
    return runlog.log_vs_trace(ev.where("event_type = 'view'"), ev.where("event_type = 'click'")).select("run", "item", "flag")


# --- motion -------------------------------------------------------------------------------------
EASINGS = ["linear", "ease", "ease-in", "cubic-bezier(0.23, 1, 0.32, 1)", "ease-in-out"]


def motion_samples(spark, sf_dir):
    easing = F.element_at(F.array(*[F.lit(e) for e in EASINGS]), (F.col("motion") % 5 + 1).cast("int"))
    return kind_events(spark, sf_dir).groupBy(F.col("user_id").alias("motion"), (F.col("k") * 5).alias("t")).agg(
        (F.min("value") / 20).alias("p")).withColumns({"easing": easing, "duration": F.lit(500)})


@query(f"""
WITH RECURSIVE s AS (SELECT user_id AS motion, {K} AS k, MIN(value) / 20 AS p FROM events GROUP BY 1, 2),
cp AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), (1, 0.25, 0.1, 0.25, 1.0), (2, 0.42, 0, 1, 1), (3, 0.23, 1, 0.32, 1), (4, 0.42, 0, 0.58, 1)) AS v(e, x1, y1, x2, y2)),
g AS (SELECT e, x1, y1, x2, y2, k / 100.0::DOUBLE AS x, k FROM cp, (SELECT DISTINCT k FROM s)),
b AS (SELECT e, k, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, x1, x2, x FROM g
  UNION ALL SELECT e, k, i + 1, CASE WHEN l THEN (lo + hi) / 2 ELSE lo END, CASE WHEN l THEN hi ELSE (lo + hi) / 2 END, x1, x2, x FROM (
    SELECT *, 3 * x1 * ((lo + hi) / 2) * (1 - (lo + hi) / 2) * (1 - (lo + hi) / 2) + 3 * x2 * ((lo + hi) / 2) * ((lo + hi) / 2) * (1 - (lo + hi) / 2)
      + ((lo + hi) / 2) * ((lo + hi) / 2) * ((lo + hi) / 2) < x AS l FROM b WHERE i < 40)),
c AS (SELECT b.e, b.k, (lo + hi) / 2 AS m, y1, y2 FROM b JOIN g USING (e, k) WHERE i = 40),
v AS (SELECT e, k, 3 * y1 * m * (1 - m) * (1 - m) + 3 * y2 * m * m * (1 - m) + m * m * m AS q FROM c),
r AS (SELECT motion, s.k, p, p - q AS err, LAG(p) OVER (PARTITION BY motion ORDER BY s.k) AS was FROM s JOIN v ON v.e = motion % 5 AND v.k = s.k)
SELECT motion, COUNT(*) AS samples, ROUND(MAX(abs(err)), 6) AS max_err, ROUND(sqrt(AVG(err * err)), 6) AS rms, ROUND(greatest(MAX(p) - 1, 0), 6) AS overshoot,
       bool_and(COALESCE(p >= was, TRUE)) AS monotonic FROM r GROUP BY 1""")
def motion_residual(spark, sf_dir):
    """Values over k against an easing per user."""
    out = motion.motion_residual(motion_samples(spark, sf_dir), F.floor(F.col("t") / 60_000))
    return out.withColumns({c: F.round(c, 6) for c in ("max_err", "rms", "overshoot")})


@query("""
WITH m AS (SELECT event_id AS motion, CASE event_type WHEN 'view' THEN 'press' WHEN 'click' THEN 'tooltip' WHEN 'error' THEN 'dropdown' WHEN 'purchase' THEN 'modal' END AS band, value * 5 AS duration FROM events)
SELECT motion, band, CASE band WHEN 'press' THEN duration BETWEEN 100 AND 160 WHEN 'tooltip' THEN duration BETWEEN 125 AND 200
  WHEN 'dropdown' THEN duration BETWEEN 150 AND 250 ELSE duration BETWEEN 200 AND 500 END AS inside FROM m WHERE band IS NOT NULL""")
def band_join(spark, sf_dir):
    """Durations against the band of their kind."""
    t = F.col("event_type")
    kind = F.when(t == "view", "press").when(t == "click", "tooltip").when(t == "error", "dropdown").when(t == "purchase", "modal")
    return motion.duration_band(table(spark, sf_dir, "events").select(
        F.col("event_id").alias("motion"), kind.alias("kind"), (F.col("value") * 5).alias("duration"))).select("motion", "band", "inside")


@query(f"""
WITH m AS (SELECT event_id AS motion, user_id AS component, CASE event_type WHEN 'view' THEN 'enter' WHEN 'click' THEN 'exit' WHEN 'error' THEN 'constant' ELSE 'move' END AS phase,
                  {K} % 5 AS e, CAST(floor(value) AS INTEGER) AS duration, {K} * 10 AS delay FROM events),
x AS (SELECT *, LAG(delay) OVER (PARTITION BY component, phase ORDER BY motion) AS was, MIN(CASE WHEN phase = 'enter' THEN duration END) OVER (PARTITION BY component) AS enter FROM m)
SELECT motion, 'ease-in' AS rule FROM x WHERE e = 2
UNION ALL SELECT motion, 'enter and exit ease out' FROM x WHERE phase IN ('enter', 'exit') AND e IN (0, 1, 4)
UNION ALL SELECT motion, 'linear without constant motion' FROM x WHERE phase = 'move' AND e = 0
UNION ALL SELECT motion, 'exit not shorter than entrance' FROM x WHERE phase = 'exit' AND duration >= enter
UNION ALL SELECT motion, 'stagger' FROM x WHERE was IS NOT NULL AND NOT delay - was BETWEEN 30 AND 80""")
def motion_rules(spark, sf_dir):
    """Broken motion rules."""
    t = F.col("event_type")
    phase = F.when(t == "view", "enter").when(t == "click", "exit").when(t == "error", "constant").otherwise("move")
    easing = F.element_at(F.array(*[F.lit(e) for e in EASINGS]), (F.col("k") % 5 + 1).cast("int"))
    rows = kind_events(spark, sf_dir).select(
        F.col("event_id").alias("motion"), F.col("user_id").alias("component"), phase.alias("phase"), easing.alias("easing"),
        F.floor("value").cast("int").alias("duration"), F.col("event_id").alias("item"), (F.col("k") * 10).alias("delay"))
    return motion.motion_rules(rows)


# --- chunks -------------------------------------------------------------------------------------
CHUNKS = """
WITH RECURSIVE s AS (SELECT conv_id % 3 AS shelf, conv_id AS session, CAST(SUM(len(string_split(text, chr(10)))) AS BIGINT) AS n FROM conversations GROUP BY 1, 2),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY shelf ORDER BY session) AS i FROM s),
r AS (SELECT shelf, session, i, n AS held, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS start, n FROM o WHERE i = 1
      UNION ALL SELECT o.shelf, o.session, o.i, CASE WHEN held >= 60 THEN o.n ELSE held + o.n END, CASE WHEN held >= 60 THEN chunk + 1 ELSE chunk END, start + r.n, o.n
      FROM r JOIN o ON o.shelf = r.shelf AND o.i = r.i + 1)
"""


def session_sizes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 3).alias("shelf"), F.col("conv_id").alias("session")).agg(
        F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query(CHUNKS + "SELECT shelf, session, start, chunk FROM r")
def chunk_assign(spark, sf_dir):
    """Conversations in chunks of 60 lines or a little more."""
    return chunks.chunk_assign(session_sizes(spark, sf_dir), 60, "shelf").select("shelf", "session", "start", "chunk")


@query(CHUNKS + "SELECT shelf, chunk, MIN(start) + 1 AS first_line, MAX(start + n) AS last_line, COUNT(*) AS sessions FROM r GROUP BY 1, 2")
def chunk_ranges(spark, sf_dir):
    """Line ranges of the chunks."""
    return chunks.chunk_ranges(chunks.chunk_assign(session_sizes(spark, sf_dir), 60, "shelf"), "shelf")


@query(CHUNKS + """SELECT CAST(shelf AS VARCHAR) AS shelf, chunk, MIN(start) + 1 AS first_line, MAX(start + n) AS last_line, CAST(SUM(bytes) AS BIGINT) AS bytes
FROM r JOIN (SELECT conv_id AS session, SUM(strlen(text) + 1) AS bytes FROM conversations GROUP BY 1) USING (session) GROUP BY 1, 2""")
def chunk_manifest(spark, sf_dir):
    """Conversations written as chunk files: the lines and bytes of each chunk, as the published manifest has them."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 3).alias("shelf"), F.col("conv_id").alias("session"), "turn", "text")
    cut = chunks.chunk_assign(session_sizes(spark, sf_dir), 60, "shelf")
    manifest = chunk_files.publish_chunks(turns, cut, new_folder(spark, "chunks"), ("shelf", "session"), ("turn",))
    return manifest.groupBy("shelf", "chunk").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("bytes").alias("bytes"))


@query("""
WITH RECURSIVE f AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 64 >= 32 THEN 'a' WHEN doc_id % 64 >= 16 THEN 'b' WHEN doc_id % 64 >= 8 THEN 'c'
  ELSE 'd' || lpad(CAST(doc_id % 512 AS VARCHAR), 3, '0') END AS area FROM documents),
a AS (SELECT area, CAST(SUM(n_chars) AS BIGINT) AS n FROM f GROUP BY 1),
w AS (SELECT CAST(SUM(n) AS BIGINT) AS whole FROM a),
g AS (SELECT area, n, ROW_NUMBER() OVER (ORDER BY n DESC, area) AS i FROM a, w WHERE n * 9 > whole),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS area, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS z, -1 AS shard
      UNION ALL SELECT g.i, g.area, CASE WHEN x <= y AND x <= z THEN x + n ELSE x END, CASE WHEN x > y AND y <= z THEN y + n ELSE y END,
        CASE WHEN x > z AND y > z THEN z + n ELSE z END, CASE WHEN x <= y AND x <= z THEN 0 WHEN y <= z THEN 1 ELSE 2 END
      FROM r JOIN g ON g.i = r.i + 1),
l AS (SELECT x, y, z, whole - x - y - z AS rest FROM r, w WHERE i = (SELECT MAX(i) FROM r)),
v AS (SELECT *, least(rest + least(x, y, z), (rest + x + y + z - greatest(x, y, z) + 1) // 2, (rest + x + y + z + 2) // 3) AS level FROM l),
e AS (SELECT greatest(0, level - x) AS e1, greatest(0, level - x) + greatest(0, level - y) AS e2 FROM v),
s AS (SELECT area, SUM(n) OVER (ORDER BY area) - n AS begins FROM a, w WHERE n * 9 <= whole),
p AS (SELECT area, shard FROM r WHERE i > 0 UNION ALL SELECT area, CASE WHEN begins < e1 THEN 0 WHEN begins < e2 THEN 1 ELSE 2 END FROM s, e)
SELECT doc_id AS path, (shard + 1) % 3 AS shard FROM f JOIN p USING (area)""")
def largest_first(spark, sf_dir):
    """Documents of areas from half of all lines down to a few, in three shards with the largest placed first, second round."""
    m = F.col("doc_id") % 64
    area = F.when(m >= 32, "a").when(m >= 16, "b").when(m >= 8, "c").otherwise(F.concat(F.lit("d"), F.lpad((F.col("doc_id") % 512).cast("string"), 3, "0")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), area.alias("area"), F.col("n_chars").alias("lines"))
    return findings.largest_first(files, 3, 1).select("path", "shard")
