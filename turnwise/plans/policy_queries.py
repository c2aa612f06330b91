"""Policy queries: events stand for tool calls, page addresses for paths, customers for agents."""
from pyspark.sql import functions as F

from turnwise.functions import calls as c
from turnwise.operators import chains, policy
from turnwise.plans.log_queries import kind_events
from turnwise.plans.registry import query, table


def tool_calls(spark, sf_dir):
    """Events as calls: the type picks the tool, k the command, path and state."""
    k = F.col("k").cast("string")
    tool = (F.when(F.col("event_type") == "click", "Bash").when(F.col("event_type") == "view", "Write")
            .when(F.col("event_type") == "error", F.concat(F.lit("mcp__linear-server__"), F.when(F.col("k") % 2 == 0, "save_issue").otherwise("list_issues")))
            .when(F.col("event_type") == "purchase", F.when(F.col("k") % 3 == 0, "mcp__tracker__deleteThing").otherwise("mcp__tracker__push_files"))
            .otherwise("Artifact"))
    command = F.concat(
        F.lit("echo "), F.when(F.col("k") % 2 == 0, F.lit('"a > b"')).otherwise(F.lit("x")), F.lit(" > out"), k,
        F.when(F.col("k") % 5 == 0, F.lit(".md")).when(F.col("k") % 7 == 0, F.lit("/.claude/work/a")).otherwise(F.lit(" 2>&1")),
        F.when(F.col("k") % 11 == 0, F.lit(" && git push")).otherwise(F.lit("; git commit -m x")))
    path = F.concat(F.lit("src/f"), k, F.when(F.col("k") % 4 == 0, F.lit(".md")).otherwise(F.lit(".ts")))
    return kind_events(spark, sf_dir).select(
        "event_id", "ts", F.col("user_id").cast("string").alias("agent_id"), "k", tool.alias("tool"), command.alias("command"),
        path.alias("path"), F.when(F.col("k") % 2 == 0, "read").otherwise("publish").alias("action"),
        F.when(F.col("k") % 10 == 0, "Canceled").otherwise("Done").alias("state"), (F.col("k") % 3 != 1).alias("has_surface"))


CALLS = """
WITH e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
c AS (SELECT *, CASE event_type
    WHEN 'click' THEN CASE WHEN k % 11 = 0 THEN 4 WHEN k % 5 = 0 THEN 1 WHEN k % 7 = 0 THEN 2 ELSE 3 END
    WHEN 'view' THEN CASE WHEN k % 4 = 0 THEN 1 ELSE 3 END
    WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END
    WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 1 ELSE 4 END
    ELSE CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END END AS need FROM e)
"""


@query(CALLS + "SELECT event_id, need FROM c")
def required_mode(spark, sf_dir):
    """The mode each call needs."""
    return policy.with_need(tool_calls(spark, sf_dir)).select("event_id", "need")


@query(r"""
WITH t AS (SELECT page_id, html, regexp_extract_all(html,
  '(?s)(''[^'']*''|"(?:[^"\\]|\\.)*"|\\.|[''"].*|[^''"\\]+|\\)') AS tok FROM pages),
m AS (SELECT page_id, array_to_string(list_transform(tok, lambda x:
  CASE WHEN regexp_full_match(x, '(?s)''[^'']*''|"(?:[^"\\]|\\.)*"|\\.') THEN replace(x, '>', '_') ELSE x END), '') AS masked FROM t),
p AS (SELECT page_id, UNNEST(string_split_regex(masked, '&&|\|\|?|;|\n')) AS part FROM m),
r AS (SELECT page_id, part, regexp_extract_all(regexp_replace(part, '\d*>&\d+|\d*>>?\s*/dev/null', '', 'g'), '>>?\s*([^\s>&|;]+)', 1) AS g FROM p)
SELECT page_id, MAX(CASE WHEN len(list_filter(g, lambda x: NOT regexp_matches(x, '(?i)\.(md|markdown)$'))) > 0 THEN 3
                         WHEN len(g) > 0 THEN 1 ELSE 0 END) AS need,
       COUNT(*) AS parts FROM r GROUP BY 1""")
def strictest_need(spark, sf_dir):
    """Page sources judged as shell commands, quotes and redirects included."""
    return table(spark, sf_dir, "pages").select(
        "page_id", c.strictest_need(F.col("html")).alias("need"), F.size(c.command_parts(F.col("html"))).cast("bigint").alias("parts"))


@query("""SELECT event_id, CAST(hour(ts) * 60 + minute(ts) BETWEEN 540 AND 1079 AS BOOLEAN) AS day,
  hour(ts) >= 22 OR hour(ts) < 6 AS night, hour(ts + INTERVAL 8 HOURS) BETWEEN 9 AND 17 AS far FROM events""")
def in_shift(spark, sf_dir):
    """Events inside a day shift, a night shift and a shift in another zone."""
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", c.in_shift(ts).alias("day"), c.in_shift(ts, "22:00", "06:00").alias("night"),
        c.in_shift(ts, "bad", "18:00", "Asia/Manila").alias("far"))


@query(CALLS + """SELECT event_id, CASE WHEN NOT (event_type = 'error' AND k % 2 = 0) THEN 'pass'
  WHEN NOT hour(ts) BETWEEN 9 AND 17 THEN 'deny' WHEN k % 10 <> 0 OR k % 3 = 1 THEN 'pass' ELSE 'ask' END AS verdict FROM c""")
def shift_verdict(spark, sf_dir):
    """Tracker writes against the shift."""
    return policy.shift_verdict(tool_calls(spark, sf_dir)).select("event_id", "verdict")


AGENTS = """
WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN c_custkey // 3 END AS parent,
    CASE WHEN c_custkey % 7 = 3 THEN c_custkey % 4 END AS own, CASE WHEN c_custkey % 5 = 2 THEN c_custkey % 4 END AS sub FROM customer),
a AS (SELECT id, parent AS anc FROM n WHERE parent IS NOT NULL
      UNION ALL SELECT a.id, n.parent FROM a JOIN n ON n.id = a.anc WHERE n.parent IS NOT NULL),
u AS (SELECT a.id, MIN(n.sub) AS from_above FROM a JOIN n ON n.id = a.anc GROUP BY 1),
v AS (SELECT n.id, LEAST(4, COALESCE(own, 4), COALESCE(from_above, 4)) AS rank, own FROM n LEFT JOIN u USING (id))
"""


def agent_tables(spark, sf_dir):
    k = F.col("c_custkey")
    name = lambda col: c.mode_name(col.cast("int"))
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    edges = cust.where("c_custkey > 0").select(k.alias("child"), F.floor(k / 3).alias("parent"))
    own = cust.where("c_custkey % 7 = 3").select(k.alias("agent"), F.lit("self").alias("scope"), name(k % 4).alias("mode"))
    sub = cust.where("c_custkey % 5 = 2").select(k.alias("agent"), F.lit("subagents").alias("scope"), name(k % 4).alias("mode"))
    return edges, own.unionByName(sub)


@query(AGENTS + "SELECT id AS agent, rank, CASE WHEN rank = 4 THEN 'user' WHEN rank = own THEN 'own' ELSE 'above' END AS source FROM v")
def inherited_mode(spark, sf_dir):
    """The mode that binds each agent of a tree."""
    return chains.inherited_mode(*agent_tables(spark, sf_dir))


@query(AGENTS.replace("WITH RECURSIVE", "WITH RECURSIVE " + CALLS.strip().removeprefix("WITH") + ",") + """
SELECT event_id, CASE WHEN need > COALESCE(rank, 4) THEN 'deny' ELSE 'pass' END AS verdict,
  CASE WHEN need > COALESCE(rank, 4) THEN CASE WHEN rank = own THEN 'own' ELSE 'above' END END AS by FROM c LEFT JOIN v ON v.id = c.user_id""")
def mode_verdict(spark, sf_dir):
    """Calls against the modes of the agents that made them."""
    bound = chains.inherited_mode(*agent_tables(spark, sf_dir)).withColumn("agent", F.col("agent").cast("string"))
    return policy.mode_verdict(tool_calls(spark, sf_dir), bound).select("event_id", "verdict", "by")


@query(CALLS + """, v AS (SELECT event_type, CASE WHEN need > 2 THEN 'deny' ELSE 'pass' END AS verdict FROM c)
SELECT event_type, verdict, COUNT(*) AS n FROM v GROUP BY ROLLUP (event_type, verdict)""")
def verdict_profile(spark, sf_dir):
    """Verdicts in prototype mode by kind of call, with totals."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows = policy.with_need(tool_calls(spark, sf_dir)).join(ev, "event_id").withColumn(
        "verdict", F.when(F.col("need") > c.PROTOTYPE, "deny").otherwise("pass"))
    return policy.verdict_profile(rows, ["event_type"])


@query("""SELECT c_custkey AS agent, 'self' AS scope FROM customer WHERE c_custkey % 7 = 3 AND c_custkey % 4 < 2
UNION ALL SELECT c_custkey, 'subagents' FROM customer WHERE c_custkey % 5 = 2 AND c_custkey % 4 < 2""")
def uncovered_mode(spark, sf_dir):
    """Modes that still bind under a user mode of prototype."""
    return chains.uncovered_mode(agent_tables(spark, sf_dir)[1], "prototype").select("agent", "scope")


PATHS = """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
p AS (SELECT event_id, k, CASE k % 10 WHEN 0 THEN 'docs/stories/' || k || '.md' WHEN 1 THEN 'apps/prototypes/' || k || '.html'
  WHEN 2 THEN 'FINDINGS.md' WHEN 3 THEN 'packages/core/' || k || '-EVIDENCE.md' WHEN 4 THEN 'e2e/test_zz_' || k || '.py'
  WHEN 5 THEN '.github/spike-' || k || '/x.md' WHEN 6 THEN 'README.md' WHEN 7 THEN 'src/db/migrate/' || k || '.rb'
  WHEN 8 THEN 'artifacts/' || k || '/a.spec.ts' ELSE 'notes' || k || '.txt' END AS path FROM e)
"""


def call_paths(spark, sf_dir):
    k = F.col("k").cast("string")
    names = [("docs/stories/", ".md"), ("apps/prototypes/", ".html"), None, ("packages/core/", "-EVIDENCE.md"), ("e2e/test_zz_", ".py"),
             (".github/spike-", "/x.md"), None, ("src/db/migrate/", ".rb"), ("artifacts/", "/a.spec.ts"), ("notes", ".txt")]
    fixed = {2: "FINDINGS.md", 6: "README.md"}
    path = F.coalesce(*[F.when(F.col("k") % 10 == i, F.lit(fixed[i]) if n is None else F.concat(F.lit(n[0]), k, F.lit(n[1])))
                        for i, n in enumerate(names)])
    return kind_events(spark, sf_dir).select("event_id", "k", path.alias("path"))


@query(PATHS + """SELECT event_id, path, CASE k % 10 WHEN 0 THEN 'a reports/ or docs/ planning folder'
  WHEN 1 THEN 'a prototype, scratch, recovery, research-notes, spike or .local folder' WHEN 2 THEN 'a loose document at the repo root'
  WHEN 3 THEN 'a findings, report, plan or numbered evidence file name' WHEN 4 THEN 'a probe or temporary test file name'
  WHEN 8 THEN 'a test artifact or evidence folder' ELSE 'a loose document at the repo root' END AS reason,
  k % 10 IN (4, 8) AS test, k % 10 = 7 AS migration FROM p WHERE k % 10 NOT IN (5, 6, 7)""")
def working_file_reason(spark, sf_dir):
    """Paths that belong in a work folder and the rule."""
    from turnwise.operators.changes import is_test_path

    return call_paths(spark, sf_dir).select(
        "event_id", "path", c.working_file_reason(F.col("path")).alias("reason"), is_test_path(F.col("path")).alias("test"),
        c.migration_path(F.col("path")).alias("migration")).where("reason is not null")


URLS = """
WITH u AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages),
h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
"""


def url_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")).distinct()


@query(URLS + """, r AS (SELECT host AS root FROM h UNION SELECT host || '/en' FROM h WHERE length(host) % 2 = 0)
SELECT path, arg_max(root, length(root)) AS root, substr(path, MAX(length(root)) + 2) AS rel
FROM u JOIN r ON starts_with(path, root || '/') GROUP BY 1""")
def nearest_root(spark, sf_dir):
    """The deepest known root of each page path."""
    paths = url_paths(spark, sf_dir)
    host = paths.select(F.substring_index("path", "/", 1).alias("root")).distinct()
    roots = host.unionByName(host.where("length(root) % 2 = 0").select(F.concat("root", F.lit("/en")).alias("root")))
    return policy.nearest_root(paths, roots)


@query(URLS + """, p AS (SELECT string_split(path, '/')[1] AS root, substr(path, strpos(path, '/') + 1) AS rel FROM u)
SELECT root, rel FROM p WHERE NOT (length(root) % 2 = 0 AND (starts_with(rel, 'en/') OR regexp_full_match(rel, '(?:.*/)?1[^/]*')))""")
def allow_list_join(spark, sf_dir):
    """Page paths their host's allow list does not cover."""
    paths = url_paths(spark, sf_dir).select(
        F.substring_index("path", "/", 1).alias("root"), F.regexp_replace("path", r"^[^/]*/", "").alias("rel"))
    allow = paths.select("root").distinct().where("length(root) % 2 = 0").withColumn("allow", F.array(F.lit("en/"), F.lit("**/1*")))
    return policy.allow_list_join(paths, allow).select("root", "rel")


FEATURES = URLS + """, f AS (SELECT host AS feature, host || '/en/' AS pattern FROM h UNION ALL SELECT host || '#', host || '/*/2*' FROM h),
m AS (SELECT DISTINCT path, feature FROM u JOIN f ON CASE WHEN contains(pattern, '*')
      THEN regexp_full_match(path, replace(replace(pattern, '.', '\\.'), '*', '[^/]*')) ELSE starts_with(path, pattern) END)
"""


def feature_paths(spark, sf_dir):
    host = url_paths(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("host")).distinct()
    return host.select(F.col("host").alias("feature"), F.concat("host", F.lit("/en/")).alias("pattern")).unionByName(
        host.select(F.concat("host", F.lit("#")).alias("feature"), F.concat("host", F.lit("/*/2*")).alias("pattern")))


@query(FEATURES.replace("\\\\.", "\\.") + "SELECT path, feature FROM m")
def path_to_feature(spark, sf_dir):
    """Page paths and the features that list them."""
    return policy.path_to_feature(url_paths(spark, sf_dir), feature_paths(spark, sf_dir))


@query(FEATURES.replace("\\\\.", "\\.") + "SELECT path FROM u WHERE path NOT IN (SELECT path FROM m)")
def unlisted_surface(spark, sf_dir):
    """Page paths no feature lists."""
    return policy.unlisted_surface(url_paths(spark, sf_dir), feature_paths(spark, sf_dir))


@query("""
SELECT user_id AS top, epoch_us(MAX(ts)) AS last FROM events GROUP BY 1
HAVING NOT MAX(ts) > (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY""")
def expire_entries(spark, sf_dir):
    """Users without an event in the last day."""
    ev = table(spark, sf_dir, "events")
    entries = ev.select(F.col("user_id").alias("top"), F.col("ts").alias("mtime"))
    now = ev.agg(F.max("ts")).scalar()
    return policy.expire_entries(entries, now).select("top", F.unix_micros("last").alias("last"))


@query("""SELECT event_id, hook FROM events, (VALUES ('a', 'view|cl.*'), ('b', '.*'), ('c', 'pur')) AS h(hook, m)
WHERE regexp_full_match(event_type, m)""")
def matcher_cross(spark, sf_dir):
    """Hooks that cover each event."""
    return policy.matcher_cross(table(spark, sf_dir, "events").withColumnRenamed("event_type", "tool"),
                                [("a", "view|cl.*"), ("b", "*"), ("c", "pur")]).select("event_id", "hook")


@query("""
WITH e AS (SELECT user_id AS machine, event_type AS key, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 2 AS side FROM events),
s AS (SELECT machine, key, MAX(k) AS want FROM e WHERE side = 0 GROUP BY 1, 2),
l AS (SELECT machine, key, MAX(k) AS got FROM e WHERE side = 1 GROUP BY 1, 2)
SELECT machine, key, want, got FROM s LEFT JOIN l USING (machine, key) WHERE got IS NULL OR want <> got""")
def settings_drift(spark, sf_dir):
    """Source keys the live side lacks or holds otherwise."""
    ev = kind_events(spark, sf_dir).select(F.col("user_id").alias("machine"), F.col("event_type").alias("key"), "k", (F.col("event_id") % 2).alias("side"))
    side = lambda n: ev.where(F.col("side") == n).groupBy("machine", "key").agg(F.max("k").alias("value"))
    return policy.settings_drift(side(0), side(1))


@query("""
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k % 4 = 2 THEN 'denies' WHEN k % 5 = 0 THEN 'denies' WHEN k % 5 = 1 THEN 'denies' WHEN k % 5 = 2 THEN 'approves' END AS verdict,
       CASE WHEN k % 3 = 0 THEN 'large window' WHEN k % 3 = 1 THEN 'no model or effort' END AS model, k % 6 = 0 OR k % 5 = 4 AS failed FROM e""")
def hook_override(spark, sf_dir):
    """Hook answers, model settings and failures of calls."""
    k = F.col("k")
    out = (F.when(k % 5 == 0, '{"decision": "block"}').when(k % 5 == 1, '{"hookSpecificOutput": {"permissionDecision": "deny"}}')
           .when(k % 5 == 2, '{"hookSpecificOutput": {"permissionDecision": "allow"}}').when(k % 5 == 3, "not json")
           .otherwise('{"success" : false}'))
    model = F.when(k % 3 == 0, "big[1m]").when(k % 3 == 2, "small")
    return kind_events(spark, sf_dir).withColumn("out", out).select(
        "event_id", c.hook_override(k % 4, F.col("out")).alias("verdict"),
        c.model_problem(F.lit("go"), model, F.lit("high")).alias("model"), c.call_failed(k % 6 == 0, F.col("out")).alias("failed"))


@query(r"""SELECT conv_id, turn, regexp_extract(text, '(?i)(the tion|la que|die un)', 1) AS found FROM conversations
WHERE regexp_matches(text, '(?i)(the tion|la que|die un)')""")
def banned_payload_text(spark, sf_dir):
    """The first denied text inside JSON inputs."""
    talk = table(spark, sf_dir, "conversations")
    payload = F.to_json(F.struct(F.struct(F.array("text").alias("la que")).alias("input")))
    return talk.select("conv_id", "turn", c.banned_payload_text(payload, "(?i)the tion|la que|die un").alias("found")).where("found is not null")


# --- chains -------------------------------------------------------------------------------------
@query("""
WITH RECURSIVE r AS (SELECT o_orderkey AS node, o_orderkey AS root, CAST(0 AS BIGINT) AS depth FROM orders WHERE o_orderkey = 0
  UNION ALL SELECT o.o_orderkey, r.root, r.depth + 1 FROM r JOIN orders o ON o.o_orderkey // 2 = r.node AND o.o_orderkey > 0)
SELECT node, root, depth FROM r""")
def parent_chain(spark, sf_dir):
    """Root and depth of every order in a binary tree."""
    k = F.col("o_orderkey")
    links = table(spark, sf_dir, "orders").select(k.alias("node"), F.when(k > 0, F.floor(k / 2)).alias("parent"))
    return chains.parent_chain(links)


DECISIONS = """
WITH RECURSIVE d AS (SELECT o_orderkey AS id, o_orderkey // 2 AS nxt, o_orderkey > 0 AND o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AS whole,
                            o_orderkey > 0 AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS part FROM orders),
r AS (SELECT id AS start, id AS cur, CAST(0 AS BIGINT) AS hops FROM d
      UNION ALL SELECT r.start, d.nxt, r.hops + 1 FROM r JOIN d ON d.id = r.cur WHERE d.whole),
e AS (SELECT start AS id, arg_max(cur, hops) AS current, MAX(hops) AS hops FROM r GROUP BY 1)
"""


def decision_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    edges = orders.where("o_orderkey > 0 and o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 2).alias("superseded_by"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").alias("part"))
    return orders.select(F.col("o_orderkey").alias("id")), edges


@query(DECISIONS + "SELECT id, current, hops FROM e")
def current_decision(spark, sf_dir):
    """The order in force at the end of each chain of replaced ones."""
    return chains.current_decision(*decision_tables(spark, sf_dir))


@query(DECISIONS + "SELECT d.id, 'urgent' AS part, e.current FROM d JOIN e ON e.id = d.nxt WHERE d.part")
def replaced_parts(spark, sf_dir):
    """Replaced parts and what now holds for them."""
    decisions, edges = decision_tables(spark, sf_dir)
    return chains.replaced_parts(chains.current_decision(decisions, edges), edges)


@query("""
WITH RECURSIVE c AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id - 1 WHEN doc_id % 12 = 4 THEN doc_id - 2 END AS parent FROM documents),
r AS (SELECT doc_id AS sha, doc_id AS root, 0 AS depth FROM c WHERE parent IS NULL
      UNION ALL SELECT c.doc_id, r.root, r.depth + 1 FROM r JOIN c ON c.parent = r.sha),
l AS (SELECT root, arg_max(depth, sha) AS depth FROM r GROUP BY 1)
SELECT 'd' || sha AS sha, 'd' || root AS root, l.depth % 2 = 0 AS live FROM r JOIN l USING (root)""")
def revert_chain(spark, sf_dir):
    """Chains of reverts and what is live at their root."""
    d = F.col("doc_id")
    parent = F.when(d % 4 != 0, d - 1).when(d % 12 == 4, d - 2)
    commits = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), d.cast("string")).alias("sha"), d.alias("ts"),
        F.when(parent.isNotNull(), F.concat(F.lit("Revert\n\nThis reverts commit d"), parent.cast("string"), F.lit("."))).otherwise("Add").alias("message"))
    return chains.revert_chain(commits)


STACK = """
WITH RECURSIVE b AS (SELECT c_custkey AS id, c_custkey // 2 AS by FROM customer WHERE c_custkey > 0
                     UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 0),
r AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS level UNION SELECT b.id, r.level + 1 FROM r JOIN b ON b.by = r.id),
l AS (SELECT id, MAX(level) AS level FROM r GROUP BY 1)
SELECT c_nationkey AS slice, id, CAST(ROW_NUMBER() OVER w AS BIGINT) AS pos, level, COALESCE(LAG(c_name) OVER w, 'main') AS base
FROM l JOIN customer ON c_custkey = id WINDOW w AS (PARTITION BY c_nationkey ORDER BY level, id)"""


@query(STACK)
def stack_order(spark, sf_dir):
    """Customers stacked per nation, blockers below."""
    k = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("slice"), k.alias("id"), F.col("c_name").alias("branch"),
        F.when(k > 0, F.array(F.floor(k / 2), F.floor(k / 3))).otherwise(F.array().cast("array<bigint>")).alias("blocked_by"))
    return chains.stack_order(items).select("slice", "id", "pos", "level", "base")


@query("""
WITH d AS (SELECT o_orderkey AS id, o_orderkey // 2 AS by, o_orderstatus = 'F' AS done, o_totalprice AS risk FROM orders)
SELECT d.id, d.risk FROM d JOIN d AS b ON b.id = d.by WHERE NOT d.done AND (b.done OR b.id = d.id)""")
def riskiest_first(spark, sf_dir):
    """Open orders whose blocker is done, by price."""
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k > 0, F.array(F.floor(k / 2))).otherwise(F.array().cast("array<bigint>")).alias("blocked_by"),
        (F.col("o_orderstatus") == "F").alias("done"), "o_totalprice")
    return chains.riskiest_first(items, F.col("o_totalprice")).select("id", "risk")
