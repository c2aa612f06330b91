"""Log queries on the conversations and events tables.

A conversation is a session and a message an event; user messages are prompts. The texts hold no
English corrections, so the queries pass word lists that hit them.
"""
from pyspark.sql import functions as F

from turnwise.operators import lenses, mining
from turnwise.operators.ordered import carry, int_segment, time_segment
from turnwise.plans.registry import query, table

OPENER = r"(?i)^\s*(the|of|by|la|que|de|der|und|el|and|es|un)(?:$|[^\p{L}\p{N}_])"
CLAIM = r"(?i)(?:^|[^\p{L}\p{N}_])(the|la|die|que)(?:$|[^\p{L}\p{N}_])"
NO_CALLS = "array<struct<id:string,name:string,line:string,skill:string,input:string>>"
NO_RESULTS = "array<struct<id:string,text:string>>"


def session_events(spark, sf_dir):
    """Conversations in the shape of the log events."""
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select(
        F.col("conv_id").cast("string").alias("file"), (F.col("conv_id") % 10).cast("string").alias("project"),
        F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("type"),
        F.col("text").alias("said"), F.array().cast(NO_CALLS).alias("calls"), F.array().cast(NO_RESULTS).alias("results"))


def kind_events(spark, sf_dir):
    """The events table, ordered per user by (ts, event_id); props.k names what an event concerns."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


TURNS = """
WITH m AS (
  SELECT conv_id, turn, role, text,
         SUM(CASE WHEN role = 'user' AND length(trim(text)) > 0 THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn) AS turn_id
  FROM conversations WHERE role IN ('user', 'assistant')),
t AS (SELECT * FROM m WHERE turn_id > 0),
r AS (
SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn_id AS BIGINT) AS turn_id, COUNT(*) AS messages,
       MIN(turn) AS seq,
       MAX(CASE WHEN role = 'user' THEN text END) AS user_text,
       COALESCE(arg_max(text, turn) FILTER (WHERE role = 'assistant' AND length(trim(text)) > 0), '') AS claude_text
FROM t GROUP BY 1, 2)
"""


@query(TURNS + """SELECT session, turn_id, left(user_text, 1200) AS user, right(claude_text, 600) AS claude FROM r""")
def turn_rollup(spark, sf_dir):
    """Every prompt with the last answer text."""
    pages = mining.turn_rollup(session_events(spark, sf_dir))
    return pages.groupBy("session", "turn_id").agg(
        F.min_by("user", F.when(F.col("user").isNotNull(), F.col("page"))).alias("user"),
        F.coalesce(F.max_by("claude", F.when(F.col("claude").isNotNull(), F.col("page"))), F.lit("")).alias("claude"))


@query("""
WITH m AS (
  SELECT conv_id, turn, role, SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn) AS turn_id
  FROM conversations WHERE role IN ('user', 'assistant'))
SELECT CAST(conv_id AS VARCHAR) AS session, CAST(MAX(turn_id) AS BIGINT) AS turns, COUNT(*) AS messages
FROM m WHERE turn_id > 0 GROUP BY 1""")
def turn_counts(spark, sf_dir):
    """Turns and messages per session."""
    return mining.turn_id(session_events(spark, sf_dir).select("file", "session", "seq", "type", "said")).groupBy("session").agg(
        F.max("turn_id").alias("turns"), F.count("*").alias("messages"))


BEFORE = r"""
WITH m AS (
  SELECT conv_id, turn, role, text,
         role = 'user' AND length(trim(text)) > 0 AND NOT starts_with(text, '<') AND length(text) <= 2500 AS kept
  FROM conversations WHERE role IN ('user', 'assistant')),
s AS (
  SELECT *, COALESCE(LAST_VALUE(CASE WHEN role = 'assistant' AND length(trim(text)) > 0 THEN right(text, 600)
                                     WHEN kept THEN '' END IGNORE NULLS)
            OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before
  FROM m)
"""


@query(BEFORE + "SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, before, text AS said FROM s WHERE kept")
def before_text(spark, sf_dir):
    """Each prompt with the answer it reacts to."""
    return mining.before_text(session_events(spark, sf_dir)).select("session", "seq", "before", "said")


HITS = BEFORE + r"""
, h AS (
  SELECT conv_id, turn, before, text,
         CASE WHEN regexp_matches(text, '(?i)^\s*(the|of|by|la|que|de|der|und|el|and|es|un)(?:$|[^\p{L}\p{N}_])')
                OR contains(before, '***') THEN 'REPLY' END AS kind
  FROM s WHERE kept)
"""


@query(HITS + "SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, kind, before, text AS user FROM h WHERE kind IS NOT NULL")
def reply_hits(spark, sf_dir):
    """Prompts that open like a correction or follow a marked answer."""
    state = mining.with_state(session_events(spark, sf_dir))
    return mining.reply_exchanges(state, OPENER, "***").select("session", "seq", "kind", "before", "user")


@query(HITS + """
SELECT CAST(conv_id % 10 AS VARCHAR) AS project, kind, before, text AS user,
       arg_min(CAST(conv_id AS VARCHAR), (CAST(conv_id AS VARCHAR), turn)) AS session
FROM h WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4""")
def correction_report(spark, sf_dir):
    """Exchanges once per project, kind and wording."""
    state = mining.with_state(session_events(spark, sf_dir))
    hits = mining.reply_exchanges(state, OPENER, "***")
    return mining.dedupe_exchanges(hits).select("project", "kind", "before", "user", "session")


@query("""
SELECT text, MIN(doc_id) AS doc_id, COUNT(*) AS copies FROM documents GROUP BY text""")
def dedupe_exchanges(spark, sf_dir):
    """Repeated texts once; the smallest id stays."""
    docs = table(spark, sf_dir, "documents")
    first = mining.dedupe_exchanges(docs, keys=("text",), order=("doc_id",), keep=())
    return first.join(docs.groupBy("text").agg(F.count("*").alias("copies")), "text").select("text", "doc_id", "copies")


SPAN = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
s AS (
  SELECT *, LAST_VALUE(CASE WHEN event_type = 'view' THEN k END IGNORE NULLS)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active
  FROM e)
"""


def spans(spark, sf_dir):
    ev = kind_events(spark, sf_dir)
    return carry(ev, ["user_id"], ["ts", "event_id"], time_segment("ts", 86_400),
                 last={"active": F.when(F.col("event_type") == "view", F.col("k"))})


@query(SPAN + "SELECT event_id, user_id, event_type, active FROM s")
def active_span(spark, sf_dir):
    """Every event with the view that was open."""
    return spans(spark, sf_dir).select("event_id", "user_id", "event_type", "active")


@query(SPAN + """SELECT user_id, active, COUNT(*) AS n FROM s
WHERE event_type = 'error' AND active IS NOT NULL GROUP BY 1, 2""")
def hits_by_span(spark, sf_dir):
    """Errors per user and open view."""
    return spans(spark, sf_dir).where("event_type = 'error' AND active IS NOT NULL").groupBy("user_id", "active").agg(
        F.count("*").alias("n"))


@query(SPAN + """, c AS (SELECT user_id, active, COUNT(*) AS n FROM s
  WHERE event_type = 'error' AND active IS NOT NULL GROUP BY 1, 2),
old AS (SELECT DISTINCT user_id, active FROM s WHERE event_type = 'error' AND active IS NOT NULL AND ts < TIMESTAMP '2024-01-08')
SELECT c.user_id, c.active, c.n FROM c LEFT JOIN old USING (user_id, active) WHERE old.user_id IS NULL""")
def nudge_once(spark, sf_dir):
    """Counts of pairs that had no error in the first week."""
    hit = spans(spark, sf_dir).where("event_type = 'error' AND active IS NOT NULL").select(
        F.col("user_id").alias("session"), F.col("active").alias("skill"), "ts")
    counts = hit.groupBy("session", "skill").agg(F.count("*").alias("n"))
    old = hit.where("ts < TIMESTAMP '2024-01-08'")
    return mining.nudge_once(counts, old).select(F.col("session").alias("user_id"), F.col("skill").alias("active"), "n")


@query(r"""
WITH e AS (SELECT user_id, event_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
q AS (
  SELECT *, LAST_VALUE(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
       OVER (PARTITION BY user_id, k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked
  FROM e WHERE event_type IN ('view', 'purchase'))
SELECT user_id, k, event_id AS answered, asked FROM q WHERE event_type = 'purchase' AND asked IS NOT NULL""")
def ask_answer(spark, sf_dir):
    """Each purchase with the last earlier view of the same thing by the same user."""
    ev = kind_events(spark, sf_dir).where("event_type in ('view', 'purchase')")
    blocks = ev.select(
        F.col("user_id").alias("file"), F.col("k").cast("string").alias("id"), F.col("event_id").alias("seq"),
        F.lit(0).alias("pos"), F.when(F.col("event_type") == "view", "call").otherwise("result").alias("part"),
        F.lit("AskUserQuestion").alias("name"), F.col("event_id").cast("string").alias("input"),
        F.lit(None).cast("string").alias("text"))
    return mining.ask_answer(blocks).select(
        F.col("file").alias("user_id"), F.col("id").cast("int").alias("k"), F.col("seq").alias("answered"),
        F.col("question").cast("bigint").alias("asked"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r AS (SELECT user_id, k, MIN(event_id) AS result_seq FROM e WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.user_id, e.k, e.event_id, r.result_seq FROM e LEFT JOIN r ON e.user_id = r.user_id AND e.k = r.k WHERE event_type = 'click'""")
def call_result(spark, sf_dir):
    """Each click with the first purchase of the same thing."""
    ev = kind_events(spark, sf_dir).where("event_type in ('click', 'purchase')")
    blocks = ev.select(
        F.col("user_id").alias("file"), F.col("k").alias("id"), F.col("event_id").alias("seq"), F.lit(0).alias("pos"),
        F.when(F.col("event_type") == "click", "call").otherwise("result").alias("part"),
        F.col("event_type").alias("name"), F.col("event_type").alias("line"), F.lit("").alias("text"))
    return mining.call_result(blocks).select(
        F.col("file").alias("user_id"), F.col("id").alias("k"), F.col("seq").alias("event_id"), "result_seq")


@query("""
SELECT event_type AS model, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM events GROUP BY 1""")
def usage_by_model(spark, sf_dir):
    """Events per type and their share."""
    ev = table(spark, sf_dir, "events").select(F.lit("assistant").alias("type"), F.col("event_type").alias("model"))
    return mining.usage_by_model(ev).withColumn("share", F.round("share", 6))


CLAIMS = TURNS + r""", f AS (
  SELECT session, seq, turn_id, claude_text,
         lower(regexp_extract(claude_text, '(?i)(?:^|[^\p{L}\p{N}_])(the|la|die|que)(?:$|[^\p{L}\p{N}_])', 1)) AS pattern
  FROM r WHERE regexp_matches(claude_text, '(?i)(?:^|[^\p{L}\p{N}_])(the|la|die|que)(?:$|[^\p{L}\p{N}_])'))
"""


@query(CLAIMS + "SELECT session, seq, pattern, left(claude_text, 200) AS quote FROM f")
def no_artifact_claim(spark, sf_dir):
    """Turns whose last text claims something and which hold no call."""
    return lenses.no_artifact_claim(session_events(spark, sf_dir), CLAIM).select("session", "seq", "pattern", "quote")


@query(TURNS + r"""
SELECT session, seq, name AS pattern, left(claude_text, 200) AS quote FROM r, (VALUES
  ('first', '(?:^|[^\p{L}])the tion'), ('second', '(?:^|[^\p{L}])la que'), ('third', '(?:^|[^\p{L}])die [a-z]+ich[^\p{L}]')) AS c(name, says)
WHERE regexp_matches(claude_text, says)""")
def skipped_check(spark, sf_dir):
    """Reported checks without a matching call."""
    checks = {"first": (r"(?:^|[^\p{L}])the tion", "^Bash"), "second": (r"(?:^|[^\p{L}])la que", "^Bash"),
              "third": (r"(?:^|[^\p{L}])die [a-z]+ich[^\p{L}]", "^Bash")}
    return lenses.skipped_check(session_events(spark, sf_dir), checks).select("session", "seq", "pattern", "quote")


@query(TURNS + r"""
SELECT session, seq, trim(regexp_extract(user_text, '[A-Z][a-z]+ [a-z]+\.', 0)) AS pattern, left(user_text, 200) AS quote FROM r
WHERE len(string_split(user_text, chr(10))) >= 3 AND regexp_matches(user_text, '[A-Z][a-z]+ [a-z]+\.')""")
def pasted_context(spark, sf_dir):
    """Long prompts that carry a pasted passage."""
    return lenses.pasted_context(session_events(spark, sf_dir), r"[A-Z][a-z]+ [a-z]+\.", min_lines=3).select(
        "session", "seq", "pattern", "quote")


@query(CLAIMS + """
, per AS (SELECT session, pattern, MIN((seq, left(claude_text, 200))) AS q, COUNT(*) AS n FROM f GROUP BY 1, 2),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pattern ORDER BY session) AS rk FROM per)
SELECT pattern, COUNT(*) AS sessions, CAST(SUM(n) AS BIGINT) AS n,
       string_agg(q[2], ' / ' ORDER BY rk) FILTER (WHERE rk <= 3) AS quotes
FROM ranked GROUP BY 1 HAVING COUNT(*) >= 2""")
def recurring(spark, sf_dir):
    """Claims that recur in two or more sessions, with three quotes."""
    found = lenses.no_artifact_claim(session_events(spark, sf_dir), CLAIM)
    return lenses.recurring(found).select("pattern", "sessions", "n", F.array_join("quotes", " / ").alias("quotes"))


@query("""
WITH e AS (SELECT user_id AS session, event_id AS seq, event_type || ' ' || json_extract_string(props, '$.k') AS line FROM events
           WHERE event_type IN ('view', 'click')),
s AS (SELECT line, session, MIN(seq) AS seq FROM e GROUP BY 1, 2),
f AS (SELECT line, arg_min(session, (seq, session)) AS first_session FROM s GROUP BY 1 HAVING COUNT(*) > 1)
SELECT s.line, first_session, session AS later_session, seq FROM s JOIN f USING (line) WHERE session <> first_session""")
def rediscovered(spark, sf_dir):
    """Views and clicks another user had made before."""
    return lenses.rediscovered(tool_lines(spark, sf_dir), "^(view|click) ")


def tool_lines(spark, sf_dir):
    return kind_events(spark, sf_dir).select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_id").alias("started"),
        F.concat_ws(" ", "event_type", F.col("k").cast("string")).alias("line"))


@query("""
SELECT user_id AS session, event_type || ' ' || json_extract_string(props, '$.k') AS line, COUNT(*) AS n, MIN(event_id) AS seq
FROM events GROUP BY 1, 2 HAVING COUNT(*) >= 3""")
def wasted_calls(spark, sf_dir):
    """The same call three or more times by one user."""
    return lenses.wasted_calls(tool_lines(spark, sf_dir), 3).select("session", "line", "n", "seq")


@query("""
SELECT event_type || '-' || json_extract_string(props, '$.k') AS theme, COUNT(*) AS n, COUNT(DISTINCT user_id) AS sources FROM events GROUP BY 1 HAVING COUNT(DISTINCT user_id) >= 2""")
def theme_repeat(spark, sf_dir):
    """Event types with their tag across two or more users."""
    tagged = kind_events(spark, sf_dir).select(F.concat_ws("-", "event_type", F.col("k").cast("string")).alias("theme"), F.col("user_id").alias("source"))
    return lenses.theme_repeat(tagged)


WORDS = r"list_distinct(list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1), lambda x: length(x) >= 2))"


@query(f"""
WITH a AS (SELECT conv_id * 100 + turn AS request, {WORDS} AS w FROM conversations WHERE role = 'user'),
q AS (SELECT item_id * 1000 + pos AS trigger, item_id % 24 AS skill, {WORDS} AS k
      FROM (SELECT item_id, UNNEST(string_split(text, '.')) AS text, generate_subscripts(string_split(text, '.'), 1) - 1 AS pos FROM benchmark)),
p AS (SELECT request, skill, trigger, len(list_intersect(w, k)) AS shared, len(k) AS of FROM a, q WHERE len(k) > 0),
h AS (SELECT request, skill, MAX(shared / of) AS score FROM p WHERE shared >= ceil(of * 0.5) GROUP BY 1, 2),
b AS (SELECT h.request, h.skill, MIN(trigger) AS trigger, ANY_VALUE(h.score) AS score FROM h JOIN p
      ON h.request = p.request AND h.skill = p.skill AND p.shared / p.of = h.score GROUP BY 1, 2)
SELECT request, skill, trigger, ROUND(score, 6) AS score FROM b
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.request = b.request AND a.request % 3 = 0 AND b.skill = 0)""")
def missed_trigger(spark, sf_dir):
    """Prompts that hold half the words of a benchmark sentence whose skill did not load."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request"), "text")
    triggers = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("pos", "query")).select(
        (F.col("item_id") * 1000 + F.col("pos")).alias("trigger"), (F.col("item_id") % 24).alias("skill"), "query")
    loads = asked.where("request % 3 = 0").select("request", F.lit(0).cast("bigint").alias("skill"))
    return lenses.missed_trigger(asked, triggers, loads, 0.5, 2).select(
        "request", "skill", "trigger", F.round("score", 6).alias("score"))


@query("""
SELECT CAST(conv_id % 10 AS VARCHAR) AS project, 'revert' AS kind, 'd' || (conv_id * 100 + turn) AS ref, 'Revert ' || text AS text
FROM conversations WHERE role = 'system'
UNION ALL SELECT CAST(doc_id % 10 AS VARCHAR), 'review', CAST(doc_id AS VARCHAR), text FROM documents
UNION ALL SELECT CAST(conv_id % 10 AS VARCHAR), 'correction', CAST(conv_id AS VARCHAR), text FROM conversations WHERE role = 'user'""")
def review_lessons(spark, sf_dir):
    """Reverts, review notes and corrections of a project in one table."""
    talk = table(spark, sf_dir, "conversations").withColumn("project", (F.col("conv_id") % 10).cast("string"))
    commits = talk.where("role in ('system', 'assistant')").select(
        "project", F.concat(F.lit("d"), (F.col("conv_id") * 100 + F.col("turn")).cast("string")).alias("sha"),
        F.concat(F.when(F.col("role") == "system", "Revert ").otherwise("Add "), "text").alias("message"))
    comments = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 10).cast("string").alias("project"), F.col("doc_id").alias("ref"), "text")
    fixes = talk.where("role = 'user'").select("project", F.col("conv_id").alias("session"), F.col("text").alias("user"))
    return lenses.review_lessons(commits, comments, fixes)


@query("""
WITH e AS (SELECT ts, CASE WHEN event_type = 'purchase' THEN 'decision' ELSE event_type END AS kind, event_id AS ref,
                  event_type || ' k' || json_extract_string(props, '$.k') AS text FROM events),
h AS (SELECT * FROM e WHERE contains(text, 'k7') AND ts >= (SELECT MAX(ts) FROM events) - INTERVAL 7 DAYS),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY ts DESC, ref) AS rk FROM h)
SELECT kind, ref, text FROM r WHERE kind = 'decision' OR rk <= 5""")
def recall_brief(spark, sf_dir):
    """What the last seven days hold on a topic."""
    ev = kind_events(spark, sf_dir)
    last = ev.agg(F.max("ts"))
    records = ev.select(
        "ts", F.when(F.col("event_type") == "purchase", "decision").otherwise(F.col("event_type")).alias("kind"),
        F.col("event_id").alias("ref"), F.concat("event_type", F.lit(" k"), F.col("k").cast("string")).alias("text"))
    return lenses.recall_brief(records, "k7", last.scalar()).select("kind", "ref", "text")


@query("""
SELECT COUNT(DISTINCT user_id) AS files, COUNT(*) FILTER (WHERE event_type = 'error') AS hits,
  CAST(COUNT(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 = 0) AS BIGINT) AS bad_lines FROM events""")
def mining_stats(spark, sf_dir):
    """Users as files, errors as hits, every twentieth kind as an unreadable line."""
    ev = kind_events(spark, sf_dir)
    raw = ev.select(F.col("user_id").alias("file"), (F.col("k") % 20 == 0).alias("bad"))
    return mining.mining_stats(raw, ev.where("event_type = 'error'"))


@query(SPAN + """SELECT event_id AS seq, 'REPLY' AS kind, active FROM s WHERE event_type = 'error' AND active = 7
UNION ALL SELECT event_id, 'REJECTED', active FROM s WHERE event_type = 'click' AND active = 7""")
def skill_span_filter(spark, sf_dir):
    """Errors and clicks of two kinds made while view 7 was open."""
    rows = spans(spark, sf_dir).withColumn("active_skill", F.col("active").cast("string"))
    none = F.lit(None).cast("string")
    kind = lambda t, name, part: rows.where(F.col("event_type") == t).select(
        F.col("user_id").alias("file"), none.alias("project"), none.alias("session"), F.col("event_id").alias("seq"), F.lit(part).alias("part"),
        F.lit(0).alias("pos"), F.lit(name).alias("kind"), "active_skill", none.alias("before"), none.alias("user"))
    both = mining.union_kinds(kind("click", "REJECTED", 0), kind("error", "REPLY", 1))
    return mining.skill_span_filter(both, "/x:7").select("seq", "kind", F.col("active_skill").cast("int").alias("active"))
