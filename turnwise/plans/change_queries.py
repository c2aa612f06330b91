"""Change queries on documents: every even document is an old version, the next odd one the new."""
from pyspark.sql import functions as F

from turnwise.operators import changes
from turnwise.plans.registry import query, table


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("rev"),
        F.concat((F.floor(F.col("doc_id") / 2)).cast("string"), F.lit(".txt")).alias("path"), "text")


BLOCKS = r"""
WITH f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS rev, (doc_id // 2) || '.txt' AS path, text FROM documents),
l AS (SELECT rev, path, UNNEST(string_split_regex(text, '\r\n|[\n\r\f\x0B\x1C-\x1E\x{85}\x{2028}\x{2029}]')) AS raw,
             generate_subscripts(string_split_regex(text, '\r\n|[\n\r\f\x0B\x1C-\x1E\x{85}\x{2028}\x{2029}]'), 1) AS no FROM f),
k AS (SELECT rev, path, no, regexp_replace(raw, '[ \t]+$', '') AS line FROM l WHERE regexp_replace(raw, '[ \t]+$', '') <> ''),
s AS (SELECT *, SUM(CASE WHEN regexp_matches(line, '^[^\s})\]]') THEN 1 ELSE 0 END) OVER (PARTITION BY rev, path ORDER BY no) AS b FROM k),
blocks AS (SELECT rev, path, b, string_agg(line, chr(10) ORDER BY no) AS block, COUNT(*) AS n_lines FROM s GROUP BY 1, 2, 3),
c AS (SELECT path, block, sha256(block) AS block_id, n_lines, COUNT(*) FILTER (WHERE rev = 'new') AS n_new,
             COUNT(*) FILTER (WHERE rev = 'old') AS n_old FROM blocks GROUP BY 1, 2, 3, 4),
d AS (SELECT block_id, MIN(trim(string_split(block, chr(10))[1])) AS first_line, MAX(n_lines) AS n_lines,
             CAST(SUM(n_new) - SUM(n_old) AS BIGINT) AS delta FROM c GROUP BY 1 HAVING SUM(n_new) <> SUM(n_old))
"""


@query(BLOCKS + "SELECT block_id, first_line, CAST(n_lines AS INTEGER) AS lines, delta FROM d")
def signed_multiset(spark, sf_dir):
    """Blocks whose number changed."""
    return changes.block_multiset(changes.blocks(files(spark, sf_dir)))


@query(BLOCKS + "SELECT block_id, first_line, CAST(n_lines AS INTEGER) AS lines, delta AS n FROM d WHERE delta > 0")
def extra_blocks(spark, sf_dir):
    """Blocks that came."""
    return changes.extra_blocks(changes.blocks(files(spark, sf_dir)))


@query(BLOCKS + "SELECT block_id, first_line, CAST(n_lines AS INTEGER) AS lines, -delta AS n FROM d WHERE delta < 0")
def lost_blocks(spark, sf_dir):
    """Blocks that went."""
    return changes.lost_blocks(changes.blocks(files(spark, sf_dir)))


@query(BLOCKS + """SELECT c.block_id, c.path, CAST(n_new - n_old AS BIGINT) AS here, d.delta FROM c JOIN d USING (block_id)
WHERE n_new <> n_old AND sign(n_new - n_old) = sign(d.delta)""")
def block_paths(spark, sf_dir):
    """The files behind each changed block."""
    cut = changes.blocks(files(spark, sf_dir))
    return changes.block_paths(cut, changes.block_multiset(cut))


@query(BLOCKS + "SELECT CAST(SUM(n_lines * greatest(n_old - n_new, 0)) AS BIGINT) AS lines FROM c")
def moved_lines(spark, sf_dir):
    """Lines that left a file."""
    return changes.moved_lines(changes.blocks(files(spark, sf_dir)))


CHANGED = """
WITH p AS (SELECT (doc_id // 2) || '.txt' AS path, MAX(text) FILTER (WHERE doc_id % 2 = 0) AS o, MAX(text) FILTER (WHERE doc_id % 2 = 1) AS n
           FROM documents GROUP BY 1)
"""


@query(CHANGED + """SELECT path, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM p WHERE o IS DISTINCT FROM n""")
def changed_paths(spark, sf_dir):
    """Files that differ between the versions."""
    return changes.changed_paths(files(spark, sf_dir))


@query(BLOCKS + """SELECT 'logic edits' AS verdict, (SELECT COUNT(*) FROM (SELECT doc_id // 2 AS p FROM documents GROUP BY 1
  HAVING MAX(CASE WHEN doc_id % 2 = 0 THEN text END) IS DISTINCT FROM MAX(CASE WHEN doc_id % 2 = 1 THEN text END))) AS files,
  COUNT(*) AS edits, CAST(NULL AS BIGINT) AS moved_lines FROM d""")
def move_verdict(spark, sf_dir):
    """One verdict over all files."""
    return changes.move_verdict(files(spark, sf_dir))


LINES = r"""
WITH f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS rev, (doc_id // 2) || '.txt' AS path,
                  string_split_regex(text, '\r?\n') AS l FROM documents),
x AS (SELECT rev, path, UNNEST(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM f)
"""


@query(LINES + """SELECT line, CAST(COUNT(*) FILTER (WHERE rev = 'new') - COUNT(*) FILTER (WHERE rev = 'old') AS BIGINT) AS delta FROM x
GROUP BY 1 HAVING COUNT(*) FILTER (WHERE rev = 'new') <> COUNT(*) FILTER (WHERE rev = 'old')""")
def signed_lines(spark, sf_dir):
    """Lines as a bag over all files."""
    return changes.signed_lines(changes.lines_of(files(spark, sf_dir)))


@query("""
SELECT l_orderkey, l_partkey, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'O'
  EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1, 2""")
def extra_rows(spark, sf_dir):
    """Open (order, part) rows beyond the filled ones, as a bag."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "new").otherwise("old").alias("rev"), "l_orderkey", "l_partkey")
    return changes.signed_lines(rows, ("l_orderkey", "l_partkey")).where("delta > 0").withColumnRenamed("delta", "n")


@query("""
SELECT l_orderkey, l_partkey, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'
  EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1, 2""")
def lost_rows(spark, sf_dir):
    """Filled (order, part) rows beyond the open ones, as a bag."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "new").otherwise("old").alias("rev"), "l_orderkey", "l_partkey")
    return changes.signed_lines(rows, ("l_orderkey", "l_partkey")).where("delta < 0").select(
        "l_orderkey", "l_partkey", (-F.col("delta")).alias("n"))


@query(LINES + """SELECT path, CAST(pos AS INTEGER) AS pos, line FROM x n WHERE rev = 'new'
AND NOT EXISTS (SELECT 1 FROM x o WHERE o.rev = 'old' AND o.path = n.path AND o.line = n.line)""")
def added_lines(spark, sf_dir):
    """New lines a file did not have."""
    return changes.added_lines(changes.lines_of(files(spark, sf_dir)))


@query(r"""
WITH l AS (SELECT doc_id, UNNEST(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS no
           FROM documents)
SELECT doc_id || '_test.py' AS path, trim(arg_min(line, no)) AS line FROM l
WHERE trim(line, ' ' || chr(9)) <> '' AND regexp_matches(line, '[0-9]') GROUP BY 1""")
def first_lost_line(spark, sf_dir):
    """The first line each text loses when its lines with digits go."""
    kept = F.array_join(F.filter(F.split("text", r"\r?\n"), lambda s: ~s.rlike("[0-9]")), "\n")
    pairs = table(spark, sf_dir, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_test.py")).alias("path"), F.col("text").alias("head_text"),
        kept.alias("new_text"))
    return changes.lost_test_lines(pairs)


@query(LINES + r"""
SELECT path, rev, CAST(pos AS INTEGER) AS pos, 'marks' AS rule FROM x WHERE regexp_matches(line, '\*\*\*')
UNION ALL SELECT path, rev, CAST(pos AS INTEGER), 'bars' FROM x WHERE regexp_matches(line, '\|\|')
UNION ALL SELECT path, rev, CAST(pos AS INTEGER), 'hash' FROM x WHERE regexp_matches(line, '###')""")
def weak_assertion(spark, sf_dir):
    """Lines that hit a pattern of weak tests."""
    rules = {"marks": r"\*\*\*", "bars": r"\|\|", "hash": "###"}
    return changes.weak_assertion(changes.lines_of(files(spark, sf_dir)), rules).select("path", "rev", "pos", "rule")


@query(LINES + r"""
, g AS (SELECT path, trim(line) AS line FROM x WHERE regexp_matches(line, '(?:^|[^\p{L}])(the|la|der)[^\p{L}]')
        GROUP BY 1, 2 HAVING COUNT(*) FILTER (WHERE rev = 'old') > COUNT(*) FILTER (WHERE rev = 'new')),
n AS (SELECT DISTINCT path, trim(line) AS line FROM x WHERE pos = 0)
SELECT g.path, g.line, CAST(COUNT(*) FILTER (WHERE x.rev = 'old') - COUNT(*) FILTER (WHERE x.rev = 'new') AS BIGINT) AS gone
FROM g JOIN x ON x.path = g.path AND trim(x.line) = g.line WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path = g.path AND n.line = g.line)
  AND regexp_matches(x.line, '(?:^|[^\p{L}])(the|la|der)[^\p{L}]')
GROUP BY 1, 2""")
def unnamed_test_change(spark, sf_dir):
    """Lost lines that no first line names."""
    rows = changes.lines_of(files(spark, sf_dir))
    return changes.unnamed_test_change(rows, rows.where("pos = 0"), r"(?:^|[^\p{L}])(the|la|der)[^\p{L}]")


@query("""
WITH e AS (SELECT user_id AS pr, event_id AS seq, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS patch FROM events),
p AS (SELECT pr, MAX(seq) AS last_seq, arg_max(patch, seq) AS last_patch FROM e WHERE event_type = 'click' GROUP BY 1)
SELECT e.pr, e.seq, e.patch, COALESCE(last_seq > seq AND last_patch <> patch, FALSE) AS void FROM e LEFT JOIN p USING (pr) WHERE event_type = 'view'""")
def latest_patch(spark, sf_dir):
    """Verdicts a later push made void."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pr"), F.col("event_id").alias("seq"), "event_type",
        (F.get_json_object("props", "$.k").cast("int") % 3).alias("patch"))
    return changes.latest_patch(ev.where("event_type = 'click'"), ev.where("event_type = 'view'").withColumn("verdict", F.lit("PASS"))).select(
        "pr", "seq", "patch", "void")
