"""Prose queries on documents and pages."""
from pyspark.sql import functions as F

from turnwise.functions.text import body, front_matter, lines, sentences, word_count, words
from turnwise.operators import prose
from turnwise.plans.registry import query, table

RULES = {
    "article": r"(?:^|[^\p{L}\p{N}_])(the|la|der|el)[^\p{L}\p{N}_]",
    "marks": r"\*\*\*",
    "bar": r"\|",
    "mail": r"[A-Za-z0-9_.]+@[a-z]+\.[a-z]+",
    "hex": "[0-9a-f]{7,40}",
}
# The oracle's engine has no look-behind, so a sentence ends where the mark is set.
SENTENCES = r"""
WITH l AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents),
p AS (SELECT * FROM l WHERE length(trim(line)) > 0 AND NOT starts_with(line, '#') AND NOT starts_with(ltrim(line), '|')),
k AS (SELECT *, regexp_matches(line, '^\s*\d+\.\s+') AS step FROM p),
x AS (
  SELECT doc_id, line_no, CASE WHEN step THEN 20 ELSE 25 END AS lim,
         list_filter(string_split(regexp_replace(
             trim(CASE WHEN step THEN regexp_replace(line, '^\s*\d+\.\s+', '') ELSE line END, ' ' || chr(9) || chr(13)),
             '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: s <> '') AS ss
  FROM k),
s AS (SELECT doc_id, line_no, lim, UNNEST(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM x),
w AS (SELECT doc_id, line_no, lim, pos, sentence, len(string_split_regex(trim(regexp_replace(regexp_replace(sentence,
             '`[^`]*`', 'CODE', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')), '\s+')) AS words FROM s)
"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(SENTENCES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(pos AS INTEGER) AS pos, CAST(words AS INTEGER) AS words FROM w WHERE words > lim")
def long_sentences(spark, sf_dir):
    """Sentences over 25 words, steps over 20."""
    return prose.long_sentences(docs(spark, sf_dir)).where("kind <> 'cell'").select("doc_id", "line_no", "pos", "words")


@query(r"""
WITH l AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents),
f AS (SELECT doc_id, line_no, line, starts_with(ltrim(line), '***') AS is_fence FROM l)
SELECT doc_id, COUNT(*) AS lines, CAST(SUM(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) AS BIGINT) AS fences,
       MAX(length(line)) AS longest FROM f GROUP BY 1""")
def line_profile(spark, sf_dir):
    """Lines per document, its fences and its longest line."""
    return prose.fence_state(docs(spark, sf_dir), every_break=False).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.col("is_fence").cast("int")).alias("fences"),
        F.max(F.length("line")).cast("bigint").alias("longest"))


FENCED = r"""
WITH d AS (SELECT page_id, replace(html, '<p>', chr(10) || '```' || chr(10)) AS text FROM pages),
l AS (
  SELECT page_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
f AS (SELECT *, starts_with(ltrim(line, ' ' || chr(9)), '```') AS is_fence FROM l),
s AS (SELECT *, SUM(CASE WHEN is_fence THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
"""


@query(FENCED + """SELECT page_id, CAST(line_no AS INTEGER) AS line_no, is_fence, COALESCE(before, 0) % 2 = 1 AS in_fence FROM s""")
def fence_state(spark, sf_dir):
    """Page lines with the state of a fence at every paragraph tag."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<p>"), F.lit("\n```\n")).alias("text"))
    return prose.fence_state(pages, every_break=False).select("page_id", "line_no", "is_fence", "in_fence")


@query(r"""
WITH h AS (
SELECT doc_id, lang, source, 'article' AS rule, len(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(the|la|der|el)[^\p{L}\p{N}_]')) AS hits FROM documents
  UNION ALL SELECT doc_id, lang, source, 'marks' AS rule, len(regexp_extract_all(text, '\*\*\*')) AS hits FROM documents
  UNION ALL SELECT doc_id, lang, source, 'bar' AS rule, len(regexp_extract_all(text, '\|')) AS hits FROM documents
  UNION ALL SELECT doc_id, lang, source, 'mail' AS rule, len(regexp_extract_all(text, '[A-Za-z0-9_.]+@[a-z]+\.[a-z]+')) AS hits FROM documents
  UNION ALL SELECT doc_id, lang, source, 'hex' AS rule, len(regexp_extract_all(text, '[0-9a-f]{7,40}')) AS hits FROM documents)
SELECT doc_id, rule, CAST(hits AS INTEGER) AS hits FROM h WHERE hits > 0""")
def rule_hits(spark, sf_dir):
    """Hits per document and rule."""
    return prose.tell_catalogue(docs(spark, sf_dir), RULES)


PROFILE = r"""
WITH h AS (
SELECT doc_id, lang, source, 'article' AS rule, len(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(the|la|der|el)[^\p{L}\p{N}_]')) AS hits FROM documents
  UNION ALL SELECT doc_id, lang, source, 'marks' AS rule, len(regexp_extract_all(text, '\*\*\*')) AS hits FROM documents
  UNION ALL SELECT doc_id, lang, source, 'bar' AS rule, len(regexp_extract_all(text, '\|')) AS hits FROM documents
  UNION ALL SELECT doc_id, lang, source, 'mail' AS rule, len(regexp_extract_all(text, '[A-Za-z0-9_.]+@[a-z]+\.[a-z]+')) AS hits FROM documents
  UNION ALL SELECT doc_id, lang, source, 'hex' AS rule, len(regexp_extract_all(text, '[0-9a-f]{7,40}')) AS hits FROM documents)
"""


@query(PROFILE + """SELECT lang, source, rule, CAST(GROUPING(lang, source, rule) AS INTEGER) AS level, CAST(SUM(hits) AS BIGINT) AS hits, COUNT(*) AS docs FROM h WHERE hits > 0
GROUP BY ROLLUP (lang, source, rule)""")
def rule_profile(spark, sf_dir):
    """Hits by language, source and rule with subtotals."""
    hits = prose.tell_catalogue(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), RULES)
    return prose.rule_hit_profile(hits, ("lang", "source", "rule"))


@query(PROFILE + r""", w AS (
  SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(string_split_regex(trim(regexp_replace(regexp_replace(text,
    '`[^`]*`', 'CODE', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '\s+')) END AS n FROM documents)
SELECT lang, source, CAST(GROUPING(lang, source) AS INTEGER) AS level, rule, CAST(SUM(hits) AS BIGINT) AS hits, CAST(SUM(n) AS BIGINT) AS words,
       ROUND(SUM(hits) * 1000 / SUM(n), 6) AS per_1000
FROM h JOIN w USING (doc_id) GROUP BY GROUPING SETS ((lang, source, rule), (lang, rule), (source, rule), (rule))""")
def lexical_stats(spark, sf_dir):
    """Hits per 1,000 words, cubed over language and source."""
    return prose.lexical_stats(table(spark, sf_dir, "documents"), ("lang", "source"), RULES).withColumn(
        "per_1000", F.round("per_1000", 6))


@query(r"""
WITH l AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents),
t AS (SELECT doc_id, line_no, regexp_extract_all(regexp_replace(regexp_replace(line, '`[^`]*`', ' ', 'g'), '\]\([^)]*\)', ']', 'g'),
             '[%*#|]{3}|[A-Za-z0-9_.]+@[a-z]+') AS found FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, UNNEST(found) AS term FROM t""")
def banned_terms(spark, sf_dir):
    """Marks and addresses outside code."""
    return prose.banned_terms(docs(spark, sf_dir), r"[%*#|]{3}|[A-Za-z0-9_.]+@[a-z]+").select("doc_id", "line_no", "term")


@query(r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, 'title' AS rule, CAST(len(l) AS INTEGER) AS n_lines FROM d WHERE l[1] <> '# ' || doc_id
UNION ALL SELECT doc_id, 'headings', CAST(len(l) AS INTEGER) FROM d
  WHERE list_transform(list_filter(l, lambda s: starts_with(s, '## ')), lambda s: trim(s[4:])) <> ['Example']
UNION ALL SELECT doc_id, 'length', CAST(len(l) AS INTEGER) FROM d WHERE len(l) > 20""")
def heading_schema(spark, sf_dir):
    """Documents without the wanted title and headings or with more than 20 lines."""
    return prose.heading_schema(docs(spark, sf_dir), F.col("doc_id").cast("string"), F.array(F.lit("Example")), 20).select(
        "doc_id", "rule", "n_lines")


@query(r"""
WITH d AS (SELECT doc_id, 'MEMORY' AS base, text FROM documents),
n AS (SELECT doc_id, doc_id % 2 = 0 AS idx, text, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, 'digits' AS rule FROM n WHERE regexp_matches(text, '[0-9]{3,}') OR regexp_matches(text, '@[a-z]+')
UNION ALL SELECT doc_id, 'marks' FROM n WHERE regexp_matches(text, '\*\*\*')
  OR len(list_filter(regexp_extract_all(text, '[0-9a-f]{7,40}'), lambda h: regexp_matches(h, '[0-9]') AND regexp_matches(h, '[a-f]'))) > 0
UNION ALL SELECT doc_id, 'index line' FROM n WHERE idx AND len(list_filter(l, lambda s: length(s) > 200)) > 0
UNION ALL SELECT doc_id, 'topic length' FROM n WHERE NOT idx AND length(text) > 1200""")
def note_rules(spark, sf_dir):
    """Documents judged as notes: every second one is an index."""
    notes = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "/m/MEMORY.md").otherwise("/m/x.md").alias("path"),
        F.lit("").alias("old"), F.col("text").alias("new"), F.lit(True).alias("whole"))
    rules = {"digits": ["[0-9]{3,}", "@[a-z]+"], "marks": [r"\*\*\*"]}
    return prose.note_rules(notes, rules=rules, hex_rule="marks", hex_pattern="[0-9a-f]{7,40}").select("doc_id", "rule")


@query(r"""
WITH p AS (SELECT doc_id, UNNEST(string_split_regex(text, '(?:\r?\n[ \t]*){2,}')) AS p,
                  generate_subscripts(string_split_regex(text, '(?:\r?\n[ \t]*){2,}'), 1) - 1 AS para FROM documents),
s AS (SELECT doc_id, para, list_filter(string_split(regexp_replace(trim(regexp_replace(p, '\s*\r?\n\s*', ' ', 'g')),
             '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS ss FROM p WHERE length(trim(p)) > 0)
SELECT doc_id, COUNT(*) AS wide, CAST(MAX(len(ss)) AS INTEGER) AS most FROM s WHERE len(ss) > 6 GROUP BY 1""")
def doc_limits(spark, sf_dir):
    """Paragraphs of more than six sentences."""
    return prose.doc_limits(docs(spark, sf_dir), "^(Use|Run) ").where("rule = 'paragraph'").groupBy("doc_id").agg(
        F.count("*").alias("wide"), F.max("n").alias("most"))


@query("""
SELECT source AS root, CAST(SUM(length(text)) AS BIGINT) AS chars, SUM(length(text)) > 150000 AS over FROM documents GROUP BY 1""")
def instruction_size(spark, sf_dir):
    """Characters per source against the budget."""
    return prose.instruction_size(table(spark, sf_dir, "documents").select(F.col("source").alias("root"), "text"))


@query(r"""
WITH d AS (SELECT doc_id, '---' || chr(10) || 'lang: ' || lang || chr(10) || 'source: "' || source || '"' || chr(10) || '---' || chr(10) || text AS text,
           lang, source, text AS body FROM documents)
SELECT doc_id, lang, source, md5(body) AS body FROM d""")
def read_front_matter(spark, sf_dir):
    """A header written in front of each text and taken off again."""
    from turnwise.functions.text import header_map

    whole = table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.lit("---\nlang: "), "lang", F.lit('\nsource: "'), "source", F.lit('"\n---\n'), "text").alias("text"))
    head = header_map(front_matter("text"))
    return whole.select("doc_id", head["lang"].alias("lang"), head["source"].alias("source"), F.md5(body("text")).alias("body"))


@query(r"""
SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: s <> '')) AS INTEGER) AS sentences,
       CAST(CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(string_split_regex(trim(regexp_replace(regexp_replace(text,
    '`[^`]*`', 'CODE', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '\s+')) END AS INTEGER) AS words,
       CAST(len(list_distinct(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1))) AS INTEGER) AS distinct_words
FROM documents""")
def text_counts(spark, sf_dir):
    """Sentences, words and distinct words per document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(sentences("text")).alias("sentences"), word_count("text").alias("words"),
        F.size(words("text")).alias("distinct_words"))
