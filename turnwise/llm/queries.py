"""One query per operator over the given tables."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import (alignment, audio, fingerprints, host_rules, html_text, jaccard_join, licences, merkle, mixing, packing, pii, secret_scan,
                          toxicity)
from turnwise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query()
def op9_secrets(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")


@query()
def op4_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM t),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
     l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
     e AS (SELECT x, y FROM l UNION SELECT y, x FROM l)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (
  WITH RECURSIVE reach(doc_id, c) AS (SELECT x, x FROM e UNION SELECT e.y, reach.c FROM reach JOIN e ON e.x = reach.doc_id)
  SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
""")
def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.join_alike(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op6_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query()
def op2_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op10_audio(spark, sf_dir):
    return audio.media_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op7_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query()
def op1_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(licences.licence_sql())
def op5_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licences.known_digests(spark))


@query(host_rules.rule_sql())
def op11_host_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "source AS host", "text")
    return host_rules.judge(docs).drop("host", "n_lines")


@query(merkle.SQL)
def op12_merkle(spark, sf_dir):
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


@query()
def op13_alignment(spark, sf_dir):
    return alignment.align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
