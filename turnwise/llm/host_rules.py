"""Quality rules judged by host.

Every document is measured once and each rule passes or fails it. Failures are added up by host, and a
host's rate is shrunk towards the rate of all hosts by a beta prior whose strength is fitted from how far hosts
lie apart (method of moments for beta-binomial counts). A host of few documents, or hosts that are all
alike, keep close to the common rate. Documents of a host whose shrunk rate passes the limit go.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from turnwise.lineage import durable, stored
from turnwise.llm.common import whole
from turnwise.operators.ordered import lookup

# White space, symbols, and the rules that fail a document by itself.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
BASE = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeated": "100 * n_repeat_words > 50 * n_words",
}

#: Rules of which a host's share of failures is judged; those of BASE among them.
RULES = BASE | {
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
LIMIT = 0.5  # shrunk rate of failures above which a host goes
ALIKE = 1e-6  # least correlation of documents of a host: hosts that do not differ share one rate
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=n)
    pair = np.unique(at[:-1] * len(code) + at[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(code) + at[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    held = np.zeros(n, dtype=bool)
    for k in range(3):
        held[k:n - 2 + k] |= again
    return int(held.sum())


def measure(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Lines count that hold a word; a line is a duplicate if it equals an earlier one."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(words), len(text) - sum(text.count(c) for c in SPACE), sum(text.count(c) for c in SYMBOLS),
            len(lines), len(lines) - len(set(lines)), repeated_words(words))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, host and COUNTS of each row of ``documents`` (doc_id, host, text)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [measure(t.as_py()) for t in part.column(2)]
            found = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], ["doc_id", "host", *COUNTS])

    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("host").cast("string").alias("host"), whole().alias("text"))
    return narrow.mapInArrow(batches, f"doc_id bigint, host string, {', '.join(f'{c} bigint' for c in COUNTS)}")


def host_failures(rows: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """host, n and failures f_<rule> of the measured ``rows``; rows without a host belong to none."""
    fails = [F.sum(F.expr(rule).cast("bigint")).alias(f"f_{name}") for name, rule in rules.items()]
    return rows.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *fails)


def moments(hosts: DataFrame, rules: dict[str, str] = RULES) -> Row:
    """What the priors are fitted from, one row: hosts, n, n * n, and per rule f and f * f / n, each added up over hosts."""
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.count("*").alias("hosts")]
    for name in rules:
        f = F.col(f"f_{name}")
        sums += [F.sum(f).alias(f"f_{name}"), F.sum(f * f / F.col("n")).alias(f"ff_{name}")]
    return hosts.agg(*sums).first()


def beta_prior(hosts: int, n: int, nn: float, f: int, ff: float) -> tuple[float, float]:
    """Parameters of the beta prior of a rule's failure rate.

    With m the common rate, hosts of one true rate would give sum of n (f / n - m)^2 = m (1 - m) (hosts - 1); what is
    above grows with the correlation r of a host's documents, and the prior weighs 1 / r - 1 documents.
    """
    mean = f / n
    spread, room = mean * (1 - mean), n - nn / n - (hosts - 1)
    r = ((ff - mean * mean * n) / spread - (hosts - 1)) / room if spread > 0 and room > 0 else 0.0
    weight = 1 / min(max(r, ALIKE), 1 - ALIKE) - 1
    return mean * weight, (1 - mean) * weight


def host_rates(hosts: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``hosts`` with the shrunk rate r_<rule> of each rule."""
    seen = moments(hosts, rules)
    if not seen["hosts"]:
        return hosts.select("*", *[F.lit(None).cast("double").alias(f"r_{name}") for name in rules])
    priors = {name: beta_prior(seen["hosts"], seen["n"], seen["nn"], seen[f"f_{name}"], seen[f"ff_{name}"]) for name in rules}
    return hosts.select("*", *[((F.col(f"f_{name}") + a) / (F.col("n") + a + b)).alias(f"r_{name}") for name, (a, b) in priors.items()])


def failed_hosts(rates: DataFrame, rules: dict[str, str] = RULES, limit: float = LIMIT) -> DataFrame:
    """Hosts with a rule whose shrunk rate passes the limit."""
    over: Column = F.greatest(*[F.col(f"r_{name}") for name in rules]) if len(rules) > 1 else F.col(f"r_{next(iter(rules))}")
    return rates.where(over > limit).select("host")


def judge(documents: DataFrame, rules: dict[str, str] = RULES, limit: float = LIMIT) -> DataFrame:
    """Measures and verdict of each row of ``documents`` (doc_id, host, text): doc_id, host, COUNTS, base_failed, host_failed, kept.

    A document is kept if no rule of BASE fails it and its host is not rejected. A null or empty text has no words and
    fails; a row without a host is judged by itself; repeated rows count each, and a row without doc_id is a document like
    others; rates equal to the limit pass; an empty table gives no rows. Other columns of ``documents`` are not read.
    """
    rows = stored(measured(documents))
    bad = failed_hosts(host_rates(durable(host_failures(rows, rules)), rules), rules, limit).withColumn("_bad", F.lit(True))
    base = F.expr(" or ".join(f"({rule})" for rule in BASE.values()))
    return lookup(rows, bad, ["host"], ["doc_id", "n_words"]).select(
        "doc_id", "host", *COUNTS, base.alias("base_failed"), F.col("_bad").isNotNull().alias("host_failed"),
        (~base & F.col("_bad").isNull()).alias("kept"))


def rule_sql(limit: float = LIMIT) -> str:
    """DuckDB SQL for the rows of ``judge`` over ``documents``, its source as the host."""
    space = r"[ \t\n\x0b\f\r]"
    fails = ", ".join(f"sum(({rule})::int) AS f_{name}" for name, rule in RULES.items())
    prior, rate = [], []
    for name in RULES:
        mean = f"(sum(f_{name}) / sum(n))"
        found = f"(((sum(f_{name} * f_{name} / n) - {mean} * {mean} * sum(n)) / ({mean} * (1 - {mean})) - (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)))"
        usable = f"{mean} * (1 - {mean}) > 0 AND sum(n) - sum(n * n) / sum(n) - (count(*) - 1) > 0"
        prior.append(f"{mean} AS m_{name}, 1 / least(greatest(CASE WHEN {usable} THEN {found} ELSE 0 END, {ALIKE}), 1 - {ALIKE}) - 1 AS w_{name}")
        rate.append(f"(f_{name} + m_{name} * w_{name}) / (n + w_{name}) > {limit}")
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
     w AS (SELECT r, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS w FROM t),
     p AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
     g AS (SELECT r, i, a, lead(a, 1) OVER v AS b, lead(a, 2) OVER v AS c FROM p WINDOW v AS (PARTITION BY r ORDER BY i)),
     k AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM g WHERE c IS NOT NULL),
     z AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) o(j) WHERE times > 1 GROUP BY r),
     l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
           FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^ \\t\\n\\x0b\\f\\r]') GROUP BY r),
     m AS (SELECT t.r, doc_id, host, len(w) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
           FROM t JOIN w ON w.r = t.r LEFT JOIN l ON l.r = t.r LEFT JOIN z ON z.r = t.r),
     h AS (SELECT host, count(*) AS n, {fails} FROM m WHERE host IS NOT NULL GROUP BY host),
     b AS (SELECT {", ".join(prior)} FROM h),
     bad AS (SELECT host FROM h, b WHERE {" OR ".join(rate)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(BASE.values())} AS base_failed,
  bad.host IS NOT NULL AS host_failed, NOT ({" OR ".join(BASE.values())}) AND bad.host IS NULL AS kept
FROM m LEFT JOIN bad ON bad.host = m.host
"""
