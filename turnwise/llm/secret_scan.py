"""Secrets in text: fixed patterns, and strings that a character Markov model takes for random.

Everything runs as columns. Two first-order models over the characters of ``ALPHABET`` are counted
from labelled samples, random strings and the words of documents; a candidate's log-likelihood ratio
is the sum of one table entry per pair of neighbours.
"""
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import boxed, unboxed, whole

# Kinds in their order, each with its pattern.
KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "markov": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}",
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
ORDER = {kind: i for i, kind in enumerate(KINDS)}

HITS = "array<struct<start:bigint,end:bigint,hit:string>>"
STRETCH = 128  # items of a row that are added up together
RANDOM_STRINGS = 4000  # strings of the random sample
THRESHOLD = 14.0  # nats; a million to one before a candidate counts


def _hits(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as (start, end, match) in code points, leftmost first, none overlapping.

    The text between matches and the matches themselves are cut by the same search; their lengths,
    summed up, are the places.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))
    ends = _running(pairs, lambda at, p: at + F.char_length(p["gap"]) + F.char_length(p["hit"]))
    walked = F.transform(F.arrays_zip(found.alias("hit"), ends.alias("end")), lambda h: F.struct(
        (h["end"] - F.char_length(h["hit"])).alias("start"), h["end"].alias("end"), h["hit"].alias("hit")))
    return F.when(F.rlike(text, F.lit(pattern)), walked).otherwise(F.array().cast(HITS))


def _running(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` makes of the number so far, 0 at first, and each item in turn, as an array.

    An array that grows is copied at each step, so results are gathered in stretches of STRETCH items, and stretches in a second array.
    """
    none, kind = F.array().cast("array<bigint>"), "array<struct<at:bigint,out:array<bigint>>>"

    def add(state, item):
        at = step(state["at"], item).cast("bigint")
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

    def stretch(done, cut):
        at = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0).cast("bigint"))
        return F.concat(done, F.array(F.aggregate(cut, F.struct(at.alias("at"), none.alias("out")), add)))

    def walked(held):
        count = F.greatest(F.lit(0), F.floor((F.size(held) - 1) / STRETCH)).cast("int")
        cuts = F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(held, i * STRETCH + 1, F.lit(STRETCH)))
        return F.flatten(F.transform(F.aggregate(cuts, F.array().cast(kind), stretch), lambda s: s["out"]))

    return _once(items, walked)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, although lambdas inside name it many times."""
    return F.get(F.transform(F.array(value), then), 0)


def _free(hits: Column, taken: Column) -> Column:
    """The ``hits`` that overlap none of the spans ``taken``; the hits of one kind are apart.

    Of all in order, a hit is free if no span before it ends after its start and the next one, if it is a span, does not begin before its end.
    """
    both = F.array_sort(F.concat(
        F.transform(taken, lambda t: F.struct(t["start"].alias("start"), F.lit(0).alias("rank"), t["end"].alias("end"), F.lit("").alias("hit"))),
        F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(1).alias("rank"), h["end"].alias("end"), h["hit"].alias("hit")))))
    def seen(spans):
        upto = _running(spans, lambda most, s: F.greatest(most, F.when(s["rank"] == 0, s["end"]).otherwise(0)))
        return F.arrays_zip(spans.alias("s"), upto.alias("upto"), F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))).alias("next"))

    free = F.filter(_once(both, seen), lambda x: (x["s"]["rank"] == 1) & (x["upto"] <= x["s"]["start"])
                    & (x["next"].isNull() | (x["next"]["rank"] == 1) | (x["next"]["start"] >= x["s"]["end"])))
    return F.transform(free, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["hit"].alias("hit")))


def _kept(kind: str, hits: Column) -> Column:
    if kind == "assign":
        value = lambda h: F.regexp_extract(h["hit"], KINDS["assign"], 2)
        return F.filter(hits, lambda h: F.char_length(value(h)) >= 6)
    if kind == "access":
        return F.filter(hits, lambda h: F.char_length(h["hit"]) >= 20)
    return hits


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of neighbouring characters as places in ALPHABET; 0 is the start or any other character.

    Equal strings are counted first, in each task and then together, so characters are looked at once per different string.
    """
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    chars = F.split(F.col("s"), "")
    codes = strings.groupBy("s").agg(F.count("*").alias("n")).select("n", F.concat(F.array(F.lit(0)), F.transform(
        F.filter(chars, lambda c: c != ""), lambda c: code(c))).alias("k"))
    steps = codes.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size("k") - 1), lambda i: F.struct(
        F.get("k", i - 1).alias("a"), F.get("k", i).alias("b")))).alias("p"))
    return steps.groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled random strings, half hexadecimal and half base 64."""
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")).cast("binary"), 256)
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, F.left(digest, F.lit(40)))
                                 .otherwise(F.left(F.base64(F.unhex(digest)), F.lit(40))).alias("s"))


def ordinary_strings(documents: DataFrame) -> DataFrame:
    """Words of all documents in which no fixed pattern matches."""
    docs = documents.select("text").where(F.col("text").isNotNull())
    for kind in ("assign", "access", "hex"):
        docs = docs.where(~F.rlike("text", F.lit(KINDS[kind])))
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_-]{4,}"), F.lit(0))).alias("s"))


def log_ratios(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Table of ln P(b | a, random) - ln P(b | a, ordinary) by a * width + b, add-one-half smoothed."""
    width = len(ALPHABET) + 1
    tables = []
    for strings in (random, ordinary):
        seen = {(r["a"], r["b"]): r["n"] for r in _pairs(strings).collect()}
        total = [sum(seen.get((a, b), 0) for b in range(width)) for a in range(width)]
        tables.append([math.log((seen.get((a, b), 0) + 0.5) / (total[a] + 0.5 * width)) for a in range(width) for b in range(width)])
    return [round(x - y, 4) for x, y in zip(*tables, strict=True)]


def likelihood_ratio(string: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of the random against the ordinary model, in nats."""
    width = len(ALPHABET) + 1
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum"))

    def step(state, c):
        b = F.instr(F.lit(ALPHABET), c)
        return F.struct(b.alias("a"), (state["sum"] + F.get(ratios, state["a"] * width + b)).alias("sum"))

    return F.aggregate(F.filter(F.split(string, ""), lambda c: c != ""), start, step, lambda s: s["sum"])


def _named(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda h: F.struct(
        h["start"].alias("start"), F.lit(ORDER[kind]).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind")))


def _count(kind: str) -> Column:
    return F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("bigint")


def scan(documents: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with ``_found``: sorted array of (start, rank, end, kind) of all spans.

    A null text counts as empty and has no spans. A Markov span never overlaps a fixed one and holds
    a letter and a digit. Rows are scanned one by one: ties, repeated rows, extra columns and empty tables change nothing.
    """
    text = whole()
    out = documents
    for kind in KINDS:
        out = out.withColumn(f"_{kind}", _hits(text, KINDS[kind]))
    for kind in ("assign", "access", "hex"):
        out = out.withColumn(f"_{kind}", _kept(kind, F.col(f"_{kind}")))
    fixed = F.concat("_assign", "_access", "_hex")
    random = F.filter("_markov", lambda h: F.rlike(h["hit"], F.lit("[0-9]")) & F.rlike(h["hit"], F.lit("[A-Za-z]"))
                      & (likelihood_ratio(h["hit"], table) >= threshold))
    out = out.withColumn("_markov", F.when(F.size("_markov") > 0, random).otherwise(F.col("_markov")))
    out = out.withColumn("_markov", F.when((F.size("_markov") > 0) & (F.size(fixed) > 0), _free(F.col("_markov"), fixed)).otherwise(F.col("_markov")))
    named = [_named(kind) for kind in KINDS]
    return out.withColumn("_found", F.array_sort(F.concat(*named))).drop(*[f"_{kind}" for kind in KINDS])


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def train(documents: DataFrame) -> list[float]:
    return log_ratios(random_strings(documents.sparkSession), ordinary_strings(documents))


def find_secrets(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``n_<kind>``, ``base_sha256`` and ``spans`` to ``documents``; columns of these names, and of those that begin with an underscore and a kind, are replaced."""
    found = scan(documents, train(documents), threshold)
    base = F.filter("_found", lambda s: s["rank"] < ORDER["markov"])
    counts = {f"n_{kind}": _count(kind) for kind in KINDS}
    return found.withColumns({**counts, "base_sha256": F.sha2(span_list(base).cast("binary"), 256), "spans": span_list(F.col("_found"))}).drop("_found")


def redact(documents: DataFrame, mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with every span of ``text`` replaced by ``mark``; overlapping spans by one. A null text stays null.

    Where a text changes, ``n_chars`` does too. All other columns stay, whatever their names.
    """
    found = scan(boxed(documents, "text"), train(documents), threshold)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    part = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))

    def step(state, s):
        new = s["start"] >= state["at"]
        return F.struct(F.when(new, F.concat(state["out"], part(state["at"], s["start"]), F.lit(mark))).otherwise(state["out"]).alias("out"),
                        F.greatest(state["at"], s["end"]).alias("at"))

    rest = lambda s: F.concat(s["out"], part(s["at"], F.char_length("text").cast("bigint")))
    clean = F.when(F.size("_found") > 0, F.aggregate("_found", start, step, rest)).otherwise(F.col("text"))
    masked = {"text": clean}
    if "n_chars" in documents.columns:
        masked["n_chars"] = F.when(F.size("_found") > 0, F.char_length(clean).cast("bigint")).otherwise(F.col("_row").getField("n_chars"))
    return unboxed(found, documents.columns, **masked)
