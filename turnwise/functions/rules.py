"""Rule lists applied to a text column in the row itself, without a join."""
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import col


def any_match(c: Column | str, patterns: Sequence[str]) -> Column:
    c = col(c)
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def hit_counts(c: Column | str, rules: Mapping[object, str]) -> Column:
    """Array of (rule, hits) for the rules that match at least once."""
    c = col(c)
    counts = F.array(*[F.struct(F.lit(r).alias("rule"), F.regexp_count(c, F.lit(p)).alias("hits")) for r, p in rules.items()])
    return F.filter(counts, lambda s: s["hits"] > 0)


def matching(c: Column | str, rules: Mapping[str, str]) -> Column:
    """Names of the rules that match, in order."""
    c = col(c)
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(r)) for r, p in rules.items()]))


def first_matching(c: Column | str, rules: Mapping[str, str]) -> Column:
    c = col(c)
    return F.coalesce(*[F.when(c.rlike(p), F.lit(r)) for r, p in rules.items()])


def hex_reference(c: Column | str, pattern: str) -> Column:
    """A run of hex digits that holds both a digit and a letter."""
    return F.exists(F.regexp_extract_all(col(c), F.lit(pattern), 0), lambda h: h.rlike("[0-9]") & h.rlike("[a-f]"))
