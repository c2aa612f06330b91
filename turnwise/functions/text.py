"""Text columns."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, the Unicode kinds included.
SPACE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
RARE_BREAKS = "\r\f\x0b\x1c\x1d\x1e\x85\u2028\u2029"
SENTENCE_MARK = "\u001f"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACE))


def present(c: Column | str) -> Column:
    """True for text with something other than white space; false for null."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def unroll(df: DataFrame, keep: Sequence[Column | str], array: Column | str, name: str, pos: str = "_pos") -> DataFrame:
    """One row per element of an array, with its place.

    A plain explode makes the optimizer work the array out again in a filter on its size, so costly
    arrays take the outer form and drop its empty rows.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())


def head(c: Column | str, n: int) -> Column:
    return F.left(col(c), F.lit(n))


def tail(c: Column | str, n: int) -> Column:
    return F.right(col(c), F.lit(n))


def first_group(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def skill_name(raw: Column | str) -> Column:
    """``/plugin:name`` to ``name``."""
    return F.element_at(F.split(F.ltrim(strip(raw), F.lit("/")), ":"), -1)


def shipped_name(raw: Column | str, shipped: dict[str, str]) -> Column:
    """The name if it is in ``shipped`` (name to owner) and carries no other owner's prefix."""
    parts = F.split(F.regexp_replace(strip(raw), "^/", ""), ":")
    name = F.element_at(parts, -1)
    if not shipped:
        return F.lit(None).cast("string")
    owners = F.create_map(*[F.lit(x) for pair in shipped.items() for x in pair])
    owner = F.try_element_at(owners, name)
    return F.when(owner.isNotNull() & ((F.size(parts) == 1) | (parts[0] == owner)), name)


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def unified_lines(c: Column | str) -> Column:
    """Every kind of line break as a line feed; texts without the rare kinds pass untouched."""
    c = col(c)
    rare = F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), RARE_BREAKS, "\n" * len(RARE_BREAKS))
    has_rare = F.lit(False)
    for b in RARE_BREAKS:
        has_rare = has_rare | c.contains(b)
    return F.when(has_rare, rare).otherwise(c)


def lines(c: Column | str, every_break: bool = True) -> Column:
    """Lines of a text. With ``every_break`` a final break opens no further line and empty text has none."""
    if not every_break:
        return F.split(col(c), "\n")
    text = unified_lines(c)
    cut = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(F.length(col(c)) == 0, F.array().cast("array<string>")).otherwise(F.split(cut, "\n"))


def sentences(c: Column | str) -> Column:
    """Cut after ``.``, ``!`` or ``?`` and white space."""
    marked = F.regexp_replace(strip(c), f"([.!?])[{SPACE}]+", f"$1{SENTENCE_MARK}")
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: s != "")


def word_count(c: Column | str) -> Column:
    """Words, a code span counting as one word and a link as its text."""
    c = col(c)
    text = F.when(c.contains("`"), F.regexp_replace(c, r"`[^`]*`", "CODE")).otherwise(c)
    text = F.when(text.contains("]("), F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")).otherwise(text)
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def words(c: Column | str, min_chars: int = 1) -> Column:
    """Distinct lower-case words."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= min_chars))


def flat(c: Column | str) -> Column:
    """Markdown text without its marks, on one line."""
    text = F.regexp_replace(col(c), r"(?m)^\s*(#+|[-*>]|\d+\.)\s+", "")
    text = F.regexp_replace(text, r"[*_`]", "")
    return strip(F.regexp_replace(text, r"\s+", " "))


def clip(c: Column | str, n: int, mark: str = "...") -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(head(c, n), F.lit(mark))).otherwise(c)


def short_id(c: Column | str) -> Column:
    """A UUID to its first eight characters."""
    c = col(c)
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return F.when(c.rlike(uuid), F.concat(head(c, 8), F.lit("…"))).otherwise(c)


def split_words(c: Column | str) -> Column:
    """Words of a snake, kebab, dotted or camel case name."""
    spaced = F.regexp_replace(col(c), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.split(F.lower(spaced), r"[_\-.]+")


def short_count(c: Column | str) -> Column:
    """A count as 950, 12k or 3M, cut off, not rounded."""
    c = col(c).cast("bigint")
    return (
        F.when(c >= 1_000_000, F.concat(F.floor(c / 1_000_000).cast("string"), F.lit("M")))
        .when(c >= 1_000, F.concat(F.floor(c / 1_000).cast("string"), F.lit("k")))
        .otherwise(c.cast("string"))
    )


def duration_text(seconds: Column | str) -> Column:
    """Seconds as 3h05m, or 12m under an hour."""
    s = col(seconds).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), F.lpad(m.cast("string"), 2, "0"), F.lit("m"))).otherwise(
        F.concat(m.cast("string"), F.lit("m")))


def front_matter(c: Column | str) -> Column:
    """The lines between a leading pair of ``---`` lines, null without them."""
    return first_group(c, r"\A---\n([\s\S]*?)\n---(?:\n|\z)")


def body(c: Column | str) -> Column:
    """The text after its front matter."""
    return F.regexp_replace(col(c), r"\A---\n[\s\S]*?\n---\n?", "")


def header_map(block: Column | str) -> Column:
    """``key: value`` lines as a map; one pair of quotes around a value is dropped."""
    rows = F.filter(F.split(col(block), "\n"), lambda s: s.rlike(r"^[\w-]+:"))
    pairs = F.transform(rows, lambda s: F.struct(
        F.regexp_extract(s, r"^([\w-]+):", 1).alias("k"),
        F.regexp_replace(F.regexp_extract(s, r"^[\w-]+:\s*(.*?)\s*$", 1), r"^(['\"])([\s\S]*)\1$", "$2").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(
        k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v"))))
