"""Prose checks over a table of documents (``doc``, ``text`` and any further columns).

A document is one row, so lines, fences and sentences are worked out inside the row; nothing is
shuffled until hits are counted.
"""
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.rules import any_match, hex_reference, hit_counts
from turnwise.functions.text import body, lines, present, sentences, strip, unroll, word_count


def fence_state(docs: DataFrame, every_break: bool = True) -> DataFrame:
    """One row per line with ``line_no``, ``line``, ``is_fence`` and ``in_fence``.

    A fence line toggles the state and is itself outside the prose.
    """
    rows = docs.withColumn("_lines", lines("text", every_break))
    marks = F.filter(
        F.transform("_lines", lambda s, i: F.when(F.ltrim(s, F.lit(" \t\n\r\f\x0b")).startswith("```"), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("_marks", F.when(F.col("text").contains("```"), marks).otherwise(F.array().cast("array<int>")))
    rest = [c for c in docs.columns if c != "text"]
    out = unroll(rows, [*rest, "_marks"], "_lines", "line")
    no = F.col("_pos") + 1
    return out.select(
        *rest, no.alias("line_no"), "line", F.array_contains("_marks", no).alias("is_fence"),
        (F.size(F.filter("_marks", lambda m: m < no)) % 2 == 1).alias("in_fence"))


def prose_lines(docs: DataFrame, max_words: int = lx.MAX_WORDS, max_step_words: int = lx.MAX_STEP_WORDS) -> DataFrame:
    """Pieces of prose with their word limit: table cells, numbered steps and plain lines."""
    rest = [c for c in docs.columns if c != "text"]
    rows = fence_state(docs).where(
        ~F.col("is_fence") & ~F.col("in_fence") & ~F.col("line").startswith("#") & present("line"))
    is_table = F.ltrim(F.col("line"), F.lit(" \t\f\x0b")).startswith("|")
    rows = rows.where(~(is_table & F.col("line").rlike(r"\A\s*\|[\s|:-]*\z")))
    step = r"\A\s*\d+\.\s+(.*)"
    is_step = ~is_table & F.col("line").rlike(step)
    cells = F.split(F.btrim(strip("line"), F.lit("|")), r"\|")
    piece = F.when(is_table, cells).when(is_step, F.array(F.regexp_extract("line", step, 1))).otherwise(F.array("line"))
    kind = F.when(is_table, "cell").when(is_step, "step").otherwise("line")
    limit = F.when(is_step, max_step_words).otherwise(max_words)
    return unroll(rows, [*rest, "line_no", kind.alias("kind"), limit.alias("limit")], piece, "text", "part")


def long_sentences(docs: DataFrame, max_words: int = lx.MAX_WORDS, max_step_words: int = lx.MAX_STEP_WORDS) -> DataFrame:
    """Sentences over their word limit."""
    rest = [c for c in docs.columns if c != "text"]
    pieces = prose_lines(docs, max_words, max_step_words)
    rows = unroll(pieces, [*rest, "line_no", "kind", "limit", "part"], sentences("text"), "sentence", "pos")
    return rows.withColumn("words", word_count("sentence")).where(F.col("words") > F.col("limit"))


def banned_terms(docs: DataFrame, lexicon: str = lx.BANNED) -> DataFrame:
    """Every banned match outside fences, code spans and link targets."""
    rest = [c for c in docs.columns if c != "text"]
    rows = fence_state(docs).where(~F.col("is_fence") & ~F.col("in_fence"))
    seen = F.regexp_replace(F.regexp_replace("line", r"`[^`]*`", " "), r"\]\([^)]*\)", "]")
    return unroll(rows, [*rest, "line_no"], F.regexp_extract_all(seen, F.lit(lexicon), 0), "term", "pos")


def heading_schema(docs: DataFrame, name: Column, expected: Column, max_lines: int = lx.MAX_LINES) -> DataFrame:
    """Documents whose title, second-level headings or length break the schema; one row per rule."""
    rest = [c for c in docs.columns if c != "text"]
    all_lines = lines("text")
    rows = docs.withColumn("_lines", all_lines).withColumn(
        "_found", F.transform(F.filter("_lines", lambda s: s.startswith("## ")), lambda s: strip(F.substr(s, F.lit(4)))))
    title_ok = F.coalesce(F.try_element_at("_lines", F.lit(1)) == F.concat(F.lit("# "), name), F.lit(False))
    broken = F.array_compact(F.array(
        F.when(~title_ok, "title"),
        F.when(F.col("_found") != expected, "headings"),
        F.when(F.size("_lines") > max_lines, "length")))
    keep = [*rest, F.size("_lines").alias("n_lines"), F.array_join("_found", "|").alias("found")]
    return unroll(rows, keep, broken, "rule").drop("_pos")


def tell_catalogue(docs: DataFrame, rules: Mapping[object, str] | None = None) -> DataFrame:
    """Rule hits per document."""
    rest = [c for c in docs.columns if c != "text"]
    hits = unroll(docs, rest, hit_counts("text", rules or lx.TELLS), "h")
    return hits.select(*rest, "h.rule", "h.hits")


def doc_limits(docs: DataFrame, imperative: str, max_words: int = lx.MAX_WORDS, max_step_words: int = lx.MAX_STEP_WORDS,
               max_sentences: int = lx.MAX_PARAGRAPH) -> DataFrame:
    """Instruction and other sentences over their limits, and paragraphs of too many sentences.

    ``imperative`` is the pattern that makes a sentence an instruction.
    """
    rest = [c for c in docs.columns if c != "text"]
    blank = r"(?:\r?\n[ \t]*){2,}"
    paras = unroll(docs, rest, F.filter(F.split("text", blank), lambda p: present(p)), "_p", "para")
    paras = paras.withColumn("_s", sentences(F.regexp_replace("_p", r"\s*\r?\n\s*", " ")))
    limit = F.when(F.col("sentence").rlike(imperative), max_step_words).otherwise(max_words)
    long = unroll(paras, [*rest, "para"], "_s", "sentence", "pos").withColumns(
        {"n": word_count("sentence"), "limit": limit}).where("n > limit")
    rule = F.when(F.col("limit") == max_step_words, "instruction").otherwise("sentence")
    wide = paras.where(F.size("_s") > max_sentences).select(
        *rest, "para", F.lit(-1).alias("pos"), F.lit("paragraph").alias("rule"), F.size("_s").alias("n"))
    return long.select(*rest, "para", "pos", rule.alias("rule"), "n").unionByName(wide)


def lexical_stats(docs: DataFrame, group: Sequence[str] = ("lang", "source"), rules: Mapping[object, str] | None = None) -> DataFrame:
    """Hits per 1,000 words by rule, with a cube over the groups; ``level`` has a bit for each group summed over, so a null group is no total.

    Hits and words fold to one row per group and rule before the cube spreads them.
    """
    rules = rules or lx.TELLS
    counted = docs.select(*group, word_count("text").cast("bigint").alias("n"),
                          *[F.regexp_count("text", F.lit(p)).cast("bigint").alias(f"r{i}") for i, p in enumerate(rules.values())])
    base = counted.groupBy(*group).agg(F.sum("n").alias("n"), *[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(rules))])
    cube = base.cube(*group).agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("words"), *[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(rules))])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("hits")) for i, r in enumerate(rules)])
    out = cube.select(*group, "level", "words", F.explode(pairs).alias("h")).select(*group, "level", "h.rule", "h.hits", "words")
    return out.withColumn("per_1000", F.when(F.col("words") > 0, F.col("hits") * 1000 / F.col("words")))


def rule_hit_profile(hits: DataFrame, by: Sequence[str] = ("source", "rule")) -> DataFrame:
    """Hits per group with subtotals and a grand total; ``level`` has a bit for each column summed over, so a null group is no total."""
    base = hits.groupBy(*by).agg(F.sum("hits").alias("hits"), F.count("*").alias("docs"))
    return base.rollup(*by).agg(F.grouping_id().cast("int").alias("level"), F.sum("hits").alias("hits"), F.sum("docs").alias("docs"))


# --- notes --------------------------------------------------------------------------------------
def is_note_path(path: Column, folder: str = "", home: str = "") -> Column:
    inside = path.rlike(lx.NOTE_FOLDER)
    folder = folder.strip()
    if folder:
        folder = folder if folder.endswith("/") else folder + "/"
        inside = inside | path.startswith(f"{home}/{folder[2:]}" if folder.startswith("~/") else folder)
    return path.endswith(".md") & inside


def note_reasons(text: Column, path: Column, whole: Column, rules: Mapping[str, Sequence[str]] | None = None,
                 hex_rule: str | None = lx.HEX_RULE, hex_pattern: str = lx.HEX, max_topic: int = lx.MAX_TOPIC,
                 max_line: int = lx.MAX_INDEX_LINE) -> Column:
    """Names of the rules a note breaks."""
    found = []
    for name, patterns in (rules or lx.NOTE_RULES).items():
        hit = any_match(text, patterns)
        if name == hex_rule:
            hit = hit | hex_reference(text, hex_pattern)
        found.append(F.when(hit, F.lit(name)))
    units = lambda c: F.octet_length(F.encode(c, "UTF-16BE")) / 2
    index = path.rlike(lx.NOTE_INDEX)
    found.append(F.when(index & F.exists(F.split(text, "\n"), lambda s: units(s) > max_line), F.lit("index line")))
    found.append(F.when(~index & whole & (units(text) > max_topic), F.lit("topic length")))
    return F.array_compact(F.array(*found))


def added_text(old: Column, new: Column) -> Column:
    """Lines of ``new`` whose text is not among the lines of ``old``."""
    before = F.split(old, "\n")
    return F.array_join(F.filter(F.split(new, "\n"), lambda s: ~F.array_contains(before, s)), "\n")


def note_rules(notes: DataFrame, **options) -> DataFrame:
    """One row per broken rule. ``notes``: path, old, new, whole; an edit is judged by its added lines."""
    text = F.when(F.col("whole"), body("new")).otherwise(added_text(F.coalesce("old", F.lit("")), F.col("new")))
    rows = notes.withColumn("_text", text)
    rest = [c for c in notes.columns if c not in ("old", "new", "whole")]
    return unroll(rows, rest, note_reasons(F.col("_text"), F.col("path"), F.col("whole"), **options), "rule").drop("_pos")


def instruction_size(files: DataFrame, limit: int = lx.INSTRUCTION_LIMIT) -> DataFrame:
    """Characters of the always-loaded files per root."""
    return files.groupBy("root").agg(F.sum(F.length("text")).alias("chars")).withColumn("over", F.col("chars") > limit)
