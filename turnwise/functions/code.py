"""Source text to top-level blocks, by patterns over the whole text of a file.

Repeats are possessive: the pattern engine then loops over them instead of recursing, so long
files do not overflow its stack.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.text import col, strip, unified_lines

_QUOTED = r"(?:\"[^\"\n]*\"|'[^'\n]*')"
_END = r"[ \t]*;?[ \t]*"
# A statement may span lines; what follows its ';' on the same line is code and stays.
_SCRIPT_IMPORT = "|".join([
    rf"import[ \t]*{_QUOTED}{_END}",
    rf"export\s+(?:type\s+)?\{{[^}}]*+\}}(?!\s*from\s*[\"']){_END}",
    rf"export\s+(?:type\s+)?(?:\{{[^}}]*+\}}|\*(?:\s*as\s+[\w$]+)?)\s*from\s*{_QUOTED}{_END}",
    rf"import(?:\s+|(?=\{{))(?:type\s+)?[\w$*{{][^;=(]*?\bfrom\s*{_QUOTED}{_END}",
    r"import\s+(?:type\s+)?[\w$][^;{}\n]*+;[ \t]*",
])
SCRIPT_IMPORT = rf"(?m)^[ \t]*(?:{_SCRIPT_IMPORT})"
PYTHON_IMPORT = (
    r"(?m)^(?:from[ \t]+\S++[ \t]+import\b|import[ \t]+(?=\w))"
    r"(?:[^;\n\\(]++|\\\n|\\|\([^)]*+\))*+;?[ \t]*"
)
EXPORT = r"(?m)^export[ \t]+(?:default[ \t]+)?"


def _block_pattern(lead: str | None) -> str:
    rest = r"(?:\n[\s})\]][^\n]*+)*+"  # indented lines and closers under the first line
    if lead is None:
        return rf"(?m)(?:\A[\s}})\]]|^[^\s}})\]])[^\n]*+{rest}"
    leads = rf"(?:^(?:{lead})[^\n]*+{rest}(?:\n|\z))*+"
    start = rf"^(?!{lead})[^\s}})\]][^\n]*+{rest}"
    return rf"(?m)(?:\A[\s}})\]][^\n]*+{rest}|{leads}{start}|^(?:{lead})[^\n]*+{rest}(?:\n(?:{lead})[^\n]*+{rest})*+)"


SCRIPT_BLOCK = _block_pattern("@|//|/\\*")
PYTHON_BLOCK = _block_pattern("@|#")
PLAIN_BLOCK = _block_pattern(None)


def strip_imports(path: Column | str, text: Column | str) -> Column:
    """The text without its import and re-export statements and without ``export`` in front of declarations."""
    path, text = col(path), unified_lines(text)
    script = F.regexp_replace(F.regexp_replace(text, SCRIPT_IMPORT, ""), EXPORT, "")
    python = F.regexp_replace(text, PYTHON_IMPORT, "")
    return F.when(path.rlike(lx.SCRIPT_FILE), script).when(path.rlike(lx.PYTHON_FILE), python).otherwise(text)


def tidy_lines(code: Column | str) -> Column:
    """Lines without white space at their end, and no blank lines; most texts pass the tests untouched."""
    c = col(code)
    loose = F.lit(False)
    for space in " \t\x0b\f":
        loose = loose | c.contains(space + "\n")
    c = F.rtrim(F.when(loose, F.regexp_replace(c, r"[ \t\x0B\f]+\n", "\n")).otherwise(c), F.lit(" \t\x0b\f\n"))
    c = F.ltrim(c, F.lit("\n"))
    return F.when(c.contains("\n\n"), F.regexp_replace(c, r"\n{2,}", "\n")).otherwise(c)


def cut_blocks(path: Column | str, tidy: Column | str) -> Column:
    """Top-level blocks of a tidy text: a line at column 0, the lines under it, and the comments or decorators before it."""
    path, tidy = col(path), col(tidy)
    cut = lambda pattern: F.regexp_extract_all(tidy, F.lit(pattern), 0)
    blocks = F.when(path.rlike(lx.SCRIPT_FILE), cut(SCRIPT_BLOCK)).when(path.rlike(lx.PYTHON_FILE), cut(PYTHON_BLOCK)).otherwise(
        cut(PLAIN_BLOCK))
    return F.filter(F.transform(blocks, lambda b: F.rtrim(b, F.lit("\n"))), lambda b: b != "")


def first_lost_line(head: Column, new: Column) -> Column:
    """The first non-blank line of ``head`` that does not follow, in order, in ``new``; null if all do.

    One fold over the lines of ``new`` moves the place of the next line to find on at each match, so the
    work grows with the longer of the texts.
    """
    kept = F.filter(F.split(head, r"\r?\n"), lambda s: strip(s) != "")
    found = lambda k: F.get(F.transform(F.array(k), lambda lines: F.get(lines, F.aggregate(
        F.split(new, r"\r?\n"), F.lit(0), lambda at, line: at + F.when(line == F.get(lines, at), 1).otherwise(0)))), 0)
    return F.when(head == new, F.lit(None).cast("string")).otherwise(found(kept))
