"""Tool calls and paths, judged in the row."""
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.rules import any_match
from turnwise.functions.text import present, split_words, strip

_WHOLE_QUOTE = r"'[^']*+'|\"(?:[^\"\\]++|\\[\s\S])*+\""
_SHELL_TOKEN = rf"{_WHOLE_QUOTE}|\\[\s\S]|['\"][\s\S]*+|[^'\"\\]++|\\"
_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?'


def one_of(c: Column, values: Sequence[str]) -> Column:
    return c.isin(list(values))


# --- modes --------------------------------------------------------------------------------------
def mode_rank(name: Column) -> Column:
    """Place of a mode on the ladder, strictest 0; null for an unknown name."""
    place = F.array_position(F.array(*[F.lit(m) for m in lx.MODES]), F.lower(strip(name))).cast("int") - 1
    return F.when(place >= 0, place)


def mode_name(rank: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(m) for m in lx.MODES]), (rank + 1).cast("int"))


READONLY, RESEARCH, PROTOTYPE, BUILD, OFF = range(len(lx.MODES))


def mask_quotes(command: Column) -> Column:
    """``>`` inside quotes or after a backslash becomes ``_``; an unclosed quote masks nothing after it."""
    tokens = F.regexp_extract_all(command, F.lit(f"({_SHELL_TOKEN})"), 1)
    masked = lambda t: t.rlike(rf"\A(?:{_WHOLE_QUOTE}|\\[\s\S])\z")
    return F.array_join(F.transform(tokens, lambda t: F.when(masked(t), F.replace(t, F.lit(">"), F.lit("_"))).otherwise(t)), "")


def command_parts(command: Column) -> Column:
    joined = F.replace(F.coalesce(command, F.lit("")), F.lit("\\\n"), F.lit(" "))
    return F.split(mask_quotes(joined), lx.PART_SPLIT)


def part_need(part: Column) -> Column:
    pulls = part.rlike(lx.API_CALL) & part.rlike(lx.PULLS) & part.rlike(lx.API_WRITE) & ~part.rlike(lx.API_GET)
    targets = F.regexp_extract_all(F.regexp_replace(part, lx.HARMLESS_REDIRECT, ""), F.lit(lx.REDIRECT_TARGET), 1)
    return (
        F.when(part.rlike(lx.PUBLISH) | pulls, OFF)
        .when(F.exists(targets, lambda t: ~t.rlike(lx.PLAN_FILE) & ~t.rlike(lx.WORK_FILE)), BUILD)
        .when(F.exists(targets, lambda t: ~t.rlike(lx.PLAN_FILE)), PROTOTYPE)
        .when((F.size(targets) > 0) | part.rlike(lx.COMMIT) | part.rlike(lx.TRACKER_CLI), RESEARCH)
        .otherwise(READONLY))


def strictest_need(command: Column) -> Column:
    """The highest mode any part of a shell command needs."""
    return F.array_max(F.transform(command_parts(command), part_need))


def mcp_need(tool: Column, host_tools: str = lx.HOST_TOOLS) -> Column:
    name = F.regexp_extract(tool, r"^mcp__.+?__(.+)$", 1)
    words = split_words(name)
    writes = F.exists(words, lambda w: one_of(w, lx.WRITE_VERBS))
    has = lambda w: F.array_contains(words, w)
    return (
        F.when((name == "") | tool.rlike(host_tools), READONLY)
        .when(has("push") | (writes & has("pull") & has("request")), OFF)
        .when(writes, RESEARCH).otherwise(READONLY))


def required_mode(tool: Column, command: Column, path: Column, action: Column) -> Column:
    """Rank of the least mode a call needs."""
    path, action = F.coalesce(path, F.lit("")), F.coalesce(action, F.lit(""))
    edit = F.when(path.rlike(lx.PLAN_FILE), RESEARCH).when(path.rlike(lx.WORK_FILE), PROTOTYPE).otherwise(BUILD)
    return (
        F.when(one_of(tool, lx.EDIT_TOOLS), edit)
        .when(tool == "Artifact", F.when(one_of(action, lx.ARTIFACT_READS), READONLY).otherwise(RESEARCH))
        .when(tool == "Bash", strictest_need(command))
        .otherwise(mcp_need(tool)))


# --- tracker gate -------------------------------------------------------------------------------
def minutes_of(clock: str) -> int | None:
    m = re.match(lx.MINUTES, clock or "")
    return int(m[1]) * 60 + int(m[2]) if m else None


def in_shift(ts: Column, start: str = lx.SHIFT_START, end: str = lx.SHIFT_END, zone: str = "UTC") -> Column:
    """Minute of the day in [start, end), over midnight if start is later; a bad pair means 09:00 to 18:00."""
    a, b = minutes_of(start), minutes_of(end)
    if a is None or b is None:
        a, b = minutes_of(lx.SHIFT_START), minutes_of(lx.SHIFT_END)
    local = F.from_utc_timestamp(ts, zone)
    now = F.hour(local) * 60 + F.minute(local)
    return (now >= a) & (now < b) if a <= b else (now >= a) | (now < b)


def tracker_write(tool: Column, server: str = lx.TRACKER_SERVER) -> Column:
    """The tracker operation of a tool name if it writes, else null."""
    pattern = r"^mcp__(.+?)__(.+)$"
    name, owner = F.regexp_extract(tool, pattern, 2), F.regexp_extract(tool, pattern, 1)
    known = one_of(name, lx.TRACKER_WRITES) | ((owner == server) & name.rlike(lx.TRACKER_SERVER_WRITE))
    return F.when(known, name)


def is_drastic(name: Column, state: Column) -> Column:
    return name.rlike(lx.DRASTIC_NAME) | F.coalesce(one_of(F.lower(state), lx.CANCEL_STATES), F.lit(False))


def gate_verdict(tool: Column, ts: Column, state: Column, has_surface: Column, on_shift: str = "drastic",
                 start: str = lx.SHIFT_START, end: str = lx.SHIFT_END, zone: str = "UTC") -> Column:
    """deny off shift, ask where a person must decide, else pass."""
    if on_shift not in ("host", "drastic", "ask"):
        on_shift = "drastic"
    name = tracker_write(tool)
    free = F.lit(True) if on_shift == "host" else (~is_drastic(name, state) if on_shift == "drastic" else F.lit(False))
    return F.when(name.isNull(), "pass").when(~in_shift(ts, start, end, zone), "deny").when(free | ~has_surface, "pass").otherwise("ask")


def call_failed(is_error: Column, text: Column) -> Column:
    return F.coalesce(is_error, F.lit(False)) | F.coalesce(text.rlike(lx.CALL_FAILED), F.lit(False))


# --- hook rules ---------------------------------------------------------------------------------
def hook_override(code: Column, out: Column) -> Column:
    """'denies' or 'approves' if a hook's answer overrides the host, else null."""
    v = F.try_parse_json(out)
    decision = F.try_variant_get(v, "$.hookSpecificOutput.permissionDecision", "string")
    block = F.try_variant_get(v, "$.decision", "string")
    return F.when(code == 2, "denies").when((decision == "deny") | (block == "block"), "denies").when(decision == "allow", "approves")


def payload_strings(payload: Column) -> Column:
    """All string values of a JSON text at any depth, keys left out."""
    tokens = F.regexp_extract_all(payload, F.lit(f"({_JSON_STRING})"), 1)
    values = F.filter(tokens, lambda t: t.endswith('"'))
    return F.transform(values, lambda t: F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0])


def banned_payload_text(payload: Column, terms: str = lx.PAYLOAD_TERMS) -> Column:
    """The first banned text in any string of the input, null without one."""
    joined = F.array_join(payload_strings(payload), "\n")
    return F.when(joined.rlike(terms), F.regexp_extract(joined, f"({terms})" if not terms.startswith("(?i)") else f"(?i)({terms[4:]})", 1))


def model_problem(prompt: Column, model: Column, effort: Column) -> Column:
    """Why a started thread or agent is refused."""
    return F.when(F.coalesce(model, F.lit("")).contains(lx.LARGE_WINDOW), "large window").when(
        present(prompt) & (~present(model) | ~present(effort)), "no model or effort")


# --- paths --------------------------------------------------------------------------------------
def segments(path: Column) -> Column:
    return F.split(path, "/")


def resolve_path(path: Column, cwd: Column) -> Column:
    """Absolute path without '.', '..' and empty segments."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(cwd, F.lit("/"), path))
    kept = F.filter(segments(whole), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(kept, empty, lambda acc, s: F.when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def working_file_reason(rel: Column) -> Column:
    """The first rule by which a new file is a working file, null for none."""
    parts = segments(rel)
    base = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    stem = F.lower(F.regexp_replace(base, r"\.[^.]*$", ""))
    tests = [
        F.exists(folders, lambda s: one_of(s, lx.WORK_FOLDER_NAMES) | s.startswith(lx.WORK_FOLDER_PREFIX) | s.endswith(lx.WORK_FOLDER_SUFFIX)),
        rel.rlike(lx.REPORT_FOLDERS),
        F.exists(folders, lambda s: one_of(s, lx.ARTIFACT_FOLDERS)),
        (F.size(folders) == 0) & base.rlike(lx.LOOSE_DOC) & ~one_of(stem, lx.ROOT_DOCS),
        any_match(base, lx.REPORT_NAMES),
        base.rlike(lx.PROBE_NAMES),
    ]
    found = F.coalesce(*[F.when(t, F.lit(why)) for t, why in zip(tests, lx.PATH_REASONS)])
    return F.when(~one_of(parts[0], lx.TOOL_FOLDERS), found)


def glob_pattern(glob: Column) -> Column:
    """``**/``, ``**`` and ``*`` as a regular expression over a whole path."""
    quoted = F.regexp_replace(glob, r"([.+?^${}()|\[\]\\])", r"\\$1")
    marked = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02"))
    plain = F.replace(marked, F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit(r"\A"), F.replace(F.replace(plain, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*")), F.lit(r"\z"))


def path_allowed(rel: Column, allow: Column) -> Column:
    """True if a prefix (ends in '/') or a glob of the list covers the path."""
    return F.coalesce(F.exists(allow, lambda a: F.when(a.endswith("/"), rel.startswith(a)).otherwise(F.regexp_like(rel, glob_pattern(a)))), F.lit(False))


def migration_path(path: Column) -> Column:
    return path.rlike(lx.MIGRATION)


def prefixes(path: Column) -> Column:
    """Every folder above a path and the path itself, without a trailing slash."""
    parts = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
