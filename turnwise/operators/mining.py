"""Turns, corrections and the skill that was active.

Input: the columns of ``sources.sessions.events`` (``file``, ``project``, ``session``, ``seq``,
``type``, ``said``, ``calls``, ``results``). One ordered scan per job carries every running state.
"""
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.text import first_group, head, present, shipped_name, skill_name, strip, tail, unroll, utf16_length
from turnwise.operators.ordered import carry, int_segment

PAGE_BITS = 27
# seq counts bytes of the log, so a segment is at most 64 MB of one file.
LOG_BITS = 26


# --- per-event columns --------------------------------------------------------------------------
def command_started(said: Column | str = "said") -> Column:
    return first_group(said, lx.COMMAND)


def user_text_filter(said: Column | str = "said", max_chars: int = lx.MAX_USER_CHARS, peer: str = lx.PEER) -> Column:
    said = F.col(said) if isinstance(said, str) else said
    return present(said) & ~said.startswith("<") & ~said.startswith(peer) & (F.length(said) <= max_chars)


def took_defaults(result: Column) -> Column:
    """Every answered part is a recommended one; without answers false."""
    parts = F.flatten(F.transform(F.regexp_extract_all(result, F.lit(lx.ANSWER), 1), lambda a: F.split(a, ", ")))
    return (F.size(parts) > 0) & F.forall(parts, lambda p: strip(p).endswith(lx.DEFAULT_ANSWER))


def is_rejected(result: Column) -> Column:
    return result.contains(lx.REFUSED) | F.lower(head(result, 200)).contains(lx.REJECTED)


def classify_reply(said: Column, before: Column, correction: str = lx.CORRECTION, asks: str = "?") -> Column:
    return (
        F.when(said.startswith(lx.HOOK), "HOOK")
        .when(said.contains(lx.INTERRUPT), "INTERRUPT")
        .when(said.rlike(correction) | F.coalesce(before, F.lit("")).contains(asks), "REPLY")
    )


def skill_started(shipped: Mapping[str, str] | None = None) -> Column:
    """The skill an event starts, null if it starts none.

    With ``shipped`` an unknown name gives '', which ends the running skill without starting one.
    """
    named = F.transform(
        F.filter("calls", lambda b: (b["name"] == lx.SKILL_TOOL) & b["skill"].isNotNull()), lambda b: b["skill"])
    raw = F.when(F.col("type") == "assistant", F.try_element_at(named, F.lit(-1))).when(
        F.col("type") == "user", command_started())
    if shipped is None:
        return F.when(raw.isNotNull(), skill_name(raw))
    return F.when(raw.isNotNull(), F.coalesce(shipped_name(raw, dict(shipped)), F.lit("")))


# --- running state ------------------------------------------------------------------------------
def with_state(events: DataFrame, *, shipped: Mapping[str, str] | None = None, peer: str = lx.PEER,
               max_chars: int = lx.MAX_USER_CHARS, before_chars: int = lx.BEFORE_CHARS) -> DataFrame:
    """Events with ``active_skill`` and ``before``.

    ``before`` is the last assistant text since the last user message that passed the filter. A
    message that passed sets it back to empty, a filtered one or a command leaves it.
    """
    is_user = F.col("type") == "user"
    command = is_user & command_started().isNotNull()
    kept = is_user & ~command & user_text_filter(max_chars=max_chars, peer=peer)
    marker = F.when((F.col("type") == "assistant") & present("said"), tail("said", before_chars)).when(kept, F.lit(""))
    staged = events.withColumns({"is_command": command, "kept": kept, "_marker": marker, "_skill": skill_started(shipped)})
    # Assistant text is only needed as the marker, so it does not travel through the shuffle.
    staged = staged.withColumn("said", F.when(is_user, F.col("said")))
    out = carry(staged.drop("calls"), ["file"], ["seq"], int_segment("seq", LOG_BITS),
                last={"active_skill": F.col("_skill")}, prior={"before": F.col("_marker")})
    return out.withColumns({
        "active_skill": F.nullif(F.col("active_skill"), F.lit("")),
        "before": F.coalesce("before", F.lit("")),
    }).drop("_marker", "_skill")


def active_skill(events: DataFrame, shipped: Mapping[str, str] | None = None) -> DataFrame:
    """Events with the latest skill started at or before them."""
    out = carry(events.withColumn("_skill", skill_started(shipped)), ["file"], ["seq"], int_segment("seq", LOG_BITS),
                last={"active_skill": F.col("_skill")})
    return out.withColumn("active_skill", F.nullif(F.col("active_skill"), F.lit(""))).drop("_skill")


def before_text(events: DataFrame, **options) -> DataFrame:
    return with_state(events, **options).where("kept").select("file", "project", "session", "seq", "before", "said")


# --- questions and answers ----------------------------------------------------------------------
def ask_answer(blocks: DataFrame) -> DataFrame:
    """Each tool result with the last earlier question of the same id in the same file."""
    asked = (F.col("part") == "call") & (F.col("name") == lx.ASK_TOOL)
    both = blocks.where((asked | (F.col("part") == "result")) & F.col("id").isNotNull()).select(
        "file", "id", "seq", "pos", "part", F.when(asked, head(F.coalesce("input", F.lit("{}")), lx.TURN_CHARS)).alias("_q"),
        "text")
    out = carry(both, ["file", "id"], ["seq", "pos"], int_segment("seq", LOG_BITS), prior={"question": F.col("_q")})
    return out.where((F.col("part") == "result") & F.col("question").isNotNull()).select(
        "file", "id", "seq", "pos", "question", F.col("text").alias("result"))


def call_result(blocks: DataFrame) -> DataFrame:
    """Each tool call with its result, by id; a call without one keeps nulls."""
    call = blocks.where("part = 'call'").select("file", "id", "seq", "pos", "name", "line")
    result = blocks.where("part = 'result'").groupBy("file", "id").agg(
        F.min_by(F.struct("seq", "text"), F.struct("seq", "pos")).alias("r"))
    return call.join(result, ["file", "id"], "left").select(
        "file", "id", "seq", "name", "line", F.col("r.seq").alias("result_seq"), F.col("r.text").alias("result"))


# --- exchanges ----------------------------------------------------------------------------------
EXCHANGE = ["file", "project", "session", "seq", "part", "pos", "kind", "active_skill", "before", "user"]


def reply_exchanges(state: DataFrame, correction: str = lx.CORRECTION, asks: str = "?") -> DataFrame:
    """HOOK, INTERRUPT and REPLY rows."""
    kind = classify_reply(F.col("said"), F.col("before"), correction, asks)
    return state.where("kept").withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "file", "project", "session", "seq", F.lit(1).alias("part"), F.lit(0).alias("pos"), "kind", "active_skill",
        "before", F.col("said").alias("user"))


def result_exchanges(state: DataFrame, asked: DataFrame) -> DataFrame:
    """ASK rows for answers that left the defaults, REJECTED rows for refused tools."""
    rows = unroll(state.where((F.col("type") == "user") & ~F.col("is_command")),
                  ["file", "project", "session", "seq", "active_skill", "before"], "results", "r", "pos")
    text = F.col("r.text")
    rows = rows.withColumns({"_default": took_defaults(text), "_no": is_rejected(text)}).where(~F.col("_default") | F.col("_no"))
    rows = rows.join(asked.select("file", "seq", "pos", "question"), ["file", "seq", "pos"], "left")
    is_ask = F.col("question").isNotNull()
    kind = F.when(is_ask & ~F.col("_default"), "ASK").when(~is_ask & F.col("_no"), "REJECTED")
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "file", "project", "session", "seq", F.lit(0).alias("part"), "pos", "kind", "active_skill",
        F.when(is_ask, F.col("question")).otherwise(F.col("before")).alias("before"),
        F.when(is_ask, head("r.text", lx.TURN_CHARS)).otherwise(head("r.text", lx.BEFORE_CHARS)).alias("user"))


def union_kinds(*kinds: DataFrame) -> DataFrame:
    """Exchanges of all kinds; (seq, part, pos) puts an event's results before its text."""
    out = kinds[0].select(EXCHANGE)
    for k in kinds[1:]:
        out = out.unionByName(k.select(EXCHANGE))
    return out


def skill_span_filter(exchanges: DataFrame, skill: str) -> DataFrame:
    name = skill.strip().lstrip("/").split(":")[-1]
    return exchanges.where(F.col("active_skill") == name)


def dedupe_exchanges(exchanges: DataFrame, keys=("project", "kind", "before", "user"),
                     order=("session", "seq", "part", "pos"), keep=("active_skill",)) -> DataFrame:
    """One row per key, the first in ``order``. Copies fold before the shuffle, so none pile up."""
    first = F.min(F.struct(*order, *keep)).alias("_first")
    return exchanges.groupBy(*keys).agg(first).select(*keys, "_first.*")


def mining_stats(raw: DataFrame, exchanges: DataFrame) -> DataFrame:
    files = raw.groupBy("file").agg(F.count_if("bad").alias("bad"))
    hits = exchanges.agg(F.count("*").alias("hits"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_lines")).select(
        "files", hits.scalar().alias("hits"), "bad_lines")


# --- turns --------------------------------------------------------------------------------------
def turn_id(events: DataFrame, peer: str = lx.PEER, keep=()) -> DataFrame:
    """Events with the number of their turn; events before the first prompt are dropped.

    A turn starts at every user text that is not blank and not from a peer session.
    """
    starts = (F.col("type") == "user") & present("said") & ~F.col("said").startswith(peer)
    staged = events.withColumn("starts", starts)
    out = carry(staged, ["file"], ["seq"], int_segment("seq", LOG_BITS), total={"turn_id": F.col("starts").cast("int")},
                last={"start_seq": F.when(F.col("starts"), F.col("seq"))})
    return out.where("turn_id > 0")


def turn_rollup(events: DataFrame, user_cap: int = lx.TURN_CHARS, text_cap: int = lx.BEFORE_CHARS,
                peer: str = lx.PEER) -> DataFrame:
    """One row per turn: the prompt, the tool lines in order and the last assistant text.

    A turn longer than 2^27 places in its file goes on in further rows with ``page`` 1, 2, ...,
    so no row collects without bound.
    """
    is_text = (F.col("type") == "assistant") & present("said")
    narrow = events.select(
        "file", "project", "session", "seq", "type",
        F.when(F.col("type") == "user", head("said", max(user_cap, len(peer))))
        .when(is_text, tail("said", text_cap)).alias("said"),
        F.transform("calls", lambda b: b["line"]).alias("lines"))
    page = F.shiftright(F.col("seq") - F.col("start_seq"), PAGE_BITS).cast("int")
    rows = turn_id(narrow, peer).withColumn("page", page)
    tools = F.flatten(F.transform(
        F.array_sort(F.collect_list(F.when(F.size("lines") > 0, F.struct("seq", "lines")))), lambda s: s["lines"]))
    return rows.groupBy("file", "project", "session", "turn_id", "page").agg(
        F.max(F.when(F.col("starts"), head("said", user_cap))).alias("user"),
        tools.alias("tools"),
        F.max_by(F.col("said"), F.when(is_text, F.col("seq"))).alias("claude"))


def turn_facts(events: DataFrame, flags: Mapping[str, Column], peer: str = lx.PEER) -> DataFrame:
    """One row per turn with the prompt, the last text and one boolean per flag.

    ``flags`` are boolean columns over an event (``calls``, ``said``); a turn has a flag if any of
    its events has it. Nothing is collected, so a turn may be of any length.
    """
    is_text = (F.col("type") == "assistant") & present("said")
    narrow = events.select(
        "file", "project", "session", "seq", "type", "said",
        F.size("calls").alias("n"), *[c.alias(n) for n, c in flags.items()])
    rows = turn_id(narrow, peer)
    return rows.groupBy("file", "project", "session", "turn_id").agg(
        F.min("seq").alias("seq"), F.max(F.when(F.col("starts"), F.col("said"))).alias("user"),
        F.coalesce(F.max_by(F.col("said"), F.when(is_text, F.col("seq"))), F.lit("")).alias("claude"),
        F.sum("n").alias("n_calls"), *[F.bool_or(n).alias(n) for n in flags])


def turn_calls(events: DataFrame, peer: str = lx.PEER) -> DataFrame:
    """One row per tool call with its turn."""
    rows = turn_id(events.select("file", "project", "session", "seq", "type", "said", "calls"), peer)
    return unroll(rows, ["file", "project", "session", "turn_id", "seq"], "calls", "b", "pos").select(
        "file", "project", "session", "turn_id", "seq", "pos", "b.name", "b.line")


def usage_by_model(events: DataFrame) -> DataFrame:
    """Assistant turns per model and their share."""
    per = events.where((F.col("type") == "assistant") & F.col("model").isNotNull()).groupBy("model").agg(
        F.count("*").alias("n"))
    whole = Window.partitionBy()
    return per.withColumn("share", F.col("n") / F.sum("n").over(whole))


# --- corrections per skill ----------------------------------------------------------------------
def corrections_by_skill(events: DataFrame, shipped: Mapping[str, str], correction: str = lx.CORRECTION) -> DataFrame:
    """Corrections per session and known skill.

    This counter differs from the exchanges on purpose: no ``?`` rule, no peer filter, a refused
    question counts, lengths are UTF-16 and hook feedback counts when the word list matches it.
    """
    is_user = (F.col("type") == "user") & command_started().isNull()
    said_hit = (present("said") & ~F.col("said").startswith("<") & (utf16_length("said") <= lx.MAX_USER_CHARS)
                & (F.col("said").contains(lx.INTERRUPT) | F.col("said").rlike(correction)))
    refused = F.size(F.filter("results", lambda r: is_rejected(r["text"])))
    staged = events.select("file", "project", "session", "seq", skill_started(shipped).alias("_skill"),
                           F.when(is_user, refused + said_hit.cast("int")).otherwise(0).alias("hits"))
    staged = staged.where((F.col("hits") > 0) | F.col("_skill").isNotNull())
    out = carry(staged, ["file"], ["seq"], int_segment("seq", LOG_BITS), last={"skill": F.col("_skill")})
    return out.where((F.col("hits") > 0) & (F.col("skill") != "")).groupBy("project", "session", "skill").agg(
        F.sum("hits").alias("n"))


def nudge_once(counts: DataFrame, announced: DataFrame) -> DataFrame:
    """Counts of (session, skill) pairs not announced before."""
    return counts.join(announced.select("session", "skill").distinct(), ["session", "skill"], "left_anti")
