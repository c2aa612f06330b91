"""Session logs: one JSON event per line, ``root/<project>/<session>.jsonl``."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import lexicons as lx
from turnwise.functions.text import head, strip, tail, unroll
from turnwise.operators.ordered import lookup

RAW_SCHEMA = "value STRING"


def session_columns(path: Column) -> dict[str, Column]:
    """Project: the last 40 characters of the folder. Session: the first 8 of the file name."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return {
        "file": plain,
        "project": tail(F.regexp_extract(plain, r"([^/]*)/[^/]*$", 1), 40),
        "session": head(F.regexp_extract(plain, r"([^/]*)\.jsonl$", 1), 8),
    }


def read_sessions(spark: SparkSession, root: str, project: str = "", since: str | None = None) -> DataFrame:
    """Lines of the logs with their order.

    ``seq`` is the start of the line's file block plus the line's place in the scan task. A task
    packs at most one block's length of bytes, so ``seq`` grows along the file and never repeats.
    """
    raw = spark.read.text(f"{root}/*/*.jsonl").select("value", "_metadata.*")
    folder = F.regexp_extract(F.url_decode(F.regexp_replace("file_path", r"\+", "%2B")), r"([^/]*)/[^/]*$", 1)
    raw = raw.where(folder.contains(project) & ~F.col("file_path").contains(lx.PRIVATE))
    if since is not None:
        raw = raw.where(F.col("file_modification_time") >= F.lit(since).cast("timestamp"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = raw.select("value", "file_path", (F.col("file_block_start") + place).alias("seq"))
    return parsed_lines(ordered)


def parsed_lines(rows: DataFrame) -> DataFrame:
    parsed = rows.withColumn("v", F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return parsed.select(
        *[c.alias(n) for n, c in session_columns(F.col("file_path")).items()], "seq", "value", "v",
        (F.col("v").isNull() | ~is_object).alias("bad"))


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def text_of(content: Column) -> Column:
    """A string as it is; of a list of blocks the text blocks, one per line."""
    blocks = get(content, "$", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: get(b, "$.type") == "text"), lambda b: F.coalesce(get(b, "$.text"), F.lit("")))
    plain = F.when(F.schema_of_variant(content) == "STRING", get(content, "$"))
    return F.coalesce(F.when(blocks.isNotNull(), F.array_join(texts, "\n")), plain, F.lit(""))


def tool_line(block: Column) -> Column:
    """Tool name and the first of its telling arguments."""
    args = [F.nullif(get(block, f"$.input.{k}"), F.lit("")) for k in ("command", "skill", "file_path", "description")]
    arg = F.coalesce(*args, F.lit(""))
    return strip(F.concat(F.coalesce(get(block, "$.name"), F.lit("None")), F.lit(" "), head(arg, lx.TOOL_CHARS)))


def skill_argument(block: Column) -> Column:
    raw = F.try_variant_get(block, "$.input.skill", "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", get(block, "$.input.skill"))


def events(raw: DataFrame) -> DataFrame:
    """The columns every log job reads, taken out of the JSON once.

    Sidechain events, other event types and unreadable lines are gone; ``calls`` and ``results``
    hold an event's tool calls and tool results in order.
    """
    good = raw.where(~F.col("bad")).where(~F.coalesce(get("v", "$.isSidechain", "boolean"), F.lit(False)))
    kind = get("v", "$.type")
    content = F.try_variant_get("v", "$.message.content", "variant")
    staged = good.select(
        "file", "project", "session", "seq", kind.alias("type"),
        get("v", "$.timestamp").alias("ts"), get("v", "$.entrypoint").alias("entrypoint"),
        get("v", "$.message.model").alias("model"), content.alias("content"),
        get("v", "$.message.content", "array<variant>").alias("blocks"),
    ).where(F.col("type").isin("assistant", "user"))
    uses = F.filter("blocks", lambda b: get(b, "$.type") == "tool_use")
    calls = F.transform(uses, lambda b: F.struct(
        get(b, "$.id").alias("id"), get(b, "$.name").alias("name"), tool_line(b).alias("line"),
        skill_argument(b).alias("skill"),
        F.to_json(F.try_variant_get(b, "$.input", "variant")).alias("input")))
    results = F.transform(
        F.filter("blocks", lambda b: get(b, "$.type") == "tool_result"),
        lambda b: F.struct(get(b, "$.tool_use_id").alias("id"),
                           text_of(F.try_variant_get(b, "$.content", "variant")).alias("text")))
    none_call = "array<struct<id:string,name:string,line:string,skill:string,input:string>>"
    none_result = "array<struct<id:string,text:string>>"
    return staged.select(
        "file", "project", "session", "seq", "type", "ts", "entrypoint", "model",
        text_of(F.col("content")).alias("said"),
        F.when(F.col("type") == "assistant", F.coalesce(calls, F.array().cast(none_call)))
        .otherwise(F.array().cast(none_call)).alias("calls"),
        F.when(F.col("type") == "user", F.coalesce(results, F.array().cast(none_result)))
        .otherwise(F.array().cast(none_result)).alias("results"))


def bad_lines(raw: DataFrame) -> DataFrame:
    """Unreadable lines, for a side table."""
    return raw.where("bad").select("file", "project", "session", "seq", "value")


def skip_headless(events_df: DataFrame, headless: str = lx.HEADLESS) -> DataFrame:
    """Without the sessions whose first event came from a headless run."""
    first = events_df.groupBy("file").agg(F.min_by(F.struct("entrypoint"), "seq").alias("first"))
    out = first.where(F.col("first.entrypoint") == headless).select("file")
    return lookup(events_df, out, ["file"], ["seq"], "left_anti")


def blocks_of(events_df: DataFrame) -> DataFrame:
    """One row per tool call or result with its place in the event."""
    call = unroll(events_df, ["file", "seq"], "calls", "b", "pos").select(
        "file", "seq", "pos", F.lit("call").alias("part"), "b.id", "b.name", "b.line", "b.skill", "b.input",
        F.lit(None).cast("string").alias("text"))
    none = F.lit(None).cast("string")
    result = unroll(events_df, ["file", "seq"], "results", "b", "pos").select(
        "file", "seq", "pos", F.lit("result").alias("part"), "b.id", none.alias("name"), none.alias("line"),
        none.alias("skill"), none.alias("input"), F.col("b.text").alias("text"))
    return call.unionByName(result)


def stream_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Rolled log files as a stream, with the columns of ``read_sessions``.

    A roll ``<session>.<n>.jsonl`` is closed before it is read and is as large as the writer lets
    it grow; it is one row until its lines are numbered. ``seq`` is the roll, then the line.
    """
    raw = spark.readStream.schema(RAW_SCHEMA).option("wholetext", True).option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "*.jsonl").format("text").load(root).select("value", F.col("_metadata.file_path").alias("file_path"))
    text = F.regexp_replace("value", r"\r?\n\z", "")
    rows = unroll(raw, ["file_path"], F.split(text, r"\r\n|\n|\r"), "value")
    roll = F.coalesce(F.regexp_extract("file_path", r"\.(\d+)\.jsonl$", 1).try_cast("bigint"), F.lit(0))
    return parsed_lines(rows.withColumn("seq", F.shiftleft(roll, 32) + F.col("_pos")))
