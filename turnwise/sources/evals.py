"""Evaluation files, run logs, motion samples and document trees."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.text import body, first_group, front_matter, header_map, strip

RUN_LOG = "time STRING, hypothesis STRING, change STRING, before STRING, after STRING, result STRING, evidence STRING"
MOTION = """
duration INT, easing STRING, key STRING, title STRING, measured STRING, samples ARRAY<STRUCT<t: DOUBLE, p: DOUBLE>>
"""


def _texts(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, root: str, kinds: dict[str, list[str]]) -> DataFrame:
    """Documents of each folder glob with the headings its kind must have.

    ``kinds``: glob below ``root`` to expected headings. Columns: doc, folder, expected, text.
    """
    out = None
    for glob, headings in kinds.items():
        part = _texts(spark, f"{root}/{glob}").select(
            F.col("path").alias("doc"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"),
            F.array(*[F.lit(h) for h in headings]).alias("expected"), "text")
        out = part if out is None else out.unionByName(part)
    return out


def read_graders(spark: SparkSession, root: str) -> DataFrame:
    """``root/<suite>/<case>/graders/<grader>.md`` with a header as one row each."""
    rows = _texts(spark, f"{root}/*/*/graders/*.md")
    where = r"([^/]+)/([^/]+)/graders/([^/]+)\.md$"
    meta = header_map(front_matter("text"))
    return rows.select(
        F.regexp_extract("path", where, 1).alias("suite"), F.regexp_extract("path", where, 2).alias("case"),
        F.regexp_extract("path", where, 3).alias("grader"), meta.alias("m"), strip(body("text")).alias("note")).select(
        "suite", "case", "grader", F.col("m")["type"].alias("type"), F.col("m")["tool"].alias("tool"),
        F.col("m")["input_match"].alias("input_match"), F.col("m")["min"].cast("int").alias("min"),
        F.col("m")["max"].cast("int").alias("max"), F.col("m")["pattern"].alias("pattern"),
        F.col("m")["match"].alias("match"), F.col("m")["target"].alias("target"), "note")


def read_eval_cases(spark: SparkSession, root: str) -> DataFrame:
    """Cases: prompt and the name of the scaffold script, if any."""
    where = r"([^/]+)/([^/]+)/[^/]+$"
    prompts = _texts(spark, f"{root}/*/*/prompt.md").select(
        F.regexp_extract("path", where, 1).alias("suite"), F.regexp_extract("path", where, 2).alias("case"),
        strip(body("text")).alias("prompt"))
    config = _texts(spark, f"{root}/*/*/case.yaml").select(
        F.regexp_extract("path", where, 1).alias("suite"), F.regexp_extract("path", where, 2).alias("case"),
        first_group("text", r"(?m)^\s*scaffold_script:\s*(\S+)").alias("scaffold"))
    return prompts.join(config, ["suite", "case"], "left")


def read_triggers(spark: SparkSession, glob: str) -> DataFrame:
    """Labelled queries; the skill is the folder above ``evals``."""
    return spark.read.schema("query STRING, should_trigger BOOLEAN").option("multiLine", True).json(glob).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/evals/[^/]+$", 1).alias("skill"), "query", "should_trigger")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated pass log; ``pass`` is the line order inside a file."""
    raw = spark.read.schema(RUN_LOG).csv(path, sep="\t", header=True)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select(F.col("_metadata.file_path").alias("run"), (F.col("_metadata.file_block_start") + place).alias("pass"), "*")


def read_motion(spark: SparkSession, glob: str) -> DataFrame:
    """Sample files as (motion, duration, easing, pos, t, p)."""
    raw = spark.read.schema(MOTION).option("multiLine", True).json(glob)
    return raw.select(F.col("_metadata.file_path").alias("motion"), "duration", "easing", F.posexplode("samples").alias("pos", "s")).select(
        "motion", "duration", "easing", "pos", F.col("s.t").alias("t"), F.col("s.p").alias("p"))
