"""A training corpus from raw documents, stage by stage.

Toxic documents go, one document of each group of near copies stays, secrets are masked, sources are
mixed to their targets, and the rest is packed into sequences. Each stage takes (spark, docs, sf_dir) and works on
all that the stage before it kept; all but the last return the columns of ``documents``.
"""
from pyspark.sql import DataFrame, SparkSession

from turnwise.lineage import new_folder
from turnwise.llm import jaccard_join, mixing, packing, secret_scan, toxicity
from turnwise.llm.common import boxed, table, unboxed

#: Models that are fitted and joins that are iterated have no SQL.
ORACLE_SQL = None
WIDTH, ALIKE, OF = 5, 80, 100  # near copies: words of a shingle, and linked from ALIKE / OF on


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of the kept documents, does not call toxic."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return unboxed(toxicity.scores(boxed(docs, "text"), model).where("predicted = 0"), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs, WIDTH, ALIKE, OF)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and its length counted anew."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole copies."""
    return mixing.copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packing.pack(docs).drop("row", "key")


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
