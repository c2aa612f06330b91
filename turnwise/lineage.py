"""Lineage cuts that survive the loss of an executor."""
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # folders of stored tables


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor can read.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
            folder = tempfile.mkdtemp(prefix="turnwise-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there."""
    shared_folder(df.sparkSession)
    with _freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # the setting holds for plans that are made under it


def stored(df: DataFrame) -> DataFrame:
    """Write a wide table to the shared folder as Parquet; later scans read only the columns they need."""
    path = new_folder(df.sparkSession, "table")
    with _freed(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[table] = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, neither later nor to make lost rows anew."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_places.pop(table))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
