"""Size checks before a side of a join is broadcast, and the folder that the cluster shares."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 200_000


def small(df: DataFrame, limit: int = LIMIT) -> bool:
    return df.limit(limit + 1).count() <= limit


def hinted(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Broadcast if it has at most limit rows; else merged, where adaptive execution splits skewed keys.

    The planner has no say: it takes exploded rows for as few as there were before, and broadcasts what fits no driver.
    """
    return F.broadcast(df) if small(df, limit) else df.hint("merge")


def _root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a local session names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path in the shared one."""
    return f"{_root(spark)}/tessella/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_root(spark))
    return df.checkpoint()
