"""Places for intermediate tables, and size checks before a broadcast or a collect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that are broadcast or brought to the driver; beyond it the caller's other way is taken.
SMALL = 1_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="loomtide-")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by checkpoint()."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()


def is_small(df: DataFrame, limit: int = SMALL) -> bool:
    return df.limit(limit + 1).count() <= limit


def bounded(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """Marked for broadcast where its count allows it, else as it is."""
    return F.broadcast(df) if is_small(df, limit) else df


def collect_bounded(df: DataFrame, what: str, limit: int = SMALL) -> list:
    """All rows on the driver; refused beyond ``limit``, never cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}: divide the work before asking for them")
    return rows
