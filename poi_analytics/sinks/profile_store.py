"""Profiles as a stored table that updates are applied to (K8, writing side).

The table is Parquet partitioned by ranges of ids.  An update rewrites the partitions of the profiles it
names and no others (copy on write, by dynamic partition overwrite).  The new partitions are first
written in full beside the table; whoever comes next finishes a write that was killed half way.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.behavior import profile_update
from ..session import remove

#: Ids of one partition.
WIDTH = 100_000
PART = "id_range"


def _pending(path: str) -> str:
    return f"{path.rstrip('/')}_pending"


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def create_store(profiles: DataFrame, path: str, width: int = WIDTH) -> None:
    """Write all profiles, one partition per ``width`` ids (a bounded number of rows)."""
    (profiles.withColumn(PART, F.floor(F.col("id") / width).cast("long")).repartition(PART)
     .write.mode("overwrite").partitionBy(PART).parquet(path))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def _put(spark: SparkSession, path: str) -> None:
    """Replace the partitions that the pending table holds, then drop it."""
    pending = _pending(path)
    (spark.read.parquet(pending).repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(PART).parquet(path))
    remove(spark, pending)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a write that was killed after its new partitions were complete; an incomplete one is dropped."""
    done = _complete(spark, _pending(path))
    if done:
        _put(spark, path)
    else:
        remove(spark, _pending(path))
    return done


def apply_updates(spark: SparkSession, path: str, updates: DataFrame, partial: bool = True,
                  order_col: str | None = None) -> int:
    """K8 on the stored table; the number of partitions rewritten.

    Updates are keyed by username, so finding their partitions reads that column of the whole table; the rows
    of other partitions are neither read in full nor written.  Applying the same updates again changes nothing.
    """
    recover(spark, path)
    store = spark.read.parquet(path)
    touched = store.join(updates.select("username").distinct(), "username", "left_semi").select(PART).distinct()
    changed = profile_update(store.join(touched, PART, "left_semi"), updates, partial, order_col)
    changed.write.parquet(_pending(path))
    n = spark.read.parquet(_pending(path)).select(PART).distinct().count()
    if n:
        _put(spark, path)
    else:
        remove(spark, _pending(path))
    return n
