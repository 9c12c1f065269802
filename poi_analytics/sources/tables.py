"""Readers for catalog tables and the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables the driver provides as one Parquet file each.
DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet gives column pruning and filter pushdown."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_scan(spark: SparkSession, db: str, table: str) -> DataFrame:
    """A2: read a catalog table, creating the database when it is missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
    return spark.table(f"`{db}`.`{table}`")


ITEM_FEATURE_COLUMNS = ["poiId", "districtName", "price", "heatScore", "commentScore", "tagNameList"]
CONTENT_COLUMNS = ["poiId", "poiName", "shortFeatures", "tagNameList", "coverImageUrl",
                   "detailUrl", "districtName", "heatScore", "commentScore"]


def item_feature_scan(dwd: DataFrame) -> DataFrame:
    """A3: the ranking features, one row per poiId (of several the largest values)."""
    rest = [c for c in ITEM_FEATURE_COLUMNS if c != "poiId"]
    best = dwd.groupBy("poiId").agg(F.max(F.struct(*rest)).alias("f"))
    return best.select("poiId", *[F.col(f"f.{c}").alias(c) for c in rest])


def content_scan(dwd: DataFrame, limit: int | None = None) -> DataFrame:
    """A4: rows with a usable cover image; an optional limit takes the lowest ids."""
    out = dwd.select(*CONTENT_COLUMNS).where(
        F.col("coverImageUrl").isNotNull() & (F.col("coverImageUrl") != ""))
    if limit:
        out = out.orderBy("poiId").limit(int(limit))
    return out


def truthy_id(c: Column) -> Column:
    """An id counts only when it is neither null nor 0."""
    return c.isNotNull() & (c != 0)


def behavior_scan(events: DataFrame, user_col: str = "user_id", poi_col: str = "poi_id") -> DataFrame:
    """A5: (user_id, poi_id) of one event table, rows with a null or 0 id dropped."""
    return (events.select(F.col(user_col).cast("bigint").alias("user_id"),
                          F.col(poi_col).cast("bigint").alias("poi_id"))
            .where(truthy_id(F.col("user_id")) & truthy_id(F.col("poi_id"))))


def factor_scan(spark: SparkSession, path: str) -> DataFrame:
    """A saved factor / embedding table (id, vector)."""
    return spark.read.parquet(path)
