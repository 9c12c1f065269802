"""Interaction data for the recommenders.

Everything is a join, aggregate or projection; scalars such as the number of
users come in as scalar subqueries (``DataFrame.scalar()``), never through
driver-side Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from ..sources.tables import truthy_id

# The weight of each behaviour kind.
WEIGHTS = {"click": 1.0, "detail": 0.8, "favorite": 1.5, "comment": 2.0}
UNKNOWN_DISTRICT = "未知"
STD_EPS = 1e-6
CF_NEG_RATIO = 1
CTR_NEG_RATIO = 2


def weighted_interactions(events: dict[str, DataFrame]) -> DataFrame:
    """(event_id, user_id, poi_id, weight) of the four event tables.

    Only favorites with is_favorite = true count; null or 0 ids are dropped;
    repeats are kept (union all).  Each table numbers its own rows, so the event id carries
    the table as well: id * 4 + the kind's place.
    """
    out = None
    for place, (kind, weight) in enumerate(WEIGHTS.items()):
        ev = events[kind]
        if kind == "favorite":
            ev = ev.where(F.col("is_favorite") == F.lit(True))
        part = (ev.where(truthy_id(F.col("user_id")) & truthy_id(F.col("poi_id")))
                .select((F.col("id").cast("bigint") * len(WEIGHTS) + place).alias("event_id"),
                        F.col("user_id").cast("bigint").alias("user_id"),
                        F.col("poi_id").cast("bigint").alias("poi_id"), F.lit(weight).alias("weight")))
        out = part if out is None else out.unionByName(part)
    return out


def weighted_interactions_log(log: DataFrame, kind_col: str = "kind") -> DataFrame:
    """L1 over one mixed event log (a ``kind`` column, ids unique in the log): one scan
    instead of one per kind."""
    kind = F.col(kind_col)
    weight = None
    for k, w in WEIGHTS.items():
        weight = F.when(kind == k, F.lit(w)) if weight is None else weight.when(kind == k, F.lit(w))
    keep = (weight.isNotNull() & truthy_id(F.col("user_id")) & truthy_id(F.col("poi_id"))
            & ((kind != "favorite") | (F.col("is_favorite") == F.lit(True))))
    return log.where(keep).select(F.col("id").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"),
                                  F.col("poi_id").cast("bigint").alias("poi_id"), weight.alias("weight"))


def dense_index(df: DataFrame, col: str, index_col: str, partitions: int | None = None) -> DataFrame:
    """Ascending distinct values of ``col`` numbered 0..n-1.

    The distinct values are range-partitioned (``repartitionByRange``) and written down with
    their partition id, so every consumer sees the same split.  Each range partition
    numbers its values locally; the offset of a partition is the prefix sum of the partition
    sizes, a table of one row per partition (a proven bound, so it is broadcast).  No
    single-partition window over the values, and no Python.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialized(df.select(col).where(F.col(col).isNotNull()).distinct()
                          .repartitionByRange(n, col).withColumn("_pid", F.spark_partition_id()), f"index-{col}")
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(col)))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(F.broadcast(offsets), "_pid").select(
        col, (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias(index_col))


def indexed_positives(interactions: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positives in index space plus the user and item index tables.

    ``keep`` names the columns that the positives carry besides the two indexes, for one consumer that
    writes them down itself; all, written once, when not given.

    The interactions and the indexed positives are written to the shared folder once,
    as Parquet: both index builds, negative sampling, the anti join and training
    read files (pruned to their columns) instead of planning the source and the
    index joins again, and a lost executor re-reads files.
    """
    src = materialized(interactions, "interactions")
    users = dense_index(src, "user_id", "user_idx")
    items = dense_index(src, "poi_id", "item_idx")
    pos = src.join(users, "user_id").join(items, "poi_id")
    pos = materialized(pos, "positives") if keep is None else pos.select("user_idx", "item_idx", *keep)
    return pos, users, items


def indexed_pairs(interactions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events, summed pairs (user_idx, item_idx, weight, n) and the user and item index tables.

    For consumers that need pairs and events, but not which event has which pair: no event id goes through the
    index joins, and the rows of a pair meet where the last of these joins leaves them, so summing ships nothing.
    Interactions and pairs are written once.
    """
    src = materialized(interactions, "interactions")
    users = dense_index(src, "user_id", "user_idx")
    items = dense_index(src, "poi_id", "item_idx")
    joined = src.select("user_id", "poi_id", "weight").join(users, "user_id").join(items, "poi_id")
    # grouped by the ids as well, by one of which the rows are partitioned already
    pairs = joined.groupBy("user_id", "poi_id", "user_idx", "item_idx").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    return src.select("event_id"), materialized(pairs.drop("user_id", "poi_id"), "pairs"), users, items


def repeated_pairs(pairs: DataFrame) -> DataFrame:
    """(user_idx, item_idx) of every interaction: each pair as often as it was counted."""
    each = F.explode(F.array_repeat(F.lit(True), F.col("n").cast("int")))
    return pairs.select("user_idx", "item_idx", each.alias("_each")).drop("_each")


def _hash_mod(seed: Column, salt: str, n: Column) -> Column:
    """60 hash bits modulo ``n``: every index can be drawn and the draw is even far beyond 2^32 of them."""
    h = F.conv(F.substring(F.md5(F.concat(seed, F.lit(salt))), 1, 15), 16, 10).cast("bigint")
    return F.pmod(h, n)


def negative_samples(positives: DataFrame, ratio: int = 1, seed: int = 42, events: DataFrame | None = None) -> DataFrame:
    """``ratio`` uniform (user_idx, item_idx) draws per positive,
    minus the positive pairs (compared in index space), duplicates kept.

    Each draw is a hash of (event id, draw number, seed), so the sample does not
    depend on partitioning and survives recomputation after executor loss.  ``events`` holds the positives'
    event ids, when ``positives`` are pairs without them.
    """
    # indexes are dense, so the largest one of the positives is the count (every value occurs there)
    sizes = positives.agg(F.struct((F.max("user_idx") + 1).alias("u"), (F.max("item_idx") + 1).alias("i"))).scalar()
    n_users, n_items = sizes.getField("u"), sizes.getField("i")
    draws = (positives if events is None else events).select("event_id", F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("k"))
    s = F.concat_ws(":", F.col("event_id").cast("string"), F.col("k").cast("string"), F.lit(str(seed)))
    sampled = draws.select("event_id", "k", _hash_mod(s, ":u", n_users).alias("user_idx"),
                           _hash_mod(s, ":i", n_items).alias("item_idx"))
    pos_pairs = positives.select("user_idx", "item_idx").distinct()
    return sampled.join(pos_pairs, ["user_idx", "item_idx"], "left_anti")


def training_set(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """L4: positives labelled 1, negatives labelled 0."""
    return (positives.select("user_idx", "item_idx", F.lit(1.0).alias("label"))
            .unionByName(negatives.select("user_idx", "item_idx", F.lit(0.0).alias("label"))))


def interactions_with_items(interactions: DataFrame, dwd: DataFrame) -> DataFrame:
    """Interactions whose poi exists in the attraction table (left semi join)."""
    return interactions.join(dwd.select(F.col("poiId").alias("poi_id")), "poi_id", "left_semi")


def item_features(dwd: DataFrame, items: DataFrame) -> DataFrame:
    """Price, heat, score (null -> 0) and district (null/'' -> '未知') of the
    interacting items only; written once, as moments, z-scores and districts all read it."""
    f = dwd.select(F.col("poiId").alias("poi_id"),
                   F.coalesce(F.col("price"), F.lit(0.0)).alias("price"),
                   F.coalesce(F.col("heatScore"), F.lit(0.0)).alias("heat"),
                   F.coalesce(F.col("commentScore"), F.lit(0.0)).alias("score"),
                   F.when(F.col("districtName").isNull() | (F.col("districtName") == ""),
                          F.lit(UNKNOWN_DISTRICT)).otherwise(F.col("districtName")).alias("district"))
    return materialized(items.join(f, "poi_id", "inner"), "item-features")


def zscore(df: DataFrame, cols=("price", "heat", "score"), eps: float = STD_EPS) -> DataFrame:
    """(x - mean) / (population std + eps).

    All moments come from one aggregate, used as a single scalar subquery.
    """
    moments = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                              *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])).scalar()
    return df.withColumns({c: (F.col(c) - moments.getField(f"m_{c}")) / (moments.getField(f"s_{c}") + F.lit(eps))
                           for c in cols})


def _districts(features: DataFrame) -> DataFrame:
    """One row: the sorted district names (a dimension of administrative names, not of rows)."""
    return features.agg(F.array_sort(F.collect_set("district")).alias("names"))


def district_index(features: DataFrame) -> DataFrame:
    """Sorted distinct district names numbered 0.., from one aggregate."""
    return _districts(features).select(F.posexplode("names").alias("district_idx", "district")).select(
        "district", F.col("district_idx").cast("bigint").alias("district_idx"))


def ctr_item_features(features: DataFrame) -> DataFrame:
    """L8 + L9 per item: item_idx, poi_id, district_idx and the z-scored price, heat and score."""
    place = F.array_position(_districts(features).scalar(), F.col("district")) - 1
    return zscore(features).select("item_idx", "poi_id", place.cast("bigint").alias("district_idx"),
                                   "price", "heat", "score")


def ctr_training_frame(train: DataFrame, features: DataFrame) -> DataFrame:
    """Each sample with the item's z-scored price, heat, score and district index."""
    return train.join(ctr_item_features(features).drop("poi_id"), "item_idx", "inner").select(
        "user_idx", "item_idx", "district_idx", "price", "heat", "score", "label")


def cold_start_items(features: DataFrame, k: int = 10) -> DataFrame:
    """The list an unknown user gets: top-k items by z-scored heat (ties by poi)."""
    z = zscore(features, cols=("heat",))
    return (z.select("poi_id", "heat").orderBy(F.desc("heat"), F.asc("poi_id")).limit(k)
            .select(F.row_number().over(Window.orderBy(F.desc("heat"), F.asc("poi_id"))).cast("bigint")
                    .alias("rank"),
                    "poi_id"))
