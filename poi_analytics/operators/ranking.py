"""Global orders without a global task, and the quality of rankings (L5/L11 evaluation).

``running_totals`` gives sums over all earlier rows of a total order: rows are split by ranges of the
order, summed inside each range, and a table of one row per range adds what lies before it.
AUC by rank sums and ranks of whole tables are built on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized


def running_totals(df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column],
                   partitions: int | None = None) -> DataFrame:
    """``df`` with, for each ``name: value``, the sum of ``value`` over all rows before a row in ``order``.

    The order should be total (equal rows share one range, in no fixed order).  The split is written
    down once, so that every consumer sees the same ranges; no window spans more than one range,
    and the broadcast table has one row per range (a proven bound).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = {f"_{name}": value for name, value in totals.items()}
    ranged = materialized(df.repartitionByRange(n, *order).withColumns(
        {**held, "_range": F.spark_partition_id()}), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({name: F.coalesce(F.sum(f"_{name}").over(inside), F.lit(0)) for name in totals})
    sizes = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in held])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in held])
    out = local.join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *[(F.col(name) + F.col(f"_{name}_before")).alias(name) for name in totals])


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row (positives, negatives, auc): the chance that a positive scores above a negative, ties half.

    Rows are first counted per distinct score (combined before the shuffle, so one score that a third
    of all rows share costs one row).  A positive beats the negatives of all smaller scores and
    half of those of its own, which is the mid-rank form of the rank-sum statistic.  Rows without
    a score or label are left out; with one class only, auc is null.
    """
    rows = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg"))
    below = running_totals(counts, [F.asc("score")], {"below": F.col("neg")})
    sums = below.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                     F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("negatives", F.lit(0)).alias("negatives"),
                       F.when(pairs > 0, F.col("wins") / pairs).alias("auc"))


def hit_rate(recommended: DataFrame, held_out: DataFrame, k: int = 10, user: str = "user_id", item: str = "poi_id",
             rank: str = "rank") -> DataFrame:
    """One row (users, hit_users, hits, hit_rate, recall) of the first ``k`` of each user's list.

    ``held_out`` holds the (user, item) pairs to find; repeats count once.  ``hit_rate`` is the share of users
    with at least one hit, ``recall`` the share of all pairs found.  A user without a list counts
    as one without a hit.
    """
    pairs = held_out.select(user, item).where(F.col(user).isNotNull() & F.col(item).isNotNull()).distinct()
    top = recommended.where(F.col(rank) <= k).select(user, item).distinct().withColumn("hit", F.lit(1))
    found = pairs.join(top, [user, item], "left")
    return _rates(found.groupBy(user).agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("pairs")))


def hit_rate_common(recommended: DataFrame, held_out: DataFrame, k: int = 10, user: str = "user_id",
                    item: str = "poi_id", rank: str = "rank") -> DataFrame:
    """``hit_rate`` where everyone gets the same list (rank, item), such as the cold-start list."""
    pairs = held_out.select(user, item).where(F.col(user).isNotNull() & F.col(item).isNotNull()).distinct()
    top = recommended.where(F.col(rank) <= k).select(item).distinct().withColumn("hit", F.lit(1))
    found = pairs.join(top, item, "left")  # the list has k rows, which the planner sees and broadcasts
    return _rates(found.groupBy(user).agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("pairs")))


def _rates(per_user: DataFrame) -> DataFrame:
    sums = per_user.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("hits") > 0).alias("hit_users"),
                        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    return sums.select("users", "hit_users", "hits",
                       F.when(F.col("users") > 0, F.col("hit_users") / F.col("users")).alias("hit_rate"),
                       F.when(F.col("pairs") > 0, F.col("hits") / F.col("pairs")).alias("recall"))
