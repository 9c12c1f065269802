"""Big-screen dashboard marts (F1-F9) over the DWD attraction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucketize, bucketize_sql, columns_of, pick, with_columns_present
from ..functions.images import IMAGE_COLUMNS, IMAGE_JSON_COLUMNS, image_url, image_url_sql
from ..functions.jsoncols import event_date
from ..functions.regions import normalize_region, normalize_region_sql
from .schemas import SCHEMAS, needs

# Candidate columns, in priority order.
DETAIL_COLUMNS = ["detailUrl", "url", "wapUrl", "jumpUrl", "detailLink"]
CITY_COLUMNS = ["districtName", "crawlDistrictName", "cityName", "provinceName"]
DESC_COLUMNS = ["shortDesc", "absDesc", "description", "tips", "summary", "intro"]
HEAT_COLUMNS = ["heatScore", "commentCount"]
CATEGORY_COLUMNS = ["categoryName", "categoryType", "tagName"]
PRICE_COLUMNS = ["price", "marketPrice", "marketDiscountPrice", "discountPrice"]
# Price buckets and score labels.
SCREEN_PRICE_BUCKETS = [("<", 50, "0-49"), ("<", 100, "50-99"), ("<", 200, "100-199"), ("<", 500, "200-499")]
SCREEN_PRICE_DEFAULT = "500+"
HIGH_SCORE = 4.5
TOP_SCORE_LABEL = "5分+"

# Every input column the screen marts may read (missing ones are simply absent).
INPUT_COLUMNS = sorted({"poiId", "poiName", "commentScore", "commentCount", "heatScore", "timestamp",
                        "provinceName", "crawlDistrictName", "categoryName", "categoryType", "tagName",
                        *DETAIL_COLUMNS, *CITY_COLUMNS, *DESC_COLUMNS, *PRICE_COLUMNS,
                        *IMAGE_COLUMNS, *IMAGE_JSON_COLUMNS})

TOPN = 10
MAP_LIMIT = 34
WORD_CLOUD_LIMIT = 60
TREND_LIMIT = 30
CATEGORY_LIMIT = 8
RECOMMEND_LIMIT = 6


def screen_cards(df: DataFrame) -> DataFrame:
    """F1: distinct pois (null id counts once), mean score, total comments, high scorers.

    Combined per poiId first (partial aggregation), then one global pass.  Without poiId every row
    counts; without scores or comment counts those figures are null or 0.
    """
    df = with_columns_present(df, commentScore="double", commentCount="bigint")
    if not columns_of(df, ["poiId"]):
        df = df.withColumn("poiId", F.monotonically_increasing_id())
    per_poi = df.groupBy("poiId").agg(
        F.sum("commentScore").alias("ss"), F.count("commentScore").alias("cs"),
        F.sum("commentCount").alias("cc"),
        F.count_if(F.col("commentScore") >= HIGH_SCORE).alias("hi"))
    return per_poi.agg(
        F.count(F.lit(1)).alias("totalAttractions"),
        F.round(F.sum("ss") / F.sum("cs"), 2).alias("avgScore"),
        F.coalesce(F.sum("cc"), F.lit(0)).cast("bigint").alias("totalComments"),
        F.coalesce(F.sum("hi"), F.lit(0)).cast("bigint").alias("highScorePlaces"))


@needs(["provinceName", "crawlDistrictName"])
def screen_map_heat(df: DataFrame, limit: int = MAP_LIMIT, merge: bool = False) -> DataFrame:
    """distinct pois per province (else crawl district), top ``limit``.

    Names are normalized after grouping, as the source does, so two raw names
    may map to one province; ``merge=True`` groups by the normalized name.
    """
    col = pick(df, ["provinceName", "crawlDistrictName"])
    key = normalize_region(col) if merge else col
    top = (df.groupBy(key.alias("name"))
           .agg(F.count_distinct("poiId").alias("value"))
           .orderBy(F.desc("value"), F.asc_nulls_first("name"))
           .limit(limit))
    return top if merge else top.select(normalize_region(F.col("name")).alias("name"), "value")


@needs(HEAT_COLUMNS, ["poiName"])
def screen_word_cloud(df: DataFrame, limit: int = WORD_CLOUD_LIMIT) -> DataFrame:
    """the ``limit`` names with the highest heat (else comment count); null -> 0."""
    return (df.select(F.col("poiName").alias("name"), pick(df, HEAT_COLUMNS, "double").alias("v"),
                      pick(df, ["poiId"], "bigint").alias("poiId"))
            .orderBy(F.desc_nulls_last("v"), F.asc_nulls_first("poiId"))
            .limit(limit)
            .select("name", F.coalesce(F.col("v"), F.lit(0.0)).alias("value")))


@needs(["timestamp"])
def screen_score_trend(df: DataFrame, limit: int = TREND_LIMIT) -> DataFrame:
    """mean score per day, the earliest ``limit`` groups; the null day takes a slot, then is dropped."""
    return (df.groupBy(event_date(pick(df, ["timestamp"])).alias("d"))
            .agg(F.round(F.avg(pick(df, ["commentScore"], "double")), 2).alias("avgScore"))
            .orderBy(F.asc_nulls_first("d"))
            .limit(limit)
            .where(F.col("d").isNotNull())
            .select(F.col("d").cast("string").alias("date"), "avgScore"))


@needs(CATEGORY_COLUMNS)
def screen_category(df: DataFrame, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """distinct pois per categoryName / categoryType / tagName, top ``limit``."""
    return (df.groupBy(pick(df, CATEGORY_COLUMNS).alias("name"))
            .agg(F.count_distinct("poiId").alias("value"))
            .orderBy(F.desc("value"), F.asc_nulls_first("name"))
            .limit(limit))


def score_bucket(score):
    """'5分+' from 5 up, else 'n-(n+1)' by floor; a null score gives a null bucket."""
    fl = F.floor(score)
    return (F.when(score >= 5, F.lit(TOP_SCORE_LABEL))
            .otherwise(F.concat(fl.cast("int").cast("string"), F.lit("-"), (fl + 1).cast("int").cast("string"))))


@needs(["commentScore"])
def screen_score_distribution(df: DataFrame) -> DataFrame:
    """count per score bucket."""
    return df.groupBy(score_bucket(F.col("commentScore")).alias("bucket")).agg(F.count(F.lit(1)).alias("value"))


@needs(["price"])
def screen_price_range(df: DataFrame) -> DataFrame:
    """count per price bucket (null price -> '500+')."""
    b = bucketize(F.col("price"), SCREEN_PRICE_BUCKETS, SCREEN_PRICE_DEFAULT)
    return df.groupBy(b.alias("priceBucket")).agg(F.count(F.lit(1)).alias("value")).orderBy("priceBucket")


# What a listing shows: (published name, candidate columns, type).
LISTED = [
    ("commentScore", ["commentScore"], "double"), ("commentCount", ["commentCount"], "bigint"),
    ("score", HEAT_COLUMNS[:1], "double"), ("price", PRICE_COLUMNS, "double"),
    ("detailUrl", DETAIL_COLUMNS, "string"), ("city", CITY_COLUMNS, "string"), ("description", DESC_COLUMNS, "string"),
]


def top_listing(df: DataFrame, by: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the largest ``by`` (nulls last, ties by poiId), with every listed field.

    ``imageUrl`` is worked out for the rows left after the top-k only; the single partition
    above the limit keeps the top-k operator below the image step.
    """
    fields = [pick(df, names, dtype).alias(name) for name, names, dtype in LISTED]
    images = [pick(df, IMAGE_COLUMNS, "string", merge=True).alias("_image"),
              pick(df, IMAGE_JSON_COLUMNS, "string", merge=True).alias("_images")]
    top = (df.select(pick(df, ["poiId"], "bigint").alias("poiId"), pick(df, ["poiName"], "string").alias("poiName"),
                     *fields, *images)
           .orderBy(F.desc_nulls_last(by), F.asc_nulls_first("poiId")).limit(limit).coalesce(1))
    return top.withColumn("imageUrl", image_url(F.col("_image"), F.col("_images")))


def screen_top_table(df: DataFrame, limit: int = TOPN) -> DataFrame:
    """F8: the ``limit`` best-scored pois."""
    return top_listing(df, "commentScore", limit).select(*SCHEMAS["screen_top_table"].names)


@needs(["heatScore"], ["poiName"])
def screen_recommendations(df: DataFrame, limit: int = RECOMMEND_LIMIT) -> DataFrame:
    """the ``limit`` hottest pois; rows with a null id are dropped after the limit."""
    top = top_listing(df, "score", limit).where(F.col("poiId").isNotNull())
    return (top.withColumns({"name": F.col("poiName"), "score": F.round("score", 2)})
            .select(*SCHEMAS["screen_recommendations"].names))


BUILDERS = {
    "screen_cards": screen_cards,
    "screen_map_heat": screen_map_heat,
    "screen_word_cloud": screen_word_cloud,
    "screen_score_trend": screen_score_trend,
    "screen_category": screen_category,
    "screen_score_distribution": screen_score_distribution,
    "screen_price_range": screen_price_range,
    "screen_top_table": screen_top_table,
    "screen_recommendations": screen_recommendations,
}


def build_all(df: DataFrame, topn: int = TOPN) -> dict[str, DataFrame]:
    out = {name: fn(df) for name, fn in BUILDERS.items()}
    out["screen_top_table"] = screen_top_table(df, topn)
    return out


ORACLE = {
    "screen_cards": f"""
SELECT (SELECT count(*) FROM (SELECT DISTINCT poiId FROM attractions)) AS totalAttractions,
  (SELECT round(avg(commentScore), 2) FROM attractions) AS avgScore,
  (SELECT CAST(coalesce(sum(commentCount), 0) AS BIGINT) FROM attractions) AS totalComments,
  (SELECT count(*) FROM attractions WHERE commentScore >= {HIGH_SCORE}) AS highScorePlaces""",
    "screen_map_heat": f"""
SELECT {normalize_region_sql('name')} AS name, value FROM (
  SELECT crawlDistrictName AS name, count(DISTINCT poiId) AS value FROM attractions
  GROUP BY 1 ORDER BY value DESC, name ASC NULLS FIRST LIMIT {MAP_LIMIT})""",
    "screen_word_cloud": f"""
SELECT name, coalesce(v, 0.0) AS value FROM (
  SELECT poiName AS name, heatScore AS v, poiId FROM attractions
  ORDER BY v DESC NULLS LAST, poiId ASC NULLS FIRST LIMIT {WORD_CLOUD_LIMIT})""",
    "screen_score_trend": f"""
SELECT CAST(d AS VARCHAR) AS date, avgScore FROM (
  SELECT CAST(epoch_ms("timestamp") AS DATE) AS d, round(avg(commentScore), 2) AS avgScore
  FROM attractions GROUP BY 1 ORDER BY d ASC NULLS FIRST LIMIT {TREND_LIMIT}) WHERE d IS NOT NULL""",
    "screen_category": f"""
SELECT categoryType AS name, count(DISTINCT poiId) AS value FROM attractions
GROUP BY 1 ORDER BY value DESC, name ASC NULLS FIRST LIMIT {CATEGORY_LIMIT}""",
    "screen_score_distribution": f"""
SELECT CASE WHEN commentScore >= 5 THEN '{TOP_SCORE_LABEL}'
  ELSE CAST(CAST(floor(commentScore) AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(floor(commentScore) + 1 AS INTEGER) AS VARCHAR) END AS bucket,
  count(*) AS value FROM attractions GROUP BY 1""",
    "screen_price_range": f"""
SELECT {bucketize_sql('price', SCREEN_PRICE_BUCKETS, SCREEN_PRICE_DEFAULT)} AS priceBucket, count(*) AS value
FROM attractions GROUP BY 1""",
    "screen_top_table": f"""
SELECT poiName, commentScore, commentCount, price, districtName AS city, shortDesc AS description,
  {image_url_sql('coverImageUrl', 'imageList')} AS imageUrl, detailUrl
FROM (SELECT * FROM attractions ORDER BY commentScore DESC NULLS LAST, poiId ASC NULLS FIRST LIMIT {TOPN})""",
    "screen_recommendations": f"""
SELECT poiId, poiName AS name, round(heatScore, 2) AS score, {image_url_sql('coverImageUrl', 'imageList')} AS imageUrl,
  detailUrl, districtName AS city, price, shortDesc AS description
FROM (SELECT * FROM attractions ORDER BY heatScore DESC NULLS LAST, poiId ASC NULLS FIRST LIMIT {RECOMMEND_LIMIT})
WHERE poiId IS NOT NULL""",
}
