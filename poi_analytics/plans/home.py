"""Home dashboard marts (F10-F16) over the DWD attraction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucketize, bucketize_sql, columns_of, pick
from ..functions.jsoncols import TAG_COLUMNS, event_date, tag_tokens
from .schemas import needs

# Home candidate columns and price buckets.
HOME_IMAGE_COLUMNS = ["coverImageUrl", "dynamicCoverImageUrl", "imageUrl", "imgUrl", "image", "firstImage"]
HOME_DETAIL_COLUMNS = ["detailUrl", "url", "wapUrl"]
HOME_DESC_COLUMNS = ["shortDesc", "description", "shortFeatures"]
CITY_COLUMNS = ["crawlDistrictName", "districtName"]
CATEGORY_COLUMNS = ["categoryType", "tagName"]
HOME_PRICE_BUCKETS = [("<=", 0, "免费"), ("<", 100, "0-99"), ("<", 200, "100-199"), ("<", 300, "200-299")]
HOME_PRICE_DEFAULT = "300+"

# Every input column the home marts may read (missing ones are simply absent).
INPUT_COLUMNS = sorted({"poiId", "poiName", "price", "heatScore", "commentScore", "commentCount", "categoryType",
                        "tagName", "timestamp", "crawlDistrictName", "districtName", *TAG_COLUMNS,
                        *HOME_IMAGE_COLUMNS, *HOME_DETAIL_COLUMNS, *HOME_DESC_COLUMNS})

TOPN = 8
CATEGORY_LIMIT = 10
TREND_LIMIT = 12
PER_CITY = 5
HOT_TAG_LIMIT = 60


def home_cards(df: DataFrame) -> DataFrame:
    """distinct pois (a null id counts once), paid / free pois, mean price and heat.

    Rows are first combined per poiId (partial aggregation before the shuffle),
    so one global pass over the per-poi rows gives every figure.
    """
    per_poi = df.groupBy("poiId").agg(
        F.max((F.col("price") > 0).cast("int")).alias("paid"),
        F.sum("price").alias("sp"), F.count("price").alias("cp"),
        F.sum("heatScore").alias("sh"), F.count("heatScore").alias("ch"))
    total = F.count(F.lit(1))
    paid = F.count_if(F.col("paid") == 1)
    return per_poi.agg(
        total.alias("totalAttractions"),
        paid.alias("paidAttractions"),
        (total - paid).alias("freeAttractions"),
        F.round(F.coalesce(F.sum("sp") / F.sum("cp"), F.lit(0.0)), 2).alias("avgPrice"),
        F.round(F.coalesce(F.sum("sh") / F.sum("ch"), F.lit(0.0)), 2).alias("avgHeat"))


def home_city_overview(df: DataFrame) -> DataFrame:
    """price buckets (null price -> '300+') with count and mean score."""
    bucket = bucketize(F.col("price"), HOME_PRICE_BUCKETS, HOME_PRICE_DEFAULT)
    return (df.groupBy(bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("commentScore"), 2).alias("avgScore"))
            .orderBy("bucket"))


@needs(CATEGORY_COLUMNS)
def home_category_matrix(df: DataFrame, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """distinct pois per categoryType (else tagName), top ``limit``."""
    return (df.groupBy(pick(df, CATEGORY_COLUMNS).alias("category"))
            .agg(F.count_distinct("poiId").alias("value"))
            .orderBy(F.desc("value"), F.asc_nulls_first("category"))
            .limit(limit))


@needs(["heatScore"])
def home_price_trend(df: DataFrame, limit: int = TREND_LIMIT) -> DataFrame:
    """mean heat and price per day, the earliest ``limit`` days (a null day sorts first).

    Without a timestamp everything is today; without a price its mean is null.
    """
    day = event_date(pick(df, ["timestamp"])) if columns_of(df, ["timestamp"]) else F.current_date()
    return (df.groupBy(day.alias("d"))
            .agg(F.round(F.avg("heatScore"), 2).alias("avgHeat"),
                 F.round(F.avg(pick(df, ["price"], "double")), 2).alias("avgPrice"))
            .orderBy(F.asc_nulls_first("d"))
            .limit(limit)
            .select(F.coalesce(F.col("d").cast("string"), F.lit("")).alias("date"), "avgHeat", "avgPrice"))


@needs(CITY_COLUMNS)
def home_recent_trend(df: DataFrame, per_city: int = PER_CITY) -> DataFrame:
    """the best ``per_city`` pois per city by score (row_number, ties by poiId).

    The filter sits right on row_number, so Catalyst adds a partial
    WindowGroupLimit before the shuffle: a hot city ships at most ``per_city``
    rows per input partition.
    """
    w = Window.partitionBy("city").orderBy(F.desc_nulls_last("commentScore"), F.asc_nulls_first("poiId"))
    rows = df.select(pick(df, CITY_COLUMNS).alias("city"), pick(df, ["poiId"], "bigint").alias("poiId"), "poiName",
                     "commentScore",
                     F.coalesce(pick(df, ["commentCount"], "bigint"), F.lit(0)).cast("bigint").alias("commentCount"),
                     pick(df, ["price"], "double").alias("price"))
    return (rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_city)
            .select("city", "poiName", "commentScore", "commentCount", "price"))


@needs(TAG_COLUMNS)
def home_hot_tags(df: DataFrame, limit: int = HOT_TAG_LIMIT) -> DataFrame:
    """tag counts (JSON list or comma split of the first tag column), top ``limit``."""
    tags = pick(df, TAG_COLUMNS)
    return (df.where(tags.isNotNull())
            .select(F.explode(tag_tokens(tags)).alias("name"))
            .groupBy("name").agg(F.count(F.lit(1)).alias("value"))
            .orderBy(F.desc("value"), F.asc_nulls_first("name"))
            .limit(limit))


def home_featured(df: DataFrame, limit: int = TOPN) -> DataFrame:
    """F16: the ``limit`` hottest pois with image, link, city and description."""
    return (df.select(
        F.col("poiId").cast("bigint").alias("poiId"),
        F.col("poiName").alias("name"),
        F.col("commentScore").alias("score"),
        "price", "heatScore",
        pick(df, HOME_IMAGE_COLUMNS, "string", merge=True).alias("imageUrl"),
        pick(df, HOME_DETAIL_COLUMNS, "string", merge=True).alias("detailUrl"),
        pick(df, CITY_COLUMNS, default="").alias("city"),
        pick(df, HOME_DESC_COLUMNS, "string", merge=True).alias("desc"))
        .orderBy(F.desc_nulls_last("heatScore"), F.asc_nulls_first("poiId"))
        .limit(limit))


BUILDERS = {
    "home_cards": home_cards,
    "home_city_overview": home_city_overview,
    "home_category_matrix": home_category_matrix,
    "home_price_trend": home_price_trend,
    "home_recent_trend": home_recent_trend,
    "home_hot_tags": home_hot_tags,
    "home_featured": home_featured,
}


def build_all(df: DataFrame) -> dict[str, DataFrame]:
    return {name: fn(df) for name, fn in BUILDERS.items()}


_TAGS = ("coalesce(CASE WHEN json_valid(tagNameList) THEN from_json(tagNameList, '[\"VARCHAR\"]') END, "
         "string_split(tagNameList, ','))")

# DuckDB statements of the same marts over the ``attractions`` view.
ORACLE = {
    "home_cards": """
SELECT (SELECT count(*) FROM (SELECT DISTINCT poiId FROM attractions)) AS totalAttractions,
  (SELECT count(*) FROM (SELECT DISTINCT poiId FROM attractions WHERE price > 0)) AS paidAttractions,
  (SELECT count(*) FROM (SELECT DISTINCT poiId FROM attractions))
    - (SELECT count(*) FROM (SELECT DISTINCT poiId FROM attractions WHERE price > 0)) AS freeAttractions,
  (SELECT round(coalesce(avg(price), 0), 2) FROM attractions) AS avgPrice,
  (SELECT round(coalesce(avg(heatScore), 0), 2) FROM attractions) AS avgHeat""",
    "home_city_overview": f"""
SELECT {bucketize_sql('price', HOME_PRICE_BUCKETS, HOME_PRICE_DEFAULT)} AS bucket,
  count(*) AS count, round(avg(commentScore), 2) AS avgScore
FROM attractions GROUP BY 1""",
    "home_category_matrix": f"""
SELECT categoryType AS category, count(DISTINCT poiId) AS value FROM attractions
GROUP BY 1 ORDER BY value DESC, category ASC NULLS FIRST LIMIT {CATEGORY_LIMIT}""",
    "home_price_trend": f"""
SELECT coalesce(CAST(d AS VARCHAR), '') AS date, avgHeat, avgPrice FROM (
  SELECT CAST(epoch_ms("timestamp") AS DATE) AS d, round(avg(heatScore), 2) AS avgHeat,
    round(avg(price), 2) AS avgPrice
  FROM attractions GROUP BY 1 ORDER BY d ASC NULLS FIRST LIMIT {TREND_LIMIT})""",
    "home_recent_trend": f"""
SELECT crawlDistrictName AS city, poiName, commentScore, coalesce(commentCount, 0) AS commentCount, price
FROM (SELECT *, row_number() OVER (PARTITION BY crawlDistrictName
        ORDER BY commentScore DESC NULLS LAST, poiId ASC NULLS FIRST) AS rn FROM attractions)
WHERE rn <= {PER_CITY}""",
    "home_hot_tags": f"""
SELECT name, count(*) AS value FROM (
  SELECT unnest({_TAGS}) AS name FROM attractions WHERE tagNameList IS NOT NULL)
GROUP BY name ORDER BY value DESC, name ASC NULLS FIRST LIMIT {HOT_TAG_LIMIT}""",
    "home_featured": f"""
SELECT poiId, poiName AS name, commentScore AS score, price, heatScore, coverImageUrl AS imageUrl,
  detailUrl, crawlDistrictName AS city, coalesce(shortDesc, shortFeatures) AS "desc"
FROM attractions ORDER BY heatScore DESC NULLS LAST, poiId ASC NULLS FIRST LIMIT {TOPN}""",
}
