"""Declared schemas of the 36 marts, and the rule for marts whose input columns are absent."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.columns import columns_of

_NAME_VALUE = "name string, value bigint"
_NAME_COUNT = "name string, count bigint"

# Column names and types of the published tables.
DDL = {
    "screen_cards": "totalAttractions bigint, avgScore double, totalComments bigint, highScorePlaces bigint",
    "screen_map_heat": _NAME_VALUE,
    "screen_word_cloud": "name string, value double",
    "screen_score_trend": "date string, avgScore double",
    "screen_category": _NAME_VALUE,
    "screen_score_distribution": "bucket string, value bigint",
    "screen_price_range": "priceBucket string, value bigint",
    "screen_top_table": "poiName string, commentScore double, commentCount bigint, price double, city string, "
                        "description string, imageUrl string, detailUrl string",
    "screen_recommendations": "poiId bigint, name string, score double, imageUrl string, detailUrl string, "
                              "city string, price double, description string",
    "home_cards": "totalAttractions bigint, paidAttractions bigint, freeAttractions bigint, avgPrice double, avgHeat double",
    "home_city_overview": "bucket string, count bigint, avgScore double",
    "home_category_matrix": "category string, value bigint",
    "home_price_trend": "date string, avgHeat double, avgPrice double",
    "home_recent_trend": "city string, poiName string, commentScore double, commentCount bigint, price double",
    "home_hot_tags": _NAME_VALUE,
    "home_featured": "poiId bigint, name string, score double, price double, heatScore double, imageUrl string, "
                     "detailUrl string, city string, desc string",
    "pages_filter_city": "city string, attractionCount bigint, avgPrice double, avgHeat double, paidRate double",
    "pages_filter_level": "sightLevelStr string, count bigint, avgScore double, avgPrice double",
    "pages_filter_tags": "tag string, value bigint, avgHeat double",
    "pages_filter_booking": _NAME_COUNT,
    "pages_filter_price": "priceBucket string, count bigint, avgScore double",
    "pages_price_distribution": "bucket string, count bigint",
    "pages_price_discount": "bucket string, count bigint, avgDiscount double",
    "pages_price_vs_score": "price double, commentScore double",
    "pages_paid_rate": "label string, count bigint, avgHeat double, avgScore double",
    "pages_price_top": "poiId bigint, poiName string, price double, marketPrice double, heatScore double, commentScore double",
    "pages_family_tags": "tag string, value bigint",
    "pages_family_district": "district string, count bigint, avgScore double",
    "pages_family_level": "sightLevelStr string, count bigint",
    "pages_family_heat": "bucket string, count bigint, avgHeat double",
    "pages_family_booking": _NAME_COUNT,
    "pages_media_video": "label string, count bigint, avgHeat double",
    "pages_media_distance": "bucket string, count bigint, avgHeat double",
    "pages_media_opening": "status string, count bigint",
    "pages_media_event": _NAME_COUNT,
    "pages_media_price_tag": _NAME_COUNT,
}
_TYPES = {"string": StringType(), "bigint": LongType(), "double": DoubleType()}
SCHEMAS = {name: StructType([StructField(f.split()[0], _TYPES[f.split()[1]]) for f in ddl.split(", ")])
           for name, ddl in DDL.items()}


def needs(*groups: Sequence[str]) -> Callable:
    """A mart that has no rows, but its declared schema, unless ``df`` has a column of every group."""
    def wrap(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(build)
        def checked(df: DataFrame, *args, **kwargs) -> DataFrame:
            if all(columns_of(df, g) for g in groups):
                return build(df, *args, **kwargs)
            return df.sparkSession.createDataFrame([], SCHEMAS[build.__name__])
        return checked
    return wrap
