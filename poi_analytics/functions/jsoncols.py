"""JSON text columns (C11, C12, C14, C15, C19, C20) as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

STRING_ARRAY = ArrayType(StringType())
TAG_STRUCT = StructType([
    StructField("name", StringType(), True),
    StructField("type", StringType(), True),
    StructField("code", StringType(), True),
])
TAG_ARRAY = ArrayType(TAG_STRUCT)
NAME_STRUCT = StructType([StructField("name", StringType(), True)])

# The candidate columns for tags, in priority order.
TAG_COLUMNS = ["tagNameList", "shortFeatures", "otherTagList"]


def string_array(c: Column) -> Column:
    """C11: JSON array-of-string text -> array<string>; malformed -> null."""
    return F.from_json(c, STRING_ARRAY)


def tag_array(c: Column) -> Column:
    """C11: JSON array of {name,type,code} -> array<struct>; malformed -> null."""
    return F.from_json(c, TAG_ARRAY)


def name_struct(c: Column) -> Column:
    """C11: JSON object with a name -> struct<name>."""
    return F.from_json(c, NAME_STRUCT)


def tag_tokens(c: Column) -> Column:
    """C14: JSON array when parseable, else a comma split (untrimmed, empties kept)."""
    return F.coalesce(string_array(c), F.split(c, ","))


def tag_tokens_trimmed(c: Column) -> Column:
    """JSON array when parseable, else comma tokens trimmed with blanks dropped."""
    split = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNull() | (c == ""), F.array().cast(STRING_ARRAY)).otherwise(
        F.coalesce(string_array(c), split))


def distance_km(c: Column, legacy_units: bool = True) -> Column:
    """First number in the text, in kilometres.

    ``legacy_units=True`` keeps the source rule: any 'm' in the lower-cased text
    (which includes 'km') divides by 1000.  ``False`` divides only plain metres.
    """
    value = F.regexp_extract(c, r"([0-9.]+)", 1).try_cast("double")
    low = F.lower(c)
    if legacy_units:
        return F.when(low.contains("m"), value / 1000).otherwise(value)
    return F.when(low.contains("km"), value).when(low.contains("m"), value / 1000).otherwise(value)


def event_date(ts_millis: Column) -> Column:
    """Epoch milliseconds -> calendar date in the session's time zone."""
    return F.to_date(F.timestamp_millis(ts_millis.cast("bigint")))


def _text_part(c: Column) -> Column:
    # a list of texts is joined; a list with anything else in it, or no JSON, is taken as it is
    arr, parsed = string_array(c), F.try_parse_json(c)
    texts = ~F.exists(arr, lambda x: x.isNull()) & (F.to_json(arr) == F.to_json(parsed))
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .when(arr.isNotNull(), F.when(texts, F.array_join(arr, " ")).otherwise(c))
            .when(parsed.isNull(), c)
            .otherwise(F.lit("")))


def poi_text(name: Column, features: Column, tags: Column) -> Column:
    """C20: "name. features. tags", trimmed; JSON lists joined by spaces."""
    return F.trim(F.concat_ws(". ", F.coalesce(name, F.lit("")), _text_part(features), _text_part(tags)))
