"""Attraction, ODS, behaviour and profile views derived from the driver tables.

The same SQL text runs in Spark and in DuckDB (the oracle).  Table references
are written ``${name}`` and the reserved column as ``${ts}``; ``render`` swaps them
for a Parquet path (Spark) or a view name (DuckDB).  Everything is derived
from whole tables (``part``, ``lineitem``, ``orders``, ``customer``), so the
work grows with the scale factor.  Nulls, zeros, empty strings, malformed text,
repeats and bucket boundaries are planted by fixed rules.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

ATTRACTIONS_SQL = """
SELECT
  p_partkey AS poiId,
  CASE WHEN p_partkey % 97 = 96 THEN NULL ELSE p_name || ' ' || CAST(p_partkey AS STRING) END AS poiName,
  CAST(p_size AS BIGINT) AS districtId,
  CASE p_size % 7 WHEN 0 THEN '长沙' WHEN 1 THEN '北京' WHEN 2 THEN '广州市' WHEN 3 THEN '深圳' WHEN 4 THEN '内蒙古' WHEN 5 THEN '延边州' ELSE NULL END AS districtName,
  CASE p_size % 7 WHEN 0 THEN '长沙' WHEN 1 THEN '北京' WHEN 2 THEN '广州市' WHEN 3 THEN '深圳' WHEN 4 THEN '内蒙古' WHEN 5 THEN '延边州' ELSE '浙江省' END AS crawlDistrictName,
  'Zone ' || p_brand AS zoneName,
  p_type AS categoryType,
  CASE p_partkey % 6 WHEN 0 THEN '5A' WHEN 1 THEN '4A' WHEN 2 THEN '3A' WHEN 3 THEN '2A' WHEN 4 THEN NULL ELSE '4A' END AS sightLevelStr,
  CASE WHEN p_partkey % 11 = 0 THEN '亲子乐园' ELSE p_type END AS sightCategoryInfo,
  CASE WHEN p_partkey % 19 = 18 THEN NULL ELSE CAST(p_partkey % 51 AS DOUBLE) / 10 END AS commentScore,
  CASE WHEN p_partkey % 43 = 42 THEN NULL ELSE (p_partkey * 13) % 1000 END AS commentCount,
  CASE WHEN p_partkey % 23 = 22 THEN NULL ELSE CAST((p_partkey * 7) % 101 AS DOUBLE) / 10 END AS heatScore,
  CASE WHEN p_partkey % 29 = 28 THEN NULL ELSE CAST(p_size AS DOUBLE) * 12 - 24 END AS price,
  CASE WHEN p_partkey % 31 = 30 THEN NULL WHEN p_partkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) * 15 END AS marketPrice,
  CAST(p_size AS DOUBLE) * 13 AS marketDiscountPrice,
  CAST(p_size AS DOUBLE) * 14 AS underlineDiscountPrice,
  CASE WHEN p_size % 2 = 0 THEN '起' ELSE NULL END AS priceTypeDesc,
  CASE WHEN p_partkey % 13 = 12 THEN NULL WHEN p_partkey % 13 = 11 THEN '[]' WHEN p_partkey % 13 = 10 THEN lower(p_type) || ',' || split_part(p_name, ' ', 1) ELSE '["' || lower(p_type) || '","' || split_part(p_name, ' ', 1) || '","' || CASE WHEN p_partkey % 7 = 0 THEN '亲子' ELSE '' END || '"]' END AS tagNameList,
  '["' || split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 17 = 0 THEN '亲子遛娃' ELSE '' END || '"]' AS shortFeatures,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '[{"name":"bk' || CAST(p_partkey % 3 AS STRING) || '","type":"t","code":"c"}]' END AS otherTagList,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '[{"name":"pt' || CAST(p_partkey % 5 AS STRING) || '","type":"t","code":"c"},{"type":"t"}]' END AS priceTagList,
  CASE WHEN p_partkey % 2 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN '' ELSE '{"name":"hot' || CAST(p_partkey % 7 AS STRING) || '"}' END AS newHotInfo,
  CASE p_partkey % 4 WHEN 0 THEN '开园中' WHEN 1 THEN '已闭园' WHEN 2 THEN '' ELSE NULL END AS openStatus,
  CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS hasVideo,
  CASE WHEN p_partkey % 8 = 7 THEN NULL WHEN p_partkey % 2 = 0 THEN CAST((p_partkey * 37) % 900 AS STRING) || 'm' ELSE CAST((p_partkey * 3) % 45 AS STRING) || '.5km' END AS distanceStr,
  CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE 'http://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg' END AS coverImageUrl,
  CASE WHEN p_partkey % 2 = 0 THEN '[{"k":1,"imageUrl":"http://alt.example.com/' || CAST(p_partkey AS STRING) || '.png"}]' ELSE '{"x":["ftp://no","http://deep.example.com/d.png"]}' END AS imageList,
  'http://poi.example.com/' || CAST(p_partkey AS STRING) AS detailUrl,
  p_name AS shortDesc,
  1704067200000 + (p_partkey % 40) * 86400000 AS ${ts}
FROM ${part}
"""

# All-string landing rows: three crawl versions of every part (v = 0, 1, 2),
# padded names, malformed ids and prices; v = 2 of even keys has no timestamp,
# and the non-null timestamps of one poiId differ, so the newest is unique.
_ODS_VERSION = """
SELECT CASE WHEN p_partkey % 101 = 100 THEN 'N/A' ELSE CAST(p_partkey AS STRING) END AS poiId,
  CASE WHEN p_partkey % 97 = 96 THEN NULL ELSE '  ' || p_name || ' v{v} ' END AS poiName,
  CASE WHEN p_partkey % 37 = 36 THEN 'free' ELSE CAST(p_size * 12 - 24 AS STRING) END AS price,
  CASE WHEN p_partkey % 5 = 0 THEN '0' ELSE CAST(p_size * 15 AS STRING) END AS marketPrice,
  CASE WHEN {v} = 2 AND p_partkey % 2 = 0 THEN NULL ELSE CAST(1704067200000 + p_partkey * 1000 + {v} * 86400000 AS STRING) END AS ${ts}
FROM ${part}"""
ODS_ATTRACTIONS_SQL = "\nUNION ALL\n".join(_ODS_VERSION.replace("{v}", str(v)) for v in range(3))

# Lines are numbered within their order, so ids are unique at any scale as long as an order has fewer
# than 1,000 lines, and fit a bigint up to 9e15 orders.  The poi is the part itself, so the
# item domain grows with ``part``; every 200th part stands for the missing id 0.
BEHAVIORS_SQL = """
SELECT id, user_id, poi_id, kind, occurred_at, is_favorite, rating, stay_seconds,
  CASE WHEN kind = 'detail' THEN min(CASE WHEN kind = 'click' THEN id END) OVER (PARTITION BY order_id) END AS from_click_id,
  image_urls, scene, device
FROM (
  SELECT l_orderkey AS order_id,
    l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS id,
    o_custkey AS user_id, CASE WHEN l_partkey % 200 = 0 THEN 0 ELSE l_partkey END AS poi_id,
    CASE l_linenumber % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'detail' WHEN 2 THEN 'favorite' ELSE 'comment' END AS kind,
    l_shipdate AS occurred_at,
    l_returnflag <> 'R' AS is_favorite,
    CAST(l_quantity AS INT) % 6 AS rating,
    CAST(l_quantity AS INT) * 3 AS stay_seconds,
    CASE WHEN l_linenumber = 3 THEN '' ELSE '["http://img.example.com/' || CAST(l_partkey AS STRING) || '.jpg"]' END AS image_urls,
    'scene' || CAST(l_linenumber AS STRING) AS scene, 'web' AS device
  FROM ${lineitem} JOIN ${orders} ON o_orderkey = l_orderkey) lines
"""

# Requests as the write path gets them: by id, by username (known and unknown) or anonymous.
REQUESTS_SQL = f"""
SELECT id, poi_id, kind, scene, device, occurred_at, is_favorite, rating, stay_seconds, image_urls, from_click_id,
  CASE WHEN id % 7 IN (3, 4, 5) THEN NULL WHEN id % 7 = 6 THEN 0 ELSE user_id END AS user_id,
  CASE id % 7 WHEN 3 THEN 'Customer#' || lpad(CAST(user_id AS STRING), 9, '0') WHEN 4 THEN 'ghost' WHEN 5 THEN '' END AS username
FROM ({BEHAVIORS_SQL}) b
"""

PROFILES_SQL = """
SELECT c_custkey AS id, md5(c_name) AS external_id, c_name AS username,
  'nick' || CAST(c_custkey AS STRING) AS nickname,
  CASE WHEN c_custkey % 9 = 8 THEN '' ELSE 'u' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
  CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender,
  n_name AS city
FROM ${customer} LEFT JOIN ${nation} ON n_nationkey = c_nationkey
"""

# The same tables with every kind of constraint violated by some rows.
BAD_PROFILES_SQL = f"""
SELECT id,
  CASE WHEN id % 50 = 7 THEN 'twin' || CAST(id % 100 AS STRING) ELSE external_id END AS external_id,
  CASE WHEN id % 60 = 9 THEN 'same' || CAST(id % 120 AS STRING) WHEN id % 83 = 0 THEN repeat('u', 51) || CAST(id AS STRING)
    ELSE username END AS username,
  CASE WHEN id % 17 = 0 THEN repeat('n', 51) ELSE nickname END AS nickname,
  CASE WHEN id % 11 = 0 THEN 'robot' WHEN id % 13 = 0 THEN NULL ELSE gender END AS gender,
  CASE WHEN id % 19 = 0 THEN repeat('c', 60) ELSE city END AS city,
  CASE WHEN id % 23 = 0 THEN repeat('1', 21) ELSE '123' END AS phone
FROM ({PROFILES_SQL}) p
"""
BAD_BEHAVIORS_SQL = f"""
SELECT id, kind, CASE WHEN id % 53 = 0 THEN user_id + 1000000000 ELSE user_id END AS user_id,
  CASE WHEN id % 37 = 0 THEN repeat('s', 33) ELSE scene END AS scene,
  CASE WHEN id % 41 = 0 THEN repeat('d', 40) ELSE device END AS device,
  CASE WHEN kind = 'click' THEN CASE WHEN id % 43 = 0 THEN repeat('e', 65) ELSE '' END END AS exposure_id,
  CASE WHEN kind = 'favorite' THEN CASE WHEN id % 47 = 0 THEN repeat('x', 201) ELSE '' END END AS note,
  CASE WHEN kind = 'comment' THEN CASE id % 29 WHEN 0 THEN 9 WHEN 1 THEN -1 ELSE rating END END AS rating,
  CASE WHEN kind = 'detail' THEN CASE WHEN id % 31 = 0 THEN -5 ELSE stay_seconds END END AS stay_seconds
FROM ({BEHAVIORS_SQL}) b
"""

VIEWS = {
    "requests": REQUESTS_SQL,
    "bad_profiles": BAD_PROFILES_SQL,
    "bad_behaviors": BAD_BEHAVIORS_SQL,
    "attractions": ATTRACTIONS_SQL,
    "ods_attractions": ODS_ATTRACTIONS_SQL,
    "behaviors": BEHAVIORS_SQL,
    "profiles": PROFILES_SQL,
}

_TOKEN = re.compile(r"\$\{(\w+)\}")


def render(sql: str, dialect: str, sf_dir: str | None = None) -> str:
    """Replace ``${table}`` / ``${ts}`` tokens for 'spark' (Parquet paths) or 'duckdb' (views)."""
    def sub(m: re.Match) -> str:
        name = m.group(1)
        if name == "ts":
            return "`timestamp`" if dialect == "spark" else '"timestamp"'
        if dialect == "spark":
            return f"parquet.`{sf_dir.rstrip('/')}/{name}.parquet`"
        return name
    return _TOKEN.sub(sub, sql)


#: Lines of whole orders that one task of a derived event log numbers, at any size of the table.
ORDER_ROWS = 500_000


def _by_order(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``lineitem`` in partitions of about ORDER_ROWS lines of whole orders, and ``orders`` hashed, not sorted, in the join.

    The session's shuffle partitions are a fixed number (and are merged by their compressed size), so a task's
    sorts would grow with the table; the count comes from the Parquet footers.  A table that the cores hold
    in one round is left alone.
    """
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    parts = -(-lines.count() // ORDER_ROWS)
    if parts <= spark.sparkContext.defaultParallelism:
        return {"lineitem": lines, "orders": orders}
    return {"lineitem": lines.repartition(parts, "l_orderkey"), "orders": orders.hint("shuffle_hash")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a lazy DataFrame."""
    sql = VIEWS[name]
    if "${lineitem}" not in sql:
        return spark.sql(render(sql, "spark", sf_dir))
    return spark.sql(render(sql.replace("${lineitem}", "{lineitem}").replace("${orders}", "{orders}"), "spark", sf_dir),
                     **_by_order(spark, sf_dir))


def attractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "attractions")


def ods_attractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ods_attractions")


def behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "behaviors")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "profiles")


def with_views(sql: str, *names: str) -> str:
    """DuckDB text: the named views as CTEs in front of ``sql``."""
    ctes = ",\n".join(f"{n} AS ({render(VIEWS[n], 'duckdb')})" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
