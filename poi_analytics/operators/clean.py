"""ODS -> DWD cleaning (C1-C5): trim, typed numbers, required keys, newest row per
poi, discount rate.  Each step is one projection or filter; only the dedupe
shuffles (on poiId)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import columns_of

# The columns forced to a number type when present.
NUMERIC_TYPES = {
    "poiId": "bigint",
    "commentCount": "bigint",
    "price": "double",
    "marketPrice": "double",
    "marketDiscountPrice": "double",
    "underlineDiscountPrice": "double",
    "commentScore": "double",
    "heatScore": "double",
    "latitude": "double",
    "longitude": "double",
    "timestamp": "bigint",
}
REQUIRED = ("poiId", "poiName")


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim (spaces) every string column, in one projection."""
    return df.select(*[F.trim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType)
                       else F.col(f.name) for f in df.schema.fields])


def to_number(c: Column, dtype: str) -> Column:
    """Malformed text -> null under any ANSI setting; '3.7' -> bigint 3."""
    if dtype == "bigint":
        return c.try_cast("decimal(38,18)").try_cast("bigint")
    return c.try_cast(dtype)


def cast_numeric(df: DataFrame) -> DataFrame:
    """Cast whichever of the known numeric columns exist."""
    targets = {c: t for k, t in NUMERIC_TYPES.items() for c in columns_of(df, [k])}
    return df.select(*[to_number(F.col(c), targets[c]).alias(c) if c in targets else F.col(c)
                       for c in df.columns])


def require_keys(df: DataFrame) -> DataFrame:
    """Keep rows whose poiId and poiName are both present."""
    return df.dropna(subset=columns_of(df, REQUIRED))


def dedupe_latest(df: DataFrame) -> DataFrame:
    """C4: one row per poiId, the newest by timestamp (nulls last).

    Ties are broken by the remaining columns so the pick is deterministic.  The
    rank filter sits directly on row_number, so Catalyst plans a partial
    WindowGroupLimit before the shuffle on poiId: a poi repeated a million
    times sends one row per map partition, not all of them.
    """
    key = next(iter(columns_of(df, ["poiId"])), None)
    if key is None:
        return df
    ts = next(iter(columns_of(df, ["timestamp"])), None)
    order = [F.desc_nulls_last(ts)] if ts else []
    order += [F.asc_nulls_last(c) for c in sorted(df.columns) if c not in (key, ts)
              and df.schema[c].dataType.typeName() not in ("map", "variant")]
    if not order:
        order = [F.lit(1)]
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def discount_rate(df: DataFrame) -> DataFrame:
    """Price / marketPrice when marketPrice > 0 and price is present."""
    both = [*columns_of(df, ["price"]), *columns_of(df, ["marketPrice"])]
    if len(both) < 2:
        return df
    p, m = map(F.col, both)
    return df.withColumn("discount_rate", F.when((m > 0) & p.isNotNull(), p / m))


def clean(df: DataFrame) -> DataFrame:
    """The DWD pipeline: trim -> cast -> required keys -> newest per poi -> discount."""
    return discount_rate(dedupe_latest(require_keys(cast_numeric(trim_strings(df)))))


_CAST_SQL = """
SELECT CAST(trunc(TRY_CAST(trim(poiId) AS DECIMAL(38,6))) AS BIGINT) AS poiId, trim(poiName) AS poiName,
  TRY_CAST(trim(price) AS DOUBLE) AS price, TRY_CAST(trim(marketPrice) AS DOUBLE) AS marketPrice,
  CAST(trunc(TRY_CAST(trim("timestamp") AS DECIMAL(38,6))) AS BIGINT) AS "timestamp"
FROM ods_attractions"""

_DEDUPE_SQL = f"""
SELECT poiId, poiName, price, marketPrice, "timestamp" FROM (
  SELECT *, row_number() OVER (PARTITION BY poiId ORDER BY "timestamp" DESC NULLS LAST,
    marketPrice ASC NULLS LAST, poiName ASC NULLS LAST, price ASC NULLS LAST) AS rn
  FROM ({_CAST_SQL}) WHERE poiId IS NOT NULL AND poiName IS NOT NULL) WHERE rn = 1"""

ORACLE = {
    "clean_trim_strings": """
SELECT trim(poiId) AS poiId, trim(poiName) AS poiName, trim(price) AS price, trim(marketPrice) AS marketPrice,
  trim("timestamp") AS "timestamp" FROM ods_attractions""",
    "clean_cast_numeric": _CAST_SQL,
    "clean_require_keys": f"SELECT * FROM ({_CAST_SQL}) WHERE poiId IS NOT NULL AND poiName IS NOT NULL",
    "clean_dedupe_latest": _DEDUPE_SQL,
    "dwd_clean": f"""
SELECT *, CASE WHEN marketPrice > 0 AND price IS NOT NULL THEN price / marketPrice END AS discount_rate
FROM ({_DEDUPE_SQL})""",
}

STEPS = {
    "clean_trim_strings": trim_strings,
    "clean_cast_numeric": lambda df: cast_numeric(trim_strings(df)),
    "clean_require_keys": lambda df: require_keys(cast_numeric(trim_strings(df))),
    "clean_dedupe_latest": lambda df: dedupe_latest(require_keys(cast_numeric(trim_strings(df)))),
    "dwd_clean": clean,
}
