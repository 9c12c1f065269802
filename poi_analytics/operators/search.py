"""Attraction search (D1-D8) and generic table search.

Filters become ``Column`` predicates over the DWD table; Catalyst pushes the
simple ones (district id, price range, poiId) into the Parquet scan.  The count
and the page share one filtered frame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Searched text columns, listing columns and the level choices.
KEYWORD_COLUMNS = ["poiName", "zoneName", "districtName", "shortFeatures", "tagNameList"]
SEARCH_COLUMNS = [
    "poiId", "poiName", "districtId", "districtName", "zoneName", "sightLevelStr", "commentScore",
    "commentCount", "heatScore", "shortFeatures", "tagNameList", "priceTagList", "price", "marketPrice",
    "marketDiscountPrice", "underlineDiscountPrice", "priceTypeDesc", "detailUrl", "coverImageUrl",
    "timestamp", "discount_rate",
]
OTHER_LEVEL = "其他"
NAMED_LEVELS = ("5a", "4a", "3a")
PAGE_SIZE = 10
ABSENT = (None, "", "null")


def _like(c: Column, text: str, literal: bool) -> Column:
    low = F.lower(c)
    return low.contains(text) if literal else low.like(f"%{text}%")


def keyword_predicate(keyword: str, literal: bool = False) -> Column | None:
    """Lower-cased keyword in any searched column; '%'/'_' act as wildcards
    unless ``literal``; null cells never match."""
    kw = (keyword or "").strip().lower()
    if not kw:
        return None
    out = None
    for c in KEYWORD_COLUMNS:
        p = _like(F.col(c), kw, literal)
        out = p if out is None else (out | p)
    return out


def district_predicate(district) -> Column | None:
    """All digits -> districtId equality; otherwise a name LIKE."""
    d = str(district or "").strip()
    if not d:
        return None
    if d.isdigit():
        return F.col("districtId") == F.lit(int(d))
    return F.lower(F.col("districtName")).like(f"%{d.lower()}%")


def level_predicate(level) -> Column | None:
    """D3: '其他' -> not one of 5A/4A/3A (or no level); else case-insensitive equality."""
    if not level:
        return None
    if level == OTHER_LEVEL:
        c = F.col("sightLevelStr")
        return (~F.lower(c).isin(*NAMED_LEVELS)) | c.isNull()
    return F.lower(F.col("sightLevelStr")) == F.lit(str(level).lower())


def price_predicate(min_price=None, max_price=None) -> Column | None:
    """Inclusive bounds; '', None and 'null' mean no bound."""
    out = None
    if min_price not in ABSENT:
        out = F.col("price") >= F.lit(float(min_price))
    if max_price not in ABSENT:
        p = F.col("price") <= F.lit(float(max_price))
        out = p if out is None else (out & p)
    return out


def tag_predicate(tag) -> Column | None:
    """Lower-cased tag text in tagNameList."""
    t = (tag or "").strip().lower()
    return F.lower(F.col("tagNameList")).like(f"%{t}%") if t else None


def filter_predicate(filters: Mapping) -> Column | None:
    parts = [keyword_predicate(filters.get("keyword"), bool(filters.get("literal"))),
             district_predicate(filters.get("district")),
             level_predicate(filters.get("sightLevel")),
             price_predicate(filters.get("minPrice"), filters.get("maxPrice")),
             tag_predicate(filters.get("tagName"))]
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else (out & p)
    return out


def search_filter(df: DataFrame, filters: Mapping) -> DataFrame:
    """D1-D5 AND-ed."""
    pred = filter_predicate(filters)
    return df.where(pred) if pred is not None else df


def search_page(df: DataFrame, filters: Mapping, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """The listing columns of page ``page``, hottest first (ties by poiId).

    Planned as one TakeOrderedAndProject with an offset: each partition keeps
    only its best ``page * page_size`` rows.
    """
    offset = max(int(page) - 1, 0) * int(page_size)
    cols = [c for c in SEARCH_COLUMNS if c in df.columns]
    return (search_filter(df, filters).select(*cols)
            .orderBy(F.desc_nulls_last("heatScore"), F.asc_nulls_first("poiId"))
            .offset(offset).limit(int(page_size)))


def search_count(df: DataFrame, filters: Mapping) -> DataFrame:
    """COUNT(1) of the same predicate."""
    return search_filter(df, filters).agg(F.count(F.lit(1)).alias("count"))


def poi_detail(df: DataFrame, poi_id: int) -> DataFrame:
    """Every column of one poi (at most one row)."""
    return df.where(F.col("poiId") == F.lit(int(poi_id))).limit(1)


def search_table(df: DataFrame, text: str | None = None, fields: Sequence[str] = (),
                 facets: Mapping | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Case-insensitive 'contains' over ``fields`` (OR), equality facets (AND)."""
    out = df
    t = (text or "").strip().lower()
    if t and fields:
        pred = None
        for f in fields:
            p = F.lower(F.col(f).cast("string")).contains(t)
            pred = p if pred is None else (pred | p)
        out = out.where(pred)
    for k, v in (facets or {}).items():
        out = out.where(F.col(k) == F.lit(v))
    return out.select(*columns) if columns else out


# ---- registered cases and their DuckDB statements ----------------------------

_COLS = ", ".join(f'"{c}"' for c in SEARCH_COLUMNS)
# The DWD view used by search: attractions plus the derived discount rate.
DWD_SQL = ("SELECT *, CASE WHEN marketPrice > 0 AND price IS NOT NULL THEN price / marketPrice END "
           "AS discount_rate FROM attractions")

CASES = {
    "search_keyword": {"keyword": " Ring "},
    "search_district": {"district": "广州"},
    "search_district_id": {"district": "12"},
    "search_level": {"sightLevel": OTHER_LEVEL},
    "search_level_named": {"sightLevel": "4A"},
    "search_price_range": {"minPrice": "50", "maxPrice": 200, "district": ""},
    "search_price_min": {"minPrice": 120, "maxPrice": "null"},
    "search_tag": {"tagName": "Small"},
}
PAGE_CASE = {"keyword": "o", "minPrice": 0, "maxPrice": "500"}
PAGE_NO = 3
DETAIL_ID = 42

_CASE_WHERE = {
    "search_keyword": " OR ".join(f"lower({c}) LIKE '%ring%'" for c in KEYWORD_COLUMNS),
    "search_district": "lower(districtName) LIKE '%广州%'",
    "search_district_id": "districtId = 12",
    "search_level": "(lower(sightLevelStr) NOT IN ('5a', '4a', '3a') OR sightLevelStr IS NULL)",
    "search_level_named": "lower(sightLevelStr) = '4a'",
    "search_price_range": "price >= 50 AND price <= 200",
    "search_price_min": "price >= 120",
    "search_tag": "lower(tagNameList) LIKE '%small%'",
}
_PAGE_WHERE = ("(" + " OR ".join(f"lower({c}) LIKE '%o%'" for c in KEYWORD_COLUMNS) + ")"
               " AND price >= 0 AND price <= 500")

ORACLE = {name: f"SELECT {_COLS} FROM ({DWD_SQL}) WHERE {w}" for name, w in _CASE_WHERE.items()}
ORACLE["search_page"] = (f"SELECT {_COLS} FROM ({DWD_SQL}) WHERE {_PAGE_WHERE} "
                         f"ORDER BY heatScore DESC NULLS LAST, poiId ASC NULLS FIRST "
                         f"LIMIT {PAGE_SIZE} OFFSET {(PAGE_NO - 1) * PAGE_SIZE}")
ORACLE["search_count"] = f"SELECT count(*) AS count FROM ({DWD_SQL}) WHERE {_PAGE_WHERE}"
ORACLE["poi_detail"] = f"SELECT * FROM ({DWD_SQL}) WHERE poiId = {DETAIL_ID} LIMIT 1"
