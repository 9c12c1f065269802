"""Province-level region names as one native ``when`` chain (no UDF).

The three look-up tables are fixed values that must equal the source data's
conventions; they are small literal maps, embedded in the plan.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Municipalities and the suffixed name they take.
DIRECT_CITY_SUFFIX = {
    "北京": "北京市",
    "上海": "上海市",
    "天津": "天津市",
    "重庆": "重庆市",
}

# Special regions and their full names.
SPECIAL_REGION_SUFFIX = {
    "内蒙古": "内蒙古自治区",
    "广西": "广西壮族自治区",
    "宁夏": "宁夏回族自治区",
    "新疆": "新疆维吾尔自治区",
    "西藏": "西藏自治区",
    "香港": "香港特别行政区",
    "澳门": "澳门特别行政区",
    "台湾": "台湾省",
}

# City (without a trailing 市) to its province.
CITY_TO_PROVINCE = {
    "长沙": "湖南省",
    "厦门": "福建省",
    "西安": "陕西省",
    "银川": "宁夏回族自治区",
    "桂林": "广西壮族自治区",
    "大理": "云南省",
    "武汉": "湖北省",
    "长春": "吉林省",
    "哈尔滨": "黑龙江省",
    "杭州": "浙江省",
    "南京": "江苏省",
    "成都": "四川省",
    "广州": "广东省",
    "深圳": "广东省",
    "苏州": "江苏省",
    "青岛": "山东省",
    "大连": "辽宁省",
    "沈阳": "辽宁省",
    "济南": "山东省",
    "郑州": "河南省",
    "石家庄": "河北省",
    "太原": "山西省",
    "合肥": "安徽省",
    "南昌": "江西省",
    "福州": "福建省",
    "昆明": "云南省",
    "贵阳": "贵州省",
    "海口": "海南省",
    "兰州": "甘肃省",
    "西宁": "青海省",
    "乌鲁木齐": "新疆维吾尔自治区",
    "拉萨": "西藏自治区",
    "呼和浩特": "内蒙古自治区",
    "南宁": "广西壮族自治区",
}

# Suffixes that already name a province-level region, and the
# suffixes kept as they are.
PROVINCE_SUFFIXES = ("省", "自治区", "特别行政区")
KEEP_SUFFIXES = ("州", "盟")


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def _ends_with_any(c: Column, suffixes) -> Column:
    out = None
    for s in suffixes:
        cond = c.endswith(s)
        out = cond if out is None else (out | cond)
    return out


def normalize_region(name: Column) -> Column:
    """Ordered rules: null/'' unchanged; trim; municipality; special region;
    province suffix kept; city (one trailing 市 stripped) -> province; 州/盟 kept;
    otherwise append 省."""
    t = F.trim(name)
    city = F.when(t.endswith("市"), t.substr(F.lit(1), F.char_length(t) - 1)).otherwise(t)
    return (F.when(name.isNull() | (name == ""), name)
            .when(F.try_element_at(_map(DIRECT_CITY_SUFFIX), t).isNotNull(),
                  F.try_element_at(_map(DIRECT_CITY_SUFFIX), t))
            .when(F.try_element_at(_map(SPECIAL_REGION_SUFFIX), t).isNotNull(),
                  F.try_element_at(_map(SPECIAL_REGION_SUFFIX), t))
            .when(_ends_with_any(t, PROVINCE_SUFFIXES), t)
            .when(F.try_element_at(_map(CITY_TO_PROVINCE), city).isNotNull(),
                  F.try_element_at(_map(CITY_TO_PROVINCE), city))
            .when(_ends_with_any(t, KEEP_SUFFIXES), t)
            .otherwise(F.concat(t, F.lit("省"))))


def _sql_case_map(expr: str, d: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items())
    return f"CASE {expr} {whens} END"


def normalize_region_sql(expr: str) -> str:
    """The same rule as portable SQL (CASE over the literal tables)."""
    t = f"trim({expr})"
    city = f"(CASE WHEN {t} LIKE '%市' THEN substr({t}, 1, length({t}) - 1) ELSE {t} END)"
    direct = _sql_case_map(t, DIRECT_CITY_SUFFIX)
    special = _sql_case_map(t, SPECIAL_REGION_SUFFIX)
    prov = _sql_case_map(city, CITY_TO_PROVINCE)
    ends_prov = " OR ".join(f"{t} LIKE '%{s}'" for s in PROVINCE_SUFFIXES)
    ends_keep = " OR ".join(f"{t} LIKE '%{s}'" for s in KEEP_SUFFIXES)
    return (f"CASE WHEN {expr} IS NULL OR {expr} = '' THEN {expr} "
            f"WHEN {direct} IS NOT NULL THEN {direct} "
            f"WHEN {special} IS NOT NULL THEN {special} "
            f"WHEN {ends_prov} THEN {t} "
            f"WHEN {prov} IS NOT NULL THEN {prov} "
            f"WHEN {ends_keep} THEN {t} "
            f"ELSE {t} || '省' END")
