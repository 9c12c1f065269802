"""Hand-made cases for the column rules: nulls, zeros, empty text, boundaries, malformed JSON."""

import json

from pyspark.sql import functions as F

from poi_analytics.functions.columns import bucketize, columns_of, is_link, pick, with_columns_present
from poi_analytics.functions.images import find_image_url, image_url
from poi_analytics.functions.jsoncols import distance_km, poi_text, tag_tokens, tag_tokens_trimmed
from poi_analytics.functions.regions import normalize_region
from poi_analytics.plans import screen


def _col(spark, values, dtype, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_region_names(spark):
    cases = {
        None: None, "": "", " 北京 ": "北京市", "广西": "广西壮族自治区", "浙江省": "浙江省",
        "厦门市": "福建省", "厦门": "福建省", "延边州": "延边州", "锡林郭勒盟": "锡林郭勒盟",
        "未知地": "未知地省", "内蒙古自治区": "内蒙古自治区", "香港": "香港特别行政区",
    }
    got = _col(spark, list(cases), "string", normalize_region)
    assert got == list(cases.values())


def test_image_url_python_rule():
    cases = [
        ("http://a/x.jpg", "http://a/x.jpg"),
        ("  http://a/y.jpg  ", "http://a/y.jpg"),
        ('["ftp://no", "http://b/1.png"]', "http://b/1.png"),
        (json.dumps([json.dumps(["http://c/2.png"])]), "http://c/2.png"),
        ('{"url": "http://d/3.png", "x": "http://z"}', "http://d/3.png"),
        ('{"imageUrl": "nope", "inner": {"bigImage": "http://e/4.png"}}', "http://e/4.png"),
        ('{"a": {"b": ["http://f/5.png"]}}', "http://f/5.png"),
        ('"http://g/6.png"', "http://g/6.png"),
        ("[]", None), ("{not json", None), ("", None), (None, None),
    ]
    for text, want in cases:
        assert find_image_url(text) == want, text


def test_image_url_column(spark):
    df = spark.createDataFrame(
        [("http://p/1.jpg", '["http://j/1.png"]'), (None, '[{"k": 1, "imageUrl": "http://j/2.png"}]'),
         ("", '{"x": ["ftp://no", "http://j/3.png"]}'), (None, None), (None, "http://plain")],
        "p string, j string")
    got = [r[0] for r in df.select(image_url(F.col("p"), F.col("j"))).collect()]
    assert got == ["http://p/1.jpg", "http://j/2.png", "http://j/3.png", None, "http://plain"]


def test_bucketize_routes_null_to_default(spark):
    rules = [("<=", 0, "free"), ("<", 100, "low")]
    got = _col(spark, [None, -5.0, 0.0, 0.5, 99.99, 100.0], "double", lambda c: bucketize(c, rules, "high"))
    assert got == ["high", "free", "free", "low", "low", "high"]


def test_score_bucket_boundaries(spark):
    got = _col(spark, [None, 0.0, 4.49, 4.5, 5.0, 7.2], "double", screen.score_bucket)
    assert got == [None, "0-1", "4-5", "4-5", "5分+", "5分+"]


def test_distance_units(spark):
    vals = ["450m", "3.5km", "12", None, "far", "1.2KM"]
    legacy = _col(spark, vals, "string", lambda c: distance_km(c, legacy_units=True))
    metric = _col(spark, vals, "string", lambda c: distance_km(c, legacy_units=False))
    assert legacy == [0.45, 0.0035, 12.0, None, None, 0.0012]
    assert metric == [0.45, 3.5, 12.0, None, None, 1.2]


def test_tag_tokens(spark):
    vals = ['["a","b",""]', "x,y,", "[]", None, " p , ,q"]
    assert _col(spark, vals, "string", tag_tokens) == [["a", "b", ""], ["x", "y", ""], [], None, [" p ", " ", "q"]]
    assert _col(spark, vals, "string", tag_tokens_trimmed) == [["a", "b", ""], ["x", "y"], [], [], ["p", "q"]]


def test_poi_text(spark):
    df = spark.createDataFrame(
        [("A", '["f1","f2"]', '["t"]'), (None, "raw, text", None), ("B", '{"k":1}', "[]")],
        "n string, f string, t string")
    got = [r[0] for r in df.select(poi_text(F.col("n"), F.col("f"), F.col("t"))).collect()]
    assert got == ["A. f1 f2. t", ". raw, text.", "B. ."]


def test_presence_helpers(spark):
    df = spark.createDataFrame([("http://x", None, "y")], "CoverImageUrl string, imageUrl string, other string")
    assert columns_of(df, ["nope", "coverimageurl", "imageUrl"]) == ["CoverImageUrl", "imageUrl"]
    row = df.select(pick(df, ["missing", "imageUrl", "other"], merge=True).alias("c"),
                    pick(df, ["imageUrl", "other"]).alias("f"),
                    pick(df, ["other", "coverImageUrl"], keep=is_link).alias("h"),
                    pick(df, ["nope"], default="zz").alias("d")).first()
    assert (row.c, row.f, row.h, row.d) == ("y", None, "http://x", "zz")
    more = with_columns_present(df, other="string", price="double")
    assert more.columns == [*df.columns, "price"] and dict(more.dtypes)["price"] == "double"


def test_numbers_truncate(spark):
    from poi_analytics.operators.clean import to_number
    got = _col(spark, ["3.9999999", "-3.9999999", "9223372036854775807", "x", None], "string",
               lambda c: to_number(c, "bigint"))
    assert got == [3, -3, 9223372036854775807, None, None]


def test_event_date_follows_the_session_zone(spark):
    from poi_analytics.functions.jsoncols import event_date
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        days = {}
        for zone in ("UTC", "Asia/Shanghai"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            days[zone] = str(_col(spark, [1704124800000], "long", event_date)[0])  # 2024-01-01 16:00 UTC
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert days == {"UTC": "2024-01-01", "Asia/Shanghai": "2024-01-02"}


def test_poi_text_of_mixed_lists(spark):
    df = spark.createDataFrame([('["中", "b\\"c"]',), ('["a", 1]',), ('["a", null]',), ("[]",)], "f string")
    got = [r[0] for r in df.select(poi_text(F.lit("N"), F.col("f"), F.lit(None).cast("string"))).collect()]
    assert got == ['N. 中 b"c.', 'N. ["a", 1].', 'N. ["a", null].', "N. ."]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1000, 1000, allow_nan=False)), min_size=1, max_size=30))
def test_bucketize_matches_python_rule(spark, values):
    rules = [("<=", 0, "free"), ("<", 100, "a"), ("<", 200, "b"), ("<", 500, "c")]

    def py(v):
        if v is None:
            return "top"
        for op, bound, label in rules:
            if (op == "<=" and v <= bound) or (op == "<" and v < bound):
                return label
        return "top"
    got = _col(spark, values, "double", lambda c: bucketize(c, rules, "top"))
    assert got == [py(v) for v in values]


def test_top_n_ties_break_by_id(spark):
    from poi_analytics.plans import home
    rows = [(i, f"p{i}", 5.0, 1.0, 9.0 if i in (3, 7, 11) else 1.0, "c") for i in range(20)]
    df = spark.createDataFrame(rows, "poiId long, poiName string, commentScore double, price double, "
                                     "heatScore double, crawlDistrictName string")
    top = [r.poiId for r in home.home_featured(df, limit=4).collect()]
    assert top == [3, 7, 11, 0]
    per_city = [r.poiName for r in home.home_recent_trend(df, per_city=3).collect()]
    assert sorted(per_city) == ["p0", "p1", "p2"]
    cloud = [r.name for r in screen.screen_word_cloud(df.drop("crawlDistrictName"), limit=5).collect()]
    assert cloud == ["p3", "p7", "p11", "p0", "p1"]
