"""Properties, landing round trips, planted-signal recommenders and plan checks."""

import os
import re
import tempfile

import numpy as np
from pyspark.sql import functions as F

from __spark_entry__ import queries
from poi_analytics.operators import behavior, clean, similarity
from poi_analytics.operators import interactions as inter
from poi_analytics.plans import catalog, home, jobs, pages, recommend, schemas, screen
from poi_analytics.sinks import writers
from poi_analytics.sources import fixtures as fx
from poi_analytics.sources import landing


def test_dedupe_idempotent_and_unique(spark, sf_dir):
    dwd = clean.clean(fx.ods_attractions(spark, sf_dir))
    again = clean.dedupe_latest(dwd)
    assert dwd.count() == again.count() == dwd.select("poiId").distinct().count()
    assert dwd.where(F.col("poiId").isNull() | F.col("poiName").isNull()).count() == 0


def test_dedupe_keeps_newest_and_breaks_ties(spark):
    df = spark.createDataFrame(
        [(1, "a", 5), (1, "b", 7), (1, "c", None), (2, "z", 3), (2, "y", 3)], "poiId long, poiName string, timestamp long")
    got = sorted(tuple(r) for r in clean.dedupe_latest(df).collect())
    assert got == [(1, "b", 7), (2, "y", 3)]


def test_cast_numeric_non_ansi_rules(spark):
    df = spark.createDataFrame([("3.7", "x", " 12 ")], "poiId string, price string, heatScore string")
    r = clean.cast_numeric(clean.trim_strings(df)).first()
    assert (r.poiId, r.price, r.heatScore) == (3, None, 12.0)


def test_bucket_counts_sum_to_rows(spark, sf_dir):
    a = fx.attractions(spark, sf_dir)
    n = a.count()
    p = pages.prepare(a)
    for df, col in [(home.home_city_overview(a), "count"), (screen.screen_price_range(a), "value"),
                    (screen.screen_score_distribution(a), "value"), (pages.pages_price_discount(p), "count"),
                    (pages.pages_paid_rate(p), "count"), (pages.pages_media_video(p), "count")]:
        assert df.agg(F.sum(col)).first()[0] == n


def test_negatives_disjoint_from_positives(spark, sf_dir):
    events = {k: behavior.event_table(fx.behaviors(spark, sf_dir), k) for k in behavior.KINDS}
    pos, users, items = inter.indexed_positives(inter.weighted_interactions(events))
    neg = inter.negative_samples(pos, ratio=2)
    assert neg.join(pos, ["user_idx", "item_idx"], "left_semi").count() == 0
    n_users, n_items = users.count(), items.count()
    r = neg.agg(F.min("user_idx"), F.max("user_idx"), F.min("item_idx"), F.max("item_idx")).first()
    assert r[0] >= 0 and r[1] < n_users and r[2] >= 0 and r[3] < n_items


def test_dense_index_is_contiguous(spark, sf_dir):
    events = {k: behavior.event_table(fx.behaviors(spark, sf_dir), k) for k in behavior.KINDS}
    idx = inter.dense_index(inter.weighted_interactions(events), "user_id", "user_idx")
    rows = idx.orderBy("user_id").collect()
    assert [r.user_idx for r in rows] == list(range(len(rows)))


def test_results_independent_of_partitioning(spark, sf_dir):
    q = queries()
    names = ["home_cards", "home_recent_trend", "pages_filter_tags", "dwd_clean", "favorite_state",
             "negative_samples_cf", "dense_index_users", "cosine_top_k"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = {}
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results[parts] = {n: sorted(map(tuple, q[n](spark, sf_dir).collect()),
                                        key=lambda t: tuple((x is None, str(x)) for x in t)) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for n in names:
        assert results["1"][n] == results["13"][n], n


def test_cosine_blocks_do_not_change_result(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = similarity.cosine_top_k(emb, k=5, blocks=(1, 1)).orderBy("query_id", "rank").collect()
    many = similarity.cosine_top_k(emb, k=5, blocks=(3, 4)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.neighbor_id) for r in one] == [(r.query_id, r.neighbor_id) for r in many]
    assert all(r.query_id != r.neighbor_id for r in one)


def test_unit_norms(spark, sf_dir):
    tags = similarity.tag_hash_vector(fx.attractions(spark, sf_dir))
    norms = tags.groupBy("poi_id").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("n"))
    assert norms.where(F.abs(F.col("n") - 1) > 1e-9).count() == 0
    mm = catalog.multimodal_vectors(spark, sf_dir)
    n = mm.select(similarity.l2_norm(F.col("vector")).alias("n"))
    assert n.where(F.abs(F.col("n") - 1) > 1e-9).count() == 0


def test_planted_cf_beats_random(spark):
    # users 0-49 use items 0-19, users 50-99 use items 20-39
    rows = [(u * 100 + i, u, i if u < 50 else 20 + i, 1.0) for u in range(100) for i in range(0, 20, 2)]
    inter_df = spark.createDataFrame(rows, "event_id long, user_id long, poi_id long, weight double")
    pos, users, items = inter.indexed_positives(inter_df)
    model = recommend.cf_train(pos, rank=8, max_iter=10)
    recs = recommend.cf_recommend(model, users, items, k=5)
    hits = recs.where(((F.col("user_id") < 50) & (F.col("poi_id") < 20))
                      | ((F.col("user_id") >= 50) & (F.col("poi_id") >= 20))).count()
    assert hits / recs.count() > 0.9


def test_ctr_model_learns(spark, sf_dir):
    """Held-out rows: users like the items of their own half, and negatives are uniform."""
    rows = [(u * 100 + j, u, (u % 2) * 20 + (u * 7 + j * 3) % 20, 1.0) for u in range(80) for j in range(10)]
    inter_df = spark.createDataFrame(rows, "event_id long, user_id long, poi_id long, weight double")
    pos, _, items = inter.indexed_positives(inter_df)
    dwd = spark.range(40).selectExpr("id AS poiId", "id * 1.0D AS price", "id % 7 * 1.0D AS heatScore", "4.0D AS commentScore",
                                     "concat('d', id % 3) AS districtName")
    feats = inter.item_features(dwd, items)
    frame = inter.ctr_training_frame(inter.training_set(pos, inter.negative_samples(pos, ratio=2)), feats)
    factors = recommend.cf_train(pos.where(~recommend.held_out(pos)), rank=8)
    model = recommend.ctr_train(frame.where(~recommend.held_out(frame)), factors, 3, max_iter=60)
    scored = recommend.ctr_score(model, frame.where(recommend.held_out(frame)), factors)
    assert recommend.auc(scored) > 0.65
    best = recommend.ctr_recommend_user(model, factors, spark.createDataFrame([(5, 0)], "user_id long, user_idx long"),
                                        inter.ctr_item_features(feats), feats, 5, k=4).collect()
    assert [r["rank"] for r in best] == [1, 2, 3, 4]
    new = recommend.ctr_recommend_user(model, factors, spark.createDataFrame([(5, 0)], "user_id long, user_idx long"),
                                       inter.ctr_item_features(feats), feats, 99, k=4).collect()
    assert new == inter.cold_start_items(feats, 4).collect()


def test_favorite_state_with_pairs(spark):
    fav = spark.createDataFrame(
        [(1, 1, 10, True, "2024-01-01"), (2, 1, 10, False, "2024-01-02"), (3, 2, 10, True, "2024-01-01")],
        "id long, user_id long, poi_id long, is_favorite boolean, occurred_at string")
    pairs = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "user_id long, poi_id long")
    got = sorted(tuple(r) for r in behavior.favorite_state(fav, pairs).collect())
    assert got == [(1, 10, False), (2, 10, True), (3, 10, False)]


def test_profile_update_modes(spark):
    prof = spark.createDataFrame([(1, "u1", "n1", "e1"), (2, "u2", "n2", "e2")],
                                 "id long, username string, nickname string, email string")
    upd = spark.createDataFrame([("u1", "new", None)], "username string, nickname string, email string")
    part = {r.username: (r.nickname, r.email) for r in behavior.profile_update(prof, upd, partial=True).collect()}
    full = {r.username: (r.nickname, r.email) for r in behavior.profile_update(prof, upd, partial=False).collect()}
    twice = spark.createDataFrame([("u1", "old", 1), ("u1", "newest", 3), ("u1", "mid", 2)], "username string, nickname string, at int")
    got = behavior.profile_update(prof, twice, order_col="at").where("username = 'u1'").collect()
    assert [(r.nickname, r.email) for r in got] == [("newest", "e1")]
    assert part == {"u1": ("new", "e1"), "u2": ("n2", "e2")}
    assert full == {"u1": ("new", ""), "u2": ("n2", "e2")}


def test_get_or_create_and_delete(spark):
    prof = spark.createDataFrame([(1, "u1", "n", "e", "male", "c", "x-1", "123")], "id long, username string, nickname string, "
                                 "email string, gender string, city string, external_id string, phone string")
    acc = spark.createDataFrame([("u1", "x"), ("demo_user", None), ("new", "m@x.io")], "username string, email string")
    out = {r.username: r for r in behavior.profile_get_or_create(prof, acc).collect()}
    assert set(out) == {"u1", "demo_user", "new"}
    assert out["demo_user"].nickname == behavior.DEMO_NICKNAME and out["demo_user"].email == ""
    assert (out["u1"].email, out["u1"].external_id, out["u1"].phone) == ("e", "x-1", "123")


def test_ingest_always_has_a_user(spark):
    prof = spark.createDataFrame([(4, "u4", "n")], "id long, username string, nickname string")
    req = spark.createDataFrame(
        [(1, 4, None, 7, ["a", "b"]), (2, None, "u4", 7, None), (3, 0, "", 7, []), (4, None, None, 7, ["é"]), (5, 9, "u4", 7, None),
         (6, None, "who", 7, None), (7, 4, None, 0, None)],
        "id long, user_id long, username string, poi_id long, images array<string>")
    got = {r.id: r for r in behavior.ingest(req, prof, "comment").collect()}
    assert [(got[i].user_id, got[i].reject_reason) for i in range(1, 8)] == [
        (4, None), (4, None), (5, None), (5, None), (None, "unknown_user"), (None, "unknown_user"), (4, "missing_poi_id")]
    assert [got[i].image_urls for i in (1, 2, 3, 4)] == ['["a","b"]', "[]", "[]", '["é"]']
    assert all(r.user_id is not None for r in got.values() if r.accepted)


def test_one_registration_per_username(spark):
    reg = spark.createDataFrame([(3, "a", "secret1", ""), (1, "a", "secret1", "x"), (2, "a", "secret1", "a@b.c"), (4, "b", "secret1", "")],
                                "id long, username string, password string, email string")
    got = {r.id: r.reject_reason for r in behavior.registration_check(reg, spark.createDataFrame([("z",)], "username string")).collect()}
    assert got == {1: "invalid_email", 2: None, 3: "username_taken", 4: None}


def test_audit_reports_every_rule(spark, sf_dir):
    rules = {r.rule for r in queries()["constraint_audit"](spark, sf_dir.replace("0.001", "0.01")).select("rule").distinct().collect()}
    assert rules == {"unique_username", "unique_external_id", "gender_choice", "max_length_username", "max_length_nickname",
                     "max_length_phone", "max_length_city", "max_length_scene", "max_length_device", "max_length_exposure_id",
                     "max_length_note", "rating_range", "stay_seconds_nonnegative", "fk_user"}


def test_event_ids_stay_unique_and_fit(spark, sf_dir):
    log = fx.behaviors(spark, sf_dir)
    assert log.select("id").distinct().count() == log.count()
    # sf1000: order keys up to 6e9 in the widest numbering, under 1,000 lines each
    assert 6_000_000_000 * 1000 + 999 < 2**63
    small, large = (fx.behaviors(spark, sf_dir.replace("0.001", sf)).select("poi_id").distinct().count() for sf in ("0.01", "0.1"))
    assert large > 5 * small


def test_weighted_ids_of_separate_tables(spark):
    ev = {k: spark.createDataFrame([(i, 1, i, True) for i in range(1, 4)], "id long, user_id long, poi_id long, is_favorite boolean")
          for k in behavior.KINDS}
    got = inter.weighted_interactions(ev)
    assert got.count() == got.select("event_id").distinct().count() == 12


def test_top_k_of_equal_vectors_and_bad_ones(spark, monkeypatch):
    n = 5000
    df = spark.range(n).selectExpr("id", "array(1.0D, 0.0D) AS v")
    bad = spark.createDataFrame([(n, [float("nan"), 1.0]), (n + 1, None), (n + 2, [None, 1.0]), (n + 3, [2.0, 0.0])],
                                "id long, v array<double>")
    got = similarity.top_k_dot(df.where("id < 20").unionByName(bad), df.unionByName(bad), 5, True, (2, 3))
    rows = got.orderBy("query_id", "rank").collect()
    assert len(rows) == 21 * 5 and all(r.neighbor_id < n or r.neighbor_id == n + 3 for r in rows)
    assert [r.neighbor_id for r in rows[:5]] == [n + 3, 1, 2, 3, 4]
    q, c = np.arange(30), np.arange(4000)
    monkeypatch.setattr(similarity, "CANDIDATE_TILE", 500)
    ids, names, s = similarity._best(q, np.ones((30, 2)), c, np.ones((4000, 2)), 10, True)
    assert len(ids) == 300 and names.max() <= 10
    asked = similarity.top_k_requested(df.where("id = 3"), df.unionByName(bad), 3, True).orderBy("rank").collect()
    assert [r.neighbor_id for r in asked] == [n + 3, 0, 1]


def test_requested_pois_equal_the_full_table(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    full = similarity.cosine_top_k(emb, k=5).where("query_id IN (1, 7)").orderBy("query_id", "rank").collect()
    some = similarity.similar_pois(emb, [1, 7, -1], k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.neighbor_id) for r in full] == [(r.query_id, r.neighbor_id) for r in some]


from poi_analytics.functions.jsoncols import TAG_COLUMNS  # noqa: E402

MART_NEEDS = {
    "screen_map_heat": ["provinceName", "crawlDistrictName"], "screen_word_cloud": ["heatScore", "commentCount"],
    "screen_score_trend": ["timestamp"], "screen_category": ["categoryName", "categoryType", "tagName"],
    "screen_score_distribution": ["commentScore"], "screen_price_range": ["price"], "screen_recommendations": ["heatScore"],
    "home_category_matrix": ["categoryType", "tagName"], "home_price_trend": ["heatScore"],
    "home_recent_trend": ["crawlDistrictName", "districtName"], "home_hot_tags": TAG_COLUMNS,
}


def test_absent_columns_give_empty_marts(spark, sf_dir):
    a = fx.attractions(spark, sf_dir)
    for name, columns in MART_NEEDS.items():
        build = {**screen.BUILDERS, **home.BUILDERS}[name]
        got = build(a.drop(*columns))
        assert got.collect() == [] and got.dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.SCHEMAS[name]], name
    for name in ("screen_word_cloud", "screen_recommendations"):
        assert screen.BUILDERS[name](a.drop("poiName")).collect() == []
    cards = screen.screen_cards(a.drop("poiId", "commentScore", "commentCount")).first()
    assert tuple(cards) == (a.count(), None, 0, 0)
    trend = home.home_price_trend(a.drop("timestamp", "price")).collect()
    assert len(trend) == 1 and trend[0].avgPrice is None and trend[0].avgHeat is not None
    assert screen.screen_score_trend(a.drop("commentScore")).first().avgScore is None
    assert all(r.commentScore is None for r in screen.screen_top_table(a.drop("commentScore")).collect())


def test_written_marts_have_their_declared_schema(spark, sf_dir):
    a = fx.attractions(spark, sf_dir)
    assert set(schemas.SCHEMAS) == {*screen.BUILDERS, *home.BUILDERS, *pages.BUILDERS}
    for family in jobs.FAMILIES:
        d = tempfile.mkdtemp(prefix="marts-")
        for name, target in jobs.run_marts(a, family, d, topn=3).items():
            assert spark.read.parquet(target).schema == schemas.SCHEMAS[name], name
        assert not [x for x in os.listdir(d) if x.startswith("_input")]
    assert spark.read.parquet(jobs.run_marts(a, "home", tempfile.mkdtemp(prefix="marts-"), topn=3)["home_featured"]).count() == 3


def test_summary_documents(spark, sf_dir):
    import json
    a = fx.attractions(spark, sf_dir)
    docs = {}
    for family in jobs.FAMILIES:
        d = tempfile.mkdtemp(prefix="summary-")
        jobs.run_summary(a, family, d)
        lines = [x for x in os.listdir(d + "/document") if x.endswith(".json")]
        docs[family] = json.loads("".join(open(f"{d}/document/{x}").read() for x in lines))
        assert not os.path.exists(d + "/_input")
        if family == "home":
            assert spark.read.json(d + "/rows").count() == home.home_recent_trend(a).count()
    assert list(docs["screen"]) == ["generatedAt", *jobs.SCREEN_KEYS]
    assert list(docs["home"]) == ["generatedAt", *(k for k in jobs.HOME_KEYS if k != "recentTrend")]
    assert list(docs["pages"]) == ["generatedAt", "filter", "price", "family", "media"]
    assert sum(len(docs["pages"][g]) for g in jobs.PAGE_GROUPS) == len(pages.BUILDERS)
    assert docs["home"]["cards"] == home.home_cards(a).first().asDict()
    assert docs["home"]["cityOverview"] == sorted(
        (r.asDict() for r in home.home_city_overview(a).collect()), key=lambda r: r["bucket"])
    assert len(docs["screen"]["topTable"]) == screen.TOPN


def test_training_and_embedding_jobs(spark, sf_dir):
    d = tempfile.mkdtemp(prefix="train-")
    log = inter.weighted_interactions_log(fx.behaviors(spark, sf_dir))
    jobs.train_recommenders(log, fx.attractions(spark, sf_dir), d)
    assert sorted(os.listdir(d)) == ["cf", "ctr", "item_features", "items", "users"]
    jobs.build_embeddings(spark.createDataFrame([(1, "a b"), (2, None)], "poi_id long, text string"), d + "/vectors")
    got = {r.poi_id: np.linalg.norm(r.vector) for r in spark.read.parquet(d + "/vectors").collect()}
    assert abs(got[1] - 1) < 1e-9 and got[2] == 0


def test_headers_that_differ_are_an_error(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="landing-")
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "y,x\n3,4\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="header"):
        landing.read_landing_csv(spark, d).collect()


def test_checkpoint_folder_is_required_on_a_cluster():
    import pytest

    from poi_analytics.session import checkpoint_dir

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_recommender_plan_is_small(spark, sf_dir):
    text = spark._jvm.PythonSQLUtils.explainString(queries()["ctr_training_frame"](spark, sf_dir)._jdf.queryExecution(), "simple")
    shuffles = re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", text)
    assert len(shuffles) <= 12, len(shuffles)


def test_landing_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="landing-")
    path = os.path.join(d, "a.csv")
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write('poiId,poiName,note\n1,"say ""hi""","line one\nline two"\n2,plain,x\n')
    df = landing.read_landing_csv(spark, path, multiline=True)
    rows = df.orderBy("poiId").collect()
    assert df.columns == ["poiId", "poiName", "note"]
    assert [(r.poiId, r.poiName, r.note) for r in rows] == [("1", 'say "hi"', "line one\nline two"), ("2", "plain", "x")]


def test_card_flatten_envelope_and_nesting(spark):
    df = spark.createDataFrame([('{"card": {"a": 1, "b": [1, 2], "c": {"x": "中"}}}',), ('{"a": "z", "d": null}',)],
                               "raw string")
    rows = landing.card_flatten(df, "raw", ["a", "b", "c", "d"]).collect()
    assert tuple(rows[0]) == ("1", "[1,2]", '{"x":"中"}', None)
    assert tuple(rows[1]) == ("z", None, None, None)


def test_writers(spark, sf_dir):
    d = tempfile.mkdtemp(prefix="sink-")
    mart = home.home_city_overview(fx.attractions(spark, sf_dir))
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
    schema = StructType([StructField("bucket", StringType()), StructField("count", LongType()),
                         StructField("avgScore", DoubleType())])
    writers.write_mart(mart.where("false"), d + "/empty", schema)
    assert spark.read.parquet(d + "/empty").schema == schema
    writers.write_landing(mart, d + "/land", overwrite=False)
    writers.write_landing(mart.limit(1), d + "/land", overwrite=False)  # ignored: target exists
    assert spark.read.option("header", True).csv(d + "/land").count() == mart.count()
    doc = writers.summary_document({"a": mart, "b": mart.limit(0), "g": {"c": mart}}, generated_at="t")
    r = doc.first()
    assert r.generatedAt == "t" and r.b == [] and len(r.a) == mart.count() and r.g.c == r.a


def test_plans_stay_native_and_limit_windows(spark, sf_dir):
    a = fx.attractions(spark, sf_dir)
    for name, fn in {**home.BUILDERS, **pages.BUILDERS}.items():
        df = fn(pages.prepare(a)) if name.startswith("pages") else fn(a)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name
    plan = home.home_recent_trend(a)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    plan = clean.clean(fx.ods_attractions(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_text_vectors_read_whole_texts(spark):
    long_text = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(1, long_text), (2, long_text + " extra"), (3, ""), (4, None)], "id long, t string")
    v = {r.poi_id: np.array(r.vector) for r in similarity.text_vector_dense(df, "id", "t").collect()}
    assert not np.allclose(v[1], v[2])
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-9 and not v[3].any() and not v[4].any()


def test_embed_batch_takes_a_model(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], np.float32)
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    assert [r[0] for r in df.select(recommend.embed_batch(F.col("t"), make, dim=2)).collect()] == [[3.0, 1.0], [0.0, 1.0]]


def test_mart_job_and_layers(spark, sf_dir):
    d = tempfile.mkdtemp(prefix="jobs-")
    jobs.build_dwd(fx.ods_attractions(spark, sf_dir), d + "/dwd", repartition=2)
    dwd = spark.read.parquet(d + "/dwd")
    assert dwd.count() == clean.clean(fx.ods_attractions(spark, sf_dir)).count()
    a = fx.attractions(spark, sf_dir)
    targets = jobs.run_marts(a, "pages", d + "/marts")
    assert len(targets) == len(pages.BUILDERS)
    got = sorted(map(tuple, spark.read.parquet(targets["pages_filter_city"]).collect()))
    want = sorted(map(tuple, pages.pages_filter_city(pages.prepare(a)).collect()))
    assert got == want


def test_factor_and_model_writes(spark):
    from pyspark.ml.recommendation import ALSModel
    d = tempfile.mkdtemp(prefix="factors-")
    rows = [(u * 10 + i, u, i, 1.0) for u in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, poi_id long, weight double")
    pos, users, items = inter.indexed_positives(df)
    model = recommend.cf_train(pos, rank=4, max_iter=2)
    writers.write_factors(model.itemFactors, d + "/items")
    writers.save_model(model, d + "/als")
    assert spark.read.parquet(d + "/items").count() == 5
    assert ALSModel.load(d + "/als").rank == 4


def test_account_view_and_decimals(spark):
    from poi_analytics.functions.columns import decimals_to_double
    acc = spark.createDataFrame([(1, "u", "e")], "id long, username string, email string")
    assert behavior.account_view(acc).columns == behavior.ACCOUNT_FIELDS
    dec = spark.createDataFrame([(1,)], "x int").selectExpr("CAST(1.25 AS DECIMAL(10,2)) AS p", "x")
    out = decimals_to_double(dec)
    assert dict(out.dtypes) == {"p": "double", "x": "int"} and out.first().p == 1.25


def test_stream_ingest_resumes_from_checkpoint(spark, sf_dir):
    from poi_analytics.streaming import ingest as stream
    base = stream.scratch_path(spark, "resume")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ev.where("event_id % 2 = 0").write.mode("append").parquet(base + "/in")
    src = lambda: stream.event_source(spark, base + "/in", "*.parquet", ev.schema)
    prof = fx.profiles(spark, sf_dir)
    stream.run_append(stream.ingest_events(stream.events_to_requests(src()), prof), base + "/out", base + "/ck")
    first = spark.read.parquet(base + "/out").count()
    ev.where("event_id % 2 = 1").write.mode("append").parquet(base + "/in")
    stream.run_append(stream.ingest_events(stream.events_to_requests(src()), prof), base + "/out", base + "/ck")
    total = spark.read.parquet(base + "/out")
    assert first == ev.where("event_id % 2 = 0").count()
    assert total.count() == ev.count() and total.select("id").distinct().count() == ev.count()


def test_streamed_requests_of_all_kinds_keep_their_columns(spark):
    from poi_analytics.streaming import ingest as stream
    base = stream.scratch_path(spark, "all-kinds")
    prof = spark.createDataFrame([(4, "u4", "n")], "id long, username string, nickname string")
    spark.createDataFrame(
        [(1, "favorite", 7, False, None, None, None, None, None), (2, "favorite", 7, None, None, None, None, None, None),
         (3, "comment", 7, None, 5, "good", ["a"], None, None), (4, "comment", 7, None, None, None, None, None, None),
         (5, "detail", 7, None, None, None, None, 30, 9), (6, "click", 7, True, 3, "x", ["b"], 1, 1),
         (7, "share", 7, True, 3, "x", ["b"], 1, 1), (8, None, 7, None, None, None, None, None, None)],
        "id long, kind string, poi_id long, is_favorite boolean, rating int, content string, images array<string>, "
        "stay_seconds int, from_click_id long").withColumn("user_id", F.lit(4)).write.parquet(base + "/in")
    src = stream.event_source(spark, base + "/in", "*.parquet", spark.read.parquet(base + "/in").schema)
    stream.run_append(stream.ingest_events(src, prof), base + "/out", base + "/ck")
    rows = {r.id: r for r in spark.read.parquet(base + "/out").collect()}
    own = ["is_favorite", "rating", "content", "image_urls", "stay_seconds", "from_click_id", "exposure_id"]
    assert {i: tuple(r[c] for c in own) for i, r in rows.items()} == {
        1: (False, None, None, None, None, None, None), 2: (True, None, None, None, None, None, None),
        3: (None, 5, "good", '["a"]', None, None, None), 4: (None, 0, "", "[]", None, None, None),
        5: (None, None, None, None, 30, 9, None), 6: (None, None, None, None, None, None, ""),
        7: (None,) * 7, 8: (None,) * 7}
    assert [rows[i].reject_reason for i in range(1, 9)] == [None] * 6 + ["unknown_kind"] * 2
    assert all(r.occurred_at is not None for r in rows.values())


def test_no_cross_joins_or_row_udfs_in_any_plan(spark, sf_dir):
    jvm = spark._jvm
    bad = []
    for name, q in sorted(catalog.QUERIES.items()):
        text = jvm.PythonSQLUtils.explainString(q(spark, sf_dir)._jdf.queryExecution(), "formatted")
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if k in text]
        if hits:
            bad.append((name, hits))
    assert bad == []


def test_favorite_state_stream_updates_across_batches(spark, sf_dir):
    from poi_analytics.streaming import ingest as stream
    base = stream.scratch_path(spark, "fav-updates")
    fav = behavior.event_table(fx.behaviors(spark, sf_dir), "favorite").cache()
    cut = fav.approxQuantile("id", [0.5], 0.0)[0]
    fav.where(F.col("id") <= cut).write.mode("append").parquet(base + "/in")
    src = lambda: stream.event_source(spark, base + "/in", "*.parquet", fav.schema)
    stream.run_state_updates(stream.favorite_state_stream(src()), base + "/state", base + "/ck")
    fav.where(F.col("id") > cut).write.mode("append").parquet(base + "/in")
    stream.run_state_updates(stream.favorite_state_stream(src()), base + "/state", base + "/ck")
    got = sorted(map(tuple, stream.latest_state(spark, base + "/state", ["user_id", "poi_id"]).collect()))
    want = sorted(map(tuple, behavior.favorite_state(fav).collect()))
    assert got == want
    fav.unpersist()


def test_negative_draws_reach_indexes_beyond_32_bits(spark):
    from pyspark.sql import functions as F

    from poi_analytics.operators.interactions import negative_samples
    largest = 1 << 40
    pos = spark.range(2000).select(F.col("id").alias("event_id"), F.lit(largest).alias("user_idx"), F.lit(3).alias("item_idx"),
                                   F.lit(1.0).alias("weight"))
    drawn = [r.user_idx for r in negative_samples(pos).select("user_idx").collect()]
    assert sum(d > largest // 2 for d in drawn) in range(800, 1200)
    assert max(drawn) <= largest


def test_event_log_is_cut_into_bounded_partitions(spark, sf_dir, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    names = ["behaviors", "requests", "bad_behaviors"]
    want = {n: rows(fx.view(spark, sf_dir, n)) for n in names}
    monkeypatch.setattr(fx, "ORDER_ROWS", 500)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for n in names:
        got = fx.view(spark, sf_dir, n)
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
        assert f", {-(-lines // 500)}), REPARTITION_BY_NUM" in plan
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert rows(got) == want[n]


def test_no_log_is_sorted_for_a_look_up(spark, sf_dir):
    for name in ("ingest_detail_view", "set_null_on_delete"):
        plan = spark._jvm.PythonSQLUtils.explainString(queries()[name](spark, sf_dir)._jdf.queryExecution(), "simple")
        assert "ShuffledHashJoin" in plan, name
