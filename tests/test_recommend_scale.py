"""Neighbour index, click scores by blocks, ranking quality, published models, stored layers."""

import os
import tempfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from __spark_entry__ import queries
from poi_analytics.operators import interactions as inter
from poi_analytics.operators import lsh, ranking, similarity
from poi_analytics.plans import layers, recommend
from poi_analytics.sinks import models, profile_store, writers
from poi_analytics.sources import fixtures as fx
from poi_analytics.sources import landing


def plan_of(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


# ---- neighbour index -----------------------------------------------------------------

def clustered(spark, n=600, clusters=12, dim=16):
    r = np.random.default_rng(2)
    centres = r.normal(size=(clusters, dim))
    rows = [(i, (centres[i % clusters] + 0.15 * r.normal(size=dim)).astype(np.float32).tolist(), i % clusters) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_lsh_recall_is_measured_and_high(spark, sf_dir):
    rows = queries()["cosine_top_k_lsh"](spark, sf_dir).collect()
    assert len({r.recall for r in rows}) == 1 and rows[0].recall >= 0.88  # 500 vectors without any clusters
    got = lsh.cosine_top_k_lsh(clustered(spark), clustered(spark).where("vec_id % 20 = 0"), bits=8, tables=12).collect()
    assert got[0].recall >= 0.9


def test_lsh_pieces_lose_nothing(spark, monkeypatch):
    vectors = clustered(spark)
    index = lsh.build_lsh_index(vectors, tempfile.mkdtemp(prefix="lsh-") + "/i", bits=3, tables=2)
    unit = similarity._unit(vectors, "vec_id", "embedding")
    asked = unit.where("id % 20 = 0")
    key = ["query_id", "rank", "neighbor_id"]
    whole = sorted(map(tuple, lsh.lsh_top_k(asked, index, 5).select(key).collect()))
    monkeypatch.setattr(lsh, "PIECE_ROWS", 7)
    monkeypatch.setattr(lsh, "PIECE_QUERIES", 3)
    assert sorted(map(tuple, lsh.lsh_top_k(asked, index, 5).select(key).collect())) == whole
    assert len(whole) == 5 * asked.count()


def test_lsh_index_serves_requested_rows_and_skips_bad_ones(spark):
    d = tempfile.mkdtemp(prefix="lsh-") + "/i"
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [-1.0, 0.1]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 0.0])]
    index = lsh.build_lsh_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), d, bits=4, tables=8)
    assert sorted(os.listdir(d))[-8:] == [f"tab={t}" for t in range(8)]
    assert {r.id for r in index.rows(spark).select("id").distinct().collect()} == {1, 2, 3, 6}
    got = lsh.similar_pois_lsh(spark, index, [1, 99], k=1).collect()
    assert [(r.query_id, r.neighbor_id) for r in got] == [(1, 2)]


def test_blocks_follow_row_counts(spark, monkeypatch):
    vectors = similarity._unit(clustered(spark), "vec_id", "embedding")
    key = ["query_id", "rank", "neighbor_id"]
    whole = sorted(map(tuple, similarity.top_k_dot(vectors, vectors, 4, True).select(key).collect()))
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 100)
    monkeypatch.setattr(similarity, "CANDIDATE_BLOCK", 64)
    rows = spark.range(1).select(similarity.blocks_of(vectors, 100).alias("q"), similarity.blocks_of(vectors, 64).alias("c"),
                                 similarity.blocks_of(vectors.limit(0), 64).alias("none")).first()
    assert tuple(rows) == (6, 10, 1)
    assert sorted(map(tuple, similarity.top_k_dot(vectors, vectors, 4, True).select(key).collect())) == whole


def by_sorting(qid, qv, cid, cv, k):
    """Each query's best ``k`` others, all scores sorted."""
    out = []
    for i, v in zip(qid, qv):
        s = np.where(cid == i, -np.inf, np.einsum("id,jd->ij", v[None], cv)[0])
        order = np.lexsort((cid, -s))[:k]
        out += [(i, cid[j], s[j]) for j in order if s[j] > -np.inf]
    return out


@pytest.mark.parametrize("kind", ["normal", "zeros", "copies", "near", "mixed", "big", "few"])
def test_screened_tiles_choose_as_sorting_does(kind):
    r = np.random.default_rng(4)
    q, c = r.normal(size=(300, 8)), r.normal(size=(5_000, 8))
    q, c = {"normal": (q, c), "zeros": (q * 0, c * 0), "copies": (np.repeat(q[:3], 100, 0), np.repeat(c[:5], 1_000, 0)),
            "near": (1 + 1e-9 * q, 1 + 1e-9 * c), "mixed": (np.exp(20 * q), np.exp(20 * c)), "big": (1e30 * q, 1e30 * c),
            "few": (q[:7], c[:5])}[kind]
    qid, cid = np.arange(len(q)), r.permutation(len(c))
    got, want = list(zip(*similarity._best(qid, q, cid, c, 10, True))), by_sorting(qid, q, cid, c, 10)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-12)


def test_blocks_are_large_and_bounded_in_bytes(spark):
    # 900,000 users against 1,200,000 items: rows shipped to block pairs (330 million with blocks of 4,096 and 16,384)
    n, m = 900_000, 1_200_000
    assert -(-n // similarity.QUERY_BLOCK) * m + -(-m // similarity.CANDIDATE_BLOCK) * n < 60e6
    wide = spark.range(100).select("id", F.array_repeat(F.lit(1.0), 640).alias("v"))
    assert spark.range(1).select(similarity.blocks_of(wide, 100)).first()[0] == 20  # as long as 2,000 rows of 32 numbers


def test_factors_of_floats_score_as_doubles(spark):
    vectors = similarity._unit(clustered(spark, 200), "vec_id", "embedding").select("id", F.col("v").cast("array<float>").alias("v"))
    doubles = vectors.select("id", similarity.as_double_array(F.col("v")).alias("v"))
    assert sorted(similarity.top_k_dot(vectors, vectors, 3).collect()) == sorted(similarity.top_k_dot(doubles, doubles, 3).collect())


@pytest.mark.parametrize("name", ["text_embeddings", "multimodal_vector"])
def test_vectors_are_not_broadcast(spark, sf_dir, name):
    # the planner takes them for as small as the compressed table they come from
    plan = plan_of(spark, queries()[name](spark, sf_dir))
    assert plan.count("SortMergeJoin") == {"text_embeddings": 1, "multimodal_vector": 2}[name]


def test_multimodal_vector_without_text_or_image(spark):
    pois = spark.createDataFrame([(1, '["a"]'), (2, None), (3, '["a","b"]')], "poiId long, tagNameList string")
    images = spark.createDataFrame([(1, [3.0, 4.0])], "poi_id long, image array<double>")
    texts = spark.createDataFrame([(1, "x y"), (2, " "), (2, "")], "poi_id long, text string")
    got = {r.poi_id: r.vector for r in similarity.multimodal_vectors(pois, images, texts, 2).collect()}
    assert set(got) == {1, 2, 3} and all(len(v) == 2 + 2 + similarity.TAG_BUCKETS for v in got.values())
    assert all(sum(x * x for x in v) == pytest.approx(1) for v in got.values())
    assert got[2][:4] == got[3][:4] == [0.0] * 4 and got[1][0] / got[1][1] == pytest.approx(0.75)


# ---- click models ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def planted(spark):
    """Users like the items of their own half; negatives are uniform."""
    rows = [(u * 100 + j, u, (u % 2) * 20 + (u * 7 + j * 3) % 20, 1.0) for u in range(80) for j in range(10)]
    pos, users, items = inter.indexed_positives(spark.createDataFrame(rows, "event_id long, user_id long, poi_id long, weight double"))
    dwd = spark.range(40).selectExpr("id AS poiId", "id * 1.0D AS price", "id % 7 * 1.0D AS heatScore", "4.0D AS commentScore",
                                     "concat('d', id % 3) AS districtName")
    feats = inter.item_features(dwd, items)
    frame = inter.ctr_training_frame(inter.training_set(pos, inter.negative_samples(pos, ratio=2)), feats)
    factors = recommend.cf_train(pos.where(~recommend.held_out(pos)), rank=8)
    model = recommend.ctr_train(frame.where(~recommend.held_out(frame)), factors, max_iter=60)
    return model, factors, frame, feats, users, pos


def every_pair(spark, planted):
    model, factors, _, feats, users, _ = planted
    items = inter.ctr_item_features(feats).collect()
    pairs = spark.createDataFrame([(u.user_id, u.user_idx, *i) for u in users.collect() for i in items],
                                  "user_id long, user_idx long, item_idx long, poi_id long, district_idx long, price double, heat double, score double")
    want = {}
    for r in recommend.ctr_score(model, pairs, factors).collect():
        want.setdefault(r.user_id, []).append((-r.click_prob, r.poi_id))
    return {u: sorted(v) for u, v in want.items()}


@pytest.mark.parametrize("tile", [(32, 2_048), (3, 7)])
def test_block_scores_equal_the_model_on_every_pair(spark, planted, monkeypatch, tile):
    model, factors, _, feats, users, _ = planted
    monkeypatch.setattr(recommend.CtrNetwork, "USERS", tile[0])
    monkeypatch.setattr(recommend.CtrNetwork, "ITEMS", tile[1])
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 16)
    monkeypatch.setattr(similarity, "CANDIDATE_BLOCK", 9)
    got = {}
    for r in recommend.ctr_recommend_users(model, factors, users, inter.ctr_item_features(feats), feats, k=6).collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.poi_id, r.click_prob))
    want = every_pair(spark, planted)
    assert set(got) == set(want)
    for u, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == [1, 2, 3, 4, 5, 6]
        probs = {p: -c for c, p in want[u]}
        for (_, poi, prob), (best, _) in zip(found, want[u]):
            assert prob == pytest.approx(probs[poi], abs=1e-9) and prob == pytest.approx(-best, abs=1e-9)


def test_large_first_layer_parts_are_screened_too(planted):
    net, r = recommend.CtrNetwork.of(planted[0], 8), np.random.default_rng(3)
    for scale in (1, 10, 30):  # the last is beyond what the product of exponentials holds
        u, i = scale * r.normal(size=(20, 64)), scale * r.normal(size=(700, 64))
        q, c = (recommend.pd.DataFrame({"id": range(len(x)), "h": list(x)}) for x in (u, i))
        got = list(zip(*net.best(5)(q, c)))
        every = recommend._sigmoid(net.logit(u[:, None] + i[None]))
        assert [x[:2] for x in got] == [(a, b) for a in range(20) for b in np.lexsort((np.arange(700), -every[a]))[:5]]


@pytest.mark.parametrize("most", [2_000_000, 100, 7])
def test_cells_score_every_row_as_the_model_does(spark, planted, monkeypatch, most):
    model, factors, frame, *_ = planted
    monkeypatch.setattr(recommend, "CELL_ROWS", most)
    strange = frame.limit(3).withColumn("user_idx", F.lit(10_000).cast("long"))  # no factors, so no score
    key = ["user_idx", "item_idx", "label"]
    out = model.transform(recommend.ctr_features(frame, factors)).select(*key, recommend.vector_to_array("probability")[1].alias("p"))
    want, got = sorted(out.collect()), recommend.ctr_score(model, frame.unionByName(strange), factors)
    assert got.columns == [*frame.columns, "click_prob"]
    got = sorted(got.select(*key, "click_prob").collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-12)
    plan = plan_of(spark, recommend.ctr_score(model, frame, factors))
    assert "SortMergeJoin" not in plan  # no factor is joined to a row


def test_users_without_factors_get_the_cold_start_list(spark, planted):
    model, factors, _, feats, _, _ = planted
    new = spark.createDataFrame([(999, 5_000)], "user_id long, user_idx long")
    got = recommend.ctr_recommend_users(model, factors, new, inter.ctr_item_features(feats), feats, k=3).orderBy("rank").collect()
    assert [(r["rank"], r.poi_id) for r in got] == [tuple(r) for r in inter.cold_start_items(feats, 3).collect()]
    assert all(r.click_prob is None and r.user_id == 999 for r in got)


def test_factorization_machine_learns_with_a_bounded_model(spark, planted):
    frame = planted[2]
    train, test = frame.where(~recommend.held_out(frame)), frame.where(recommend.held_out(frame))
    model = recommend.fm_train(train, buckets=1 << 10, max_iter=60)
    assert model.numFeatures == 1 << 10 and model.factors.numRows == 1 << 10
    scored = recommend.fm_score(model, test)
    assert ranking.auc(scored, "click_prob").first().auc > 0.7
    assert scored.count() == test.count()


def test_fit_rows_are_bounded(spark, planted):
    frame = planted[2]
    assert recommend.fit_rows(frame, 10**9).count() == frame.count()
    assert 0.3 * 500 < recommend.fit_rows(frame, 500).count() < 2 * 500
    assert recommend.fit_rows(frame.limit(0), 10).count() == 0


# ---- ranking quality --------------------------------------------------------------------

def brute_auc(rows):
    rows = [(s, y) for s, y in rows if s is not None and y is not None]
    pos, neg = [s for s, y in rows if y > 0], [s for s, y in rows if y <= 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return len(pos), len(neg), wins / (len(pos) * len(neg)) if pos and neg else None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3).map(float)), st.sampled_from([0.0, 1.0, None])), max_size=60))
def test_auc_equals_all_pairs(spark, rows):
    got = tuple(ranking.auc(spark.createDataFrame(rows, "score double, label double")).first())
    want = brute_auc(rows)
    assert got[:2] == want[:2]
    assert got[2] == (pytest.approx(want[2]) if want[2] is not None else None)


def test_auc_agrees_with_spark_ml(spark, planted):
    model, factors, frame, *_ = planted
    scored = recommend.ctr_score(model, frame, factors)
    assert ranking.auc(scored, "click_prob").first().auc == pytest.approx(recommend.auc(scored), abs=1e-3)


def test_running_totals_and_hit_rates(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "x long, y long")
    got = ranking.running_totals(df, [F.desc("x")], {"n": F.lit(1), "s": F.col("y")}, partitions=5).collect()
    ordered = sorted(((i * 7 % 50, i) for i in range(50)), reverse=True)
    want = {x: (n, sum(y for _, y in ordered[:n])) for n, (x, _) in enumerate(ordered)}
    assert {r.x: (r.n, r.s) for r in got} == want
    lists = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 20)], "user_id long, rank long, poi_id long")
    wanted = spark.createDataFrame([(1, 11), (1, 11), (1, 12), (2, 21), (3, 10), (None, 1)], "user_id long, poi_id long")
    assert tuple(ranking.hit_rate(lists, wanted, k=2).first()) == (3, 1, 1, pytest.approx(1 / 3), 0.25)
    same = spark.createDataFrame([(1, 11), (2, 10), (3, 12)], "rank long, poi_id long")
    assert tuple(ranking.hit_rate_common(same, wanted, k=2).first()) == (3, 2, 2, pytest.approx(2 / 3), 0.5)
    assert tuple(ranking.hit_rate(lists, wanted.limit(0)).first()) == (0, 0, 0, None, None)
    assert tuple(ranking.auc(df.limit(0).select(F.col("x").alias("score"), F.col("y").alias("label"))).first()) == (0, 0, None)


# ---- published models ---------------------------------------------------------------------

def test_a_killed_save_leaves_the_old_version_in_use(spark, planted, monkeypatch):
    model, factors, frame, *_ = planted
    root = tempfile.mkdtemp(prefix="models-")
    with pytest.raises(FileNotFoundError):
        models.load_version(spark, root)
    assert models.save_version(factors, root, spark) == 1
    with monkeypatch.context() as m:
        m.setattr(models, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):  # killed after the files, before the manifest
            models.save_version(factors, root, spark)
    assert models.versions(spark, root) == [1]
    assert models.load_version(spark, root).rank == 8
    with pytest.raises(FileNotFoundError):
        models.load_version(spark, root, 2)
    assert models.save_version(factors, root, spark) == 3  # the leftovers' number is not used again
    assert models.versions(spark, root) == [1, 3]
    with pytest.raises(ValueError):
        models.save_version(object(), root, spark)
    f = models.factor_scan(models.load_version(spark, root), "item")
    assert f.columns == ["id", "vector"] and f.count() == factors.itemFactors.count()
    ranker = tempfile.mkdtemp(prefix="models-")
    models.save_version(model, ranker, spark)
    scored = recommend.ctr_score(models.load_version(spark, ranker), frame, factors)
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, recommend.ctr_score(model, frame, factors).collect()))


# ---- stored layers ------------------------------------------------------------------------

def test_bucketed_layers_plan_without_exchange(spark, sf_dir):
    d = tempfile.mkdtemp(prefix="layers-")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layers.stage_typed(fx.ods_attractions(spark, sf_dir), "t_typed", buckets=4, path=d + "/typed")
        layers.build_dwd_table(spark, "default", "t_typed", "t_dwd", 4, d + "/dwd")
        writers.write_bucketed(inter.weighted_interactions_log(fx.behaviors(spark, sf_dir)), "t_events", "poi_id", 4, path=d + "/events")
        from poi_analytics.operators import clean
        assert "Exchange" not in plan_of(spark, clean.dedupe_latest(spark.table("t_typed")))
        assert "Exchange" not in plan_of(spark, layers.known_interactions(spark, "default", "t_events", "t_dwd"))
        per_poi = spark.table("t_events").groupBy("poi_id").count()
        assert "Exchange" not in plan_of(spark, per_poi)
        n = spark.table("t_dwd").count()
        writers.write_bucketed(spark.table("t_dwd").limit(5), "t_dwd2", "poiId", 4, path=d + "/dwd2")
        writers.write_bucketed(spark.table("t_dwd"), "t_dwd2", "poiId", 4, "append", path=d + "/dwd2")
        assert spark.table("t_dwd2").count() == n + 5
        with pytest.raises(ValueError):
            writers.write_bucketed(spark.table("t_dwd"), "t_dwd2", "poiId", 4, "ignore")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("t_typed", "t_dwd", "t_dwd2", "t_events"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def files_of(path):
    return {p: set(os.listdir(f"{path}/{p}")) for p in os.listdir(path) if p.startswith("id_range")}


def test_profile_updates_rewrite_touched_partitions_only(spark, sf_dir, monkeypatch):
    path = tempfile.mkdtemp(prefix="profiles-") + "/store"
    profiles = fx.profiles(spark, sf_dir)
    profile_store.create_store(profiles, path, width=10)
    before = files_of(path)
    names = [r.username for r in profiles.where("id IN (15, 17, 31)").collect()]
    updates = spark.createDataFrame([(n, "x") for n in names] + [("nobody", "y")], "username string, city string")
    want = {r.id: "x" if r.username in names else r.city for r in profiles.collect()}
    assert profile_store.apply_updates(spark, path, updates) == 2
    after = files_of(path)
    assert {p for p in before if before[p] != after[p]} == {"id_range=1", "id_range=3"}
    assert {r.id: r.city for r in profile_store.read_store(spark, path).collect()} == want
    assert profile_store.apply_updates(spark, path, updates.where("username = 'nobody'")) == 0
    # killed once the new partitions are complete: the next writer finishes it
    again = updates.withColumn("city", F.lit("z"))
    with monkeypatch.context() as m:
        m.setattr(profile_store, "_put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            profile_store.apply_updates(spark, path, again)
    assert {r.id: r.city for r in profile_store.read_store(spark, path).collect()} == want
    assert profile_store.recover(spark, path) and not profile_store.recover(spark, path)
    want = {i: "z" if c == "x" else c for i, c in want.items()}
    assert {r.id: r.city for r in profile_store.read_store(spark, path).collect()} == want


@pytest.mark.parametrize("n", [0, 1, 76, 77, 78, 200])
def test_texts_are_cut_at_77_tokens(spark, n):
    text = "  \n" + " \t".join(f"w{i}" for i in range(n)) + "  "
    got = spark.createDataFrame([(text,), (None,)], "t string").select(recommend.first_tokens(F.col("t")).alias("t")).collect()
    assert got[0].t == " ".join(f"w{i}" for i in range(min(n, 77))) and got[1].t == ""


def test_two_input_model(spark):
    def make_model():
        return lambda texts, images: np.array([[len(t), len(i)] for t, i in zip(texts, images)], np.float32)
    df = spark.createDataFrame([("a b", bytearray(b"xyz")), (None, None), ("é", bytearray())], "t string, i binary")
    got = df.select(recommend.embed_text_and_image(F.col("t"), F.col("i"), make_model, dim=2, batch_size=2).alias("v")).collect()
    assert [list(r.v) for r in got] == [[3, 3], [0, 0], [1, 0]]


def test_refused_lines_are_kept(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    with open(d + "/a.csv", "w", encoding="utf-8") as f:
        f.write('id,name,price\n1,"a\nb",2.5\nx,c,1\n3,"q ""w"", e",\n4,d,1,extra\n')
    schema = spark.createDataFrame([], "id long, name string, price double").schema
    scan = landing.read_typed_csv(spark, d, schema, multiline=True)
    rows = [(r.id, r.name, r.price, r[landing.REFUSED] is None) for r in scan.collect()]
    assert rows[:3] == [(1, "a\nb", 2.5, True), (None, "c", 1.0, False), (3, 'q "w", e', None, True)]
    assert rows[3][0] == 4 and not rows[3][3]
    scan.write.parquet(d + "/out")
    assert tuple(landing.refused_lines(spark.read.parquet(d + "/out")).first()) == (4, 2)


# ---- what factor models are fitted on --------------------------------------------------

def test_factor_models_read_no_event_ids_and_ship_few_blocks(spark, sf_dir):
    from poi_analytics.plans import catalog

    plan = plan_of(spark, catalog._interactions(spark, sf_dir).drop("event_id"))
    assert "Window" not in plan and "l_extendedprice" not in plan
    (pos, users, items), (whole, _, _) = catalog._cf_ratings(spark, sf_dir), catalog._cf_parts(spark, sf_dir)
    assert pos.columns == ["user_idx", "item_idx", "weight"]
    summed = [sorted(map(tuple, p.groupBy("user_idx", "item_idx").agg(F.round(F.sum("weight"), 6), F.count("*")).collect()))
              for p in (pos, whole)]
    assert summed[0] == summed[1] and summed[0]
    model = recommend.cf_train(pos)
    assert model.userFactors.rdd.getNumPartitions() == model.itemFactors.rdd.getNumPartitions() == recommend.CF_BLOCKS < 10
    assert (model.userFactors.count(), model.itemFactors.count()) == (users.count(), items.count())


def test_click_lists_fit_on_summed_pairs_the_same_rows(spark, sf_dir):
    from poi_analytics.plans import catalog

    dwd, pos, users, items = catalog._ctr_parts(spark, sf_dir)
    (pairs, neg, feats, found), all_neg = catalog._ctr_pairs(spark, sf_dir), inter.negative_samples(pos, ratio=2, seed=2024)
    pair, rows = ["user_idx", "item_idx"], lambda df: sorted(map(tuple, df.collect()))
    assert rows(found) == rows(users) and rows(neg) == rows(all_neg) and neg.columns == all_neg.columns
    assert rows(inter.repeated_pairs(pairs)) == rows(pos.select(*pair)) and pairs.count() == pos.select(*pair).distinct().count()
    assert rows(pairs.select(*pair, F.round("weight", 6))) == rows(pos.groupBy(*pair).agg(F.round(F.sum("weight"), 6)))

    train = inter.training_set(inter.repeated_pairs(pairs), neg)
    frame = inter.ctr_training_frame(inter.training_set(pos, all_neg), inter.item_features(dwd, items))
    assert rows(catalog._round6(inter.ctr_training_frame(train, feats))) == rows(catalog._round6(frame))
    factors = recommend.cf_fit(pairs, rank=4, max_iter=1, blocks=recommend.CTR_LIST_BLOCKS)
    assert factors.userFactors.rdd.getNumPartitions() == recommend.CTR_LIST_BLOCKS < recommend.CF_BLOCKS
    late, early = (recommend.ctr_train(f, factors, max_iter=2, features=x) for f, x in ((train, feats), (frame, None)))
    assert late.stages[0].categorySizes == early.stages[0].categorySizes
    # each partition's last stack of rows weighs as much as a full one, so the gradient depends a little on the partitions
    assert np.allclose(late.stages[-1].weights.toArray(), early.stages[-1].weights.toArray(), rtol=1e-2, atol=1e-3)


def test_factor_vectors_have_a_size(spark):
    factors = recommend.cf_fit(spark.range(40).selectExpr("id % 8 AS user_idx", "id % 5 AS item_idx", "1.0D AS weight"), rank=4, max_iter=1)
    data = recommend.ctr_features(spark.range(40).selectExpr("id % 8 AS user_idx", "id % 5 AS item_idx"), factors)
    for name in ("uvec", "ivec"):  # without a size, an assembler runs the plan to see one
        assert data.schema[name].metadata["ml_attr"]["num_attrs"] == 4
    known = {r.id: list(r.features) for r in factors.itemFactors.collect()}
    assert all(r.ivec.toArray().tolist() == known[r.item_idx] for r in data.collect()) and data.count() == 40


def test_factorization_machine_scores_rows_as_hashed(spark):
    from pyspark.ml.feature import VectorAssembler

    frame = spark.range(300).select(
        F.col("id").alias("user_idx"), (F.col("id") % 7).alias("item_idx"), (F.col("id") % 3).alias("district_idx"),
        (F.col("id") % 2).cast("double").alias("price"), F.lit(0.0).alias("heat"), (F.col("id") % 5 - 2.0).alias("score"),
        (F.col("id") % 7 < 3).cast("double").alias("label"))
    model = recommend.fm_train(frame, buckets=256, factors=4, max_iter=3)
    assembled = VectorAssembler(inputCols=["hashed"], outputCol="features").transform(
        recommend.fm_features(frame, 256).withColumnRenamed("features", "hashed"))
    expected = model.transform(assembled).select("user_idx", recommend.vector_to_array("probability")[1].alias("p"))
    got = recommend.fm_score(model, frame)
    assert got.columns == [*frame.columns, "click_prob"]
    assert {r.user_idx: r.click_prob for r in got.collect()} == {r.user_idx: r.p for r in expected.collect()}
    # a row passes the hasher and the machine, not the assembler
    assert "hashed" not in plan_of(spark, got)


def click_rows(spark, n):
    """``n`` rows of a click frame, whose item decides its features, and factors for its users and items."""
    ids = spark.range(n).select((F.col("id") % 997).alias("user_idx"), (F.col("id") * 7 % 83).alias("item_idx"), "id")
    feats = spark.range(83).selectExpr("id AS poi_id", "id AS item_idx", "id % 5 * 1.0D AS price", "id % 7 * 1.0D AS heat",
                                       "id % 3 * 1.0D AS score", "concat('d', id % 4) AS district")
    train = ids.select("user_idx", "item_idx", F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < F.col("item_idx") % 10, 1.0).otherwise(0.0).alias("label"))
    factors = recommend.cf_fit(ids.where("id % 5 = 0").groupBy("user_idx", "item_idx").agg(F.count("*").alias("weight")), rank=4, max_iter=1)
    return train, feats, factors


@pytest.mark.parametrize("at_items", [True, False])
def test_click_model_is_fitted_on_every_row(spark, at_items, monkeypatch):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    train, feats, factors = click_rows(spark, 230_000)  # more rows than were once drawn for fitting
    frame = inter.ctr_training_frame(train, feats)
    seen = []
    inner = recommend.network.fit
    monkeypatch.setattr(recommend.network, "fit", lambda grid, *a: seen.append(
        grid.cells.map(lambda c: len(c["u"])).sum()) or inner(grid, *a))
    model = recommend.ctr_train(*((train, factors) if at_items else (frame, factors)), max_iter=3, features=feats if at_items else None)
    data = recommend.ctr_features(frame, factors)
    assert seen == [data.count()] and seen[0] > 200_000
    # Spark's own fit of the same rows; stacks of one row weigh alike
    for stage in model.stages[:2]:
        data = stage.transform(data)
    own = MultilayerPerceptronClassifier(layers=model.stages[-1].getLayers(), maxIter=3, seed=recommend.SEED, blockSize=1).fit(data.coalesce(4))
    assert np.allclose(model.stages[-1].weights.toArray(), own.weights.toArray(), atol=1e-4)


def test_cells_keep_rows_users_and_items_together(spark):
    train, _, factors = click_rows(spark, 3_000)
    strange = train.limit(2).withColumn("user_idx", F.lit(5_000).cast("long"))  # no factors
    for side in (1, 3):
        grid = recommend.Grid.of(train.unionByName(strange), factors.userFactors, factors.itemFactors, side)
        assert grid.cells.getNumPartitions() == side * side
        got = grid.map(lambda c, u, i: list(zip(u["id"][c["u"]].tolist(), i["id"][c["i"]].tolist(), c["label"].tolist()))).collect()
        known = train.join(factors.userFactors, F.col("user_idx") == F.col("id"), "left_semi").join(
            factors.itemFactors, F.col("item_idx") == F.col("id"), "left_semi")
        assert sorted(x for cell in got for x in cell) == sorted(map(tuple, known.collect()))


@pytest.mark.parametrize("buckets", [64, 1 << 14])  # few buckets, so that users share theirs with items
def test_factorization_machine_is_fitted_on_every_row(spark, buckets, monkeypatch):
    n = 210_000 if buckets > 64 else 5_000  # the first is more than was once drawn for fitting
    train, feats, _ = click_rows(spark, n)
    frame = inter.ctr_training_frame(train, feats)
    seen = []
    inner = recommend.machine.fit
    monkeypatch.setattr(recommend.machine, "fit", lambda grid, *a: seen.append(
        grid.cells.map(lambda c: len(c["u"])).sum()) or inner(grid, *a))
    got = recommend.fm_train(frame, buckets=buckets, factors=3, max_iter=4, features=feats)
    own = recommend.fm_train(frame, buckets=buckets, factors=3, max_iter=4)  # Spark's own fit of a vector a row
    assert seen == [n]
    assert np.allclose(got.factors.toArray(), own.factors.toArray(), atol=1e-6)
    assert np.allclose(got.linear.toArray(), own.linear.toArray(), atol=1e-6) and got.intercept == pytest.approx(own.intercept, abs=1e-6)
    assert recommend.fm_score(got, frame).count() == n


def test_top_k_ships_no_block(spark):
    vectors = similarity._unit(clustered(spark), "vec_id", "embedding")
    got = similarity.top_k_dot(vectors, vectors, 4, True, (3, 5))
    assert "CoGroup" not in plan_of(spark, got)
    key = ["query_id", "rank", "neighbor_id"]
    assert sorted(got.select(key).collect()) == sorted(similarity.top_k_dot(vectors, vectors, 4, True, (1, 1)).select(key).collect())
