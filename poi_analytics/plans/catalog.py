"""Registered queries and their DuckDB oracles.

Each query is ``(spark, sf_dir) -> DataFrame`` over the whole driver tables.
Mart queries read the ``attractions`` view (DWD-shaped, derived from ``part``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bucketize_sql, round_doubles
from ..functions.regions import normalize_region_sql
from ..sources import tables
from ..operators import behavior, clean, lsh, ranking, search
from ..operators import interactions as inter
from ..operators import similarity as sim
from ..functions.jsoncols import poi_text
from . import recommend as rec
from ..session import materialized, remove, shared_path
from ..sinks import models, profile_store, writers
from ..sources import landing
from ..streaming import ingest as stream
from ..sources.tables import read_table
from ..sources import fixtures as fx
from . import home, jobs, layers, pages, screen
from .schemas import SCHEMAS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _register_marts(builders: dict, oracle: dict, prepare=None) -> None:
    for name, fn in builders.items():
        def q(spark: SparkSession, sf_dir: str, fn=fn) -> DataFrame:
            df = fx.attractions(spark, sf_dir)
            return fn(prepare(df) if prepare else df)
        QUERIES[name] = q
        if name in oracle:
            ORACLE[name] = fx.with_views(oracle[name], "attractions")


_register_marts(home.BUILDERS, home.ORACLE)
_register_marts(screen.BUILDERS, screen.ORACLE)
_register_marts(pages.BUILDERS, pages.ORACLE, prepare=pages.prepare)


# ---- DWD cleaning over the all-string ODS view --------------------------------

def _register_clean() -> None:
    for name, step in clean.STEPS.items():
        def q(spark: SparkSession, sf_dir: str, step=step) -> DataFrame:
            return step(fx.ods_attractions(spark, sf_dir))
        QUERIES[name] = q
        ORACLE[name] = fx.with_views(clean.ORACLE[name], "ods_attractions")


_register_clean()


# ---- search over the DWD-shaped attractions ----------------------------------

def _dwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.discount_rate(fx.attractions(spark, sf_dir))


def _register_search() -> None:
    for name, filters in search.CASES.items():
        def q(spark: SparkSession, sf_dir: str, filters=filters) -> DataFrame:
            return search.search_filter(_dwd(spark, sf_dir), filters).select(*search.SEARCH_COLUMNS)
        QUERIES[name] = q
    QUERIES["search_page"] = lambda spark, sf_dir: search.search_page(
        _dwd(spark, sf_dir), search.PAGE_CASE, page=search.PAGE_NO)
    QUERIES["search_count"] = lambda spark, sf_dir: search.search_count(_dwd(spark, sf_dir), search.PAGE_CASE)
    QUERIES["poi_detail"] = lambda spark, sf_dir: search.poi_detail(_dwd(spark, sf_dir), search.DETAIL_ID)
    for name, sql in search.ORACLE.items():
        ORACLE[name] = fx.with_views(sql, "attractions")


_register_search()


# ---- behaviour events and profiles --------------------------------------------

INGEST_TIME = "2024-06-01 00:00:00"
_REQUEST_COLS = {
    "click": [],
    "detail": ["stay_seconds", "from_click_id"],
    "favorite": ["is_favorite"],
    "comment": ["rating", "images"],
}
# The columns each event table lists, and what its search looks at.
_LISTED = {
    "click": ["id", "username", "poi_id", "scene", "occurred_at"],
    "detail": ["id", "username", "poi_id", "stay_seconds", "occurred_at"],
    "favorite": ["id", "username", "poi_id", "is_favorite", "occurred_at"],
    "comment": ["id", "username", "poi_id", "rating", "occurred_at"],
}
_SEARCHED = {
    "click": ("17", ["username", "poi_id"], {"scene": "scene4"}),
    "detail": ("00001", ["username", "poi_id"], {}),
    "favorite": (None, [], {"is_favorite": True}),
    "comment": ("9", ["username", "poi_id", "content"], {}),
}


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return behavior.event_table(fx.behaviors(spark, sf_dir), kind)


def _requests(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    images = F.from_json(F.nullif(F.col("image_urls"), F.lit("")), "array<string>")
    return (fx.view(spark, sf_dir, "requests").where(F.col("kind") == kind).withColumn("images", images)
            .select("id", "user_id", "username", "poi_id", "scene", "device", "occurred_at", *_REQUEST_COLS[kind]))


def _deleted_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Profiles without an email are the ones removed in the delete scenarios.
    return fx.profiles(spark, sf_dir).where(F.col("email") == "")


def _register_behavior() -> None:
    names = {"click": "ingest_click", "detail": "ingest_detail_view",
             "favorite": "ingest_favorite", "comment": "ingest_comment"}
    for kind, name in names.items():
        def q(spark, sf_dir, kind=kind):
            return behavior.ingest(_requests(spark, sf_dir, kind), fx.profiles(spark, sf_dir), kind,
                                   ingest_time=F.lit(INGEST_TIME))
        QUERIES[name] = q
    QUERIES["favorite_state"] = lambda spark, sf_dir: behavior.favorite_state(_events(spark, sf_dir, "favorite"))
    QUERIES["comment_feed"] = lambda spark, sf_dir: behavior.comment_feed(
        _events(spark, sf_dir, "comment"), fx.profiles(spark, sf_dir))
    QUERIES["detail_from_click"] = lambda spark, sf_dir: behavior.detail_from_click(
        _events(spark, sf_dir, "detail"), _events(spark, sf_dir, "click"))
    # the whole mixed log: the events of all four kinds go with their user
    QUERIES["cascade_delete"] = lambda spark, sf_dir: behavior.cascade_delete(
        fx.behaviors(spark, sf_dir), _deleted_profiles(spark, sf_dir)).select("id", "kind", "user_id", "poi_id", "occurred_at")

    def set_null(spark, sf_dir):
        clicks = _events(spark, sf_dir, "click")
        gone = clicks.join(_deleted_profiles(spark, sf_dir).select(F.col("id").alias("user_id")),
                           "user_id", "left_semi")
        return behavior.set_null_on_delete(_events(spark, sf_dir, "detail"), gone)
    QUERIES["set_null_on_delete"] = set_null
    QUERIES["profile_view"] = lambda spark, sf_dir: behavior.profile_view(fx.profiles(spark, sf_dir))

    def get_or_create(spark, sf_dir):
        # Accounts: every supplier signs up (new), every customer logs in again (existing).
        sup = read_table(spark, sf_dir, "supplier").select(
            F.col("s_name").alias("username"),
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"))
        cus = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"),
                                                           F.lit(None).cast("string").alias("email"))
        return behavior.profile_get_or_create(fx.profiles(spark, sf_dir), sup.unionByName(cus))
    QUERIES["profile_get_or_create"] = get_or_create

    def updates(spark, sf_dir):
        # Each customer's profile takes its market segment as city; nickname not sent.
        return read_table(spark, sf_dir, "customer").select(
            F.col("c_name").alias("username"), F.lit(None).cast("string").alias("nickname"),
            F.lower("c_mktsegment").alias("city"))
    QUERIES["profile_update_partial"] = lambda spark, sf_dir: behavior.profile_update(
        fx.profiles(spark, sf_dir), updates(spark, sf_dir), partial=True)
    QUERIES["profile_update_full"] = lambda spark, sf_dir: behavior.profile_update(
        fx.profiles(spark, sf_dir), updates(spark, sf_dir), partial=False)

    def registrations(spark, sf_dir):
        sup = read_table(spark, sf_dir, "supplier").select(
            F.col("s_name").alias("username"),
            F.substring(F.md5("s_name"), 1, (F.col("s_suppkey") % 10).cast("int")).alias("password"),
            F.when(F.col("s_suppkey") % 4 == 0, F.lit("bad-email"))
            .otherwise(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@example.com")))
            .alias("email"))
        cus = read_table(spark, sf_dir, "customer").select(
            F.col("c_name").alias("username"), F.lit("secret1").alias("password"), F.lit("").alias("email"))
        again = sup.withColumn("email", F.lit("again@example.com"))  # a second try of every supplier
        return behavior.registration_check(sup.unionByName(again).unionByName(cus), fx.profiles(spark, sf_dir))
    QUERIES["registration_check"] = registrations

    def audit(spark, sf_dir):
        return behavior.constraint_audit(fx.view(spark, sf_dir, "bad_profiles"), fx.view(spark, sf_dir, "bad_behaviors"))
    QUERIES["constraint_audit"] = audit

    def behavior_search(spark, sf_dir):
        return search.search_table(fx.profiles(spark, sf_dir), text="customer#00000001",
                                   fields=["username", "nickname", "city"], facets={"gender": "male"},
                                   columns=["id", "username", "nickname", "city", "gender"])
    QUERIES["behavior_search"] = behavior_search
    for kind, (text, fields, facets) in _SEARCHED.items():
        def search_kind(spark, sf_dir, kind=kind, text=text, fields=fields, facets=facets):
            return behavior.search_events(_events(spark, sf_dir, kind), fx.profiles(spark, sf_dir), text, fields,
                                          facets, _LISTED[kind])
        QUERIES[f"behavior_search_{kind}"] = search_kind

    for name, sql in BEHAVIOR_ORACLE.items():
        views = [v for v in ("behaviors", "requests", "bad_profiles", "bad_behaviors", "profiles")
                 if re.search(rf"\b{v}\b", sql)]
        ORACLE[name] = fx.with_views(sql, *views)


def _ingest_sql(kind: str, extras: str) -> str:
    """From the write path's rules: an id must exist, else a name must exist, else the demo user's
    profile, which gets the next id when there is none."""
    demo = (f"coalesce((SELECT min(id) FROM profiles WHERE username = '{behavior.DEMO_USERNAME}'), "
            f"(SELECT coalesce(max(id), 0) + 1 FROM profiles))")
    return f"""
WITH r AS (SELECT *, CASE
    WHEN user_id IS NOT NULL AND user_id <> 0 THEN (SELECT min(p.id) FROM profiles p WHERE p.id = q.user_id)
    WHEN username IS NOT NULL AND username <> '' THEN (SELECT min(p.id) FROM profiles p WHERE p.username = q.username)
    ELSE {demo} END AS who
  FROM requests q WHERE kind = '{kind}'),
j AS (SELECT *, CASE WHEN poi_id IS NULL OR poi_id = 0 THEN 'missing_poi_id' WHEN who IS NULL THEN 'unknown_user' END AS why FROM r)
SELECT id, who AS user_id, poi_id, coalesce(scene, '{behavior.DEFAULTS[kind]['scene']}') AS scene,
  coalesce(device, 'web') AS device, {extras}
  coalesce(occurred_at, TIMESTAMP '{INGEST_TIME}') AS occurred_at, why IS NULL AS accepted, why AS reject_reason
FROM j"""


_DELETED = "(SELECT id FROM profiles WHERE email = '')"


def _audit_sql() -> str:
    def rows(rule: str, table: str, key: str, value: str, source: str) -> str:
        return (f"SELECT {rule} AS rule, {table} AS \"table\", CAST({key} AS VARCHAR) AS key, "
                f"CAST({value} AS VARCHAR) AS value FROM {source}")

    profile, log = "'user_profile'", "'user_' || kind || '_behavior'"
    genders = ", ".join(f"'{g}'" for g in behavior.GENDERS)
    parts = [rows(f"'unique_{c}'", profile, c, "count(*)", f"bad_profiles WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1")
             for c in ("username", "external_id")]
    parts.append(rows("'gender_choice'", profile, "id", "gender",
                      f"bad_profiles WHERE gender IS NULL OR gender NOT IN ({genders})"))
    parts += [rows(f"'max_length_{c}'", profile, "id", f"length({c})", f"bad_profiles WHERE length({c}) > {behavior.MAX_LEN[c]}")
              for c in ("username", "nickname", "phone", "city")]
    parts += [rows(f"'max_length_{c}'", log, "id", f"length({c})", f"bad_behaviors WHERE length({c}) > {behavior.MAX_LEN[c]}")
              for c in ("scene", "device", "exposure_id", "note")]
    parts.append(rows("'rating_range'", log, "id", "rating", "bad_behaviors WHERE kind = 'comment' AND (rating < 0 OR rating > 5)"))
    parts.append(rows("'stay_seconds_nonnegative'", log, "id", "stay_seconds",
                      "bad_behaviors WHERE kind = 'detail' AND stay_seconds < 0"))
    parts.append(rows("'fk_user'", log, "id", "user_id",
                      "bad_behaviors b WHERE NOT EXISTS (SELECT 1 FROM bad_profiles p WHERE p.id = b.user_id)"))
    return "\nUNION ALL\n".join(parts)


def _search_sql(kind: str) -> str:
    text, fields, facets = _SEARCHED[kind]
    source = ("(SELECT b.*, '' AS content, p.username FROM behaviors b JOIN profiles p ON p.id = b.user_id "
              f"WHERE b.kind = '{kind}')")
    where = [f"{c} = {repr(v).lower() if v is True else repr(v)}" for c, v in facets.items()]
    if text:
        where.append("(" + " OR ".join(f"contains(lower(CAST({f} AS VARCHAR)), '{text}')" for f in fields) + ")")
    return f"SELECT {', '.join(_LISTED[kind])} FROM {source} e WHERE {' AND '.join(where)}"


BEHAVIOR_ORACLE = {
    "ingest_click": _ingest_sql("click", "'' AS exposure_id,"),
    "ingest_detail_view": _ingest_sql("detail", "coalesce(stay_seconds, 0) AS stay_seconds, from_click_id,"),
    "ingest_favorite": _ingest_sql("favorite", "coalesce(is_favorite, true) AS is_favorite, "
                                               "CAST(NULL AS VARCHAR) AS note,"),
    "ingest_comment": _ingest_sql("comment", "coalesce(rating, 0) AS rating, '' AS content, "
                                             "CASE WHEN image_urls = '' THEN '[]' ELSE image_urls END AS image_urls,"),
    **{f"behavior_search_{kind}": _search_sql(kind) for kind in _SEARCHED},
    "favorite_state": """
SELECT user_id, poi_id, is_favorite FROM (
  SELECT user_id, poi_id, is_favorite,
    row_number() OVER (PARTITION BY user_id, poi_id ORDER BY occurred_at DESC, id DESC) AS rn
  FROM behaviors WHERE kind = 'favorite') WHERE rn = 1""",
    "comment_feed": """
SELECT c.id, c.poi_id, p.username AS "user", p.nickname, c.rating, '' AS content,
  from_json(CASE WHEN c.image_urls IS NULL OR c.image_urls = '' THEN '[]' ELSE c.image_urls END, '["VARCHAR"]')
    AS images, c.occurred_at
FROM behaviors c JOIN profiles p ON p.id = c.user_id WHERE c.kind = 'comment'""",
    "detail_from_click": """
SELECT d.id, d.user_id, d.poi_id, d.stay_seconds, d.from_click_id, c.scene AS click_scene,
  c.occurred_at AS click_occurred_at
FROM behaviors d LEFT JOIN (SELECT * FROM behaviors WHERE kind = 'click') c ON c.id = d.from_click_id
WHERE d.kind = 'detail'""",
    "cascade_delete": f"""
SELECT id, kind, user_id, poi_id, occurred_at FROM behaviors WHERE user_id NOT IN {_DELETED}""",
    "set_null_on_delete": f"""
SELECT d.id, d.user_id, d.poi_id, d.scene, d.device, d.occurred_at, d.stay_seconds,
  CASE WHEN g.id IS NULL THEN d.from_click_id END AS from_click_id
FROM behaviors d LEFT JOIN (SELECT id FROM behaviors WHERE kind = 'click' AND user_id IN {_DELETED}) g
  ON g.id = d.from_click_id
WHERE d.kind = 'detail'""",
    "profile_view": """
SELECT id, external_id, username, nickname, email, CAST(NULL AS VARCHAR) AS phone, gender, city,
  CAST(NULL AS VARCHAR) AS avatar, CAST(NULL AS VARCHAR) AS created_at, CAST(NULL AS VARCHAR) AS updated_at
FROM profiles""",
    "registration_check": """
WITH regs AS (
  SELECT s_name AS username, substr(md5(s_name), 1, CAST(s_suppkey % 10 AS INTEGER)) AS password,
    CASE WHEN s_suppkey % 4 = 0 THEN 'bad-email' ELSE 's' || CAST(s_suppkey AS VARCHAR) || '@example.com' END AS email
  FROM supplier
  UNION ALL SELECT s_name, substr(md5(s_name), 1, CAST(s_suppkey % 10 AS INTEGER)), 'again@example.com' FROM supplier
  UNION ALL SELECT c_name, 'secret1', '' FROM customer),
checked AS (
  SELECT r.username, coalesce(r.email, '') AS email, CAST(length(coalesce(r.password, '')) AS INTEGER) AS password_length,
    CASE WHEN r.username IS NULL OR r.username = '' THEN 'username_required'
         WHEN r.username IN (SELECT username FROM profiles) THEN 'username_taken'
         WHEN length(r.username) > 150 THEN 'username_too_long'
         WHEN length(coalesce(r.password, '')) < 6 THEN 'password_too_short'
         WHEN coalesce(r.email, '') <> '' AND NOT regexp_matches(coalesce(r.email, ''), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
           THEN 'invalid_email' END AS reject_reason
  FROM regs r)
SELECT username, email, password_length, why IS NULL AS accepted, why AS reject_reason FROM (
  SELECT *, coalesce(reject_reason, CASE WHEN row_number() OVER (PARTITION BY username, reject_reason IS NULL
    ORDER BY email, password_length) > 1 THEN 'username_taken' END) AS why FROM checked)""",
    "constraint_audit": _audit_sql(),
    "profile_get_or_create": """
WITH accounts AS (
  SELECT s_name AS username, 's' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email FROM supplier
  UNION ALL SELECT c_name, CAST(NULL AS VARCHAR) FROM customer),
new AS (
  SELECT username, min(coalesce(email, '')) AS email FROM accounts
  WHERE username IS NOT NULL AND username <> '' AND username NOT IN (SELECT username FROM profiles)
  GROUP BY username)
SELECT id, external_id, username, nickname, email, gender, city FROM profiles
UNION ALL
SELECT CAST((SELECT coalesce(max(id), 0) FROM profiles) + row_number() OVER (ORDER BY username) AS BIGINT),
  CAST(NULL AS VARCHAR), username, CASE WHEN username = 'demo_user' THEN '体验用户' ELSE '' END, email, 'unknown', ''
FROM new""",
    "profile_update_partial": """
SELECT p.id, p.external_id, p.username, coalesce(u.nickname, p.nickname) AS nickname, p.email, p.gender,
  coalesce(u.city, p.city) AS city
FROM profiles p LEFT JOIN (SELECT c_name AS username, CAST(NULL AS VARCHAR) AS nickname,
  lower(c_mktsegment) AS city FROM customer) u ON u.username = p.username""",
    "profile_update_full": """
SELECT p.id, p.external_id, p.username,
  CASE WHEN u.username IS NOT NULL THEN coalesce(u.nickname, '') ELSE p.nickname END AS nickname, p.email, p.gender,
  CASE WHEN u.username IS NOT NULL THEN coalesce(u.city, '') ELSE p.city END AS city
FROM profiles p LEFT JOIN (SELECT c_name AS username, CAST(NULL AS VARCHAR) AS nickname,
  lower(c_mktsegment) AS city FROM customer) u ON u.username = p.username""",
    "behavior_search": """
SELECT id, username, nickname, city, gender FROM profiles
WHERE (contains(lower(username), 'customer#00000001') OR contains(lower(nickname), 'customer#00000001')
       OR contains(lower(city), 'customer#00000001')) AND gender = 'male'""",
}

_register_behavior()


# ---- interactions for the recommenders ----------------------------------------

def _interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The behaviour view is one mixed log, so the single-scan form applies.
    return inter.weighted_interactions_log(fx.behaviors(spark, sf_dir))


def _cf_parts(spark, sf_dir):
    return inter.indexed_positives(_interactions(spark, sf_dir))


def _cf_ratings(spark, sf_dir):
    """What a factor model is fitted on: every interaction's weight, without event ids, so no line is numbered for them."""
    return inter.indexed_positives(_interactions(spark, sf_dir).drop("event_id"), keep=["weight"])


def _ctr_parts(spark, sf_dir):
    dwd = fx.attractions(spark, sf_dir)
    kept = inter.interactions_with_items(_interactions(spark, sf_dir), dwd)
    pos, users, items = inter.indexed_positives(kept)
    return dwd, pos, users, items


def _ctr_pairs(spark, sf_dir):
    """What the click models are fitted on: as ``_ctr_parts``, with positives summed by pair and event ids apart."""
    dwd = fx.attractions(spark, sf_dir)
    events, pairs, users, items = inter.indexed_pairs(inter.interactions_with_items(_interactions(spark, sf_dir), dwd))
    neg = inter.negative_samples(pairs, ratio=inter.CTR_NEG_RATIO, seed=2024, events=events)
    return pairs, neg, inter.item_features(dwd, items), users


def _round6(df: DataFrame) -> DataFrame:
    return round_doubles(df, 6)


def _register_interactions() -> None:
    QUERIES["weighted_interactions"] = _interactions
    QUERIES["dense_index_users"] = lambda spark, sf_dir: inter.dense_index(
        _interactions(spark, sf_dir), "user_id", "user_idx")
    QUERIES["dense_index_items"] = lambda spark, sf_dir: inter.dense_index(
        _interactions(spark, sf_dir), "poi_id", "item_idx")

    def neg_cf(spark, sf_dir):
        pos, _, _ = _cf_parts(spark, sf_dir)
        return inter.negative_samples(pos, ratio=inter.CF_NEG_RATIO, seed=42)
    QUERIES["negative_samples_cf"] = neg_cf

    def neg_ctr(spark, sf_dir):
        _, pos, _, _ = _ctr_parts(spark, sf_dir)
        return inter.negative_samples(pos, ratio=inter.CTR_NEG_RATIO, seed=2024)
    QUERIES["negative_samples_ctr"] = neg_ctr

    def train_cf(spark, sf_dir):
        pos, _, _ = _cf_parts(spark, sf_dir)
        return inter.training_set(pos, inter.negative_samples(pos, ratio=1, seed=42))
    QUERIES["training_set_cf"] = train_cf
    QUERIES["interactions_with_items"] = lambda spark, sf_dir: inter.interactions_with_items(
        _interactions(spark, sf_dir), fx.attractions(spark, sf_dir))

    def features(spark, sf_dir):
        # features need the item index only, not the indexed positives
        dwd = fx.attractions(spark, sf_dir)
        kept = inter.interactions_with_items(_interactions(spark, sf_dir), dwd)
        return inter.item_features(dwd, inter.dense_index(kept, "poi_id", "item_idx"))
    QUERIES["item_features"] = features
    QUERIES["zscore_features"] = lambda spark, sf_dir: _round6(inter.zscore(features(spark, sf_dir)))
    QUERIES["district_index"] = lambda spark, sf_dir: inter.district_index(features(spark, sf_dir))

    def ctr_frame(spark, sf_dir):
        dwd, pos, _, items = _ctr_parts(spark, sf_dir)
        neg = inter.negative_samples(pos, ratio=inter.CTR_NEG_RATIO, seed=2024)
        return _round6(inter.ctr_training_frame(inter.training_set(pos, neg), inter.item_features(dwd, items)))
    QUERIES["ctr_training_frame"] = ctr_frame
    QUERIES["cold_start_items"] = lambda spark, sf_dir: inter.cold_start_items(features(spark, sf_dir))

    for name, sql in INTERACTION_ORACLE.items():
        views = [v for v in ("behaviors", "attractions") if v in sql]
        ORACLE[name] = fx.with_views(sql, *views)


_I_CTE = """WITH interactions AS (
  SELECT id AS event_id, user_id, poi_id,
    CAST(CASE kind WHEN 'click' THEN 1.0 WHEN 'detail' THEN 0.8 WHEN 'favorite' THEN 1.5 ELSE 2.0 END AS DOUBLE) AS weight
  FROM behaviors WHERE user_id IS NOT NULL AND user_id <> 0 AND poi_id IS NOT NULL AND poi_id <> 0
    AND (kind <> 'favorite' OR is_favorite = true)),
kept AS (SELECT * FROM interactions WHERE poi_id IN (SELECT poiId FROM attractions)),"""


def _index_ctes(src: str) -> str:
    return f"""
users AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM {src})),
items AS (SELECT poi_id, dense_rank() OVER (ORDER BY poi_id) - 1 AS item_idx FROM (SELECT DISTINCT poi_id FROM {src})),
pos AS (SELECT i.*, u.user_idx, t.item_idx FROM {src} i JOIN users u USING (user_id) JOIN items t USING (poi_id))"""


def _neg_cte(ratio: int, seed: int) -> str:
    def h(salt):
        return (f"('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':' || CAST(k AS VARCHAR) || ':{seed}{salt}'), 1, 15))"
                f"::BIGINT")
    return f""",
draws AS (SELECT event_id, CAST(unnest(range(0, {ratio})) AS INTEGER) AS k FROM pos),
sampled AS (SELECT event_id, k, {h(':u')} % (SELECT count(*) FROM users) AS user_idx,
                   {h(':i')} % (SELECT count(*) FROM items) AS item_idx FROM draws),
neg AS (SELECT * FROM sampled s WHERE NOT EXISTS (
          SELECT 1 FROM pos p WHERE p.user_idx = s.user_idx AND p.item_idx = s.item_idx))"""


_FEATURES_CTE = """,
feat AS (SELECT t.poi_id, t.item_idx, coalesce(a.price, 0.0) AS price, coalesce(a.heatScore, 0.0) AS heat,
  coalesce(a.commentScore, 0.0) AS score,
  CASE WHEN a.districtName IS NULL OR a.districtName = '' THEN '未知' ELSE a.districtName END AS district
  FROM items t JOIN attractions a ON a.poiId = t.poi_id),
zfeat AS (SELECT poi_id, item_idx, district,
  (price - avg(price) OVER ()) / (stddev_pop(price) OVER () + 1e-6) AS price,
  (heat - avg(heat) OVER ()) / (stddev_pop(heat) OVER () + 1e-6) AS heat,
  (score - avg(score) OVER ()) / (stddev_pop(score) OVER () + 1e-6) AS score FROM feat),
dist AS (SELECT district, dense_rank() OVER (ORDER BY district) - 1 AS district_idx FROM (SELECT DISTINCT district FROM feat))"""

INTERACTION_ORACLE = {
    "weighted_interactions": _I_CTE + " x AS (SELECT 1)\nSELECT * FROM interactions",
    "dense_index_users": _I_CTE + _index_ctes("interactions") + "\nSELECT * FROM users",
    "dense_index_items": _I_CTE + _index_ctes("interactions") + "\nSELECT * FROM items",
    "negative_samples_cf": _I_CTE + _index_ctes("interactions") + _neg_cte(1, 42)
    + "\nSELECT user_idx, item_idx, event_id, k FROM neg",
    "negative_samples_ctr": _I_CTE + _index_ctes("kept") + _neg_cte(2, 2024)
    + "\nSELECT user_idx, item_idx, event_id, k FROM neg",
    "training_set_cf": _I_CTE + _index_ctes("interactions") + _neg_cte(1, 42)
    + "\nSELECT user_idx, item_idx, 1.0::DOUBLE AS label FROM pos"
      " UNION ALL SELECT user_idx, item_idx, 0.0::DOUBLE FROM neg",
    "interactions_with_items": _I_CTE + " x AS (SELECT 1)\nSELECT * FROM kept",
    "item_features": _I_CTE + _index_ctes("kept") + _FEATURES_CTE + "\nSELECT * FROM feat",
    "zscore_features": _I_CTE + _index_ctes("kept") + _FEATURES_CTE
    + "\nSELECT poi_id, item_idx, round(price, 6) AS price, round(heat, 6) AS heat, round(score, 6) AS score,"
      " district FROM zfeat",
    "district_index": _I_CTE + _index_ctes("kept") + _FEATURES_CTE + "\nSELECT * FROM dist",
    "ctr_training_frame": _I_CTE + _index_ctes("kept") + _neg_cte(2, 2024) + _FEATURES_CTE + """,
train AS (SELECT user_idx, item_idx, 1.0::DOUBLE AS label FROM pos
          UNION ALL SELECT user_idx, item_idx, 0.0::DOUBLE FROM neg)
SELECT tr.user_idx, tr.item_idx, d.district_idx, round(z.price, 6) AS price, round(z.heat, 6) AS heat,
  round(z.score, 6) AS score, tr.label
FROM train tr JOIN zfeat z ON z.item_idx = tr.item_idx JOIN dist d ON d.district = z.district""",
    "ctr_recommend_new_user": _I_CTE + _index_ctes("kept") + _FEATURES_CTE + """
SELECT row_number() OVER (ORDER BY heat DESC, poi_id ASC) AS rank, poi_id FROM (
  SELECT poi_id, heat FROM zfeat ORDER BY heat DESC, poi_id ASC LIMIT 10)""",
    "cold_start_items": _I_CTE + _index_ctes("kept") + _FEATURES_CTE + """
SELECT row_number() OVER (ORDER BY heat DESC, poi_id ASC) AS rank, poi_id FROM (
  SELECT poi_id, heat FROM zfeat ORDER BY heat DESC, poi_id ASC LIMIT 10)""",
}

_register_interactions()


# ---- content similarity and model pipelines -------------------------------------

#: The interactions that a recommendation list is to find: an eighth of them.
_LATER = "event_id % 8 = 0"
REQUESTED_POIS = [1, 7, 42, 123, 99_999_999]
REQUESTED_USERS = [1, 7, 42, -5]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.attractions(spark, sf_dir).select(
        F.col("poiId").alias("poi_id"),
        poi_text(F.col("poiName"), F.col("shortFeatures"), F.col("tagNameList")).alias("text"))


def multimodal_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unrounded vectors behind the registered query."""
    images = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("poi_id"), sim.as_double_array(F.col("embedding")).alias("image"))
    return sim.multimodal_vectors(fx.attractions(spark, sf_dir), images, _texts(spark, sf_dir))


def _rounded_vector(df: DataFrame) -> DataFrame:
    return df.select("poi_id", F.transform("vector", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vector"))


def _register_similarity() -> None:
    def tags(spark, sf_dir):
        return _round6(sim.tag_hash_vector(fx.attractions(spark, sf_dir)))
    QUERIES["tag_hash_vector"] = tags

    def cosine(spark, sf_dir):
        return _round6(sim.cosine_top_k(read_table(spark, sf_dir, "embeddings"), k=10))
    QUERIES["cosine_top_k"] = cosine

    def cosine_lsh(spark, sf_dir):
        vectors = read_table(spark, sf_dir, "embeddings")
        return _round6(lsh.cosine_top_k_lsh(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=10))
    QUERIES["cosine_top_k_lsh"] = cosine_lsh

    text = _texts
    QUERIES["poi_text"] = text

    QUERIES["text_embeddings"] = lambda spark, sf_dir: _rounded_vector(
        sim.text_vector_dense(text(spark, sf_dir), "poi_id", "text"))

    QUERIES["similar_pois"] = lambda spark, sf_dir: _round6(
        sim.similar_pois(read_table(spark, sf_dir, "embeddings"), REQUESTED_POIS, k=10))
    QUERIES["multimodal_vector"] = lambda spark, sf_dir: _rounded_vector(multimodal_vectors(spark, sf_dir))

    def cf_recs(spark, sf_dir):
        pos, users, items = _cf_ratings(spark, sf_dir)
        model = rec.cf_train(pos)
        return rec.cf_recommend(model, users, items, k=10)
    QUERIES["cf_recommend"] = cf_recs

    def cf_user(spark, sf_dir):
        pos, users, items = _cf_ratings(spark, sf_dir)
        return rec.cf_recommend_user(rec.cf_train(pos), users, items, REQUESTED_USERS, k=10)
    QUERIES["cf_recommend_user"] = cf_user

    def ctr_frame(spark, sf_dir):
        """The training frame, written once, and what its models need."""
        pairs, neg, feats, _ = _ctr_pairs(spark, sf_dir)
        train = inter.training_set(inter.repeated_pairs(pairs), neg)
        frame = materialized(inter.ctr_training_frame(train, feats), "ctr-frame")
        return frame.withColumn("held_out", rec.held_out(frame)), pairs, feats

    def ctr_parts(spark, sf_dir):
        """CTR model fitted on the rows that are not held out, and what scoring needs."""
        frame, pairs, feats = ctr_frame(spark, sf_dir)
        factors = rec.cf_fit(pairs.where(~rec.held_out(pairs)))
        return rec.ctr_train(frame.where("not held_out"), factors, features=feats), factors, frame

    def ctr_ranker(spark, sf_dir):
        """The same model for lists of a user's items, which need no frame: a row's features are those of its item."""
        pairs, neg, feats, users = _ctr_pairs(spark, sf_dir)
        neg = materialized(neg.select("user_idx", "item_idx"), "ctr-negatives")
        train = inter.training_set(inter.repeated_pairs(pairs), neg)
        factors = rec.cf_fit(pairs.where(~rec.held_out(pairs)), blocks=rec.CTR_LIST_BLOCKS)
        return rec.ctr_train(train.where(~rec.held_out(train)), factors, features=feats), factors, feats, users

    def ctr_scores(spark, sf_dir):
        model, factors, frame = ctr_parts(spark, sf_dir)
        return rec.ctr_score(model, frame, factors)
    QUERIES["ctr_scores"] = ctr_scores

    def fm_scores(spark, sf_dir):
        frame, _, feats = ctr_frame(spark, sf_dir)
        return rec.fm_score(rec.fm_train(frame.where("not held_out"), features=feats), frame)
    QUERIES["fm_scores"] = fm_scores

    def ctr_users(spark, sf_dir):
        model, factors, feats, users = ctr_ranker(spark, sf_dir)
        return rec.ctr_recommend_users(model, factors, users, inter.ctr_item_features(feats), feats)
    QUERIES["ctr_recommend_users"] = ctr_users

    def ctr_auc(spark, sf_dir):
        # a fixed score: the item's heat
        frame, _, _ = ctr_frame(spark, sf_dir)
        return _round6(ranking.auc(frame, score="heat"))
    QUERIES["ctr_auc_heat"] = ctr_auc

    def cold_hits(spark, sf_dir):
        dwd, pos, _, items = _ctr_parts(spark, sf_dir)
        return _round6(ranking.hit_rate_common(inter.cold_start_items(inter.item_features(dwd, items), 100),
                                               pos.where(_LATER), k=100))
    QUERIES["cold_start_hit_rate"] = cold_hits

    def given_factors(spark, sf_dir):
        """User and item factor tables, as a model would have them: vectors of odd and even ids."""
        vectors = read_table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("id"), sim.as_double_array(F.col("embedding")).alias("v"))
        return vectors.where("id % 2 = 1"), vectors.where("id % 2 = 0")

    def factors_query(spark, sf_dir):
        uf, itf = given_factors(spark, sf_dir)
        users = uf.select((F.col("id") + 1000).alias("user_id"), F.col("id").alias("user_idx"))
        items = itf.select((F.col("id") * 3).alias("poi_id"), F.col("id").alias("item_idx"))
        return _round6(rec.cf_recommend_factors(uf, itf, users, items, k=10))
    QUERIES["cf_recommend_factors"] = factors_query

    def saved(spark, sf_dir):
        """Per user: how many recommendations the loaded model gives, and how many differ from the fitted one's."""
        pos, users, items = _cf_ratings(spark, sf_dir)
        model, root = rec.cf_train(pos), shared_path(spark, "cf-model")
        models.save_version(model, root, spark)
        fitted = rec.cf_recommend(model, users, items, k=10)
        loaded = rec.cf_recommend(models.load_version(spark, root), users, items, k=10)
        key = ["user_id", "rank", "poi_id"]
        both = (loaded.withColumn("side", F.lit(1)).unionByName(fitted.withColumn("side", F.lit(-1)))
                .groupBy(*key, F.round("score", 9).alias("score")).agg(F.sum("side").alias("balance"), F.count_if(F.col("side") > 0).alias("n")))
        return both.groupBy("user_id").agg(F.sum("n").alias("recommended"), F.count_if(F.col("balance") != 0).alias("differing"))
    QUERIES["cf_saved_model"] = saved

    def ctr_user(spark, sf_dir):
        model, factors, feats, users = ctr_ranker(spark, sf_dir)
        return rec.ctr_recommend_user(model, factors, users, inter.ctr_item_features(feats), feats, REQUESTED_USERS[0])
    QUERIES["ctr_recommend_user"] = ctr_user

    def ctr_new_user(spark, sf_dir):
        # no user has this id, so neither model is asked
        dwd, _, users, items = _ctr_parts(spark, sf_dir)
        feats = inter.item_features(dwd, items)
        return rec.ctr_recommend_user(None, None, users, inter.ctr_item_features(feats), feats, -1)
    QUERIES["ctr_recommend_new_user"] = ctr_new_user

    for name, sql in SIMILARITY_ORACLE.items():
        views = [v for v in ("behaviors", "attractions") if v in sql]
        ORACLE[name] = fx.with_views(sql, *views) if views else sql


_TEXT_PART = ("CASE WHEN {c} IS NULL OR {c} = '' THEN '' "
              "WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN array_to_string(from_json({c}, '[\"VARCHAR\"]'), ' ') "
              "WHEN NOT json_valid({c}) THEN {c} ELSE '' END")
_TAG_LIST = ("CASE WHEN tagNameList IS NULL OR tagNameList = '' THEN ['unknown'] "
             "WHEN json_valid(tagNameList) AND json_type(tagNameList) = 'ARRAY' THEN "
             "CASE WHEN len(from_json(tagNameList, '[\"VARCHAR\"]')) = 0 THEN ['unknown'] "
             "ELSE from_json(tagNameList, '[\"VARCHAR\"]') END ELSE [tagNameList] END")
_ZEROS64 = "list_transform(range(64), lambda k: CAST(0.0 AS DOUBLE))"


def _dense_sql(src: str, size: int) -> str:
    return (f"SELECT poi_id, list_transform(range({size}), lambda i: coalesce(list_sum(list_transform("
            f"list_filter(e, lambda x: x.bucket = i), lambda x: x.value)), CAST(0.0 AS DOUBLE))) AS v "
            f"FROM (SELECT poi_id, list({{'bucket': bucket, 'value': value}}) AS e FROM {src} GROUP BY poi_id)")


SIMILARITY_ORACLE = {
    "ctr_auc_heat": _I_CTE + _index_ctes("kept") + _neg_cte(2, 2024) + _FEATURES_CTE + """,
train AS (SELECT item_idx, 1 AS label FROM pos UNION ALL SELECT item_idx, 0 FROM neg),
counts AS (SELECT f.heat, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
  FROM train JOIN feat f USING (item_idx) GROUP BY f.heat),
below AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY heat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM counts)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
  round(CAST(sum(p * (less + n / 2.0::DOUBLE)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 6) AS auc FROM below""",
    "cold_start_hit_rate": _I_CTE + _index_ctes("kept") + _FEATURES_CTE + """,
top AS (SELECT poi_id FROM zfeat ORDER BY heat DESC, poi_id ASC LIMIT 100),
later AS (SELECT DISTINCT user_id, poi_id FROM kept WHERE event_id % 8 = 0),
per_user AS (SELECT user_id, count(*) AS pairs, count(*) FILTER (poi_id IN (SELECT poi_id FROM top)) AS hits FROM later GROUP BY user_id)
SELECT count(*) AS users, count(*) FILTER (hits > 0) AS hit_users, CAST(sum(hits) AS BIGINT) AS hits,
  round(count(*) FILTER (hits > 0) / count(*)::DOUBLE, 6) AS hit_rate, round(sum(hits)::DOUBLE / sum(pairs)::DOUBLE, 6) AS recall
FROM per_user""",
    "cf_recommend_factors": """
WITH u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT a.id AS user_idx, b.id AS item_idx, list_inner_product(a.e, b.e) AS score
  FROM u a JOIN u b ON a.id % 2 = 1 AND b.id % 2 = 0)
SELECT user_idx + 1000 AS user_id, rank, item_idx * 3 AS poi_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx ASC) AS rank FROM scored) WHERE rank <= 10""",
    "cf_saved_model": _I_CTE + _index_ctes("interactions") + """
SELECT user_id, CAST(least(10, (SELECT count(*) FROM items)) AS BIGINT) AS recommended, CAST(0 AS BIGINT) AS differing FROM users""",
    "tag_hash_vector": f"""
WITH toks AS (SELECT poiId AS poi_id, unnest({_TAG_LIST}) AS t FROM attractions),
counts AS (SELECT poi_id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 512 AS INTEGER) AS bucket,
  CAST(count(*) AS DOUBLE) AS n FROM toks GROUP BY 1, 2)
SELECT poi_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY poi_id)), 6) AS value FROM counts""",
    "cosine_top_k": """
WITH u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nn AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS nrm FROM u),
pairs AS (SELECT a.id AS query_id, b.id AS neighbor_id,
  list_inner_product(a.e, b.e) / ((a.nrm + 1e-9) * (b.nrm + 1e-9)) AS score
  FROM nn a JOIN nn b ON a.id <> b.id)
SELECT query_id, rank, neighbor_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id ASC) AS rank FROM pairs)
WHERE rank <= 10""",
    "cosine_top_k_lsh": f"""
WITH u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nn AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS nrm FROM u),
planes AS (SELECT t, b, list(CASE WHEN ('0x' || substr(md5(t || ':' || b || ':' || d), 1, 2))::BIGINT % 2 = 1
    THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ORDER BY d) AS p
  FROM range({lsh.TABLES}) a(t), range({lsh.BITS}) c(b), (SELECT unnest(range((SELECT max(len(e)) FROM u))) AS d) GROUP BY t, b),
keys AS (SELECT id, t, CAST(sum(CASE WHEN list_inner_product(e, p) >= 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS key
  FROM nn, planes GROUP BY id, t),
met AS (SELECT DISTINCT a.id AS query_id, b.id AS neighbor_id FROM keys a JOIN keys b ON a.t = b.t
  WHERE a.id % 20 = 0 AND a.id <> b.id AND bit_count(xor(a.key, b.key)) <= 1),
pairs AS (SELECT a.id AS query_id, b.id AS neighbor_id,
  list_inner_product(a.e, b.e) / ((a.nrm + 1e-9) * (b.nrm + 1e-9)) AS score
  FROM nn a JOIN nn b ON a.id <> b.id WHERE a.id % 20 = 0),
exact AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id ASC) <= 10),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id ASC) AS rank
  FROM pairs JOIN met USING (query_id, neighbor_id))
SELECT query_id, rank, neighbor_id, round(score, 6) AS score,
  round((SELECT count(*) FROM exact SEMI JOIN found USING (query_id, neighbor_id)) / (SELECT count(*) FROM exact)::DOUBLE, 6) AS recall
FROM found WHERE rank <= 10""",
    "similar_pois": f"""
WITH u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nn AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS nrm FROM u),
pairs AS (SELECT a.id AS query_id, b.id AS neighbor_id,
  list_inner_product(a.e, b.e) / ((a.nrm + 1e-9) * (b.nrm + 1e-9)) AS score
  FROM nn a JOIN nn b ON a.id <> b.id WHERE a.id IN ({', '.join(map(str, REQUESTED_POIS))}))
SELECT query_id, rank, neighbor_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id ASC) AS rank FROM pairs)
WHERE rank <= 10""",
    "text_embeddings": f"""
WITH txt AS (SELECT poiId AS poi_id, trim(concat_ws('. ', coalesce(poiName, ''), {_TEXT_PART.format(c='shortFeatures')},
  {_TEXT_PART.format(c='tagNameList')})) AS text FROM attractions),
ttok AS (SELECT poi_id, unnest(string_split_regex(lower(text), '[ \t\n\r]+')) AS tok FROM txt),
tcnt AS (SELECT poi_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket,
  sum(CASE WHEN ('0x' || substr(md5(tok), 9, 2))::BIGINT % 2 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(-1.0 AS DOUBLE) END) AS n
  FROM ttok WHERE tok <> '' GROUP BY 1, 2),
tsp AS (SELECT poi_id, bucket, CASE WHEN nrm > 0 THEN n / nrm ELSE CAST(0.0 AS DOUBLE) END AS value
  FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY poi_id)) AS nrm FROM tcnt)),
tden AS ({_dense_sql('tsp', 64)})
SELECT x.poi_id, list_transform(coalesce(t.v, {_ZEROS64}), lambda x: round(x, 6) + 0.0) AS vector
FROM txt x LEFT JOIN tden t ON t.poi_id = x.poi_id""",
    "multimodal_vector": f"""
WITH txt AS (SELECT poiId AS poi_id, trim(concat_ws('. ', coalesce(poiName, ''), {_TEXT_PART.format(c='shortFeatures')},
  {_TEXT_PART.format(c='tagNameList')})) AS text FROM attractions),
ttok AS (SELECT poi_id, unnest(string_split_regex(lower(text), '[ \t\n\r]+')) AS tok FROM txt),
tcnt AS (SELECT poi_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket,
  sum(CASE WHEN ('0x' || substr(md5(tok), 9, 2))::BIGINT % 2 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(-1.0 AS DOUBLE) END) AS n
  FROM ttok WHERE tok <> '' GROUP BY 1, 2),
tsp AS (SELECT poi_id, bucket, CASE WHEN nrm > 0 THEN n / nrm ELSE CAST(0.0 AS DOUBLE) END AS value
  FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY poi_id)) AS nrm FROM tcnt)),
tg AS (SELECT poiId AS poi_id, unnest({_TAG_LIST}) AS t FROM attractions),
gcnt AS (SELECT poi_id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 512 AS INTEGER) AS bucket,
  CAST(count(*) AS DOUBLE) AS n FROM tg GROUP BY 1, 2),
gsp AS (SELECT poi_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY poi_id)) AS value FROM gcnt),
tden AS ({_dense_sql('tsp', 64)}),
gden AS ({_dense_sql('gsp', 512)}),
img AS (SELECT vec_id AS poi_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
j AS (SELECT a.poiId AS poi_id, i.e AS image, coalesce(t.v, {_ZEROS64}) AS text, g.v AS tags
  FROM attractions a LEFT JOIN img i ON i.poi_id = a.poiId LEFT JOIN tden t ON t.poi_id = a.poiId
  LEFT JOIN gden g ON g.poi_id = a.poiId),
n1 AS (SELECT *, sqrt(list_sum(list_transform(image, lambda x: x * x))) AS ni,
  sqrt(list_sum(list_transform(text, lambda x: x * x))) AS nt FROM j),
n2 AS (SELECT poi_id,
  coalesce(CASE WHEN ni = 0 THEN image ELSE list_transform(image, lambda x: x / ni) END, {_ZEROS64}) AS img,
  CASE WHEN nt = 0 THEN text ELSE list_transform(text, lambda x: x / nt) END AS txt, tags FROM n1),
c AS (SELECT poi_id, list_concat(list_concat(img, txt), tags) AS v FROM n2),
n3 AS (SELECT poi_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM c)
SELECT poi_id, list_transform(CASE WHEN nv = 0 THEN v ELSE list_transform(v, lambda x: x / nv) END,
  lambda x: round(x, 6) + 0.0) AS vector FROM n3""",
    "poi_text": f"""
SELECT poiId AS poi_id, trim(concat_ws('. ', coalesce(poiName, ''), {_TEXT_PART.format(c='shortFeatures')},
  {_TEXT_PART.format(c='tagNameList')})) AS text FROM attractions""",
}

_register_similarity()


# ---- landing, summary and streaming ---------------------------------------------

_CARD_FIELDS = ["poiId", "poiName", "price", "hasVideo", "tagNameList", "districtName", "geo"]


_INGESTS = {"click": "ingest_click", "detail": "ingest_detail_view",
            "favorite": "ingest_favorite", "comment": "ingest_comment"}
STREAM_REQUESTS_ORACLE = "\nUNION ALL BY NAME\n".join(
    f"SELECT '{kind}' AS kind, * FROM ({BEHAVIOR_ORACLE[name]})" for kind, name in _INGESTS.items())


def _register_landing() -> None:
    def cards(spark, sf_dir):
        a = fx.attractions(spark, sf_dir)
        body = F.struct("poiId", "poiName", "price", "hasVideo", "tagNameList", "districtName",
                        F.struct("districtId", "zoneName").alias("geo"))
        raw = F.when(F.col("poiId") % 2 == 0, F.to_json(F.struct(body.alias("card")))).otherwise(F.to_json(body))
        return landing.card_flatten(a.select(raw.alias("raw")), "raw", _CARD_FIELDS)
    QUERIES["card_flatten"] = cards

    QUERIES["crawl_stamp"] = lambda spark, sf_dir: landing.crawl_stamp(
        fx.attractions(spark, sf_dir).select("poiId", "districtName"), 7, "")
    QUERIES["crawl_stamp_named"] = lambda spark, sf_dir: landing.crawl_stamp(
        fx.attractions(spark, sf_dir).select("poiId", "districtName"), 7, "杭州")

    def union_append(spark, sf_dir):
        old = fx.ods_attractions(spark, sf_dir)
        new = fx.attractions(spark, sf_dir).select("poiId", "poiName", "heatScore", "districtName")
        return landing.schema_union_append(old, new)
    QUERIES["schema_union_append"] = union_append

    def stream_ingest(spark, sf_dir):
        schema = read_table(spark, sf_dir, "events").schema
        src = stream.event_source(spark, sf_dir, "events.parquet", schema)
        out = stream.ingest_events(stream.events_to_requests(src), fx.profiles(spark, sf_dir))
        path = stream.scratch_path(spark, "stream-ingest")
        stream.run_append(out, path + "/out", path + "/checkpoint")
        # the generic log has none of the kinds' own fields
        own = [c for kind in behavior.KINDS for c in behavior.EXTRAS[kind]]
        return spark.read.parquet(path + "/out").drop(*own)
    QUERIES["stream_ingest_events"] = stream_ingest

    def stream_requests(spark, sf_dir):
        path = stream.scratch_path(spark, "stream-requests")
        images = F.from_json(F.nullif(F.col("image_urls"), F.lit("")), "array<string>")
        (fx.view(spark, sf_dir, "requests").withColumn("images", images).drop("image_urls")
         .write.parquet(path + "/in"))
        src = stream.event_source(spark, path + "/in", "*.parquet", spark.read.parquet(path + "/in").schema)
        out = stream.ingest_events(src, fx.profiles(spark, sf_dir), ingest_time=F.lit(INGEST_TIME))
        stream.run_append(out, path + "/out", path + "/checkpoint")
        return spark.read.parquet(path + "/out")
    QUERIES["stream_ingest_requests"] = stream_requests

    def stream_favorites(spark, sf_dir):
        path = stream.scratch_path(spark, "stream-favorites")
        fav = _events(spark, sf_dir, "favorite")
        fav.write.parquet(path + "/in")
        src = stream.event_source(spark, path + "/in", "*.parquet", spark.read.parquet(path + "/in").schema)
        stream.run_state_updates(stream.favorite_state_stream(src), path + "/state", path + "/checkpoint")
        return stream.latest_state(spark, path + "/state", ["user_id", "poi_id"])
    QUERIES["stream_favorite_state"] = stream_favorites

    for name, sql in LANDING_ORACLE.items():
        views = [v for v in ("attractions", "ods_attractions", "behaviors", "profiles") if v in sql]
        ORACLE[name] = fx.with_views(sql, *views) if views else sql
    ORACLE["stream_ingest_requests"] = fx.with_views(STREAM_REQUESTS_ORACLE, "requests", "profiles")


_STREAM_REASON = """CASE WHEN kind IS NULL THEN 'unknown_kind'
    WHEN poi_id IS NULL OR poi_id = 0 THEN 'missing_poi_id'
    WHEN user_id0 IS NOT NULL AND user_id0 <> 0 AND pid IS NULL THEN 'unknown_user' END"""
LANDING_ORACLE = {
    "card_flatten": """
SELECT CAST(poiId AS VARCHAR) AS poiId, poiName, CAST(price AS VARCHAR) AS price,
  CAST(hasVideo AS VARCHAR) AS hasVideo, tagNameList, districtName,
  CAST(json_object('districtId', districtId, 'zoneName', zoneName) AS VARCHAR) AS geo
FROM attractions""",
    "crawl_stamp": """
SELECT poiId, districtName, CAST(7 AS BIGINT) AS crawlDistrictId, districtName AS crawlDistrictName
FROM attractions""",
    "crawl_stamp_named": """
SELECT poiId, districtName, CAST(7 AS BIGINT) AS crawlDistrictId, '杭州' AS crawlDistrictName FROM attractions""",
    "schema_union_append": """
SELECT '' AS districtName, '' AS heatScore, marketPrice, poiId, poiName, price, "timestamp" FROM ods_attractions
UNION ALL
SELECT coalesce(districtName, NULL), CAST(heatScore AS VARCHAR), '', CAST(poiId AS VARCHAR), poiName, '', ''
FROM attractions""",
    "stream_ingest_events": f"""
WITH r AS (
  SELECT e.event_id AS id, CASE e.event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'detail' END AS kind,
    e.user_id AS user_id0, TRY_CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS poi_id, e.ts AS occurred_at,
    p.id AS pid
  FROM events e LEFT JOIN profiles p ON e.user_id IS NOT NULL AND e.user_id <> 0 AND p.id = e.user_id)
SELECT id, kind, CASE WHEN user_id0 IS NULL OR user_id0 = 0 THEN (SELECT max(id) + 1 FROM profiles) ELSE pid END AS user_id,
  poi_id, CASE kind WHEN 'click' THEN 'attraction_list' WHEN 'detail' THEN 'detail_page' END AS scene, 'web' AS device,
  occurred_at, ({_STREAM_REASON}) IS NULL AS accepted, {_STREAM_REASON} AS reject_reason
FROM r""",
    "stream_favorite_state": BEHAVIOR_ORACLE["favorite_state"],
}

_register_landing()


# ---- scans and options ------------------------------------------------------------

def _sections(doc: DataFrame) -> DataFrame:
    """A summary document as (section, body) rows, the body as JSON text."""
    parts = [F.struct(F.lit(c).alias("section"), (F.col(c) if t == "string" else F.to_json(c, {"ignoreNullFields": "false"}))
                      .alias("body")) for c, t in doc.dtypes]
    return doc.select(F.inline(F.array(*parts)))


def _digest_model():
    """A fixed two-input model whose vectors SQL can state: token and byte counts, image size and byte sum."""
    import numpy as np

    def predict(texts, images):
        return np.array([[len(t.split()), len(t.encode()), len(i), sum(i) % 997] for t, i in zip(texts, images)], np.float32)
    return predict


def _register_stored() -> None:
    def typed_csv(spark, sf_dir):
        path = shared_path(spark, "landing")
        a = fx.attractions(spark, sf_dir)
        name = F.when(F.col("poiId") % 3 == 0, F.concat("poiName", F.lit('\n"second", line'))).otherwise(F.col("poiName"))
        writers.write_landing(a.select("poiId", name.alias("poiName"), "price", "tagNameList"), f"{path}/good")
        # lines that no schema fits: text where numbers belong
        bad = read_table(spark, sf_dir, "supplier").select(
            F.concat(F.lit("x"), "s_suppkey").alias("poiId"), F.col("s_name").alias("poiName"), F.lit("free").alias("price"),
            F.lit(None).cast("string").alias("tagNameList"))
        writers.write_landing(bad, f"{path}/bad")
        schema = a.select("poiId", "poiName", "price", "tagNameList").schema
        scan = landing.read_typed_csv(spark, [f"{path}/good", f"{path}/bad"], schema, multiline=True)
        return scan.withColumn(landing.REFUSED, F.rtrim(F.col(landing.REFUSED), F.lit("\r\n")))
    QUERIES["csv_landing_typed"] = typed_csv
    QUERIES["csv_landing_refused"] = lambda spark, sf_dir: landing.refused_lines(materialized(typed_csv(spark, sf_dir), "landing"))

    def catalog_tables(spark, *names):
        """Names of new external tables in the shared folder, and what drops them."""
        made = {n: (f"poi_{n}_{uuid.uuid4().hex}", shared_path(spark, n)) for n in names}

        def drop():
            for table, path in made.values():
                spark.sql(f"DROP TABLE IF EXISTS `{table}`")
                remove(spark, path)
        return made, drop

    def dwd_catalog(spark, sf_dir):
        made, drop = catalog_tables(spark, "typed", "dwd")
        (typed, typed_path), (dwd, dwd_path) = made["typed"], made["dwd"]
        ods = fx.ods_attractions(spark, sf_dir)
        newest = F.coalesce(F.col("poiName").contains(" v2"), F.lit(False))
        layers.stage_typed(ods.where(~newest), typed, buckets=_BUCKETS, path=typed_path)
        layers.stage_typed(ods.where(newest), typed, "append", buckets=_BUCKETS, path=typed_path)
        layers.build_dwd_table(spark, "default", typed, dwd, _BUCKETS, dwd_path)
        out = materialized(tables.table_scan(spark, "default", dwd), "dwd-result")
        drop()
        return out
    QUERIES["dwd_catalog"] = dwd_catalog

    def interactions_catalog(spark, sf_dir):
        made, drop = catalog_tables(spark, "events", "pois")
        (events, events_path), (pois, pois_path) = made["events"], made["pois"]
        writers.write_bucketed(_interactions(spark, sf_dir), events, "poi_id", _BUCKETS, path=events_path)
        writers.write_bucketed(fx.attractions(spark, sf_dir), pois, "poiId", _BUCKETS, path=pois_path)
        out = materialized(layers.known_interactions(spark, "default", events, pois), "known-interactions")
        drop()
        return out
    QUERIES["interactions_catalog"] = interactions_catalog

    def mart_catalog(spark, sf_dir):
        made, drop = catalog_tables(spark, "mart")
        table, path = made["mart"]
        mart = home.home_city_overview(fx.attractions(spark, sf_dir))
        writers.write_mart(mart, table, SCHEMAS["home_city_overview"], as_table=True, path=path)
        out = materialized(tables.table_scan(spark, "default", table), "mart-result")
        drop()
        return out
    QUERIES["mart_catalog"] = mart_catalog

    def store_update(spark, sf_dir):
        path = shared_path(spark, "profiles")
        profile_store.create_store(fx.profiles(spark, sf_dir), path, width=500)
        segment = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY'")
        updates = segment.select(F.col("c_name").alias("username"), F.lit(None).cast("string").alias("nickname"),
                                 F.lower("c_mktsegment").alias("city"))
        profile_store.apply_updates(spark, path, updates.where("city = 'building'"), partial=True)
        profile_store.apply_updates(spark, path, updates.where("city = 'machinery'"), partial=False)
        return profile_store.read_store(spark, path)
    QUERIES["profile_store_update"] = store_update

    def model_vectors(spark, sf_dir):
        text = _texts(spark, sf_dir).join(read_table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("poi_id"), F.col("text").alias("about")), "poi_id")
        image = fx.attractions(spark, sf_dir).select(F.col("poiId").alias("poi_id"), F.encode("coverImageUrl", "UTF-8").alias("image"))
        j = text.join(image, "poi_id", "left")
        both = F.concat_ws(" ", "text", "about")
        vector = rec.embed_text_and_image(both, F.col("image"), _digest_model, dim=4)
        return j.select("poi_id", F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    QUERIES["model_embeddings"] = model_vectors

    for name, sql in STORED_ORACLE.items():
        views = [v for v in ("attractions", "ods_attractions", "behaviors", "profiles") if re.search(rf"\b{v}\b", sql)]
        ORACLE[name] = fx.with_views(sql, *views)


_BUCKETS = 16  # of the registered queries' small tables
_LANDING_SQL = """
WITH good AS (SELECT poiId, CASE WHEN poiId % 3 = 0 THEN poiName || chr(10) || '"second", line' ELSE poiName END AS poiName, price, tagNameList,
  CAST(NULL AS VARCHAR) AS _refused FROM attractions),
lines AS (SELECT * FROM good UNION ALL
  SELECT NULL, s_name, NULL, NULL, 'x' || s_suppkey || ',' || s_name || ',free,' FROM supplier)"""
STORED_ORACLE = {
    "csv_landing_typed": _LANDING_SQL + "\nSELECT * FROM lines",
    "csv_landing_refused": _LANDING_SQL + "\nSELECT count(*) AS lines, count(_refused) AS refused FROM lines",
    "dwd_catalog": clean.ORACLE["dwd_clean"],
    "interactions_catalog": INTERACTION_ORACLE["interactions_with_items"],
    "mart_catalog": home.ORACLE["home_city_overview"],
    "profile_store_update": """
SELECT p.id, p.external_id, p.username, CASE WHEN c.c_mktsegment = 'MACHINERY' THEN '' ELSE p.nickname END AS nickname,
  p.email, p.gender, coalesce(lower(c.c_mktsegment), p.city) AS city
FROM profiles p LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) c ON c.c_name = p.username""",
    "model_embeddings": """
WITH txt AS (SELECT poiId AS poi_id, concat_ws(' ', trim(concat_ws('. ', coalesce(poiName, ''), """ + _TEXT_PART.format(c="shortFeatures") + """,
    """ + _TEXT_PART.format(c="tagNameList") + """)), d.text) AS t, coalesce(coverImageUrl, '') AS i
  FROM attractions a JOIN documents d ON d.doc_id = a.poiId),
cut AS (SELECT poi_id, i, list_slice(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> ''), 1, 77) AS toks FROM txt)
SELECT poi_id, [CAST(len(toks) AS DOUBLE), CAST(strlen(array_to_string(toks, ' ')) AS DOUBLE), CAST(strlen(i) AS DOUBLE),
  CAST(coalesce(list_sum(list_transform(range(1, strlen(i) + 1), lambda k: ('0x' || substr(hex(i), CAST(2 * k - 1 AS BIGINT), 2))::BIGINT)), 0) % 997 AS DOUBLE)] AS vector
FROM cut""",
}

_register_stored()


_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE"}
_MART_SQL = {**home.ORACLE, **screen.ORACLE, **pages.ORACLE}


def _row_sql(mart: str) -> str:
    """A mart's row as a struct of its declared columns."""
    fields = [(f.name, _SQL_TYPES[f.dataType.simpleString()]) for f in SCHEMAS[mart].fields]
    return "{" + ", ".join(f"'{c}': CAST(\"{c}\" AS {t})" for c, t in fields) + "}"


def _folded_sql(mart: str, single: bool = False) -> str:
    """A mart as JSON text: its one row, or the array of its rows in order of their columns."""
    order = ", ".join(f'"{f.name}" NULLS FIRST' for f in SCHEMAS[mart].fields)
    body = f"first({_row_sql(mart)})" if single else f"list({_row_sql(mart)} ORDER BY {order})"
    return f"(SELECT CAST(to_json({body}) AS VARCHAR) FROM ({_MART_SQL[mart]}))"


def _summary_oracles() -> dict[str, str]:
    def document(sections: dict[str, str]) -> str:
        rows = ["SELECT 'generatedAt' AS section, '2024-06-01T00:00:00+00:00' AS body"]
        return "\nUNION ALL\n".join([*rows, *(f"SELECT '{k}', {body}" for k, body in sections.items())])

    def keyed(keys: dict[str, str]) -> str:
        return document({k: _folded_sql(mart, k == "cards") for k, mart in keys.items() if k not in jobs.UNBOUNDED})

    groups = {g: " || ',' || ".join(f"'\"{n.removeprefix('pages_')}\":' || {_folded_sql(n)}"
                                    for n in pages.BUILDERS if jobs.PAGE_GROUP[n] == g) for g in jobs.PAGE_GROUPS}
    mart = "home_recent_trend"
    return {
        "summary_home": keyed(jobs.HOME_KEYS),
        "summary_screen": keyed(jobs.SCREEN_KEYS),
        "summary_pages": document({g: f"'{{' || {body} || '}}'" for g, body in groups.items()}),
        "summary_rows_recent_trend": f"SELECT '{mart}' AS mart, CAST(to_json({_row_sql(mart)}) AS VARCHAR) AS row FROM ({_MART_SQL[mart]})",
    }


def _register_scans() -> None:
    QUERIES["item_feature_scan"] = lambda spark, sf_dir: tables.item_feature_scan(fx.attractions(spark, sf_dir))
    QUERIES["content_scan"] = lambda spark, sf_dir: tables.content_scan(fx.attractions(spark, sf_dir))
    QUERIES["behavior_scan"] = lambda spark, sf_dir: tables.behavior_scan(_events(spark, sf_dir, "click"))
    QUERIES["screen_map_heat_merged"] = lambda spark, sf_dir: screen.screen_map_heat(
        fx.attractions(spark, sf_dir), merge=True)
    QUERIES["pages_media_distance_metric"] = lambda spark, sf_dir: pages.pages_media_distance(
        pages.prepare(fx.attractions(spark, sf_dir), legacy_units=False))
    for family in jobs.FAMILIES:
        def summary(spark, sf_dir, family=family):
            doc = jobs.summary(jobs.shared_input(fx.attractions(spark, sf_dir), family), family,
                               generated_at="2024-06-01T00:00:00+00:00")
            return _sections(doc)
        QUERIES[f"summary_{family}"] = summary
    QUERIES["summary_rows_recent_trend"] = lambda spark, sf_dir: writers.summary_rows(
        {"home_recent_trend": home.home_recent_trend(fx.attractions(spark, sf_dir))})
    for name, sql in {**SCAN_ORACLE, **_summary_oracles()}.items():
        views = [v for v in ("attractions", "behaviors") if v in sql]
        # the marts' filters must reach the view's rows before their JSON functions do
        ORACLE[name] = fx.with_views(sql, *views).replace("attractions AS (", "attractions AS NOT MATERIALIZED (", 1)


_METRIC_DIST = ("CASE WHEN contains(lower(distanceStr), 'km') "
                "THEN try_cast(regexp_extract(distanceStr, '([0-9.]+)', 1) AS DOUBLE) "
                "WHEN contains(lower(distanceStr), 'm') "
                "THEN try_cast(regexp_extract(distanceStr, '([0-9.]+)', 1) AS DOUBLE) / 1000 "
                "ELSE try_cast(regexp_extract(distanceStr, '([0-9.]+)', 1) AS DOUBLE) END")
SCAN_ORACLE = {
    "item_feature_scan": "SELECT poiId, districtName, price, heatScore, commentScore, tagNameList FROM attractions",
    "content_scan": """
SELECT poiId, poiName, shortFeatures, tagNameList, coverImageUrl, detailUrl, districtName, heatScore, commentScore
FROM attractions WHERE coverImageUrl IS NOT NULL AND coverImageUrl <> ''""",
    "behavior_scan": """
SELECT user_id, poi_id FROM behaviors
WHERE kind = 'click' AND user_id IS NOT NULL AND user_id <> 0 AND poi_id IS NOT NULL AND poi_id <> 0""",
    "screen_map_heat_merged": f"""
SELECT {normalize_region_sql('crawlDistrictName')} AS name, count(DISTINCT poiId) AS value FROM attractions
GROUP BY 1 ORDER BY value DESC, name ASC NULLS FIRST LIMIT {screen.MAP_LIMIT}""",
    "pages_media_distance_metric": f"""
SELECT {bucketize_sql('km', pages.DISTANCE_BUCKETS, pages.DISTANCE_DEFAULT)} AS bucket, count(*) AS count,
  round(avg(heatScore), 4) AS avgHeat
FROM (SELECT {_METRIC_DIST} AS km, heatScore FROM attractions) WHERE km IS NOT NULL GROUP BY 1""",
}

_register_scans()


#: Registered queries that DuckDB cannot state, and why.
NO_ORACLE = {
    "cf_recommend": "the factors come from a fitted ALS model",
    "cf_recommend_user": "the factors come from a fitted ALS model",
    "ctr_scores": "the scores come from a fitted network",
    "ctr_recommend_user": "the scores come from a fitted network",
    "ctr_recommend_users": "the scores come from a fitted network",
    "fm_scores": "the scores come from a fitted factorization machine",
}
