"""User behaviour events and profiles (K1-K13, E3-E5) as table jobs.

The four event tables share (id, user_id, poi_id, scene, device, occurred_at)
and add their own columns.  Ingest validates request rows in bulk (a flag and a
reason per row instead of an HTTP error), applying the same defaults the write
path applies; look-ups become joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsoncols import STRING_ARRAY
from ..sources.tables import truthy_id

# Event kinds, their extra columns and the write-path defaults.
KINDS = ("click", "detail", "favorite", "comment")
DEFAULTS = {
    "click": {"scene": "attraction_list", "device": "web", "exposure_id": ""},
    "detail": {"scene": "detail_page", "device": "web", "stay_seconds": 0},
    "favorite": {"scene": "frontend", "device": "web", "is_favorite": True},
    "comment": {"scene": "detail_page", "device": "web", "rating": 0, "content": "", "image_urls": "[]"},
}
EXTRA_TYPES = {"exposure_id": "string", "stay_seconds": "int", "is_favorite": "boolean",
               "rating": "int", "content": "string", "image_urls": "string", "from_click_id": "bigint",
               "note": "string"}
COMMON = ["id", "user_id", "poi_id", "scene", "device", "occurred_at"]
EXTRAS = {
    "click": ["exposure_id"],
    "detail": ["stay_seconds", "from_click_id"],
    "favorite": ["is_favorite", "note"],
    "comment": ["rating", "content", "image_urls"],
}
DEMO_USERNAME = "demo_user"
DEMO_NICKNAME = "体验用户"
# Profile model limits and choices.
GENDERS = ("male", "female", "unknown")
MAX_LEN = {"username": 50, "nickname": 50, "phone": 20, "city": 50, "scene": 32, "device": 32,
           "exposure_id": 64, "note": 200}
PROFILE_FIELDS = ["id", "external_id", "username", "nickname", "email", "phone", "gender", "city",
                  "avatar", "created_at", "updated_at"]
PROFILE_WRITABLE = ["nickname", "email", "phone", "gender", "city", "avatar"]
ACCOUNT_FIELDS = ["id", "username", "email", "first_name", "last_name"]


def event_table(events: DataFrame, kind: str) -> DataFrame:
    """One event table out of a mixed event log with a ``kind`` column."""
    cols = COMMON + EXTRAS[kind]
    present = set(events.columns)
    return events.where(F.col("kind") == kind).select(*[
        F.col(c) if c in present else F.lit(DEFAULTS[kind].get(c)).cast(EXTRA_TYPES.get(c, "string")).alias(c)
        for c in cols])


def with_demo_profile(profiles: DataFrame) -> DataFrame:
    """K7 on ingest: the profiles, and the demo user's with the next id when there is none."""
    defaults = {"username": F.lit(DEMO_USERNAME), "nickname": F.lit(DEMO_NICKNAME), "email": F.lit(""),
                "gender": F.lit("unknown"), "city": F.lit("")}
    found = profiles.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"),
                         F.count_if(F.col("username") == DEMO_USERNAME).alias("n")).where("n = 0")
    return profiles.unionByName(found.select(*[
        (F.col("id") if f.name == "id" else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in profiles.schema.fields]))


def resolve_profile(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """user_id wins, else username, else the demo profile; unknown -> rejected.

    Adds ``profile_id`` and ``resolve_error``; 0 and '' count as missing.  The demo profile
    is created when missing, so an accepted event always has a user.  Rows that need
    no look-up carry a key of their own that no profile has, so neither nulls nor
    one constant gather the log in one partition; a log without usernames is joined once.
    Profiles are hashed in both joins, so no task sorts its share of the log.
    """
    uid = F.col("user_id").cast("bigint")
    has_uid = truthy_id(uid)
    known = with_demo_profile(profiles)
    demo = known.where(F.col("username") == DEMO_USERNAME).agg(F.min("id")).scalar()
    spread = F.xxhash64(*requests.columns)
    by_id = known.select(F.col("id").alias("_by_id"))
    r = requests.withColumn("_id_key", F.when(has_uid, uid).otherwise(-F.abs(F.shiftright(spread, 1)) - 1))
    r = r.join(by_id.hint("shuffle_hash"), F.col("_id_key") == F.col("_by_id"), "left")
    named = F.lit(False)
    found = F.when(has_uid, F.col("_by_id"))
    if "username" in requests.columns:
        named = ~has_uid & F.col("username").isNotNull() & (F.col("username") != "")
        by_name = known.groupBy(F.col("username").alias("_name")).agg(F.min("id").alias("_by_name"))
        r = r.withColumn("_name_key", F.when(named, F.col("username"))
                         .otherwise(F.concat(F.lit("\x00"), spread.cast("string"))))
        r = r.join(by_name.hint("shuffle_hash"), F.col("_name_key") == F.col("_name"), "left")
        found = found.when(named, F.col("_by_name"))
    r = r.withColumn("profile_id", found.otherwise(demo))
    return (r.withColumn("resolve_error", F.when(F.col("profile_id").isNull(), F.lit("unknown_user")))
            .drop("_id_key", "_by_id", "_name_key", "_name", "_by_name"))


def image_list_json(requests: DataFrame) -> Column:
    """K4: the request's image list as JSON text; no list is ``[]``.

    ``images`` (or ``image_urls``) may be an array, stored as JSON, or JSON text already.
    """
    texts = []
    for name in ("images", "image_urls"):
        if name in requests.columns:
            c = F.col(name)
            texts.append(F.to_json(c) if requests.schema[name].dataType.typeName() == "array"
                         else F.nullif(c.cast("string"), F.lit("")))
    return F.coalesce(*texts, F.lit("[]"))


def event_time(r: DataFrame, now: Column) -> Column:
    """The request's own time when given, else ``now``."""
    if "occurred_at" not in r.columns:
        return now
    return F.coalesce(F.col("occurred_at"), now.cast(r.schema["occurred_at"].dataType))


def request_value(r: DataFrame, c: str, kind: str) -> Column:
    """K1-K4: what an event of ``kind`` stores in column ``c``: the request's value, else the default."""
    if c == "image_urls":
        return image_list_json(r)
    d, typ = DEFAULTS[kind].get(c), EXTRA_TYPES.get(c, "string")
    v = F.col(c).cast(typ) if c in r.columns else F.lit(None).cast(typ)
    return F.coalesce(v, F.lit(d).cast(typ)) if d is not None else v


def ingest(requests: DataFrame, profiles: DataFrame, kind: str,
           ingest_time: Column | None = None) -> DataFrame:
    """K1-K4: validate and default event requests of one kind.

    Output: the event columns with defaults applied, ``user_id`` replaced by
    the resolved profile, plus ``accepted`` and ``reject_reason``.
    A request without a poi_id (null or 0) or with an unknown user is rejected.
    ``occurred_at`` is the request's own time when given, else ``ingest_time``
    (default: the current timestamp).
    """
    now = ingest_time if ingest_time is not None else F.current_timestamp()
    r = resolve_profile(requests, profiles)
    present = set(r.columns)
    out = [F.col("id") if "id" in present else F.lit(None).cast("bigint").alias("id"),
           F.col("profile_id").alias("user_id"),
           F.col("poi_id").cast("bigint").alias("poi_id")]
    out += [request_value(r, c, kind).alias(c) for c in ["scene", "device"] + EXTRAS[kind]]
    out.append(event_time(r, now).alias("occurred_at"))
    reason = (F.when(~truthy_id(F.col("poi_id")), F.lit("missing_poi_id"))
              .otherwise(F.col("resolve_error")))
    out += [reason.isNull().alias("accepted"), reason.alias("reject_reason")]
    return r.select(*out)


def favorite_state(favorites: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """K5: is_favorite of the newest event per (user, poi) (ties by id).

    Without ``pairs``: the state of every pair seen.  With ``pairs``
    (user_id, poi_id): their state, false when no event exists.
    One hash aggregate with map-side partial combine; order-insensitive, so it
    is also the streaming update rule.
    """
    state = (favorites.groupBy("user_id", "poi_id")
             .agg(F.max_by("is_favorite", F.struct("occurred_at", "id")).alias("is_favorite")))
    if pairs is None:
        return state
    return (pairs.join(state, ["user_id", "poi_id"], "left")
            .select("user_id", "poi_id", F.coalesce("is_favorite", F.lit(False)).alias("is_favorite")))


def comment_feed(comments: DataFrame, profiles: DataFrame, poi_id: int | None = None) -> DataFrame:
    """Comments with the author's username and nickname, images parsed
    ('' or null -> []).

    For one poi the rows come newest first; the all-poi table is left unsorted
    (a global sort would add a range shuffle of the whole feed for nothing).
    """
    c = comments if poi_id is None else comments.where(F.col("poi_id") == F.lit(int(poi_id)))
    p = profiles.select(F.col("id").alias("user_id"), F.col("username").alias("user"), "nickname")
    images = F.from_json(F.when(F.col("image_urls").isNull() | (F.col("image_urls") == ""), F.lit("[]"))
                         .otherwise(F.col("image_urls")), STRING_ARRAY)
    out = (c.join(p, "user_id", "inner")
           .select("id", "poi_id", "user", "nickname", "rating", "content", images.alias("images"), "occurred_at"))
    return out if poi_id is None else out.orderBy(F.desc("occurred_at"), F.desc("id"))


def detail_from_click(details: DataFrame, clicks: DataFrame) -> DataFrame:
    """E5: detail views with the click they came from (when any)."""
    c = clicks.select(F.col("id").alias("from_click_id"), F.col("scene").alias("click_scene"),
                      F.col("occurred_at").alias("click_occurred_at"))
    return details.join(c, "from_click_id", "left").select(
        "id", "user_id", "poi_id", "stay_seconds", "from_click_id", "click_scene", "click_occurred_at")


def cascade_delete(events: DataFrame, deleted_profiles: DataFrame) -> DataFrame:
    """Events whose user was removed are removed too."""
    return events.join(deleted_profiles.select(F.col("id").alias("user_id")), "user_id", "left_anti")


def set_null_on_delete(details: DataFrame, deleted_clicks: DataFrame) -> DataFrame:
    """A removed click nulls the from_click_id of the detail views that point at it."""
    gone = deleted_clicks.select(F.col("id").alias("_gone")).hint("shuffle_hash")  # no task sorts its share of the views
    return (details.join(gone, details["from_click_id"] == gone["_gone"], "left")
            .withColumn("from_click_id", F.when(F.col("_gone").isNull(), F.col("from_click_id")))
            .drop("_gone"))


def profile_view(profiles: DataFrame) -> DataFrame:
    """The public profile projection (no password, fixed field list)."""
    cols = [F.col(c) if c in profiles.columns else F.lit(None).cast("string").alias(c) for c in PROFILE_FIELDS]
    return profiles.select(*cols)


def account_view(accounts: DataFrame) -> DataFrame:
    """The public account projection."""
    return accounts.select(*[F.col(c) if c in accounts.columns else F.lit("").alias(c) for c in ACCOUNT_FIELDS])


def profile_get_or_create(profiles: DataFrame, accounts: DataFrame) -> DataFrame:
    """K7: every account username gets a profile; existing profiles keep every column.

    New profiles take the account email ('' when missing) and ids after the
    largest existing id, in username order (a distributed dense index plus a
    scalar-subquery offset); the demo user gets its nickname; columns without a default are null.
    """
    from .interactions import dense_index

    new = (accounts.select("username", F.coalesce(F.col("email"), F.lit("")).alias("email"))
           .where(F.col("username").isNotNull() & (F.col("username") != ""))
           .groupBy("username").agg(F.min("email").alias("email"))
           .join(profiles.select("username"), "username", "left_anti"))
    start = profiles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = new.join(dense_index(new, "username", "_n"), "username")
    made = {"id": start + F.col("_n") + 1, "username": F.col("username"), "email": F.col("email"),
            "nickname": F.when(F.col("username") == DEMO_USERNAME, F.lit(DEMO_NICKNAME)).otherwise(F.lit("")),
            "gender": F.lit("unknown"), "city": F.lit("")}
    return profiles.unionByName(numbered.select(*[
        made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in profiles.schema.fields]))


def profile_update(profiles: DataFrame, updates: DataFrame, partial: bool = True,
                   order_col: str | None = None) -> DataFrame:
    """K8: apply updates keyed by username; read-only fields never change.

    ``partial``: a null field in the update keeps the stored value; otherwise
    every writable field is replaced (a missing value becomes '').  Of several updates of
    one username the newest by ``order_col`` counts (ties and no column: the largest values).
    """
    writable = [c for c in PROFILE_WRITABLE if c in updates.columns]
    latest = F.struct(*([F.col(order_col)] if order_col else []), *[F.col(c) for c in writable])
    u = (updates.groupBy("username").agg(F.max_by(F.struct(*writable), latest).alias("_new"))
         .withColumn("_matched", F.lit(True)))
    j = profiles.join(u, "username", "left")
    cols = []
    for c in profiles.columns:
        new = F.col(f"_new.{c}") if c in writable else None
        if new is None:
            cols.append(F.col(c))
        elif partial:
            cols.append(F.coalesce(new, F.col(c)).alias(c))
        else:
            cols.append(F.when(F.col("_matched"), F.coalesce(new, F.lit(""))).otherwise(F.col(c)).alias(c))
    return j.select(*cols)


_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def registration_check(registrations: DataFrame, users: DataFrame) -> DataFrame:
    """K9: reject a taken username, a username over 150 chars, a password under
    6 chars or a malformed email; passwords are reduced to their length.

    Registrations are taken in the order of their ``id`` (without that column, of email and
    password length), so of several valid ones of a username only the first is accepted.
    """
    taken = users.select(F.col("username").alias("_taken")).distinct()
    pw_len = F.char_length(F.coalesce(F.col("password"), F.lit("")))
    email = F.coalesce(F.col("email"), F.lit(""))
    name = F.col("username")
    reason = (F.when(name.isNull() | (name == ""), F.lit("username_required"))
              .when(F.col("_taken").isNotNull(), F.lit("username_taken"))
              .when(F.char_length(name) > 150, F.lit("username_too_long"))
              .when(pw_len < 6, F.lit("password_too_short"))
              .when((email != "") & ~email.rlike(_EMAIL), F.lit("invalid_email")))
    own = ["id"] if "id" in registrations.columns else []
    r = (registrations.join(taken, registrations["username"] == taken["_taken"], "left")
         .select(*own, name, email.alias("email"), pw_len.alias("password_length"), reason.alias("_reason")))
    # rows that are refused anyway stay out of the ranking of their username
    turn = F.struct(*own, "email", "password_length")
    ok = r.where(F.col("_reason").isNull())
    rank = F.row_number().over(Window.partitionBy("username").orderBy(turn))
    late = F.when(rank > 1, F.lit("username_taken"))
    out = ok.withColumn("_reason", late).unionByName(r.where(F.col("_reason").isNotNull()))
    return out.select(*own, "username", "email", "password_length", F.col("_reason").isNull().alias("accepted"),
                      F.col("_reason").alias("reject_reason"))


def _violations(df: DataFrame, table: Column, checks: list[tuple[Column, Column, Column]]) -> DataFrame:
    """(rule, table, key, value) of every check (rule name, condition, value) that a row fails, in one pass."""
    found = F.array(*[F.when(bad, F.struct(rule.alias("rule"), value.cast("string").alias("value")))
                      for rule, bad, value in checks])
    return (df.select(table.alias("table"), F.col("id").cast("string").alias("key"),
                      F.explode(F.array_compact(found)).alias("v"))
            .select("v.rule", "table", "key", "v.value"))


def _too_long(df: DataFrame, columns) -> list[tuple[Column, Column, Column]]:
    return [(F.lit(f"max_length_{c}"), F.char_length(c) > MAX_LEN[c], F.char_length(c))
            for c in columns if c in df.columns]


def constraint_audit(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """One table of violations (rule, table, key, value).

    ``events`` is the mixed event log (``kind`` names the table).  One pass over each table for the
    row rules (choices, lengths, ranges), one aggregate for the unique columns, and one
    anti join of the log against the profile ids.
    """
    table = F.lit("user_profile")
    gender = F.col("gender")
    own = _violations(profiles, table, [
        (F.lit("gender_choice"), gender.isNull() | ~gender.isin(*GENDERS), gender),
        *_too_long(profiles, ("username", "nickname", "phone", "city"))])
    unique = F.array(*[F.struct(F.lit(f"unique_{c}").alias("rule"), F.col(c).cast("string").alias("key"))
                       for c in ("username", "external_id") if c in profiles.columns])
    repeated = (profiles.select(F.explode(unique).alias("u")).where(F.col("u.key").isNotNull())
                .groupBy("u.rule", "u.key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
                .select("rule", table.alias("table"), "key", F.col("n").cast("string").alias("value")))
    log = F.concat(F.lit("user_"), F.col("kind"), F.lit("_behavior"))
    checks = _too_long(events, ("scene", "device", "exposure_id", "note"))
    if "rating" in events.columns:
        checks.append((F.lit("rating_range"), (F.col("kind") == "comment") & ~F.col("rating").between(0, 5), F.col("rating")))
    if "stay_seconds" in events.columns:
        checks.append((F.lit("stay_seconds_nonnegative"), (F.col("kind") == "detail") & (F.col("stay_seconds") < 0),
                       F.col("stay_seconds")))
    orphans = (events.join(profiles.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_anti")
               .select(F.lit("fk_user").alias("rule"), log.alias("table"), F.col("id").cast("string").alias("key"),
                       F.col("user_id").cast("string").alias("value")))
    return own.unionByName(repeated).unionByName(_violations(events, log, checks)).unionByName(orphans)


def search_events(events: DataFrame, profiles: DataFrame, text: str | None = None, fields=("username", "poi_id"),
                  facets=None, columns=None) -> DataFrame:
    """D10 over an event table: 'contains' over the author's username and the table's own columns."""
    from .search import search_table

    names = profiles.select(F.col("id").alias("user_id"), "username")
    return search_table(events.join(names, "user_id"), text, fields, facets, columns)
