"""Structured Streaming versions of the behaviour ingest (K1-K4) and the
favorite state (K5).

Sources are file streams (``readStream``); sinks are Parquet (append) or a
``foreachBatch`` writer for the aggregated state.  Checkpoints live under the
session's ``spark.checkpoint.dir`` (shared storage on a cluster), so a restarted
query resumes where it stopped.  For large favorite state set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import behavior
from ..session import checkpoint_dir
from ..sources.tables import truthy_id

# How the generic event log maps onto behaviour kinds.
EVENT_KINDS = {"click": "click", "view": "detail"}


def event_source(spark: SparkSession, directory: str, file_glob: str, schema: StructType,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the matching Parquet files of ``directory``."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def events_to_requests(events: DataFrame) -> DataFrame:
    """Generic log rows (event_id, ts, user_id, event_type, props) as behaviour
    requests; the poi is the ``k`` field of ``props``; other event types keep a
    null kind and are rejected downstream."""
    kind = None
    for src, dst in EVENT_KINDS.items():
        cond = F.col("event_type") == src
        kind = F.when(cond, F.lit(dst)) if kind is None else kind.when(cond, F.lit(dst))
    return events.select(
        F.col("event_id").alias("id"), kind.alias("kind"), F.col("user_id"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("poi_id"),
        F.col("ts").alias("occurred_at"))


def ingest_events(requests: DataFrame, profiles: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """K1-K4 over a mixed request stream: kind, poi and user checks plus each kind's defaults.

    The columns of all kinds are kept, filled by the rules of ``behavior.ingest``; a column of
    another kind is null, and so are all of them for an unknown kind.  Works on batch and streaming
    frames alike (the profile look-up is a stream-static join)."""
    r = behavior.resolve_profile(requests, profiles)

    def by_kind(c: str, kinds: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(F.col("kind") == k, behavior.request_value(r, c, k)) for k in kinds])

    scene = by_kind("scene", behavior.KINDS)
    if "scene" in requests.columns:
        scene = F.coalesce(F.col("scene"), scene)
    device = F.coalesce(F.col("device"), F.lit("web")) if "device" in requests.columns else F.lit("web")
    extras = [by_kind(c, (k,)).alias(c) for k in behavior.KINDS for c in behavior.EXTRAS[k]]
    now = ingest_time if ingest_time is not None else F.current_timestamp()
    known = F.coalesce(F.col("kind").isin(*behavior.KINDS), F.lit(False))
    reason = (F.when(~known, F.lit("unknown_kind"))
              .when(~truthy_id(F.col("poi_id")), F.lit("missing_poi_id"))
              .otherwise(F.col("resolve_error")))
    return r.select("id", "kind", F.col("profile_id").alias("user_id"), F.col("poi_id").cast("bigint").alias("poi_id"),
                    scene.alias("scene"), device.alias("device"), *extras,
                    behavior.event_time(r, now).alias("occurred_at"), reason.isNull().alias("accepted"),
                    reason.alias("reject_reason"))


def favorite_state_stream(favorites: DataFrame) -> DataFrame:
    """K5 on a stream: newest is_favorite per (user, poi).  The max_by rule is
    order-insensitive, so late events never undo newer ones; no watermark, as
    favorites never expire."""
    return behavior.favorite_state(favorites)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_append(df: DataFrame, output: str, checkpoint: str) -> str:
    """Run a stream to completion of the available input (``availableNow``),
    appending Parquet files; returns the output path."""
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output))
    q.awaitTermination()
    return output


def run_state_updates(df: DataFrame, output: str, checkpoint: str) -> str:
    """Run an aggregating stream in update mode: each micro-batch appends only
    the keys it changed, under ``epoch=N`` of ``output``.

    A retried epoch overwrites its own partition (idempotent); nothing else is
    rewritten, so a batch costs what it changed, not the size of the state.
    ``latest_state`` reads the current value per key.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output.rstrip('/')}/epoch={epoch}")

    q = (df.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return output


def latest_state(spark: SparkSession, output: str, keys: list[str]) -> DataFrame:
    """The current state per key: the row from the highest epoch that changed it."""
    log = spark.read.parquet(output)
    values = [c for c in log.columns if c not in keys and c != "epoch"]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("epoch")).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
