"""Catalog layers kept in buckets (A2, B1, B2): the warehouse tables that cleaning and joins read.

A layer bucketed by poi is shuffled once, when it is written.  After that the newest-row dedupe, the
marts' grouping by poi and the joins of events with attractions read co-located buckets and plan
without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean
from ..operators import interactions as inter
from ..sinks.writers import write_bucketed
from ..sources.tables import table_scan

#: Buckets of a layer: files of some hundred MB at the size the layer is meant for.
BUCKETS = 1_024


def stage_typed(ods: DataFrame, table: str, mode: str = "overwrite", buckets: int = BUCKETS, path: str | None = None) -> None:
    """C1-C3 + B1: landing rows, trimmed, typed and with their keys, into a table bucketed by poi."""
    write_bucketed(clean.require_keys(clean.cast_numeric(clean.trim_strings(ods))), table, "poiId", buckets, mode, path)


def build_dwd_table(spark: SparkSession, db: str, typed: str, table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """C4, C5 + B1: the DWD table from the typed one, bucket by bucket (same buckets, no exchange)."""
    rows = clean.discount_rate(clean.dedupe_latest(table_scan(spark, db, typed)))
    write_bucketed(rows, table, "poiId", buckets, path=path, spread=False)


def known_interactions(spark: SparkSession, db: str, events: str, dwd: str) -> DataFrame:
    """E1 over catalog tables bucketed by poi: a semi join of co-located buckets."""
    return inter.interactions_with_items(table_scan(spark, db, events), table_scan(spark, db, dwd))
