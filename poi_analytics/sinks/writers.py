"""Writers (B1-B5): layer tables, marts with declared schemas, the summary
document, landing files and factor tables.  All writes go straight from the
executors; nothing is collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_layer(df: DataFrame, target: str, mode: str = "overwrite", repartition: int | None = None,
                as_table: bool = False, partition_by: list[str] | None = None) -> None:
    """B1: write a layer (ODS/DWD) as Parquet, ``overwrite`` or ``append``.

    ``target`` is a catalog table name when ``as_table`` else a path.
    ``repartition`` sets the number of output files.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode!r}")
    out = df.repartition(repartition) if repartition else df
    w = out.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if as_table:
        w.saveAsTable(target)
    else:
        w.save(target)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite", path: str | None = None,
                   spread: bool = True) -> None:
    """B1 as a catalog table bucketed and sorted by ``key``: readers group and join on it without a shuffle.

    ``spread`` deals the rows out by bucket before writing, so that a bucket is one file per write;
    False when they are so already.  ``append`` must name the table's own key and buckets.  With ``path`` the
    table is external.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode!r}")
    out = df.repartition(buckets, key) if spread else df
    w = out.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
    (w.option("path", path) if path else w).saveAsTable(table)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project and cast ``df`` to a declared schema; absent columns become nulls."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[
        (F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def write_mart(df: DataFrame, target: str, schema: StructType | None = None, as_table: bool = False,
               path: str | None = None) -> None:
    """B2: overwrite a mart with its declared schema; an empty result still
    produces an empty table with that schema.  With ``path`` the table is external."""
    out = conform(df, schema) if schema is not None else df
    w = out.write.mode("overwrite").format("parquet")
    if as_table:
        (w.option("path", path) if path else w).saveAsTable(target)
    else:
        w.save(target)


def summary_rows(marts: Mapping[str, DataFrame]) -> DataFrame:
    """B3 as rows: one (mart, row) line per mart row, the row as JSON.

    Nothing is folded, so it holds for marts of any size.
    """
    out = None
    for key, df in marts.items():
        rows = df.select(F.lit(key).alias("mart"), F.to_json(F.struct(*df.columns), _KEEP_NULLS).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


_KEEP_NULLS = {"ignoreNullFields": "false"}


def summary_document(sections: Mapping, single: Sequence[str] = (), generated_at=None) -> DataFrame:
    """One row, ``generatedAt`` and a column per section.

    ``sections`` maps a published key to a mart, or to a mapping of them (a group).  A mart becomes a
    sorted array of its rows; the keys in ``single`` (the cards) are one object.  Each array
    is folded in one task, so this is for marts of bounded size; unbounded ones are
    published as rows (``summary_rows``).
    """
    def folded(key: str, df: DataFrame) -> Column:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        agg = F.first(row) if key in single else F.sort_array(F.collect_list(row))
        return df.agg(agg.alias(key)).scalar().alias(key)

    def column(key: str, value) -> Column:
        if isinstance(value, Mapping):
            return F.struct(*[folded(k, v) for k, v in value.items()]).alias(key)
        return folded(key, value)

    some = next(iter(sections.values()))
    some = next(iter(some.values())) if isinstance(some, Mapping) else some
    ts = F.lit(generated_at) if generated_at is not None else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return some.sparkSession.range(1).select(ts.alias("generatedAt"), *[column(k, v) for k, v in sections.items()])


def write_summary(doc: DataFrame, path: str) -> None:
    """The summary document as one JSON file (it has one row)."""
    doc.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_landing(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "csv") -> None:
    """An existing target is left alone unless ``overwrite``; parents are created."""
    w = df.write.mode("overwrite" if overwrite else "ignore").format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.save(path)


def write_factors(df: DataFrame, path: str) -> None:
    """An (id, vector) factor or embedding table as Parquet."""
    df.write.mode("overwrite").parquet(path)


def save_model(model, path: str) -> None:
    """A fitted Spark ML model (ALS / pipeline) at a path of its own; ``sinks.models`` keeps versions."""
    model.write().overwrite().save(path)
