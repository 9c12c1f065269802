"""Helpers the training-data operators share: tables, shared scratch tables, text batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poi_analytics.session import checkpoint_dir, remove

#: Stands for a null doc_id wherever ids are ordered: such rows come last.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor re-reads files.  The planner also knows the
    true size of what it reads, so it decides on broadcasts by measured size.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark removes the shuffle files of finished jobs."""
    gc.collect()
    spark._jvm.System.gc()


def drop_saved(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`saved` that nothing reads any more."""
    for path in {name.rsplit("/", 1)[0] for df in tables for name in df.inputFiles()}:
        remove(tables[0].sparkSession, path)


def ordered_id(column: str = "doc_id") -> Column:
    """The id as bigint, null as the largest value."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def row_key(text: str = "text") -> Column:
    """64-bit key of a row's text: rows equal in (id, key) hold equal documents."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def rows_at_a_time(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one step's arrays stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class WordHashes(dict):
    """Word -> its 64-bit hash as eight bytes, kept while there is room."""

    KEEP, LONGEST = 200_000, 40

    def __missing__(self, word: bytes) -> bytes:
        got = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        if len(word) <= self.LONGEST:
            if len(self) >= self.KEEP:
                self.clear()
            self[word] = got
        return got

    def of(self, text: bytes) -> bytes:
        """The hashes of all words ``[^\\x20\\x09-\\x0D]+`` of a text (what bytes.split() gives)."""
        return b"".join(map(self.__getitem__, text.split()))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]
