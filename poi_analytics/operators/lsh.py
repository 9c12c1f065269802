"""L15 in its big form: approximate cosine neighbours through a sign-hash index.

Each of ``tables`` hash tables gives a vector a key of ``bits`` signs, those of its dot products with fixed
random +1/-1 planes; vectors at a small angle agree in most signs.  The index is a Parquet table
partitioned by hash table and sorted by key, so a few requested vectors read only their own buckets.
A query probes, in every table, its own key and each key that differs in one sign
(multi-probe), and the candidates of all its buckets are ranked by their exact cosine.

Nothing is capped: a bucket with more rows than PIECE_ROWS is split into pieces, as are the queries that
probe it, and each (piece, piece) pair is one task that sends ``k`` rows a query.

How many bits suit depends on the data: one table shows a query about (bits + 1) / 2**bits of rows that are
unlike it.  The defaults reach a recall of 0.9 on vectors without any clusters, at the price of meeting
two thirds of them; vectors with near neighbours need more bits and as many tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialized, shared_path
from .similarity import PARTIAL, _matrix, _unit, _usable, best_dot, cosine_top_k

BITS, TABLES = 6, 10
#: Rows of a bucket, and queries that probe it, in one task.
PIECE_ROWS, PIECE_QUERIES = 16_384, 4_096


def plane_sign(table: int, bit: int, dim: int) -> int:
    """+1 or -1: the fixed random plane of one sign of one table, from the parity of an MD5."""
    return 1 - 2 * (hashlib.md5(f"{table}:{bit}:{dim}".encode()).digest()[0] & 1)


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """[dim, tables * bits]"""
    return np.array([[plane_sign(t, b, d) for t in range(tables) for b in range(bits)] for d in range(dim)], float)


@dataclass(frozen=True)
class LshIndex:
    """Where an index lies and the parameters its keys were made with."""

    path: str
    bits: int
    tables: int

    def rows(self, spark: SparkSession) -> DataFrame:
        """(tab, bucket, id, v): every vector once per table."""
        return spark.read.parquet(self.path)


def _keyed(unit: DataFrame, bits: int, tables: int) -> DataFrame:
    """(tab, bucket, id, v) of each unit vector in each table."""
    def run(batches):
        signs, weights = None, 1 << np.arange(bits)
        for pdf in batches:
            if pdf.empty:
                continue
            v = _matrix(list(pdf["v"]), 0)
            if signs is None:
                signs = planes(v.shape[1], bits, tables)
            keys = ((v @ signs >= 0).reshape(len(v), tables, bits) * weights).sum(2)
            for t in range(tables):
                yield pd.DataFrame({"tab": t, "bucket": keys[:, t], "id": pdf["id"], "v": pdf["v"]})

    return _usable(unit).mapInPandas(run, "tab int, bucket int, id long, v array<double>")


def build_lsh_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding",
                    bits: int = BITS, tables: int = TABLES) -> LshIndex:
    """Write the index of all vectors to ``path``; vectors of one length.  Null vectors are left out.

    Rows are spread by (table, key, id), so a key that a third of all rows share is many files' work.
    """
    keyed = _keyed(_unit(vectors, id_col, vec_col), bits, tables)
    (keyed.repartitionByRange("tab", "bucket", "id").sortWithinPartitions("tab", "bucket")
     .write.mode("overwrite").partitionBy("tab").parquet(path))
    return LshIndex(path, bits, tables)


def _probes(queries: DataFrame, index: LshIndex) -> DataFrame:
    """(tab, bucket, id, v): each query in the buckets of its own key and all keys one sign away."""
    flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(index.bits)])
    own = _keyed(queries, index.bits, index.tables)
    return own.withColumn("flip", F.explode(flips)).withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("flip"))).drop("flip")


def lsh_top_k(queries: DataFrame, index: LshIndex, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, neighbor_id, score): each query's best ``k`` of its candidates, by exact cosine.

    ``queries`` is (id, v) of unit vectors.  A candidate met in several tables counts once.
    """
    rows, probes = index.rows(queries.sparkSession), materialized(_probes(queries, index), "lsh-probes")
    bucket = ["tab", "bucket"]
    # one row a bucket that is probed: at most tables * 2**bits, whatever the tables hold
    sizes = (rows.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).cast("int").alias("pieces"))
             .join(probes.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / PIECE_QUERIES).cast("int").alias("parts")), bucket))
    sizes = F.broadcast(materialized(sizes, "lsh-sizes"))
    one_of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    key = [*bucket, "piece", "part"]
    c = rows.join(sizes, bucket).withColumns({"piece": one_of(F.col("pieces")), "part": each(F.col("parts"))})
    q = probes.join(sizes, bucket).withColumns({"piece": each(F.col("pieces")), "part": one_of(F.col("parts"))})
    best = best_dot(k, exclude_self)

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "neighbor_id": [], "score": []})
        return pd.DataFrame(dict(zip(("query_id", "neighbor_id", "score"), best(q, c))))

    found = (q.select(*key, "id", "v").groupBy(*key).cogroup(c.select(*key, "id", "v").groupBy(*key)).applyInPandas(run, PARTIAL)
             .groupBy("query_id", "neighbor_id").agg(F.max("score").alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("neighbor_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id", "score"))


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (pairs, hits, recall): how many of the exact neighbours were found."""
    hits = exact.select("query_id", "neighbor_id").join(
        found.select("query_id", "neighbor_id", F.lit(1).alias("hit")), ["query_id", "neighbor_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("hits"),
                    (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def cosine_top_k_lsh(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
                     vec_col: str = "embedding", bits: int = BITS, tables: int = TABLES, path: str | None = None) -> DataFrame:
    """Index all ``vectors``, search the ``queries`` (a frame with ``id_col``) and measure the search.

    Every row carries ``recall``, the share of the exact neighbours of all queries that the index found; the
    exact ones come from ``cosine_top_k`` (the stated queries against all rows, in blocks).
    """
    spark = vectors.sparkSession
    index = build_lsh_index(vectors, path or shared_path(spark, "lsh-index"), id_col, vec_col, bits, tables)
    unit = _unit(vectors, id_col, vec_col)
    asked = unit.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    found = materialized(lsh_top_k(asked, index, k), "lsh-found")
    measured = recall_at_k(found, cosine_top_k(vectors, k, id_col, vec_col, queries=queries))
    return found.withColumn("recall", measured.select("recall").scalar())


def similar_pois_lsh(spark: SparkSession, index: LshIndex, ids: Sequence[int], k: int = 10) -> DataFrame:
    """The best ``k`` of a few requested vectors of the index: reads their rows and the buckets they probe only."""
    first = index.rows(spark).where((F.col("tab") == 0) & F.col("id").isin(*ids)).select("id", "v")
    return lsh_top_k(first, index, k)
