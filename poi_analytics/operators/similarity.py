"""Vector and tag similarity.

Vectors are ``array<double>`` columns.  Normalization and concatenation are
native higher-order functions.  Exact top-k by dot product (cosine after
normalization, or factor scores) has two forms: a few requested queries travel to the
candidates, which are scanned once; a whole table of queries meets the candidates in hash
blocks that are packed and written once.  Either multiplies tiles with numpy and keeps only
each query's best ``k``; a per-query WindowGroupLimit merges the partial lists.  No pair is
ever emitted as a row and no cross join is planned.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .grid import Arrays, block_of, packed, written

TAG_BUCKETS = 512
TEXT_DIM = 64
TOKEN_SPLIT = r"[ \t\n\r]+"
UNKNOWN_TAG = "unknown"
NORM_EPS = 1e-9
QUERY_TILE, CANDIDATE_TILE = 256, 2_048
#: Candidates of a tile whose best score is compared before each of theirs.
GROUP = 64
#: Rows, of up to BLOCK_WIDTH numbers, of a block of queries and of candidates that meet at a time, at any size
#: of the tables.  A block of candidates is read once a block of queries.
QUERY_BLOCK, CANDIDATE_BLOCK, BLOCK_WIDTH = 32_768, 65_536, 32
#: Screening in single precision holds for numbers below this; larger ones are compared in double.
SCREENED = 2.0 ** 60


def as_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def l2_norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(c: Column, eps: float = 0.0) -> Column:
    """x / (|x| + eps); a zero vector stays zero.

    The norm is computed once per row (inside ``array_repeat``) and divided in
    with ``zip_with``; a norm written inside a ``transform`` lambda would be
    re-evaluated for every element.
    """
    n = l2_norm(c) + F.lit(eps)
    scaled = F.zip_with(c, F.array_repeat(n, F.size(c)), lambda x, d: x / d)
    return F.when(n == 0, c).otherwise(scaled)


def tag_tokens_for_hashing(tag_text: Column) -> Column:
    """L14 input: the JSON list when parseable, else the raw text as one tag;
    no tags -> ['unknown']."""
    arr = F.from_json(tag_text, "array<string>")
    toks = (F.when(tag_text.isNull() | (tag_text == ""), F.array().cast("array<string>"))
            .when(arr.isNotNull(), arr).otherwise(F.array(tag_text)))
    return F.when(F.size(toks) == 0, F.array(F.lit(UNKNOWN_TAG))).otherwise(toks)


def tag_bucket(tag: Column, buckets: int = TAG_BUCKETS) -> Column:
    """A stable hash bucket of one tag (first 32 bits of its MD5)."""
    return F.pmod(F.conv(F.substring(F.md5(tag), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def tag_hash_vector(df: DataFrame, id_col: str = "poiId", tag_col: str = "tagNameList",
                    buckets: int = TAG_BUCKETS) -> DataFrame:
    """Sparse L2-normalized bucket counts: (poi_id, bucket, value)."""
    counts = (df.select(F.col(id_col).alias("poi_id"), F.explode(tag_tokens_for_hashing(F.col(tag_col))).alias("t"))
              .groupBy("poi_id", tag_bucket(F.col("t"), buckets).alias("bucket"))
              .agg(F.count(F.lit(1)).cast("double").alias("n")))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("poi_id")))
    return counts.select("poi_id", "bucket", (F.col("n") / norm).alias("value"))


def sparse_map(sparse: DataFrame) -> DataFrame:
    """(poi_id, m map of bucket to value) from sparse (poi_id, bucket, value) rows.

    One group per poi, holding at most one entry a bucket (a fixed bound)."""
    return sparse.groupBy("poi_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))


def dense(m: Column, size: int) -> Column:
    """array<double>[size] from a map of bucket to value."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(m[i], F.lit(0.0)))


def dense_vector(sparse: DataFrame, size: int, out_col: str) -> DataFrame:
    """(poi_id, array<double>[size]) from sparse (poi_id, bucket, value) rows."""
    return sparse_map(sparse).select("poi_id", dense(F.col("m"), size).alias(out_col))


def dense_tag_vector(sparse: DataFrame, buckets: int = TAG_BUCKETS) -> DataFrame:
    """(poi_id, tags array<double>[buckets]) from the sparse tag rows."""
    return dense_vector(sparse, buckets, "tags")


def token_bucket(tok: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def token_sign(tok: Column) -> Column:
    bit = F.pmod(F.conv(F.substring(F.md5(tok), 9, 2), 16, 10).cast("bigint"), F.lit(2))
    return F.when(bit == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def hashed_text_vector(df: DataFrame, id_col: str, text_col: str, dim: int = TEXT_DIM) -> DataFrame:
    """Signed feature hashing of the whole text: sparse L2-normalized
    (poi_id, bucket, value) rows; tokens are lower-cased whitespace runs."""
    toks = (df.select(F.col(id_col).alias("poi_id"),
                      F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("tok"))
            .where(F.col("tok") != ""))
    counts = toks.groupBy("poi_id", token_bucket(F.col("tok"), dim).alias("bucket")).agg(
        F.sum(token_sign(F.col("tok"))).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("poi_id")))
    return counts.select("poi_id", "bucket", F.when(norm > 0, F.col("n") / norm).otherwise(F.lit(0.0)).alias("value"))


def multimodal_vector(image: Column, text: Column, tags: Column, dim: int) -> Column:
    """normalize(concat(normalize(image) or zeros, normalize(text), tags))."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    img = F.coalesce(l2_normalize(image), zeros)
    return l2_normalize(F.concat(img, l2_normalize(text), tags))


def text_vector_dense(df: DataFrame, id_col: str, text_col: str, dim: int = TEXT_DIM) -> DataFrame:
    """L17 natively: (poi_id, vector array<double>[dim]) of every row's whole text; no token gives zeros.

    The join is a sort-merge one: the planner guesses the vectors' size from the compressed table, and would
    broadcast those of a million texts.
    """
    m = sparse_map(hashed_text_vector(df, id_col, text_col, dim)).hint("merge")
    return (df.select(F.col(id_col).alias("poi_id")).join(m, "poi_id", "left")
            .select("poi_id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(dense(F.col("m"), dim)).alias("vector")))


def multimodal_vectors(pois: DataFrame, images: DataFrame, texts: DataFrame, dim: int = TEXT_DIM) -> DataFrame:
    """L16 over tables: (poi_id, vector) of every poi.

    ``pois`` has poiId and tagNameList, ``images`` (poi_id, image array<double>), ``texts``
    (poi_id, text).  A missing image or text counts as zeros.  Text and tags are joined as maps of their few
    entries, by sort-merge joins (see ``text_vector_dense``), and made dense in the last step.
    """
    text = sparse_map(hashed_text_vector(texts, "poi_id", "text", dim)).withColumnRenamed("m", "text")
    tags = sparse_map(tag_hash_vector(pois)).withColumnRenamed("m", "tags")
    j = (pois.select(F.col("poiId").alias("poi_id")).join(images, "poi_id", "left")
         .join(text.hint("merge"), "poi_id", "left").join(tags.hint("merge"), "poi_id", "left"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    vectors = j.select("poi_id", "image", F.when(F.col("text").isNull(), zeros).otherwise(dense(F.col("text"), dim)).alias("text"),
                       dense(F.col("tags"), TAG_BUCKETS).alias("tags"))
    return vectors.select("poi_id", multimodal_vector(F.col("image"), F.col("text"), F.col("tags"), dim).alias("vector"))


def _matrix(vectors: list | np.ndarray, dim: int) -> np.ndarray:
    if isinstance(vectors, np.ndarray):
        return vectors.astype(np.float64)
    return np.vstack(vectors).astype(np.float64) if len(vectors) else np.empty((0, dim))


def _cut(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's best ``k`` scores, ties to the smaller column; -inf is none."""
    n = min(k, s.shape[1])
    kth = np.partition(s, s.shape[1] - n, axis=1)[:, [s.shape[1] - n]]
    above, equal = s > kth, s == kth
    room = n - above.sum(1, keepdims=True)
    return np.nonzero((above | equal & (np.cumsum(equal, axis=1) <= room)) & (s > -np.inf))


def _first_k(rows: np.ndarray, cols: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` entries of each row by (score desc, column asc), rows ascending."""
    order = np.lexsort((cols, -s, rows))
    rows, cols, s = rows[order], cols[order], s[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[keep], cols[keep], s[keep]


def _reached(rough: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of the scores, a row a candidate, that are not below their query's bound: groups by their best first."""
    whole = len(rough) // GROUP * GROUP
    grouped = rough[:whole].reshape(-1, GROUP, rough.shape[1])
    g, r = np.nonzero(grouped.max(1) >= bound)
    x, y = np.nonzero(grouped[g, :, r] >= bound[r, None])
    c, q = np.nonzero(rough[whole:] >= bound)
    return np.concatenate([r[x], q]), np.concatenate([g[x] * GROUP + y, c + whole])


def _best(qid: np.ndarray, qv: np.ndarray, cid: np.ndarray, cv: np.ndarray, k: int,
          exclude_self: bool, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's best ``k`` by (score desc, id asc), in tiles.

    A score matrix never exceeds QUERY_TILE x CANDIDATE_TILE.  Tiles are screened in single precision: what lies
    below the k-th best score so far by more than the rounding error of a product can be none of the best.
    The rest is scored again in double, pair by pair, so the choice is that of the double-precision scores.  Where
    ties let much of a tile through, or numbers are too large to screen, the whole tile is scored in double and cut.
    ``least`` is each query's k-th best score among other candidates; what lies below it may be left out.
    """
    order = np.argsort(cid, kind="stable")
    cid, cv = cid[order], cv[order]
    dim = qv.shape[1] if len(qv) else 0
    with np.errstate(over="ignore", invalid="ignore"):
        screened = all(np.abs(m).max(initial=0.0) < SCREENED for m in (qv, cv))
        q32, c32 = qv.astype(np.float32), cv.astype(np.float32)
        q_norm, c_norm = np.linalg.norm(qv, axis=1), np.linalg.norm(cv, axis=1)
    found, room = [], np.empty(QUERY_TILE * max(CANDIDATE_TILE, 4 * k), np.float32)
    for a in range(0, len(qid), QUERY_TILE):
        q, ids = qv[a:a + QUERY_TILE], qid[a:a + QUERY_TILE]
        across = np.ascontiguousarray(q32[a:a + QUERY_TILE].T)
        first = np.full(len(ids), -np.inf) if least is None else least[a:a + QUERY_TILE]
        low = first.copy()  # the k-th best score so far
        rows, cols, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        pending, waiting = [], 0
        b = 0
        while b < len(cid):
            n = CANDIDATE_TILE if b else min(CANDIDATE_TILE, max(512, 4 * k))  # a first small one for a first bound
            names = cid[b:b + n]
            mine = np.nonzero(ids[:, None] == names[None, :]) if exclude_self and len(
                ids) and ids.min() <= names[-1] and ids.max() >= names[0] else None
            hit = None
            if screened:
                # a row a candidate, so that the best of a group of candidates is taken for many queries at once
                rough = np.matmul(c32[b:b + n], across, out=room[:len(names) * len(ids)].reshape(len(names), len(ids)))
                if mine:
                    rough[mine[1], mine[0]] = -np.inf
                # a product of single-precision vectors is off by less than this, underflow included
                slack = (dim + 8) * 2.0 ** -23 * q_norm[a:a + QUERY_TILE] * c_norm[b:b + n].max() + dim * 2.0 ** -60
                bound = low - slack
                if np.isneginf(low).any():
                    m = len(names)
                    bound = np.maximum(bound, np.partition(rough, m - min(k, m), axis=0)[m - min(k, m)] - 2 * slack)
                bound = np.maximum(np.nextafter(bound.astype(np.float32), np.float32(-np.inf)), np.finfo(np.float32).min)
                hit = _reached(rough, bound)
            if hit is None or len(hit[0]) > 32 * k * len(ids):
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = np.einsum("id,jd->ij", q, cv[b:b + n])
                exact[np.isnan(exact)] = -np.inf
                if mine:
                    exact[mine] = -np.inf
                r, c = _cut(exact, k)
                found_here = exact[r, c]
            else:
                r, c = hit
                found_here = np.einsum("ij,ij->i", q[r], cv[b + c])
            pending.append((r, c + b, found_here))
            waiting += len(r)
            b += n
            if waiting > k * len(ids) or b >= len(cid):
                rows, cols, s = _first_k(*(np.concatenate([x, *y]) for x, y in zip((rows, cols, s), zip(*pending))), k)
                pending, waiting = [], 0
                full = np.bincount(rows, minlength=len(ids)) >= k
                last = np.searchsorted(rows, np.arange(len(ids)), "right") - 1
                low[full] = np.maximum(first[full], s[last[full]])
        found.append((ids[rows], cid[cols], s))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and free of nulls and NaN; others have no neighbours and are none."""
    return vectors.where(F.col("v").isNotNull()
                         & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("id", "v")


def _merge(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("neighbor_id"))
    return (partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id", "score"))


PARTIAL = "query_id long, neighbor_id long, score double"


def top_k_requested(queries: DataFrame, candidates: DataFrame, k: int = 10, exclude_self: bool = False,
                    most: int = 10_000) -> DataFrame:
    """Exact top-k of a few requested queries: one scan of the candidates, k rows per query and task.

    ``queries`` may hold at most ``most`` rows (they travel to every task); more is an error, and
    ``top_k_dot`` is the form for that.
    """
    asked = _usable(queries).limit(most + 1).toPandas()
    if len(asked) > most:
        raise ValueError(f"more than {most} queries; use top_k_dot")
    spark = candidates.sparkSession
    shipped = spark.sparkContext.broadcast((asked["id"].to_numpy(), _matrix(list(asked["v"]), 0)))

    def run(batches):
        qid, qv = shipped.value
        best = None
        for pdf in batches:
            if pdf.empty or not len(qid):
                continue
            got = pd.DataFrame(dict(zip(("query_id", "neighbor_id", "score"), _best(
                qid, qv, pdf["id"].to_numpy(), _matrix(list(pdf["v"]), 0), k, exclude_self))))
            best = got if best is None else pd.concat([best, got])
            best = best.sort_values(["query_id", "score", "neighbor_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    return _merge(_usable(candidates).mapInPandas(run, PARTIAL), k)


def blocks_of(df: DataFrame, rows: int) -> Column:
    """How many blocks of about ``rows`` rows the table fills (a scalar subquery: one sum, no driver look-up).

    A row with a vector of more than BLOCK_WIDTH numbers counts as as many rows as it fills, so a block is bounded in bytes.
    """
    vectors = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    size = F.greatest(F.lit(1.0), *[F.size(c) / BLOCK_WIDTH for c in vectors]) if vectors else F.lit(1.0)
    return df.agg(F.greatest(F.ceil(F.coalesce(F.sum(size), F.lit(0.0)) / rows), F.lit(1)).cast("int").alias("blocks")).scalar()


Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (query, candidate, score) of each query's best of one block pair, given the queries' k-th best scores before it.
Best = Callable[[Arrays, Arrays, np.ndarray], Found]
#: Queries of the smallest block that is cut for the sake of more tasks, and tasks a core.
LEAST_QUERIES, TASKS_A_CORE = 2_048, 8


def _kth(queries: np.ndarray, found: Found, k: int) -> np.ndarray:
    """Each query's k-th best score in ``found`` (sorted by query and score), -inf where there are fewer."""
    rows = np.searchsorted(queries, found[0])
    full = np.bincount(rows, minlength=len(queries)) >= k
    last = np.searchsorted(rows, np.arange(len(queries)), "right") - 1
    out = np.full(len(queries), -np.inf)
    out[full] = found[2][last[full]]
    return out


def _best_of_blocks(pairs: Iterator[tuple[Arrays, Arrays]], best: Best, k: int) -> Found | None:
    """Each query's best ``k`` of one block of queries over a stream of candidate blocks."""
    found = None
    for q, c in pairs:
        if not len(q["id"]) or not len(c["id"]):
            continue
        low = np.full(len(q["id"]), -np.inf) if found is None else _kth(q["id"], found, k)
        found = [np.concatenate(x) for x in zip(found, best(q, c, low))] if found else list(best(q, c, low))
        found = _first_k(found[0], found[1], found[2], k)
    return found


def top_k_blocks(queries: DataFrame, candidates: DataFrame, best: Best, k: int,
                 blocks: tuple[int, int] | None = None, most: tuple[int, int] = (1 << 30, 1 << 30)) -> DataFrame:
    """Exact top-k candidates per query, where ``best`` gives each query's best ``k`` of one block pair.

    Both tables have an ``id``, one row each; queries and candidates are hashed into blocks of a bounded number of
    rows (QUERY_BLOCK, CANDIDATE_BLOCK, or ``most`` where a pair costs more, from their counts), packed and written once.
    A task has one block of queries and reads a share of the candidate blocks one after the other, so no block is
    shuffled or written again for the blocks it meets, no pair is ever a row, and ``k`` rows a query and task come out;
    a per-query WindowGroupLimit merges the partial lists.
    """
    spark = queries.sparkSession
    checkpoint_dir(spark)
    cores = spark.sparkContext.defaultParallelism
    candidates = candidates.select(*[F.col(c).alias(c) for c in candidates.columns])  # may be the same table
    if blocks:
        qb, cb = blocks
    else:
        qb, cb, rows = spark.range(1).select(blocks_of(queries, min(QUERY_BLOCK, most[0])), blocks_of(candidates, min(CANDIDATE_BLOCK, most[1])),
                                             queries.agg(F.count(F.lit(1)).alias("n")).scalar()).first()
        qb = max(qb, min(2 * cores, rows // LEAST_QUERIES))
    q, c = (written(packed(t, block_of(F.col("id"), n), n, ["id"])) for t, n in ((queries, qb), (candidates, cb)))
    shares = min(cb, -(-TASKS_A_CORE * cores // qb))

    def run(pairs):
        found = _best_of_blocks(pairs, best, k)
        return [] if found is None else [(pickle.dumps(found, 5),)]

    def rows_of(batches):
        for batch in batches:
            for found in batch.column("found"):
                ids, names, scores = pickle.loads(found.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(scores, pa.float64())],
                                                 ["query_id", "neighbor_id", "score"])

    partial = spark.createDataFrame(q.cartesian(c.coalesce(shares)).mapPartitions(run), "found binary")
    return _merge(partial.mapInArrow(rows_of, PARTIAL), k)


def best_dot(k: int, exclude_self: bool = False) -> Best:
    """The best ``k`` by dot product of the vectors ``v`` (a matrix, or lists in a data frame)."""
    def best(q: Arrays | pd.DataFrame, c: Arrays | pd.DataFrame, low: np.ndarray | None = None) -> Found:
        (qid, qv), (cid, cv) = ((np.asarray(x["id"]), _matrix(x["v"] if isinstance(x["v"], np.ndarray) else list(x["v"]), 0)) for x in (q, c))
        return _best(qid, qv, cid, cv, k, exclude_self, low)
    return best


def top_k_dot(queries: DataFrame, candidates: DataFrame, k: int = 10, exclude_self: bool = False,
              blocks: tuple[int, int] | None = None) -> DataFrame:
    """Exact top-k candidates per query by dot product; inputs are (id, v array of double or float).

    ``top_k_blocks`` with tiles of two matrices multiplied in each task.  Output: query_id, rank
    (1..k), neighbor_id, score.
    """
    return top_k_blocks(_usable(queries), _usable(candidates), best_dot(k, exclude_self), k, blocks)


def _unit(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"),
                          l2_normalize(as_double_array(F.col(vec_col)), NORM_EPS).alias("v"))


def cosine_top_k(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
                 queries: DataFrame | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
    """Exact top-k cosine neighbours (self excluded) of every query.

    ``queries`` (a frame with ``id_col``) defaults to every vector.  Vectors are
    normalized with +1e-9 as in the source, then ranked by ``top_k_dot``.
    """
    unit = _unit(vectors, id_col, vec_col)
    q = unit if queries is None else unit.join(
        queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    return top_k_dot(q, unit, k=k, exclude_self=True, blocks=blocks)


def similar_pois(vectors: DataFrame, ids: Sequence[int], k: int = 10, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """L15 for requested pois: their best ``k`` others by cosine; an unknown id gives no row."""
    unit = _unit(vectors, id_col, vec_col)
    return top_k_requested(unit.where(F.col("id").isin(*ids)), unit, k, exclude_self=True)
