"""Recommender pipelines on ``pyspark.ml``.

The source trains small TensorFlow models on one machine; here the same
inputs train distributed Spark ML models:

* collaborative filtering -> implicit-feedback ALS (rank 32, 5 iterations); the
  summed interaction weights become ALS confidences.  This is a different
  objective from a sigmoid dot-product network, so scores are not comparable
  numerically, only in behaviour (a planted-structure test checks hit rates).
* CTR ranking -> MultilayerPerceptronClassifier over user/item factors,
  district one-hot and the three z-scored item features, or a factorization machine
  (FMClassifier) over hashed ids, district and features, which needs no factors.

Fitting and scoring read every row of the frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (FMClassificationModel, FMClassifier,
                                       MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier)
from pyspark.ml.common import _java2py, _py2java
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from ..operators import machine, network
from ..operators.grid import Arrays, Grid, grid_side
from ..operators.interactions import cold_start_items, ctr_item_features
from ..operators.similarity import Best, as_double_array, top_k_blocks, top_k_dot, top_k_requested
from ..session import checkpoint_dir, materialized

CF_RANK = 32
CF_ITERATIONS = 5
#: Blocks of users and of items in ALS.  An iteration ships each user's factors to every item block and each item's to
#: every user block, so what is shuffled grows with the blocks; a half step is that many tasks.
CF_BLOCKS = 6
#: Fewer for the factors under a user's click list, whose training set is shuffled and written besides (longer half steps).
CTR_LIST_BLOCKS = 4
CTR_HIDDEN = (64, 32)
CTR_ITERATIONS = 20
FM_BUCKETS, FM_FACTORS, FM_ITERATIONS, FM_STEP = 1 << 14, 8, 40, 0.05
SEED = 42


def cf_train(positives: DataFrame, rank: int = CF_RANK, max_iter: int = CF_ITERATIONS,
             reg: float = 0.1, alpha: float = 1.0, seed: int = SEED) -> ALSModel:
    """Implicit ALS on (user_idx, item_idx, summed weight).

    ALS checkpoints its factor lineage every few iterations into the shared
    checkpoint folder, so a lost executor does not replay every iteration.  The ratings are
    written once: fitting asks for them more than once.
    """
    ratings = positives.groupBy("user_idx", "item_idx").agg(F.sum("weight").alias("weight"))
    return cf_fit(materialized(ratings, "cf-ratings"), rank, max_iter, reg, alpha, seed)


def cf_fit(ratings: DataFrame, rank: int = CF_RANK, max_iter: int = CF_ITERATIONS,
           reg: float = 0.1, alpha: float = 1.0, seed: int = SEED, blocks: int = CF_BLOCKS) -> ALSModel:
    """L5 on ratings that are summed and written already: one row (user_idx, item_idx, weight) a pair."""
    checkpoint_dir(ratings.sparkSession)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=True,
              userCol="user_idx", itemCol="item_idx", ratingCol="weight", seed=seed,
              numUserBlocks=blocks, numItemBlocks=blocks,
              coldStartStrategy="drop", nonnegative=False, checkpointInterval=2)
    return als.fit(ratings)


def cf_recommend(model: ALSModel, users: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Top-k items per requested user by factor dot product (ties by item).

    ``users`` holds (user_id, user_idx) of the requested known users; unknown
    users have no index and so get nothing.  Seen items are not excluded.
    """
    return cf_recommend_factors(*[f.select("id", F.col("features").alias("v"))  # floats: half of what doubles ship
                                  for f in (model.userFactors, model.itemFactors)], users, items, k)


def cf_recommend_factors(user_factors: DataFrame, item_factors: DataFrame, users: DataFrame, items: DataFrame,
                         k: int = 10) -> DataFrame:
    """L6 on factor tables (id, v array of double or float), from a model or from files.

    Scored with the blocked ``top_k_dot`` (exact, like ALS's own recommendForUserSubset, but
    without its cross join of blocks).
    """
    uf = user_factors.join(users.select(F.col("user_idx").alias("id")).distinct(), "id", "left_semi")
    top = top_k_dot(uf, item_factors, k=k)
    return (top.join(users, top["query_id"] == users["user_idx"])
            .join(items, top["neighbor_id"] == items["item_idx"])
            .select("user_id", "rank", "poi_id", "score"))


def cf_recommend_user(model: ALSModel, users: DataFrame, items: DataFrame, user_ids: Sequence[int],
                      k: int = 10) -> DataFrame:
    """L6 for requested users: one scan of the item factors; an unknown user gets nothing."""
    asked = users.where(F.col("user_id").isin(*user_ids))
    uf = model.userFactors.join(asked.select(F.col("user_idx").cast("int").alias("id")), "id", "left_semi")
    top = top_k_requested(uf.select("id", as_double_array(F.col("features")).alias("v")),
                          model.itemFactors.select("id", as_double_array(F.col("features")).alias("v")), k)
    return (top.join(asked, top["query_id"] == asked["user_idx"])
            .join(items, top["neighbor_id"] == items["item_idx"])
            .select("user_id", "rank", "poi_id", "score"))


def ctr_features(frame: DataFrame, model: ALSModel) -> DataFrame:
    """Join user and item factors onto the CTR frame (both factor tables are keyed joins)."""
    return _with_factors(_with_factors(frame, model.userFactors, "user_idx", "uvec", model.rank),
                         model.itemFactors, "item_idx", "ivec", model.rank)


def _with_factors(frame: DataFrame, factors: DataFrame, key: str, name: str, rank: int) -> DataFrame:
    """``frame`` with the factors of its ``key`` as a vector, which is made after the join: floats are half as wide to ship."""
    found = frame.join(factors.select(F.col("id").alias(key), F.col("features").alias(name)), key)
    return _sized(found.withColumn(name, array_to_vector(name)), name, rank)


def _sized(df: DataFrame, name: str, size: int) -> DataFrame:
    """``df`` with the size of a vector column noted, which an assembler would else run the whole plan to see."""
    return VectorSizeHint(inputCol=name, size=size, handleInvalid="optimistic").transform(df)


def fit_rows(frame: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of the frame by hash of their pair (all, when it has no more), for a trial fit; no query uses it.

    One pair's rows go in or stay out together, so a pair that many rows repeat can exceed the bound by them.
    """
    n = frame.count()
    part = min(1 << 30, (most << 30) // max(n, 1))
    return frame.where(F.pmod(F.xxhash64("item_idx", "user_idx", F.lit("fit")), F.lit(1 << 30)) < part)


def ctr_train(frame: DataFrame, factors: ALSModel, n_districts: int | None = None, max_iter: int = CTR_ITERATIONS,
              seed: int = SEED, features: DataFrame | None = None) -> PipelineModel:
    """MLP over [user factors, item factors, district one-hot, price, heat, score], fitted on every row.

    The one-hot width is that of the whole frame (``n_districts``, when given, must agree).  With ``features`` (L7) the
    frame is a labelled training set (L4) that gets them here (L10): each item is joined to its features, and its rows meet
    both in the cells of a grid; the one-hot width is then that of all items.  The grid is written once and read by every
    step of ``network.fit``, which are those of ``MultilayerPerceptronClassifier`` without a vector a row.
    """
    items = factors.itemFactors
    if features is None:
        per_row, known = ["district_idx", "price", "heat", "score"], frame
    else:
        per_row, known = [], ctr_item_features(features)
        items = items.join(known.select(F.col("item_idx").alias("id"), "district_idx", "price", "heat", "score"), "id")
    enc = OneHotEncoder(inputCols=["district_idx"], outputCols=["district_vec"], dropLast=False).fit(known)
    asm = VectorAssembler(inputCols=["uvec", "ivec", "district_vec", "price", "heat", "score"], outputCol="features")
    if n_districts not in (None, enc.categorySizes[0]):
        raise ValueError(f"the frame has {enc.categorySizes[0]} districts, not {n_districts}")
    rows = frame.select("user_idx", "item_idx", F.col("label").cast("byte").alias("label"), *per_row)
    side = grid_side(rows.count(), frame.sparkSession.sparkContext.defaultParallelism)
    mlp = MultilayerPerceptronClassifier(layers=[factors.rank * 2 + enc.categorySizes[0] + 3, *CTR_HIDDEN, 2],
                                         maxIter=max_iter, seed=seed, labelCol="label", featuresCol="features")
    return PipelineModel([enc, asm, _fitted(mlp, Grid.of(rows, factors.userFactors, items, side), factors.rank)])


def _fitted(mlp: MultilayerPerceptronClassifier, grid: Grid, rank: int) -> MultilayerPerceptronClassificationModel:
    """What ``mlp.fit`` gives on the rows of ``grid``, from the same first weights."""
    sc, sizes = grid.cells.context, mlp.getLayers()
    jvm, java_sizes = sc._jvm, sc._gateway.new_array(sc._jvm.int, len(sizes))
    for place, size in enumerate(sizes):
        java_sizes[place] = size
    start = jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(java_sizes, True).model(mlp.getSeed()).weights()
    weights = network.fit(grid, np.array(list(start.toArray())), sizes, rank, mlp.getMaxIter())
    vector = _py2java(sc, Vectors.dense(weights))
    model = MultilayerPerceptronClassificationModel(jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(mlp.uid, vector))
    model._resetUid(mlp.uid)
    return mlp._copyValues(model)


# ---- L12 for a table of users: the network over blocks -------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


@dataclass(frozen=True)
class CtrNetwork:
    """The fitted weights, the first layer cut into what a user, an item and its features contribute."""

    user: np.ndarray
    item: np.ndarray
    district: np.ndarray
    numbers: np.ndarray
    bias: np.ndarray
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]

    #: Users and items of one tile of scores (small enough for a core's cache), and at most of one task.
    USERS, ITEMS = 8, 256
    BLOCKS = 8_192, 32_768  # rows of BLOCK_WIDTH numbers; those of the first layer are wider

    @classmethod
    def of(cls, model: PipelineModel, rank: int) -> CtrNetwork:
        mlp = model.stages[-1]
        weights, sizes, layers = mlp.weights.toArray(), mlp.getLayers(), []
        for n_in, n_out in zip(sizes, sizes[1:]):
            cut = n_in * n_out
            layers.append((weights[:cut].reshape(n_in, n_out), weights[cut:cut + n_out]))
            weights = weights[cut + n_out:]
        first, bias = layers[0]
        n = len(first) - 3
        return cls(first[:rank], first[rank:2 * rank], first[2 * rank:n], first[n:], bias, *layers[1:])

    def of_users(self, factors: np.ndarray) -> np.ndarray:
        return factors @ self.user

    def of_items(self, factors: np.ndarray, district: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return factors @ self.item + self.district[district] + numbers @ self.numbers + self.bias

    def logit(self, first: np.ndarray) -> np.ndarray:
        """Log odds of a click from the first layer's sums (last axis)."""
        return self.logit_of_hidden(_sigmoid(first))

    def logit_of_hidden(self, y: np.ndarray) -> np.ndarray:
        """Log odds of a click from the first layer's outputs (last axis)."""
        kind = y.dtype
        z = _sigmoid(y @ self.hidden[0].astype(kind) + self.hidden[1].astype(kind))
        return z @ (self.out[0][:, 1] - self.out[0][:, 0]).astype(kind) + kind.type(self.out[1][1] - self.out[1][0])

    def error(self, reach: float) -> float:
        """Bound of what single precision adds to log odds, for first-layer parts of at most ``reach``."""
        ulp = 2.0 ** -23
        hidden, out = np.abs(self.hidden[0]), np.abs(self.out[0][:, 1] - self.out[0][:, 0])
        first = ulp * (reach + 4)
        sums = float(hidden.sum(0).max()) * first + (len(hidden) + 4) * ulp * float((hidden.sum(0) + np.abs(self.hidden[1])).max())
        return float(out.sum()) * (sums / 4 + 4 * ulp) + (len(out) + 4) * ulp * float(out.sum() + np.abs(self.out[1]).sum())

    def best(self, k: int) -> Best:
        """Each user's best ``k`` items of a block pair by click probability, ties to the smaller item.

        Tiles are screened in single precision; whatever comes within its error of the k-th score is
        scored again in double, so the choice is that of the double-precision network.  The exponential of
        a first-layer sum is the product of a user's and an item's, taken once each (unless they are too large).
        """
        def run(q: Arrays, c: Arrays, low: np.ndarray | None = None):
            qid, cid = np.asarray(q["id"]), np.asarray(c["id"])
            u, i = (x["h"] if isinstance(x["h"], np.ndarray) else np.vstack(list(x["h"])) for x in (q, c))
            u32, i32 = u.astype(np.float32), i.astype(np.float32)
            reach = max(np.abs(u).max(), np.abs(i).max())
            margin = 2 * self.error(reach)
            eu, ei = (np.exp(-u32), np.exp(-i32)) if reach < 40 else (None, None)
            room = np.empty((self.USERS, self.ITEMS, u.shape[1]), np.float32)

            def tile(a: int, b: int) -> np.ndarray:
                n, m = len(u32[a:a + self.USERS]), len(i32[b:b + self.ITEMS])
                y = room[:n, :m]
                if eu is None:
                    np.add(u32[a:a + n, None], i32[None, b:b + m], out=y)
                    with np.errstate(over="ignore"):
                        np.exp(np.negative(y, out=y), out=y)
                else:
                    np.multiply(eu[a:a + n, None], ei[None, b:b + m], out=y)
                y += 1
                return self.logit_of_hidden(np.reciprocal(y, out=y).reshape(n * m, -1)).reshape(n, m)

            found = []
            for a in range(0, len(u), self.USERS):
                rough = np.concatenate([tile(a, b) for b in range(0, len(i), self.ITEMS)], axis=1)
                n = rough.shape[1]
                kth = np.partition(rough, n - min(k, n), axis=1)[:, [n - min(k, n)]]
                rows, cols = np.nonzero(rough >= kth - margin)
                score = _sigmoid(self.logit(u[a + rows] + i[cols]))
                order = np.lexsort((cid[cols], -score, rows))
                rows, cols, score = rows[order], cols[order], score[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
                found.append((qid[a + rows[keep]], cid[cols[keep]], score[keep]))
            return tuple(np.concatenate(x) for x in zip(*found))
        return run


def ctr_recommend_users(model: PipelineModel, factors: ALSModel, users: DataFrame, item_features: DataFrame,
                        features: DataFrame, k: int = 10) -> DataFrame:
    """L12 for a table of users (user_id, user_idx): (user_id, rank, poi_id, click_prob), the k likeliest clicks.

    The first layer is linear, so its user and item parts are computed once per user and per
    item; blocks of users and items of a bounded number of rows are written once, a task reads one of users and
    a share of those of items, and only ``k`` rows a user come out of it.  Users without factors get the cold-start list (no click_prob).
    """
    net = CtrNetwork.of(model, factors.rank)

    def user_part(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "h": list(net.of_users(np.vstack([*pdf["features"], np.zeros((0, factors_rank))])))})

    def item_part(batches):
        for pdf in batches:
            h = net.of_items(np.vstack([*pdf["features"], np.zeros((0, factors_rank))]), pdf["district_idx"].to_numpy(),
                             pdf[["price", "heat", "score"]].to_numpy())
            yield pd.DataFrame({"id": pdf["item_idx"], "h": list(h)})

    factors_rank, schema = factors.rank, "id long, h array<double>"
    known = users.join(factors.userFactors.select(F.col("id").cast("long").alias("user_idx"), "features"), "user_idx")
    uh = known.select(F.col("user_idx").alias("id"), "features").mapInPandas(user_part, schema)
    ih = (item_features.join(factors.itemFactors.select(F.col("id").cast("long").alias("item_idx"), "features"), "item_idx")
          .select("item_idx", "district_idx", "price", "heat", "score", "features").mapInPandas(item_part, schema))
    top = top_k_blocks(uh, ih, net.best(k), k, most=net.BLOCKS)
    scored = (top.join(known.select("user_id", "user_idx"), top["query_id"] == known["user_idx"])
              .join(item_features.select("item_idx", "poi_id"), top["neighbor_id"] == item_features["item_idx"])
              .select("user_id", "rank", "poi_id", F.col("score").alias("click_prob")))
    cold = cold_start_items(features, k).agg(F.collect_list(F.struct("rank", "poi_id"))).scalar()  # k rows
    new = users.join(factors.userFactors.select(F.col("id").cast("long").alias("user_idx")), "user_idx", "left_anti")
    return scored.unionByName(new.select("user_id", F.inline(cold)).withColumn("click_prob", F.lit(None).cast("double")))


# ---- L11 as a factorization machine ---------------------------------------------------

def fm_features(frame: DataFrame, buckets: int = FM_BUCKETS, columns: Sequence[str] = (
        "user_idx", "item_idx", "district_idx", "price", "heat", "score")) -> DataFrame:
    """Sparse ``features`` of a frame: one-hot user, item and district and the three numbers, hashed.

    Hashing bounds the model by ``buckets``, however many ids there are.
    """
    named = [c for c in columns if c in ("user_idx", "item_idx", "district_idx")]
    hasher = FeatureHasher(inputCols=list(columns), numFeatures=buckets, categoricalCols=named, outputCol="features")
    return hasher.transform(frame)


def fm_train(frame: DataFrame, buckets: int = FM_BUCKETS, factors: int = FM_FACTORS, max_iter: int = FM_ITERATIONS,
             step: float = FM_STEP, seed: int = SEED, features: DataFrame | None = None) -> FMClassificationModel:
    """A factorization machine over hashed ids; the pairwise factors play the part of user and item factors.

    Fitted on every row.  With ``features`` (L7), by which a row's item has its features, users and items are hashed once
    each and rows meet them in the cells of a grid (``machine.fit``, the steps of ``FMClassifier``); without, a row is a vector.
    """
    fm = FMClassifier(factorSize=factors, maxIter=max_iter, stepSize=step, regParam=1e-4, seed=seed,
                      labelCol="label", featuresCol="features")
    if features is not None:
        return _fm_fitted(fm, frame, features, buckets)
    # the assembler drops zeros that the hasher stores, which the gradient does not expect; scoring adds nothing for them
    hashed = fm_features(frame, buckets).select(F.col("features").alias("hashed"), "label")
    data = materialized(VectorAssembler(inputCols=["hashed"], outputCol="features").transform(hashed).drop("hashed"), "fm-fit")
    return fm.fit(data)


def _fm_fitted(fm: FMClassifier, frame: DataFrame, features: DataFrame, buckets: int) -> FMClassificationModel:
    """What ``fm.fit`` gives on the hashed rows of ``frame``, from the same first coefficients by Spark's own updates."""
    spark, k = frame.sparkSession, fm.getFactorSize()
    sc, item_cols = spark.sparkContext, ["item_idx", "district_idx", "price", "heat", "score"]

    def entries(table: DataFrame, cols: list[str]) -> DataFrame:
        hashed = fm_features(table, buckets, cols).withColumn("id", F.col(cols[0]).cast("long"))
        return materialized(machine.hashed_entries(hashed, len(cols)), f"fm-{cols[0]}")

    users = entries(frame.select("user_idx").distinct(), ["user_idx"])
    items = entries(ctr_item_features(features), item_cols)
    rows = frame.select("user_idx", "item_idx", F.col("label").cast("byte").alias("label"))
    grid = Grid.of(rows, users, items, grid_side(rows.count(), sc.defaultParallelism))
    one = spark.createDataFrame([(Vectors.sparse(buckets, {0: 1.0}), 1.0)], ["features", "label"])
    start = fm.copy({fm.maxIter: 0}).fit(one)  # no step is taken, so these are the first coefficients
    first = np.concatenate([start.factors.toArray().ravel(), start.linear.toArray(), [start.intercept]])
    adam = sc._jvm.org.apache.spark.ml.regression.AdamWUpdater(len(first))

    def update(weights: np.ndarray, gradient: np.ndarray, turn: int) -> np.ndarray:
        old, change = (sc._jvm.org.apache.spark.mllib.linalg.Vectors.fromML(_py2java(sc, Vectors.dense(x))) for x in (weights, gradient))
        return _java2py(sc, adam.compute(old, change, fm.getStepSize(), turn, fm.getRegParam())._1().asML()).toArray()

    found = machine.fit(grid, first, buckets, k, fm.getMaxIter(), update)
    cut = buckets * k
    java = sc._jvm.org.apache.spark.ml.classification.FMClassificationModel(
        fm.uid, float(found[-1]), _py2java(sc, Vectors.dense(found[cut:-1])), _py2java(sc, DenseMatrix(buckets, k, found[:cut], True)))
    model = FMClassificationModel(java)
    model._resetUid(fm.uid)
    return fm._copyValues(model)


def fm_score(model, frame: DataFrame) -> DataFrame:
    """L12 by the factorization machine: click probability of each row of ``frame``."""
    out = model.transform(fm_features(frame, model.numFeatures))
    return out.select(*frame.columns, vector_to_array("probability")[1].alias("click_prob"))


# ---- scoring by the network -------------------------------------------------------------

#: Rows of a frame that meet their users' and items' factors in one task, and that are scored at a time.
CELL_ROWS, SCORE_ROWS = 500_000, 1 << 13


def ctr_score(model: PipelineModel, frame: DataFrame, factors: ALSModel) -> DataFrame:
    """Click probability of each (user, item) row of ``frame``.

    Users and items are hashed into about sqrt(rows / CELL_ROWS) blocks each, and the rows into the cells of that grid.
    A cell meets the factors of its users and its items in one task, so no factor travels with a row: each row is
    shipped once without factors, each factor once per block of the other side.  A cell with more rows is split.
    """
    net, rank, columns = CtrNetwork.of(model, factors.rank), factors.rank, frame.columns
    side = frame.agg(F.greatest(F.ceil(F.sqrt(F.count(F.lit(1)) / CELL_ROWS)), F.lit(1)).cast("int").alias("side")).first()["side"]
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(side)).cast("int")
    rows = frame.withColumns({"_ub": block("user_idx"), "_ib": block("item_idx")})
    sizes = rows.groupBy("_ub", "_ib").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("_parts"))
    sizes = F.broadcast(materialized(sizes, "ctr-cells"))  # at most side * side rows
    key = ["_ub", "_ib", "_part"]
    rows = rows.join(sizes, ["_ub", "_ib"]).withColumn("_part", F.pmod(F.xxhash64(*columns), "_parts").cast("int")).drop("_parts")
    each = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))

    def dealt(vectors: DataFrame, own: str, is_user: bool) -> DataFrame:
        named = vectors.select(F.col("id").cast("long").alias("id"), "features", F.lit(is_user).alias("is_user"))
        blocks = named.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(side)).cast("int"))
        return blocks.join(sizes, own).withColumn("_part", each).select(
            *[F.col(c).alias(c) for c in key], "is_user", "id", "features")

    vectors = dealt(factors.userFactors, "_ub", True).unionByName(dealt(factors.itemFactors, "_ib", False))

    def lookup(found: pa.Table, is_user: bool, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors of one side, the place of each row's among them and whether it has one."""
        found = found.filter(pc.equal(found["is_user"], is_user)).select(["id", "features"])
        ids = found["id"].to_numpy()
        order = np.argsort(ids)
        flat = found["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(ids) else np.empty(0, np.float32)
        place = np.minimum(np.searchsorted(ids[order], idx), max(len(ids) - 1, 0))
        known = ids[order][place] == idx if len(ids) else np.zeros(len(idx), bool)
        return flat.reshape(-1, rank), order[place] if len(ids) else place, known

    def run(cell: pa.Table, found: pa.Table) -> pa.Table:
        uv, u, has_u = lookup(found, True, cell["user_idx"].to_numpy())
        iv, i, has_i = lookup(found, False, cell["item_idx"].to_numpy())
        known = np.flatnonzero(has_u & has_i)
        district = cell["district_idx"].to_numpy()
        numbers = np.column_stack([cell[c].to_numpy() for c in ("price", "heat", "score")])
        prob = np.empty(len(known))
        for a in range(0, len(known), SCORE_ROWS):
            r = known[a:a + SCORE_ROWS]
            first = net.of_users(uv[u[r]].astype(float)) + net.of_items(iv[i[r]].astype(float), district[r], numbers[r])
            prob[a:a + SCORE_ROWS] = _sigmoid(net.logit(first))
        kept = cell.select(columns)
        return (kept if len(known) == len(kept) else kept.take(known)).append_column("click_prob", pa.array(prob))

    schema = StructType([*frame.schema.fields, StructField("click_prob", DoubleType())])
    return rows.groupBy(*key).cogroup(vectors.groupBy(*key)).applyInArrow(run, schema)


def ctr_recommend_user(model: PipelineModel, factors: ALSModel, users: DataFrame, item_features: DataFrame,
                       features: DataFrame, user_id: int, k: int = 10) -> DataFrame:
    """L12 for one requested user: (rank, poi_id) of the items most likely clicked.

    Every item is scored once: the user's index is one value, so this is a projection over
    the items and no join of pairs.  A user without an index gets the cold-start list (L13).
    """
    index = users.where(F.col("user_id") == F.lit(user_id)).select("user_idx").first()
    known = factors.userFactors.where(F.col("id") == F.lit(index["user_idx"])).first() if index else None
    if known is None:
        return cold_start_items(features, k)
    uvec = array_to_vector(F.array(*[F.lit(float(x)) for x in known["features"]]))
    data = _with_factors(item_features, factors.itemFactors, "item_idx", "ivec", factors.rank)
    scored = model.transform(_sized(data.withColumn("uvec", uvec), "uvec", factors.rank)).select("poi_id", vector_to_array("probability")[1].alias("click_prob"))
    best = scored.orderBy(F.desc("click_prob"), F.asc("poi_id")).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("click_prob"), F.asc("poi_id")))  # over k rows
    return best.select(rank.cast("bigint").alias("rank"), "poi_id")


def held_out(frame: DataFrame, share: int = 5) -> Column:
    """A fixed share of the (user, item) pairs, by hash, that training does not see."""
    return F.pmod(F.xxhash64("user_idx", "item_idx"), F.lit(share)) == 0


def auc(scored: DataFrame) -> float:
    ev = BinaryClassificationEvaluator(rawPredictionCol="click_prob", labelCol="label", metricName="areaUnderROC")
    return ev.evaluate(scored)


# ---- L17: batch embedding --------------------------------------------------------

def embed_batch(text: Column, make_model, dim: int = 64, batch_size: int = 256) -> Column:
    """L17 with a caller's model: inference per row through ``predict_batch_udf`` (Arrow batches;
    ``make_model`` builds the model once per Python worker).  Without a model,
    ``similarity.text_vector_dense`` gives hashed text vectors natively."""
    udf = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return udf(text)


#: Tokens (runs of anything but white space) of a text that a model gets to see.
MAX_TOKENS = 77


def first_tokens(text: Column, most: int = MAX_TOKENS) -> Column:
    """The first ``most`` tokens of a text, one space apart; null is empty."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.array_join(F.slice(tokens, 1, most), " ")


def embed_text_and_image(text: Column, image: Column, make_model, dim: int = 64, batch_size: int = 256,
                         most: int = MAX_TOKENS) -> Column:
    """L17 with a caller's two-input model: (texts cut at ``most`` tokens, image bytes) -> vectors of ``dim``.

    ``make_model`` builds the model once per Python worker and gets both inputs as arrays of a batch; a
    missing image is empty bytes.
    """
    udf = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return udf(first_tokens(text, most), F.coalesce(image, F.lit(bytearray())))
