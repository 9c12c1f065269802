"""Operator 11: approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own codebook; a cell is a pair
of centroids.  A query walks the centroid pairs by the sum of its two squared distances, taken from
a heap, until the cells it has seen hold enough entries, and those entries are reranked by
their exact Euclidean distance.

How many entries are enough is measured, not guessed: a bounded sample of vectors is searched
exactly against all rows, and the walk must be as long as it takes to reach the wanted share of their
true neighbours.  So data with clusters is searched in few cells, and data without any in many.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no
part, nor do rows without an id or of another length than most rows have.  Rows that repeat an id
count once, with the smallest of its vectors.  Equal vectors are one entry with as many of
their smallest ids as an answer can use, so a vector that a third of all rows share is one entry.
An empty table gives no rows.  Columns other than the two named are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poi_analytics.llm.shared import drop_saved, saved

#: Centroids of a half; the index has the square of it in cells, which is what the driver counts.
CENTROIDS = 128
#: Rows that codebooks are fitted on, and rows that are searched exactly to set the length of a walk.
SAMPLE, CALIBRATION = 16_384, 256
#: Share of the true neighbours of the calibration rows that a walk must reach.
RECALL = 0.97
#: Rows of an index block and queries that meet it in one task.
BLOCK_ROWS, QUERY_ROWS = 16_384, 8_192
#: Queries whose walks are one task's work (a walk costs far more than its row's bytes suggest).
WALKS = 128
ROUNDS = 12


def _square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def fit_codebook(half: np.ndarray, centroids: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's centroids of the rows of one half; no more than it has distinct rows."""
    distinct = np.unique(half, axis=0)
    if len(distinct) <= centroids:
        return distinct
    c = distinct[np.linspace(0, len(distinct) - 1, centroids).astype(int)]
    for _ in range(rounds):
        at = _square_distances(half, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, half)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


@dataclass(frozen=True)
class Codebooks:
    """The centroids of both halves; cell = place in the first * size of the second + place in the second."""

    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, centroids: int = CENTROIDS) -> Codebooks:
        cut = (rows.shape[1] + 1) // 2
        return cls(fit_codebook(rows[:, :cut], centroids), fit_codebook(rows[:, cut:], centroids))

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _square_distances(rows[:, :cut], self.first), _square_distances(rows[:, cut:], self.second)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.distances(rows)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    @property
    def size(self) -> int:
        return len(self.first) * len(self.second)


def walk(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """All cells by the sum of their centroids' distances: every row of pairs has one entry in the heap."""
    by_a, by_b = a.argsort(kind="stable"), b.argsort(kind="stable")
    da, db, width = a[by_a].tolist(), b[by_b].tolist(), len(b)
    heap = [(da[0] + db[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(by_a[i]) * width + int(by_b[j])
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))


def cells_reached(a: np.ndarray, b: np.ndarray, counts: np.ndarray, entries: int) -> np.ndarray:
    """The non-empty cells of a walk, in order, until they hold ``entries`` entries."""
    found, held = [], 0
    for cell in walk(a, b):
        if counts[cell]:
            found.append(cell)
            held += counts[cell]
            if held >= entries:
                break
    return np.array(found, np.int32)


def distances_to(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences themselves."""
    d = rows - query
    return np.sqrt((d * d).sum(1))


def nearest(ids: list, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, id, distance) of the ``k`` nearest; an entry stands for all its ids, ties go to the smaller id."""
    d = distances_to(rows, query)
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        near = np.arange(len(d))
    place = np.repeat(near, [len(ids[i]) for i in near])
    names = np.array([x for i in near for x in ids[i]], np.int64)
    order = np.lexsort((names, d[place]))[:k]
    return place[order], names[order], d[place[order]]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): rows that take part, each id once."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull())
            .where(~odd & F.exists("v", lambda x: x != 0)))
    rows = saved(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    # lengths in use: a handful, and one row of the result is enough
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("v") == (most["dim"] if most else 0))


def distinct_entries(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, v): every distinct vector with its ``k`` + 1 smallest ids, the smallest of them as its name.

    A neighbour list has ``k`` places and ties go to the smaller id, so no answer can use more of them.
    """
    w = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v")


def bounded_sample(entries: DataFrame, n: int, size: int) -> DataFrame:
    """``size`` entries by the smallest hash of their name; ``n`` is how many there are."""
    h = F.xxhash64("rep", F.lit(11))
    if n > 2 * size:  # only rows that can be among them are sorted
        entries = entries.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 2 * size / n))
    return entries.orderBy(h, "rep").limit(size)


def _put_in_cells(entries: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    shipped = entries.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            cells = shipped.value.cells(matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), *batch.columns],
                                             names=["cell", *batch.schema.names])

    return entries.mapInArrow(run, "cell int, rep long, ids array<long>, v array<double>")


def exact_neighbours(queries: pd.DataFrame, entries: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, id, score, cell): the exact ``k`` nearest of a bounded set of queries, by one scan.

    ``queries`` has (rep, v) and travels to every task; each task sends ``k`` rows a query.
    """
    names = queries["rep"].to_numpy()
    shipped = entries.sparkSession.sparkContext.broadcast((names, np.array(list(queries["v"]), float).reshape(-1, dim)))

    def run(batches):
        names, wanted = shipped.value
        kept = [[] for _ in names]
        for batch in batches:
            rows, ids, cells = matrix(batch.column("v"), dim), batch.column("ids").to_pylist(), batch.column("cell").to_numpy()
            for at, (name, q) in enumerate(zip(names, wanted)):
                place, found, d = nearest(ids, rows, q, k + 1)
                own = found == name
                kept[at] = sorted(kept[at] + [*zip(d[~own].tolist(), found[~own].tolist(), cells[place[~own]].tolist())])[:k]
        got = [(int(name), i, d, c) for name, best in zip(names, kept) for d, i, c in best]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*got) if got else ((),) * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))],
            names=["query", "id", "score", "cell"])

    w = Window.partitionBy("query").orderBy("score", "id")
    found = entries.select("cell", "ids", "v").mapInArrow(run, "query long, id long, score double, cell int")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def walk_length(truth: pd.DataFrame, queries: pd.DataFrame, books: Codebooks, counts: np.ndarray, recall: float) -> int:
    """Entries a walk must reach so that the wanted share of the true neighbours lies in its cells."""
    need = []
    wanted = truth.groupby("query")["cell"].apply(list)
    a, b = books.distances(np.array(list(queries["v"]), float))
    for at, name in enumerate(queries["rep"]):
        if name not in wanted.index:
            continue
        left, held = list(wanted[name]), 0
        for cell in walk(a[at], b[at]):
            held += counts[cell]
            hits = left.count(cell)
            if hits:
                need += [held] * hits
                left = [c for c in left if c != cell]
                if not left:
                    break
    return int(np.quantile(need, recall, method="higher")) if need else int(counts.sum())


@dataclass(frozen=True)
class MultiIndex:
    """A fitted index: its entries by cell (a saved table) and what a search needs to know of them."""

    entries: DataFrame
    books: Codebooks
    counts: np.ndarray
    reach: int
    dim: int
    k: int

    @property
    def blocks(self) -> int:
        return max(1, -(-int(self.counts.sum()) // BLOCK_ROWS))


def build(rows: DataFrame, k: int, centroids: int = CENTROIDS, sample: int = SAMPLE, calibration: int = CALIBRATION,
          recall: float = RECALL) -> MultiIndex | None:
    """Index all of ``rows`` (from :func:`usable`); None when there are none.

    Codebooks and the walk's length are fitted on bounded samples (``sample``, ``calibration``);
    every row is indexed.  The driver gets the samples and one count a cell.
    """
    plain = saved(distinct_entries(rows, k), "entries")
    n = plain.count()
    if not n:
        return None
    fitted = np.array(list(bounded_sample(plain, n, sample).select("v").toPandas()["v"]), float)
    dim = fitted.shape[1]
    books = Codebooks.fit(fitted, centroids)
    entries = saved(_put_in_cells(plain, books, dim), "cells")
    counts = np.zeros(books.size, np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most one row a cell
        counts[r["cell"]] = r["count"]
    queries = bounded_sample(plain, n, calibration).select("rep", "v").toPandas()
    truth = exact_neighbours(queries, entries, dim, k).toPandas()
    drop_saved(plain)
    return MultiIndex(entries, books, counts, walk_length(truth, queries, books, counts, recall), dim, k)


def _blocks_of_cells(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last block of each cell: blocks follow the cells, a large cell spans several."""
    end = counts.cumsum()
    start = end - counts
    return start // BLOCK_ROWS, np.maximum(end - 1, 0) // BLOCK_ROWS


def _walks(queries: DataFrame, index: MultiIndex) -> DataFrame:
    """(block, rep, v, cells): each query in every block that its walk enters, with the cells it visits there."""
    first, last = _blocks_of_cells(index.counts)
    shipped = queries.sparkSession.sparkContext.broadcast((index.books, index.counts, first, last))
    reach, dim = index.reach, index.dim

    def run(batches):
        books, counts, first, last = shipped.value
        for batch in batches:
            a, b = books.distances(matrix(batch.column("v"), dim))
            names, rows = batch.column("rep").to_pylist(), batch.column("v").to_pylist()
            for at in range(batch.num_rows):
                cells = cells_reached(a[at], b[at], counts, reach)
                spans = last[cells] - first[cells] + 1
                block = np.repeat(first[cells] - (spans.cumsum() - spans), spans) + np.arange(spans.sum())
                cells = np.repeat(cells, spans)
                order = block.argsort(kind="stable")
                where, cuts = np.unique(block[order], return_index=True)
                parts = np.split(cells[order], cuts[1:])
                n = len(where)
                yield pa.RecordBatch.from_arrays([
                    pa.array(where, pa.int64()), pa.array([names[at]] * n, pa.int64()),
                    pa.array([rows[at]] * n, pa.list_(pa.float64())), pa.array(parts, pa.list_(pa.int32()))],
                    names=["block", "rep", "v", "cells"])

    return queries.select("rep", "v").mapInArrow(run, "block long, rep long, v array<double>, cells array<int>")


def _in_blocks(index: MultiIndex) -> DataFrame:
    """(block, cell, ids, v): each entry in its cell's block, or by hash in one of those that a large cell spans."""
    shipped = index.entries.sparkSession.sparkContext.broadcast(_blocks_of_cells(index.counts))

    def run(batches):
        first, last = shipped.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            mixed = batch.column("rep").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            block = first[cell] + mixed.astype(np.int64) % (last[cell] - first[cell] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(batch.column(c) for c in ("cell", "ids", "v"))],
                                             names=["block", "cell", "ids", "v"])

    return index.entries.mapInArrow(run, "block long, cell int, ids array<long>, v array<double>")


def search(queries: DataFrame, index: MultiIndex) -> DataFrame:
    """(rep, id, score, seen): for each query vector (rep, v) its ``k`` + 1 nearest of the entries its walk reaches.

    Queries and entries meet block by block: a task holds at most about BLOCK_ROWS entries and
    QUERY_ROWS queries, and sends ``k`` + 1 rows a query.  ``seen`` is how many entries were reranked.
    """
    k, dim, size = index.k + 1, index.dim, index.books.size
    n = queries.count()
    pieces = max(1, -(-n // QUERY_ROWS))
    q = _walks(queries.repartition(max(1, -(-n // WALKS)), "rep"), index).withColumn("piece", F.pmod(F.xxhash64("rep"), F.lit(pieces)))
    e = _in_blocks(index).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))

    def run(q: pa.Table, e: pa.Table) -> pa.Table:
        out = {"rep": [], "id": [], "score": [], "seen": []}
        if q.num_rows and e.num_rows:
            rows, ids = matrix(e["v"].combine_chunks(), dim), e["ids"].to_pylist()
            cell = e["cell"].to_numpy()
            for name, v, cells in zip(q["rep"].to_pylist(), matrix(q["v"].combine_chunks(), dim), q["cells"].to_pylist()):
                visited = np.zeros(size, bool)
                visited[cells] = True
                at = np.flatnonzero(visited[cell])
                if not len(at):
                    continue
                place, found, d = nearest([ids[i] for i in at], rows[at], v, k)
                out["rep"] += [name] * len(found)
                out["id"] += found.tolist()
                out["score"] += d.tolist()
                out["seen"] += [len(at)] + [0] * (len(found) - 1)
        return pa.table({"rep": pa.array(out["rep"], pa.int64()), "id": pa.array(out["id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64()), "seen": pa.array(out["seen"], pa.int64())})

    parts = saved(q.groupBy("block", "piece").cogroup(e.groupBy("block", "piece"))
                  .applyInArrow(run, "rep long, id long, score double, seen long"), "near")
    w = Window.partitionBy("rep").orderBy("score", "id")
    best = parts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n", "seen")
    return best.join(parts.groupBy("rep").agg(F.sum("seen").alias("seen")), "rep")


RESULT = "query_id long, rank int, vec_id long, score double, reranked long"


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                       vec_col: str = "embedding", **fitting) -> DataFrame:
    """(query_id, rank, vec_id, score, reranked): the ``k`` nearest found for every row with ``is_query``.

    ``is_query`` is a condition on ``id``; a row is never its own neighbour.  Equal query vectors are
    searched once for ``k`` + 1 rows, and each query drops itself from its list.  ``fitting`` goes to
    :func:`build`.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    index = build(rows, k, **fitting)
    if index is None:
        return spark.createDataFrame([], RESULT)
    asked = saved(rows.where(is_query).join(index.entries.select("rep", "v"), "v").select("id", "rep", "v"), "asked")
    found = search(asked.groupBy("rep").agg(F.first("v").alias("v")), index)
    own = asked.select(F.col("id").alias("query_id"), "rep")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumnRenamed("id", "vec_id").join(own, "rep").where("vec_id != query_id")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score",
                    F.col("seen").alias("reranked")))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the pairs of ``exact`` (query_id, vec_id) that ``found`` has too."""
    pairs = exact.select("query_id", "vec_id")
    total = pairs.count()
    return pairs.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0
