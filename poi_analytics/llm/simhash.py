"""SimHash fingerprints and near-duplicate components by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poi_analytics.llm.components import components
from poi_analytics.llm.shared import NO_ID, ordered_id, row_key, saved, texts_of

SEED = 42
PARTS, PART_BITS = 4, 16  # population counts are taken of four 16-bit parts
TOGETHER = 64  # pieces of one cell that meet a tile under one key


def simhash(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of one text: majority over the XXH64 of its word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.array(list(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED))), np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp bigint) for every row of ``docs``; null and wordless texts have fp 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, shingle) for t in texts_of(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_key(), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, key long, fp long")


def _near_cells(radius: int) -> list[list[int]]:
    """Offsets of part counts with an L1 norm within ``radius``, one of each +/- pair, and zero."""
    span = range(-radius, radius + 1)
    return [list(d) for d in product(span, repeat=PARTS)
            if sum(map(abs, d)) <= radius and tuple(d) >= (0,) * PARTS]


def _linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``a`` and ``b`` within ``radius`` bits, reduced to a forest.

    Compares in strips, so memory stays at a strip times ``len(b)``; within a strip
    every matched row joins the strip's smallest matching partner.
    """
    rows, cols = [], []
    for start in range(0, len(a), 256):
        near = np.bitwise_count(a[start:start + 256, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        if not len(i):
            continue
        # label b's columns by the smallest row that reaches them, until nothing changes
        label = np.arange(near.shape[0])
        while True:
            col = np.full(len(b), near.shape[0])
            np.minimum.at(col, j, label[i])
            new = label.copy()
            np.minimum.at(new, i, col[j])
            if (new == label).all():
                break
            label = new
        hit_rows, hit_cols = np.unique(i), np.unique(j)
        first_col = np.full(near.shape[0], len(b))
        np.minimum.at(first_col, label[i], j)
        # a star per component: rows to its first column, columns to its first row
        rows += [hit_rows + start, col[hit_cols] + start]
        cols += [first_col[label[hit_rows]], hit_cols]
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def links(fps: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``radius`` differing bits.

    ``fps`` has one row per distinct ``fp``.  Fingerprints are laid in tiles by the
    population counts of their four 16-bit parts.  Two fingerprints within the radius
    have part counts whose differences add up to at most the radius, so only such tile
    pairs meet, and every other pair is skipped without loss.  Large tiles are cut by
    hash into pieces of about ``tile`` fingerprints, which meet pair by pair, so the pairs of
    one large tile are spread over tasks.  Of the pairs found in a tile pair a
    spanning set is emitted (same components, no quadratic output).
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", PART_BITS * i).bitwiseAND((1 << PART_BITS) - 1))
              for i in range(PARTS)]
    cells = fps.select("fp", F.array(*counts).alias("cell"))
    # at most 17^4 cells exist, whatever the input
    pieces = saved(cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("pieces")), "cells")
    most = pieces.agg(F.max("pieces")).first()[0] or 1
    tiles = saved(cells.join(F.broadcast(pieces), "cell")
                  .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("pieces")).alias("piece"))
                  .agg(F.collect_list("fp").alias("fps")), "tiles")
    near = F.array(*[F.array(*map(F.lit, d)) for d in _near_cells(radius)])
    left = (tiles.select("fps", F.col("piece").alias("p"), F.col("cell").alias("own"), F.explode(near).alias("d"))
            .select("fps", "p", "own", F.zip_with("own", "d", lambda x, y: x + y).alias("cell"))
            .join(F.broadcast(pieces), "cell")
            .select("fps", "p", "own", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
            .where("own != cell or p <= piece"))
    # a key has one tile and at most TOGETHER pieces of each cell near it
    right = tiles.select("cell", "piece", F.col("fps").alias("others"),
                         F.explode(F.sequence(F.lit(0), F.lit((most - 1) // TOGETHER))).alias("turn"))
    pairs = (left.withColumn("turn", F.floor(F.col("p") / TOGETHER).cast("int"))
             .join(right, ["cell", "piece", "turn"]).select("fps", "others"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                i, j = _linked(a, b, radius)
                out_a.append(a[i])
                out_b.append(b[j])
            a, b = (np.concatenate(v or [np.empty(0, np.uint64)]).view(np.int64) for v in (out_a, out_b))
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and (fp, component): the component of every fingerprint."""
    own = saved(fingerprints(docs, shingle), "simhash")
    nodes = saved(own.select("fp").distinct(), "nodes")
    joined = components(links(nodes, radius, tile))
    return own, nodes.join(joined, nodes.fp == joined.node, "left").select(
        F.col("fp").alias("k"), F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, tile: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest doc_id reachable, the own one included.  Equal
    fingerprints (exact copies among them) are one node from the start.  A null text
    counts as wordless (fp 0); rows with a null doc_id take part as the largest id, and a
    group of null ids only has a null component_id.  Repeated rows give repeated result
    rows; other columns are ignored; an empty table gives an empty result.
    """
    own, group = _grouped(docs, shingle, radius, tile)
    first = own.groupBy("fp").agg(F.min(ordered_id()).alias("root"))
    rooted = saved(group.join(first, group.k == first.fp).select("k", "component", "root"), "rooted")
    least = rooted.groupBy("component").agg(F.min("root").alias("component_id"))
    roots = rooted.join(least, "component").select("k", "component_id")
    return own.join(roots, own.fp == roots.k).select(
        "doc_id", "fp", F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2, tile: int = 4096) -> DataFrame:
    """The rows of ``docs``, all columns, with one left of each near-duplicate component.

    The row with the smallest doc_id stays (then by a hash of the text); of rows that repeat it in
    full, one.  Nulls count as in :func:`near_duplicates`.
    """
    own, group = _grouped(docs, shingle, radius, tile)
    rows = own.select(ordered_id().alias("oid"), "key", "fp").groupBy("oid", "key", "fp").agg(F.count("*").alias("n"))
    stay = (rows.join(group, rows.fp == group.k).groupBy("component")
            .agg(F.min(F.struct("oid", "key", "n")).alias("s")).select("s.*"))
    stay = saved(stay.withColumnsRenamed({"oid": "stay_oid", "key": "stay_key", "n": "stay_n"}), "stay")

    def among(some: DataFrame) -> DataFrame:
        # named through their table: ``docs`` may have columns of any name
        same = (ordered_id() == some["stay_oid"]) & (row_key() == some["stay_key"])
        return docs.join(some.hint("shuffle_hash"), same, "left_semi")  # the ids are the small side: no sort of the texts

    kept, many = among(stay.where("stay_n = 1")), stay.where("stay_n > 1")
    if many.isEmpty():
        return kept
    packed = among(many).select(
        ordered_id().alias("oid"), row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return kept.unionByName(packed.dropDuplicates(["oid", "key"]).select("row.*"))
