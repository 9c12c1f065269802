"""Repeated windows of symbols across documents: shared candidate search of the substring operators.

A window is ``window`` consecutive symbols of one document.  Every window has a smallest
``gram``-symbol piece by hash, its anchor; equal windows have equal anchors at equal places, so
windows can only be equal if they belong to anchors with equal grams.  An anchor's segment is
the text of all windows that hold it.  Segments that are equal as a whole need no more work;
grams with several different segments go, in shards of bounded size, to an index that finds
which of their windows are equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poi_analytics.llm.shared import (drop_saved, ordered_id, release, row_key, rows_at_a_time, runs, saved, scratch,
                                      texts_of)
from poi_analytics.session import remove

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x94D049BB133111EB)
BLOCK = 1 << 17  # symbols worked on at a time

SEGMENT = ("key long, gram long, seg long, oid long, doc long, at int, before int, after int, "
           "low int, high int, symbols binary")
MATCHED = "gram long, seg long, spans array<int>"


@dataclass(frozen=True)
class Search:
    """What repeats are looked for.

    ``symbols`` turns a text into 64-bit symbols to hash; ``stored`` into the bytes of a
    segment's symbols, ``width`` bytes each.  ``earlier``: a window counts if an equal one starts
    in a document with a smaller id; otherwise if an equal one starts anywhere else.  ``match``
    gets the segments of a shard and returns their matched windows as MATCHED rows.
    """

    window: int
    gram: int
    earlier: bool
    symbols: Callable[[bytes], np.ndarray]
    stored: Callable[[bytes], bytes]
    width: int  # bytes of a stored symbol
    match: Callable[[pa.Table], pa.Table]
    shard_symbols: int = 1 << 18  # what a task indexes at a time; an index takes some hundred bytes a symbol
    halvings: int = 2  # times every segment is halved before it is indexed
    hot: int = 4096    # segments of one key that share a shard at most


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class RangeHash:
    """64-bit hashes of any ranges of a symbol array, from prefix sums."""

    _up, _down = powers(_BASE, 1), powers(_BACK, 1)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(RangeHash._up) <= n:
            size = max(n + n // 4, BLOCK) + 1
            RangeHash._up, RangeHash._down = powers(_BASE, size), powers(_BACK, size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * RangeHash._up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * RangeHash._down[start])

    def same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the ranges of ``size`` symbols from ``a`` and from ``b`` have equal hashes."""
        return (self.sums[a + size] - self.sums[a]) * RangeHash._down[a] == (self.sums[b + size] - self.sums[b]) * RangeHash._down[b]

    def every(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` symbols, by start."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * RangeHash._down[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _M1
    h = (h ^ h >> np.uint64(29)) * _M2
    return h ^ h >> np.uint64(32)


def sliding(a: np.ndarray, size: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``size`` consecutive values, by doubling."""
    span = 1
    while 2 * span <= size:
        a = pick(a[:-span], a[span:])
        span *= 2
    return pick(a[:len(a) - (size - span)], a[size - span:]) if size > span else a


def anchors(symbols: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document number, place, gram hash, segment hash, symbols before, symbols from) of all anchors
    of documents whose symbols lie end to end."""
    stops = np.cumsum(lengths)
    starts = stops - lengths
    if not (lengths >= window).any():
        none = np.empty(0, np.int64)
        return none, none, none, none, none, none
    hashed = RangeHash(symbols)
    grams = hashed.every(gram) | np.uint64(1)
    span = window - gram + 1
    least = sliding(grams, span, np.minimum)
    for stop, length in zip(stops, lengths):  # windows past a document's end are none
        least[stop - min(window - 1, length):stop] = 0
    wide = np.zeros(len(grams) + span - 1, np.uint64)
    wide[span - 1:span - 1 + len(least)] = least
    at = np.flatnonzero(sliding(wide, span, np.maximum) == grams)
    doc = np.searchsorted(stops, at, "right")
    left, right = np.maximum(starts[doc], at + gram - window), np.minimum(stops[doc], at + window)
    before, after = at - left, right - at
    seg = hashed.of(left, right) + before.astype(np.uint64) * _M3 + after.astype(np.uint64) * _M1
    return doc, at - starts[doc], grams[at].view(np.int64), mixed(seg).view(np.int64), before, after


def _blocks(texts: list[bytes], symbols: Callable, window: int) -> Iterator[tuple[list, np.ndarray]]:
    """Documents' symbols in blocks; a document longer than a block comes in overlapping pieces.

    Yields ((document number, offset, symbols, own places from and to) per piece, symbols).
    """
    pieces, arrays, held = [], [], 0
    for i, text in enumerate(texts):
        s = symbols(text)
        if len(s) < window:
            continue
        # a piece answers for anchors at [a, b) and also holds a window's length on either side
        for a in range(0, len(s), BLOCK):
            b = min(a + BLOCK, len(s))
            low, high = max(a - window, 0), min(b + window, len(s))
            pieces.append((i, low, high - low, a, b))
            arrays.append(s[low:high])
            held += high - low
            if held >= BLOCK:
                yield pieces, np.concatenate(arrays)
                pieces, arrays, held = [], [], 0
    if pieces:
        yield pieces, np.concatenate(arrays)


def anchor_table(docs: DataFrame, search: Search) -> DataFrame:
    """(oid, key, at, before, after, gram, seg) of every anchor of every document."""
    w, g = search.window, search.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 2048):
            oid, key = (batch.column(i).to_numpy() for i in (0, 1))
            for pieces, symbols in _blocks(texts_of(batch.column(2)), search.symbols, w):
                number, low, length, first, stop = (np.array(c, np.int64) for c in zip(*pieces))
                doc, at, gram, seg, before, after = anchors(symbols, length, w, g)
                at = at + low[doc]
                inner = (at >= first[doc]) & (at < stop[doc])
                n = number[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[inner]) for x in (oid[n], key[n], at.astype(np.int32), before.astype(np.int32),
                                                  after.astype(np.int32), gram, seg)],
                    ["oid", "key", "at", "before", "after", "gram", "seg"])

    return docs.select("oid", "key", "text").mapInArrow(
        run, "oid long, key long, at int, before int, after int, gram long, seg long")


def segment_schema(more: list | None = None) -> pa.Schema:
    return pa.schema([(c, pa.int64()) for c in ("key", "gram", "seg", "oid", "doc")]
                     + [(c, pa.int32()) for c in ("at", "before", "after", "low", "high")]
                     + [("symbols", pa.binary())] + (more or []))


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _cut(search: Search) -> Step:
    """Batches of (oid, key, text, anchors) to segments with their symbols."""
    inside, schema = search.window - search.gram, segment_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 256):
            found = batch.column(3)
            counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)
            if not len(row):
                continue
            gram, seg, at, before, after = (found.flatten().field(c).to_numpy(zero_copy_only=False)
                                            for c in ("gram", "seg", "at", "before", "after"))
            oid, key = (batch.column(i).to_numpy()[row] for i in (0, 1))
            first, texts = (at - before).astype(np.int64), [search.stored(text) for text in texts_of(batch.column(2))]
            stop = (first + before + after) * search.width
            parts = [texts[i][x:y] for i, x, y in zip(row.tolist(), (first * search.width).tolist(), stop.tolist())]
            low, high = np.full(len(row), -inside, np.int32), np.zeros(len(row), np.int32)
            columns = [gram, gram, seg, oid, key ^ oid, first.astype(np.int32), before, after, low, high]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary())], schema=schema)

    return run


def _halve(search: Search) -> Step:
    """Segments to their halves: either half of the windows, keyed by what all windows of the half
    share; ``piece`` is the hash of the text of the windows it still has."""
    w, width = search.window, search.width
    schema = segment_schema([("piece", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_64_intdigest
        for batch in rows_at_a_time(batches, 4096):
            old, gram, seg, oid, doc, at, before, after, first, last = (
                np.repeat(c.to_numpy(), 2).astype(np.int64) for c in batch.columns[:10])
            second = np.arange(len(old)) % 2 == 1
            middle = (first + last) // 2
            low, high = np.where(second, middle + 1, first), np.where(second, last, middle)
            # windows are counted from the anchor; the segment has those from a to b
            a, b = np.maximum(low, -before), np.minimum(high, after - w)
            half = np.flatnonzero((low <= high) & (a <= b))
            if not len(half):
                continue
            old, gram, seg, oid, doc, at, before, low, high, a, b = (
                x[half] for x in (old, gram, seg, oid, doc, at, before, low, high, a, b))
            lead = before + a
            seeds = [(old ^ high).view(np.uint64), ((a & 0xFFFF) << 16 | b & 0xFFFF).view(np.uint64)]
            texts, parts, keys, pieces = batch.column(10).to_pylist(), [], [], []
            cuts = (x.tolist() for x in (half // 2, lead * width, (before + b + w) * width, (before + high) * width,
                                         (before + low + w) * width, *seeds))
            for i, start, stop, core, end, by, within in zip(*cuts):
                symbols = texts[i]
                part = symbols[start:stop]
                parts.append(part)
                keys.append(hashed(symbols[core:end], by))
                pieces.append(hashed(part, within))
            numbers = [np.array(keys, np.uint64).view(np.int64), gram, seg, oid, doc,
                       *(x.astype(np.int32) for x in (at + lead, -a, b + w, low, high))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(parts, pa.binary()),
                                              pa.array(np.array(pieces, np.uint64).view(np.int64))], schema=schema)

    return run


def _through(rows: DataFrame, steps: list[Step], schema: str) -> DataFrame:
    """The steps one after the other in the same Python worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return rows.mapInArrow(run, schema) if steps else rows


def _halving(rows: DataFrame, steps: list[Step], search: Search) -> tuple[DataFrame, DataFrame, str]:
    """Halve segments (``rows`` after the steps that make them) and settle what is now equal as a whole.

    Returns (gram, seg, spans) of the settled halves, the segments that still need an index, and the
    path that holds both, by ``kind`` (0 and 1).  Open are: of each piece one, where its key has
    other pieces as well.  Equal pieces, a passage in thousands of documents say, are one row of a
    grouped minimum here.
    """
    spark = rows.sparkSession
    halves = saved(_through(rows, [*steps, _halve(search)], SEGMENT + ", piece long"), "halves")
    # one number, so that the minimum is combined by hash and not by sorting
    place = F.col("oid") if search.earlier else F.xxhash64("oid", "doc", "at")
    pieces = saved(halves.groupBy("key", "piece").agg(F.count("*").alias("n"), F.min(place).alias("first")), "pieces")
    several = saved(pieces.groupBy("key").agg((F.count("*") > 1).alias("several")).where("several"), "keys")
    judged = saved(pieces.join(several, "key", "left").where("several or n > 1"), "judged")
    equal = F.col("oid") > F.col("first") if search.earlier else F.col("n") > 1
    kinds = F.array_compact(F.array(F.when(equal, 0), F.when(F.col("several") & (place == F.col("first")), 1)))
    names = segment_schema().names
    both = (halves.join(judged, ["key", "piece"]).select(*names, F.explode(kinds).alias("kind"))
            .withColumn("symbols", F.when(F.col("kind") == 1, F.col("symbols"))))
    path = scratch(spark, "halved")
    both.write.partitionBy("kind").parquet(path)
    release(spark)
    drop_saved(halves, pieces, several, judged)
    table = spark.read.schema(SEGMENT + ", kind int").parquet(path)
    settled = table.where("kind = 0").select("gram", "seg", F.array(-F.col("before"), F.col("after")).alias("spans"))
    return settled, table.where("kind = 1").select(*names), path


def _bounded(segments: DataFrame, steps: list[Step],
             search: Search) -> tuple[DataFrame | None, DataFrame, list[str], list[DataFrame]]:
    """Settled spans of the segments (rows that ``steps`` make into segments), and the open segments
    under keys with at most ``hot`` of them each; the paths and tables both are read from.

    All segments are halved ``halvings`` times first, as most of those that share a gram differ a few
    symbols further on.  Keys with more open segments are halved on, into keys of longer
    shared texts, until their segments differ; those of a single window are equal and settled.
    """
    settled = done = None
    paths, tables = [], []
    for level in range(1 + math.ceil(math.log2(search.window - search.gram + 1))):
        if level >= search.halvings:
            if steps:
                segments, steps = saved(_through(segments, steps, SEGMENT), "cut"), []
                tables.append(segments)
            hot = saved(segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > search.hot)
                        .select("key"), "hot")
            tables.append(hot)
            if hot.isEmpty():
                break
            cold = segments.join(hot, "key", "left_anti")
            done = cold if done is None else done.unionByName(cold)
            segments = segments.join(hot, "key", "left_semi")
        spans, segments, path = _halving(segments, steps, search)
        if paths and level < search.halvings:  # nothing reads the segments before this halving any more
            remove(segments.sparkSession, f"{paths[-1]}/kind=1")
        steps = []
        paths.append(path)
        settled = spans if settled is None else settled.unionByName(spans)
    return settled, segments if done is None else done.unionByName(segments), paths, tables


def covered(docs: DataFrame, search: Search) -> DataFrame:
    """(oid, key, spans): the symbol ranges (first, stop) of each document that repeated windows cover.

    ``docs`` has oid, key and text.  Documents without any are absent.
    """
    table = saved(anchor_table(docs, search), "anchors")
    many = (F.min("oid") < F.max("oid")) if search.earlier else (F.count("*") > 1)
    grams = saved(table.groupBy("gram").agg(many.alias("many"), (F.min("seg") != F.max("seg")).alias("mixed"))
                  .where("many").select("gram", "mixed"), "grams")
    kept = saved(table.join(grams, "gram"), "kept")
    drop_saved(table, grams)
    place = F.struct("oid", "key", "at", "before", "after")
    groups = saved(kept.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.min("oid").alias("first"),
                                                   F.max("mixed").alias("mixed"), F.min(place).alias("place")), "segments")
    wanted = groups.where("mixed").select("gram", "seg", "place.*")
    lists = wanted.groupBy("oid", "key").agg(F.collect_list(F.struct("gram", "seg", "at", "before", "after")).alias("a"))
    # the lists are the small side: no sort of the texts
    texts = docs.select("oid", "key", "text").join(lists.hint("shuffle_hash"), ["oid", "key"])
    settled, open_, paths, tables = _bounded(texts, [_cut(search)], search)
    total = open_.agg(F.sum(F.col("before") + F.col("after"))).first()[0] or 0
    shards = max(1, -(-total // search.shard_symbols))
    matched = (open_.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
               .groupBy("shard").applyInArrow(search.match, MATCHED))
    if settled is not None:
        matched = matched.unionByName(settled)
    matched = matched.groupBy("gram", "seg").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # a table of its own: a join of two tables is one that Spark can split at a hot segment
    decided = saved(groups.select("gram", "seg", "n", "first").join(matched, ["gram", "seg"], "left")
                    .where("n > 1 or spans is not null"), "decided")
    for path in paths:
        remove(docs.sparkSession, path)
    drop_saved(groups, *tables)
    own = F.col("oid") > F.col("first") if search.earlier else F.col("n") > 1
    pairs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2 - 1).cast("int")), lambda i: F.struct(
        (F.col("at") + F.get("spans", (2 * i).cast("int"))).alias("first"),
        (F.col("at") + F.get("spans", (2 * i + 1).cast("int"))).alias("stop")))
    whole = F.array(F.struct((F.col("at") - F.col("before")).alias("first"), (F.col("at") + F.col("after")).alias("stop")))
    found = (kept.join(decided, ["gram", "seg"]).where(own | F.col("spans").isNotNull())
             .select("oid", "key", F.when(own, whole).otherwise(pairs).alias("spans")))
    # an anchor that fills in between its neighbours adds nothing: one list per document
    spans = saved(found.groupBy("oid", "key").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    drop_saved(kept, decided)
    return spans


def matched_table(rows: list[tuple[int, int, int, np.ndarray]], window: int) -> pa.Table:
    """MATCHED rows from (gram, seg, symbols before the anchor, flags by window start)."""
    gram, seg, spans = [], [], []
    for g, s, before, flags in rows:
        first, stop = runs(flags)
        if len(first):
            gram.append(g)
            seg.append(s)
            spans.append(np.stack([first - before, stop - 1 + window - before], 1).ravel().tolist())
    return pa.Table.from_arrays([pa.array(gram, pa.int64()), pa.array(seg, pa.int64()),
                                 pa.array(spans, pa.list_(pa.int32()))], ["gram", "seg", "spans"])


def with_spans(docs: DataFrame, search: Search) -> DataFrame:
    """``docs`` (doc_id, text) with the repeated symbol ranges of every row, null for none."""
    keyed = docs.withColumn("oid", ordered_id()).withColumn("key", row_key())
    return keyed.join(covered(keyed, search).hint("shuffle_hash"), ["oid", "key"], "left")


def cover(spans: list[dict] | None, n: int) -> np.ndarray:
    """Flags of the symbols that lie in any span."""
    steps = np.zeros(n + 1, np.int64)
    for x in spans or ():
        steps[x["first"]] += 1
        steps[x["stop"]] -= 1
    return np.cumsum(steps[:-1]) > 0
