"""Context-triggered piecewise hashing: fuzzy fingerprints and their likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poi_analytics.llm.shared import NO_ID, ordered_id, row_key, rows_at_a_time, saved

WINDOW = 7        # bytes that decide on a boundary
LEAST_BLOCK = 3   # block sizes are LEAST_BLOCK * 2^level
LONGEST = 64      # characters of the finer signature; the coarser one has up to half
RUN = 7           # equal characters in a row that two signatures must share (half a shorter one)
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    return np.multiply.accumulate(steps)


class _Tables:
    """Powers of the piece hash's multiplier, grown to the longest text seen."""

    up, down = _powers(_MULTIPLIER, 1), _powers(_INVERSE, 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = _powers(_MULTIPLIER, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def _rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last ``WINDOW`` bytes at every position (fewer at the start)."""
    c = data.astype(np.uint32) + np.uint32(1)
    out = c * np.uint32(0x01000193)
    factor = 0x01000193
    for back in range(1, min(WINDOW, len(c))):
        factor = factor * 0x01000193 & 0xFFFFFFFF
        out[back:] += c[:-back] * np.uint32(factor)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def _signature(prefix: np.ndarray, ends: np.ndarray, n: int, longest: int, down: np.ndarray) -> bytes:
    """A character per piece; pieces beyond ``longest`` are one piece up to the end."""
    starts = np.concatenate([[0], ends])[:longest]
    stops = np.append(ends, n)[:longest]
    stops[-1] = n
    keep = stops > starts
    starts, stops = starts[keep], stops[keep]
    value = (prefix[stops] - prefix[starts]) * down[starts] + (stops - starts).astype(np.uint64)
    value = (value ^ value >> np.uint64(33)) * _MIX
    return ALPHABET[(value >> np.uint64(58)).astype(np.intp)].tobytes()


def fingerprint(text: bytes) -> str:
    """``block:signature:signature at twice the block`` of the whole text; equal texts, equal prints.

    A position ends a piece when the hash of the last seven bytes is -1 modulo the block size.
    The block is the largest that still leaves half the characters a signature may have.
    An empty text is ``3::``.
    """
    n = len(text)
    if not n:
        return f"{LEAST_BLOCK}::"
    data = np.frombuffer(text, np.uint8)
    marks = _rolling(data).astype(np.int64) + 1
    at = np.flatnonzero(marks % LEAST_BLOCK == 0)
    low_bit = marks[at] & -marks[at]  # a trigger of block 3*2^k is one of every smaller block too
    level = 0
    while LEAST_BLOCK << level + 1 <= n and (LEAST_BLOCK << level) * LONGEST < n:
        level += 1
    while level and np.count_nonzero(low_bit >> level) + 1 < LONGEST // 2:
        level -= 1
    up, down = _Tables.upto(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    fine = at[low_bit >> level > 0] + 1
    coarse = at[low_bit >> level + 1 > 0] + 1
    parts = (_signature(prefix, ends, n, m, down).decode() for ends, m in ((fine, LONGEST), (coarse, LONGEST // 2)))
    return f"{LEAST_BLOCK << level}:{':'.join(parts)}"


def _edit_likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """1 - (insertions and deletions) / (both lengths) per pair; 0 without a common run.

    The longest common subsequence of all pairs at once, bit-parallel in one 64-bit word a pair.
    """
    n = len(pairs)
    a, b = (np.zeros((n, LONGEST), np.uint8) for _ in range(2))
    la, lb = (np.array([len(p[i]) for p in pairs], np.int64).reshape(n) for i in (0, 1))
    for i, (x, y) in enumerate(pairs):
        a[i, :len(x)] = np.frombuffer(x.encode(), np.uint8)
        b[i, :len(y)] = np.frombuffer(y.encode(), np.uint8)
    free = np.full(n, np.uint64(2**64 - 1))  # zero bits: characters of a that the subsequence uses
    shared = np.zeros(n, np.int64)           # the longest common run
    row = np.zeros((n, LONGEST + 1), np.int8)
    for j in range(int(lb.max(initial=0))):
        same = (a == b[:, j, None]) & (b[:, j, None] != 0)
        match = np.packbits(same, axis=1, bitorder="little").view(np.uint64).reshape(n)
        used = free & match
        free = (free + used) | (free - used)
        row[:, 1:] = np.where(same, row[:, :-1] + 1, 0)
        np.maximum(shared, row.max(1), out=shared)
    common = LONGEST - np.bitwise_count(free).astype(np.int64)
    total = la + lb
    ok = (total > 0) & (shared >= np.minimum(RUN, (np.minimum(la, lb) + 1) // 2))
    return np.where(ok, 2 * common / np.maximum(total, 1), 0.0)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints, compared at every block size that both have.

    Equal prints give 1, incompatible block sizes 0.
    """
    out = np.zeros(len(pairs))
    owner, todo = [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        sides = []
        for p in (x, y):
            block, fine, coarse = p.split(":")
            sides.append({int(block): fine, 2 * int(block): coarse})
        for block in sides[0].keys() & sides[1].keys():
            owner.append(i)
            todo.append((sides[0][block], sides[1][block]))
    if todo:
        np.maximum.at(out, np.array(owner), _edit_likeness(todo))
    return out


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the first as many code points of ``after``."""
    third = len(text) // 3
    return text[:len(text) - third] + after[:third]


def in_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, part, guest): rows in ``parts`` ranges of descending id, each sorted.

    Each range is followed by a guest, the first row of the next range (of the first range
    after the last), so that every row finds its next document in its own partition.  One
    document per range is all that is copied.  The text is shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       ordered_id().alias("oid"), row_key().alias("key"))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted({min(int(c), NO_ID) for c in rows.approxQuantile("oid", shares, 0.1 / parts)} if shares else ())
    part = F.lit(len(cuts)) - F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("oid"))) \
        if cuts else F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    order = F.struct((-F.col("oid")).alias("down"), "key")
    heads = saved(rows.groupBy("part").agg(F.min_by(F.struct("doc_id", "text", "oid", "key"), order).alias("h")), "heads")
    before = Window.orderBy("part")  # over one row per range
    last = heads.agg(F.max("part")).scalar()
    guests = (heads.withColumn("before", F.lag("part").over(before))
              .select("h.*", F.coalesce(F.col("before"), last).alias("part"), F.lit(True).alias("guest")))
    return (rows.withColumn("guest", F.lit(False)).unionByName(guests)
            .repartitionByRange(len(cuts) + 1, "part")
            .sortWithinPartitions("part", "guest", F.desc("oid"), "key")
            .select("doc_id", "text", "guest"))


def compare_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited form, and compare them and the next document's.

    The next document is the one with the next smaller doc_id; after the last comes the first.
    Returns doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text is empty; a null doc_id counts as the largest; rows with
    equal ids follow each other by a hash of the text; a table of one row is its own
    neighbour.  Other columns are ignored; an empty table gives an empty result.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row whose next document has not come yet
        for batch in rows_at_a_time(batches):
            rows = held + [(i, t, g, fingerprint(t.encode("utf-8", "surrogatepass")))
                           for i, t, g in zip(*(c.to_pylist() for c in batch.columns))]
            held = rows[-1:]
            pairs = [(own, after) for own, after in zip(rows, rows[1:]) if not own[2]]
            if not pairs:
                continue
            new = [edited(own[1], after[1]).encode("utf-8", "surrogatepass") for own, after in pairs]
            prints = [fingerprint(e) for e in new]
            near = likeness([(own[3], p) for (own, _), p in zip(pairs, prints)]
                            + [(own[3], after[3]) for own, after in pairs])
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([
                pa.array([own[0] for own, _ in pairs], pa.int64()),
                pa.array([len(own[1]) for own, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in new]),
                pa.array([own[3] for own, _ in pairs]), pa.array(prints),
                pa.array(near[:n]), pa.array(near[n:])], schema=schema)

    return in_ranges(docs, parts).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
