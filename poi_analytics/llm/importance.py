"""Operator 13: importance resampling towards a target distribution, features hashed by table CRC.

Features are runs of words; a feature's bucket is its CRC-32 modulo the number of buckets.  A bucket's
gain is the log ratio of its (smoothed) share in the target and in the corpus, a document's weight
the sum of its features' gains, and the documents with the largest weight plus Gumbel noise are
drawn: a sample without replacement in proportion to exp(weight).

CRC-32 is affine, so the checksum of a span is a constant of its length XOR one contribution per
byte, looked up by (distance from the span's end, byte).  The contributions of all spans of a batch
are gathered at once and folded by ``bitwise_xor.reduceat``; spans longer than the table are cut into
blocks from their end, whose folds are joined in pairs by the operator that moves a checksum
over as many zero bytes.

Defined cases: a null or wordless text has no feature, weight 0 and cannot be drawn; a null id hashes as
an empty string and comes last among ties.  Repeated rows are separate documents, and equal
(score, id) get adjacent ranks in an order fixed by the saved table.  Empty tables give no rows, an
empty target gives every bucket the gain of no occurrence.  Very long texts and words are folded
in bounded steps.  Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poi_analytics.llm.shared import ordered_id, saved, texts_of
from poi_analytics.operators.ranking import running_totals

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Distances from the end that the contribution table covers; a longer span is folded blockwise.
REACH = 64
#: Bytes of text in one step, and of gathered spans in one fold.
STEP, GATHER = 1 << 22, 1 << 20
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected


@lru_cache(1)
def contributions() -> np.ndarray:
    """[distance from the end, byte] -> what the byte adds to the checksum; row 0 is the usual byte table."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, row >> 1 ^ np.uint32(POLYNOMIAL), row >> 1)
    rows = [row]
    for _ in range(REACH - 1):
        rows.append(rows[-1] >> 8 ^ row[rows[-1] & 255])
    return np.stack(rows)


def _moved(value: np.ndarray, operator: np.ndarray) -> np.ndarray:
    """``value`` moved over zero bytes by an operator given as one table per byte of the checksum."""
    return (operator[0][value & 255] ^ operator[1][value >> 8 & 255]
            ^ operator[2][value >> 16 & 255] ^ operator[3][value >> 24])


@lru_cache(64)
def _over_blocks(level: int) -> np.ndarray:
    """The operator over REACH * 2**level zero bytes."""
    if level:
        half = _over_blocks(level - 1)
        return _moved(half, half)
    byte = contributions()[0]
    value = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(REACH):
        value = value >> 8 ^ byte[value & 255]
    return value


@lru_cache(4096)
def length_constant(n: int) -> int:
    """The checksum of ``n`` zero bytes."""
    crc, block = 0, bytes(1 << 16)
    for start in range(0, n, len(block)):
        crc = zlib.crc32(block[:min(len(block), n - start)], crc)
    return crc


def _folds(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span of at most REACH (and at least one) bytes."""
    out = np.empty(len(starts), np.uint32)
    ends = lengths.cumsum()
    table, lo = contributions(), 0
    while lo < len(starts):
        before = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + GATHER, "right")))
        n = lengths[lo:hi]
        first = n.cumsum() - n
        inside = np.arange(n.sum()) - np.repeat(first, n)
        parts = table[np.repeat(n, n) - 1 - inside, data[np.repeat(starts[lo:hi], n) + inside]]
        out[lo:hi] = np.bitwise_xor.reduceat(parts, first)
        lo = hi
    return out


def _fold_long(data: np.ndarray, start: int, length: int) -> int:
    """The fold of one span of any length: blocks from its end, joined in pairs."""
    cuts = np.maximum(np.arange(length, 0, -REACH) - REACH, 0)
    folds = _folds(data, start + cuts, np.minimum(np.arange(length, 0, -REACH), REACH))
    level = 0
    while len(folds) > 1:
        if len(folds) % 2:
            folds = np.append(folds, np.uint32(0))
        folds = folds[::2] ^ _moved(folds[1::2], _over_blocks(level))
        level += 1
    return int(folds[0])


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each span (start, length) of a byte array."""
    out = np.zeros(len(starts), np.uint32)
    short = (lengths > 0) & (lengths <= REACH)
    out[short] = _folds(data, starts[short], lengths[short])
    for i in np.flatnonzero(lengths > REACH):
        out[i] = _fold_long(data, int(starts[i]), int(lengths[i]))
    sizes, which = np.unique(lengths, return_inverse=True)
    return out ^ np.array([length_constant(int(n)) for n in sizes], np.uint32)[which]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Word bytes after lower-casing: digits, a to z and every byte of a character beyond ASCII.
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths, ends of texts in words) of all texts' words; A-Z are lower-cased."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    edge = np.flatnonzero(np.diff(_WORD[data].astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends - starts, np.searchsorted(starts, text_ends)


def features_of(texts: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(checksums, ends of texts in features) of the runs of 1 to ``longest`` words, one length at a time."""
    data, starts, lengths, last = words_of(texts)
    yield crc32_of_spans(data, starts, lengths), last
    if longest == 1:
        return
    # the words again, one space apart
    inside = np.arange(lengths.sum() + len(lengths)) - np.repeat((lengths + 1).cumsum() - lengths - 1, lengths + 1)
    at = np.minimum(np.repeat(starts, lengths + 1) + inside, len(data) - 1)
    data = np.where(inside < np.repeat(lengths, lengths + 1), data[at], np.uint8(32))
    starts = (lengths + 1).cumsum() - lengths - 1
    text = np.repeat(np.arange(len(last)), np.diff(last, prepend=0))
    for n in range(2, longest + 1):
        first = np.flatnonzero(text[n - 1:] == text[:len(text) - n + 1]) if len(text) >= n else np.empty(0, int)
        final = first + n - 1
        yield (crc32_of_spans(data, starts[first], starts[final] + lengths[final] - starts[first]),
               np.searchsorted(text[first], np.arange(len(last)), "right"))


def _steps(batches, longest: int):
    """(ids, word counts, [(checksums, ends)]) of a bounded number of bytes at a time."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= STEP):
                held += len(texts[hi])
                hi += 1
            yield ids[lo:hi], list(features_of(texts[lo:hi], longest))
            lo = hi


def _rows(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    name = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(name.alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features of all rows by bucket.  Each task sends one row a bucket, so at most ``buckets`` rows are collected."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, features in _steps(batches, longest):
            for crc, _ in features:
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    sums = _rows(docs, None, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of a bucket's smoothed share in the target over that in the corpus."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int) -> int:
    """floor of 1000 times a Gumbel draw that depends on id and seed alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1,
          seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, without a shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        gain = shipped.value
        for ids, features in _steps(batches, longest):
            weight, count, words = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), None
            for crc, ends in features:
                so_far = np.concatenate([[0], gain[crc % np.uint32(len(gain))].cumsum()])
                weight += np.diff(so_far[ends], prepend=0)
                count += np.diff(ends, prepend=0)
                words = count.copy() if words is None else words
            score = weight + np.array([noise(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (words, count, weight, score))],
                names=["doc_id", "n_words", "n_features", "weight", "score"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", buckets: int = BUCKETS, longest: int = 1, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` numbers the drawn ones, else null.

    Two passes over the texts (counts, weights), then a global ranking of the narrow result by ranges of the score: no
    task sorts more than its range, however the scores are spread.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    # the salt parts rows that are equal in score and id; it is fixed once the table is written
    rows = saved(weigh(docs, gain, id_col, text_col, longest, seed).withColumn("salt", F.rand(seed)), "weights")
    enough = F.col("n_words") >= least_words
    drawn = percent * rows.where(enough).count() // 100
    ranked = running_totals(rows.where(enough).withColumn("late", ordered_id()), [F.desc("score"), F.asc("late"), F.asc("salt")],
                            {"before": F.lit(1)})
    place = F.col("before") + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    return (ranked.select(*columns, F.when(place <= drawn, place).alias("rank"))
            .union(rows.where(~enough).select(*columns, F.lit(None).cast("long"))))


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = (f"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWERED}'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w")

#: The query's rows in DuckDB, checksums by the usual byte table.
ORACLE = f"""
WITH byte_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x:
      CASE WHEN c % 2 = 1 THEN xor(c // 2, {POLYNOMIAL}::BIGINT) ELSE c // 2 END) AS v FROM range(256) r(i))),
words AS (SELECT doc_id, {_WORDS_SQL} FROM documents),
targets AS (SELECT {_WORDS_SQL} FROM benchmark),
buckets AS (
  SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(w), CAST(2 * i - 1 AS BIGINT), 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]))) % {BUCKETS} AS bucket
  FROM (SELECT w FROM words UNION SELECT w FROM targets), byte_table),
corpus AS (SELECT bucket, count(*) AS n FROM words JOIN buckets USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM targets JOIN buckets USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1::DOUBLE) * ((SELECT count(*) FROM words) + {BUCKETS})
    / ((c.n + 1::DOUBLE) * ((SELECT count(*) FROM targets) + {BUCKETS})))) AS g
  FROM corpus c LEFT JOIN target t USING (bucket)),
weights AS (
  SELECT d.doc_id, count(g) AS n_features, CAST(coalesce(sum(g), 0) AS BIGINT) AS weight
  FROM documents d LEFT JOIN (words JOIN buckets USING (w) JOIN gain USING (bucket)) f ON f.doc_id = d.doc_id GROUP BY d.doc_id),
scores AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT + 0.5::DOUBLE)
    / 4294967296))) AS BIGINT) AS score FROM weights),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank
FROM scores s LEFT JOIN ranked r ON r.doc_id = s.doc_id"""
