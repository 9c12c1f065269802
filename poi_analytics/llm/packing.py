"""Best-fit packing: token pieces into sequences by length patterns fitted with NNLS."""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from poi_analytics.llm.shared import saved

CAPACITY = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"


class _Chunks(dict):
    """Text chunk -> its ids as little-endian 32-bit bytes, filled on demand."""

    KEEP, LONGEST = 400_000, 64

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), "<u4").tobytes()
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.KEEP:
                self.clear()
            self[chunk] = ids
        return ids


class ByteBpe:
    """Ids of a byte-level BPE file, equal to the tokenizers library's own.

    A space begins a pre-token unless it stands inside a run of white space, so a text
    cut before its spaces encodes chunk by chunk, and chunks repeat.  Texts with the special
    token's string or a space between white space go to the libraries whole.
    """

    INSIDE_RUN = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})
        self.path, self.whole = path, None
        self.spaced = _Chunks(lambda chunk: self.fast.encode_ordinary(" " + chunk))

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            self.whole = self.whole or Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.INSIDE_RUN.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        head = np.array(self.fast.encode_ordinary(first), "<u4").tobytes()
        return head + b"".join(map(self.spaced.__getitem__, rest))


@lru_cache(1)
def byte_bpe(path: str, ranks_path: str) -> ByteBpe:
    return ByteBpe(path, ranks_path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
           ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and the place (part, rank) of each piece.

    A document is its ids and the end id.  A longer one is cut into pieces of
    ``capacity`` ids, the first holding what is left over.  ``rank`` numbers the pieces
    of one length within the task ``part``.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = byte_bpe(path, ranks_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = defaultdict(list)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.ids(text or "") + end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    length = stop - start
                    for name, value in (("doc_id", doc_id), ("piece", piece), ("start", start),
                                        ("length", length), ("rank", seen[length]),
                                        ("ids_crc32", zlib.crc32(ids[4 * start:4 * stop]))):
                        out[name].append(value)
                    seen[length] += 1
                    start, stop = stop, stop + capacity
            if out:
                n = len(out["piece"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()),
                     *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")),
                     pa.array(np.full(n, part)), pa.array(out["rank"], pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long")


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Every way to fill ``capacity`` exactly with one, two or three of the lengths (0: unused)."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    a = np.arange(1, capacity // 2 + 1)
    a = a[have[a] & have[capacity - a]]
    found.append(np.stack([capacity - a, a, np.zeros_like(a)], 1))
    for small in lengths[lengths <= capacity // 3]:
        mid = np.arange(small, (capacity - small) // 2 + 1)
        mid = mid[have[mid] & have[capacity - small - mid]]
        found.append(np.stack([capacity - small - mid, mid, np.full_like(mid, small)], 1))
    return np.concatenate(found).astype(np.int64)


def nnls(ways: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with the least weighted squares of (used - histogram).

    Accelerated projected gradient; ``ways`` holds three lengths per pattern.  Errors
    at long lengths weigh more, as the long pieces left over are the hardest to place.
    """
    size = len(histogram)
    weight = np.arange(size) / (size - 1)
    weight[0] = 0.0

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(ways.ravel(), np.repeat(x, ways.shape[1]), size)

    # the spectral norm by a few power steps bounds the step length
    v = np.ones(len(ways))
    for _ in range(20):
        v = (weight * used(v))[ways].sum(1)
        norm = np.sqrt((v * v).sum()) or 1.0
        v /= norm
    x = y = np.zeros(len(ways))
    t = 1.0
    for _ in range(steps):
        gradient = (weight * (used(y) - histogram))[ways].sum(1)
        new = np.maximum(y - gradient / (1.05 * norm), 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a sequence, how many such sequences)."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    full = []

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if count:
            (open_bins[room] if room else full).append((pattern, count))

    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            room = next((r for r in range(length, capacity) if open_bins.get(r)), capacity)
            if room < capacity:
                pattern, count = open_bins[room].pop()
            else:
                pattern, count = (), todo  # as many new ones as may be wanted
            each = min(room // length, todo)
            bins = min(count, todo // each)
            put(pattern + (length,) * each, room - each * length, bins)
            todo -= bins * each
            if room < capacity:
                put(pattern, room, count - bins)
    return full + [group for groups in open_bins.values() for group in groups]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use every piece of the histogram exactly once.

    The fitted counts are rounded down, cut to what is there, and best-fit packs the
    rest.  Taking all of the fit can leave a rest that packs badly, so smaller shares of
    it are tried as well and the plan with the fewest sequences wins.
    """
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return []
    ways = patterns(lengths, capacity)
    fit = nnls(ways, histogram) if len(ways) else np.empty(0)
    order = np.argsort(-fit, kind="stable")
    best = None
    for share in (1.0, 0.9, 0.7, 0.4):
        left, chosen = histogram.copy(), []
        for w in order:
            count = int(fit[w] * share + 1e-6)
            if not count:
                break
            used, times = np.unique(ways[w][ways[w] > 0], return_counts=True)
            count = min(count, int((left[used] // times).min()))
            if count:
                left[used] -= times * count
                chosen.append((tuple(int(v) for v in ways[w] if v), count))
        chosen += _best_fit(left, capacity)
        if best is None or sum(c for _, c in chosen) < sum(c for _, c in best):
            best = chosen
    return best


@dataclass(frozen=True)
class Slots:
    """For each length the ranks in order: from rank ``first[i]`` on, piece r of that length lies in
    sequence ``base[i] + r - first[i]`` at ``offset[i]``."""

    start: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(groups: list[tuple[tuple[int, ...], int]], capacity: int) -> Slots:
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 2)]
        taken = np.zeros(capacity + 1, np.int64)
        base = 0
        for lengths, count in groups:
            offset = 0
            for length in lengths:
                runs[length].append((int(taken[length]), base, offset))
                taken[length] += count
                offset += length
            base += count
        start = np.cumsum([0] + [len(r) for r in runs[:-1]])
        flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
        return Slots(start, flat[:, 0], flat[:, 1], flat[:, 2])

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for value in np.unique(length):
            own = length == value
            low, high = self.start[value], self.start[value + 1]
            i = low + np.searchsorted(self.first[low:high], rank[own], "right") - 1
            sequence[own] = self.base[i] + rank[own] - self.first[i]
            offset[own] = self.offset[i]
        return sequence, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
         ranks_path: str | None = None) -> DataFrame:
    """Pack every document of ``docs`` into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the end id alone.  Repeated rows are packed as often as they
    occur; a null doc_id stays null; other columns are ignored; an empty table gives an
    empty result.  The driver sees the length histogram only (``capacity`` numbers); the
    plan, bounded by the number of patterns of the capacity, travels to the tasks.
    """
    stored = saved(pieces(docs, capacity, path, ranks_path), "pieces")
    per_part = stored.groupBy("part", "length").agg(F.count("*").alias("n"))
    counted = per_part.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[counted["length"].to_numpy()] = counted["n"].to_numpy()
    slots = docs.sparkSession.sparkContext.broadcast(Slots.of(plan(histogram, capacity), capacity))
    earlier = saved(per_part.selectExpr(
        "part", "length", "sum(n) over (partition by length order by part) - n as earlier"), "offsets")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = slots.value.place(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = stored.join(earlier, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, "
                                    "ids_crc32 long, sequence_id long, offset long")
