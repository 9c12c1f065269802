"""Byte-level substring dedup with suffix arrays built by external induced sorting.

A shard's segments are sorted as in eSAIS: the S* substrings (a local minimum to the next) get
ranks, the ranks form a text a third as long that is sorted recursively, and the order of
all suffixes is induced from it by two scans.  Each scan runs on a queue of
suffix tuples (place, common prefix with the tuple before it), a first-in-first-out run per
first symbol, which is a priority queue by (symbol, order of arrival); runs beyond the
memory budget lie on disk.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poi_analytics.llm.repeats import RangeHash, Search, with_spans
from poi_analytics.llm.shared import rows_at_a_time, runs, texts_of

WINDOW, GRAM = 200, 24
CAP = 255                # common prefixes are known up to here
QUEUE_TUPLES = 1 << 22   # tuples a queue holds in memory
FEW = 1 << 21            # a shorter text of ranks is sorted directly, a longer one by another level


class DiskQueue:
    """Tuples (place, common prefix) by symbol, each symbol's in order of arrival.

    Pushes and pops are in bulk.  Once more than ``limit`` tuples are held, the longest runs are
    written to an unnamed temporary file of the task and read back when their symbol's turn comes.
    """

    def __init__(self, limit: int = QUEUE_TUPLES):
        self.limit, self.held = limit, 0
        self.runs: dict[int, list[tuple]] = {}
        self.sizes: dict[int, int] = {}
        self.file = None

    def push(self, symbol: int, place: np.ndarray, lcp: np.ndarray) -> None:
        self.runs.setdefault(symbol, []).append((place, lcp))
        self.sizes[symbol] = self.sizes.get(symbol, 0) + len(place)
        self.held += len(place)
        while self.held > self.limit:
            self._spill(max(self.sizes, key=self.sizes.get))

    def _spill(self, symbol: int) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        place, lcp = self._join([r for r in self.runs[symbol] if len(r) == 2])
        at = self.file.seek(0, 2)
        self.file.write(place.tobytes())
        self.file.write(lcp.tobytes())
        self.runs[symbol] = [r for r in self.runs[symbol] if len(r) == 3] + [(at, len(place), place.dtype)]
        self.held -= self.sizes.pop(symbol)

    @staticmethod
    def _join(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The symbol's tuples in order, run by run; more may be pushed meanwhile."""
        while self.runs.get(symbol):
            parts = self.runs.pop(symbol)
            self.held -= self.sizes.pop(symbol, 0)
            for at, n, kind in (p for p in parts if len(p) == 3):  # what was written came first
                self.file.seek(at)
                place = np.frombuffer(self.file.read(n * kind.itemsize), kind)
                yield place, np.frombuffer(self.file.read(n), np.uint8)
            if held := [p for p in parts if len(p) == 2]:
                yield self._join(held)


class _RangeMinimum:
    """Minimum of any range of a byte array (a table of doubling spans)."""

    def __init__(self, values: np.ndarray):
        self.n = n = len(values)
        self.table = np.empty((max(1, n.bit_length()), n), np.uint8)
        self.table[0] = values
        for k in range(1, len(self.table)):
            span, last = 1 << k - 1, self.table[k - 1]
            np.minimum(last[:n - 2 * span + 1], last[span:n - span + 1], out=self.table[k, :n - 2 * span + 1])

    def of(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For ranges first:stop, CAP where empty."""
        width = stop - first
        level = np.frexp(np.maximum(width, 1))[1] - 1
        row = level.astype(np.int64) * self.n
        flat = self.table.ravel()
        out = np.minimum(flat.take(row + first, mode="clip"), flat.take(row + stop - (1 << level), mode="clip"))
        out[width <= 0] = CAP
        return out


class _Scan:
    """One induction scan: from tuples in order to the tuples one place to the left.

    Two tuples that enter the same symbol's run one after the other share one symbol and what
    their sources share, the minimum over all that was scanned between them.
    """

    def __init__(self, text: np.ndarray, queue: DiskQueue, symbols: int):
        self.text, self.queue = text, queue
        self.since = np.full(symbols, -1, np.int64)  # minimum since the symbol's last tuple; -1: none yet

    def feed(self, place: np.ndarray, lcp: np.ndarray, wanted) -> None:
        """``place`` in scan order, ``lcp`` with the one scanned before; pushes the left neighbours
        that ``wanted`` (their places, their symbols, the sources' symbols) accepts."""
        left = place - 1
        ok = left >= 0
        symbol = self.text[left]
        ok &= wanted(symbol, self.text[place])
        source = np.flatnonzero(ok)
        target = symbol[source].astype(np.int64)
        # numpy sorts numbers of 16 bits by radix
        order = np.argsort(target.astype(np.uint16) if len(self.since) <= 1 << 16 else target, kind="stable")
        source, target = source[order], target[order]
        least = _RangeMinimum(lcp)
        if len(source):
            first = np.diff(target, prepend=-1) != 0
            begin = np.concatenate([[0], source[:-1] + 1])
            begin[first] = 0
            value = least.of(begin, source + 1).astype(np.int64)
            value[first] = np.minimum(value[first], self.since[target[first]])
            value = np.minimum(value + 1, CAP).astype(np.uint8)
            heads = np.flatnonzero(first)
            lasts = np.append(heads[1:], len(source))
        self.since = np.minimum(self.since, int(lcp.min()) if len(lcp) else CAP)
        if len(source):
            tail = source[lasts - 1]
            self.since[target[heads]] = least.of(tail + 1, np.full(len(tail), len(lcp)))
            places = left[source]
            for a, b in zip(heads, lasts):
                self.queue.push(int(target[a]), places[a:b], value[a:b])


def _run_lengths(text: np.ndarray) -> np.ndarray:
    """How many equal symbols follow each place, itself included (up to CAP)."""
    n = len(text)
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    stop = np.repeat(ends, np.diff(ends, prepend=-1))
    return np.minimum(stop - np.arange(n) + 1, CAP).astype(np.uint8)


def _types(text: np.ndarray) -> np.ndarray:
    """True for S: the suffix is smaller than its right neighbour.  Symbol 0 ends a segment and is S."""
    n = len(text)
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    after = np.minimum(ends + 1, n - 1)
    rises = (text[after] > text[ends]) & (ends < n - 1)
    kind = np.repeat(rises, np.diff(ends, prepend=-1))
    kind[text == 0] = True
    return kind


def _direct(text: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; equal symbols 0 count by place."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum())).astype(np.int64)
    size = 1
    order = np.argsort(rank)  # equal ones get the same rank, in whichever order they come
    while True:
        ordered = rank[order]
        fresh = np.diff(ordered, prepend=ordered[:1]) != 0
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(fresh)
        if dense[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-size] = dense[size:] + 1
        rank = dense * (n + 2) + after
        order = np.argsort(rank)
        size *= 2


def _names(text: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, bool]:
    """Ranks of the S* substrings (each up to and with the next S* place).

    Symbols are compared some at a time, only among those still equal.  A substring that is the
    beginning of another is the larger of the two.  Substrings that reach a symbol 0, and the
    symbols 0 themselves, are made distinct by place, as every segment's end is its own.
    """
    m = len(stars)
    stops = np.where(text[stars] == 0, stars + 1, np.append(stars[1:] + 1, stars[-1] + 1))
    bits = max(2, int(text.max(initial=0) + 2).bit_length())
    each = 62 // bits
    beyond = (1 << bits) - 1
    rank, open_ = np.zeros(m, np.int64), np.arange(m)
    at = 0
    while len(open_):
        key = np.zeros(len(open_), np.int64)
        for i in range(at, at + each):
            place = stars[open_] + i
            inside = place < stops[open_]
            key = key << bits | np.where(inside, text[np.minimum(place, len(text) - 1)], beyond)
        order = np.lexsort((key, rank[open_])) if at else np.argsort(key)
        r, k = rank[open_][order], key[order]
        same_rank = np.diff(r, prepend=-1) == 0
        fresh = ~same_rank | (np.diff(k, prepend=-1) != 0)
        # ranks count the smaller ones, so a group can be split without touching the others
        places = np.arange(len(order))
        group = np.maximum.accumulate(np.where(same_rank, 0, places))
        new = r + np.maximum.accumulate(np.where(fresh, places, 0)) - group
        rank[open_[order]] = new
        at += each
        alone = np.ones(len(order), bool)
        alone[1:] &= new[1:] != new[:-1]
        alone[:-1] &= new[1:] != new[:-1]
        still = open_[order][~alone]
        open_ = np.sort(still[stars[still] + at < stops[still]])
    # equal ones that end in a symbol 0: by place
    closed = text[stops - 1] == 0
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    places = np.arange(m)
    same = np.diff(r, prepend=-1) == 0
    group = np.maximum.accumulate(np.where(same, 0, places))
    rank[order] = np.where(closed[order], r + places - group, r)
    return rank, len(np.unique(rank)) == m


def suffix_array(text: np.ndarray, hashed: RangeHash | None = None, limit: int = QUEUE_TUPLES,
                 few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes of ``text`` in order and what each shares with the one before.

    ``text`` holds small non-negative integers and ends with 0; zeros end segments, are smaller than
    anything else and differ from each other (smaller by place).  Common prefixes are cut at CAP.
    Recursion levels below the first need the order only; without ``hashed`` lcp is all zero.
    """
    n = len(text)
    kind = _types(text)
    star = kind.copy()
    star[0] = False
    star[1:] &= ~kind[:-1]
    star[text == 0] = True
    stars = np.flatnonzero(star)
    if len(stars) > n // 2:  # one or two symbols a segment: nothing to induce
        order = _direct(text)
        return order, _common(text, order, hashed)
    ranks, distinct = _names(text, stars)
    if distinct:
        star_order = stars[np.argsort(ranks)]
    else:
        # segment ends keep their meaning in the shorter text
        names = np.where(text[stars] == 0, 0, ranks + 1)
        present, names = np.unique(names, return_inverse=True)
        names = names if present[0] == 0 else names + 1
        star_order = stars[_direct(names) if len(names) <= few else suffix_array(names, None, limit, few)[0]]
    star_lcp = _common(text, star_order, hashed)
    return _induce(text, kind, star_order, star_lcp, _run_lengths(text), limit)


def _common(text: np.ndarray, order: np.ndarray, hashed: RangeHash | None) -> np.ndarray:
    """What neighbours in ``order`` share, up to CAP, found by halving on range hashes."""
    n = len(order)
    out = np.zeros(n, np.uint8)
    if hashed is None or n < 2:
        return out
    zeros = np.flatnonzero(text == 0)
    left = zeros[np.searchsorted(zeros, order)] - order
    a, b = order[:-1], order[1:]
    longest = np.minimum(np.minimum(left[:-1], left[1:]), CAP)
    low = np.zeros(n - 1, np.int64)
    step = 1 << int(longest.max()).bit_length()
    while step > 1:
        step //= 2
        fits = np.flatnonzero(low + step <= longest)
        x, y = a[fits] + low[fits], b[fits] + low[fits]
        low[fits[hashed.same(x, y, step)]] += step
    out[1:] = low
    return out


def _induce(text: np.ndarray, kind: np.ndarray, star_order: np.ndarray, star_lcp: np.ndarray,
            run: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes from the sorted S* suffixes: the L suffixes by an upward scan, then the S."""
    n = len(text)
    symbols = np.unique(text)
    top = int(symbols[-1]) + 1
    first_star = np.searchsorted(text[star_order], symbols)
    last_star = np.searchsorted(text[star_order], symbols, "right")
    l_order, l_lcp = np.empty(int((~kind).sum()), np.int64), np.empty(int((~kind).sum()), np.uint8)
    l_stop, filled = {}, 0
    scan = _Scan(text, DiskQueue(limit), top)
    for s, c in enumerate(symbols):
        begin = filled
        for place, lcp in scan.queue.pop(int(c)):
            l_order[filled:filled + len(place)], l_lcp[filled:filled + len(place)] = place, lcp
            filled += len(place)
            scan.feed(place, lcp, lambda left, own: left >= own)
        l_stop[int(c)] = (begin, filled)
        a, b = first_star[s], last_star[s]
        if b > a:
            lcp = star_lcp[a:b].copy()
            # after the last L of the symbol both begin with the symbol's run, and nothing more
            lcp[0] = min(run[l_order[filled - 1]], run[star_order[a]]) if filled > begin else 0
            scan.feed(star_order[a:b], lcp, lambda left, own: left > own)
    order, out = np.empty(n, np.int64), np.zeros(n, np.uint8)
    scan = _Scan(text, DiskQueue(limit), top)
    stop = n
    zeros = star_order[first_star[0]:last_star[0]] if symbols[0] == 0 else star_order[:0]
    for c in symbols[::-1]:
        c = int(c)
        if c == 0:
            order[:len(zeros)] = zeros
            break
        # downward: a tuple's common prefix is with the suffix after it
        above, edge = stop, None
        for place, lcp in scan.queue.pop(c):
            k = len(place)
            order[stop - k:stop] = place[::-1]
            # within the symbol, the tuple's neighbour above has it as its own common prefix
            shared = lcp[::-1]
            ends = np.arange(stop - k, stop) + 1
            inner = ends < above
            out[ends[inner]] = shared[inner]
            stop -= k
            scan.feed(place, lcp, lambda left, own: (left <= own) & (left > 0))
            edge = place[-1]
        a, b = l_stop[c]
        if b > a:
            k = b - a
            order[stop - k:stop] = l_order[a:b]
            out[stop - k:stop] = l_lcp[a:b]
            out[stop - k] = 0
            between = min(run[l_order[b - 1]], run[edge]) if edge is not None else 0
            if edge is not None:
                out[stop] = between
            down = np.concatenate([[between], l_lcp[a + 1:b][::-1]]).astype(np.uint8)
            stop -= k
            scan.feed(l_order[a:b][::-1], down, lambda left, own: (left < own) & (left > 0))
    return order, out


# --- the operator ------------------------------------------------------------------------------

_SYMBOLS = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64)


def _symbols(text: bytes) -> np.ndarray:
    return _SYMBOLS[np.frombuffer(text, np.uint8)]


def _cored(symbols: list[bytes], left: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Segments' texts end to end, each closed by 0, with the core's name in place of the core.

    A core is ``core`` symbols from ``left``, which all windows of the segment hold.  Its name, its
    number among the different cores, is two symbols that occur nowhere else, so that names meet
    only names.  Returns the text, where each segment ends in it and how many symbols there are.
    """
    names: dict[bytes, int] = {}
    number, parts = np.empty(len(symbols), np.int64), []
    for i, (s, a, b) in enumerate(zip(symbols, left.tolist(), (left + core).tolist())):
        number[i] = names.setdefault(s[a:b], len(names))
        parts += (s[:a], b"\0\0", s[b:], b"\0")
    flat = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.fromiter(map(len, symbols), np.int64, len(symbols)) - core + 2
    ends = np.cumsum(lengths + 1) - 1
    text = flat.astype(np.int32) + 1
    base = math.isqrt(len(names)) + 1
    at = ends - lengths + left
    text[at], text[at + 1] = 257 + number // base, 257 + number % base
    text[ends] = 0
    return text, ends, 257 + base


def match_shard(table: pa.Table) -> pa.Table:
    """Windows of a shard's segments that also start at another place of the corpus.

    A window begins at its segment's core or before and holds the whole core, so windows are equal if
    they are equal with the cores' names in place of the cores: only these shorter texts are sorted.
    """
    low, high, before, doc, at = (table[c].to_numpy().astype(np.int64) for c in ("low", "high", "before", "doc", "at"))
    text, ends, symbols = _cored(table["symbols"].to_pylist(), before + high, WINDOW - (high - low))
    starts = np.append(0, ends[:-1] + 1)
    marks = np.random.default_rng(7).integers(1, 2**63, symbols, np.uint64)
    order, lcp = suffix_array(text, RangeHash(marks[text]))
    segment = np.repeat(np.arange(len(ends)), ends - starts + 1)[order]
    # a group: suffixes that share a window; it counts if it holds two different places
    head = lcp < (high - low + 2)[segment]
    head[0] = True
    heads = np.flatnonzero(head)
    several = np.zeros(len(heads), bool)
    for x in (doc[segment], at[segment] + order - starts[segment]):
        several |= np.minimum.reduceat(x, heads) != np.maximum.reduceat(x, heads)
    found = np.zeros(len(text), bool)
    found[order] = several[np.cumsum(head) - 1]
    # no run goes beyond its segment: nothing is found after a core's first symbol
    first, stop = runs(found)
    segment = np.searchsorted(ends, first)
    offset = before[segment] + starts[segment]
    spans = np.stack([first - offset, stop - 1 + WINDOW - offset], 1).ravel().astype(np.int32)
    own, places = np.unique(segment, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(2 * places, len(spans)), pa.int32()), pa.array(spans))
    return pa.Table.from_arrays([*(table[c].combine_chunks().take(pa.array(own)) for c in ("gram", "seg")), lists],
                                ["gram", "seg", "spans"])


SEARCH = Search(window=WINDOW, gram=GRAM, earlier=False, symbols=_symbols, stored=bytes, width=1,
                match=match_shard, shard_symbols=1 << 20)

def _covered(spans: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, stop) of the maximal runs that each row's spans cover, in order."""
    counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    base = np.cumsum(sizes + 1) - sizes - 1  # one place between rows: runs do not join across them
    own, flat = np.repeat(base, counts), spans.flatten()
    first, stop = (flat.field(c).to_numpy(zero_copy_only=False) + own for c in ("first", "stop"))
    order = np.argsort(first)
    first, reach = first[order], np.maximum.accumulate(stop[order])
    head = np.append(True, first[1:] > reach[:-1])[:len(first)]
    first, stop = first[head], reach[np.append(head[1:], True)[:len(head)]]
    row = np.searchsorted(base, first, "right") - 1
    return row, first - base[row], stop - base[row]


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, search: Search = SEARCH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of ``docs``: the UTF-8 bytes left.

    A byte goes if it lies in a ``WINDOW``-byte string of its document that also starts anywhere
    else, in the same document or another, both taken from the input; every occurrence goes.
    A null text is empty; ids may be null or repeat (each row is a document of its own, so rows that
    repeat a text lose it); other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches):
            texts = texts_of(batch.column(1))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            row, first, stop = _covered(batch.column(2), sizes)
            gone, n_runs = np.zeros(len(texts), np.int64), np.bincount(row, minlength=len(texts))
            np.add.at(gone, row, stop - first)
            kept, bounds = list(texts), np.searchsorted(row, np.arange(len(texts) + 1))
            for i in np.flatnonzero(n_runs).tolist():
                own = slice(bounds[i], bounds[i + 1])
                kept[i] = b"".join(texts[i][x:y] for x, y in zip([0, *stop[own].tolist()], [*first[own].tolist(), None]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, n_runs)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_spans(rows, search).select("doc_id", "text", "spans").mapInArrow(run, REMOVED)


def digest(removed: DataFrame) -> DataFrame:
    """The result of :func:`remove_repeats` with the SHA-256 of the kept bytes in their place."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
