"""Substring dedup of word sequences with an FM-index per shard.

The index is a wavelet matrix over the Burrows-Wheeler transform of a shard's segments.
Segments stream through it from right to left: every backward-search step prepends a
word, so each place has the longest match known to start there, cut at the window length, and
its suffix-array interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poi_analytics.llm.repeats import RangeHash, Search, cover, matched_table, with_spans
from poi_analytics.llm.shared import WordHashes, rows_at_a_time, texts_of

WINDOW, GRAM = 50, 8


class WaveletMatrix:
    """Symbol counts of any prefix of a sequence, in one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, distinct: int):
        self.bits = max(1, int(distinct - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        rest = symbols
        for level in reversed(range(self.bits)):
            bit = (rest >> level & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[:len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:])
            self.words.append(words)
            self.before.append(ones)
            self.zeros.append(len(bit) - int(bit.sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])
        # where each symbol's run begins once all bits are sorted
        self.base = self._trace(np.arange(distinct), np.zeros(distinct, np.int64))

    def rank(self, symbol: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in the first ``stop`` places, for arrays of both."""
        return self._trace(symbol, stop) - self.base[symbol]

    def _trace(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self.bits))):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[i][word] + np.bitwise_count(self.words[i][word] & mask)
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` symbols or more, by doubling.

    Backward search with patterns up to that depth counts right whatever the order of ties.
    """
    n = len(text)
    rank, size = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while size < depth:
        after = np.zeros(n, np.int64)
        after[:-size or n] = rank[size:] + 1
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(sorted_pair, prepend=sorted_pair[:1]) != 0)
        size *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class FmIndex:
    """Index of segments (64-bit symbols each), for matches of up to ``window`` symbols."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray, window: int):
        self.window = window
        lengths = np.array([len(s) for s in segments], np.int64)
        flat = np.concatenate(segments)
        self.alphabet, ids = np.unique(flat, return_inverse=True)
        # a terminator (symbol 0) after every segment
        n = len(flat) + len(segments)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = ids + 1
        self.text, self.size = text, n
        self.starts = ends - lengths
        order = suffix_order(text, window + 1)
        self.counts = np.zeros(len(self.alphabet) + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1), out=self.counts[1:])
        self.bwt = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        segment = np.repeat(np.arange(len(segments)), lengths + 1)
        left = ends[segment[order]] - order  # symbols up to the terminator
        hashed = RangeHash(np.concatenate([flat, [np.uint64(0)]])[np.where(inside, np.cumsum(inside) - 1, len(flat))])
        self.floor, self.ceil = self._alike(order, left, hashed, window - 1)
        first, stop = self._alike(order, left, hashed, window)
        heads = np.flatnonzero(first == np.arange(n))
        least = np.minimum.reduceat(owners[segment[order]], heads)
        #: by place in the order: the smallest owner among the suffixes that share a window with it
        self.least = least[np.cumsum(first == np.arange(n)) - 1]

    @staticmethod
    def _alike(order: np.ndarray, left: np.ndarray, hashed: RangeHash, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the order whose suffixes share their first ``size`` symbols, per place."""
        n = len(order)
        full = left >= size
        start = np.where(full, order, 0)
        h = hashed.of(start, np.where(full, order + size, 0))
        same = np.zeros(n, bool)
        same[1:] = full[1:] & full[:-1] & (h[1:] == h[:-1])
        places = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, places))
        stop = np.append(np.flatnonzero(~same)[1:], n)[np.cumsum(~same) - 1]
        return first, stop

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        """Symbol numbers of a text, -1 for those the index does not hold."""
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, -1)

    def matches(self, text: np.ndarray, starts: np.ndarray, stops: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Flags by place of ``text`` (symbol numbers): a window starts there that also starts in a
        segment of a smaller owner.  Streams text[start:stop] of all lanes side by side.

        Per lane the interval of the current match (``size`` symbols from place ``at + 1``) is
        extended to the left.  A match of a whole window is widened to one symbol less first.
        Where no extension exists, the match starts anew one symbol further left.
        """
        w = self.window
        found = np.zeros(len(text), bool)
        at, size = stops - 1, np.zeros(len(starts), np.int64)
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size)
        live = np.flatnonzero(stops - starts >= w)
        while len(live):
            c = text[at[live]]
            full = size[live] == w
            lo, hi = low[live], high[live]
            hi = np.where(full, self.ceil[np.minimum(lo, self.size - 1)], hi)
            lo = np.where(full, self.floor[np.minimum(lo, self.size - 1)], lo)
            length = np.where(full, w - 1, size[live])
            known = np.maximum(c, 0)
            rank = self.bwt.rank(np.concatenate([known, known]), np.concatenate([lo, hi]))
            new_lo = self.counts[known] + rank[:len(live)]
            new_hi = self.counts[known] + rank[len(live):]
            ok = (c > 0) & (new_hi > new_lo)
            lane = live[ok]
            low[lane], high[lane], size[lane] = new_lo[ok], new_hi[ok], length[ok] + 1
            whole = lane[size[lane] == w]
            found[at[whole]] = self.least[low[whole]] < owners[whole]
            at[lane] -= 1
            lane, lost = live[~ok], length[~ok]
            # the match ended before place at + 1 + length; a shorter one may end one symbol earlier
            at[lane] = np.where(lost > 0, at[lane] + lost - 1, at[lane] - 1)
            low[lane], high[lane], size[lane] = 0, self.size, 0
            live = live[at[live] + 1 + size[live] - starts[live] >= w]
            live = live[at[live] >= starts[live]]
        return found


def match_shard(table: pa.Table) -> pa.Table:
    """Windows of a shard's segments that start in a document with a smaller id."""
    rows = table.select(["gram", "seg", "oid", "before", "symbols"]).to_pydict()
    segments = [np.frombuffer(s, "<u8") for s in rows["symbols"]]
    owners = np.array(rows["oid"], np.int64)
    index = FmIndex(segments, owners, WINDOW)
    stops = index.starts + np.array([len(s) for s in segments])
    found = index.matches(index.text, index.starts, stops, owners)
    return matched_table([(g, s, b, found[start:stop]) for g, s, b, start, stop in
                          zip(rows["gram"], rows["seg"], rows["before"], index.starts, stops)], WINDOW)


_words = WordHashes()


def _symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(_words.of(text), "<u8")


SEARCH = Search(window=WINDOW, gram=GRAM, earlier=True, symbols=_symbols, stored=_words.of, width=8,
                match=match_shard, shard_symbols=1 << 18)

def remove_repeats(docs: DataFrame, search: Search = SEARCH, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of every row of ``docs`` with n_words, n_removed and kept, the words left
    joined by one space.

    A word goes if it lies in a run of ``WINDOW`` consecutive words of its document that also starts
    in a document with a smaller doc_id, both taken from the input.  Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged.  A null text has none; a null doc_id is the largest id;
    rows of one id do not count as each other's earlier document, so repeated rows keep their
    words; other columns are ignored; an empty table gives an empty result.
    Words are told apart by 64-bit hashes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches):
            out = []
            for text, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
                words = text.split()
                gone = cover(spans, len(words))
                out.append((len(words), int(gone.sum()), b" ".join(x for x, g in zip(words, gone.tolist()) if not g)))
            n, removed, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], [*carry, "n_words", "n_removed", "kept"])

    rows = docs.select(*{*carry, "doc_id"}, F.col("text").cast("string").alias("text"))
    schema = rows.select(*carry).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return with_spans(rows, search).select(*carry, "text", "spans").mapInArrow(run, schema)


def digest(removed: DataFrame) -> DataFrame:
    """The result of :func:`remove_repeats` with the SHA-256 of the kept words in their place."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


