"""Document log-likelihood under a gated recurrent language model, in numpy inside Spark tasks.

Documents become token batches written once to the shared folder.  Word counts over all
training documents are exchanged batch by batch, bucketed by word hash.  The network
trains by truncated backpropagation in the tasks, with its parameters averaged between
rounds, and scores every document with the state carried from its first to its last token.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poi_analytics.llm.shared import WordHashes, rows_at_a_time, saved, texts_of

LOG10 = np.log(10.0)
END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds white space, so no word is the end token


@dataclass(frozen=True)
class Settings:
    """The network's size and its training; counts and scores always cover all documents.

    ``train_share``: each round trains on the training documents of one hash class out of so
    many, in every batch, the next round on the next class.  There are as many rounds as classes
    at least, so every training document is learned from.
    """

    words: int = 4096          # most frequent training tokens with outputs of their own
    class_words: int = 64      # words per output class, by frequency rank
    hidden: int = 16
    window: int = 32           # steps of truncated backpropagation
    lanes: int = 64            # documents trained side by side
    rounds: int = 2
    train_share: int = 2
    rate: float = 0.01
    smoothing: float = 0.1
    batch_docs: int = 4096
    batch_bytes: int = 16 << 20
    bucket_entries: int = 500_000
    held_out: int = 10


# --- token batches -----------------------------------------------------------------------------

def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


BATCH = ("batch string, docs int, entries long, trained long, doc_ids array<long>, held_out array<boolean>, "
         "lengths binary, tokens binary, hashes binary, counts binary")


def token_batches(docs: DataFrame, s: Settings) -> DataFrame:
    """A row per batch of documents: its distinct token hashes (as they occur) with their counts in the
    batch's training documents, and every document's tokens as indexes into them."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % s.held_out == 0, F.lit(True))
    end = END.to_bytes(8, "little")

    def batch_row(part: str, n: int, ids: list, held: list, hashed: list[bytes]) -> pa.RecordBatch:
        lengths = np.array([len(h) // 8 for h in hashed], np.int64)
        tokens, distinct = pd.factorize(np.frombuffer(b"".join(hashed), "<u8"))
        training = np.repeat(~np.array(held, bool), lengths)
        counts = np.bincount(tokens[training], minlength=len(distinct))
        values = [[f"{part}-{n}"], [len(ids)], [len(distinct)], [int(training.sum())], [ids], [held],
                  *([_packed(a)] for a in (lengths, tokens.astype("<u4"), distinct, counts.astype("<u4")))]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()),
                 *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)],
                                          [f.split()[0] for f in BATCH.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words = str(TaskContext.get().partitionId()), WordHashes()
        ids, held, hashed, size, n = [], [], [], 0, 0
        for batch in rows_at_a_time(batches):
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         texts_of(batch.column(2))):
                ids.append(doc_id)
                held.append(out)
                hashed.append(words.of(text.lower()) + end)
                size += len(hashed[-1])
                if len(ids) >= s.batch_docs or size >= s.batch_bytes:
                    yield batch_row(part, n, ids, held, hashed)
                    ids, held, hashed, size, n = [], [], [], 0, n + 1
        if ids:
            yield batch_row(part, n, ids, held, hashed)

    return saved(docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string"))
                 .mapInArrow(run, BATCH), "tokens")


# --- corpus counts -----------------------------------------------------------------------------

COUNTED = "kind int, batch string, bucket long, data binary, tokens long, distinct_tokens long"


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the hashes, and the order that puts those of a bucket together, the first bucket first."""
    own = hashes % np.uint64(buckets)
    return own, np.argsort(own, kind="stable")


def corpus_counts(batches: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """Counts of every token over all training documents, by batch and by bucket; the number of buckets.

    Kind 0: for a batch and a bucket that it has hashes of, their corpus counts, in the batch's
    order.  Kind 1: for a bucket, its tokens, distinct tokens and its most frequent
    hashes with counts.  A word crosses the network once per batch at most, however frequent, and no
    row is sent without a word: rows and bytes grow with the batches' distinct words.
    """
    entries = batches.agg(F.sum("entries")).first()[0] or 0
    buckets = max(1, -(-entries // s.bucket_entries))

    def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for batch, hashes, counts in zip(*(c.to_pylist() for c in r.columns)):
                hashes, counts = _unpacked(hashes, "<u8"), _unpacked(counts, "<u4")
                own, order = _by_bucket(hashes, buckets)
                used, first = np.unique(own[order], return_index=True)
                pieces = np.split(order, first[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int64)), pa.array([batch] * len(used)),
                     pa.array([hashes[p].tobytes() for p in pieces], pa.binary()),
                     pa.array([counts[p].tobytes() for p in pieces], pa.binary())],
                    ["bucket", "batch", "hashes", "counts"])

    def total(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, "<u8") for h in table["hashes"].to_pylist()]
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in table["counts"].to_pylist()])
        distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(at, counts, len(distinct)).astype(np.int64)
        ends = np.cumsum([len(h) for h in hashes])
        rows = [(0, b, _packed(sums[at[e - len(h):e]].astype("<i8")), None, None)
                for b, h, e in zip(table["batch"].to_pylist(), hashes, ends)]
        order = np.lexsort((distinct, -sums))[:s.words]
        top = np.stack([distinct[order].view(np.int64), sums[order]]) if len(order) else np.empty((2, 0), np.int64)
        rows.append((1, None, _packed(top), int(sums.sum()), int((sums > 0).sum())))
        kind, batch, data, tokens, known = zip(*rows)
        bucket = [table["bucket"][0].as_py()] * len(rows)
        return pa.Table.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(batch, pa.string()), pa.array(bucket, pa.int64()),
             pa.array(data, pa.binary()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64())],
            [f.split()[0] for f in COUNTED.split(", ")])

    return saved(batches.select("batch", "hashes", "counts")
                 .mapInArrow(spread, "bucket long, batch string, hashes binary, counts binary")
                 .groupBy("bucket").applyInArrow(total, COUNTED), "counts"), buckets


@dataclass(frozen=True)
class Vocabulary:
    """Training totals and the most frequent tokens; word i is in class i // class_words."""

    tokens: int
    distinct: int
    hashes: np.ndarray   # sorted, of the words
    words: np.ndarray    # word number of each of them
    counts: np.ndarray   # by word number, most frequent first
    smoothing: float

    @property
    def mass(self) -> float:
        return self.tokens + self.smoothing * (self.distinct + 1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, len(counts) for all other tokens."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.words[at], len(self.counts))


def vocabulary(counted: DataFrame, s: Settings) -> Vocabulary:
    """Totals and the ``words`` most frequent tokens: as many numbers reach the driver."""
    sums = counted.where("kind = 1").agg(F.sum("tokens"), F.sum("distinct_tokens")).first()

    def entries(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for data in r.column(0).to_pylist():
                top = _unpacked(data, "<i8").reshape(2, -1)
                top = top[:, top[1] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(top[0]), pa.array(top[1])], ["h", "c"])

    top = (counted.where("kind = 1").select("data").mapInArrow(entries, "h long, c long")
           .orderBy(F.desc("c"), "h").limit(s.words).toArrow())
    hashes, counts = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy().astype(np.float64)
    order = np.lexsort((hashes, -counts))  # most frequent first, whatever order the rows came in
    hashes, counts = hashes[order], counts[order]
    rank = np.argsort(hashes)
    return Vocabulary(int(sums[0] or 0), int(sums[1] or 0), hashes[rank], rank.astype(np.int64), counts, s.smoothing)


# --- the network -------------------------------------------------------------------------------

def _one_over(x: np.ndarray, top: float) -> np.ndarray:
    """top / (1 + exp(x)), in place: of -x the sigmoid (top 1), of -2x the tanh and one (top 2).

    Exponentials take a third of the time of numpy's tanh.
    """
    np.exp(x, out=x)
    x += np.float32(1)
    return np.divide(np.float32(top), x, out=x)


def _softmax_at(x: np.ndarray, column: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of ``x`` the log-softmax at one column; the exponentials, in place of ``x``, and their sums.

    ``small``: no sum of exponentials leaves the range of single precision, so rows need no shift.
    """
    if not small:
        x -= x.max(-1, keepdims=True)
    picked = x[np.arange(len(x)), column].astype(np.float64)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    return picked - np.log(total), x, total


class Network:
    """A GRU over word numbers with a class-factored softmax.

    Inputs: a word, any other token, or the start.  Output classes: blocks of words by
    frequency rank, and one class for all other tokens, inside which a token has its share of
    the smoothed counts.  So the probabilities of all possible next tokens sum to one.
    """

    def __init__(self, v: Vocabulary, s: Settings):
        self.v, self.s = v, s
        n, m, h = len(v.counts), s.class_words, s.hidden
        self.n, self.classes = n, -(-n // m)
        smooth = np.zeros(self.classes * m)
        smooth[:n] = v.counts + v.smoothing
        inside = smooth.reshape(-1, m)
        rest = max(v.mass - smooth.sum(), v.smoothing)
        self.rest = rest
        rng = np.random.default_rng(7)

        def small(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.1, shape)

        with np.errstate(divide="ignore"):
            word_bias = np.log(inside / np.maximum(inside.sum(1, keepdims=True), 1e-300))
        shapes = {
            "E": small(n + 2, h), "W": small(h, 3 * h), "U": small(h, 3 * h), "b": np.zeros(3 * h),
            "C": np.vstack([np.zeros((h, self.classes + 1)), np.log(np.append(inside.sum(1), rest) / v.mass)]),
            "B": np.zeros((self.classes, h + 1, m)),  # trained on top of the shares
        }
        # log share in the class; minus infinity past the last word
        self.word_bias = np.maximum(word_bias, -1e9).astype(np.float32)
        self.shapes = {k: a.shape for k, a in shapes.items()}
        self.flat = np.concatenate([a.ravel() for a in shapes.values()]).astype(np.float32)
        self.p = self.views(self.flat)
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that the next call of this name uses again; fresh memory costs more than the sums in it."""
        size = int(np.prod(shape))
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The named parts of a parameter vector, without copies.

        The last row of the output weights (C of classes, B of words) is their bias.
        """
        ends, h = np.cumsum([int(np.prod(shape)) for shape in self.shapes.values()]), self.s.hidden
        p = {k: a.reshape(shape) for (k, shape), a in zip(self.shapes.items(), np.split(flat, ends[:-1]))}
        return p | {"Wc": p["C"][:h], "bc": p["C"][h], "Ww": p["B"][:, :h], "bw": p["B"][:, h]}

    def vector(self) -> np.ndarray:
        return self.flat.copy()

    def load(self, flat: np.ndarray) -> Network:
        self.flat[:] = flat
        return self

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """New state from projected inputs."""
        n = self.s.hidden
        u = h @ self.p["U"]
        zr = x[:, :2 * n] + u[:, :2 * n]
        _one_over(np.negative(zr, out=zr), 1)
        c = u[:, 2 * n:] * zr[:, n:]
        c += x[:, 2 * n:]
        c *= np.float32(-2)
        _one_over(c, 2)
        c -= np.float32(1)
        out = h - c
        out *= zr[:, :n]
        out += c
        return out

    def outputs(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural-log probabilities of the targets (a word, or the class of other tokens), and
        the gradient of their negative sum with respect to the states if ``grads`` is given."""
        m, n, p = self.s.class_words, self.s.hidden, self.p
        cls = np.where(target < self.n, target // m, self.classes).astype(np.min_scalar_type(self.classes))
        order = np.argsort(cls, kind="stable")
        cls, word, size = cls[order].astype(np.int64), target[order] % m, len(target)
        h = self.room("sorted", size, n + 1)
        h[:, :n] = states[order]
        h[:, n] = 1
        cut = np.searchsorted(cls, np.arange(self.classes + 1))
        blocks = [(k, slice(cut[k], cut[k + 1])) for k in np.flatnonzero(np.diff(cut))]
        known = cut[-1]
        # shares sum to one, so these bound the logarithms of both sums
        reach = max(1.0, float(np.abs(states).max(initial=0)))
        x = np.matmul(h, p["C"], out=self.room("classes", size, self.classes + 1))
        lp, d, total = _softmax_at(x, cls, reach * np.abs(p["C"]).sum(0).max() < 60)
        x, weights = self.room("words", known, m), p["B"].copy()
        weights[:, n] += self.word_bias
        for k, own in blocks:
            np.matmul(h[own], weights[k], out=x[own])
        lw, dw, total_w = _softmax_at(x, word[:known], reach * np.abs(p["B"]).sum(1).max(initial=0) < 60)
        lp[:known] += lw
        out, back = np.empty(size), np.zeros_like(states)
        out[order] = lp
        if grads is not None:
            d *= (1 / total)[:, None]
            d[np.arange(size), cls] -= 1
            dw *= (1 / total_w)[:, None]
            dw[np.arange(known), word[:known]] -= 1
            grads["C"] += h.T @ d
            flow = np.matmul(d, p["Wc"].T, out=self.room("flow", *states.shape))
            through = self.room("through", known, n + 1)
            for k, own in blocks:
                rows = dw[own]
                grads["B"][k] += h[own].T @ rows
                np.matmul(rows, p["B"][k].T, out=through[own])
            flow[:known] += through[:, :n]
            back[order] = flow
        return out, back

    def inputs(self) -> np.ndarray:
        return self.p["E"] @ self.p["W"] + self.p["b"]

    def train(self, docs: list[np.ndarray]) -> int:
        """One pass over documents (word numbers), by Adam; returns the tokens seen.

        Every lane reads documents one after the other, each from the zero state to its last
        token; the state is carried from window to window, and gradients stop at the window's
        start.  The longest documents are dealt first, so the lanes end at about the same time; a
        window with fewer live tokens moves the parameters by as much less.
        """
        s = self.s
        docs = sorted((d for d in docs if len(d)), key=len, reverse=True)
        if not docs:
            return 0
        lanes: list[list[np.ndarray]] = [[] for _ in range(min(s.lanes, len(docs)))]
        ends = [(0, i) for i in range(len(lanes))]
        for d in docs:
            size, i = heapq.heappop(ends)
            lanes[i].append(d)
            heapq.heappush(ends, (size + len(d), i))
        lanes.sort(key=lambda lane: -sum(map(len, lane)))
        rng = np.random.default_rng(11)
        lanes = [[lane[i] for i in rng.permutation(len(lane))] for lane in lanes]
        targets = np.concatenate([d for lane in lanes for d in lane])
        lengths = np.array([sum(map(len, lane)) for lane in lanes])
        starts = np.cumsum(lengths) - lengths
        fresh = np.zeros(len(targets), bool)  # first tokens of documents
        fresh[np.cumsum([0, *(len(d) for lane in lanes for d in lane)])[:-1]] = True
        before = np.where(fresh, self.n + 1, np.roll(targets, 1))

        first, second, g, change = (np.zeros_like(self.flat) for _ in range(4))
        grads = self.views(g)
        h = np.zeros((len(lanes), s.hidden), np.float32)
        updates = 0
        for t0 in range(0, int(lengths[0]), s.window):
            active = int((lengths > t0).sum())
            at = np.arange(t0, min(t0 + s.window, int(lengths[0])))[:, None]
            live = at < lengths[:active]
            at = np.where(live, at, 0) + starts[:active]
            g[:] = 0
            h = self._window(before[at], targets[at], live, ~fresh[at], h[:active], grads)
            seen, updates = int(live.sum()), updates + 1
            norm = float(np.sqrt(g @ g)) / seen
            scale = min(1.0, 5.0 / (norm + 1e-12)) / seen
            np.multiply(g, np.float32(0.1 * scale), out=change)
            first *= np.float32(0.9)
            first += change
            g *= g
            g *= np.float32(0.01 * scale * scale)
            second *= np.float32(0.99)
            second += g
            correction = (1 - 0.99 ** updates) ** 0.5
            np.sqrt(second, out=g)
            g += np.float32(1e-6 * correction)
            np.divide(first, g, out=g)
            g *= np.float32(s.rate * correction / (1 - 0.9 ** updates) * seen / (len(lanes) * s.window))
            self.flat -= g
        return len(targets)

    def _window(self, x: np.ndarray, target: np.ndarray, live: np.ndarray, carried: np.ndarray, h: np.ndarray,
                grads: dict) -> np.ndarray:
        """Adds the gradients of one window (steps x lanes) to ``grads``; returns the last states.

        Positions not ``live`` lie past a lane's end; where not ``carried`` a document starts.
        """
        p, n, (steps, lanes) = self.p, self.s.hidden, x.shape
        inputs = np.take(p["E"], x.ravel(), 0, self.room("inputs", x.size, n), "clip")
        projected = np.matmul(inputs, p["W"], out=self.room("projected", x.size, 3 * n))
        projected += p["b"]
        # a lane a column: the gates of all lanes lie together; scaled as _one_over takes them
        across, u = self.room("across", 2, steps, 3 * n, lanes)
        across[:] = projected.reshape(steps, lanes, 3 * n).transpose(0, 2, 1)
        scale = np.repeat(np.float32([-1, -2]), [2 * n, n])[:, None]
        across *= scale
        turn = p["U"].T * scale
        zr = self.room("gates", steps, 2 * n, lanes)
        states, before, c = self.room("kept", 3, steps, n, lanes)
        z, r, un = zr[:, :n], zr[:, n:], u[:, 2 * n:]
        whole, carried = carried.all(1).tolist(), carried.astype(np.float32)
        h, one = h.T, np.float32(1)
        for t in range(steps):
            start, gates, cand, new = before[t], zr[t], c[t], states[t]
            np.multiply(h, carried[t], out=start)
            np.matmul(turn, start, out=u[t])
            np.add(u[t, :2 * n], across[t, :2 * n], out=gates)
            _one_over(gates, 1)
            np.multiply(gates[n:], un[t], out=cand)
            cand += across[t, 2 * n:]
            _one_over(cand, 2)
            cand -= one
            np.subtract(start, cand, out=new)
            new *= gates[:n]
            new += cand
            h = new
        last, own = h.T.copy(), slice(None) if live.all() else live.ravel()
        rows = self.room("rows", steps, lanes, n)
        rows[:] = states.transpose(0, 2, 1)
        back = self.outputs(rows.reshape(-1, n)[own], target.ravel()[own], grads)[1]
        rows[:] = 0
        rows.reshape(-1, n)[own] = back
        flow, to_z, to_r, to_c, spare = self.room("slopes", 5, steps, n, lanes)
        flow[:] = rows.transpose(0, 2, 1)
        # slopes of the gates' inputs: by the new state for z and c, by c's own slope for r
        np.subtract(before, c, out=to_z)
        to_z *= z
        np.subtract(1, z, out=spare)
        to_z *= spare
        np.multiply(c, c, out=to_c)
        np.subtract(1, to_c, out=to_c)
        to_c *= spare
        np.subtract(1, r, out=to_r)
        to_r *= r
        to_r *= un
        to_r *= np.float32(-0.5)
        dh = np.zeros((n, lanes), np.float32)
        d = self.room("gate slopes", steps, 4 * n, lanes)  # of z, r, the state's part of c, c
        for t in range(steps - 1, -1, -1):
            at = d[t]
            dc = at[3 * n:]
            dh += flow[t]
            np.multiply(dh, to_z[t], out=at[:n])
            np.multiply(dh, to_c[t], out=dc)
            np.multiply(dc, to_r[t], out=at[n:2 * n])
            np.multiply(dc, r[t], out=at[2 * n:3 * n])
            dh *= z[t]
            dh += p["U"] @ at[:3 * n]
            if not whole[t]:
                dh *= carried[t]
        grads["U"] += np.matmul(before, d[:, :3 * n].transpose(0, 2, 1)).sum(0)
        dx = projected.reshape(steps, lanes, 3 * n)
        dx[:, :, :2 * n] = d[:, :2 * n].transpose(0, 2, 1)
        dx[:, :, 2 * n:] = d[:, 3 * n:].transpose(0, 2, 1)
        grads["b"] += np.ones(x.size, np.float32) @ projected
        grads["W"] += inputs.T @ projected
        by_place = np.matmul(projected, p["W"].T, out=inputs)
        used = x.ravel()
        order = np.argsort(used)
        used = used[order]
        cut = np.flatnonzero(np.diff(used, prepend=-1))
        grads["E"][used[cut]] += np.add.reduceat(by_place[order], cut)
        return last

    def score(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per document the natural-log probability of its tokens, other tokens as their class.

        All documents of the batch advance together, the longest last; the state runs through
        the whole document.
        """
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        total = np.zeros(len(lengths))
        table = self.inputs()
        h = np.zeros((len(lengths), self.s.hidden), np.float32)
        x = np.full(len(lengths), self.n + 1)
        held, targets, owners, pending = [], [], [], 0
        live = len(sizes)
        for t in range(int(sizes.max(initial=0))):
            while sizes[live - 1] <= t:
                live -= 1
            h = self.step(table[x[:live]], h[:live])
            x = words[starts[:live] + t]
            held.append(h)
            targets.append(x)
            owners.append(live)
            pending += live
            if pending >= 32768 or t + 1 == sizes[0]:
                lp, _ = self.outputs(np.concatenate(held), np.concatenate(targets))
                at = 0
                for n in owners:
                    total[:n] += lp[at:at + n]
                    at += n
                held, targets, owners, pending = [], [], [], 0
        out = np.empty(len(lengths))
        out[order] = total
        return out


def _documents(words: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(words, np.cumsum(lengths)[:-1])


def fit(batches: DataFrame, v: Vocabulary, s: Settings) -> np.ndarray:
    """Parameters averaged over all batches, ``rounds`` times and once for every hash class at least.

    Every round each batch trains from the last averages on its own training documents of
    that round's hash class; the averages, weighted by tokens, are added up per task and then
    in two more steps, so one vector at a time is in memory anywhere.
    """
    sc = batches.sparkSession.sparkContext
    flat = Network(v, s).vector()
    share = s.train_share

    def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0.0
        for r in rows:
            for vector, w in zip(*(c.to_pylist() for c in r.columns)):
                vector = np.frombuffer(vector, np.float64)
                total, weight = vector if total is None else total + vector, weight + w
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight])],
                                             ["vector", "weight"])

    for turn in range(max(s.rounds, s.train_share)):
        shipped = sc.broadcast(flat)

        def local(rows: Iterator[pa.RecordBatch], shipped=shipped, turn=turn) -> Iterator[pa.RecordBatch]:
            total, weight = np.zeros(len(shipped.value)), 0.0
            for r in rows_at_a_time(rows, 1):
                row = r.to_pylist()[0]
                words = v.numbers(_unpacked(row["hashes"], "<u8"))[_unpacked(row["tokens"], "<u4")]
                docs = _documents(words, _unpacked(row["lengths"], "<i8"))
                own = [d for d, i, out in zip(docs, row["doc_ids"], row["held_out"])
                       if not out and zlib.crc32(b"%d" % i) // s.held_out % share == turn % share]
                net = Network(v, s).load(shipped.value)
                seen = net.train(own)
                total += net.vector().astype(np.float64) * seen
                weight += seen
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight])],
                                                 ["vector", "weight"])

        kind = "vector binary, weight double"
        parts = batches.select("doc_ids", "held_out", "lengths", "tokens", "hashes").mapInArrow(local, kind)
        parts = parts.repartition(16).mapInArrow(summed, kind).repartition(1).mapInArrow(summed, kind)
        got = parts.first()
        if got is not None:
            flat = (np.frombuffer(got["vector"], np.float64) / got["weight"]).astype(np.float32)
    return flat


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Score every row of ``docs``; learn from those whose crc32(doc_id as text) mod 10 is not 0.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that training
    holds), train_tokens, base_score (smoothed unigram) and score (the network), both log10.
    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A null text is empty: its one
    token is the end.  A null doc_id is held out; repeated rows count and score as often as
    they occur; other columns are ignored; an empty table gives an empty result.  With no
    training row every token has the probability of an unseen one.
    Tokens are told apart by 64-bit hashes.
    """
    s = settings
    batches = token_batches(docs, s)
    counted, buckets = corpus_counts(batches, s)
    v = vocabulary(counted, s)
    flat = fit(batches, v, s)
    shipped = docs.sparkSession.sparkContext.broadcast((v, flat))
    back = (counted.where("kind = 0").groupBy("batch")
            .agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias("parts")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = shipped.value
        net = Network(v, s).load(flat)
        for r in rows_at_a_time(rows, 1):
            row = r.to_pylist()[0]
            hashes, tokens = _unpacked(row["hashes"], "<u8"), _unpacked(row["tokens"], "<u4")
            lengths = _unpacked(row["lengths"], "<i8")
            counts = np.empty(len(hashes))
            counts[_by_bucket(hashes, buckets)[1]] = np.concatenate([_unpacked(p["data"], "<i8") for p in row["parts"]])
            words = v.numbers(hashes)
            base = np.log((counts + v.smoothing) / v.mass)
            # other tokens: their share of the class on top of the network's class probability
            inside = np.where(words == net.n, np.log((counts + v.smoothing) / net.rest), 0.0)
            starts = np.cumsum(lengths) - lengths
            n = len(lengths)
            scores = net.score(words[tokens], lengths) + np.add.reduceat(inside[tokens], starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(lengths),
                 pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts)),
                 pa.array(np.full(n, v.tokens)), pa.array(np.add.reduceat(base[tokens], starts) / LOG10),
                 pa.array(scores / LOG10)], [f.split()[0] for f in SCORED.split(", ")])

    return (batches.select("batch", "doc_ids", "held_out", "lengths", "tokens", "hashes")
            .join(back, "batch").drop("batch").mapInArrow(run, SCORED))
