"""Token counts by finite-state transducers compiled from a BPE piece table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK = 1 << 16  # characters a state map covers
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Pieces:
    """The normal pieces of a BPE model with their scores, and the merge rule on short strings."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.open = {p[:i] for p in scores for i in range(len(p))}  # texts that grow into some piece
        self._pairs: dict[tuple[str | None, str], bool] = {}

    @staticmethod
    def from_model(path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        return Pieces({model.id_to_piece(i): model.get_score(i) for i in ids
                       if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: str | None, piece: str) -> bool:
        """Whether ``piece`` can stand after ``before`` (None: at the start) in a merged text."""
        known = self._pairs.get((before, piece))
        if known is None:
            parts = self.merge((before or "") + piece)
            known = parts[-1] == piece and len(parts) == (2 if before else 1)
            self._pairs[before, piece] = known
        return known

    def tokens(self, piece: str) -> int:
        """Tokens a final piece gives: one, or one per byte of an unknown character."""
        return 1 if piece in self.scores else len(piece.encode("utf-8", "surrogatepass"))


class Transducer:
    """Deterministic character transducer whose transitions carry token-count changes.

    A text's merged form is the one sequence of pieces in which every neighbouring pair is
    itself a merged form, so its last piece depends only on the last pieces of its shorter
    prefixes.  A state holds, for each position at which a piece may still be open, the last
    piece before it and its count relative to now; the open positions are those from which the
    text so far is a prefix of some piece.  Pieces have bounded length, so the states are
    finite; they are determinised as texts reach them, and shared by all texts.
    """

    KEEP_STATES = 400_000

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.start = self._state(("", ((None, 0),)))

    def _state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return found

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        open_text, history = self.states[state]
        text = open_text + char
        for size in range(len(text), 0, -1):  # exactly one last piece fits
            piece = text[-size:]
            if size == 1 or piece in self.pieces.scores:
                before, count = history[len(text) - size]
                if self.pieces.follows(before, piece):
                    break
        count += self.pieces.tokens(piece)
        history += ((piece, count),)
        size, grows = len(text), self.pieces.open
        left = [i for i in range(size) if text[i:] in grows]
        skip = left[0] if left else size
        history = tuple([(history[i][0], history[i][1] - count) if i in left else None
                         for i in range(skip, size)] + [(piece, 0)])
        move = self.moves[state][char] = self._state((text[skip:], history)), count
        return move

    def run(self, text: str, state: int) -> tuple[int, int]:
        """(state reached, tokens added) from ``state``."""
        total, moves = 0, self.moves
        for char in text:
            move = moves[state].get(char)
            if move is None:
                move = self._compile(state, char)
            state, added = move
            total += added
        return state, total


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to every entry state.

    ``head`` is its text up to the first reset (a space after a non-space, where no piece can
    span); from there on nothing depends on the entry: ``count`` tokens are closed and the
    transducer stands at ``exit``.  Without a reset, ``exit`` is None and the chunk is all head.
    """

    head: str
    count: int = 0
    exit: int | None = None


class Counter:
    """Counts the tokens of texts; counts of units between resets are kept and reused."""

    KEEP, LONGEST = 400_000, 40

    def __init__(self, pieces: Pieces):
        self.machine = Transducer(pieces)
        self.units: dict[str, int] = {}
        self.words = _Words(self)

    def unit(self, unit: str) -> int:
        """Tokens of a text without an inner reset, run from the start state."""
        got = self.units.get(unit)
        if got is None:
            if len(self.machine.states) > Transducer.KEEP_STATES:
                self.machine.clear()
            got = self.machine.run(unit, self.machine.start)[1]
            if len(unit) <= self.LONGEST:
                if len(self.units) >= self.KEEP:
                    self.units.clear()
                self.units[unit] = got
        return got

    def chunk(self, text: str) -> ChunkMap:
        """The state map of a piece of a longer text."""
        units = _UNIT.findall(text)
        # the first unit joins what came before; a leading space resets only after a non-space,
        # which the composition knows, so it stays in the head
        if len(units) < 2:
            return ChunkMap(text)
        exit_state, tail = self.machine.run(units[-1], self.machine.start)
        return ChunkMap(units[0], sum(map(self.unit, units[1:-1])) + tail, exit_state)

    def compose(self, first: ChunkMap, second: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks; associative, so any grouping gives the same."""
        if first.exit is None:
            joined = self.chunk(first.head + second.head)
            if second.exit is None:
                return joined
            if joined.exit is None:
                return ChunkMap(joined.head, second.count, second.exit)
            return ChunkMap(joined.head, joined.count + second.count, second.exit)
        state, count = first.exit, first.count
        for unit in _UNIT.findall(second.head):
            if unit[0] == SPACE and not self._in_spaces(state):
                state = self.machine.start
            state, added = self.machine.run(unit, state)
            count += added
        if second.exit is None:
            return ChunkMap(first.head, count, state)
        return ChunkMap(first.head, count + second.count, second.exit)

    def _in_spaces(self, state: int) -> bool:
        last = self.machine.states[state][1][-1][0]
        return last is None or last[-1] == SPACE

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Reduce neighbouring maps pairwise, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str) -> int:
        """Tokens of a whole text, with the space the model puts before it."""
        if not text:
            return 0
        if len(text) <= CHUNK:
            spaced = text.replace(SPACE, " ")
            if "  " not in spaced and spaced[0] != " ":
                return sum(map(self.words.__getitem__, spaced.split(" ")))
            return sum(map(self.unit, _UNIT.findall(SPACE + text.replace(" ", SPACE))))
        if len(self.machine.states) > Transducer.KEEP_STATES:
            self.machine.clear()
        marked = SPACE + text.replace(" ", SPACE)
        whole = self.scan([self.chunk(marked[i:i + CHUNK]) for i in range(0, len(marked), CHUNK)])
        return sum(map(self.unit, _UNIT.findall(whole.head))) + whole.count


class _Words(dict):
    """Word -> tokens of a space and the word."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        got = self.counter.unit(SPACE + word)
        if len(word) <= Counter.LONGEST:
            if len(self) >= Counter.KEEP:
                self.clear()
            self[word] = got
        return got


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(Pieces.from_model(path))


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    The counts are those of the model file at ``path`` without begin, end or added tokens.  Whole
    texts are read; a null text is empty (0 tokens); repeated rows and null ids give rows of
    their own; other columns are ignored; an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array([count(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                 pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
