"""Operator 12: fill-in-the-middle transformation with piece tables.

A document is a list of descriptors (buffer, start, end) over two immutable buffers: its text and the
sentinels.  Cutting splits a descriptor, an arrangement is a permutation of them with sentinels in
between, and nothing is copied until the bytes are written or hashed, descriptor by descriptor.
The inverse works on the output alone: its sentinels are found and dropped, and the
inverse permutation puts the pieces back.

Defined cases: a null text is empty; an empty text is ``plain``, as is one that holds a sentinel (so
that sentinels of an output can only be its own) and the share left untouched.  A null id hashes as an
empty string.  Rows are independent: repeated rows give repeated results, an empty table none.
Very long texts cost their own length, in pieces of ``HASH_CHUNK`` characters.  Columns other than
the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sentinels in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters that are encoded at once when a piece is hashed or written.
HASH_CHUNK = 1 << 16
#: Rows of an Arrow batch that one step works on.
ROWS = 256

# Order of the parts (0 prefix, 1 middle, 2 suffix) in each form, with the sentinel in front of each.
FORMS = {
    "psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)),
    "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE)),
}


@dataclass(frozen=True)
class Piece:
    """Characters ``start`` to ``end`` of a buffer that is never changed."""

    buffer: str = field(repr=False)
    start: int
    end: int

    def __len__(self) -> int:
        return self.end - self.start

    def split(self, at: int) -> tuple[Piece, Piece]:
        """Two pieces, cut ``at`` characters into this one."""
        return Piece(self.buffer, self.start, self.start + at), Piece(self.buffer, self.start + at, self.end)


def whole(buffer: str) -> Piece:
    return Piece(buffer, 0, len(buffer))


class PieceTable:
    """A document as an ordered list of pieces."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces

    @classmethod
    def of(cls, text: str) -> PieceTable:
        return cls([whole(text)])

    def __len__(self) -> int:
        return sum(map(len, self.pieces))

    def cut(self, *places: int) -> PieceTable:
        """Split so that a piece starts at every place (ascending, repeats give empty pieces)."""
        done, rest, before = [], list(self.pieces), 0
        for place in places:
            while rest and before + len(rest[0]) < place:
                before += len(rest[0])
                done.append(rest.pop(0))
            head, tail = rest.pop(0).split(place - before)
            done.append(head)
            rest.insert(0, tail)
            before = place
        return PieceTable(done + rest)

    def arrange(self, form: str) -> PieceTable:
        """The three pieces in the order of the form, each behind its sentinel."""
        out = []
        for part, sentinel in FORMS[form]:
            out += [whole(sentinel), self.pieces[part]]
        return PieceTable(out)

    def rearranged(self, form: str) -> PieceTable:
        """The inverse: sentinels dropped, pieces in the order of the text."""
        parts = self.pieces[1::2]
        back = sorted(range(len(parts)), key=lambda i: FORMS[form][i][0])
        return PieceTable([parts[i] for i in back])

    def encoded(self) -> Iterator[bytes]:
        """The UTF-8 bytes, streamed by descriptor."""
        for p in self.pieces:
            for at in range(p.start, p.end, HASH_CHUNK):
                yield p.buffer[at:min(at + HASH_CHUNK, p.end)].encode()

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.encoded():
            h.update(part)
        return h.hexdigest()

    def text(self) -> str:
        return "".join(p.buffer[p.start:p.end] for p in self.pieces)


def from_output(output: str, form: str) -> PieceTable:
    """The table of an output: a piece for each sentinel and each part between them.

    The parts hold no sentinel, and none can arise across a border, as a sentinel's first
    character occurs nowhere else in it; so the first occurrence is the sentinel itself.
    """
    places, at = [], 0
    for _, sentinel in FORMS[form]:
        at = output.index(sentinel, at)
        places += [at, at + len(sentinel)]
        at += len(sentinel)
    return PieceTable(PieceTable.of(output).cut(*places).pieces[1:])


def restore(output: str, form: str) -> PieceTable:
    """The original text's table, from output and form alone."""
    return PieceTable.of(output) if form == "plain" else from_output(output, form).rearranged(form)


def draws(doc_id, salt: str = "1") -> list[int]:
    """The first four 8-digit groups of the hash of salt and id, as integers."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id, text: str | None, fim_rate: int = 90, spm_rate: int = 20, salt: str = "1") -> tuple[PieceTable, str, int | None, int | None]:
    """(output, form, prefix length, middle length) of one document; rates are per cent."""
    text = text or ""
    table = PieceTable.of(text)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return table, "plain", None, None
    h1, h2, h3, h4 = draws(doc_id, salt)
    if h3 % 100 >= fim_rate:
        return table, "plain", None, None
    form = "spm" if h4 % 100 < spm_rate else "psm"
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return table.cut(a, b).arrange(form), form, a, b - a


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_rate: int = 90,
                   spm_rate: int = 20, salt: str = "1", digests_only: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256) of every row.

    One pass over the rows without a shuffle.  ``restored_sha256`` is taken from the text
    rebuilt from output and form.  ``digests_only`` leaves out the output text itself.
    """
    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, "
              "output_sha256 string, restored_sha256 string")
    if digests_only:
        schema = schema.replace("output string, ", "", 1)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                step = batch.slice(start, ROWS)
                rows = []
                for doc_id, text in zip(step.column(0).to_pylist(), step.column(1).to_pylist()):
                    table, form, prefix, middle = transform(doc_id, text, fim_rate, spm_rate, salt)
                    output = table.text()
                    rows.append((doc_id, len(text or ""), form, prefix, middle, output, table.sha256(),
                                 restore(output, form).sha256()))
                got = {c: pa.array(v, t) for c, v, t in zip(cols, zip(*rows), kinds)}
                if digests_only:
                    del got["output"]
                yield pa.RecordBatch.from_pydict(got)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


#: The query's rows in DuckDB.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
           OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, t, n, form, least(c1, c2) AS a, greatest(c1, c2) AS b, substr(t, 1, least(c1, c2)) AS pre,
    substr(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS mid, substr(t, greatest(c1, c2) + 1) AS suf FROM g)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
