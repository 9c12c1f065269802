"""ZIP-packaged archives and piecewise-hash fingerprints."""

import base64
import gzip
import hashlib
import io
import struct
import zipfile
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from poi_analytics.llm import archives, ctph
from poi_analytics.llm.queries import QUERIES

from .cases import awkward, awkward_rows, empty, prose

PAGES = "page_id long, url string, html string, digest string, revisit int, first string"


def digest(html) -> str:
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def want(rows, at_least=0):
    out = Counter()
    for i, _, html in rows:
        same = [r[0] for r in rows if (r[2] or "") == (html or "")]
        first = min((2**63 - 1 if x is None else x) for x in same)
        revisit = (2**63 - 1 if i is None else i) > first and len((html or "").encode()) >= at_least
        out[i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def result(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.mark.parametrize("at_least, size", [(0, 64 << 20), (5, 600)])
def test_round_trip_of_awkward_pages(spark, at_least, size):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""),
            (5, "u", "é\r\n\r\nWARC/1.1"), (5, "u", "é\r\n\r\nWARC/1.1"), (None, "n", "<p>x</p>"), (None, "n", "only"),
            (6, "long", "ab" * 300_000), (7, "long", "ab" * 300_000), (0, "z", "é\r\n\r\nWARC/1.1"), (8, "short", "abc"),
            (9, "short", "abc")]
    pages = spark.createDataFrame([(*r, "d", 1, "f") for r in rows], PAGES)
    assert result(archives.round_trip(pages, at_least, size)) == want(rows, at_least)


def test_whole_pages_table(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert result(QUERIES["op1_warc_archives"](spark, sf_dir)) == want(rows)


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "v", "one"), (3, "w", "é")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    manifest = archives.write_archives(archives.plan_revisits(pages), folder)
    got = {r.page_id: r.payload for r in archives.read_archives(spark, manifest, folder).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {1: b"one", 2: None, 3: "é".encode()}


def test_no_pages(spark):
    assert archives.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def reader(data: bytes, log=None):
    def read_at(at: int, n: int) -> bytes:
        assert at >= 0
        if log is not None:
            log.append((at, n))
        return data[at:at + n]
    return read_at


def archive(records, index=True, comment=b"") -> bytes:
    out = io.BytesIO()
    w = archives.ArchiveWriter(out)
    for i, payload in records:
        w.add(i, "u", archives.warc_record(i, "u", payload, None, False))
    if not index:
        w.data.close()
        w.zip.comment = comment
        w.zip.close()
    else:
        w.zip.comment = comment
        w.close()
    return out.getvalue()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.booleans(), st.sampled_from([b"", b"note PK\x05\x06 note"]))
def test_archives_with_and_without_index(payloads, index, comment):
    data = archive(list(enumerate(payloads)), index, comment)
    got = list(archives.read_archive(reader(data), len(data)))
    assert [(r["page_id"], r["payload"]) for r in got] == list(enumerate(payloads))


def test_only_ranges_are_read():
    data = archive([(i, bytes([i]) * 50_000 + prose(i, 3000).encode()) for i in range(30)])
    log = []
    directory = archives.ZipDirectory(reader(data, log), len(data))
    first = next(archives.record_ranges(directory))
    assert sum(n for _, n in log) < 80_000 < len(data)
    assert gzip.decompress(data[first[0]:first[0] + first[1]]).startswith(b"WARC/1.1")


def zip64(name=b"archive/x", body=b"hello") -> bytes:
    """A file whose directory counts, sizes and offsets are all in ZIP64 fields."""
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(body),
                        2**32 - 1, 2**32 - 1, len(name), 20)
    local += name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHH", 9, 2, 7) + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0x800, 0, 0, 0, zlib.crc32(body), 2**32 - 1, 2**32 - 1,
                          len(name), len(extra), 0, 0, 0, 0, 2**32 - 1) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    at = len(local) + len(central)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 0)
    return local + central + end64 + locator + end


def test_zip64_directories():
    data = zip64()
    directory = archives.ZipDirectory(reader(data), len(data))
    assert directory.read(directory.members["archive/x"]) == b"hello"
    assert zipfile.ZipFile(io.BytesIO(data)).read("archive/x") == b"hello"


def test_damage_is_an_error():
    data = bytearray(archive([(1, b"payload " * 50)], index=False))
    with pytest.raises(ValueError):
        archives.ZipDirectory(reader(bytes(data[:40])), 40)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(archives.DATA, b"x" * 500)
    with pytest.raises(ValueError):
        list(archives.read_archive(reader(out.getvalue()), len(out.getvalue())))
    record = archives.warc_record(1, "u", b"one", None, False)
    broken = gzip.compress(gzip.decompress(record).replace(b"one", b"two"))
    with pytest.raises(ValueError):
        archives.parse_record(broken)


# --- fingerprints

def test_neighbours_of_awkward_rows(spark):
    got = ctph.compare_neighbours(awkward(spark), parts=4).collect()
    rows = [(2**63 - 1 if r[0] is None else r[0], r[1] or "") for r in awkward_rows()]
    assert len(got) == len(rows)
    unique = {i: t for i, t in rows if [x[0] for x in rows].count(i) == 1}
    ids = sorted({i for i, _ in rows}, reverse=True)
    found = {r.doc_id: r for r in got}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        if a in unique and b in unique:
            new = ctph.edited(unique[a], unique[b])
            assert found[a].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert found[a].fingerprint == ctph.fingerprint(unique[a].encode())
            assert found[a].edited_fingerprint == ctph.fingerprint(new.encode())
            near = ctph.likeness([(found[a].fingerprint, found[a].edited_fingerprint),
                                  (found[a].fingerprint, ctph.fingerprint(unique[b].encode()))])
            assert [found[a].near_edited, found[a].near_next] == list(near)
    assert ctph.compare_neighbours(empty(spark)).collect() == []


def test_one_row_is_its_own_neighbour(spark):
    got = ctph.compare_neighbours(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in got] == [(6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]


def test_neighbours_of_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    for r in QUERIES["op3_fuzzy_fingerprints"](spark, sf_dir).collect():
        new = ctph.edited(texts[r.doc_id], texts[after[r.doc_id]])
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(texts[r.doc_id])


def test_likeness_tells_edits_from_strangers():
    texts = [prose(i, 400).encode() for i in range(60)]
    edits = [t[:700] + b" inserted words here " + t[720:] for t in texts]
    prints, changed = ([ctph.fingerprint(t) for t in x] for x in (texts, edits))
    assert min(ctph.likeness(list(zip(prints, changed)))) > 0.7
    assert max(ctph.likeness(list(zip(prints, prints[1:])))) < 0.4


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y else 2)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("ABCD", min_size=1, max_size=64), st.text("ABCD", min_size=1, max_size=64))
def test_edit_likeness(a, b):
    runs = max((n for n in range(1, 65) if any(a[i:i + n] in b for i in range(len(a) - n + 1))), default=0)
    want = 1 - edit_distance(a, b) / (len(a) + len(b)) if runs >= min(7, (min(len(a), len(b)) + 1) // 2) else 0
    assert ctph._edit_likeness([(a, b)])[0] == pytest.approx(want)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_prints_are_well_formed(data):
    block, fine, coarse = ctph.fingerprint(data).split(":")
    assert int(block) % 3 == 0 and len(fine) <= 64 and len(coarse) <= 32
    assert (len(fine) > 0) == (len(data) > 0)
    assert ctph.fingerprint(data) == ctph.fingerprint(bytes(data))
