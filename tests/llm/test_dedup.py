"""Substring, suffix-array and SimHash deduplication against brute force."""

import hashlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poi_analytics.llm import fm_index, repeats, simhash, suffix_array
from poi_analytics.llm.components import components
from poi_analytics.llm.queries import QUERIES

from .cases import awkward, awkward_rows, empty, words_of

NO_ID = 2**63 - 1


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def brute_words(rows):
    first = {}
    for i, text in rows:
        w = words_of(text)
        for a in range(len(w) - 49):
            k = tuple(w[a:a + 50])
            first[k] = min(first.get(k, NO_ID), NO_ID if i is None else i)
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if first[tuple(w[a:a + 50])] < (NO_ID if i is None else i):
                gone[a:a + 50] = [True] * 50
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return Counter(out)


def brute_bytes(rows):
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        count.update(b[a:a + 200] for a in range(len(b) - 199))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for a in range(len(b) - 199):
            if count[b[a:a + 200]] > 1:
                gone[a + 1:a + 201] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone[1:-1]].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, sha(kept)))
    return Counter(out)


@pytest.mark.parametrize("change, block", [({}, 1 << 18), ({"hot": 2, "shard_symbols": 300}, 700), ({"halvings": 0}, 1 << 18)])
def test_words_match_brute_force(spark, monkeypatch, change, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    got = fm_index.digest(fm_index.remove_repeats(awkward(spark), replace(fm_index.SEARCH, **change))).collect()
    assert Counter(map(tuple, got)) == brute_words([r[:2] for r in awkward_rows()])


@pytest.mark.parametrize("change, block", [({}, 1 << 18), ({"hot": 2, "shard_symbols": 900, "halvings": 1}, 1500)])
def test_bytes_match_brute_force(spark, monkeypatch, change, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    got = suffix_array.digest(suffix_array.remove_repeats(awkward(spark), replace(suffix_array.SEARCH, **change))).collect()
    assert Counter(map(tuple, got)) == brute_bytes([r[:2] for r in awkward_rows()])


def test_common_passage_in_many_contexts(spark):
    """A passage shorter than the window in every document, each in its own surroundings, and one of 60 words."""
    short, full = " ".join(f"s{i}" for i in range(40)), " ".join(f"f{i}" for i in range(60))
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(60)) + f" {short} " + " ".join(f"b{i}x{j}" for j in range(60))
             + (f" {full} " if i % 3 == 0 else " ") + " ".join(f"c{i}x{j}" for j in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = replace(fm_index.SEARCH, hot=4, shard_symbols=2000)
    got = Counter(map(tuple, fm_index.digest(fm_index.remove_repeats(docs, small)).collect()))
    assert got == brute_words(rows)
    assert sorted(r[2] for r in got)[-13:] == [60] * 13
    small = replace(suffix_array.SEARCH, hot=4, shard_symbols=9000)
    assert Counter(map(tuple, suffix_array.digest(suffix_array.remove_repeats(docs, small)).collect())) == brute_bytes(rows)


def test_whole_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op2_substring_dedup"](spark, sf_dir).collect())) == brute_words(rows)
    assert Counter(map(tuple, QUERIES["op9_suffix_array_dedup"](spark, sf_dir).collect())) == brute_bytes(rows)


def test_empty_tables(spark):
    assert fm_index.remove_repeats(empty(spark)).collect() == []
    assert suffix_array.remove_repeats(empty(spark)).collect() == []
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.one_of_each(empty(spark)).collect() == []


def sorted_suffixes(text):
    zeros = np.cumsum(text == 0) - 1

    def key(i):
        stop = i + int(np.flatnonzero(text[i:] == 0)[0])
        return [(1, int(x)) for x in text[i:stop]] + [(0, int(zeros[stop]))]

    order = sorted(range(len(text)), key=key)
    shared = [0]
    for a, b in zip(order, order[1:]):
        x, y = key(a), key(b)
        same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        shared.append(min(same, suffix_array.CAP))
    return order, shared


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=40), min_size=1, max_size=6), st.sampled_from([3, 50, 10**6]))
def test_induced_sorting(segments, limit):
    text = np.array([x for s in segments for x in [*s, 0]], np.int32)
    marks = np.array([0, 11400714819323198485, 14029467366897019727, 1609587929392839161], np.uint64)[text]
    order, lcp = suffix_array.suffix_array(text, repeats.RangeHash(marks), limit=limit, few=0)
    assert (order.tolist(), lcp.tolist()) == sorted_suffixes(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_wavelet_ranks(symbols):
    a = np.array(symbols)
    tree = fm_index.WaveletMatrix(a, 10)
    for c in range(10):
        stops = np.arange(len(a) + 1)
        assert (tree.rank(np.full(len(stops), c), stops) == np.concatenate([[0], np.cumsum(a == c)])).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=5),
       st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_foreign_text_streams_through_the_index(segments, text):
    """A text the index does not hold: windows of four symbols that any segment holds."""
    index = fm_index.FmIndex([np.array(s, np.uint64) for s in segments], np.zeros(len(segments), np.int64), 4)
    ids = index.ids(np.array(text, np.uint64))
    found = index.matches(ids, np.array([0]), np.array([len(text)]), np.array([1]))
    have = {tuple(s[i:i + 4]) for s in segments for i in range(len(s) - 3)}
    assert found.tolist() == [tuple(text[i:i + 4]) in have and i + 4 <= len(text) for i in range(len(text))]


def brute_simhash(text):
    w = [x.lower() for x in words_of(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rows = [r[:2] for r in awkward_rows()]
    fps = [brute_simhash(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    root = {k: min((NO_ID if i is None else i) for (i, _), x in zip(rows, label) if x == k) for k in set(label)}
    want = Counter((i, f, None if root[k] == NO_ID else root[k]) for (i, _), f, k in zip(rows, fps, label))
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash.one_of_each(awkward(spark)).collect()
    assert len(kept) == len(set(label))
    assert {r.doc_id for r in kept} == {None if v == NO_ID else v for v in root.values()}


@pytest.mark.parametrize("tile", [3, 64])
def test_tiles_lose_no_link(spark, tile):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 60, np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base[:40] for i, j in r.integers(0, 64, (5, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), base[:3] + np.arange(3, dtype=np.uint64)]))
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = components(simhash.links(table, 2, tile)).collect()
    label = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    for _ in range(30):
        np.minimum.at(label, i, label[j])
    groups = {}
    for f, k in zip(fps.view(np.int64).tolist(), label.tolist()):
        groups.setdefault(k, set()).add(f)
    found = {}
    for r in got:
        found.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("together", [4, 64])
def test_one_large_cell_is_many_tasks(spark, monkeypatch, together):
    """Fingerprints whose four parts have eight bits each lie in one cell, here in some 50 pieces."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    r = np.random.default_rng(2)
    base = {int("".join(map(str, np.concatenate([r.permutation([0, 1] * 8) for _ in range(4)]))), 2) for _ in range(60)}
    fps = set(base)
    for b in base:  # swaps of neighbouring differing bits of one part stay in the cell, two bits away
        for i in range(15):
            if b >> i & 3 in (1, 2):
                fps.add(b ^ 3 << i)
    fps = sorted(fps)[:400]
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        links = simhash.links(table, 2, 8)
        got = {r.node: r.component for r in components(links).collect()}
        spread = links.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set(setting, before)
    assert spread > 1
    label = np.arange(len(fps))
    a = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None]) <= 2)
    for _ in range(40):
        np.minimum.at(label, i, label[j])
    signed = a.view(np.int64).tolist()
    want, found = {}, {}
    for f, k in zip(signed, label.tolist()):
        want.setdefault(k, set()).add(f)
    for f, k in got.items():
        found.setdefault(k, set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_shards_sort_flanks_and_names_of_cores(monkeypatch):
    """The text that is sorted holds what differs between a key's segments, not the cores that they share."""
    rng = np.random.default_rng(1)
    cores = [bytes(rng.integers(97, 123, 157, np.uint8)) for _ in range(60)]
    rows = []
    for i in range(240):  # segments of 44 windows: flanks of 43 symbols from few different ones, some cut short
        left = [b"x" * 43, b"xy" * 21 + b"x", b"z" * 20 + b"x" * 23][i % 3][i % 5:]
        right = [b"r" * 43, b"r" * 30 + b"s" * 13][i % 2][:43 - i % 4]
        rows.append((i // 4, i // 4, i, i, i, 7 * i, len(left), 157 + len(right), -43, 0, left + cores[i // 4] + right))
    table = pa.Table.from_batches([repeats.as_batch(rows, repeats.segment_schema())])
    sorted_, build = [], suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda text, *a: (sorted_.append(len(text)), build(text, *a))[1])
    got = {(r["gram"], r["seg"]): r["spans"] for r in suffix_array.match_shard(table).to_pylist()}
    assert sum(sorted_) <= len(rows) * (2 * 43 + 3)
    windows = Counter(r[-1][a:a + 200] for r in rows for a in range(len(r[-1]) - 199))
    want = {}
    for r in rows:
        flags = np.array([windows[r[-1][a:a + 200]] > 1 for a in range(len(r[-1]) - 199)])
        if flags.any():
            first, stop = repeats.runs(flags)
            want[r[1], r[2]] = np.stack([first - r[6], stop - 1 + 200 - r[6]], 1).ravel().tolist()
    assert got == want and 0 < len(want) < len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 4)), max_size=5) | st.none(), min_size=1, max_size=6))
def test_covered_runs_of_a_batch(rows):
    """Runs of a whole batch are those of each row: they do not join across rows."""
    spans = [None if r is None else [{"first": a, "stop": a + n} for a, n in r] for r in rows]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
    row, first, stop = suffix_array._covered(pa.array([[{"first": 0, "stop": 1}], *spans], kind).slice(1), np.full(len(rows), 12))
    for i, r in enumerate(spans):
        want = repeats.runs(repeats.cover(r, 12))
        assert (first[row == i].tolist(), stop[row == i].tolist()) == tuple(x.tolist() for x in want)
