"""Multi-index search, piece tables and importance resampling against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from poi_analytics.llm import importance, multi_index, piece_table
from poi_analytics.llm.queries import QUERIES

from .cases import awkward, awkward_rows, empty

# ---- operator 11 --------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, id string, v int, rep long, cell string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, None, "c", "s") for i, v in rows], VECTORS)


def exact(rows, k, is_query):
    """{query: [(id, distance)]} of usable rows given as {id: vector}."""
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    out = {}
    for at, q in enumerate(ids):
        if is_query(q):
            d = np.sqrt(((x - x[at]) ** 2).sum(1))
            out[q] = sorted((float(a), i) for a, i in zip(d, ids) if i != q)[:k]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_walk_visits_every_cell_once_by_summed_distance():
    r = np.random.default_rng(1)
    a, b = r.random(7), r.random(5)
    seen = list(multi_index.walk(a, b))
    assert sorted(seen) == list(range(35))
    total = [a[c // 5] + b[c % 5] for c in seen]
    assert total == sorted(total)


def test_query_recall_and_exact_scores(spark, sf_dir):
    got = answers(QUERIES["op11_multi_index_neighbours"](spark, sf_dir))
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    truth = exact({r.vec_id: r.embedding for r in table}, 10, lambda i: i % 100 == 0)
    assert set(got) == set(truth)
    every = {r.vec_id: np.array(r.embedding, float) for r in table}
    hits = 0
    for q, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, 11))
        for _, i, score in found:
            assert score == pytest.approx(float(np.sqrt(((every[i] - every[q]) ** 2).sum())), abs=1e-12)
        hits += len({i for _, i, _ in found} & {i for _, i in truth[q]})
    assert hits >= 0.9 * 10 * len(truth)


def test_clusters_are_searched_in_few_cells(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 8)) * 20
    rows = {i: (centres[i % 40] + r.normal(size=8)).astype(np.float32).tolist() for i in range(4000)}
    df = multi_index.nearest_neighbours(vectors(spark, rows.items()), multi_index.F.col("id") % 100 == 0, k=10, centroids=40)
    got, truth = answers(df), exact(rows, 10, lambda i: i % 100 == 0)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in truth[q]}) for q in truth)
    assert hits >= 0.9 * 10 * len(truth)
    assert max(row.reranked for row in df.collect()) < 1000  # of 4,000


def test_full_walk_is_exact_with_ties_copies_and_unusable_rows(spark):
    r = np.random.default_rng(5)
    usable = {i: [float(x) for x in r.integers(-2, 3, 4)] for i in range(1, 400)}
    usable = {i: v if any(v) else [1.0, 0.0, 0.0, 0.0] for i, v in usable.items()}
    usable |= {i: [7.0, 7.0, 7.0, 7.0] for i in range(400, 900)}  # one vector that most rows share
    odd = [(1000, None), (1001, []), (1002, [0.0] * 4), (1003, [1.0, None, 1.0, 1.0]), (1100, [1.0, float("nan"), 0.0, 0.0]),
           (1200, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (1300, [1.0, 2.0])]
    rows = [*usable.items(), *odd, (400, usable[400])]
    got = answers(multi_index.nearest_neighbours(vectors(spark, rows), multi_index.F.col("id") % 20 == 0, k=10, centroids=3, recall=1.0,
                                                 calibration=10_000))
    truth = exact(usable, 10, lambda i: i % 20 == 0)
    assert set(got) == set(truth)
    for q, want in truth.items():
        assert [(i, round(d, 9)) for _, i, d in got[q]] == [(i, round(d, 9)) for d, i in want]


def test_blocks_smaller_than_a_cell_and_pieces_of_queries(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 16)
    monkeypatch.setattr(multi_index, "QUERY_ROWS", 8)
    r = np.random.default_rng(9)
    rows = {i: r.normal(size=6).tolist() for i in range(300)}
    got = answers(multi_index.nearest_neighbours(vectors(spark, rows.items()), multi_index.F.col("id") % 5 == 0, k=4, centroids=2,
                                                 recall=1.0, calibration=10_000))
    rows = {i: np.float32(v).tolist() for i, v in rows.items()}
    truth = exact(rows, 4, lambda i: i % 5 == 0)
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in truth.items()}


def test_few_and_no_vectors(spark):
    one = multi_index.F.col("id") >= 0
    assert multi_index.nearest_neighbours(vectors(spark, []), one).count() == 0
    assert multi_index.nearest_neighbours(vectors(spark, [(1, [0.0, 0.0]), (2, None)]), one).count() == 0
    assert multi_index.nearest_neighbours(vectors(spark, [(1, [1.0])]), one).count() == 0
    got = multi_index.nearest_neighbours(vectors(spark, [(1, [1.0]), (2, [3.0])]), one).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 2, 2.0), (2, 1, 1, 2.0)]


# ---- operator 12 --------------------------------------------------------------------

def brute_fim(doc_id, text):
    t = text or ""
    n = len(t)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a, out, sha(out), sha(t))


def test_fill_in_middle_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    rows += [(i, "<" * (i % 3) + "a P> é" * (i % 7) + "<S"[:i % 3]) for i in range(20, 120)]
    rows += [(200 + i, f"x{s}y") for i, s in enumerate(["<P>", "<S>", "<M>", "<p>", "< P>"])]
    docs = spark.createDataFrame([(i, t, "psm", 1, "o") for i, t in rows], "doc_id long, text string, form string, n int, output string")
    got = sorted((tuple(r) for r in piece_table.fill_in_middle(docs).collect()), key=str)
    assert got == sorted((brute_fim(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digests = piece_table.fill_in_middle(docs, digests_only=True)
    assert sorted((tuple(r) for r in digests.collect()), key=str) == sorted((r[:5] + r[6:] for r in got), key=str)


def test_fill_in_middle_of_nothing(spark):
    assert piece_table.fill_in_middle(empty(spark)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM é😀", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]))
def test_pieces_restore_the_text(text, a, b, form):
    if re.search("<[PSM]>", text):
        return
    a, b = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    table = piece_table.PieceTable.of(text).cut(a, b)
    assert [p.buffer[p.start:p.end] for p in table.pieces] == [text[:a], text[a:b], text[b:]]
    output = table.arrange(form).text()
    back = piece_table.restore(output, form)
    assert back.text() == text and len(back) == len(text)
    assert back.sha256() == hashlib.sha256(text.encode()).hexdigest()


def test_hash_streams_long_pieces():
    text = "日本語 text " * 60_000
    table = piece_table.PieceTable.of(text).cut(7, 500_001)
    assert table.sha256() == hashlib.sha256(text.encode()).hexdigest()
    assert max(map(len, table.encoded())) <= 4 * piece_table.HASH_CHUNK


# ---- operator 13 --------------------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=12))
def test_table_crc_equals_zlib(parts):
    data = np.frombuffer(b"".join(parts) + b"!", np.uint8)
    lengths = np.array([len(p) for p in parts], np.int64)
    got = importance.crc32_of_spans(data, lengths.cumsum() - lengths, lengths)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


@pytest.mark.parametrize("n", [63, 64, 65, 127, 128, 129, 4096, 100_003, 3_000_000])
def test_long_spans_fold_blockwise(n):
    data = np.random.default_rng(n).integers(0, 256, n + 10, dtype=np.uint8)
    got = importance.crc32_of_spans(data, np.array([3, 0]), np.array([n, 5]))
    assert got.tolist() == [zlib.crc32(data[3:n + 3].tobytes()), zlib.crc32(data[:5].tobytes())]


def split_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_resample(docs, target, buckets=10_000, longest=1, percent=10, least=20, seed=2024):
    def features(text):
        w = split_words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    corpus, wanted = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, t in docs:
        np.add.at(corpus, features(t), 1)
    for t in target:
        np.add.at(wanted, features(t), 1)
    s_all, t_all = int(corpus.sum()), int(wanted.sum())
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(split_words(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0]))
    for n, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest, percent", [(1, 10), (1, 60), (3, 100)])
def test_resample_equals_brute_force(spark, longest, percent):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(30, "x" * 200_000 + " Y"), (31, "Ünï-code 1a,2B\x00\x7f_z " * 9)]
    rows = [r for r in rows if r != (14, "é" * 500)] + [(14, "é" * 500)]
    docs = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in rows], "doc_id long, text string, weight int, before int, rank string")
    target = ["the thing whenever", None, "", "é que oi THE", "x" * 300]
    wanted = spark.createDataFrame([(t, 5) for t in target], "text string, doc_id int")
    got = importance.resample(docs, wanted, longest=longest, percent=percent, buckets=500)
    want = brute_resample(rows, target, 500, longest, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_repeated_rows_share_no_rank(spark):
    docs = spark.createDataFrame([(7, "a b c " * 10)] * 40, "doc_id long, text string")
    got = importance.resample(docs, docs.limit(3), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    assert len({r.score for r in got}) == 1


def test_resample_of_nothing(spark):
    assert importance.resample(empty(spark), empty(spark)).count() == 0
    got = importance.resample(awkward(spark), empty(spark), least_words=1).collect()
    assert len(got) == len(awkward_rows())
