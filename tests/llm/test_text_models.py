"""Language ID, token counts, packing and language-model scores."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from poi_analytics.llm import langid, language_model, packing, token_counts
from poi_analytics.llm.queries import QUERIES

from .cases import awkward, awkward_rows, empty, prose, words_of


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


# --- language ID

def test_language_of_awkward_rows(spark):
    got = langid.identify(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, i is None or crc(i) % 5 == 0) for i, *_ in awkward_rows())
    none = [r for r in got if r.doc_id in (6, 7, 8, 9)]
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 4
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"} and all(0 <= r.score <= 1 for r in got)


def test_only_letters_are_letters(spark):
    """Number signs, marks and digits of any script are no letters; letters of any script are."""
    none = ["\u00b2\u00bd", "\u2460\u2167", "\u0663", "_ 12", "\u0301", "\u20ac\u00a9"]
    some = ["\u00b2a", "\u00aa", "\u02b0", "日", "ß\u00b2"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(none + some)], "doc_id long, text string, lang string")
    extra = awkward(spark).select((langid.F.col("doc_id") + 100).alias("doc_id"), "text", "lang")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.unionByName(extra)).collect()}
    assert [got[i] for i in range(len(none))] == ["und"] * len(none)
    assert "und" not in [got[len(none) + i] for i in range(len(some))]
    kept = {r.doc_id for r in docs.where(langid.F.col("text").rlike(langid.LETTER)).collect()}
    assert kept == set(range(len(none), len(none) + len(some)))


def test_copies_take_one_place_of_the_sample(spark):
    """A text with hundreds of copies neither fills its label's places nor starves the label."""
    rows = [(i, "le eau que " * 5, "fr") for i in range(2_000)] + [(3_000 + i, prose(i, 40, "fr"), "fr") for i in range(60)]
    rows += [(5_000 + i, prose(i, 40), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.Settings(sample_per_label=30)).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out) >= 0.97 * sum(r.held_out for r in got.values())


def test_language_without_training_rows(spark):
    assert langid.identify(empty(spark)).collect() == []
    docs = spark.createDataFrame([(1, "the text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]


def test_language_on_held_out_documents(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in QUERIES["op6_language_id"](spark, sf_dir).collect() if r.held_out]
    assert got and sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.97


def test_rejection_keeps_clean_rows_and_all_columns(spark):
    kept = langid.with_language(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= {0, 1, 2, 3, 4, 5, 11, 12, 17, 18} and not ids & {6, 7, 8, 9}


def test_ftrl_is_sparse_and_calibrated():
    s = langid.Settings(bits=10)
    rows = [(np.array([i % 5, 5 + i % 2]), np.array([0.1, 1.0]), i % 2) for i in range(400)]
    w = langid.fit_ftrl(rows, 2, s)
    assert (w[7:] == 0).all() and w[5, 0] > 0 > w[5, 1]
    t = langid.fit_temperature(np.array([[4.0, 0.0]] * 50 + [[0.0, 4.0]] * 50), np.array([0] * 40 + [1] * 60))
    p = langid.softmax(np.array([4.0, 0.0]) / t)[0]
    assert 0.85 < p < 0.95  # nine of ten are right


# --- token counts

COUNTER = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abet hi▁.\n<s>/éß日0 ", max_size=60)))
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


def test_chunk_maps_compose(monkeypatch):
    texts = [r[1] or "" for r in awkward_rows()] + ["    a   b ", "▁▁x▁ y", " " * 50]
    want = [len(x) for x in LIBRARY.encode([t[:900] for t in texts])]
    for size in (1, 5, 64):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert [COUNTER.count(t[:900]) for t in texts] == want


def test_token_counts_of_awkward_rows(spark):
    got = token_counts.count_tokens(awkward(spark), limit=300).collect()
    want = Counter()
    for i, text, *_ in awkward_rows():
        n = len(LIBRARY.encode(text or ""))
        want[i, len((text or "").encode()), n, n > 300] += 1
    assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(empty(spark)).collect() == []


# --- packing

def check_packing(rows, got, capacity=1024):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(r.length for r in got)


def test_packing_of_awkward_rows(spark):
    rows = [r[:2] for r in awkward_rows()] + [(50, "a <|endoftext|> b  c\n d "), (51, "tail  "), (52, "\n \n x"), (53, " lead")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sequences, tokens = check_packing(rows, packing.pack(docs).collect())
    assert sequences <= math.ceil(tokens / 1024) + 1
    assert packing.pack(empty(spark)).collect() == []


def test_packing_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sequences, tokens = check_packing(rows, QUERIES["op8_best_fit_packing"](spark, sf_dir).collect())
    assert sequences <= 1.02 * tokens / 1024 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=300))
def test_plans_use_every_piece_once(lengths):
    histogram = np.bincount(lengths, minlength=33)
    groups = packing.plan(histogram, 32)
    used = np.zeros(33, np.int64)
    for pattern, count in groups:
        assert sum(pattern) <= 32 and count > 0
        for x in pattern:
            used[x] += count
    assert (used == histogram).all()


def test_patterns_fill_exactly():
    ways = packing.patterns(np.array([1, 2, 3, 5, 8]), 8)
    assert {tuple(w[w > 0]) for w in ways} == {(8,), (5, 3), (5, 2, 1), (3, 3, 2)}


# --- language model

def brute_base(rows):
    tokens = [[w.lower() for w in words_of(t)] + [b"\n"] for _, t in rows]
    train = [t for (i, _), t in zip(rows, tokens) if i is not None and crc(i) % 10]
    count = Counter(w for t in train for w in t)
    total, known = sum(count.values()), len(count)
    out = []
    for (i, _), t in zip(rows, tokens):
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (known + 1))) for w in t)
        out.append((i, i is None or crc(i) % 10 == 0, len(t), sum(count[w] > 0 for w in t), total, round(base, 5)))
    return Counter(out)


def test_base_scores_of_awkward_rows(spark):
    small = language_model.Settings(words=64, class_words=16, batch_docs=5, bucket_entries=300, train_share=2, hidden=8)
    got = language_model.score_documents(awkward(spark), small).collect()
    assert Counter((*r[:5], round(r.base_score, 5)) for r in got) == brute_base([r[:2] for r in awkward_rows()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score_documents(empty(spark)).collect() == []


def test_network_beats_the_base_on_held_out_documents(spark):
    """Two languages: the state learns which one a document is in."""
    rows = [(i, prose(1000 + i, 60, "en" if i % 2 else "fr")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = language_model.Settings(words=256, class_words=32, train_share=1, rounds=3, lanes=32, batch_docs=200)
    got = [r for r in language_model.score_documents(docs, s).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_network_learns_from_training_documents_of_all_hash_classes(spark):
    """Two languages, held by fourteen of sixteen hash classes; the other two hold one word only."""
    rows = [(i, "x " * 60 if crc(i) % 10 and crc(i) // 10 % 16 < 2 else prose(1000 + i, 60, "en" if i % 2 else "fr"))
            for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for s in language_model.Settings(), language_model.Settings(train_share=5):
        got = [r for r in language_model.score_documents(docs, s).collect() if r.held_out]
        assert sum(r.score for r in got) > 0.98 * sum(r.base_score for r in got)


def network(n=20):
    v = language_model.Vocabulary(100, 30, np.arange(n, dtype=np.uint64), np.arange(n), np.linspace(9, 2, n), 0.1)
    return language_model.Network(v, language_model.Settings(class_words=6, hidden=5, window=4, lanes=3)), v


def test_probabilities_sum_to_one():
    net, v = network()
    net.train([np.array([1, 2, 3, 20, 5] * 3), np.array([4, 4, 19, 0])] * 20)
    states = np.random.default_rng(0).normal(0, 1, (1, 5)).astype(np.float32)
    lp = [net.outputs(states, np.array([w]))[0][0] for w in range(21)]
    assert abs(sum(np.exp(lp)) - 1) < 1e-4


def test_gradients_of_the_outputs():
    net, _ = network()
    states = np.random.default_rng(1).normal(0, 1, (7, 5)).astype(np.float32)
    net.p["Wc"] += 0.1
    net.p["Ww"] += np.random.default_rng(2).normal(0, 0.3, net.p["Ww"].shape).astype(np.float32)
    target = np.array([0, 5, 6, 13, 19, 20, 20])
    grads = {k: np.zeros_like(a) for k, a in net.p.items()}
    _, back = net.outputs(states, target, grads)
    for i, j in ((0, 1), (3, 4), (6, 0)):
        up, down = states.copy(), states.copy()
        up[i, j] += 1e-2
        down[i, j] -= 1e-2
        slope = (net.outputs(down, target)[0].sum() - net.outputs(up, target)[0].sum()) / 2e-2
        assert abs(slope - back[i, j]) < 1e-2


def test_state_runs_through_whole_documents():
    """A document scores the same alone and beside others, and cutting it changes the rest of its score."""
    net, _ = network()
    net.train([np.array([1, 2, 3, 20, 5] * 6)] * 30)
    one, two = np.array([1, 2, 3, 20, 5] * 4), np.array([7, 8])
    both = net.score(np.concatenate([two, one]), np.array([2, 20]))
    assert np.allclose(both, [net.score(two, np.array([2]))[0], net.score(one, np.array([20]))[0]], atol=1e-4)


def test_gradients_of_the_recurrent_part():
    """Two lanes over three steps, one document starting inside a window and one lane ending early."""
    net, _ = network()
    rng = np.random.default_rng(3)
    net.flat += rng.normal(0, 0.2, net.flat.shape).astype(np.float32)
    x, target = np.array([[1, 2], [3, 21], [1, 4]]), np.array([[3, 5], [1, 4], [20, 9]])
    live, carried = np.array([[1, 1], [1, 1], [1, 0]], bool), np.array([[1, 1], [1, 0], [1, 1]], bool)
    h = rng.normal(0, 0.5, (2, 5)).astype(np.float32)

    def loss():
        table, state, total = net.inputs(), h, 0.0
        for t in range(3):
            state = net.step(table[x[t]], state * carried[t][:, None])
            total -= net.outputs(state, target[t])[0][live[t]].sum()
        return total

    grads = net.views(np.zeros_like(net.flat))
    last = net._window(x, target, live, carried, h, grads)
    assert np.allclose(last[0], net._window(x, target, live, carried, h, net.views(np.zeros_like(net.flat)))[0])
    for name in ("E", "W", "U", "b", "Wc", "bc", "Ww", "bw"):
        place = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        was = net.p[name][place]
        sides = []
        for move in (1e-2, -1e-2):
            net.p[name][place] = was + move
            sides.append(loss())
        net.p[name][place] = was
        assert abs((sides[0] - sides[1]) / 2e-2 - grads[name][place]) < 2e-2 * max(1, abs(grads[name][place])), name


def test_words_are_counted_across_many_buckets(spark):
    """More buckets than a batch has words: the counts still come back to their words."""
    rows = [(i, prose(500 + i, 4)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = language_model.Settings(words=16, class_words=4, batch_docs=2, bucket_entries=1, hidden=4)
    got = language_model.score_documents(docs, small).collect()
    assert Counter((*r[:5], round(r.base_score, 5)) for r in got) == brute_base(rows)
