"""Benchmark decontamination and the corpus pipeline against brute force."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from poi_analytics.llm import decontaminate, langid, simhash
from poi_analytics.llm.queries import QUERIES

from .cases import awkward, awkward_rows, empty, prose

WORD = re.compile(r"[^\W_]+")


def runs_of(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute_leaks(rows, items):
    """Runs of five words, of an item with fewer words the whole item."""
    out = set()
    for i, t in items:
        n = min(5, len(WORD.findall((t or "").lower())))
        wanted = runs_of(t, n) if n else set()
        for d, text in rows:
            shared = len(wanted & runs_of(text, n)) if n else 0
            if wanted and shared >= 0.8 * len(wanted) - 1e-9:
                out.add((d, i, len(wanted), shared))
    return out


def as_items(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_leaks_in_awkward_rows(spark):
    base = [r[:2] for r in awkward_rows()]
    words = prose(5, 30_000).split()
    items = [(1, prose(0, 200)[:150]), (2, " ".join(words[20_000:20_030])), (3, None), (4, ""), (5, "WORD!"), (None, "a b"),
             (6, " ".join(words[9_000:9_020] + ["other"] * 3)), (7, prose(77, 30)), (2, " ".join(words[20_000:20_030])),
             (8, " ".join(w.upper() for w in words[:40])), (9, "日本語 テキスト")]
    got = decontaminate.contained_items(awkward(spark), as_items(spark, items))
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()} == brute_leaks(base, items)
    left = decontaminate.without_items(awkward(spark), as_items(spark, items))
    leaks = {d for d, *_ in brute_leaks(base, items)}
    bad = {(d, t) for d, t in base if brute_leaks([(d, t)], items)}
    assert left.columns == awkward(spark).columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(x for x in base if x not in bad)
    assert leaks


def test_partial_passages(spark):
    """Items of which 60 to 100 % stand in a document, whole and in two places."""
    items, docs = [], []
    for k in range(40):
        w = prose(300 + k, 40).split()
        items.append((k, " ".join(w)))
        cut = 24 + k % 17
        docs.append((k, prose(500 + k, 300) + " " + " ".join(w[:cut]) + " " + prose(600 + k, 50)))
        docs.append((100 + k, " ".join(w[:20]) + " " + prose(700 + k, 900) + " " + " ".join(w[16:])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.contained_items(frame, as_items(spark, items))
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()} == want and len(want) > 40


def test_short_items_are_found_in_long_documents(spark):
    docs = [(1, prose(1, 400) + " the quick, Brown fox " + prose(2, 300)), (2, "Quick brown"), (3, "quick"), (4, "quick fox brown fox " * 9),
            (5, prose(3, 50) + "。今日は良い天気です。" + prose(4, 50)), (6, "fox " * 200 + "the end"), (7, None), (8, "")]
    items = [(1, "quick"), (2, "Quick brown!"), (3, "quick brown fox"), (4, "The quick brown fox"), (5, "今日は良い天気です"), (6, "fox fox"),
             (7, "absent"), (8, "the quick brown fox " + " ".join(prose(2, 300).split()[:3])), (9, "..."), (10, None), (11, "the end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contained_items(frame, as_items(spark, items)).collect()}
    assert got == brute_leaks(docs, items)
    assert {(1, 1), (1, 2), (1, 3), (1, 4), (1, 8), (2, 1), (2, 2), (3, 1), (4, 1), (5, 5), (6, 6), (6, 11)} <= {g[:2] for g in got}
    left = decontaminate.without_items(frame, as_items(spark, items)).collect()
    assert sorted(r.doc_id for r in left) == sorted({d for d, _ in docs} - {g[0] for g in got})


def test_one_of_each_with_columns_of_its_own_names(spark):
    rows = [(1, "a b c d", 5, 6, 7), (2, "a b c d", 8, 9, 1), (2, "a b c d", 8, 9, 1), (3, "x y z w q", 0, 0, 0), (3, "x y z w q", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stay_oid long, stay_key long, stay_n long")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[3]]


def test_leaks_of_the_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = QUERIES["op5_decontamination"](spark, sf_dir).collect()
    want = brute_leaks([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got} == want


def test_empty_sides(spark):
    assert decontaminate.contained_items(empty(spark), as_items(spark, [(1, "a b c d e f")])).collect() == []
    assert decontaminate.contained_items(awkward(spark), as_items(spark, [])).collect() == []
    assert decontaminate.without_items(awkward(spark), as_items(spark, [])).count() == len(awkward_rows())


def test_decontamination_is_native(spark):
    plan = decontaminate.contained_items(awkward(spark), as_items(spark, [(1, "a b c d e f")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def stages(spark, docs, sf_dir):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def check_stages(spark, docs, sf_dir):
    raw, lang, near, cut, clean, packed = stages(spark, docs, sf_dir)
    for stage in (lang, near, cut, clean):
        assert stage.columns == docs.columns
    key = lambda r: (r.doc_id, r.text)
    rows = {name: [key(r) for r in df.collect()] for name, df in
            (("raw", raw), ("lang", lang), ("near", near), ("cut", cut), ("clean", clean))}
    assert all(not langid.has_letter(t) for _, t in (Counter(rows["raw"]) - Counter(rows["lang"])))
    # one document of each near-duplicate component of the stage's input
    groups = defaultdict(set)
    for r in simhash.near_duplicates(lang).collect():
        groups[r.component_id].add(r.doc_id)
    assert len(rows["near"]) >= len(groups) and {i for i, _ in rows["near"]} == set(groups)
    # words of windows that start in an earlier document are gone
    first, order = {}, sorted(rows["near"], key=lambda x: (x[0] is None, x[0] or 0))
    for i, t in order:
        w = (t or "").encode().split()
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a:a + 50]), i)
    want = Counter()
    for i, t in order:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if first[tuple(w[a:a + 50])] != i:
                gone[a:a + 50] = [True] * 50
        if not any(gone):
            want[i, t] += 1
        elif not all(gone):
            want[i, b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    assert Counter(rows["cut"]) == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {(i, t) for i, t in rows["cut"] if brute_leaks([(i, t)], items)}
    assert Counter(rows["clean"]) == Counter(x for x in rows["cut"] if x not in leaks)
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in rows["clean"]}
    assert [r.n_chars for r in cut.collect() if r.text is not None and r.n_chars != len(r.text)] == []


def test_pipeline_on_the_table(spark, sf_dir):
    check_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert corpus_pipeline.run(spark, sf_dir).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_on_awkward_rows(spark, sf_dir):
    check_stages(spark, awkward(spark), sf_dir)


def test_pipeline_on_an_empty_table(spark, sf_dir):
    assert [s.count() for s in stages(spark, empty(spark), sf_dir)] == [0] * 6


def test_documents_stay_when_no_language_can_be_learned(spark):
    texts = ["un deux", "one two", "12 !!", "", None]
    unlabelled = [(i, t, None) for i, t in enumerate(texts)]
    held_out = [(None, t, "en") for t in texts]
    for rows in unlabelled, held_out:
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert sorted(r.text for r in langid.with_language(docs).collect()) == ["one two", "un deux"]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
