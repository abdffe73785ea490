"""Quality, language, decontamination, neighbours, near-duplicates and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import op1_quality, op3_decontaminate, op4_neighbours, op7_language, op9_minhash
from folioscope.llm.components import components
from folioscope.llm.shingles import shingle_hashes, word_hashes

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["river", "stone", "window", "garden", "letter", "market", "winter", "summer", "bridge", "forest", "kitchen", "doctor", "engine", "harbor", "island"]
GERMAN = ["fluss", "strasse", "fenster", "garten", "brief", "markt", "winter", "sommer", "schule", "wald", "kirche", "arzt", "zug", "hafen", "insel"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(n))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def brute_links(texts: dict, k: int, percent: int = 80):
    sets = {}
    for i, t in texts.items():
        w = [x for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    comp = {i: i for i in texts}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def test_near_duplicates_against_brute_force(spark):
    base = [prose(s, 150) for s in range(4)]
    texts = {}
    for g, b in enumerate(base):
        for j, share in enumerate((0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08)):
            texts[1000 - 20 * g - j] = edited(b, 100 * g + j, share) if share else b
    texts |= {5: "", 6: "   ", 7: "one two", 8: "ONE  two", 9: "two one", 10: None, 11: "a b c d", 12: "A b c d"}
    df = documents(spark, [(i, t, "en") for i, t in texts.items()]).withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op9_minhash.near_duplicates(df, k=4).collect()}
    assert got == brute_links(texts, 4)


def test_near_duplicates_of_a_large_group_in_blocks(spark, monkeypatch):
    """Many copies of one text, none of which is the text they come from, in buckets larger than SMALL."""
    base = prose(1, 120)
    texts = {i: edited(base, i, 0.012 * (i % 6)) for i in range(1, 70)}
    monkeypatch.setattr(op9_minhash, "BLOCK", 16)
    monkeypatch.setattr(op9_minhash, "SMALL", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op9_minhash.near_duplicates(documents(spark, [(i, t, "en") for i, t in texts.items()]), k=4).collect()}
    assert got == brute_links(texts, 4)


def test_near_duplicates_of_pages_of_one_template(spark, monkeypatch):
    """Many pages that share most of their text, none alike enough, but for some pairs: all links are found."""
    monkeypatch.setattr(op9_minhash, "SMALL", 4)
    frame = prose(5, 150)
    texts = {i: frame + " " + prose(1000 + i, 28) for i in range(150)}
    monkeypatch.setattr(op9_minhash, "BLOCK", 64)
    texts |= {1000 + i: texts[i] + f" own{i} words{i}" for i in range(0, 150, 10)}
    df = documents(spark, [(i, t, "en") for i, t in texts.items()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op9_minhash.near_duplicates(df, k=4).collect()}
    assert got == brute_links(texts, 4) and got[1010][1] == 10


def test_near_duplicate_rows_that_repeat_or_lack_ids(spark):
    rows = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (None, "a b c d e f", "en"), (None, "x y z u v w", "en"), (2, "a b c d e f", "en")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in op9_minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = op9_minhash.one_of_each(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in kept) == [(0, "x"), (1, "a")]
    assert op9_minhash.near_duplicates(documents(spark, [])).count() == 0


def test_near_duplicates_of_ids_with_different_texts(spark):
    """A doc_id's texts are compared and kept one by one, whichever of them a task reads first."""
    a, b, c = prose(31, 100), prose(32, 100), prose(33, 100)
    near = lambda t: t + " more"
    rows = [(1, a), (1, b), (2, near(b)), (5, c), (6, near(c)), (6, a), (7, c), (8, ""), (8, near(a) + " words")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in op9_minhash.near_duplicates(documents(spark, [(i, t, "en") for i, t in rows])).collect())
    assert got == [(1, 96, 1, True), (1, 96, 1, True), (2, 97, 1, False), (5, 96, 5, True), (6, 96, 1, False), (6, 97, 5, False), (7, 96, 5, False), (8, 0, 8, True), (8, 98, 1, False)]
    kept = op9_minhash.one_of_each(documents(spark, [(i, t, "en") for i, t in rows])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b), (5, c), (8, "")])


def test_signature_estimate():
    rng = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.8):
        n = 4000
        shared = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
        x, y = (op9_minhash.signature(s)[1].view(np.uint64) for s in (a, b))
        assert abs(op9_minhash._similar((x ^ y)[None])[0] - j) < 0.15


def test_word_hashes():
    for text in ("", "  ", "One two\tTHREE\nfour\x0bfive\x0csix\rseven", "é É x", "a" * 5000):
        words = text.encode().lower().split()
        h = word_hashes(text)
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert (word_hashes("xx abc") [1:] == word_hashes("abc")).all()
    assert len(shingle_hashes(word_hashes("a b"), 4)) == 1 and len(shingle_hashes(word_hashes("a b a b a b"), 2)) == 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (7, 7)] + [(100, 100 + i) for i in range(1, 50)] + [(300 + i, 301 + i) for i in range(20)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 5)} | {i: 10 for i in range(10, 13)} | {i: 100 for i in range(100, 150)} | {i: 300 for i in range(300, 321)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality(spark):
    good = [(i, prose(i, 60).capitalize() + ".", "en") for i in range(60)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(i, 60).split()), "en") for i in range(60, 90)]
    odd = [(200, None, "en"), (201, "", "en"), (202, "word", "en"), (203, "x " * 50_000, "en"), (None, "text", "en"), (0, good[0][1], "en")]
    docs = documents(spark, good + bad + odd).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = op1_quality.classify(docs, labels).collect()
    assert len(rows) == 96 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"]) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] < 90]
    assert tested and all(r["predicted"] == int(r["doc_id"] < 60) for r in tested)
    assert [r["score"] for r in rows if r["doc_id"] in (200, 201)] == [0, 0]
    assert op1_quality.classify(docs.limit(0), labels).count() == 0
    assert all(r["score"] == 0 for r in op1_quality.classify(docs, labels.limit(0)).collect())


def test_quality_reads_the_whole_of_long_words():
    """Texts of one long word that differ behind its start only, by shapes and pairs of shapes."""
    head, n = "aB3-" * 1500, op1_quality._SHAPES
    one, two = op1_quality.terms(head + "x.Y;" * 500), op1_quality.terms(head + "7=q/" * 500)
    assert (one[:n] != two[:n]).sum() > 1


def test_quality_neighbours_against_brute_force():
    rows = np.stack([op1_quality.terms(prose(i, 40)) for i in range(30)])
    m = op1_quality.learn(rows, [i % 2 for i in range(30)])
    texts = [prose(100 + i, 40) for i in range(5)]
    for t, s in zip(texts, m.score(texts), strict=True):
        v = m.latent(op1_quality.terms(t)[None])[0].astype(float)
        best = sorted(((max(float(v @ x), 0) ** op1_quality.POWER, y) for x, y in zip(m.vectors, m.labels, strict=True)), key=lambda x: -x[0])[: op1_quality.NEAREST]
        assert abs(s - sum(w * y for w, y in best) / sum(w for w, _ in best)) < 1e-4


def test_quality_of_equal_neighbours():
    """Of equally near labelled texts the first by doc_id vote."""
    rows = np.stack([op1_quality.terms(prose(1, 40))] * 40 + [op1_quality.terms(prose(i, 40, GERMAN)) for i in range(20)])
    m = op1_quality.learn(rows, [1] * op1_quality.NEAREST + [0] * (60 - op1_quality.NEAREST))
    assert m.score([prose(1, 40)])[0] == pytest.approx(1.0)


def test_quality_leaves_no_words_behind(spark):
    """A worker goes on to other stages, so what a task keeps of words ends with it."""
    docs = documents(spark, [(i, prose(i, 40), "en") for i in range(40)]).repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert op1_quality.classify(docs, labels).count() == 40

    def kept(batches):
        import pandas as pd

        from folioscope.llm import op1_quality

        for _ in batches:
            yield pd.DataFrame({"n": [len(op1_quality._words)]})

    assert [r["n"] for r in spark.range(0, 8, 1, 4).mapInPandas(kept, "n long").collect()] == [0] * 4


def test_quality_fits_in_little_memory():
    """Besides the rows, one array of their size and blocks."""
    import tracemalloc

    x = np.random.default_rng(1).random((2048, op1_quality.DIMS), np.float32)
    tracemalloc.start()
    try:
        op1_quality.learn(x, [0, 1] * 1024)
        assert tracemalloc.get_traced_memory()[1] < 1.8 * x.nbytes
    finally:
        tracemalloc.stop()


def test_language_cache_is_bounded_by_bytes(monkeypatch):
    """Scores of 100 languages count in the bound, words of many texts stay, and what is let go changes no prediction."""
    vocabulary = {"▁a": 1, "a": 2, "b": 3, "c": 4}
    langs = [f"l{i:03}" for i in range(100)]
    m = op7_language.learn({x: {"▁ab": 1 + i, "▁ac": 3} for i, x in enumerate(langs)}, dict.fromkeys(langs, 1), vocabulary)
    texts = ["ab ac " + " ".join("a" + "".join("abc"[at // 3**k % 3] for k in range(10)) for at in range(i, i + 2000)) for i in range(0, 40_000, 2000)]
    want = [m.predict([t])[0] for t in texts]
    monkeypatch.setattr(op7_language, "MAX_CACHED_BYTES", 5_000_000)
    m._forget()
    for t, w in zip(texts, want, strict=True):
        assert m.predict([t])[0] == pytest.approx(w)
        assert m.table.nbytes + m.hits.nbytes <= 5_000_000 and {"ab", "ac"} <= m.rows.keys()


def test_language(spark):
    rows = [(i, prose(i, 40, WORDS if i % 2 else GERMAN), "en" if i % 2 else "de") for i in range(80)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !? ² Ⅷ _", "de"), (103, "garten " * 20_000, None), (104, "ж" * 3000, None), (None, "river stone", "en"), (1, rows[1][1], "en")]
    docs = documents(spark, rows + odd).withColumn("lang_pred", F.lit("clash"))
    got = op7_language.identify(docs, public.path("piece_bpe_32k.model")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 87 and all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in got)
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [by[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "de"] and by[104]["lang_pred"] in ("de", "en")
    none = op7_language.identify(docs.withColumn("lang", F.lit(None).cast("string")), public.path("piece_bpe_32k.model")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_segmentations_against_enumeration():
    vocabulary = {p: i + 1 for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"])}
    m = op7_language.learn({"x": {"▁aba": 3, "▁ab": 2}, "y": {"▁bab": 4}}, {"x": 1, "y": 1}, vocabulary)

    def ways(w, k):
        if not w:
            return 1.0
        total = 0.0
        for n in range(1, len(w) + 1):
            q = m.p[vocabulary.get(w[:n], 0), k]
            total += (max(q, op7_language.FLOOR) if n == 1 else q) * ways(w[n:], k)
        return total

    for w in ("▁abab", "▁zab", "▁b", "▁" + "ab" * 6):
        want = [np.log(ways(w, k)) for k in range(2)]
        assert np.allclose(m._score([w])[0], want) and np.allclose(op7_language._long_word(w, m.pieces, m.p), want)
        ids, counts = op7_language._expected_of_long(w, m.pieces, m.p[:, 0])
        want = op7_language.expected_counts({w: 1}, m.pieces, m.p[:, 0])
        assert np.allclose(np.bincount(ids, counts, len(want))[1:], want[1:] / op7_language.UNIT, atol=1e-4)


def test_language_is_learned_alike_by_jobs_and_on_one_machine(spark):
    """All pieces and words take part, long ones too, and the prior is of all labelled rows."""
    path = public.path("piece_bpe_32k.model")
    vocabulary = op7_language.vocabulary(path)
    assert max(map(len, vocabulary)) > 12
    rows = [(i, prose(i, 40, WORDS) + " relationship " + "ab" * (30 + i), "en") for i in range(40)] + [(i, prose(i, 40, GERMAN), "de") for i in range(40, 60)]
    docs = documents(spark, rows)
    seen, words = op7_language.training_words(docs)
    assert seen == {"de": sum(not held(i) for i in range(40, 60)), "en": sum(not held(i) for i in range(40))}
    langs = list(seen)
    counts = {x: {} for x in langs}
    for r in words.collect():
        counts[langs[r["at"]]][r["w"]] = r["n"]
    one, many = op7_language.learn(counts, seen, vocabulary), op7_language.fit(docs, path)
    assert one.langs == many.langs and (one.p == many.p).all() and (one.prior == many.prior).all()
    assert one.p[vocabulary["▁relationship"], 1] > 100 * op7_language.FLOOR


def test_language_of_ties_and_of_runs_without_spaces():
    vocabulary = {p: i + 1 for i, p in enumerate(["▁", "a", "b", "ab"])}
    m = op7_language.learn({"y": {"▁ab": 3}, "x": {"▁ab": 3}}, {"y": 2, "x": 2}, vocabulary)
    assert m.predict(["ab ab"]) == [("x", 0.5)] and m.predict(["ab" * 20_000])[0] == ("x", 0.5)


def test_decontamination(spark):
    item = prose(1, 30)
    words = item.split()
    swapped = " ".join("other" if i % 6 == 3 else w for i, w in enumerate(words))
    dropped = " ".join(w for i, w in enumerate(words) if i % 7)
    rows = [(1, prose(50, 200) + " " + item + " " + prose(51, 100), "en"), (2, prose(52, 80) + "\n" + swapped.upper() + ".", "en"), (3, dropped, "en"), (4, prose(53, 300), "en"), (5, None, "en"), (6, "", "en"), (None, item, "en"), (1, "clean text only", "en"), (7, item * 1, "en"), (7, item * 1, "en")]
    docs = documents(spark, rows).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(10, item), (11, prose(2, 30)), (12, None), (13, "two words")], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["item_id"]) for r in op3_decontaminate.leaked_items(docs, bench).collect())
    assert got == [(0, 10), (1, 10), (2, 10), (3, 10), (7, 10), (7, 10)]
    assert sorted((r["doc_id"], r["text"]) for r in op3_decontaminate.without_leaks(docs, bench).where("doc_id is not null").collect() if r["doc_id"] < 5) == sorted([(1, "clean text only"), (4, rows[3][1])])
    assert op3_decontaminate.leaked_items(docs.limit(0), bench).count() == 0 and op3_decontaminate.leaked_items(docs, bench.limit(0)).count() == 0


def test_decontamination_where_most_trigrams_are_absent_or_common(spark):
    """An edited copy as an item's only trace, a back half as another's, and back halves that a whole copy makes common."""
    edited_item, half_item, common_item = (prose(s, 32) for s in (21, 22, 23))
    edited = " ".join("other" if i % 4 == 3 else w for i, w in enumerate(edited_item.split()))
    back = lambda t: " ".join(t.split()[14:])
    rows = [(1, prose(60, 90) + " " + edited, "en"), (2, back(half_item) + " " + prose(61, 90), "en"), (3, common_item, "en"), *((i, back(common_item), "en") for i in range(4, 9)), (9, prose(62, 300), "en")]
    bench = spark.createDataFrame([(31, edited_item), (32, half_item), (33, common_item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in op3_decontaminate.leaked_items(documents(spark, rows), bench).collect())
    assert got == [(1, 31), (2, 32), *((i, 33) for i in range(3, 9))]


def test_decontamination_of_short_items_long_texts_and_parts(spark, monkeypatch):
    """Items of one or two words stand whole; every hit of a very long text counts; parts of items give the same; ties are each reported."""
    item, same = prose(41, 24), prose(41, 24)
    far = prose(63, 30_000) + " " + item + " " + prose(64, 30_000)
    rows = [(1, "He said Two-Words, and left", "en"), (2, "words two", "en"), (3, "Shibboleth!", "en"), (4, far, "en"), (5, "x", "en"), (6, item[: len(item) // 2], "en")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(1, "two words"), (2, "shibboleth"), (3, item), (4, same), (5, ""), (6, "..."), (7, None)], "item_id long, text string")
    whole = sorted((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in op3_decontaminate.leaked_items(docs, bench).collect())
    assert [x[:2] for x in whole] == [(1, 1), (3, 2), (4, 3), (4, 4), (6, 3), (6, 4)] and all(s == 1 for d, _, s in whole if d != 6)
    monkeypatch.setattr(op3_decontaminate, "PART_BYTES", 60)
    parts = sorted((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in op3_decontaminate.leaked_items(docs, bench).collect())
    assert parts == whole


def test_alignment_against_brute_force():
    rng = np.random.default_rng(3)
    item = rng.integers(0, 6, 12)
    windows = rng.integers(-1, 6, (5, 25))
    got, _ = op3_decontaminate.local_scores(item, windows)
    for row, g in zip(windows, got, strict=True):
        h = np.zeros((len(item) + 1, len(row) + 1))
        for i, a in enumerate(item, 1):
            for j, b in enumerate(row, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        assert abs(h.max() - g) < 1e-5


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [None] * 16), (None, x[0].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in op4_neighbours.neighbours(df, cell_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    v = x.astype(float)
    size = np.linalg.norm(v, axis=1)
    hit = 0
    assert set(got) == set(range(0, 1500, 50)) and all(len(g) == 5 for g in got.values())
    for q, g in got.items():
        c = np.round(v @ v[q] / (size * size[q]), 12)
        c[q] = -9
        best = np.lexsort((np.arange(1500), -c))[:5]
        hit += len(set(best) & {i for i, _ in g})
        assert all(abs(s - c[i]) < 1e-9 for i, s in g)
        if q in (100, 150):
            assert [i for i, _ in g] == [i for i in range(100, 107) if i != q][:5]
    assert hit >= 0.9 * 5 * len(got)
    assert op4_neighbours.neighbours(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in op4_neighbours.neighbours(few).collect()] == [(0, 1, 1)]


def test_neighbours_of_extreme_magnitudes_and_lengths(spark):
    """Sizes near the limits of double precision change no cosine; vectors of another length are no candidates."""
    rows = [(0, [1e-200, 0.0]), (1, [2.0**-700, 2.0**-703]), (2, [1.0, 0.5]), (3, [2.0**700, 2.0**697]), (4, [3e-310, 0.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 2.0, 0.0]), (100, [2.0]), (150, [])]
    got = {}
    for r in op4_neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    near = 8 / np.sqrt(65)
    assert [i for i, _ in got[0]] == [4, 1, 3, 2] and np.allclose([x for _, x in got[0]], [1, near, near, 2 / np.sqrt(5)])
    assert [i for i, _ in got[50]] == [51] and set(got) == {0, 50}


def test_neighbours_stop_early(spark):
    """On isotropic vectors, the hardest case, recall is 0.9 at least and most vectors are never verified; groups are cut small."""
    x = np.random.default_rng(7).normal(size=(6000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = op4_neighbours.neighbours(df, cell_rows=900).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit, share = 0, []
    for q in range(0, 6000, 50):
        c = u @ u[q]
        c[q] = -9
        mine = [r for r in rows if r["query_id"] == q]
        assert sorted(r["rank"] for r in mine) == [1, 2, 3, 4, 5]
        hit += len({r["vec_id"] for r in mine} & set(np.argsort(-c)[:5].tolist()))
        share.append(mine[0]["verified"] / 6000)
    assert hit >= 0.9 * 5 * 120 and np.mean(share) < 0.45


def test_neighbours_in_parts_of_crowded_cells(spark, monkeypatch):
    """Cells beyond their rows, and crowds of queries beyond theirs, are searched in parts with the same result."""
    monkeypatch.setattr(op4_neighbours, "MAX_DEPTH", 1)
    monkeypatch.setattr(op4_neighbours, "QUERY_ROWS", 7)
    x = np.random.default_rng(8).normal(size=(500, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in op4_neighbours.neighbours(df, every=5, cell_rows=60).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = sum(len(got[q] & {i for i in np.argsort(-(u @ u[q]))[:6].tolist() if i != q}) for q in range(0, 500, 5))
    assert len(got) == 100 and hit >= 0.9 * 500


def brute_pipeline(docs, labels, items):
    """The five stages on one machine, one after the other: rows (doc_id, text, lang) in, {(doc_id, text)} of each stage out, and the ids."""
    import hashlib

    from folioscope.llm import op5_bpe

    crc = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    taught = sorted((i, q, t) for i, q in labels if q is not None and not crc(i) for j, t, _ in docs if j == i and t is not None)
    m = op1_quality.learn(np.stack([op1_quality.terms(t) for _, _, t in taught]), [q for _, q, _ in taught])
    rows = [r for r in docs if m.score([r[1]])[0] >= 0.3]
    out = [sorted(rows, key=str)]

    vocabulary = op7_language.vocabulary(public.path("piece_bpe_32k.model"))
    counts, seen = {}, {}
    for i, t, lang in rows:
        if lang is not None and t is not None and i is not None and not crc(i):
            seen[lang] = seen.get(lang, 0) + 1
            for w in op7_language._LETTERS.findall(t.lower()):
                w = op7_language.MARK + w
                counts.setdefault(lang, {})[w] = counts.get(lang, {}).get(w, 0) + 1
    tongue = op7_language.learn(counts, seen, vocabulary)
    told = [tongue.predict([t])[0] for _, t, _ in rows]
    rows = [r for r, (lang, share) in zip(rows, told, strict=True) if lang != "und" and share >= 0.5]
    out.append(sorted(rows, key=str))

    texts = sorted({(i, t) for i, t, _ in rows}, key=str)
    group = {texts[k]: c for k, (_, c) in brute_links({k: t for k, (_, t) in enumerate(texts)}, 5).items()}
    best = {}
    for x in texts:
        best[group[x]] = min(best.get(group[x], x), x)
    stay, kept = set(best.values()), []
    for r in rows:
        if r[:2] in stay:
            stay.remove(r[:2])
            kept.append(r)
    out.append(sorted(kept, key=str))

    known = {}
    number = lambda t: np.array([known.setdefault(w, len(known)) for w in op3_decontaminate.words_of(t)], np.int64)
    targets = [x for x in (number(t) for t in items) if len(x)]
    leak = lambda t: any(op3_decontaminate.local_scores(x, number(t)[None])[0][0] >= 0.4 * len(x) for x in targets)
    rows = [r for r in kept if not (r[1] and leak(r[1]))]
    out.append(sorted(rows, key=str))

    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [(i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), t or "") for i, t, _ in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert op5_bpe
    return out, sorted((i, len(x) // 4, sha(x), sha(t.encode())) for i, x, t in ids)


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small corpus with edited copies of documents and of benchmark items, nulls, empty texts, repeated rows and a clashing column."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    source = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    source = [r for r in source if len(r[1] or "") < 6000]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:40]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    some = [r for r in source if len((r[1] or "").split()) > 80][:6]
    rows = source + [(10_000 + i, edited(t, i, 0.01), lang) for i, (_, t, lang) in enumerate(some)]
    rows += [(20_000 + i, f"{some[i % 6][1][:300]} {edited(x, i, 0.1)} {some[i % 6][1][-300:]}", "en") for i, x in enumerate(items[:8])]
    rows += [(30_000, None, "en"), (30_001, "", None), (30_002, " \n", "en"), (some[0][0], some[0][1], some[0][2]), (30_003, some[1][1], None)]
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash") for i, t, lang in rows], DOCS + ", score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps, want = brute_pipeline(rows, labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for (name, stage), step in zip(pipeline.STAGES, steps, strict=False):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns and sorted(((r["doc_id"], r["text"], r["lang"]) for r in docs.collect()), key=str) == step, name
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(steps[0]) > len(steps[2]) > len(steps[3]) > 50
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(pipeline.STAGES)
    good = {r["doc_id"] for r in stages["quality classifier"](spark, docs, sf).collect()}
    assert all((i in good) == bool(q) for i, q in labels.items())
    assert stages["language id"](spark, docs, sf).count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i for i, (_, c) in brute_links(texts, 5).items() if i == c}
    kept = stages["minhash near-dedup"](spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in stages["benchmark decontamination"](spark, docs, sf).collect()}
    assert clean == {i for i, t in texts.items() if not any(x in t for x in items)}
