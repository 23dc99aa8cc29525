"""Hostile rows and stages: null and repeated ids, long tokens and texts, ties, samples of unequal size, recall of near pairs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from silva.llm import language, minhash, toxicity


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_samples_of_unequal_size_compare_fairly(spark):
    rng = random.Random(3)
    stems = [words(rng, "abcdefghij", 1) for _ in range(60)]
    tongue = {"big": stems[:40], "small": stems[20:]}

    def say(k, n):
        return " ".join(rng.choice(tongue[k]) + rng.choice(["", "a", "e"]) for _ in range(n))

    parser = language.CrossParser({"big": [say("big", 6000)], "small": [say("small", 60)]})
    texts = spark.createDataFrame([(i, say("small", 80)) for i in range(100)], "doc_id long, text string")
    assert sum(r.lang_pred == "small" for r in language.identify(texts, parser).collect()) >= 95
    texts = spark.createDataFrame([(i, say("big", 80)) for i in range(100)], "doc_id long, text string")
    assert sum(r.lang_pred == "big" for r in language.identify(texts, parser).collect()) >= 95


def longest_match_phrases(text, sample):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample and text[at : at + k] in sample:
            k += 1
        at, n = at + k, n + 1
    return n


def test_phrases_of_long_texts_equal_longest_matches_block_by_block():
    rng = random.Random(5)
    samples = {"a": [words(rng, "abcd", 300)], "b": [words(rng, "cdef", 200)]}
    parser = language.CrossParser(samples)
    texts = [words(rng, "abcdef", n) for n in (1, 40, 3000)] + ["ü 日本 12 a"]
    found, counts = parser.phrases(texts)
    for k, t in enumerate(texts):
        s = parser.symbols([t])[0].tobytes()
        assert len(s) == counts[k]
        for row, lang in enumerate(parser.languages):
            sample = parser.symbols(samples[lang])[0].tobytes()
            assert found[row, k] == sum(longest_match_phrases(s[b : b + language.BLOCK], sample) for b in range(0, len(s), language.BLOCK))


def test_language_of_hostile_rows(spark):
    rows = [(1, "hello there", "en"), (1, "hello there", "en"), (2, None, "en"), (3, "", None), (4, "123 !?", "fr"), (None, "hello again", "en"), (5, "x" * 300_000, "en"), (6, "bonjour", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)})
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == 8 and sorted(r.lang_pred for r in got) == ["en"] * 5 + ["und"] * 3
    assert all(r.score == (0.0 if r.lang_pred == "und" else 1.0) for r in got)
    none = docs.limit(0)
    assert language.identify(none, language.train(none)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(none)).collect()} == {"und"}
    tie = language.CrossParser({"b": ["same text"], "a": ["same text"]})
    assert {r.lang_pred for r in language.identify(docs.where("doc_id = 1"), tie).collect()} == {"a"}


def test_number_characters_are_no_letters(spark):
    learned = spark.createDataFrame([(1, "hello there", "en"), (3, "guten tag", "de")], "doc_id long, text string, lang string")
    texts = ["½ ²", "Ⅷ ①", "٣ 四", "ᛮ", "12 a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(docs, language.train(learned)).collect()}
    for k, text in enumerate(texts):
        if any(c.isalpha() for c in text):
            assert got[k].lang_pred in ("de", "en") and 0 <= got[k].score <= 1
        else:
            assert (got[k].lang_pred, got[k].score, got[k].bits_per_symbol) == ("und", 0, 0)


def test_long_tokens_take_time_in_proportion():
    rng = np.random.default_rng(1)
    fix = toxicity.Deobfuscator(toxicity.costs(rng.integers(0, 50, size=(toxicity.SYMBOLS,) * 3).astype(float)))
    pool = "abcdefghijklmnopqrstuvwxyz0123456789+/"
    for token in ("a" * 200_000, "ab" * 100_000, "".join(pool[i] for i in rng.integers(0, 38, 200_000)), "a b " * 50_000, "1!" * 50_000 + "a", "a." * 100_000):
        began = time.time()
        fix(token)
        fix.pieces(token)
        assert time.time() - began < 20
    t = time.time()
    assert fix("a" * 1_000_000) == "a" and time.time() - t < 5


def test_toxicity_of_hostile_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        rows.append((i, words(rng, "etaoinsh", 20) + (" vile" if i % 3 == 0 else "")))
        labels.append((i, int(i % 3 == 0)))
    rows += [(None, "so v1le"), (None, None), (0, rows[0][1]), (0, "plain text"), (400, ""), (401, "x" * 100_000), (402, "á v!l3")]
    labels += [(None, 1), (5, None), (999, 1), (0, 1), (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "y": F.lit(1), "id": F.lit(2)})
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("t"))
    got = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r.predicted)
    assert sorted(of[None]) == [0, 1] and sorted(of[0]) == [0, 1, 1] and of[400] == of[401] == [0] and of[402] == [1]
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.train(none, marks.limit(0))).count() == 0
    assert all(r.score == got2.score for r, got2 in zip(*[toxicity.score(docs.where("doc_id = 1"), toxicity.train(docs, marks.limit(0))).collect()] * 2))


def test_near_pairs_are_recalled_and_repeats_are_fast(spark):
    rng = random.Random(9)
    pool = [words(rng, "etaoinshrdlu", 1) for _ in range(4000)]
    rows, near = [], []
    for k in range(150):
        own = [rng.choice(pool) for _ in range(rng.randint(60, 400))]
        other = list(own)
        for _ in range(rng.randint(1, max(1, len(own) // 60))):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice([[], [rng.choice(pool)], [rng.choice(pool), rng.choice(pool)]])
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        a, b = (minhash.shingle_hashes(minhash.word_hashes([" ".join(w)])[0], 5) for w in (own, other))
        if minhash.similarity(a, b, 0.8):
            near.append(k)
    boiler = " ".join(rng.choice(pool) for _ in range(120))
    rows += [(1000 + i, boiler + " " + " ".join(rng.choice(pool) for _ in range(150))) for i in range(60)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 80 and all(got[2 * k + 1] == got[2 * k] for k in near)
    assert all(got[2 * k + 1] != got[2 * k] for k in range(150) if k not in near)
    assert len({got[1000 + i] for i in range(60)}) == 60
    one = np.full(20_000, 5, dtype=np.uint64)
    two = one.copy()
    one[0], two[-1], two[::97] = 1, 2, np.arange(len(two[::97]))
    began = time.time()
    assert minhash.similarity(one, two, 0.8) > 0.9 and time.time() - began < 2


def test_near_copies_of_hostile_rows(spark):
    rng = random.Random(10)
    base = [words(rng, "etaoinsh", 60) for _ in range(4)]
    twin = base[1] + " more"
    rows = [(9, base[0]), (3, base[0]), (3, base[1]), (7, twin), (None, base[0]), (None, base[2]), (None, base[2]), (5, None), (5, ""), (6, "!!"), (8, base[3]), (8, base[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "n": F.lit("x"), "node": F.lit(0), "hash": F.lit(2)})
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles > 0, -1 if r.class_id is None else r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    want = [(9, True, 3, False), (3, True, 3, True), (3, True, 3, True), (7, True, 3, False), (-1, True, 3, False), (-1, True, -1, True), (-1, True, -1, True), (5, False, 5, True), (5, False, 5, True), (6, False, 6, True), (8, True, 8, True), (8, True, 8, True)]
    assert got == sorted(want)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(folder, documents): rows of every hostile kind beside plain ones."""
    rng = random.Random(12)
    plain = [words(rng, "etaoinshrdlcum", 40) for _ in range(120)]
    leak = words(rng, "etaoinshrdlcum", 30)
    rows = [(i, t + (" vile" if i % 4 == 0 else ""), "en") for i, t in enumerate(plain)]
    rows += [(None, plain[1], "en"), (1, plain[1], "en"), (1, plain[2] + " tail", None), (None, "so vile", "en"), (200, None, "en"), (201, "", None), (202, "12 34", "en"), (None, leak, "en"), (203, plain[3] + " " + leak, "en"), (203, plain[5], "en"), (204, words(rng, "etaoin", 9000), "en")]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "_row": F.lit(1), "_k1": F.lit("y"), "source": F.lit("s"), "n_chars": F.lit(0)}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, leak), (1, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, leak


def test_every_stage_judges_row_by_row(spark, stages):
    import corpus_pipeline

    at, rows, leak = stages
    docs = spark.read.parquet(f"{at}/documents.parquet")
    order = lambda got: sorted(((-1 if i is None else i), t or "") for i, t in got)
    pairs = [(i, t) for i, t, _ in rows]
    wanted = {
        "language": [(i, t) for i, t in pairs if any(c.isalpha() for c in t or "")],
        "toxicity": [(i, t) for i, t in pairs if "vile" not in (t or "")],
        "leaks": [(i, t) for i, t in pairs if leak not in (t or "")],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, at)
        assert got.columns == docs.columns and stage(spark, docs.limit(0), at).count() == 0
        found = order((r.doc_id, r.text) for r in got.collect())
        if name in wanted:
            assert found == order(wanted[name]), name
        else:  # one of each group: three rows of plain[1], two of plain[2] and of plain[5], whatever their ids
            texts = [t for _, t in found]
            assert len(found) == len(rows) - 4 and texts.count(rows[1][1]) == texts.count(rows[5][1]) == sum(t.startswith(rows[2][1]) for t in texts) == 1
    name, stage = corpus_pipeline.STAGES[-1]
    out = stage(spark, docs, at)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and out.select("doc_id", "piece", "start").count() >= len(rows)
    assert stage(spark, docs.limit(0), at).count() == 0
    assert corpus_pipeline.run(spark, at).count() > 50
