"""The numbered operators on small fixtures: brute force, round trips, hostile rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from silva.llm import decontam, embeddings, language, lattice, licenses, minhash, packing, sstable, tokens, toxicity, warc

SYLLABLES = "the an er in ti on re st ha wh ou ly nd es".split()


def text(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randint(5, 200)), "en" if i % 2 else "xx") for i in range(60)]
    rows += [(60, None, None), (61, "", "en"), (62, "12 34", None), (63, text(rng, 3000), "en"), (64, rows[3][1], "xx"), (64, rows[3][1], "xx"), (None, "lone text", None)]
    words = rows[7][1].split()
    rows.append((70, " ".join(words[:-1] + ["changed"]), "en"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit(1)).withColumn("n", F.lit("x"))


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_minhash_classes(spark, docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert got[64].class_id == 3 and not got[64].kept and got[3].kept
    assert got[None].kept and got[60].kept and got[62].kept
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_finds_all_near_pairs_of_short_texts(spark):
    rng = random.Random(12)
    rows = []
    for n in range(6, 26):
        for _ in range(6):
            own = [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
            rows += [own, [*own, "more"], ["more", "still", *own], ["other", *own[1:]], [*own[:-2], "else", "where"]]
    for _ in range(20):  # repeated words
        own = [rng.choice("xyz") for _ in range(rng.randint(6, 25))]
        rows += [own, [*own, rng.choice("xyz")]]
    tables = [minhash.shingle_hashes(minhash.word_hashes([" ".join(w)])[0], 5) for w in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if minhash.similarity(tables[i], tables[j], 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = minhash.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == {i: find(i) for i in range(len(rows))}
    assert len({find(i) for i in range(len(rows))}) < len(rows) - 200


def test_similarity_equals_common_subsequence():
    rng = random.Random(1)
    for _ in range(30):
        a = [rng.randint(0, 6) for _ in range(rng.randint(5, 30))]
        b = [x for x in a if rng.random() > 0.08]
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        m = table[-1, -1]
        want = m / (len(a) + len(b) - m) if b else 0
        got = minhash.similarity(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 0.7)
        assert got == pytest.approx(want if want >= 0.7 else 0)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.08, size=(20, 16)), base[:5]])
    rows = [(i, v.tolist(), int(i % 20 % 3)) for i, v in enumerate(x)] + [(90, None, 1), (91, [0.0] * 16, 1), (92, [1.0, None], 1), (93, [float("nan")] * 16, 1), (94, x[0].tolist(), None), (95, [], 1)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in rows[:65]])[:, None] == np.array([r[2] for r in rows[:65]])[None])
    assert [got[i].n_links for i in range(65)] == (near.sum(axis=1) - 1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(90, 96))
    assert sum(near.sum(axis=1) > 1) > 10


def test_lattice_sums_all_segmentations():
    v = lattice.pieces(lattice.default_vocabulary())
    score = v.start.tolist()
    word = lattice.MARK + "thing"

    def ways(i):
        return 1.0 if i == len(word) else sum(math.exp(score[v.names[word[i:j]]]) * ways(j) for j in range(i + 1, len(word) + 1) if word[i:j] in v.names)

    assert lattice.log_probability("thing", v, score) == pytest.approx(math.log(ways(0)))
    into = [0.0] * len(score)
    weight = np.exp(v.start).tolist()
    table = lattice.arc_table(v, weight)
    lattice.expected_counts("thing", 2.0, v, score, weight, table, into)
    for w in ("thing", "日本x", "a" * 200):
        assert lattice.word_score(w, v, score, weight, table) == pytest.approx(lattice.log_probability(w, v, score))
    assert sum(len(p) * into[i] for p, i in v.names.items()) == pytest.approx(2.0 * len(word))


def test_lattice_of_unseen_characters_does_not_underflow(spark):
    v = lattice.pieces(lattice.default_vocabulary())
    rare = np.full(len(v.start), math.log(1e-9))
    for start in (v.start, rare):
        score, weight = start.tolist(), np.exp(start).tolist()
        table = lattice.arc_table(v, weight)
        for word in ("\u4e02" * 19, "\U0001f9ff" * 15, "\u4e02\U0001f9ff" * 29, "ab" * 29):
            assert lattice.word_score(word, v, score, weight, table) == pytest.approx(lattice.log_probability(word, v, score))
            into = [0.0] * len(score)
            lattice.expected_counts(word, 3.0, v, score, weight, table, into)
            named = sum(len(p) * into[i] for p, i in v.names.items())
            assert named + sum(into[i] for i in v.byte) >= 3.0 * len(word) and all(map(math.isfinite, into))
    rows = [(i, "plain words " + "\u4e02" * 40 + " " + "\U0001f9ff" * 30 + f" {i}") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = lattice.score(table, *lattice.train(table, lattice.default_vocabulary())).collect()
    assert len(got) == 30 and all(math.isfinite(r.score) for r in got)


def test_lattice_scores(spark, docs):
    got = lattice.score(docs, *lattice.train(docs, lattice.default_vocabulary(), frequent=50)).collect()
    rows = docs.collect()
    counts, ends = {}, 0
    for r in rows:
        if r.doc_id is None or crc(r.doc_id, 10) != 0:
            ends += 1
            for w in lattice.tokens(r.text or ""):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    by = {(g.doc_id, round(g.base_score, 6)) for g in got}
    for r in rows:
        c = [counts.get(w, 0) for w in lattice.tokens(r.text or "")] + [ends]
        base = sum(math.log10((x + 0.1) / (total + 0.1 * (distinct + 1))) for x in c)
        assert any(i == r.doc_id and abs(b - base) < 1e-4 for i, b in by)
    assert len(got) == len(rows) and all(g.score < 0 and g.train_tokens == total for g in got)


def test_lattice_scores_do_not_depend_on_the_broadcast(spark, docs):
    by = []
    for frequent in (3, 10_000):
        model, rare = lattice.train(docs, lattice.default_vocabulary(), frequent=frequent)
        by.append(sorted((r.doc_id or -1, r.n_tokens, r.score) for r in lattice.score(docs, model, rare).collect()))
    assert [r[:2] for r in by[0]] == [r[:2] for r in by[1]]
    assert [r[2] for r in by[0]] == pytest.approx([r[2] for r in by[1]])
    # a counted word has its own arc, however many words are more frequent
    rows = spark.createDataFrame([(i, "common words come here zyxwvq") for i in range(40)], "doc_id long, text string")
    model, rare = lattice.train(rows, lattice.default_vocabulary(), frequent=0)
    row = rare.where(F.col("word") == F.lit(b"zyxwvq")).first()
    assert row.n and row.spelled >= math.log10(model.share * row.n / model.total)


def brute_leaks(docs, items):
    import re

    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def bag(w):
        out = {}
        for i in range(len(w) - 4):
            out[tuple(w[i : i + 5])] = out.get(tuple(w[i : i + 5]), 0) + 1
        return out

    found = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            b = bag(words(it))
            n = len(words(it))
            for s in range(len(w)) if b else []:
                a = bag(w[s : s + n])
                common = sum(min(c, b.get(g, 0)) for g, c in a.items())
                sim = common / (sum(a.values()) + sum(b.values()) - common)
                if sim >= 0.8:
                    found[d, i] = max(sim, found.get((d, i), 0))
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, text(rng, rng.randint(15, 50))) for i in range(8)] + [(20, "too short"), (21, None)]
    rows = []
    for d in range(30):
        w = text(rng, 60).split()
        if d % 2:
            own = items[d % 8][1].split()
            if d % 3 == 0:
                own[len(own) // 2] = "changed"
            w[30:30] = own
        rows.append((d, " ".join(w)))
    rows += [(40, None), (41, ""), (42, items[0][1]), (None, items[1][1])]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in brute_leaks(rows, items).items()}


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    cost = toxicity.costs(rng.integers(0, 50, size=(toxicity.SYMBOLS,) * 3).astype(float)).tolist()
    from itertools import product

    for span in ("1d10t", "a.b c", "moo00n", "s  t"):
        best = []
        for choice in product(*toxicity.lattice(span)):
            reading, total, x, y = "".join(c for c, _ in choice), sum(p for _, p in choice), 0, 0
            for c in reading:
                z = toxicity._code(c)
                total += cost[x][y][z]
                x, y = y, z
            best.append((total + cost[x][y][0], reading))
        assert toxicity.restore(span, cost) == min(best)[1]


def test_toxicity_finds_disguised_words(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = text(rng, 30).split()
        if toxic:
            t.insert(5, rng.choice(["moron", "idiot", "stupid"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    d, l = spark.createDataFrame(rows + [(500, None), (501, "")], "doc_id long, text string"), spark.createDataFrame(labels + [(7, None)], "doc_id long, toxic int")
    model = toxicity.train(d, l)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    right = [got[i].predicted == y for i, y in labels if got[i].held_out]
    assert sum(right) / len(right) > 0.95 and got[500].predicted == 0 and got[501].score == got[500].score
    odd = spark.createDataFrame([(1, "the m0r0n ha"), (2, "an i d i o t st"), (3, "re stuuupid on")], "doc_id long, text string")
    restored = {r.doc_id: r.restored for r in toxicity.score(odd, model, with_text=True).collect()}
    assert restored == {1: "the moron ha", 2: "an idiot st", 3: "re stupid on"}


def test_toxicity_restores_all_disguises(spark):
    words = "hate ass idiots morons stupid ignorant ugly bastard idiot moron the an er in tion rest hash well".split()
    rng = random.Random(6)
    table = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(60)) + " blöde") for i in range(200)], "doc_id long, text string")
    fix = toxicity.Deobfuscator(toxicity.costs(toxicity.trigram_counts(table)))
    odd = {"h4t3": "hate", "a55": "ass", "idi07": "idiot", "m0r0n5": "morons", "stup1d0": "stupido", "i9norant": "ignorant", "u91y": "ugly", "8astard": "bastard", "blöd3": "blöde", "id!0t": "idiot", "i-d-i-o-t": "idiot"}
    odd |= {"i  d  i  o  t": "idiot", "i\td\ti\to\tt": "idiot", "i\u00a0d\u00a0i\u00a0o\u00a0t": "idiot", "i-d i-o t": "idiot", "i_d i.o-t": "idiot", "(m 0 r 0 n)": "(moron)"}
    for seen, meant in odd.items():
        assert fix(f"the {seen} er") == f"the {meant} er"
        assert {fix.token(t) for t in fix.pieces(f"the {seen} er")} == {"the", meant, "er"}
    for plain in ("well! in the end", "the idiot's (rest)", "in 1999 er 20 30", "b2b", ""):
        assert fix(plain) == plain
    assert fix("you idiot! the h4te!!") == "you idiot! the hate!!"


def test_licences(spark, docs):
    rows = [(1, "plain words\nLicensed under the Apache License, Version 2.0.\nthing"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (4, ""), (5, "He lost his driving license last year"), (6, "und mit der zeit kam er an"), (7, "All rights reserved.")]
    model = licenses.fit(licenses.sample_lines(docs))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {k: r.family for k, r in got.items()} == {1: "apache", 2: "gpl", 5: "unknown", 6: "unknown", 7: "proprietary"}
    assert got[1].paragraph == 1 and got[1].confirmed and not got[5].confirmed
    for k, t in ((1, "Licensed under the Apache License, Version 2.0."), (5, rows[4][1])):
        assert got[k].probability == pytest.approx(max(model.probabilities(t).values()))


def test_wrapped_licences_and_version_spellings(spark, docs):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. Redistributions of source code must retain the above copyright notice."
    mit = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation\nfiles (the Software), to deal in the Software without restriction"
    gpl = "   This program is free software: you can redistribute it and/or modify\r\n   it under the terms of the GNU General Public License as published\r\n   by the Free Software Foundation, either version 3 of the License"
    rows = [(1, bsd), (2, f"plain words\n\n \n{mit}\n\nmore"), (3, gpl), (4, f"one line\nhere {mit}"), (5, "Released under the\nApache things he said")]
    rows += [(10, "Released under GPLv3"), (11, "AGPLv3"), (12, "licensed under LGPLv2.1"), (13, "gplvx is no word"), (14, "This is GPL3 code"), (15, "dedicated to the public domain under CC0 1.0 Universal")]
    model = licenses.fit(licenses.sample_lines(docs))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    wrapped = {r.doc_id: (r.paragraph, r.lines, r.family) for r in got if r.lines > 1}
    assert wrapped == {1: (0, 3, "bsd"), 2: (3, 3, "mit"), 4: (0, 4, "mit")}
    assert [r.paragraph for r in got if r.doc_id == 3 and r.confirmed] == [1]  # a line that names the licence
    assert all(r.confirmed for r in got if r.lines > 1)
    assert {r.doc_id: r.family for r in got if r.doc_id >= 10 and r.family != "unknown"} == {10: "gpl", 11: "agpl", 12: "lgpl", 14: "gpl", 15: "public-domain"}
    for r in got:
        if r.doc_id >= 10:
            assert r.probability == pytest.approx(max(model.probabilities(dict(rows)[r.doc_id]).values()))


def test_cross_parsing_equals_longest_matches(spark, docs):
    samples = {"a": ["the tone then", "another one"], "b": ["xyzzy plugh"]}
    parser = language.CrossParser(samples)
    found, _ = parser.phrases(["then the xyz"])
    for row, lang in enumerate(parser.languages):
        source = "".join(chr(65 + s) for t in samples[lang] for s in parser.symbols([t])[0])
        rest, n = "".join(chr(65 + s) for s in parser.symbols(["then the xyz"])[0]), 0
        while rest:
            k = 1
            while k < len(rest) and rest[: k + 1] in source and rest[:k] in source:
                k += 1
            rest, n = rest[k:], n + 1
        assert found[row, 0] == n
    got = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert got[60].lang_pred == "und" and got[62].lang_pred == "und" and len(got) == 67


def test_languages_of_any_script_are_learned_from_all_texts(spark):
    rng = random.Random(21)
    scripts = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзийклмнопрстуфхцчшщ", "el": "αβγδεζηθικλμνξοπρστυφχψω", "he": "אבגדהוזחטיכלמנסעפצקרשת", "zh": "".join(map(chr, range(0x4E00, 0x4E80))), "ja": "".join(map(chr, range(0x3041, 0x3090))), "ko": "".join(map(chr, range(0xAC00, 0xAC80)))}

    def words(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(n))

    rows = [(k * 1000 + i, words(v, 40), lang) for k, (lang, v) in enumerate(scripts.items()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs)).collect()}
    assert [got[i] for i, _, _ in rows] == [lang for _, _, lang in rows]

    # a third of the rows are one text, and what tells a text apart lies behind its first 2,000 characters
    a, b = scripts["en"][:13], scripts["en"][13:]
    head = words(scripts["en"], 600)
    rows = [(i, head if i % 3 == 0 else head[:2100] + " " + words(a, 30_000 // 4), "a") for i in range(30)]
    rows += [(100 + i, head[:2100] + " " + words(b, 30_000 // 4), "b") for i in range(30)]
    seen = []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language.CrossParser
    language.CrossParser = lambda samples: seen.append(samples) or made(samples)
    try:
        parser = language.train(docs)
    finally:
        language.CrossParser = made
    assert len(set(seen[0]["a"])) == len(seen[0]["a"]) > 10
    odd = spark.createDataFrame([(1000, words(a, 300)), (1001, words(b, 300))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(odd, parser).collect()} == {1000: "a", 1001: "b"}
    assert language.spread([np.arange(3), np.arange(100), np.arange(100)], 43) == [*range(3), *range(20), *range(20)]


def test_packing_fills_and_keeps_all(spark, docs):
    out = packing.pack(packing.pieces(docs, tokens.default_tokenizer(), capacity=256), 256).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in out)
    assert len(by) <= -(-total // 256) * 1.1 + 1
    assert packing.pack(packing.pieces(docs.limit(0), tokens.default_tokenizer())).count() == 0


def test_word_encoder_equals_whole_texts(docs):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokens.default_tokenizer())
    texts = [r.text or "" for r in docs.limit(30).collect()] + ["Straße Ünïcode 日本語 it's <|endoftext|> áb", "tab\tand space"]
    ids, counts = tokens.encoder(tokens.default_tokenizer()).encode(texts)
    want = [full.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_shards_round_trip(spark, docs):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted(sstable.token_shards(some, tokens.default_tokenizer()).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, d in zip(got, sorted(some.collect(), key=lambda r: r.doc_id)):
        ids, _ = tokens.encoder(tokens.default_tokenizer()).encode([d.text or ""], 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)


def test_files_are_read_back_by_several_tasks(spark):
    manifest = spark.createDataFrame([(f"/none/{i}", i, 5) for i in range(40)], "path string, shard long, ids long").repartition(1)
    assert sstable.read_shards(manifest).rdd.getNumPartitions() == min(40, 4 * spark.sparkContext.defaultParallelism)
    rows = [(f"/none/{i}", 0, 1, "k", None, 0, 0) for i in range(40)]
    index = spark.createDataFrame(rows, "path string, place long, size long, url_key string, captured timestamp, part long, seq long")
    assert warc.read_archives(index).rdd.getNumPartitions() == min(40, 4 * spark.sparkContext.defaultParallelism)


def test_archives(spark):
    import hashlib

    html = ["<p>" + "a" * 120, None, "", "<p>" + "a" * 120, "short", "short", "ü" * 60]
    got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")).collect()}
    assert [got[i].payload_digest for i in range(7)] == [hashlib.sha256((h or "").encode()).hexdigest() for h in html]
    assert got[3].refers_to == 0 and got[3].record_type == "revisit" and got[5].record_type == "response"


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    docs = [(i, text(rng, 60), "en", "s", 0) for i in range(120)]
    docs[5] = (5, docs[4][1], "en", "s", 0)
    leak = text(rng, 40)
    docs[9] = (9, docs[9][1] + " " + leak, "en", "s", 0)
    docs[11] = (11, "123 456", None, "s", 0)
    labels = [(i, 1, int(i % 5 == 0)) for i in range(20, 120)]
    docs = [(d[0], d[1] + (" moron idiot" if d[0] >= 20 and d[0] % 5 == 0 else ""), *d[2:]) for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not kept & {5, 9, 11} and not kept & {i for i in range(20, 120, 5)}
    assert kept == set(range(120)) - {5, 9, 11} - set(range(20, 120, 5))


def test_leaks_of_reordered_split_and_repeated_items_equal_brute_force(spark):
    rng = random.Random(31)
    items = [(i, text(rng, n)) for i, n in enumerate([40, 60, 80, 25, 16])]
    loop = text(rng, 8)
    items += [(7, " ".join([loop] * 6)), (7, text(rng, 30)), (8, items[3][1])]
    rows = []
    for k in range(24):
        own = items[k % 6][1].split()
        half = len(own) // 2
        middle = [own, own[half:] + own[:half], own[:half] + text(rng, 1).split() + own[half:], own[3:], own[:-3], own + own, own[: len(own) - len(own) // 10]][k % 7]
        rows.append((k, " ".join(text(rng, rng.randint(0, 12)).split() + middle + text(rng, rng.randint(0, 3)).split())))
    rows += [(50, loop), (51, " ".join([loop] * 40)), (52, rows[0][1]), (52, "other text"), (None, rows[1][1]), (53, None), (54, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k1": F.lit(1), "h": F.lit("x"), "item_id": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit("y"))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.contaminated(docs, bench).collect()}
    want = {}
    for d, t in rows:
        for i, it in items:
            for v in brute_leaks([(d, t)], [(i, it)]).values():
                want[d, i] = max(round(v, 9), want.get((d, i), 0))
    assert got == want and len(want) >= 20
    clean = decontam.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.text) for r in clean.collect()) == sorted(str(t) for d, t in rows if not any(brute_leaks([(d, t)], [(i, it)]) for i, it in items))
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 == decontam.contaminated(docs, bench.limit(0)).count()
    assert decontam.without_leaks(docs, bench.limit(0)).count() == len(rows)
