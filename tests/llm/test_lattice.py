"""Lattice scores of whole texts against sums over all spellings, and hostile rows."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from silva.llm import lattice


def spellings(word, names, byte, p):
    """The sum over all ways to spell the marked word; a character that is no piece is spelled in bytes."""
    word = lattice.MARK + word

    def ways(i):
        if i == len(word):
            return 1.0
        total = sum(p[names[word[i:j]]] * ways(j) for j in range(i + 1, len(word) + 1) if word[i:j] in names)
        if word[i] not in names:
            total += math.prod(p[byte[b]] for b in word[i].encode()) * ways(i + 1)
        return total

    return ways(0)


def flat(pairs):
    return [v for pair in pairs for v in pair]


def test_scores_equal_sums_over_all_spellings(spark):
    rng = random.Random(4)
    words = [rng.choice("the thing on er ha 日本 ÉTÉ x1".split()) + rng.choice(["", "ing", "s", "🙂"]) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), "k") for i in range(40)]
    rows += [(None, "no id here", "k"), (None, None, "k"), (3, "other", "k"), (3, "other", "k"), (50, "", "k"), (51, "never seen by any other", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").withColumns({"n": F.lit("x"), "row": F.lit(1)})
    model, rare = lattice.train(docs, lattice.default_vocabulary(), frequent=5)
    counts, ends = {}, 0
    for i, t, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10 != 0:
            ends += 1
            for w in lattice.tokens(t or ""):
                counts[w] = counts.get(w, 0) + 1
    assert model.total == sum(counts.values()) and model.distinct == len(counts)
    v = lattice.pieces(lattice.default_vocabulary())
    p = [math.exp(x) for x in model.score]
    assert sum(p) - p[v.end] == pytest.approx(1, abs=1e-9)
    assert p[v.end] + model.share + model.spelled * (sum(p) - p[v.end]) == pytest.approx(1, abs=1e-9)  # all that may come next
    log = {}
    for w in {w for _, t, _ in rows for w in lattice.tokens(t or "")}:
        log[w] = math.log10(model.share * counts.get(w, 0) / model.total + model.spelled * spellings(w.decode(), v.names, v.byte, p))
    want = sorted((-1 if i is None else i, round(sum(log[w] for w in lattice.tokens(t or "")) + math.log10(p[v.end]), 6)) for i, t, _ in rows)
    got = lattice.score(docs, model, rare).collect()
    assert flat(sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in got)) == pytest.approx(flat(want))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    base = math.log10(sum(counts.values()) + ends + 0.1 * (len(counts) + 2))
    end = math.log10(ends + 0.1) - base
    bases = sorted((-1 if i is None else i, round(sum(math.log10(counts.get(w, 0) + 0.1) - base for w in lattice.tokens(t or "")) + end, 6)) for i, t, _ in rows)
    assert flat(sorted((-1 if r.doc_id is None else r.doc_id, round(r.base_score, 6)) for r in got)) == pytest.approx(flat(bases))


def test_empty_table_and_long_words(spark):
    vocabulary = lattice.default_vocabulary()
    rows = [(i, "word " * 3 + w) for i, w in enumerate(["🙂" * 200, "ሰላም" * 60, "漢字" * 100, "a" * 20_000, "́" * 50])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lattice.score(docs, *lattice.train(docs, vocabulary)).collect()
    assert len(got) == 5 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    none = docs.limit(0)
    assert lattice.score(none, *lattice.train(none, vocabulary)).count() == 0
    assert all(math.isfinite(r.score) for r in lattice.score(docs, *lattice.train(none, vocabulary)).collect())
