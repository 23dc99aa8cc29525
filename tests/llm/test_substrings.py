"""Substring dedup against brute force: copies, common phrases, crowded buckets, long and hostile texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silva.llm import substrings


def plain(rows, wide=20):
    texts = {(i, t) for i, t in rows}
    first = {}
    for i, t in texts:
        w = (t or "").encode().split()
        for at in range(len(w) - wide + 1):
            key, place = tuple(w[at : at + wide]), (i is not None, i or 0, at)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for at in range(len(w) - wide + 1):
            if first[tuple(w[at : at + wide])] < (i is not None, i or 0, at):
                gone.update(range(at, at + wide))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def by_all(rows):
    return sorted(map(tuple, rows), key=str)


def corpus(rng):
    names = [f"{a}{b}" for a in "bcdfghklm" for b in ("a", "e", "iö", "o", "U")]
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    passages, line = [say(rng.randint(21, 70)) for _ in range(6)], say(12)
    rows = []
    for i in range(160):
        parts = [say(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice([*passages, line, line]), say(rng.randint(0, 25))]
        rows.append((i - 20, rng.choice([" ", "\n", "\t ", "\x0b\x0c\r "]).join(parts)))
    rows += [(500, "same " * 300), (501, "a b " * 100), (502, "same " * 19), (503, "same " * 20), (None, passages[0]), (None, "x " + passages[0]), (504, None), (505, ""), (506, " \n\t")]
    rows += [(507, passages[1])] * 4 + [(507, "other " + passages[1])]  # rows that share an id
    rows += [(508, "nbsp\xa0joined \x1fsign\x85 " + passages[2] + " " + passages[2]), (509, "w" * 5000 + " " + "v" * 70_000 + " " + passages[3])]
    return rows


@pytest.mark.parametrize("crowd", [substrings.CROWD, 3])
def test_equals_brute_force(spark, crowd):
    rows = corpus(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "text_hash": F.lit(1), "n": F.lit(2), "start": F.lit(3)})
    got = substrings.remove_repeats(docs.repartition(5), crowd=crowd).collect()
    want = plain(rows)
    assert by_all(got) == by_all(want) and sum(r[2] for r in want) > 2000


def test_crowded_buckets_end_in_small_batches(spark):
    rng = random.Random(8)
    names = [f"w{k}" for k in range(400)]
    line = " ".join(f"l{k}" for k in range(18))
    rows = [(i, " ".join(rng.choice(names) for _ in range(8)) + f" {line} " + " ".join(rng.choice(names[:3]) for _ in range(8))) for i in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert by_all(got) == by_all(plain(rows))


def test_long_texts_go_in_pieces():
    rng = random.Random(9)
    text = " ".join(rng.choice(["a", "bb", "ccc", "d" * 40]) + str(rng.randint(0, 50)) for _ in range(3000)).encode()
    book = sorted({w for w in text.split() if len(w) < 5})

    def windows(packer):
        out = {}
        for piece in packer.pieces([b"short one", text, b""]):
            for row, start, n, _, _, packed in zip(*packer.supers(piece)):
                bucket = substrings._Bucket(*[np.array([v]) for v in (0, 0, 0, start, n)], [packed])
                for at, a, b in zip(*substrings._windows(bucket, 20)[1:]):
                    out[int(row), int(start + at)] = (int(a), int(b))
        return out

    whole, cut = windows(substrings.Packer(book)), windows(substrings.Packer(book, pass_bytes=2000))
    assert whole == cut and len(whole) == 3000 - 19


def test_codebook_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a a b b b " + "z" * 40 + " " + "z" * 40), (2, "c")], "doc_id long, text string")
    assert substrings.codebook(docs) == [b"a", b"b"]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
