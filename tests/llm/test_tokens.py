"""Token shards and packing: files, look-ups, round trips, hostile rows, bins against other ways of packing."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from silva.llm import packing, sstable, tokens

PATH = tokens.default_tokenizer()


def whole(texts, end):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(PATH)
    return [[*full.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def hostile(spark):
    rows = [(3, "some words"), (3, "other words"), (3, "some words"), (None, "no id"), (None, None), (-5, ""), (9, None), (10, "long " * 9000), (2**40, "Ünïcode 日本語 it's")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "piece": F.lit("x"), "_id": F.lit(0), "part": F.lit(2)})


def test_shards_of_hostile_rows(spark):
    rows, docs = hostile(spark)
    got = sstable.token_shards(docs, PATH).collect()
    want = sorted((d if d is not None else -(2**63), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, whole([t for _, t in rows], 2)))
    assert sorted((r.doc_id if r.doc_id is not None else -(2**63), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == sorted(by_start, key=lambda i: (i is not None, i or 0))
    assert sstable.token_shards(docs.limit(0), PATH).count() == 0


def test_single_keys_are_found_by_filter_index_and_block(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    import pyarrow.fs as fs

    uri = str(tmp_path / "a.sst")
    rng = np.random.default_rng(1)
    keys = [None, *sorted({int(k) for k in rng.integers(-(2**62), 2**62, 300)} | {0, -1, 1})]
    keys = [keys[0], *[k for k in keys[1:] for _ in range(3 if k == 0 else 1)]]  # one key fills more than a block
    ids = [rng.integers(0, 49_000, int(rng.integers(1, 90))).astype(np.uint32) for _ in keys]
    writer = sstable.Writer(fs.LocalFileSystem().open_output_stream(uri, compression=None), 2)
    for k, own in zip(keys, ids):
        writer.add(sstable.key_of(k), own)
    writer.close()
    reader = sstable.Reader(uri)
    assert len(reader.index) > 20 and [x[0] for x in reader.index] == sorted(x[0] for x in reader.index)
    first = {}
    for k, own in zip(keys, ids):
        first.setdefault(k, own)
    for k, own in first.items():
        assert reader.get(k).tolist() == own.tolist()
    absent = [int(k) for k in rng.integers(-(2**62), 2**62, 2000) if int(k) not in first]
    assert all(reader.get(k) is None for k in absent)
    passed = sum(all(reader.bloom[b >> 3] >> (7 - (b & 7)) & 1 for b in sstable._bloom_bits(sstable.key_of(k), reader.bits, reader.hashes)) for k in absent)
    assert passed < 0.03 * len(absent)
    assert [(sstable.id_of(k), i.tolist()) for k, i in reader.scan()] == [(k, i.tolist()) for k, i in zip(keys, ids)]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, counts = tokens.WordEncoder(path).encode(["two words here", "", "it's  odd"], 7)
    want = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 7] for t in ("two words here", "", "it's  odd")]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_pieces_and_places_of_hostile_rows(spark):
    rows, docs = hostile(spark)
    got = packing.pack(packing.pieces(docs, PATH, capacity=64), 64).collect()
    want = []
    for (d, _), ids in zip(rows, whole([t for _, t in rows], 0)):
        for k, start in enumerate(range(0, len(ids), 64)):
            own = ids[start : start + 64]
            want.append((d, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def test_evolution_beats_best_fit_on_hard_lengths():
    rng = random.Random(0)
    for low, high, gain in ((500, 900, 0.05), (300, 700, 0.01)):
        lengths = [rng.randint(low, high) for _ in range(900)]
        plain = packing.best_fit(sorted(range(900), key=lambda i: -lengths[i]), lengths, [], 2048)
        found = packing.evolve(lengths, [], 1, 2048)
        assert sorted(i for own in found for i in own) == list(range(900)) and all(sum(lengths[i] for i in own) <= 2048 for own in found)
        assert -(-sum(lengths) // 2048) <= len(found) <= (1 - gain) * len(plain)
    assert packing.evolve([], [], 1, 2048) == [] and packing.evolve([2048] * 3, [], 1, 2048) == [[0], [1], [2]]


def test_crossover_keeps_every_piece_once():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(80)]
    order = list(range(80))
    one = packing.best_fit(order, lengths, [], 128)
    rng.shuffle(order)
    two = packing.best_fit(order, lengths, [], 128)
    for _ in range(20):
        child = packing.crossover(one, two, lengths, 128, rng)
        assert sorted(i for own in child for i in own) == list(range(80)) and all(sum(lengths[i] for i in own) <= 128 for own in child)
        one, two = two, child


def test_rows_of_one_id_are_spread_over_files(spark, tmp_path):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = sstable.write_shards(docs, f"{tmp_path}/hot", tokens.default_tokenizer()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.docs for r in made]
    assert sum(sizes) == 20_000 and len(sizes) > 1 and max(sizes) < 12_000
