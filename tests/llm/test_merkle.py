"""The manifest against a plain one, proofs, exact ranks, hostile rows."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from silva.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        i //= 3
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            now = leaf((*r[:4], r[4].replace("\n", ""))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None else leaf(r)
            for a, b in steps:
                now = h(a, now, b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(a + b for a, b in steps)), now, now == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def by_all(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_equals_a_plain_manifest(spark):
    rng = random.Random(1)
    ids = [rng.choice([k, k - 500, k << 40, -(k << 50), (k << 20) + 7]) for k in range(900)]  # dense, negative, far apart; some repeat
    rows = [(i, "big" if rng.random() < 0.9 else rng.choice(["a", "", None, "Ä", "=", "z"]), rng.choice(["en", None]), i % 9, rng.choice(["one\ntwo", "plain", "", None, "\n\n"])) for i in ids]
    rows += [(None, "big", None, None, f"text {k}\n") for k in range(40)] + [(5, "big", "en", 1, "same\n")] * 30 + [(6, None, None, None, None), (9, "lone", "en", 3, "x" * 200_000 + "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "_rank": F.lit("x"), "_n": F.lit(2)})
    got = merkle.manifest(docs)
    assert got.columns == COLUMNS
    assert by_all(got.collect()) == by_all(plain(rows))


def test_one_row_and_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(4, None, "en", 3, "a\nb")]
    docs = spark.createDataFrame(one, schema)
    assert by_all(merkle.manifest(docs).collect()) == by_all(plain(one))
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_ranks_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(-9, 9), 1 << rng.randint(0, 62)]), f"{rng.getrandbits(64):016x}") for _ in range(2000)]
    got = merkle.group_ranks(spark.createDataFrame(rows, "g string, k long, l string"), "g", "k", "l", "place").collect()
    for g in "abc":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(own))) and {r._n for r in mine} == {len(own)}
        assert [(r.k, r.l) for r in mine] == [r[1:] for r in own]


def test_blocks_of_several_levels(spark):
    nodes = [h(str(k)) for k in range(500)]
    leaves = spark.createDataFrame([("g", k, x, 500) for k, x in enumerate(nodes)] + [("one", 0, h("one"), 1)], "g string, _rank long, _hash string, _n long")
    found, roots = merkle.trie(leaves, "g", levels=2)
    assert len(found) == 3 and {r.g: r._hash for r in roots.collect()} == {"g": tree(nodes)[-1][0], "one": h("one")}
    above = roots.select("g", F.array().cast("array<struct<left:string,right:string>>").alias("_path"))
    got = {(r.g, r._rank): [tuple(s) for s in r._path] for r in merkle.proofs(found, "g", above, levels=2).collect()}
    assert got == {("g", k): path(tree(nodes), k) for k in range(500)} | {("one", 0): []}
