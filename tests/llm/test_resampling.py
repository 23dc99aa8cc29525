"""Importance resampling against a plain computation, hostile rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from silva.llm import resampling


def plain(rows, target):
    """{(id, text): (n_features, weight, score, n_words)} and the draw in order."""

    def words(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))

    def buckets(t):
        w = words(t)
        return [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s = Counter(b for _, t in rows for b in buckets(t))
    g = Counter(b for t in target for b in buckets(t))
    sa, ta = sum(s.values()) + 10_000, sum(g.values()) + 10_000
    out = []
    for i, t in rows:
        own = buckets(t)
        weight = sum(math.floor(1000 * math.log((g[b] + 1) * sa / ((s[b] + 1) * ta))) for b in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t))))
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, fit[: 5 * len(fit) // 100]


def test_equals_a_plain_computation(spark):
    stems = "alpha Beta gamma ÉTÉ 日本 x9 delta".split()
    rows = [(i, " ".join(stems[(i * k + k * k) % 7] for k in range(i % 60))) for i in range(150)]
    rows += [(7, "again " * 30), (7, "again " * 30), (None, None), (None, "no id " * 15), (None, "no id " * 15), (200, ""), (201, " .,!-- \x00\n"), (202, "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "_buckets": F.lit(1), "b": F.lit(2)})
    target = [stems[0] + " " + stems[3], None, "", "again again"]
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want, drawn = plain(rows, target)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got], key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and len(drawn) > 3
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in drawn]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 25)] * 30, "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resample(none, none.select("text")).count() == 0
    got = resampling.resample(docs, none.select("text")).collect()
    assert len(got) == 30 and [r["rank"] for r in got if r["rank"]] == [1]  # 30 rows that are alike
