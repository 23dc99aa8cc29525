"""Archives: the loser tree, the external merge and its order, hostile rows."""

import hashlib
import random

from silva.llm import files, warc


def test_loser_tree_merges_as_sorting_does():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_runs_are_read_by_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ROWS", 4)
    rng = random.Random(2)
    rows = sorted((rng.choice("abcd"), rng.randint(0, 5), rng.randint(0, 3), "p", i, 1) for i in range(60))
    uri, out = files.create(str(tmp_path), "run", ".cdx")
    writer = warc.RunWriter(out)
    for r in rows:
        writer.add(r)
    keys = writer.close()
    assert keys == [r[:3] for r in rows[::4]]
    cuts = [None, *sorted({r[:3] for r in rows})[::5], None]
    assert [r for a, b in zip(cuts, cuts[1:]) for r in warc.read_run(uri, a, b)] == rows
    assert list(warc.read_run(uri, ("zz", 0, 0), None)) == []


def pages(spark):
    rng = random.Random(3)
    long = ["<p>" + w * 60 for w in ("ab", "cd", "ef", "gh")]
    rows = [(i, rng.choice([f"http://www.Host{i % 7}.org:80/P{i % 5}?q={i}#f", f"https://u@a.b{i % 3}.net", None, "", "no url\nat all"]), rng.choice([*long, None, "", "short", "ü" * 60])) for i in range(200)]
    rows += [(5, "http://x/", rows[5][2]), (7, "http://y/", long[0]), (None, "http://z/", long[1]), (None, None, None), (None, "http://n/", "only without an id " * 9), (None, "http://n/", "only without an id " * 9)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_index_is_in_global_order_however_it_is_merged(spark, monkeypatch):
    rows, table = pages(spark)
    captured = "timestamp_seconds(1700000000 + coalesce(page_id, 0) % 50)"
    seen = []
    monkeypatch.setattr(warc, "with_revisits", lambda pages: pages.selectExpr("*", "'x' AS payload_digest", "cast(null AS long) AS refers_to").repartition(7))
    monkeypatch.setattr(warc, "BLOCK_ROWS", 8)
    for fan, most in ((256, 200_000), (2, 9), (3, 40)):
        folder = warc.new_path(spark, "test")
        runs = warc.write_archives(table.selectExpr("page_id", "url", "html", f"{captured} AS captured"), folder)
        assert runs.count() > 3
        index = warc.merge_runs(runs, folder, fan, most)
        got = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in index.orderBy("part", "seq").collect()]
        assert got == sorted(got) and len(got) == len(rows)
        assert (index.select("part").distinct().count() > 1) == (most < 200) or most > 1000
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]


def test_archives_of_hostile_rows(spark):
    rows, table = pages(spark)
    odd = table.selectExpr("*", "1 AS payload_bytes", "'x' AS captured", "2 AS first", "3 AS d")
    got = warc.archive_pages(odd).collect()
    payload = {}
    for i, _, h in rows:
        payload.setdefault(h or "", []).append(i)
    first = {h: min((i for i in own if i is not None), default=None) for h, own in payload.items()}
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first[h or ""] is not None and i != first[h or ""]
        want.append((-1 if i is None else i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else -1))
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == sorted(want)
    assert sorted(r.capture_order for r in got) == list(range(len(rows)))
    order = sorted(got, key=lambda r: r.capture_order)
    assert [r.url_key for r in order] == sorted(r.url_key for r in order)
    assert warc.archive_pages(odd.limit(0)).count() == 0
