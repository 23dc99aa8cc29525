"""WARC archives with a globally ordered capture index.

Each task writes one archive, its records sorted by URL key and capture time, and beside it the sorted run of its index rows,
in blocks. The runs are then merged externally: the index is cut into ranges of keys, and the task of a range reads those blocks of
all runs that reach into it, one block of each run at a time, and merges them with a loser tree. More than FAN runs are first merged
into longer ones, FAN at a time. So the whole index comes out in order of URL key, time and id, and no task holds more than FAN blocks.
Records are then read back from the archives by the places that the index names, each with its place in the global order.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import bound_batches, new_path, readers, stage

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
#: Join keys over which the copies of one payload are dealt.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of a block of a run, runs that one task merges at most, rows of a range.
BLOCK_ROWS, FAN, RANGE_ROWS = 512, 256, 200_000
#: First keys of blocks that cut the ranges at most; they balance the work and change no result.
SAMPLED = 4096

Row = tuple  # (url_key, captured in microseconds, page_id or -1 << 63, path, place, size)


class LoserTree:
    """Merges sorted iterators: inner nodes keep losers, so each step replays one path from a leaf to the root. Equal items come in the order of the runs."""

    def __init__(self, runs: list[Iterator[Row]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        one, two = self.heads[a], self.heads[b]
        return one is not None and (two is None or (one, a) < (two, b))

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.losers[node] < 0:  # still building: wait here for the other side
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[Row]:
        while self.k and (head := self.heads[self.losers[0]]) is not None:
            winner = self.losers[0]
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


class RunWriter:
    """A sorted run in a file: compressed blocks of rows, then their first keys and places, then where these begin."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.at, self.rows = out, 0, 0
        self.block: list[Row] = []
        self.index: list[tuple[Row, int, int]] = []

    def add(self, row: Row) -> None:
        self.block.append(row)
        self.rows += 1
        if len(self.block) == BLOCK_ROWS:
            self._flush()

    def _flush(self) -> None:
        data = zlib.compress(pickle.dumps(self.block, 5), 1)
        self.index.append((self.block[0][:3], self.at, len(data)))
        self.out.write(data)
        self.at += len(data)
        self.block = []

    def close(self) -> list[Row]:
        """The first keys of the blocks."""
        if self.block:
            self._flush()
        index = zlib.compress(pickle.dumps(self.index, 5), 1)
        self.out.write(index + struct.pack("<QQ", self.at, len(index)))
        self.out.close()
        return [x[0] for x in self.index]


def read_run(uri: str, low: Row | None, high: Row | None) -> Iterator[Row]:
    """The rows of a run from the key ``low`` on and before ``high``, a block at a time."""
    file = files.open_input(uri)
    end = file.size()
    file.seek(end - 16)
    at, size = struct.unpack("<QQ", file.read(16))
    file.seek(at)
    index = pickle.loads(zlib.decompress(file.read(size)))
    begin = 0 if low is None else max(0, bisect.bisect_left(index, (low,)) - 1)
    index = index[begin : len(index) if high is None else bisect.bisect_left(index, (high,))]
    for _, at, size in index:
        file.seek(at)
        for row in pickle.loads(zlib.decompress(file.read(size))):
            if (low is None or row[:3] >= low) and (high is None or row[:3] < high):
                yield row
    file.close()


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels in reverse, then path and query in lower case; scheme, www, port and fragment don't count. A null URL: empty."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")
    rest = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^#]*)", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)), F.lit(""))


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to (null for responses) to page_id, url, captured, html."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    same = known.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1 and first is not null")
    # every page has a salt; a digest with few copies has a row for each salt too, so one join serves both
    same = same.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))) if SALTS > 1 else same.withColumn("s", F.lit(0))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    both = known.join(same.select("d", "s", "first"), (known.payload_digest == F.col("d")) & (salt == F.col("s")), "left")
    return both.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("d", "s", "first", "many")


def record(page_id: int | None, url: str | None, captured, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>",
        f"WARC-Date: {captured:%Y-%m-%dT%H:%M:%SZ}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        *([f"Page-ID: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """The fields of one record: page_id, record_type, refers_to, url, payload (None for revisits), payload_bytes, payload_digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    whole = fields["WARC-Type"] == "response"
    ids = {k: int(fields[k]) if k in fields else None for k in ("Page-ID", "Refers-To-Page-ID")}
    return {
        "page_id": ids["Page-ID"], "record_type": fields["WARC-Type"], "refers_to": ids["Refers-To-Page-ID"], "url": fields.get("WARC-Target-URI"), "payload": payload if whole else None,
        "payload_bytes": len(payload) if whole else said, "payload_digest": hashlib.sha256(payload).hexdigest() if whole else fields["WARC-Payload-Digest"][7:],
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, captured, html; all but captured may be null) as archives under ``folder``, a sorted run of index rows beside each; returns a row per run: run (its path), rows, keys (the first keys of its blocks).

    A null html is an empty payload, a null URL leaves the target out, a null id is never referred to. Repeated ids are separate records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at, index = "", None, 0, None
        for batch in batches:
            if out is None and batch.num_rows:
                uri, out = files.create(folder, "pages", ".warc.gz")
                name, file = files.create(folder, "pages", ".cdx")
                index = RunWriter(file)
            for k in range(batch.num_rows):  # a row at a time: pages may be long
                (r,) = batch.slice(k, 1).to_pylist()
                data = record(r["page_id"], r["url"], r["captured"], (r["html"] or "").encode("utf-8", "replace"), r["payload_digest"], r["refers_to"])
                out.write(data)
                index.add((r["url_key"], r["at"], _NO_ID if r["page_id"] is None else r["page_id"], uri, at, len(data)))
                at += len(data)
        if out is not None:
            out.close()
            keys = index.close()
            yield _run_rows([(name, index.rows, keys)])

    bound_batches(pages.sparkSession)
    rows = with_revisits(pages.select("page_id", "url", "captured", "html")).withColumns({"url_key": url_key(F.col("url")), "at": F.unix_micros("captured")})
    rows = rows.select("page_id", "url", "captured", "html", "payload_digest", "refers_to", "url_key", "at").sortWithinPartitions("url_key", "captured", "page_id")
    return stage(rows.mapInArrow(run, _RUNS), "captures")


_NO_ID = -(1 << 63)  # nulls come first
_RUNS = "run string, rows long, keys array<struct<k:string,t:long,p:long>>"


def _run_rows(found: list[tuple[str, int, list[Row]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("k", pa.string()), ("t", pa.int64()), ("p", pa.int64())]))
    keys = [[dict(zip("ktp", key)) for key in own] for _, _, own in found]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array(keys, kind)], ["run", "rows", "keys"])


def _longer_runs(runs: DataFrame, folder: str, fan: int) -> DataFrame:
    """Runs merged ``fan`` at a time, each group by one task that streams."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                name, file = files.create(folder, f"merged-{uuid.uuid4().hex}", ".cdx")
                out = RunWriter(file)
                for row in LoserTree([read_run(uri, None, None) for uri in own]):
                    out.add(row)
                keys = out.close()
                yield _run_rows([(name, out.rows, keys)])

    number = F.floor((F.row_number().over(Window.orderBy("run")) - 1) / fan)  # a row per run: few
    groups = runs.select("run", number.alias("g")).groupBy("g").agg(F.sort_array(F.collect_list("run")).alias("own"))
    return stage(groups.repartition(readers(runs.sparkSession, -(-runs.count() // fan)), "g").select("own").mapInArrow(merge, _RUNS), "longer")


def merge_runs(runs: DataFrame, folder: str, fan: int = FAN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All index rows in global order: url_key, captured, page_id, path, place, size, part (range of keys) and seq (place in it, from 0)."""
    spark = runs.sparkSession
    many, total = runs.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    while many > fan:
        runs = _longer_runs(runs, folder, fan)
        many = runs.count()
    # cut at first keys of blocks: a sample of bounded size, dealt by hash
    blocks = runs.select(F.explode("keys").alias("x")).select("x.k", "x.t", "x.p").distinct()
    sample = sorted(tuple(r) for r in blocks.orderBy(F.xxhash64("k", "t", "p"), "k", "t", "p").limit(SAMPLED).collect())
    ranges = min(len(sample), max(1, -(-total // range_rows), min(len(sample), spark.sparkContext.defaultParallelism)))
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if ranges else []
    bounds = list(zip([None, *cuts], [*cuts, None]))
    names = [r.run for r in runs.select("run").orderBy("run").collect()]  # FAN at most

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)]
            columns[2] = [None if i == _NO_ID else i for i in columns[2]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["url_key", "captured", "page_id", "path", "place", "size", "seq", "part"])

        for batch in batches:
            for part in batch.column(0).to_pylist():
                made = []
                for seq, row in enumerate(LoserTree([read_run(uri, *bounds[part]) for uri in names])):
                    made.append((*row, seq, part))
                    if len(made) == 10_000:
                        yield table(made)
                        made = []
                if made:
                    yield table(made)

    parts = spark.range(0, len(bounds) if names else 0, 1, max(1, len(bounds)))
    return parts.mapInArrow(merge, "url_key string, captured timestamp, page_id long, path string, place long, size long, seq long, part long")


def read_archives(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, read from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, capture_order (place in the whole history, from 0)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            found = []
            for path, place, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != uri:
                    uri, file = path, files.open_input(path)
                file.seek(place)
                got = parse(file.read(size))
                found.append([got[k] for k in names])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*found), kinds)] if found else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(i) for i in range(3, 6))], [*names, "url_key", "captured", "capture_order"])

    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = index.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row per range
    rows = index.join(F.broadcast(starts), "part").select("path", "place", "size", "url_key", "captured", (F.col("before") + F.col("seq")).alias("capture_order"))
    rows = rows.repartition(readers(index.sparkSession, index.select("path").distinct().count()), "path").sortWithinPartitions("path", "place")
    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured timestamp, capture_order long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write page_id, url, html to archives in the shared folder, merge their indexes, and read all records back: page_id, payload_bytes (of the whole payload), payload_digest (SHA-256 of it), record_type, refers_to, url_key, captured, capture_order.

    Pages carry no capture time; the id counts as seconds after a fixed moment. A null html is an empty payload. Rows that share an id are records of their own; of equal payloads with
    the smallest id all with that id are responses, and pages without an id revisit it. Payloads that only pages without an id hold are all responses. Other columns are ignored. Empty table: no rows.
    """
    captured = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31)))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), F.col("html")).withColumn("captured", captured)
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(stage(merge_runs(write_archives(rows, folder), folder), "index"))
