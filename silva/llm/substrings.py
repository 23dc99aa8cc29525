"""Substring dedup: words of passages that occur earlier in the corpus are removed, by super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash of the runs of ``RUN`` words inside it, so equal windows have
equal minimisers, and so have most neighbours: consecutive windows whose minimiser stands at one place travel as one packed string, a super-k-mer, to the
bucket of that minimiser. There they are sorted; equal strings follow each other, and of all but the first every window has occurred before. The
windows of different strings are hashed to 128 bits and sorted, so each is compared with the first of its kind.

Strings are packed: half a byte a word says what it is, a frequent word (two bytes of a codebook), one spelled out, or one of 15 bytes or more (a digest of 128 bits). A task removes
copies of a string among 16 MB of texts before the shuffle, so a passage that very many texts hold sends one string for them all. A bucket that many different strings share (a common phrase, each time between other words) lets its
windows go on alone, by their own hashes, so no task holds a whole bucket. Nothing is left out either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_stages, freed_shuffles, mix64, stage

WINDOW, RUN = 20, 5
#: Frequent words that get a code of 15 bits, and the longest of them in bytes.
CODES, CODED_BYTES = 32_766, 32
#: Bytes of text in one numpy pass; a longer text goes in pieces that overlap by a window less a word.
PASS_BYTES = 1 << 20
#: Different strings of one bucket that a task holds; the windows of a bucket with more go on alone.
CROWD = 4096
#: Bytes of text among which a task removes copies, and rows of what it hands on at once.
COPY_BYTES, ROWS = 16 << 20, 20_000
#: An id for null, below all others.
NO_ID = -(1 << 63)
#: What half a byte says of a word: 0 a code, else its length, 15 a digest; and the bytes that follow.
_LONG = 15
_BYTES = np.array([2, *range(1, _LONG), 16])
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SUPERS = "minimiser long, id long, text_hash long, start int, n int, packed binary"
FOUND = "id long, text_hash long, start int, stop int, h1 long, h2 long"


def codebook(docs: DataFrame, text_col: str = "text") -> list[bytes]:
    """The most frequent words of all texts, CODES at most; where too many are equally frequent, those are left out together.

    The codebook only shortens strings. Words are counted before the shuffle, and a histogram of the counts gives the least count, so nothing is ranked in one task.
    """
    words = docs.select(F.explode_outer(F.split(text_col, r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''").where(F.octet_length("w") <= CODED_BYTES)
    with freed_shuffles(docs.sparkSession):
        counts = stage(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"), "words")
    sizes = counts.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()  # 1,000 rows at most
    total, least = 0, None
    for r in sizes:
        total += r.kinds
        if total > CODES:
            break
        least = r.least
    book = [] if least is None else [r.w.encode() for r in counts.where(F.col("n") >= least).select("w").collect()]
    drop_stages(counts)
    return sorted(book)


class _Hash:
    """Hashes of all slices of an array of small numbers, from one pass over it: a polynomial over 64 bits, whose terms are mixed."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.table = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(seed))
        self.powers = self.back = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("back", self.inverse)):
                made = np.full(n, base, dtype=np.uint64)
                made[0] = 1
                setattr(self, name, np.cumprod(made, out=made))

    def sums(self, terms: np.ndarray) -> np.ndarray:
        n = len(terms)
        self.grow(n + 1)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.powers[:n] * terms, out=out[1:])
        return out

    def slices(self, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix64((sums[stops] - sums[starts]) * self.back[starts] + (stops - starts).astype(np.uint64))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Packer:
    """Super-k-mers of texts."""

    def __init__(self, book: list[bytes], window: int = WINDOW, run: int = RUN, pass_bytes: int = PASS_BYTES):
        self.window, self.run, self.pass_bytes = window, run, pass_bytes
        self.bytes, self.units = _Hash(0x5851F42D4C957F2D, 1), _Hash(0xD1342543DE82EF95, 2)
        raw = np.frombuffer(b" ".join([*book, b""]), dtype=np.uint8)
        _, _, hashes = self._words(raw)
        order = np.argsort(hashes, kind="stable")
        self.known, self.codes = hashes[order], order.astype(np.uint16)

    def _words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, stops = _runs(~_SPACE[raw])
        return starts, stops, self.bytes.slices(self.bytes.sums(self.bytes.table[raw]), starts, stops)

    def pieces(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Lists of (row, words before, bytes) of about ``pass_bytes``; a longer text is cut between words, and pieces overlap."""
        held, size = [], 0
        for row, text in enumerate(texts):
            at, before, step = 0, 0, self.pass_bytes
            while len(text) - at > step:
                stop = at + step
                while stop < len(text) and not _SPACE[text[stop]]:
                    stop += 1
                piece = text[at:stop]
                starts, _ = _runs(~_SPACE[np.frombuffer(piece, dtype=np.uint8)])
                if len(starts) < 2 * self.window:  # very long words
                    step *= 2
                    continue
                yield [(row, before, piece)]
                again = len(starts) - (self.window - 1)
                at, before, step = at + int(starts[again]), before + again, self.pass_bytes
            rest = text[at:] if at else text
            if held and size + len(rest) > self.pass_bytes:
                yield held
                held, size = [], 0
            held.append((row, before, rest))
            size += len(rest) + 1
        if held:
            yield held

    def supers(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        """Of all runs of windows that share the place of their minimiser: row, first word, count of windows, minimiser, hash of its words, packed string."""
        raw = np.frombuffer(b"\n".join([*(p[2] for p in pieces), b""]), dtype=np.uint8)
        starts, stops, words = self._words(raw)
        many, wide = len(words), self.window
        if many < wide:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64), []
        ends = np.cumsum([len(p[2]) + 1 for p in pieces])
        first = np.concatenate(([0], np.searchsorted(starts, ends)))
        piece_of = np.repeat(np.arange(len(pieces)), np.diff(first))
        grams = np.zeros(many - self.run + 1, dtype=np.uint64)
        for j in range(self.run):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : many - self.run + 1 + j]
        least, place, span = mix64(grams), np.arange(len(grams)), 1
        while span < wide - self.run + 1:  # the leftmost least of ever longer spans
            hop = min(span, wide - self.run + 1 - span)
            left = least[:-hop] <= least[hop:]
            least, place = np.where(left, least[:-hop], least[hop:]), np.where(left, place[:-hop], place[hop:])
            span += hop
        inside = piece_of[: many - wide + 1] == piece_of[wide - 1 :]
        begin = inside & np.concatenate(([True], ~inside[:-1] | (place[1:] != place[:-1])))
        head = np.flatnonzero(begin)
        after = np.flatnonzero(begin | ~inside)
        following = np.searchsorted(after, head, "right")
        n = np.concatenate((after, [len(inside)]))[following] - head
        whole = self.units.slices(self.units.sums(words), head, head + n + (wide - 1))
        strings = self.packed(raw, starts, stops, words, head, n + (wide - 1))
        piece = piece_of[head]
        rows, before = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
        return rows[piece], head - first[piece] + before[piece], n, least[head], whole, strings

    def packed(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, words: np.ndarray, head: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The packed strings of ``n`` words from each of ``head``: half bytes that say what the words are, then their bytes."""
        size = stops - starts
        kind = np.minimum(size, _LONG)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
            coded = np.flatnonzero(self.known[at] == words)
            kind[coded] = 0
        offsets = np.concatenate(([0], np.cumsum(_BYTES[kind])))
        body = np.zeros(offsets[-1], dtype=np.uint8)
        if len(self.known):
            body[offsets[coded]], body[offsets[coded] + 1] = self.codes[at[coded]] >> 8, self.codes[at[coded]] & 255
        spelled = np.flatnonzero((kind > 0) & (kind < _LONG))
        nth = np.arange(size[spelled].sum()) - np.repeat(np.cumsum(size[spelled]) - size[spelled], size[spelled])
        body[np.repeat(offsets[spelled], size[spelled]) + nth] = raw[np.repeat(starts[spelled], size[spelled]) + nth]
        long = np.flatnonzero(kind == _LONG)
        digests = b"".join(hashlib.blake2b(raw[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts[long].tolist(), stops[long].tolist()))
        body[offsets[long][:, None] + np.arange(16)] = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16)
        even = n + (n & 1)
        flat = np.zeros(even.sum(), dtype=np.uint8)
        into = np.cumsum(even) - even
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat(into, n) + nth] = kind[np.repeat(head, n) + nth]
        kinds, blob = (flat[0::2] << 4 | flat[1::2]).tobytes(), body.tobytes()
        return [kinds[a:b] + blob[c:d] for a, b, c, d in zip((into // 2).tolist(), ((into + even) // 2).tolist(), offsets[head].tolist(), offsets[head + n].tolist())]


def _later(ids: np.ndarray, starts: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which rows have an equal key with a smaller (id, start)."""
    order = np.lexsort((starts, ids, *keys))
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), dtype=bool)
    out[order] = (ids[head] != ids[order]) | (starts[head] != starts[order])
    return out


def _split(batches: Iterator[pa.RecordBatch], packer: Packer) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        for piece in packer.pieces(texts):
            row, *rest = packer.supers(piece)
            held.append((batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], *rest))
            size += sum(len(p[2]) for p in piece)
            if size >= COPY_BYTES:
                yield from _shipped(held, packer.window)
                held, size = [], 0
    if held:
        yield from _shipped(held, packer.window)


def _shipped(parts: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """Strings of texts on their way to the buckets; of copies only the first, and the place of the others."""
    ids, hashes, start, n, minimiser, whole = (np.concatenate([p[k] for p in parts]) for k in range(6))
    strings = [s for p in parts for s in p[6]]
    gone = _later(ids, start, minimiser, whole)
    place = np.where(gone, hashes, minimiser.view(np.int64))  # what is found already travels with the rest, to any task
    columns = [place, ids, hashes, start.astype(np.int32), np.where(gone, n + window - 1, n).astype(np.int32)]
    sent = pa.array([None if g else s for g, s in zip(gone.tolist(), strings)], pa.binary())
    made = pa.RecordBatch.from_arrays([*map(pa.array, columns), sent], ["minimiser", "id", "text_hash", "start", "n", "packed"])
    for at in range(0, made.num_rows, ROWS):
        yield made.slice(at, ROWS)


class _Bucket:
    """Different strings of buckets, as arrays."""

    def __init__(self, minimiser: np.ndarray, ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, n: np.ndarray, strings: list[bytes]):
        self.columns, self.strings = (minimiser, ids, hashes, start, n), strings

    def take(self, at: np.ndarray) -> _Bucket:
        return _Bucket(*[c[at] for c in self.columns], [self.strings[k] for k in at.tolist()])

    def __len__(self) -> int:
        return len(self.strings)

    @staticmethod
    def join(parts: list[_Bucket]) -> _Bucket:
        return _Bucket(*[np.concatenate(c) for c in zip(*[p.columns for p in parts])], [s for p in parts for s in p.strings])


_TWO = _Hash(0x5851F42D4C957F2D, 11), _Hash(0xD1342543DE82EF95, 12)


def _windows(strings: _Bucket, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: the string, its place there, and two hashes."""
    n = strings.columns[4].astype(np.int64)
    words = n + window - 1
    heads = (words + 1) // 2
    raw = np.frombuffer(b"".join(strings.strings), dtype=np.uint8)
    size = np.array([len(s) for s in strings.strings])
    base = np.cumsum(size) - size
    nth = np.arange(heads.sum()) - np.repeat(np.cumsum(heads) - heads, heads)
    both = raw[np.repeat(base, heads) + nth]
    halves = np.stack((both >> 4, both & 15), axis=1).ravel()
    kind = halves[np.arange(2 * heads.sum()) - np.repeat(2 * (np.cumsum(heads) - heads), 2 * heads) < np.repeat(words, 2 * heads)].astype(np.int64)
    before = np.cumsum(_BYTES[kind]) - _BYTES[kind]  # bytes of all words before
    first = np.cumsum(words) - words
    starts = before - np.repeat(before[first], words) + np.repeat(base + heads, words)
    owner = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = first[owner] + nth
    found = []
    for h in _TWO:
        word = mix64(h.slices(h.sums(h.table[raw]), starts, starts + _BYTES[kind]) + kind.astype(np.uint64))
        found.append(h.slices(h.sums(word), at, at + window))
    return owner, nth, *found


def _ranges(ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), none, none], ["id", "text_hash", "start", "stop", "h1", "h2"])


def _compared(strings: _Bucket, window: int) -> pa.RecordBatch:
    """Ranges of words that later windows cover, of buckets that are whole here."""
    owner, nth, h1, h2 = _windows(strings, window)
    _, ids, hashes, start, _ = strings.columns
    later = _later(ids[owner], start[owner] + nth, h2, h1)
    begin = later & np.concatenate(([True], ~later[:-1] | (owner[1:] != owner[:-1])))
    end = later & np.concatenate((~later[1:] | (owner[1:] != owner[:-1]), [True]))
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    own = owner[a]
    return _ranges(ids[own], hashes[own], start[own] + nth[a], start[own] + nth[b] + window)


def _loose(strings: _Bucket, window: int) -> pa.RecordBatch:
    """All windows on their own."""
    owner, nth, h1, h2 = _windows(strings, window)
    _, ids, hashes, start, _ = strings.columns
    at = (start[owner] + nth).astype(np.int32)
    columns = [ids[owner], hashes[owner], at, at + np.int32(window), h1.view(np.int64), h2.view(np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["id", "text_hash", "start", "stop", "h1", "h2"])


def _resolve(batches: Iterator[pa.RecordBatch], window: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated words, from strings sorted by minimiser, string, id and start; windows of crowded buckets go on."""
    last = None  # the first row of the run of equal strings that is open: minimiser, string, id, start
    held: _Bucket | None = None  # different strings of the open bucket
    crowded = None  # the open bucket, once its windows go on alone
    for batch in batches:
        known = pc.is_valid(batch.column(5))
        found = batch.filter(pc.invert(known))
        if found.num_rows:
            start = found.column(3).to_numpy()
            yield _ranges(found.column(1).to_numpy(), found.column(2).to_numpy(), start, start + found.column(4).to_numpy())
        batch = batch.filter(known)
        if not batch.num_rows:
            continue
        minimiser, ids, hashes, start, n = (batch.column(k).to_numpy() for k in range(5))
        strings = batch.column(5).to_pylist()
        same = np.zeros(len(strings), dtype=bool)
        same[1:] = (minimiser[1:] == minimiser[:-1]) & pc.equal(batch.column(5).slice(1), batch.column(5).slice(0, len(strings) - 1)).to_numpy(zero_copy_only=False)
        same[0] = last is not None and last[0] == minimiser[0] and last[1] == strings[0]
        heads = np.flatnonzero(~same)
        run = np.cumsum(~same) - 1  # -1: the run began in a batch before
        head = heads[np.maximum(run, 0)] if len(heads) else np.zeros(len(run), dtype=np.int64)
        first_id, first_start = ids[head], start[head]
        if last is not None:
            first_id, first_start = np.where(run < 0, last[2], first_id), np.where(run < 0, last[3], first_start)
        gone = (first_id != ids) | (first_start != start)
        if gone.any():
            yield _ranges(ids[gone], hashes[gone], start[gone], start[gone] + n[gone] + (window - 1))
        if len(heads):
            k = heads[-1]
            last = minimiser[k], strings[k], ids[k], start[k]
        stay = _Bucket(minimiser, ids, hashes, start, n, strings).take(np.flatnonzero(~gone & ~same))
        if held is not None:
            stay = _Bucket.join([held, stay])
        if not len(stay):
            continue
        buckets = stay.columns[0]
        if crowded is not None:
            more = buckets == crowded
            if more.any():
                yield _loose(stay.take(np.flatnonzero(more)), window)
                stay = stay.take(np.flatnonzero(~more))
                buckets = stay.columns[0]
            if not len(stay):
                held = None
                continue
            crowded = None
        begin = np.concatenate(([True], buckets[1:] != buckets[:-1]))
        firsts = np.flatnonzero(begin)
        size = np.diff(np.concatenate((firsts, [len(buckets)])))
        of = np.cumsum(begin) - 1
        closed = np.flatnonzero((of < len(firsts) - 1) & (size[of] > 1))
        if len(closed):
            yield _compared(stay.take(closed), window)
        held = stay.take(np.flatnonzero(of == len(firsts) - 1))
        if len(held) > crowd:
            crowded = held.columns[0][0]
            yield _loose(held, window)
            held = None
    if held is not None and len(held) > 1:
        yield _compared(held, window)


def repeated_ranges(docs: DataFrame, book: list[bytes], id_col: str = "id", hash_col: str = "text_hash", text_col: str = "text", window: int = WINDOW, run: int = RUN, crowd: int = CROWD) -> DataFrame:
    """(id, text_hash, start, stop): words covered by windows that also start at a smaller (id, start). Ranges may overlap.

    ``docs`` holds an id (long, not null), a hash of the text and the text.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(book)  # CODES words at most, of CODED_BYTES at most
    supers = docs.select(id_col, hash_col, text_col).mapInArrow(lambda batches: _split(batches, Packer(shared.value, window, run)), SUPERS)
    buckets = supers.repartition("minimiser").sortWithinPartitions("minimiser", "packed", "id", "start")
    with freed_shuffles(docs.sparkSession):
        found = stage(buckets.mapInArrow(lambda batches: _resolve(batches, window, crowd), FOUND), "ranges")
    loose = found.where("h1 IS NOT NULL")
    first = loose.groupBy("h1", "h2").agg(F.min(F.struct("id", "start")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    alone = loose.join(first, ["h1", "h2"]).where(F.struct("id", "start") > F.col("_first"))
    return found.where("h1 IS NULL").select("id", "text_hash", "start", "stop").unionByName(alone.select("id", "text_hash", "start", "stop"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for text, ranges in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            words = (text or b"").split()  # bytes are split at 0x20 and 0x09 to 0x0D
            kept, at = [], 0
            for r in ranges or []:
                kept += words[at : max(at, r["start"])]
                at = max(at, r["stop"])
            kept += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def with_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text, ranges): per row of ``docs`` the words to remove, as sorted (start, stop); null where nothing is."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = keyed.withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID).cast("long")), "text_hash": F.xxhash64("text")})
    ranges = repeated_ranges(keyed, codebook(keyed), window=window, run=run, crowd=crowd)
    ranges = ranges.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("ranges"))  # a set: repeated rows have the same ranges
    return keyed.join(ranges, ["id", "text_hash"], "left").select("doc_id", "text", "ranges")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, crowd: int = CROWD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Words are runs of other bytes than 0x20 and 0x09 to 0x0D. A word goes if it is covered by a window of ``window`` words whose sequence also starts at a smaller
    doc_id, or earlier in the same document; windows are judged on the input. A null id comes before all others. Rows that share an id count as one document there:
    what starts at the same word of two such rows is no repeat. A null or empty text, or one of fewer words than a window, loses nothing. No rows in, none out; other columns are ignored.
    """
    made = with_ranges(docs, id_col, text_col, window, run, crowd)
    return made.mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
