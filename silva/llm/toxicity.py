"""Toxicity by noisy-channel deobfuscation and a lexical score.

A character trigram model is counted over all documents. Spans that may be disguised (a sign or digit that imitates
a letter beside any letter, letters drawn out, letters apart) become a lattice: each symbol stands for itself or for the
letters it imitates, a run of letters for one or two, a gap for nothing or a space, each at a cost. Viterbi finds
the cheapest reading under the channel costs and the trigram model. The restored text's words are then
scored by weights of word beginnings and words, learned from labelled documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, stage, text_batches

#: The bounded sample to fit on: toxic documents, and twice as many clean ones.
PER_CLASS = 6000
#: Word beginnings of these lengths are features, besides whole words. Those kept occur in LEAST_TOXIC documents of the bounded sample, so it bounds them.
HEADS = (4, 5, 6)
LEAST_TOXIC, LEAST_WEIGHT, DEVIATIONS = 4, 1.2, 2.0
#: Documents of one class with the same words of smallest hash count once in fitting: copies are no evidence.
SMALLEST = 4
#: Distinct words that a worker remembers at most; then it starts afresh.
REMEMBERED = 200_000

# Letters that a digit or sign imitates.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SUBSTITUTE, DOUBLED, DRAWN_OUT, GAP = 1.0, 1.5, 0.5, 2.0

_SIGNS = "".join(LEET)
_ORDER = "abcdefghijklmnopqrstuvwxyz0123456789" + "@$!|+"
SYMBOLS = len(_ORDER) + 2  # 0: between words; the last: all other letters
_MARKS = ".-_*"
_UNIT = r"(?:[^\W_]|[@$!|+])"  # a letter, a digit or a sign that imitates one
_ALONE, _ENDS = r"(?<![^\W_])(?<![@$!|+])", r"(?![^\W_]|[@$!|+])"
_SPACED = re.compile(rf"{_ALONE}{_UNIT}(?:[\s.\-_*]+{_UNIT}){{2,}}{_ENDS}")  # letters with blanks or marks between them
_SPAN = re.compile(rf"{_UNIT}+")
_DISGUISED = re.compile(r"[^\W\d_][01345789@$!|+]|[01345789@$!|+][^\W\d_]|([^\W\d_])\1\1")  # signs beside letters, letters drawn out
_JOINED = re.compile(_UNIT)
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")


def _codes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x3000):
        if chr(point).isalpha():
            table[point] = SYMBOLS - 1
    table[0x3000:0xD800] = SYMBOLS - 1
    for n, c in enumerate(_ORDER):
        table[ord(c)] = n + 1
    return table


_TABLE: list[np.ndarray] = []


def encode(text: str) -> np.ndarray:
    """Symbols of a lower-case text."""
    if not _TABLE:
        _TABLE.append(_codes())
    return _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _code(c: str) -> int:
    at = _ORDER.find(c)
    return at + 1 if at >= 0 else SYMBOLS - 1 if c.isalpha() else 0


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts (SYMBOLS**3 values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for _, texts in text_batches(batches):
            s = encode("\n".join(["", *[t.lower() for t in texts], ""])).astype(np.int32)
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    rows = docs.select(F.lit(0), F.col(text_col)).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # SYMBOLS**3 bounds it
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r.at] = r.n
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of a symbol after two others: trigrams backed by pairs, these by single symbols."""
    one = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + SYMBOLS)
    pairs = counts.sum(axis=0)
    two = (pairs + 5 * one) / (pairs.sum(axis=1, keepdims=True) + 5)
    three = (counts + 5 * two[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return -np.log(three)


_readings: dict[tuple[str, int], list[tuple[str, float, tuple[int, ...]]]] = {}


def _run(c: str, n: int) -> list[tuple[str, float, tuple[int, ...]]]:
    """The readings of ``n`` times the character ``c`` (3 stands for more): text, channel cost, symbols."""
    own = _readings.get((c, n))
    if own is None:
        if c.isalpha():
            made = [(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, DOUBLED)] if n == 2 else [(c, DRAWN_OUT), (c + c, DOUBLED)]
        elif c in LEET:
            made = [(c * min(n, 2), 0.0), *[(x, SUBSTITUTE) for x in LEET[c]], *([(x + x, SUBSTITUTE + DOUBLED) for x in LEET[c]] if n > 1 else [])]
        elif c.isdigit():
            made = [(c * min(n, 2), 0.0)]
        else:
            made = [("", 0.0), (" ", GAP)]
        own = _readings[c, n] = [(text, paid, tuple(map(_code, text))) for text, paid in made]
        if len(_readings) > REMEMBERED:
            _readings.clear()
    return own


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """The readings of each run of equal characters of a lower-case span, with their channel costs."""
    return [[(text, paid) for text, paid, _ in _run(c, min(3, len(list(run))))] for c, run in groupby(span)]


def restore(span: str, cost: list) -> str:
    """The cheapest reading of a lower-case span. cost: nested lists by three symbols."""
    return cheapest(span, cost)[1]


def cheapest(span: str, cost: list) -> tuple[float, str]:
    """The reading that :func:`restore` gives, after its cost.

    A path is a chain of readings, the last first. Where all paths meet in one state, which two plain letters bring about, the chain is written out, so
    time and memory follow the span's length.
    """
    out: list[str] = []
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}

    def write(path: tuple | None) -> None:
        own = []
        while path is not None:
            path, text = path
            own.append(text)
        out.extend(reversed(own))

    for c, run in groupby(span):
        options = _run(c, min(3, len(list(run))))
        if len(states) == 1:
            ((state, (so_far, path)),) = states.items()
            write(path)
            states = {state: (so_far, None)}
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, path) in states.items():
            for text, paid, codes in options:
                x, y, total = a, b, so_far + paid
                for z in codes:
                    total += cost[x][y][z]
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, text))
        states = after
    total, path = min(((total + cost[a][b][0], path) for (a, b), (total, path) in states.items()), key=lambda x: x[0])
    write(path)
    return total, "".join(out)


class Deobfuscator:
    """Restores disguised spans of texts, remembering them."""

    def __init__(self, cost: np.ndarray):
        self.array = cost
        self.nested: list | None = None
        self.known: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return {"array": self.array, "nested": None, "known": {}}

    def _one(self, match: re.Match) -> str:
        if self.nested is None:
            self.nested = self.array.tolist()
        return restore(match.group(), self.nested)

    def _span(self, match: re.Match) -> str:
        span = match.group()
        if not _DISGUISED.search(span):
            return span
        found, body = self._one(match), span.rstrip("!")
        if not body or body == span:
            return found
        # an exclamation mark at the end may be just that
        alone, whole = cheapest(body, self.nested), cheapest(span, self.nested)
        return alone[1] + span[len(body) :] if alone[0] <= whole[0] else found

    def token(self, token: str) -> str:
        """A run without white space, its disguised spans restored; spaced letters are joined already."""
        return _SPAN.sub(self._span, token) if _DISGUISED.search(token) else token

    def _token(self, match: re.Match) -> str:
        """A run without white space, restored; remembered."""
        token = match.group()
        found = self.known.get(token)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known = {}
            found = self.known[token] = self.token(token)
        return found

    def __call__(self, text: str) -> str:
        """The lower-case text with its disguised spans restored."""
        return _TOKEN.sub(self._token, _SPACED.sub(self._one, text.lower()))

    def pieces(self, text: str) -> set[str]:
        """The distinct runs without white space of the lower-case text, spaced letters joined first."""
        low = text.lower()
        found = set(low.split())
        if any(map(_lone, found)):
            joined = _SPACED.sub(self._one, low)
            if joined != low:
                return set(joined.split())
        return found


def _lone(token: str) -> bool:
    """Whether spaced letters may begin in the token: they need one with nothing but marks or the token's end before the next."""
    if len(token) == 1:
        return True
    bare = token.strip(_MARKS)
    return len(bare) == 1 or (len(bare) > 1 and not _JOINED.match(bare[-2]))


def features(word: str) -> list[str]:
    return [f"{word}$", *[word[:n] for n in HEADS if len(word) >= n]]


class Scorer:
    """Score of a text from the weights of its distinct words, each its heaviest feature."""

    def __init__(self, weights: dict[str, float], intercept: float = 0.0, slope: float = 1.0):
        self.weights, self.intercept, self.slope = weights, intercept, slope
        self.known: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def weight(self, word: str) -> float:
        return max([0.0, *[self.weights.get(f, 0.0) for f in features(word)]])

    def total(self, words: Iterable[str]) -> float:
        return sum(map(self.weight, words))

    def text_total(self, text: str, fix: Deobfuscator) -> float:
        """The same of a text's distinct restored words; each distinct token is looked at once per worker."""
        known, marked = self.known, {}
        for token in fix.pieces(text):
            hits = known.get(token)
            if hits is None:
                if len(known) > REMEMBERED:
                    known.clear()
                hits = known[token] = tuple((w, v) for w in _WORD.findall(fix.token(token)) if (v := self.weight(w)))
            if hits:
                marked.update(hits)
        return sum(marked.values())

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, self.intercept + self.slope * total))))


def _sketch(words: list[str]) -> str:
    return " ".join(sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:SMALLEST])


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: tuple[int, int], per_class: int) -> DataFrame:
    """id, text, y of at most ``per_class`` toxic and twice as many clean documents outside the fold, by a hash of the id."""
    rest = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(fold[0]))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (rest != fold[1]))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    there = known.join(texts.select("id").distinct(), "id", "left_semi")
    order = F.xxhash64(F.lit(11), "id")
    sample = there.where("y = 1").orderBy(order, "id").limit(per_class).unionByName(there.where("y = 0").orderBy(order, "id").limit(2 * per_class))
    return texts.join(F.broadcast(sample), "id")  # 3 * per_class bounds it


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: tuple[int, int] = (5, 0), per_class: int = PER_CLASS) -> tuple[Deobfuscator, Scorer]:
    """Count the character model over all of ``docs``; fit weights on one half of the labelled sample, calibrate on the other."""
    spark = docs.sparkSession
    fixer = Deobfuscator(costs(trigram_counts(docs, text_col)))
    shared = spark.sparkContext.broadcast(fixer)  # SYMBOLS**3 bounds it

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = shared.value
        for batch in batches:
            rows = [(i, y, sorted(set(_WORD.findall(fix(text or ""))))) for i, text, y in zip(*[batch.column(k).to_pylist() for k in range(3)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([" ".join(r[2]) for r in rows], pa.string()), pa.array([_sketch(r[2]) for r in rows], pa.string())], ["id", "y", "words", "sketch"])

    sample = stage(_labelled(docs, labels, id_col, text_col, label_col, fold, per_class).select("id", "text", "y").mapInArrow(restored, "id long, y int, words string, sketch string"), "toxic-sample")
    sample = stage(sample.groupBy("y", "sketch").agg(F.min("id").alias("id")).join(sample.drop("y", "sketch"), "id").dropDuplicates(["id"]), "toxic-distinct")
    half = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(2))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[y].update({f for w in words.split(" ") if w for f in features(w)})
            if len(found[0]) + len(found[1]) > REMEMBERED:
                yield _counts(found)
                found = (Counter(), Counter())
        yield _counts(found)

    def _counts(found: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = sorted(found[0].keys() | found[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], ["feature", "toxic", "clean"])

    sizes = {(r.h, r.y): r.n for r in sample.groupBy(half.alias("h"), "y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    counts = sample.where(half == 0).select("y", "words").mapInArrow(counted, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    # so many standard deviations below the estimate: what was seen a few times only weighs little
    weight = weight - DEVIATIONS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = counts.where(F.col("toxic") >= LEAST_TOXIC).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
    scorer = Scorer({r.feature: r.w for r in kept.collect()})
    fitted = spark.sparkContext.broadcast(scorer)  # the sample bounds it

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fitted.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(own.total(filter(None, w.split(" "))), 1) for w in batch.column(1).to_pylist()], pa.float64())], ["y", "total"])

    seen = sample.where(half == 1).select("y", "words").mapInArrow(totals, "y int, total double").groupBy(F.least("total", F.lit(100.0)).alias("total"), "y").agg(F.count("*").alias("n")).collect()  # at most 2000 rows
    prior = _prior(labels, id_col, label_col, fold)
    return fixer, Scorer(scorer.weights, *calibrate([(r.total, r.y, r.n) for r in seen], prior))


def _prior(labels: DataFrame, id_col: str, label_col: str, fold: tuple[int, int]) -> float:
    rest = F.pmod(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(fold[0]))
    n, toxic = labels.where(F.col(label_col).isin(0, 1) & (rest != fold[1])).agg(F.count("*"), F.coalesce(F.sum(F.col(label_col).cast("int")), F.lit(0))).first()
    return (toxic + 0.5) / (n + 1.0)


def calibrate(seen: list[tuple[float, int, int]], prior: float) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over (total, class, count), classes weighted to ``prior``; damped Newton steps."""
    if not seen:
        return math.log(prior / (1 - prior)), 0.0
    x, y, n = (np.array(v, dtype=float) for v in zip(*seen))
    mass = np.array([n[y == 0].sum(), n[y == 1].sum()])
    if not mass.all():
        return math.log(prior / (1 - prior)), 0.0
    w = n * np.where(y == 1, prior / mass[1], (1 - prior) / mass[0]) * n.sum()
    design = np.stack([np.ones_like(x), x], axis=1)
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -40, 40)))
        gradient = design.T @ (w * (y - p)) - 0.01 * b
        hessian = design.T @ (design * (w * np.maximum(p * (1 - p), 1e-9))[:, None]) + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        b += step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def annotate(docs: DataFrame, model: tuple[Deobfuscator, Scorer], names: list[str], text_col: str = "text", with_text: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the score (0 to 1) and, if asked for, the restored text, under the given names; decided row by row without a shuffle.

    Null and empty texts get the score of a text without marked words. Repeated rows are scored alike; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SYMBOLS**3 and the labelled sample bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix, own = shared.value
        for part, texts in text_batches(batches, column=column):
            scores = pa.array([own.score(own.text_total(text, fix)) for text in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores, *[pa.array([fix(text) for text in texts], pa.string()) for _ in range(with_text)]], whole)

    column, whole = docs.columns.index(text_col), [*docs.columns, *names]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.StringType())))])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: tuple[Deobfuscator, Scorer], id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (5, 0), with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), and the restored text if asked for, as :func:`annotate` decides.

    A null id is never held out. Other columns are ignored.
    """
    out = annotate(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, ["score", *["restored"] * with_text], with_text=with_text)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold[0])) == fold[1], F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *["restored"] * with_text)
