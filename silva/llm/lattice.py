"""Language-model scores from a subword lattice.

The pieces of an existing public vocabulary spell every word in many ways; the probability of a word is the sum over
all of them, by a forward recursion in log space. Every word of the training side is also a piece of its own: one more
arc across the whole lattice, as likely as the word is frequent. The vocabulary's scores are ranks of merges (BPE), so Zipf's law makes
probabilities of them. These are the prior: expected counts over all the distinct words, by a forward and a backward pass, are added to PRIOR pieces dealt by
the existing scores. A word counts once there: its
arc stands for its further occurrences, and spelling is for words not met yet. A text's words and its end are independent given the pieces.

Word counts are summed by Spark over the whole training side. The FREQUENT most frequent words are broadcast, which
takes the hot keys out of the join; all other words are scored once each and meet their scores in a shuffled
join. Which words are broadcast doesn't change any score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage, text_batches

#: Words that are broadcast at most; an aid of the join that changes no score.
FREQUENT = 200_000
#: Longest word that is broadcast, in bytes: together they bound what goes to the driver.
BROADCAST_BYTES = 64
#: Rounds of expected counts, and the pieces that the vocabulary's own scores count for beside those of the corpus.
ROUNDS, PRIOR = 2, 10_000.0
#: Marked words of up to so many characters are tried without logs; a sum under TINY may have lost ways to underflow and is done again in logs.
SHORT, TINY = 60, 1e-280
#: Distinct words that a worker gathers before it hands them on.
GATHERED = 200_000
LN10 = math.log(10)
MARK = "▁"  # stands before a word in the vocabulary
_pieces: dict[str, Pieces] = {}


class Pieces:
    """The public vocabulary: pieces, their log probabilities from its own scores, and pieces for single bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = model.eos_id()
        self.names = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        # the scores of a merge vocabulary are negative ranks: Zipf's law makes probabilities of them
        weight = np.array([1 / (10 - model.get_score(i)) if not model.is_byte(i) else 1e-5 for i in range(n)])
        self.start = np.log(weight / weight.sum())
        self.heads: dict[str, int] = {}  # every beginning of a piece; -1 if it is no piece itself
        for piece in self.names:
            for k in range(1, len(piece)):
                self.heads.setdefault(piece[:k], -1)
        self.heads.update(self.names)

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """For each place in the marked word the arcs that leave it: (place reached, ids). A character that is no piece is spelled in bytes."""
        n, get = len(word), self.heads.get
        out = []
        for i in range(n):
            own = []
            for j in range(i + 1, n + 1):
                found = get(word[i:j])
                if found is None:
                    break
                if found >= 0:
                    own.append((j, (found,)))
            if not own or own[0][0] > i + 1:
                own.insert(0, (i + 1, tuple(self.byte[b] for b in word[i].encode("utf-8", "surrogatepass"))))
            out.append(own)
        return out


def pieces(path: str) -> Pieces:
    """This worker's vocabulary from the file at ``path``."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def default_vocabulary() -> str:
    """Where the public piece vocabulary lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _add(terms: list[float]) -> float:
    top = max(terms)
    return top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))


def forward(arcs: list, score: list[float]) -> list[float]:
    """Log probability of all ways to each place."""
    reached: list[list[float]] = [[] for _ in range(len(arcs) + 1)]
    reached[0].append(0.0)
    out = []
    for i, own in enumerate(arcs):
        here = _add(reached[i])
        out.append(here)
        for j, ids in own:
            reached[j].append(here + (score[ids[0]] if len(ids) == 1 else sum([score[k] for k in ids])))
    out.append(_add(reached[-1]))
    return out


def log_probability(word: str, vocabulary: Pieces, score: list[float]) -> float:
    """Natural log of the marginal probability of the word over all its segmentations."""
    return forward(vocabulary.arcs(MARK + word), score)[-1]


def arc_table(vocabulary: Pieces, weight: list[float]) -> dict[str, tuple[int, float]]:
    """Every beginning of a piece with its id (-1 if it is no piece) and probability."""
    return {k: (i, weight[i] if i >= 0 else 0.0) for k, i in vocabulary.heads.items()}


def short_lattice(word: str, table: dict, vocabulary: Pieces, weight: list[float]) -> tuple[list[float], list[tuple]]:
    """Probabilities of all ways to each place of a marked word of SHORT characters at most, and its arcs (from, to, ids, probability). Valid if the last of them reaches TINY."""
    n, get = len(word), table.get
    ahead, used = [0.0] * (n + 1), []
    ahead[0] = 1.0
    for i in range(n):
        here, single = ahead[i], False
        for j in range(i + 1, n + 1):
            found = get(word[i:j])
            if found is None:
                break
            k, p = found
            if k >= 0:
                single = single or j == i + 1
                ahead[j] += here * p
                used.append((i, j, k, p))
        if not single:
            ids, p = tuple(vocabulary.byte[b] for b in word[i].encode("utf-8", "surrogatepass")), 1.0
            for k in ids:
                p *= weight[k]
            ahead[i + 1] += here * p
            used.append((i, i + 1, ids, p))
    return ahead, used


def expected_counts(word: str, count: float, vocabulary: Pieces, score: list[float], weight: list[float], table: dict, into: list[float]) -> None:
    """Add ``count`` times the expected use of each piece in the word. ``weight`` holds the exponentials of ``score``, ``table`` its arc table."""
    word = MARK + word
    n = len(word)
    ahead, used = short_lattice(word, table, vocabulary, weight) if n <= SHORT else ([0.0], [])
    if ahead[-1] < TINY:
        arcs = vocabulary.arcs(word)
        ahead = forward(arcs, score)
        back = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            terms = [sum([score[k] for k in ids]) + back[j] for j, ids in arcs[i]]
            back[i] = _add(terms)
            for (_, ids), t in zip(arcs[i], terms):
                use = count * math.exp(ahead[i] + t - ahead[n])
                for k in ids:
                    into[k] += use
        return
    back = [0.0] * (n + 1)
    back[n] = count / ahead[n]
    for i, j, k, p in reversed(used):
        p *= back[j]
        back[i] += p
        p *= ahead[i]
        if k.__class__ is int:
            into[k] += p
        else:
            for x in k:
                into[x] += p


def word_score(word: str, vocabulary: Pieces, score: list[float], weight: list[float], table: dict) -> float:
    """The same as :func:`log_probability`, by the short lattice where that is safe."""
    found = short_lattice(MARK + word, table, vocabulary, weight)[0][-1] if len(word) < SHORT else 0.0
    return math.log(found) if found >= TINY else log_probability(word, vocabulary, score)


def tokens(text: str) -> list[bytes]:
    """Lower case of A-Z; runs of other bytes than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _string(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def _held_out(id_: Column, fold: tuple[int, int]) -> Column:
    """Whether crc32(id as text) mod fold[0] is fold[1]; never for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(fold[0])) == fold[1], F.lit(False))


def word_counts(docs: DataFrame, id_col: str, text_col: str, fold: tuple[int, int]) -> DataFrame:
    """word (binary) of all texts, n over the texts of the training side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = [*found[1], *(w for w in found[0] if w not in found[1])]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([found[1][w] for w in words], pa.int64())], ["word", "n"])

        found: tuple[Counter, Counter] = (Counter(), Counter())
        for part, texts in text_batches(batches):
            for yes, text in zip(part.column(0).to_pylist(), texts):
                found[yes].update(tokens(text))
                if len(found[1]) + len(found[0]) > GATHERED:
                    yield out()
                    found = (Counter(), Counter())
        yield out()

    return docs.select(~_held_out(F.col(id_col), fold), F.col(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words of BROADCAST_BYTES at most, ``most`` of them at most: all whose count reaches the least of a row of steps that keeps to it."""
    short = counts.where((F.col("n") > 1) & (F.length("word") <= BROADCAST_BYTES))
    step = F.floor(F.log2("n") * 16).cast("long")  # a thousand steps at most
    sizes = short.groupBy(step.alias("step")).agg(F.count("*").alias("words"))
    room, least = most, None
    for at, words in sorted(((r.step, r.words) for r in sizes.collect()), reverse=True):
        room -= words
        if room < 0:
            break
        least = at
    if least is None:
        return {}
    return {bytes(r.word): r.n for r in short.where(step >= least).collect()}


class Model:
    """What scoring needs: counts of frequent words, the log probabilities of pieces, totals, and what whole words and spelled ones have of the probability of what comes next; the text's end has the rest."""

    def __init__(self, path: str, frequent: dict[bytes, int], score: np.ndarray, total: int, distinct: int, share: float, spelled: float):
        self.path, self.frequent, self.score, self.total, self.distinct, self.share, self.spelled = path, frequent, score, total, distinct, share, spelled

    @property
    def base_floor(self) -> float:
        return math.log10(self.total + 0.1 * (self.distinct + 1))

    def open(self) -> None:
        """Make a worker's tables."""
        self.list = self.score.tolist()
        self.vocabulary = pieces(self.path)
        self.end = self.list[self.vocabulary.end] / LN10
        self.weight = np.exp(self.score).tolist()
        self.table = arc_table(self.vocabulary, self.weight)
        self.whole, self.rest = math.log(max(1e-300, self.share)), math.log(self.spelled)

    def word(self, word: bytes, n: int) -> float:
        """log10 probability of a word that the training side has ``n`` times: as a whole, or spelled."""
        spelled = self.rest + word_score(_string(word), self.vocabulary, self.list, self.weight, self.table)
        return (_add([self.whole + math.log(n / self.total), spelled]) if n else spelled) / LN10

    def prepare(self) -> None:
        self.open()
        self.prepared = {w: (math.log10(c + 0.1) - self.base_floor, self.word(w, c)) for w, c in self.frequent.items()}


def train(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (10, 0), frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model, learned from texts whose crc32(id as text) mod fold[0] is not fold[1] and those without an id, and a table of all words but the frequent ones: word, n, spelled (log10 of the probability over the whole word and all spellings), each word once."""
    spark = docs.sparkSession
    bound_batches(spark)
    counts = stage(word_counts(docs, id_col, text_col, fold), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    top = frequent_words(counts, frequent)  # FREQUENT bounds it
    ends = docs.where(~_held_out(F.col(id_col), fold)).count()
    own = pieces(vocabulary)
    known = spark.sparkContext.broadcast(frozenset(top))
    log_p = own.start

    def counter(first: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_pieces, score, weight = pieces(vocabulary), first.tolist(), np.exp(first).tolist()
            table = arc_table(own_pieces, weight)
            into = [0.0] * len(first)
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if n:
                        expected_counts(_string(word), 1.0, own_pieces, score, weight, table, into)
            found = np.array(into)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.float64())], ["piece", "n"])

        return run

    for _ in range(ROUNDS):
        expected = PRIOR * np.exp(own.start)
        for r in counts.mapInArrow(counter(log_p), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # the vocabulary bounds it
            expected[r.piece] += r.n
        log_p = np.log(expected / expected.sum())
    # words and ends are pieces too; spelling keeps the share of tokens that were new when they came
    share = 1 - (distinct + 1) / (total + distinct + 2) if total else 0.0
    end = (ends + 1) / (total + ends + 2)
    log_p = log_p - math.log1p(-math.exp(log_p[own.end]))  # the end is no spelling: the other pieces have the whole of it
    log_p[own.end] = math.log(end)
    model = Model(vocabulary, top, log_p, total, distinct, share * (1 - end), (1 - share) * (1 - end))
    spelling = spark.sparkContext.broadcast(Model(vocabulary, {}, model.score, total, distinct, model.share, model.spelled))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, skip = spelling.value, known.value
        if not hasattr(rule, "table"):
            rule.open()
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in skip]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64()), pa.array([rule.word(w, n) for w, n in rows], pa.float64())], ["word", "n", "spelled"])

    return model, stage(counts.mapInArrow(spell, "word binary, n long, spelled double"), "rare")


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (10, 0)) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    A null or empty text is its end alone. The end is a token of both scores, known if any training text exists. A null
    id is never held out and counts as training. Repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FREQUENT and the vocabulary bound it
    ends = docs.where(~_held_out(F.col(id_col), fold)).count()
    total, distinct = model.total + ends, model.distinct + (ends > 0)
    floor = math.log10(total + 0.1 * (distinct + 1)) if total + 0.1 * (distinct + 1) > 0 else 0.0
    end_base = math.log10(ends + 0.1) - floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if not hasattr(own, "prepared"):
            own.prepare()
        get, shift = own.prepared.get, own.base_floor - floor
        for part, texts in text_batches(batches):
            n, known, base, scores, rare, times = [], [], [], [], [], []
            for text in texts:
                found = Counter(tokens(text))
                size = sum(found.values())
                b, s, k = end_base, own.end, int(ends > 0)
                tail, tail_n = [], []
                for word, c in found.items():
                    pair = get(word)
                    if pair is None:
                        tail.append(word)
                        tail_n.append(c)
                    else:
                        b += c * (pair[0] + shift)
                        s += c * pair[1]
                        k += c
                n.append(size + 1)
                known.append(k)
                base.append(b)
                scores.append(s)
                rare.append(tail)
                times.append(tail_n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "known", "base", "score", "words", "times"],
            )

    schema = "doc_id long, n_tokens long, known long, base double, score double, words array<binary>, times array<long>"
    first = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
    first = stage(first.withColumn("row", F.monotonically_increasing_id()), "scores")  # written once, so the numbers hold
    rare = first.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("c"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("c") * (F.log10(F.col("n") + 0.1) - F.log10(F.lit(0.1)))).alias("gain"), F.sum(F.when(F.col("n") > 0, F.col("c"))).alias("met"), F.sum(F.col("c") * F.col("spelled")).alias("spelled"))
    unmet = F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y) * (math.log10(0.1) - floor)
    out = first.join(met, "row", "left")
    held = _held_out(F.col("doc_id"), fold)
    base = F.col("base") + unmet + F.coalesce("gain", F.lit(0.0))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("spelled", F.lit(0.0))).alias("score"))
