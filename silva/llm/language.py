"""Language identification by cross-parsing.

Each language has a suffix automaton of a sample of its labelled text. A text is parsed into phrases, each
the longest run from its place that occurs in the sample; a language that resembles the text needs
few phrases. A phrase is named by a place in the sample, which takes the logarithm of the sample's size in bits, so phrases times
that logarithm per symbol estimate the cross entropy, whatever the sizes of the samples. The least wins.

The automaton's transitions are a table, in which a missing transition already holds the state after a new
phrase begins, so one lookup advances one text in one language, and numpy advances thousands of
text blocks in all languages at once. Blocks bound the steps: a phrase ends at its block's end. Symbols are the bytes
of letters in UTF-8, so no script is folded; a table has columns for the bytes of its own sample alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, text_batches

#: The bounded sample: distinct texts per language, characters taken of each from any place, symbols per language and in all.
SAMPLE_DOCS, SAMPLE_CHARS, SYMBOLS, ALL_SYMBOLS = 64, 4000, 48_000, 800_000
WIDTH = 256
BLOCK = 2048
#: Bytes of text that are parsed at once: a step costs much the same for a few texts as for many.
PARSED_BYTES = 1 << 20
UND = "und"

def has_letter(text: str) -> bool:
    """Whether :meth:`CrossParser.symbols` finds a letter: numbers such as a half or a circled one are none."""
    return any(map(str.isalpha, text))


def suffix_automaton(symbols: list[int], width: int = WIDTH) -> np.ndarray:
    """Transitions (states x width) of the suffix automaton of ``symbols``; -1 where there is none. State 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nexts), width), -1, dtype=np.int32)
    for s, own in enumerate(nexts):
        table[s, list(own)] = list(own.values())
    return table


def spread(texts: list[np.ndarray], most: int) -> list[int]:
    """The first symbols of all texts, ``most`` in all: what short ones leave falls to the others in equal parts."""
    quota, left = {}, most
    order = sorted(range(len(texts)), key=lambda k: (len(texts[k]), k))
    for done, k in enumerate(order):
        quota[k] = min(len(texts[k]), left // (len(order) - done))
        left -= quota[k]
    return [c for k, t in enumerate(texts) for c in t[: quota[k]].tolist()]


class CrossParser:
    """All languages' tables in one, and the alphabet."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        each = min(SYMBOLS, ALL_SYMBOLS // max(1, len(samples)))
        self._letters = None
        tables, roots, columns, sizes, at = [], [], [], [], 0
        for language in self.languages:
            symbols = spread([self.symbols([t])[0] for t in samples[language]], each)
            own = sorted(set(symbols))
            column = np.full(WIDTH, len(own), dtype=np.int32)  # the last column is any byte that the sample lacks
            column[own] = np.arange(len(own))
            width = len(own) + 1
            table = suffix_automaton(column[symbols].tolist(), width).astype(np.int64)
            table = np.vstack((table, np.full((1, width), -1)))  # the last state lies between phrases: any symbol begins one
            begun = np.where(table[0] < 0, len(table) - 1, table[0])  # a symbol that the sample lacks is a phrase alone
            table = np.where(table < 0, -(begun[None, :] * width + at) - 1, table * width + at)
            tables.append(table.astype(np.int32).ravel())
            roots.append((len(table) - 1) * width + at)
            columns.append(column)
            sizes.append(len(symbols))
            at += table.size
        self.flat = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int32)
        self.roots = np.array(roots, dtype=np.int32)
        self.columns = np.array(columns, dtype=np.int32).reshape(-1, WIDTH)
        self.bits = np.log2(np.array(sizes, dtype=float) + 1)  # that name a place in each sample

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_letters": None}

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and the count of each: 0 for any run of other characters than letters, the bytes of a letter in UTF-8."""
        if self._letters is None:
            self._letters = np.full(0x110000, 255, dtype=np.uint8)
        low = [t.lower() for t in texts]
        points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = self._letters[points]
        for c in np.unique(points[out == 255]).tolist():
            self._letters[c] = chr(c).isalpha()
        out = self._letters[points]
        ends = np.cumsum(np.array([len(t) for t in low])) + np.arange(len(texts))
        text_of = np.searchsorted(ends, np.arange(len(points)), "left") if len(texts) > 1 else np.zeros(len(points), dtype=np.int64)
        keep = (out != 0) | (np.concatenate(([0], out[:-1])) != 0)
        keep[ends[:-1]] = False  # the line ends that join the texts
        points, text_of = np.where(out != 0, points, 0).astype(np.uint32)[keep], text_of[keep]
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        made = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return np.frombuffer(made, dtype=np.uint8), np.bincount(text_of, weights=size, minlength=len(texts)).astype(np.int64)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language (languages x texts), and symbols of each text."""
        symbols, counts = self.symbols(texts)
        starts = np.cumsum(counts) - counts
        blocks = -(-counts // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + nth * BLOCK
        size = np.minimum(BLOCK, starts[owner] + counts[owner] - begin)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        many, steps = len(self.languages), int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), "left")  # blocks with more than t symbols
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        cuts = np.zeros((many, len(owner)), dtype=np.int32)
        for t in range(steps):
            k = active[t]
            got = self.flat[state[:, :k] + self.columns[:, symbols[begin[:k] + t]]]
            new = got >> 31
            cuts[:, :k] -= new
            state[:, :k] = got ^ new
        found = np.zeros((many, len(texts)), dtype=np.int64)
        for row in range(many):
            found[row] = np.bincount(owner, weights=cuts[row], minlength=len(texts))
        return found, counts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: tuple[int, int] = (4, 2)) -> CrossParser:
    """Fit on about SAMPLE_DOCS distinct labelled texts per language whose crc32(id as text) mod fold[0] is not fold[1].

    A text gives a passage of SAMPLE_CHARS characters at most, from a place by its hash; the passages share the language's SYMBOLS.
    """
    rest = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(fold[0]))
    known = docs.where(F.col(lang_col).isNotNull() & (rest != fold[1]) & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(17), text_col).alias("h"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect()}  # a row per language
    if not sizes:
        return CrossParser({})
    dealt = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.coalesce(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / max(1, n))))])[F.col("lang")], F.lit(0.0))
    place = F.pmod(F.xxhash64(F.lit(23), "h"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    passages = known.where(dealt <= share).select("lang", "h", F.substring("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("passage"))
    # copies share their hash, so they are one text here
    rows = passages.groupBy("lang", "h").agg(F.min("passage")).collect()
    samples: dict[str, list[str]] = {k: [] for k in sizes}
    for lang, _, text in sorted(rows, key=lambda r: (r[1], r[2])):
        samples[lang].append(text)
    return CrossParser({k: v for k, v in samples.items() if any(map(has_letter, v))})


def annotate(docs: DataFrame, parser: CrossParser, names: list[str], text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with three more of the given names, decided row by row without a shuffle: language, score, bits per symbol.

    ``und`` with score 0 for a text that is null or has no letter, or if nothing was learned. Ties go to the
    first language by name. The score is the runner-up's share of the bits of the best two, so 0.5 is a tie;
    with one language it is 1. Repeated rows are treated alike; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # ALL_SYMBOLS bounds it
    languages = parser.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, texts in text_batches(batches, PARSED_BYTES, column):
            named = np.array([has_letter(t) for t in texts])
            lang, score, rate = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if languages and named.any():
                phrases, counts = own.phrases(texts)
                found = phrases * own.bits[:, None]
                best = np.argmin(found, axis=0)
                first = found.min(axis=0)
                second = np.partition(found, 1, axis=0)[1] if len(languages) > 1 else found[0] * 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(named, second / (first + second) if len(languages) > 1 else 1.0, 0.0)
                    rate = np.where(named, first / counts, 0.0)
                lang = [languages[b] if ok else UND for b, ok in zip(best.tolist(), named.tolist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], whole)

    column, whole = docs.columns.index(text_col), [*docs.columns, *names]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType())))])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, bits_per_symbol, as :func:`annotate` decides.

    A null id is never held out. Other columns are ignored.
    """
    out = annotate(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), parser, ["lang_pred", "score", "bits_per_symbol"])
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold[0])) == fold[1], F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_symbol")
