"""Importance resampling toward a target distribution, with hashed features that are scored without being exploded.

Higher-order functions turn a text into an array of buckets, one for each run of one to three words. The corpus and
the target are counted by bucket, which is all that is shuffled; the logarithm of the ratio of both shares is a bucket's gain.
A document's weight is an aggregate over its bucket array of ``element_at`` on one literal array of gains, and random noise from its
id turns weights into a draw without replacement (the highest of weight plus Gumbel noise).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import numbered
from .common import stage

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: What lies between words, once A-Z are lowered: a word is a run of digits, letters a-z and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """All words of a text as an array; none of a null text."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.length(whole)
    lowered = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _UPPER.lower()))  # lower() is faster, but lowers letters beyond ASCII as well
    return F.array_remove(F.split(lowered, BETWEEN), "")


def bucket_array(words_col: str, buckets: int = BUCKETS, run: int = RUN) -> Column:
    """The buckets, from 1, of all runs of 1 to ``run`` consecutive words of an array column, joined by a space; repeats are kept."""
    at = F.col(words_col)

    def runs(n: int) -> Column:
        def one(first: Column, place: Column) -> Column:
            joined = [first]
            for later in range(1, n):
                joined += [F.lit(" "), F.get(at, place + later)]
            return (F.crc32(F.concat(*joined).cast("binary")) % buckets + 1).cast("int")

        return F.transform(F.slice(at, F.lit(1), F.greatest(F.size(at) - (n - 1), F.lit(0))), one)

    return F.concat(*[runs(n) for n in range(1, run + 1)])


def _with_buckets(docs: DataFrame, text_col: str, keep: list[Column], buckets: int, run: int) -> DataFrame:
    # the array of words is a column of its own, since the runs read it in every step
    return docs.select(*keep, words(F.col(text_col)).alias("_words")).select("*", bucket_array("_words", buckets, run).alias("_buckets"))


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> dict[int, int]:
    """How many features of all texts fall into each bucket, from 1. Tasks count before the shuffle, so that at most ``buckets`` rows leave each."""
    made = _with_buckets(texts, text_col, [], buckets, run)
    found = made.select(F.explode_outer("_buckets").alias("b")).groupBy("b").count()  # a plain explode gets a filter on the array's size, which would make the words anew for each feature
    return {r.b: r["count"] for r in found.collect() if r.b is not None}  # `buckets` rows at most


def gain_array(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> Column:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket as one literal array of longs."""
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    gains = [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((corpus.get(b, 0) + 1) * t_all))) for b in range(1, buckets + 1)]
    return F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded into one literal


def score(docs: DataFrame, gains: Column, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score (all long), without a shuffle.

    The weight is the sum of the gains of all features; a null or empty text, or one without words, has none and weighs 0. The noise comes from
    sha256 of ``<seed>:<doc_id>``; a null id counts as an empty string there. Repeated rows are scored alike, other columns are ignored.
    """
    counted = _with_buckets(docs, text_col, [F.col(id_col).cast("long").alias("doc_id")], buckets, run)
    weight = F.aggregate("_buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gains, b))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    out = counted.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.size("_buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return out.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score and rank, its place from 1 among the drawn rows, null if it isn't drawn; and n_words.

    Of the N rows with ``least_words`` words or more, the floor(percent N / 100) highest scores are drawn; ties go to the smaller doc_id, a null id comes
    last, and rows that share score and id are ranked in any order. ``target`` gives texts in its column ``text``; an empty one makes gains of the corpus alone.
    An empty ``docs`` gives no rows. Ranks come from ranges of the scores, sorted apart, so no task meets all rows.
    """
    gains = gain_array(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, "text", buckets, run), buckets)
    scored = stage(score(docs, gains, id_col, text_col, buckets, run, seed).withColumn("_row", F.monotonically_increasing_id()), "scores")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = numbered(fit.withColumns({"_high": -F.col("score"), "_null": F.col("doc_id").isNull()}), ["_high", "_null", "doc_id", "_row"], "_place")
    rest = scored.where(F.col("n_words") < least_words).withColumn("_place", F.lit(None).cast("long"))
    both = ranked.select(rest.columns).unionByName(rest)
    return both.select("doc_id", "n_features", "weight", "score", F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"), "n_words")
