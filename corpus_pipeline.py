"""A training corpus from documents: five stages, each a numbered operator on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silva.llm import decontam, language, minhash, packing, toxicity
from silva.llm.common import new_names, new_path, stage
from silva.llm.tokens import default_tokenizer

#: No SQL expresses a language automaton, a lattice decoder or a genetic algorithm.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a language is found; those without a letter (null and empty texts too) go. Each row is judged by its own text; no rows in, none out."""
    names = new_names(docs, "lang", "score", "rate")
    return language.annotate(docs, language.train(docs), names).where(F.col(names[0]) != language.UND).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted toxic, each judged by its own text, whether or not it has an id; no rows in, none out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = new_names(docs, "score")
    return toxicity.annotate(docs, toxicity.train(docs, labels), names).where(F.col(names[0]) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, whatever their ids; texts without a word stay. No rows in, none out."""
    (row,) = new_names(docs, "row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written, so that numbers hold: ids may be null or repeated
    gone = minhash.near_duplicates(numbered, id_col=row).where("not kept").select(F.col("doc_id").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, whatever their ids; no rows in, none out."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows' tokens, placed in sequences: a null or empty text is one piece with the end alone; no rows in, none out."""
    return packing.pack(packing.pieces(docs, default_tokenizer()))


STAGES = [("language", identify_language), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
