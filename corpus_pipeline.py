"""A corpus pipeline: five stages over documents, each on all that the one before kept.

What holds for every stage: a null or empty text is a text without words; very long texts
are read whole; repeated rows and ids are told below; further columns of documents may
have any name and pass through unchanged (but for the two that the last stage adds); an
empty table gives an empty one. A stage's result depends on the rows alone, not on their
order or on how they are dealt into partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, quality_classifier, sentencepieces, simhash, suffix_dedup
from quern.llm.common import discard, documents, labels, mark, prepare, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Equal texts share their score, so repeated rows stay or go together; a score at the
    threshold stays. Null and empty texts are judged by the model's bias. Null ids are
    judged like others, but never learned from.
    """
    prepare(spark)
    return quality_classifier.kept(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that with the least id.

    Texts without words are all alike, so one of them stays. Of several rows with this id
    the one with the least text stays, a null before any. Rows with a null id stay.
    """
    prepare(spark)
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that a document with a smaller id has are cut out; n_chars counts what is left.

    No row goes; a text may become empty, a null one stays null, as does its n_chars.
    Rows with one id are one document and cut nothing from each other. A null id is the
    largest.
    """
    prepare(spark)
    left = suffix_dedup.deduplicated(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, with all rows of their id.

    Rows with a null id or text overlap nothing and stay.
    """
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, how many these are, and whether they decode to the text (round_trip).

    A null text has no ids, as an empty one, and is taken for empty by round_trip. Input
    columns named round_trip, piece_ids or n_pieces in any case are replaced.
    """
    prepare(spark)
    names = [c for c in docs.columns if c.lower() not in ("round_trip", "piece_ids", "n_pieces")]
    found = sentencepieces.encoded(docs.select(names), out="piece_ids", back="round_trip")
    same = F.col("round_trip") == F.translate(F.coalesce("text", F.lit("")), sentencepieces.SPACE, " ")
    return found.select(*names, same.alias("round_trip"), "piece_ids", F.size("piece_ids").alias("n_pieces"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", pieces),
]

#: SQL can express none of the stages but the decision on scores; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Each stage's rows are written to the shared folder; what the stage itself and the one
    before wrote there is removed then. Only the rows that the last stage reads stay.
    """
    docs, since = documents(spark, sf_dir), mark()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard(spark, since, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
