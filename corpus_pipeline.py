"""The corpus pipeline: quality classifier, quality rules, near-duplicates, mixing, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and reread as the next stage's
``docs``.  All but the last return the columns of documents; other columns, whatever their names, are left behind.  Empty documents go through
every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import classifier, mixing, pieces, rules, simhash
from quern.llm.common import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled among them, scores at its threshold or above.

    Null texts, and texts without words, score 0 and go.  Repeated rows are scored each.  Without labels every score is 0.5, and all go.
    """
    model = classifier.quality_model(spark, sf_dir, docs)
    scored = classifier.score(docs.select(COLUMNS), model, name="_quality")
    return scored.where(F.col("_quality") >= classifier.THRESHOLD).select(COLUMNS)


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table; null and empty texts don't, repeated rows are judged each."""
    return rules.keep(docs.select(COLUMNS))


def by_fingerprint(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least identifier, null last, of each group of near-duplicates; repeated rows are one group."""
    return simhash.keep_one(docs.select(COLUMNS))


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none to three times.  A null source is one of its own; rows of one identifier go together."""
    return mixing.mixed(docs.select(COLUMNS))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifier, source and piece ids of each document; a null or empty text has none."""
    import public_tokenizers

    return pieces.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("quality_classifier", by_quality),
    ("quality_rules", by_rules),
    ("simhash_near_dedup", by_fingerprint),
    ("mixing", by_mixture),
    ("sentencepiece", to_pieces),
]

#: Fingerprints, neighbour votes and pieces are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"pipeline-{name}")
    return docs
