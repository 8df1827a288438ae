"""Corpus pipeline: five stages over ``documents``, each one operator of ``loomgraph.llm``.

All stages but the last return the columns of documents; the last returns the encoded documents:
packed piece ids beside the columns that describe a document.
SQL can't express the first stage's model or the last stage's draws, so there is no SQL for the
whole; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, line_dedup, minhash_dedup, sentencepiece_sampling, toxicity
from loomgraph.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on these documents' labels, doesn't reject."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to earlier ones; n_chars follows the text.

    A document all of whose words were in such lines is nothing but a copy and goes. One that had no
    words before, or no text, stays.
    """
    out = line_dedup.remove_lines(docs, emptied=False)
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns]
    return out.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, linked from similarity 0.8 up."""
    return minhash_dedup.dedup(docs, (8, 10))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document beside its other columns, each checked to decode to its text."""
    return sentencepiece_sampling.encode(docs, keep=[c for c in docs.columns if c != "text"], check=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
