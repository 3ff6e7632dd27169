"""The corpus pipeline: documents in, encoded training documents out.

Each stage gets what the one before it wrote. All but the last return the columns of
``documents``; their edge cases are those of the operators they call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaplens.llm import classifier, lines, mixing, sentencepieces, simhash
from gaplens.llm.common import store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.scored(docs, model, least=classifier.THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a later document repeats."""
    out = lines.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    made = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(made.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Near duplicates are those of op1's contract (3-word shingles, 3 of 64 bits), not all texts of
    5-word similarity 0.8: the README has the share of these that it links.
    """
    return simhash.one_of_each(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target mixture."""
    return mixing.mixed(docs).where("kept").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return sentencepieces.encoded(docs, carry=["doc_id", "lang", "source"]).select("row.*", "n_tokens", "ids", "exact", "parity")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing_weights), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each over a written copy of what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"pipeline-{name}")
    return docs
