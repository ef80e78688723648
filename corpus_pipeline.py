"""A corpus from raw documents: rules, classifier, near duplicates, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.

Defined results, stage by stage: a null or empty text has no words, so the rules reject it; a stage that is given one keeps its row (rules and
classifier judge it as text without words, near duplicates links it with nothing, the mixture places it, its ids are empty). Very long
texts count whole everywhere. Rows that repeat are judged alike by rules and classifier; of rows with the same doc_id and text one stays after
near duplicates; rows without doc_id take no part in groups and stay. Ties: a score at the threshold stays, the least doc_id of a group stays,
equal deadlines go by the name of the source. An empty table passes through as an empty one. Columns beyond those of documents pass
through the first four stages whatever their names; the last returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelweir.llm import bpe, near_dedup, quality_classifier, quality_rules, source_mixing
from pixelweir.llm.common import documents, written

#: Rows that go to Python at once. Spark's own figure (10,000) lets each task hold tens of MB of texts outside the heap.
AT_ONCE = 1000


def in_small_batches(spark: SparkSession) -> None:
    """Sets the session to hand Python AT_ONCE rows at a time (or fewer, if it has fewer set); every row still goes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    spark.conf.set(name, min(rows, AT_ONCE) if rows > 0 else AT_ONCE)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    in_small_batches(spark)
    return quality_rules.keep_passing(docs, "prose-1")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of low quality go."""
    in_small_batches(spark)
    return quality_classifier.keep_predicted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    in_small_batches(spark)
    return near_dedup.keep_one(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources take their turns by weight; the places are noted for the last stage."""
    return source_mixing.mix_and_note(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, place in the mixture (slot, in_block) and token ids of every document.

    Files do not keep the order of the stage before, so each document takes the place that the mixture noted for it (null without a mixture).
    Texts meet their places before they are encoded, as they are smaller than their ids: one shuffle of the texts, no sort, and no copy of the ids.
    """
    in_small_batches(spark)
    placed = source_mixing.noted_places(docs.select("doc_id", "source", "text"))
    return bpe.encode(placed, name="input_ids").select("doc_id", "source", "slot", "in_block", "input_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_dedup", deduplicate),
    ("source_mixing", mixture),
    ("bpe", tokens),
]

#: The near-duplicate and token stages have no SQL form; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
