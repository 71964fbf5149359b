"""A corpus pipeline from five of the operators: each stage works on what the one before has kept.

``run(spark, sf_dir)`` writes each stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import put_back, row_key, set_aside, table, without
from fieldloom.llm.decontaminate import drop_contaminated
from fieldloom.llm.mixing import mix_to_targets
from fieldloom.llm.ngram_join import drop_near_duplicates
from fieldloom.llm.quality import quality_scores
from fieldloom.llm.sharding import hilbert_shards
from fieldloom.session import stored

#: Wanted shares of tokens by language and topic; a source's share is an equal one.
MIX_TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.6, "de": 0.15, "es": 0.1, "fr": 0.15},
    "topic": {"general": 0.9, "licence": 0.04, "access": 0.02, "contact": 0.04},
}
#: Share of the tokens that is sampled.
MIX_FRACTION = 0.8
SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. A document without an id is judged by a score of its
    own like any other; of rows with one id, each text by its own score."""
    docs, names = set_aside(docs)
    keyed = docs.withColumn("_key", row_key("doc_id", "text"))
    labels = table(spark, sf_dir, "labels")
    # The key tells rows of one id apart; labels belong to ids.
    scores = quality_scores(docs, labels, keep=[row_key("doc_id", "text").alias("_key")])
    rejected = stored(scores.filter("predicted = 0").select("_key").distinct(), "rejected")
    return put_back(without(keyed, rejected, ["_key"]).select(*docs.columns), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents in the wanted proportions."""
    return mix_to_targets(docs, MIX_TARGETS, MIX_FRACTION).filter("sampled").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and the place in it."""
    return hilbert_shards(docs, shards=SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No SQL: a stage learns its decisions and another samples by a hash that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
