"""The corpus pipeline: documents through five stages, each written and read again.

Stages keep all columns of documents, whatever else these hold. An empty table stays empty. Documents whose text is null or empty go in the
first two stages; rows without language, source or id go on as far as their texts do. Copies go in the third stage, in
which a row is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwright.llm import langid, minhash, mixing, packing, quality_rules
from pairwright.llm.storage import discard, held_tables, materialize, owner, small_batches_from_now


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str, sure: float = 0.6, sure_chars: int = 200) -> DataFrame:
    """Rejects texts without a language, and those of which the text surely contradicts the label.

    A prediction is sure from a score of `sure` on and for texts of sure_chars characters and more: a shorter text has some twenty phrases
    in any language, so a name or two may turn the ratio, and its label is then the better witness.
    """
    small_batches_from_now(spark)  # the rows are computed when the caller writes them
    named = langid.identify(docs, langid.learn(docs))
    wrong = (F.col("lang_pred") != F.col("lang")) & (F.col("score") >= sure) & (F.length("text") >= sure_chars)
    return named.where((F.col("lang_pred") != "und") & ~F.coalesce(wrong, F.lit(False))).select(*docs.columns)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the quality rules reject."""
    small_batches_from_now(spark)
    return quality_rules.assess(docs, quality_rules.references(docs)).where("kept").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (similarity 0.8 or more)."""
    return minhash.deduplicate(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents up to 90 % of all tokens by the target weights, each at most once; the one in which a leaf's prefix ends is taken whole."""
    return mixing.mix(docs, percent=90, max_epochs=1, crossing=True).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all pieces of the documents into sequences of 4,096 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language", by_language),
    ("quality", by_quality),
    ("near_duplicates", without_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL expresses neither the language model nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents. Each stage's tables are deleted when the next stage's rows are written."""
    docs, before, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(held_tables()), set()
    for name, stage in STAGES[:-1]:
        docs = owner(lambda docs=docs, stage=stage, name=name: materialize(stage(spark, docs, sf_dir), name)[0])()
        discard(spark, *own)
        own = set(held_tables()) - before
    return STAGES[-1][1](spark, docs, sf_dir)
