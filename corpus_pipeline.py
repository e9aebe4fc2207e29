"""The corpus pipeline: quality, exact duplicates, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import exact, mixing, packing, quality, shingles
from brindle.llm.common import Kept, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of all documents in sf_dir."""
    model = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact.kept_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the one with the smallest id stays."""
    return shingles.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, better ones sooner; the one at which a source's budget ends is cut there."""
    weight = mixing.fit_weight(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixing.mixed_documents(docs, weight=weight(docs["text"]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset; a document that is taken twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", unique),
    ("simhash near-dedup", distinct),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's tables go once its result is kept, that result once the next one's is: disk does not add up over stages."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with Kept.passing() as tables:
            after = Kept(stage(spark, docs, sf_dir), f"stage-{k}")
            tables.remove(after)
        if before:
            before.drop()
        docs, before = after.df, after
        spark.sparkContext._jvm.System.gc()  # else the stage's shuffle files stay until the driver happens to collect its garbage
    return STAGES[-1][1](spark, docs, sf_dir)
