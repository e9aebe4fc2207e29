"""Operator 5: mixing sources to target token budgets. DataFrame functions only.

Each source has a budget of words. Whole epochs of the source come first; what is left of the budget
goes to documents in the order of Efraimidis-Spirakis keys, -ln(u) / weight with u a hash of the
document, so that heavier (better) documents come sooner. The order within a source is a range
partitioning of (source, key) with offsets from the sums of the partitions before, so a source that
holds a third of all rows is spread over as many tasks as the data need.

A document's weight is its quality: a logistic function of a few measures of its text, fitted to the labels of at
most SAMPLE documents of each label (those with the smallest hash of the id; the only rows that come to the driver,
as measures). Measures and weights are DataFrame expressions. Operator 10 judges better, but not without Python
workers, which this operator is to do without; a caller who has its scores as a column gives them as `weight`.

Defined results: a null text has size 0 and is taken 0 times 0 words; a null source is a source, the
last one; equal rows each count; equal keys go by doc_id and a hash of the text, and rows that agree in all of that
are equal; a text of any length counts whole; without labels all documents weigh the same; an empty table gives an
empty result; other columns play no part. The document at which a budget ends gives only its first words, so a
source meets its budget exactly. Sources are a row each in one task, so there may be millions of them, not billions.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fold, keep, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = 7
#: Labelled documents of each label that the weights are fitted to at most; the least weight.
SAMPLE, LEAST = 1024, 0.05


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measures(text: Column) -> list[Column]:
    """Of a text: shares of signs and of capitals, characters a word, and the share of different words."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    words = F.split(text, " ")
    return [
        share(r"""|#$%&*!{}<>=~^\@+_[]"""),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        F.least(n / F.greatest(F.size(words), F.lit(1)), F.lit(50.0)) / 50,
        F.size(F.array_distinct(words)) / F.size(words),
    ]


def fit_weight(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held_out: int = 1, sample: int = SAMPLE):
    """A function of a text column: the probability that its label is 1, fitted outside the held-out fold."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.where(fold(F.col("doc_id"), parts) != held_out).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = [own.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for x in (0, 1)]
    # At most 2 * sample ids, so this side can be broadcast; one row for each of them comes to the driver.
    measured = docs.select("doc_id", F.array(*measures(F.col("text"))).alias("m")).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = sorted((r.label, r.m) for r in measured.groupBy("doc_id", "label").agg(F.min("m").alias("m")).collect())
    y = np.array([r[0] for r in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return lambda text: F.lit(1.0)
    x = np.array([r[1] for r in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.concatenate([np.ones((len(x), 1)), (x - mean) / spread], axis=1)
    w = np.zeros(x.shape[1])
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both labels count the same
    for _ in range(25):  # Newton's steps, with a little decay so that separable labels have an end
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (y - p)) - 1e-3 * w
        w += np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), slope)
    scale = w[1:] / spread
    base = float(w[0] - (scale * mean).sum())

    def weight(text: Column) -> Column:
        z = reduce(add, (m * float(s) for m, s in zip(measures(text), scale)), F.lit(base))
        return F.greatest(F.lit(LEAST), 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))

    return weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> also target. Sources in code-point order, null last, get the weights in turn.

    Capped shares have a closed form: with sources in the order of cap / weight, the level is the largest of
    (total - caps before) / (weights from here on). One row a source, so one window over all of them.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("_ratio", "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("_rank", F.row_number().over(every))
        .withColumn("_w", pick)
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    return (
        ranked.withColumn("_level", level)
        .withColumn("target", F.least("_cap", F.max("_level").over(all_rows) * F.col("_w")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weight: Column | None = None, seed: int = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, and _row, a hash that tells documents with one id apart.

    `weight`: a column of docs, above 0; all weigh the same without it.
    """
    sized = keep(
        docs.select(
            "doc_id",
            "source",
            words_in(F.col("text")).alias("size"),
            F.xxhash64("text").alias("_row"),
            (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5).alias("_u"),
            (F.lit(1.0) if weight is None else weight).alias("_weight"),
        ).withColumn("_key", -F.log(F.col("_u") * 2.0**-53) / F.col("_weight")),
        "sized",
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    order = ["_key", "doc_id", "_row"]
    ranged = keep(
        sized.repartitionByRange("source", *order).select("*", F.spark_partition_id().alias("_part")).drop("_u", "_weight"), "ranged"
    )
    sums = ranged.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    starts = sums.select(
        "source",
        "_part",
        (F.sum("_sum").over(Window.partitionBy("source").orderBy("_part")) - F.col("_sum")).alias("_start"),
    )
    plan = (
        starts.alias("a")
        .join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .select(F.col("a.source").alias("_source"), F.col("_part").alias("_part2"), "_start", "source_size", "target")
    )
    run = Window.partitionBy("_part", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.withColumn("_run", F.sum("size").over(run) - F.col("size"))
    joined = within.join(plan, (F.col("_part") == F.col("_part2")) & F.col("source").eqNullSafe(F.col("_source")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_start") - F.col("_run")))
    return joined.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "_row"
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as it is taken; a part taken is its first words, space-joined."""
    taken = mix(docs, **how).groupBy("doc_id", "_row").agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count("*").alias("_n"))
    text = F.col("_doc").getField("text")
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    per = F.col("_taken") / F.col("_n")  # equal rows share what they take
    whole = F.when(F.col("_size") > 0, F.floor(per / F.col("_size"))).otherwise(F.lit(1)).cast("int")
    rest = F.when(F.col("_size") > 0, F.floor(per) - whole * F.col("_size")).otherwise(F.lit(0)).cast("int")
    own = docs.select(F.struct("*").alias("_doc"), "doc_id", F.xxhash64("text").alias("_row"))  # whatever else the columns are called
    joined = own.alias("d").join(
        taken.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_row2"), whole.alias("_whole"), rest.alias("_rest")),
        F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.col("d._row") == F.col("_row2")),
    )
    copies = F.col("_whole") + F.when(F.col("_rest") > 0, 1).otherwise(0)
    rows = joined.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    cut = F.when(F.col("_copy") <= F.col("_whole"), text).otherwise(F.array_join(F.slice(split, 1, F.greatest(F.col("_rest"), F.lit(1))), " "))
    out = rows.select("_doc", cut.alias("_cut"))
    new = {"text": F.col("_cut"), "n_chars": F.length("_cut").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weight = fit_weight(docs, table(spark, sf_dir, "labels"))
    return mix(docs, weight(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")
