"""Ranked lists: probabilities from ranks, merging, top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.operators.skew import ranked


def softmax(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """Adds `p`: exp(score) over its sum in the group; shifted by the largest score, so large scores don't overflow."""
    w = Window.partitionBy(*by)
    x = F.exp(F.col(score) - F.max(score).over(w))
    return rows.withColumn("p", x / F.sum(x).over(w))


def average(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """Adds `p`: the score's share of the group's sum; null where the sum is 0."""
    total = F.sum(score).over(Window.partitionBy(*by))
    return rows.withColumn("p", F.when(total != 0, F.col(score) / total))


RANK, SCORE, EQUAL = "rank", "score", "equal"


def rank_to_p(rows: DataFrame, by: str, item: str, score: str, limit: int | None = None, mode: str = RANK) -> DataFrame:
    """(by, item, rank, p): ranks by falling score (ties by item); a list's p sum to 1.

    mode rank: scores are falling ranks, softmaxed. Neighbours differ by one, so p is exp(1 - rank) over a geometric sum
    of the list's length, and what the ranks are counted from cancels; score: the scores themselves, softmaxed; equal: all
    the same. limit: only the best so many of a list. Lists of any length are ranked in parts; items of a list must differ.
    """
    r = ranked(rows.select(by, item, score), [by], [F.col(score).desc(), F.col(item)])
    if limit:
        r = r.where(F.col("rank") <= limit)
    top = r.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.max(score).alias("_top"))
    if mode == SCORE:  # the largest of a list is the shift, so the sum is made of partial sums
        x = r.join(top, by).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
        p = x.join(x.groupBy(by).agg(F.sum("_e").alias("_sum")), by).withColumn("p", F.col("_e") / F.col("_sum"))
    elif mode == EQUAL:
        p = r.join(top, by).withColumn("p", 1 / F.col("_n"))
    else:
        total = (1 - F.exp(-F.col("_n").cast("double"))) / (1 - F.exp(F.lit(-1.0)))
        p = r.join(top, by).withColumn("p", F.exp(1 - F.col("rank").cast("double")) / total)
    return p.select(by, item, F.col("rank").cast("int").alias("rank"), "p")


def merge_rankings(lists: DataFrame, weights: dict, by: str, item: str, score: str) -> DataFrame:
    """(item, score): softmaxed rank scores of each list, weighted, divided by the weights of the lists that have rows."""
    spark = lists.sparkSession
    w = spark.createDataFrame(list(weights.items()), f"{by} string, w double")
    p = rank_to_p(lists, by, item, score).join(F.broadcast(w), by)
    there = F.broadcast(w.join(lists.select(by).distinct(), by, "left_semi").agg(F.sum("w").alias("total")).withColumn("_one", F.lit(1)))
    s = p.groupBy(item).agg(F.sum(F.col("p") * F.col("w")).alias("s")).withColumn("_one", F.lit(1))
    return s.join(there, "_one").select(item, (F.col("s") / F.col("total")).alias("score"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order that has no ties, with their `rank`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
