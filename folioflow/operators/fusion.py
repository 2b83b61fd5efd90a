"""Fusing ranked channels by weighted reciprocal ranks, and the final cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("text", "graph", "image")


def tagged(hits: DataFrame, channel: str, weight: float) -> DataFrame:
    """A channel's hits (qid, item, rank from 1, …) with its place in the fixed order and its weight."""
    return hits.withColumn("channel", F.lit(CHANNELS.index(channel))).withColumn("weight", F.lit(float(weight)))


def fuse(hits: DataFrame, rrf_k: int = 60) -> DataFrame:
    """(qid, item, score, channel, rank, position): summed weight / (rrf_k + rank), best first.

    ``channel`` and ``rank`` are those of the item's first occurrence, by channel and then rank, which
    also orders equal scores. An item that a channel lists twice counts twice. A column ``source`` is carried
    from there too.
    """
    source = ["source"] if "source" in hits.columns else []
    first = F.min(F.struct("channel", "rank", *source)).alias("first")
    score = F.round(F.sum(F.col("weight") / (rrf_k + F.col("rank"))), 12).alias("score")
    fused = hits.groupBy("qid", "item").agg(score, first)
    fused = fused.select("qid", "item", "score", F.col("first.channel").alias("channel"), F.col("first.rank").alias("rank"), *[F.col(f"first.{c}").alias(c) for c in source])
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "channel", "rank", "item")
    return fused.withColumn("position", F.row_number().over(order))


def rerank(fused: DataFrame, scores: DataFrame) -> DataFrame:
    """``fused`` reordered by a reranker's scores (qid, item, rerank); equal ones keep their order."""
    scored = fused.join(scores, ["qid", "item"])
    order = Window.partitionBy("qid").orderBy(F.desc("rerank"), "position")
    return scored.withColumn("new_position", F.row_number().over(order)).withColumn("score", F.col("rerank")).drop("rerank", "position").withColumnRenamed("new_position", "position")


def cut(fused: DataFrame, top_k: int = 5) -> DataFrame:
    return fused.filter(F.col("position") <= top_k)
