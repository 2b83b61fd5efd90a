"""Question sets: eligibility, seeded draws, splits and upgrades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LEAST_CHARS = 200


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, by the MD5 of seed and key; the same however the table is dealt out."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)).limit(n)


def eligible_chunks(chunks: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    return chunks.filter(F.char_length("text") >= least)


def eligible_regions(regions: DataFrame) -> DataFrame:
    return regions.filter(tx.strip(F.coalesce("caption", F.lit(""))) != "")


def ask(rows: DataFrame, prompt: Column, reply: Callable[[Column], Column], qtype: str, gold_id: str, gold_kind: str) -> DataFrame:
    """Question rows for golds that the model finds a question for."""
    asked = rows.withColumn("question", tx.clean_question(reply(prompt))).filter(F.coalesce("question", F.lit("")) != "")
    return asked.select(
        "question", F.lit(qtype).alias("qtype"), F.col(gold_id).alias("gold_id"), F.lit(gold_kind).alias("gold_kind"), F.col("doc_id").alias("gold_doc_id"), F.col("page_index").alias("gold_page_index")
    )


def text_questions(chunks: DataFrame, n: int, reply: Callable[[Column], Column], seed: int = 42) -> DataFrame:
    drawn = seeded_sample(eligible_chunks(chunks), "chunk_id", n, seed)
    return ask(drawn, F.concat(F.lit("Write one factual question that this passage answers:\n"), "text"), reply, "text", "chunk_id", "chunk")


def visual_questions(regions: DataFrame, n: int, reply: Callable[[Column], Column], seed: int = 42) -> DataFrame:
    drawn = seeded_sample(eligible_regions(regions), "region_id", n, seed)
    return ask(drawn, F.concat(F.lit("Write one question that the figure or table with this caption answers:\n"), "caption"), reply, "visual", "region_id", "region")


def multihop_attempts(candidates: DataFrame, n: int, max_attempts: int = 0, seed: int = 42) -> DataFrame:
    """Candidates (a, b, c1, c2) in seeded order, cut at the cap of attempts (8 n by default).

    Candidates whose bridge was tried before use up attempts; ``fresh`` marks the first one of each bridge.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), "b", F.lit("|"), "c1"))
    cap = max_attempts or 8 * n
    tried = candidates.withColumn("draw", draw).orderBy("draw", "b", "c1").limit(cap)
    order = Window.partitionBy("c2").orderBy("draw", "b", "c1")
    return tried.withColumn("fresh", F.row_number().over(order) == 1)


def verified_multihop(asked: DataFrame, dense_hits: DataFrame, graph_hits: DataFrame, n: int) -> DataFrame:
    """Questions (qid, question, a, gold_id, draw) that name A, that the graph reaches and dense search misses.

    One question per gold, the first by ``draw``; ``dense_hits`` and ``graph_hits`` are (qid, item).
    """
    named = asked.filter((F.coalesce("question", F.lit("")) != "") & tx.mentions(F.col("question"), F.col("a")))
    hit = lambda h: h.select("qid", F.col("item").alias("gold_id"))
    good = named.join(hit(graph_hits), ["qid", "gold_id"], "left_semi").join(hit(dense_hits), ["qid", "gold_id"], "left_anti")
    order = Window.partitionBy("gold_id").orderBy("draw", "qid")
    return good.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth").orderBy("draw", "qid").limit(n)


def append_missing_splits(stored: DataFrame, made: DataFrame) -> DataFrame:
    """``stored`` and those rows of ``made`` whose question type it doesn't have."""
    return stored.unionByName(made.join(stored.select("qtype").distinct(), "qtype", "left_anti"))


def upgrade(rows: DataFrame) -> DataFrame:
    """Rows of the older format, with gold_chunk_id only, in today's: type text, gold of kind chunk."""
    has = set(rows.columns)
    old = F.col("gold_chunk_id") if "gold_chunk_id" in has else F.lit(None).cast("string")
    legacy = F.col("gold_id").isNull() if "gold_id" in has else F.lit(True)
    gold = F.coalesce(F.col("gold_id"), old) if "gold_id" in has else old
    kind = F.col("gold_kind") if "gold_kind" in has else F.lit(None).cast("string")
    qtype = F.coalesce(F.col("qtype"), F.lit("text")) if "qtype" in has else F.lit("text")
    rest = [c for c in rows.columns if c not in ("gold_id", "gold_kind", "qtype")]
    return rows.select(*rest, qtype.alias("qtype"), gold.alias("gold_id"), F.when(legacy, F.coalesce(kind, F.lit("chunk"))).otherwise(kind).alias("gold_kind"))
