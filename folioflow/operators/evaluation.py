"""Gold ranks, retrieval metrics, judge scores and comparisons of variants, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_rank(ids: Column, docs: Column, gold_id: Column, gold_doc: Column, allow_doc: Column) -> Column:
    """Rank from 1 of the gold id, else, if allowed, of the first item from its document; null when neither is there."""
    exact = F.coalesce(F.array_position(ids, gold_id), F.lit(0))
    sibling = F.coalesce(F.array_position(docs, gold_doc), F.lit(0))
    has_doc = F.coalesce(gold_doc, F.lit("")) != ""
    return F.when(exact > 0, exact).when(F.coalesce(allow_doc, F.lit(True)) & has_doc & (sibling > 0), sibling).cast("int")


def with_gold_ranks(qa: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``qa`` with the rank of its gold in ``retrieved`` (qid, position, item, doc_id); only text questions fall back to the document."""
    lists = retrieved.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "item", F.coalesce("doc_id", F.lit("")).alias("doc_id")))).alias("l"))
    lists = lists.select("qid", F.col("l.item").alias("ids"), F.col("l.doc_id").alias("docs"))
    rank = gold_rank(F.col("ids"), F.col("docs"), F.col("gold_id"), F.col("gold_doc_id"), F.col("qtype") == "text")
    return qa.join(lists, "qid", "left").withColumn("rank", rank).drop("ids", "docs")


def recall_at(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1 / rank, F.lit(0.0))


def ndcg_at(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)


def metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """(by…, qtype, metric, value): means by question type and pooled (qtype ``overall``), in one pass."""
    r = F.col("rank")
    values = {"mrr": reciprocal(r)} | {f"recall@{k}": recall_at(r, k) for k in ks} | {f"ndcg@{k}": ndcg_at(r, k) for k in ks}
    flat = ranked.select(*by, "qtype", *[v.alias(n) for n, v in values.items()])
    return _pooled(flat, list(values), by, digits)


def judge_means(scored: DataFrame, columns: tuple[str, ...] = ("faithfulness", "answer_relevancy"), by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Like ``metrics`` for judge scores: nulls are skipped, and a metric without any score is left out."""
    return _pooled(scored.select(*by, "qtype", *columns), list(columns), by, digits).filter("value is not null")


def _pooled(flat: DataFrame, names: list[str], by: tuple[str, ...], digits: int) -> DataFrame:
    keys = [F.col(c) for c in by]
    means = [F.round(F.avg(F.col(f"`{n}`")), digits).alias(n) for n in names]
    sets = [[*keys, F.col("qtype")], keys]
    out = flat.groupingSets(sets, *keys, F.col("qtype")).agg(F.grouping("qtype").alias("all_types"), *means)
    out = out.withColumn("qtype", F.when(F.col("all_types") == 1, "overall").otherwise(F.col("qtype")))
    return out.unpivot([*by, "qtype"], [F.col(f"`{n}`") for n in names], "metric", "value")


def deltas(values: DataFrame, baseline: str = "baseline", digits: int = 4) -> DataFrame:
    """(variant, qtype, metric, delta) against the baseline; types that it lacks drop out, metrics count as 0."""
    base = values.filter(F.col("variant") == baseline)
    types = base.select("qtype").distinct()
    base = base.select("qtype", "metric", F.col("value").alias("base"))
    rows = values.filter(F.col("variant") != baseline).join(types, "qtype", "left_semi").join(base, ["qtype", "metric"], "left")
    return rows.select("variant", "qtype", "metric", F.round(F.col("value") - F.coalesce("base", F.lit(0.0)), digits).alias("delta"))


def judged_sample(answers: DataFrame, most: int) -> DataFrame:
    """The first ``most`` answers of each type by their place in the question set; 0 or less keeps all."""
    if most <= 0:
        return answers
    order = Window.partitionBy("qtype").orderBy("place")
    return answers.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")


def question_counts(qa: DataFrame) -> DataFrame:
    """(qtype, n) with the total as ``total``."""
    out = qa.rollup("qtype").agg(F.grouping("qtype").alias("g"), F.count("*").alias("n"))
    return out.select(F.when(F.col("g") == 1, "total").otherwise(F.col("qtype")).alias("qtype"), "n")


def channel_firing(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(channel, fired, total_hits, mean_hits) over all queries; a channel fires where it has a hit."""
    per = hits.groupBy("channel", "qid").agg(F.count("*").alias("h"))
    n = queries.agg(F.count("*").alias("queries"))
    out = per.groupBy("channel").agg(F.count("*").alias("fired"), F.sum("h").alias("total_hits"))
    return out.join(F.broadcast(n)).select("channel", "fired", "total_hits", F.round(F.col("total_hits") / F.col("queries"), 6).alias("mean_hits"))
