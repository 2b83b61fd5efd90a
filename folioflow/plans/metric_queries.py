"""Retrieval metrics, judge scores and comparisons over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from .registry import query, table
from .search_queries import sparse_sql, word_search

#: Words of an anchor.
SHINGLE = 4

#: Questions are the benchmark texts. The gold is the first document that contains the text.
GOLD_SQL = """gold AS (SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'visual' ELSE 'multihop' END AS qtype, min(doc_id) AS gold
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
hit AS (SELECT qid, rank, doc_id, 'src' || doc_id % 20 AS parent FROM sparse),
ranked AS (SELECT g.qid, qtype, coalesce(min(rank) FILTER (doc_id = gold), CASE WHEN qtype = 'text' THEN min(rank) FILTER (parent = 'src' || gold % 20) END) AS rank FROM gold g LEFT JOIN hit USING (qid) GROUP BY g.qid, qtype)"""


def with_containing(b: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id) of each text of ``b`` (qid, text) and each document that contains it, anywhere.

    The words of a text but its first and last are whole words of every document that contains it. The first
    ``SHINGLE`` of them anchor the text among the word shingles of whole documents, joined by hash; only texts
    too short for an anchor are held against every document. Anchors, two longs a text, are broadcast.
    """
    words = lambda text: F.split(text, r"\s+")
    cut = lambda w, at: F.xxhash64(F.slice(w, at, SHINGLE))
    anchored = F.size(words(F.col("text"))) >= SHINGLE + 2
    anchors = b.filter(anchored).select("qid", cut(words(F.col("text")), F.lit(2)).alias("shingle"))
    d = docs.select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") >= SHINGLE)
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1)), lambda i: cut(F.col("w"), i)))
    d = d.select("doc_id", F.explode(shingles).alias("shingle"))
    likely = d.join(F.broadcast(anchors), "shingle").select("qid", "doc_id").distinct()
    whole = docs.select("doc_id", F.col("text").alias("whole"))
    found = likely.join(b, "qid").join(whole, "doc_id").filter(F.contains("whole", "text"))
    short = b.filter(~anchored).join(whole, F.contains("whole", "text"))
    return found.select("qid", "doc_id").unionByName(short.select("qid", "doc_id"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    found = with_containing(b, table(spark, d, "documents")).groupBy("qid").agg(F.min("doc_id").alias("gold"))
    qtype = F.when(F.col("qid") % 3 == 0, "text").when(F.col("qid") % 3 == 1, "visual").otherwise("multihop")
    rows = b.select("qid", qtype.alias("qtype")).join(found, "qid", "left")
    return rows.select("qid", "qtype", F.col("gold").cast("string").alias("gold_id"), F.concat(F.lit("src"), (F.col("gold") % 20).cast("string")).alias("gold_doc_id"))


def ranked(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    hits = word_search(spark, d, k)
    hits = hits.select("qid", F.col("rank").alias("position"), F.col("doc_id").cast("string").alias("item"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("doc_id"))
    return evaluation.with_gold_ranks(gold(spark, d), hits)


@query(f"WITH {sparse_sql(10)}, {GOLD_SQL} SELECT qid, qtype, rank FROM ranked")
def gold_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("qid", "qtype", "rank")


def metrics_sql(source: str) -> str:
    means = ["avg(coalesce(1.0::DOUBLE / rank, 0))"] + [f"avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END)" for k in (1, 3, 5, 10)] + [f"avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0.0 END)" for k in (1, 3, 5, 10)]
    names = ["mrr", *[f"recall@{k}" for k in (1, 3, 5, 10)], *[f"ndcg@{k}" for k in (1, 3, 5, 10)]]
    rows = ", ".join(f"('{n}')" for n in names)
    pick = " ".join(f"WHEN '{n}' THEN {m}" for n, m in zip(names, means, strict=True))
    return f"SELECT coalesce(qtype, 'overall') AS qtype, metric, round(CASE metric {pick} END, 6) AS value FROM {source}, (VALUES {rows}) t(metric) GROUP BY GROUPING SETS ((qtype, metric), (metric))"


@query(f"WITH {sparse_sql(10)}, {GOLD_SQL} {metrics_sql('ranked')}")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(ranked(spark, d))


@query(f"""WITH {sparse_sql(10)}, {GOLD_SQL}, shifted AS (SELECT qid, qtype, CASE WHEN rank > 1 THEN rank - 1 ELSE rank END AS rank FROM ranked),
base AS ({metrics_sql('ranked')}), var AS ({metrics_sql('shifted')})
SELECT 'better' AS variant, qtype, metric, round(v.value - coalesce(b.value, 0), 4) AS delta FROM var v JOIN base b USING (qtype, metric)""")
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    base = ranked(spark, d)
    better = base.withColumn("rank", F.when(F.col("rank") > 1, F.col("rank") - 1).otherwise(F.col("rank")))
    tag = lambda df, n: evaluation.metrics(df).withColumn("variant", F.lit(n))
    return evaluation.deltas(tag(base, "baseline").unionByName(tag(better, "better")))


@query("""SELECT coalesce(qtype, 'overall') AS qtype, metric, value FROM (
SELECT lang AS qtype, 'faithfulness' AS metric, round(avg(quality), 6) AS value FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())
UNION ALL SELECT lang, 'answer_relevancy', round(avg(toxic), 6) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ()))""")
def judge_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("qtype")).join(table(spark, d, "labels"), "doc_id", "left")
    return evaluation.judge_means(rows.select("qtype", F.col("quality").cast("double").alias("faithfulness"), F.col("toxic").cast("double").alias("answer_relevancy")))


@query("""SELECT conv_id, turn, qtype FROM (SELECT conv_id, turn, role AS qtype, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) AS n FROM conversations) WHERE n <= 50""")
def judge_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("qtype"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"))
    return evaluation.judged_sample(c, 50).select("conv_id", "turn", "qtype")


@query("SELECT coalesce(lang, 'total') AS qtype, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), ())")
def question_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.question_counts(table(spark, d, "documents").select(F.col("lang").alias("qtype")))
