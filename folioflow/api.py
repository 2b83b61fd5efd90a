"""Driver-side entry points that answer with plain JSON records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answering
from .plans.retrieval import System


def _asked(spark: SparkSession, questions: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "qid bigint, question string")


def query(spark: SparkSession, system: System, questions: list[str]) -> list[dict]:
    """question, answer, citations and graph paths of each question."""
    out = system.answer(_asked(spark, questions)).select("qid", F.to_json(F.struct("question", F.col("text").alias("answer"), "citations", "graph_paths")).alias("j"))
    return [json.loads(r["j"]) for r in out.orderBy("qid").toLocalIterator()]


def explain(spark: SparkSession, system: System, questions: list[str]) -> list[dict]:
    """The whole provenance record of each question."""
    out = system.explain(_asked(spark, questions))
    return [json.loads(r["j"]) for r in out.select("qid", F.to_json(F.struct(*[c for c in out.columns if c != "qid"])).alias("j")).orderBy("qid").toLocalIterator()]


def evidence_rows(spark: SparkSession, system: System, question: str) -> list[dict]:
    """Rows for an evidence table or gallery, cited items first."""
    rows = answering.evidence_table(system.explain(_asked(spark, [question]))).orderBy("place")
    return [r.asDict() for r in rows.toLocalIterator()]
