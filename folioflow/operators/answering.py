"""From ranked evidence to prompts, answers with citations, and provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

ITEM_FIELDS = ("doc_id", "page_index", "score", "modality", "text", "chunk_id", "region_id", "crop_path", "source")
IMAGE_PLACEHOLDER = "[figure or table: see the attached image]"
VISION_NOTE = "Some evidence is attached as images; read them where a tag says so."


def evidence_lists(items: DataFrame, questions: DataFrame, most: int = 6) -> DataFrame:
    """(qid, question, evidence): the first ``most`` items of each question in order; none gives an empty list."""
    kept = items.filter(F.col("position") <= most)
    lists = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*ITEM_FIELDS).alias("item")))).alias("l"))
    lists = lists.select("qid", F.transform("l", lambda x: x["item"]).alias("evidence"))
    empty = F.array().cast(lists.schema["evidence"].dataType)
    return questions.select("qid", "question").join(lists, "qid", "left").withColumn("evidence", F.coalesce("evidence", empty))


def blank_images(evidence: Column, most: int = 4) -> Column:
    """Evidence as shown to a vision model: the first ``most`` images with a crop show a note and no caption."""
    usable = lambda x: (x["modality"] == "image") & (F.coalesce(x["crop_path"], F.lit("")) != "")
    shown = lambda x, i: F.when(
        usable(x) & (F.size(F.filter(F.slice(evidence, F.lit(1), i + 1), usable)) <= most), x.withField("text", F.lit(IMAGE_PLACEHOLDER))
    ).otherwise(x)
    return F.transform(evidence, shown)


def attached_images(evidence: Column, most: int = 4) -> Column:
    usable = F.filter(evidence, lambda x: (x["modality"] == "image") & (F.coalesce(x["crop_path"], F.lit("")) != ""))
    return F.slice(F.transform(usable, lambda x: x["crop_path"]), 1, most)


def prompts(lists: DataFrame, step_by_step: bool = True, vision: bool = False, max_images: int = 4) -> DataFrame:
    """``lists`` with system and user prompts, and the images to attach for a vision model."""
    shown = blank_images(F.col("evidence"), max_images) if vision else F.col("evidence")
    user = tx.user_prompt(F.col("question"), tx.evidence_block(shown), step_by_step)
    images = attached_images(F.col("evidence"), max_images) if vision else F.array().cast("array<string>")
    noted = F.when(F.size(images) > 0, F.concat(F.lit(VISION_NOTE + "\n\n"), user)).otherwise(user)
    return lists.select("*", F.lit(tx.SYSTEM_PROMPT).alias("system_prompt"), noted.alias("user_prompt"), images.alias("images"))


def answers(prompted: DataFrame, reply: Callable[[Column, Column, Column], Column], paths: DataFrame | None = None) -> DataFrame:
    """(qid, question, text, reasoning, citations, evidence, graph_paths) from a model's replies.

    ``reply`` maps the system prompt, the user prompt and the images to a string column.
    """
    content = prompted.withColumn("content", reply(F.col("system_prompt"), F.col("user_prompt"), F.col("images")))
    out = content.select(
        "qid",
        "question",
        tx.answer_of(F.col("content")).alias("text"),
        tx.reasoning_of(F.col("content")).alias("reasoning"),
        tx.citations(F.col("content"), F.col("evidence")).alias("citations"),
        "evidence",
    )
    none = F.array().cast("array<string>")
    if paths is None:
        return out.withColumn("graph_paths", none)
    return out.join(paths.select("qid", F.col("paths").alias("graph_paths")), "qid", "left").withColumn("graph_paths", F.coalesce("graph_paths", none))


def provenance(answered: DataFrame) -> DataFrame:
    """One record per answer, with each evidence item's source, rounded score and whether it is cited."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    some = lambda c: F.when(c != "", c)

    def trace(x: Column) -> Column:
        source = F.coalesce(some(x["chunk_id"]), some(x["region_id"]), F.lit(""))
        return F.struct(
            source.alias("source_id"), x["doc_id"].alias("doc_id"), x["page_index"].alias("page_index"), x["modality"].alias("modality"), x["source"].alias("retrieval_source"),
            F.round(x["score"], 4).alias("score"), F.array_contains(F.col("citations"), source).alias("cited"), empty(x["crop_path"]).alias("crop_path"), x["text"].alias("text"),
        )

    return answered.select("qid", "question", F.col("text").alias("answer"), "reasoning", F.transform("evidence", trace).alias("evidence"), "graph_paths")


def evidence_table(records: DataFrame) -> DataFrame:
    """Rows for display, cited items first and else in order; ``label`` has at most 200 characters."""
    each = records.select("qid", F.posexplode("evidence").alias("pos", "e"))
    order = Window.partitionBy("qid").orderBy(F.desc("e.cited"), "pos")
    return each.select(
        "qid",
        F.row_number().over(order).alias("place"),
        F.col("e.source_id").alias("source_id"),
        F.col("e.modality").alias("modality"),
        F.round("e.score", 3).alias("score"),
        F.when(F.col("e.cited"), "yes").otherwise("").alias("cited"),
        F.substring("e.text", 1, 200).alias("label"),
    )
