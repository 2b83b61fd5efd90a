"""String functions, prompts, answers and provenance over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answering, layout, qa
from .registry import query, table

#: Replies as a model might give them, made of the documents' own words: whole texts, the mark between their halves.
REPLY_SQL = """reply AS (SELECT doc_id, 'Reasoning: ' || substr(text, 1, length(text) // 2) || CASE WHEN doc_id % 3 = 0 THEN ' ANSWER: draft [S9] ' ELSE '' END ||
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE chr(10) || 'Answer: ' END || substr(text, length(text) // 2 + 1) || ' [S' || (1 + doc_id % 3) || '] [S1] [S1, S2]' AS content FROM documents)"""


def replies(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("doc_id"), F.col("text")
    draft = F.when(k % 3 == 0, " ANSWER: draft [S9] ").otherwise("")
    head = F.when(k % 5 == 0, "").otherwise("\nAnswer: ")
    half = F.floor(F.char_length(t) / 2).cast("int")
    content = F.concat(F.lit("Reasoning: "), F.substring(t, F.lit(1), half), draft, head, F.substring(t, half + 1, F.char_length(t)), F.lit(" [S"), (1 + k % 3).cast("string"), F.lit("] [S1] [S1, S2]"))
    return table(spark, d, "documents").select("doc_id", content.alias("content"))


@query(f"""WITH {REPLY_SQL} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\\[(S\\d+)\\]', 1))), ',') AS tags FROM reply""")
def citation_tags(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("doc_id", F.array_join(tx.citation_tags(F.col("content")), ",").alias("tags"))


@query(f"""WITH {REPLY_SQL}, s AS (SELECT doc_id, content, regexp_matches(content, '(?i)answer:') AS has FROM reply)
SELECT doc_id, regexp_replace(CASE WHEN has THEN regexp_extract(content, '(?is)^.*answer:(.*)$', 1) ELSE content END, '^\\s+|\\s+$', '', 'g') AS answer,
  CASE WHEN has THEN regexp_replace(regexp_replace(regexp_extract(content, '(?is)^(.*)answer:.*$', 1), '(?i)reasoning:', '', 'g'), '^\\s+|\\s+$', '', 'g') ELSE '' END AS reasoning FROM s""")
def answer_split(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return replies(spark, d).select("doc_id", tx.answer_of(c).alias("answer"), tx.reasoning_of(c).alias("reasoning"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Score: ' || round(value, 2) WHEN 1 THEN '-0.5' WHEN 2 THEN '4/5' WHEN 3 THEN 'none' ELSE 'about .75 or so' END AS reply FROM events)
SELECT event_id, CASE WHEN regexp_matches(reply, '\\d*\\.?\\d+') THEN greatest(0.0, least(1.0, regexp_extract(reply, '\\d*\\.?\\d+')::DOUBLE)) END AS score FROM s""")
def score_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    reply = F.when(k == 0, F.concat(F.lit("Score: "), F.round("value", 2).cast("string"))).when(k == 1, "-0.5").when(k == 2, "4/5").when(k == 3, "none").otherwise("about .75 or so")
    return table(spark, d, "events").select("event_id", tx.judge_score(reply).alias("score"))


@query("""WITH s AS (SELECT p_partkey, p_partkey % 5 AS k, p_brand FROM part)
SELECT p_partkey, 0::BIGINT AS pos, 'part ' || p_partkey AS subject, 'has brand' AS relation, p_brand AS object FROM s WHERE k IN (0, 1)
UNION ALL SELECT p_partkey, 1, 'None', 'is', 'known' FROM s WHERE k = 1""")
def triples_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    good = F.concat(F.lit('{"subject": " part '), F.col("p_partkey").cast("string"), F.lit('", "relation": "has brand", "object": "'), F.col("p_brand"), F.lit('"}'))
    reply = (
        F.when(k == 0, F.concat(F.lit("Here: ["), good, F.lit("] done")))
        .when(k == 1, F.concat(F.lit("["), good, F.lit(', {"subject": null, "relation": "is", "object": "known"}, 7, {"subject": "x", "relation": " "}]')))
        .when(k == 2, F.concat(F.lit("["), good))
        .when(k == 3, "[not json]")
        .otherwise("nothing")
    )
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(tx.triples(reply)).alias("pos", "t"))
    return rows.select("p_partkey", "pos", "t.*")


@query("""SELECT doc_id, trim(regexp_replace(chr(10) || ' "' || text || '?"' || chr(9), '^\\s+|\\s+$', '', 'g'), '"') AS question, contains(lower(text), lower(substr(text, 3, 5))) AS names_it FROM documents""")
def question_cleanup(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat(F.lit('\n "'), F.col("text"), F.lit('?"\t'))
    return table(spark, d, "documents").select("doc_id", tx.clean_question(reply).alias("question"), tx.mentions(F.col("text"), F.substring("text", 3, 5)).alias("names_it"))


@query("""SELECT p_partkey, regexp_matches(lower(q), '(^|[^\\p{L}\\p{N}_])' || w || '($|[^\\p{L}\\p{N}_])') AS found FROM
(SELECT p_partkey, 'é' || p_name || ' and (' || p_type || ')' AS q, lower(split_part(p_name, ' ', 1)) AS w FROM part)""")
def whole_word(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("é"), "p_name", F.lit(" and ("), "p_type", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", tx.has_word(F.lower(q), F.lower(F.element_at(F.split("p_name", " "), 1))).alias("found"))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice / 40 AS x, floor(o_totalprice / 40)::BIGINT AS w FROM orders)
SELECT o_orderkey, CASE WHEN x < 60 THEN printf('%.1fs', x) WHEN w < 3600 THEN printf('%dm %02ds', w // 60, w % 60) ELSE printf('%dh %02dm %02ds', w // 3600, w % 3600 // 60, w % 60) END AS timed,
  CASE WHEN w >= 3600 THEN printf('%dh %dm %ds', w // 3600, w % 3600 // 60, w % 60) WHEN w >= 60 THEN printf('%dm %ds', w // 60, w % 60) ELSE printf('%ds', w) END AS plain FROM s""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice") / 40
    return table(spark, d, "orders").select("o_orderkey", tx.short_duration(x).alias("timed"), tx.plain_duration(x).alias("plain"))


@query("""SELECT o_orderkey, CASE WHEN greatest(w, h) < 896 THEN greatest(1, round_even(w * (896 / greatest(w, h)), 0)::BIGINT) ELSE w END AS width,
  CASE WHEN greatest(w, h) < 896 THEN greatest(1, round_even(h * (896 / greatest(w, h)), 0)::BIGINT) ELSE h END AS height
FROM (SELECT o_orderkey, 8 + o_orderkey % 1000 AS w, 8 + o_custkey % 700 AS h FROM orders)""")
def crop_upscaling(spark: SparkSession, d: str) -> DataFrame:
    size = tx.upscaled(8 + F.col("o_orderkey") % 1000, 8 + F.col("o_custkey") % 700)
    return table(spark, d, "orders").select("o_orderkey", size["width"].alias("width"), size["height"].alias("height"))


ITEMS_SQL = """items AS (SELECT conv_id, turn, 'C' || conv_id AS doc_id, turn AS page_index, 1.0 / (turn + 3) AS score, CASE WHEN role = 'user' THEN 'image' ELSE 'text' END AS modality, text,
  CASE WHEN role <> 'user' THEN 'C' || conv_id || ':' || turn || ':c0' END AS chunk_id, CASE WHEN role = 'user' THEN 'C' || conv_id || ':' || turn || ':r0' END AS region_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position FROM conversations)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    doc, user = F.concat(F.lit("C"), F.col("conv_id").cast("string")), F.col("role") == "user"
    page = F.concat_ws(":", doc, F.col("turn").cast("string"))
    return c.select(
        F.col("conv_id").alias("qid"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("position"), doc.alias("doc_id"), F.col("turn").cast("int").alias("page_index"),
        (1.0 / (F.col("turn") + 3)).alias("score"), F.when(user, "image").otherwise("text").alias("modality"), "text", F.when(~user, F.concat(page, F.lit(":c0"))).alias("chunk_id"),
        F.when(user, F.concat(page, F.lit(":r0"))).alias("region_id"), F.lit(None).cast("string").alias("crop_path"), F.lit("text_dense").alias("source"),
    )


def evidence(spark: SparkSession, d: str) -> DataFrame:
    found = items(spark, d)
    return answering.evidence_lists(found, found.select("qid", F.lit("what?").alias("question")).distinct())


@query(f"""WITH {ITEMS_SQL} SELECT conv_id AS qid, string_agg('[S' || position || '] (doc ' || doc_id || ', page ' || page_index || ', ' || modality || ')' || chr(10) ||
  regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY position) AS block FROM items WHERE position <= 6 GROUP BY conv_id""")
def evidence_format(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).select("qid", tx.evidence_block(F.col("evidence")).alias("block"))


@query(f"""WITH {ITEMS_SQL} SELECT conv_id AS qid, coalesce(chunk_id, region_id) AS source_id, doc_id, page_index::BIGINT AS page_index, modality, round(score, 4) AS score, position IN (1, 2) AS cited FROM items WHERE position <= 6""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    prompted = answering.prompts(evidence(spark, d))
    answered = answering.answers(prompted, lambda s, u, i: F.lit("Reasoning: r Answer: a [S2] [S1] [S77]"))
    each = answering.provenance(answered).select("qid", F.explode("evidence").alias("e"))
    return each.select("qid", "e.source_id", "e.doc_id", "e.page_index", "e.modality", "e.score", "e.cited")


@query(f"""WITH {ITEMS_SQL} SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY position IN (2, 3) DESC, position) AS place, coalesce(chunk_id, region_id) AS source_id,
  CASE WHEN position IN (2, 3) THEN 'yes' ELSE '' END AS cited, substr(text, 1, 200) AS label FROM items WHERE position <= 6""")
def evidence_gallery(spark: SparkSession, d: str) -> DataFrame:
    answered = answering.answers(answering.prompts(evidence(spark, d)), lambda s, u, i: F.lit("Answer: a [S3][S2]"))
    return answering.evidence_table(answering.provenance(answered)).select("qid", "place", "source_id", "cited", "label")


@query("""SELECT doc_id, 'text' AS qtype, 'c' || doc_id AS gold_id, 'chunk' AS gold_kind FROM documents""")
def qa_upgrade(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "documents").select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("gold_chunk_id"))
    return qa.upgrade(old).select("doc_id", "qtype", "gold_id", "gold_kind")


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN text ELSE '[figure region]' END AS shown FROM documents JOIN labels USING (doc_id)""")
def image_text_fallback(spark: SparkSession, d: str) -> DataFrame:
    from ..schemas import FIGURE

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("category", F.lit(FIGURE)).withColumn("caption", F.when(F.col("toxic") == 1, F.col("text")).otherwise(""))
    with_caption = layout.captioned(rows).select("doc_id", F.col("caption").alias("shown"))
    rest = rows.filter("caption = ''").select("doc_id", F.lit("[figure region]").alias("shown"))
    return with_caption.unionByName(rest)
