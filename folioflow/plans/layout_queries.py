"""Page keys, regions, chunks, sources and stage resumption over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, layout, qa, search
from ..sources import readers
from ..streaming import incremental
from .registry import query, table

#: Line items stand for annotations: page = order, and boxes made of their measures.
ANN_SQL = """
ann AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS idx,
  1 + l_linenumber % 6 AS category, l_quantity * 10 AS x, fmod(l_extendedprice, 800) AS y, abs(l_discount) * 1000 AS w, abs(l_tax) * 1000 AS h FROM lineitem),
cut AS (SELECT *, greatest(0, least(trunc(x)::BIGINT, 612)) AS x1, greatest(0, least(trunc(y)::BIGINT, 792)) AS y1,
  greatest(0, least(trunc(x + w)::BIGINT, 612)) AS x2, greatest(0, least(trunc(y + h)::BIGINT, 792)) AS y2 FROM ann)
"""


def annotations(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), (F.row_number().over(order) - 1).alias("idx"), (1 + F.col("l_linenumber") % 6).alias("category"),
        (F.col("l_quantity") * 10).alias("x"), (F.col("l_extendedprice") % 800).alias("y"), (F.abs("l_discount") * 1000).alias("w"), (F.abs("l_tax") * 1000).alias("h"),
    )


@query("""SELECT doc_id AS id, regexp_extract(source || '_' || lpad(doc_id::VARCHAR, 5, '0'), '^(.+?)_(\\d+)$', 1) AS doc,
  regexp_extract(source || '_' || lpad(doc_id::VARCHAR, 5, '0'), '^(.+?)_(\\d+)$', 2)::BIGINT AS page, source AS odd_doc, 0::BIGINT AS odd_page FROM documents""")
def parse_key(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("_", "source", F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), tx.page_key_doc(key).alias("doc"), tx.page_key_index(key).alias("page"), tx.page_key_doc(F.col("source")).alias("odd_doc"), tx.page_key_index(F.col("source")).alias("odd_page"))


@query(f"""WITH {ANN_SQL} SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY round_even(y / 20, 0), x, idx) - 1 AS reading_order FROM ann""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_rank(annotations(spark, d), ["page"], "x", "y", "idx").select("page", "idx", "reading_order")


@query(f"""WITH {ANN_SQL} SELECT page, idx, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 END AS x1, CASE WHEN x2 > x1 AND y2 > y1 THEN y1 END AS y1,
  CASE WHEN x2 > x1 AND y2 > y1 THEN x2 END AS x2, CASE WHEN x2 > x1 AND y2 > y1 THEN y2 END AS y2 FROM cut""")
def clamp_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = layout.clamped(*[F.col(c) for c in "xywh"], F.lit(612), F.lit(792))
    return annotations(spark, d).select("page", "idx", *[box[c].alias(c) for c in ("x1", "y1", "x2", "y2")])


def page_table(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d).withColumn("a", F.struct(F.col("idx").cast("long").alias("id"), F.col("category").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), F.lit("").alias("category_name")))
    pages = a.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("idx", "a"))).alias("l"))
    key = F.concat(F.lit("O_"), F.col("page").cast("string"))
    return pages.select(key.alias("key"), F.lit("O").alias("doc_id"), F.col("page").cast("int").alias("page_index"), F.lit(None).cast("binary").alias("image"), F.lit(612).alias("width"), F.lit(792).alias("height"), F.col("l.a").alias("annotations"))


@query(f"""WITH {ANN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round_even(y / 20, 0), x, idx) - 1 AS reading_order FROM cut)
SELECT 'O:' || page || ':' || idx AS region_id, 'O_' || page AS page_key, category, reading_order,
  CASE WHEN category IN (4, 5) AND x2 - x1 >= 8 AND y2 - y1 >= 8 THEN 'crops/O_' || page || '_' || idx || '.png' END AS crop_path
FROM r WHERE category BETWEEN 1 AND 5""")
def regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.extract_regions(page_table(spark, d), "crops").select("region_id", "page_key", "category", "reading_order", "crop_path")


@query(f"""WITH {ANN_SQL} SELECT category, count(*) AS n, count(*) FILTER (category IN (4, 5) AND x2 - x1 >= 8 AND y2 - y1 >= 8) AS eligible FROM cut GROUP BY category""")
def crop_eligibility(spark: SparkSession, d: str) -> DataFrame:
    box = layout.clamped(*[F.col(c) for c in "xywh"], F.lit(612), F.lit(792))
    a = annotations(spark, d).withColumn("ok", layout.crop_eligible(F.col("category"), box))
    return a.groupBy("category").agg(F.count("*").alias("n"), F.count_if("ok").alias("eligible"))


def line_regions(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("reading_order", "text"))
    return lines.select(
        F.concat_ws(":", "source", "doc_id", "reading_order").alias("region_id"), F.col("source").alias("doc_id"), F.concat_ws("_", "source", "doc_id").alias("page_key"),
        F.col("doc_id").cast("int").alias("page_index"), F.lit(1).alias("category"), "reading_order", "text",
    )


CHUNK_SQL = r"""
WITH RECURSIVE lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ro FROM documents),
r AS (SELECT doc_id, source, txt, source || ':' || doc_id || ':' || ro AS rid, row_number() OVER (PARTITION BY doc_id ORDER BY ro) AS n FROM lines WHERE length(txt) >= 40),
fold(doc_id, source, n, buf, ids, len, out_text, out_ids) AS (
  SELECT doc_id, source, n, txt, [rid], length(txt), NULL::VARCHAR, NULL::VARCHAR[] FROM r WHERE n = 1
  UNION ALL
  SELECT f.doc_id, f.source, r.n,
    CASE WHEN NOT f.full_ THEN f.buf || chr(10) || r.txt WHEN f.tail <> '' THEN f.tail || chr(10) || r.txt ELSE r.txt END,
    CASE WHEN f.full_ THEN [r.rid] ELSE list_append(f.ids, r.rid) END,
    CASE WHEN f.full_ THEN length(f.tail) ELSE f.len END + length(r.txt),
    CASE WHEN f.full_ THEN f.body END, CASE WHEN f.full_ THEN f.ids END
  FROM (SELECT fold.*, x.n AS nn, fold.len + length(x.txt) > 1200 AS full_, regexp_replace(buf, '^\s+|\s+$', '', 'g') AS body, right(regexp_replace(buf, '^\s+|\s+$', '', 'g'), 150) AS tail
        FROM fold JOIN r x ON x.doc_id = fold.doc_id AND x.n = fold.n + 1) f JOIN r ON r.doc_id = f.doc_id AND r.n = f.nn),
last AS (SELECT doc_id, max(n) AS n FROM r GROUP BY doc_id),
parts AS (SELECT doc_id, source, n, out_text AS txt, out_ids AS ids FROM fold WHERE out_text IS NOT NULL
  UNION ALL SELECT f.doc_id, f.source, f.n + 1, regexp_replace(buf, '^\s+|\s+$', '', 'g'), ids FROM fold f JOIN last USING (doc_id, n))
SELECT source || ':' || doc_id || ':c' || (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1) AS chunk_id, txt AS text, array_to_string(ids, ',') AS region_ids FROM parts
"""


@query(CHUNK_SQL)
def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_regions(line_regions(spark, d)).select("chunk_id", "text", F.array_join("region_ids", ",").alias("region_ids"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, text, ws, unnest(generate_series(0, greatest(ceil((len(ws) - 250) / 220.0)::BIGINT, 0))) AS i FROM w)
SELECT doc_id, i AS window_no, md5(CASE WHEN len(ws) <= 250 THEN text ELSE array_to_string(list_slice(ws, i * 220 + 1, i * 220 + 250), ' ') END) AS digest FROM s""")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.word_windows(F.col("text"))).alias("window_no", "w"))
    return docs.select("doc_id", "window_no", F.md5("w").alias("digest"))


@query("""SELECT o_orderkey AS image_id, count(l_orderkey) AS n_annotations, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def coco_join(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("O_"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file_name"), F.lit(612).alias("width"), F.lit(792).alias("height"), F.lit(None).cast("binary").alias("image"))
    anns = table(spark, d, "lineitem").select(F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 5 + 1).cast("int").alias("category_id"), F.array("l_quantity").alias("bbox"), F.lit(None).cast("string").alias("category_name"))
    cats = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("id"), F.col("r_name").alias("name"))
    pages = readers.coco_pages(images, anns, cats)
    return pages.select(F.col("page_index").cast("long").alias("image_id"), F.size("annotations").alias("n_annotations"), F.array_join(F.transform("annotations", lambda a: a["id"].cast("string")), ",").alias("lines"))


@query("""SELECT c_custkey, coalesce(n_name, '') AS category_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20""")
def category_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").filter("n_nationkey < 20")
    c = table(spark, d, "customer")
    return c.join(names, c["c_nationkey"] == names["n_nationkey"], "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("category_name"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return search.pending(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("""WITH a AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY user_id),
s AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT * FROM a UNION ALL SELECT * FROM s WHERE user_id NOT IN (SELECT user_id FROM a)""")
def upsert_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    stored = search.upsert(None, e.filter("event_id % 3 = 0"), "user_id", "event_id")
    return search.upsert(stored, e.filter("event_id % 3 <> 0"), "user_id", "event_id").select("user_id", "event_type", "value")


@query("""WITH w AS (SELECT c_custkey AS qid, unnest([c_custkey % 40, c_custkey % 7, c_custkey % 40, 999999999]) AS doc_id, unnest([0, 1, 2, 3]) AS pos FROM customer WHERE c_custkey % 20 = 0)
SELECT qid, pos, doc_id, source, 0.0::DOUBLE AS score FROM w JOIN documents USING (doc_id)""")
def ordered_fetch(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    wanted = table(spark, d, "customer").filter(k % 20 == 0).select(k.alias("qid"), F.array(k % 40, k % 7, k % 40, F.lit(999999999).cast("long")).alias("ids"))
    return search.fetch_in_order(table(spark, d, "documents").select("doc_id", "source"), wanted, "doc_id").select("qid", "pos", "doc_id", "source", "score")


@query("""SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, lang) AS lang, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def payload_update(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("lang"))
    return search.update_payload(stored, new, "doc_id", "lang")


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1('D:' || doc_id || ':c0') AS h FROM documents)""")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    natural = F.concat(F.lit("D:"), F.col("doc_id").cast("string"), F.lit(":c0"))
    return table(spark, d, "documents").select("doc_id", tx.point_id(natural).alias("point_id"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(h1|p|li)[^>]*>(.*?)</(h1|p|li)>', 1)) AS tag, unnest(regexp_extract_all(html, '(?s)<(h1|p|li)[^>]*>(.*?)</(h1|p|li)>', 2)) AS body FROM pages)
SELECT page_id, CASE tag WHEN 'h1' THEN 2 WHEN 'p' THEN 1 ELSE 3 END::BIGINT AS category, count(*) AS n, count(*) FILTER (length(body) >= 40) AS usable FROM h GROUP BY ALL""")
def html_regions(spark: SparkSession, d: str) -> DataFrame:
    pattern = F.lit("(?s)<(h1|p|li)[^>]*>(.*?)</(h1|p|li)>")
    found = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("tag"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("body"))
    h = table(spark, d, "pages").select("page_id", F.inline(found))
    cat = F.when(F.col("tag") == "h1", 2).when(F.col("tag") == "p", 1).otherwise(3)
    return h.groupBy("page_id", cat.alias("category")).agg(F.count("*").alias("n"), F.count_if(F.char_length("body") >= 40).alias("usable"))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return qa.seeded_sample(table(spark, d, "documents"), "doc_id", 50).select("doc_id")


@query("""SELECT epoch_ms(time_bucket(INTERVAL '5 minutes', ts)) // 1000 AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = incremental.event_windows(table(spark, d, "events"))
    return w.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY user_id""")
def events_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive in two overlapping parts, kept once each."""
    e = table(spark, d, "events").select("event_id", "user_id")
    first = e.filter("event_id % 2 = 0")
    both = first.unionByName(search.pending(e, first, "event_id"))
    return both.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
