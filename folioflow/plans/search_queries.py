"""Vector search, fusion and the retriever's variants over the standard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VARIANTS, Config, variant
from ..models import Providers, stand_ins
from ..operators import fusion, graph, search
from .registry import query, table
from .retrieval import Retriever, Stores
from .storage import stored


def collection(spark: SparkSession, d: str, parity: int) -> DataFrame:
    """Even vectors stand for the text collection, odd ones for the image collection."""
    return table(spark, d, "embeddings").filter(F.col("vec_id") % 2 == parity)


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def dense_sql(parity: int, k: int, where: str = "true", name: str = "dense") -> str:
    return f"""{name} AS (SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS qid, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id % 2 = {parity} AND {where})) WHERE rank <= {k})"""


@query(f"WITH {dense_sql(0, 5)} SELECT * FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.dense_topk(collection(spark, d, 0), vector_queries(spark, d), 5)


@query(f"WITH {dense_sql(1, 5)} SELECT * FROM dense")
def image_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.dense_topk(collection(spark, d, 1), vector_queries(spark, d), 5)


@query(f"WITH {dense_sql(0, 5, 'e.label IN (1, 3, 7)')} SELECT * FROM dense")
def doc_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = search.match_documents(collection(spark, d, 0), [1, 3, 7], "label")
    return search.dense_topk(docs, vector_queries(spark, d), 5)


WORDS = "list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')"


def sparse_sql(k: int) -> str:
    return f"""d AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({WORDS}) AS t FROM documents) GROUP BY ALL),
q AS (SELECT item_id AS qid, t, count(*) AS n FROM (SELECT item_id, unnest({WORDS}) AS t FROM benchmark) GROUP BY ALL),
sparse AS (SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qid, doc_id, sum(d.n * q.n)::DOUBLE AS score FROM d JOIN q USING (t) GROUP BY ALL)) WHERE rank <= {k})"""


def word_weights(df: DataFrame, key: str) -> DataFrame:
    """(key, sparse): word counts of a text as a map. Words are counted in their row: sorted, equal ones stand together."""
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  a value that is computed once

    def counted(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        sizes = lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s) + 1)), lambda a, b: F.when(a.isNotNull(), (b - a).cast("float")))
        return bound(heads, lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(s, i - 1)), sizes(at)))

    words = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    return df.select(key, bound(F.sort_array(words), lambda s: F.when(F.size(s) > 0, counted(s))).alias("sparse")).filter("sparse is not null")


def word_search(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = word_weights(table(spark, d, "documents"), "doc_id")
    asked = word_weights(table(spark, d, "benchmark"), "item_id").withColumnRenamed("item_id", "qid")
    return search.sparse_topk(docs, asked, k, "doc_id")


@query(f"WITH {sparse_sql(10)} SELECT * FROM sparse")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return word_search(spark, d, 10)


@query(f"""WITH {dense_sql(0, 30)}, {sparse_sql(30)}, u AS (SELECT qid // 20 AS qid, vec_id AS doc_id, rank FROM dense UNION ALL SELECT qid, doc_id, rank FROM sparse),
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (2 + rank - 1)), 12) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    dense = search.dense_topk(collection(spark, d, 0), vector_queries(spark, d), 30)
    dense = dense.select(F.expr("qid div 20").alias("qid"), F.col("vec_id").alias("doc_id"), "rank")
    return search.hybrid_topk(dense, word_search(spark, d, 30), 10, "doc_id")


@query(f"""WITH {dense_sql(0, 10)}, {dense_sql(1, 10, name="image")}, {sparse_sql(10)},
u AS (SELECT qid // 20 AS qid, 'v' || vec_id AS item, rank, 0 AS channel, 1.0 AS w FROM dense UNION ALL SELECT qid, 'v' || doc_id, rank, 1, 0.7 FROM sparse UNION ALL SELECT qid // 20, 'v' || vec_id, rank, 2, 1.0 FROM image),
f AS (SELECT qid, item, round(sum(w::DOUBLE / (60 + rank)), 12) AS score, min(channel * 1000 + rank) AS first FROM u GROUP BY ALL)
SELECT qid, item, score, first // 1000 AS channel, position FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, item) AS position FROM f) WHERE position <= 5""")
def weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    asked = vector_queries(spark, d)
    item = lambda df, c: df.select("qid", F.concat(F.lit("v"), F.col(c).cast("string")).alias("item"), "rank")
    twentieth = lambda df: df.withColumn("qid", F.expr("qid div 20"))
    text = item(twentieth(search.dense_topk(collection(spark, d, 0), asked, 10)), "vec_id")
    image = item(twentieth(search.dense_topk(collection(spark, d, 1), asked, 10)), "vec_id")
    words = item(word_search(spark, d, 10), "doc_id")
    hits = fusion.tagged(text, "text", 1.0).unionByName(fusion.tagged(words, "graph", 0.7)).unionByName(fusion.tagged(image, "image", 1.0))
    return fusion.cut(fusion.fuse(hits)).select("qid", "item", "score", "channel", "position")


# The retriever end to end. Its models are replaced by countable features that SQL can state too: letter
# counts for dense vectors, counts of letter pairs for sparse ones, shared words for the reranker.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAIRS = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "le", "de", "es", "ch", "io")


def letter_counts(text: Column) -> Column:
    return F.array(*[(F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("float") for c in LETTERS])


def pair_counts(text: Column) -> Column:
    n = [((F.char_length(text) - F.char_length(F.replace(text, F.lit(p), F.lit("")))) / 2).cast("float") for p in PAIRS]
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(i) for i in range(len(PAIRS))]), F.array(*n)), lambda k, v: v > 0)


def space_words(text: Column) -> Column:
    return F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")


def shared_words(question: Column, passage: Column) -> Column:
    q = F.array_distinct(space_words(question))
    return F.round(F.size(F.array_intersect(q, space_words(passage))) / F.greatest(F.size(q), F.lit(1)), 6)


def countable() -> Providers:
    base = stand_ins()
    fields = {f: getattr(base, f) for f in base.__dataclass_fields__}
    return Providers(**(fields | {"embed_text": letter_counts, "embed_sparse": pair_counts, "embed_image": letter_counts, "embed_image_query": letter_counts, "rerank": shared_words}))


def stores(spark: SparkSession, d: str, linked: bool = True) -> Stores:
    """Both indexes and, if ``linked``, the graph, written once for the channels that read it."""
    docs = table(spark, d, "documents")
    chunk_id = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    text = docs.select(chunk_id.alias("chunk_id"), "source", "text", "lang", "doc_id")
    index = text.select("chunk_id", F.col("source").alias("doc_id"), (F.col("doc_id") % 50).cast("int").alias("page_index"), "text", letter_counts(F.col("text")).alias("dense"), pair_counts(F.col("text")).alias("sparse"))
    pages = table(spark, d, "pages")
    image = pages.select(
        F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("region_id"), F.lit("pages").alias("doc_id"), F.col("page_id").cast("int").alias("page_index"), F.lit(5).alias("category"),
        F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("").alias("caption"), F.lit("").alias("crop_path"), letter_counts(F.col("html")).alias("image"),
    )
    if not linked:
        return Stores(index, image, None, None)
    chunks = text.select("chunk_id", F.col("source").alias("doc_id"), (F.col("doc_id") % 50).cast("int").alias("page_index"), F.col("doc_id").alias("ord"))
    words = F.filter(space_words(F.col("text")), lambda w: F.char_length(w) >= 7)
    mention = lambda w, i: F.struct(F.lit(0).alias("window"), i.alias("pos"), w.alias("text"), F.lit("method").alias("label"), F.lit(1.0).alias("score"))
    mentions = text.select("chunk_id", F.col("doc_id").alias("ord"), F.transform(words, mention).alias("said"))
    nodes, edges = graph.build(chunks, stored(graph.distinct_mentions(mentions)), None, False, keep=stored)
    # Whole texts hold thousands of entities, too many to list their pairs.
    return Stores(index, image, stored(nodes, "ntype"), stored(edges, "key"), implied=Config().kg.cooccurrence)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace({text}, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


def _pairs_sql(table_: str, key: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS k, {i} AS t, ((length({text}) - length(replace({text}, '{p}', ''))) / 2)::FLOAT::DOUBLE AS n FROM {table_}" for i, p in enumerate(PAIRS))


def retriever_sql(flags: dict) -> str:
    """The retriever of one variant as SQL."""
    blanked = "list_filter(string_split(replace({0}, chr(10), ' '), ' '), lambda x: x <> '')"
    ctes = [
        "q AS (SELECT item_id AS qid, text AS question FROM benchmark)",
        f"qv AS (SELECT qid, {_letters_sql('question')} AS v FROM q)",
        f"dv AS (SELECT 'D' || doc_id AS item, {_letters_sql('text')} AS v FROM documents)",
        """dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM
          (SELECT qid, item, round(list_cosine_similarity(dv.v, qv.v), 6) AS score FROM dv, qv WHERE list_sum(dv.v) > 0 AND list_sum(qv.v) > 0)) WHERE rank <= 30)""",
    ]
    text = "dense"
    if flags.get("use_sparse"):
        ctes += [
            f"qs AS (SELECT * FROM ({_pairs_sql('q', 'qid', 'question')}) WHERE n > 0)",
            f"ds AS (SELECT * FROM ({_pairs_sql('documents', 'doc_id', 'text')}) WHERE n > 0)",
            """sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM
              (SELECT qs.k AS qid, 'D' || ds.k AS item, round(sum(qs.n * ds.n), 6) AS score FROM qs JOIN ds USING (t) GROUP BY ALL)) WHERE rank <= 30)""",
            """hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM
              (SELECT qid, item, round(sum(1.0::DOUBLE / (2 + rank - 1)), 12) AS score FROM (SELECT qid, item, rank FROM dense UNION ALL SELECT qid, item, rank FROM sparse) GROUP BY ALL)) WHERE rank <= 30)""",
        ]
        text = "hybrid"
    parts = [f"SELECT qid, item, rank, 0 AS channel FROM {text}"]
    if flags.get("use_graph"):
        ctes += [
            f"m AS (SELECT DISTINCT 'D' || doc_id AS item, lower(w) AS name FROM (SELECT doc_id, unnest(list_filter({blanked.format('text')}, lambda x: length(x) >= 7)) AS w FROM documents))",
            "anchor AS (SELECT name, count(*) AS freq FROM m GROUP BY name HAVING count(*) <= 40)",
            """linked AS (SELECT qid, name, freq FROM (SELECT qid, name, freq, row_number() OVER (PARTITION BY qid ORDER BY freq, name) AS r FROM q, anchor
              WHERE CASE WHEN contains(lower(question), name) THEN regexp_matches(lower(question), '(^|[^\\p{L}\\p{N}_])' || regexp_escape(name) || '($|[^\\p{L}\\p{N}_])') ELSE false END) WHERE r <= 8)""",
            """hop AS (SELECT qid, name, min(dist) AS dist FROM (SELECT qid, name, 0 AS dist FROM linked UNION ALL
              SELECT DISTINCT l.qid, y.name, 1 FROM linked l JOIN m x ON x.name = l.name JOIN m y ON y.item = x.item) GROUP BY ALL)""",
            """kg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM
              (SELECT qid, item, round(sum(1.0::DOUBLE / (dist + 1)), 12) AS score FROM hop JOIN m USING (name) GROUP BY ALL)) WHERE rank <= 30)""",
        ]
        parts.append("SELECT qid, item, rank, 1 FROM kg")
    if flags.get("use_image"):
        ctes += [
            f"pv AS (SELECT 'P' || page_id AS item, {_letters_sql('html')} AS v FROM pages)",
            """img AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM
              (SELECT qid, item, round(list_cosine_similarity(pv.v, qv.v), 6) AS score FROM pv, qv WHERE list_sum(pv.v) > 0 AND list_sum(qv.v) > 0)) WHERE rank <= 30)""",
        ]
        parts.append("SELECT qid, item, rank, 2 FROM img")
    ctes += [
        f"u AS ({' UNION ALL '.join(parts)})",
        "f AS (SELECT qid, item, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(channel * 1000 + rank) AS first FROM u GROUP BY ALL)",
        "g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, item) AS position FROM f)",
    ]
    if flags.get("use_rerank"):
        ctes += [
            "body AS (SELECT 'D' || doc_id AS item, text AS b FROM documents UNION ALL SELECT 'P' || page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE '[figure region]' END FROM pages)",
            f"rr AS (SELECT g.*, round(len(list_intersect(list_distinct({blanked.format('question')}), {blanked.format('b')})) / greatest(len(list_distinct({blanked.format('question')})), 1), 6) AS rerank FROM g JOIN q USING (qid) JOIN body USING (item))",
            "z AS (SELECT qid, item, rerank AS score, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, position) AS position FROM rr)",
        ]
    else:
        ctes.append("z AS (SELECT qid, item, score, position FROM g)")
    return f"WITH {', '.join(ctes)} SELECT qid, item, score, position FROM z WHERE position <= 5"


def retrieved(spark: SparkSession, d: str, name: str) -> DataFrame:
    config = variant(Config(), name)
    found = Retriever(config, stores(spark, d, config.retrieval.use_graph), countable()).retrieve(questions(spark, d))
    return found.select("qid", "item", "score", "position")


def _register(name: str) -> None:
    query(retriever_sql(VARIANTS[name]), f"fused_topk_{name}")(lambda spark, d: retrieved(spark, d, name))


for _name in VARIANTS:
    _register(_name)


@query(None)
def answers_with_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The whole system with stand-in models; its generated text has no SQL counterpart."""
    from .retrieval import System

    system = System(variant(Config(), "enhanced"), stores(spark, d), countable())
    return system.explain(questions(spark, d)).select("qid", "answer", F.size("evidence").alias("n_evidence"), F.size(F.filter("evidence", lambda e: e["cited"])).alias("n_cited"))


@query("""WITH """ + dense_sql(0, 10) + """, """ + sparse_sql(10) + """, u AS (SELECT 'text' AS channel, qid // 20 AS qid FROM dense UNION ALL SELECT 'graph', qid FROM sparse),
p AS (SELECT channel, qid, count(*) AS h FROM u GROUP BY ALL)
SELECT channel, count(*) AS fired, sum(h)::BIGINT AS total_hits, round(sum(h) / (SELECT count(*) FROM benchmark), 6) AS mean_hits FROM p GROUP BY channel""")
def channel_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import evaluation

    text = search.dense_topk(collection(spark, d, 0), vector_queries(spark, d), 10).select(F.lit("text").alias("channel"), F.expr("qid div 20").alias("qid"))
    hits = text.unionByName(word_search(spark, d, 10).select(F.lit("graph").alias("channel"), "qid"))
    return evaluation.channel_firing(hits, table(spark, d, "benchmark"))
