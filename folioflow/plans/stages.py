"""The build stages over tables: regions and chunks, captions, index, graph, and evaluation of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, variant
from ..functions import text as tx
from ..models import Providers
from ..operators import chunking, evaluation, graph, layout, qa, search
from .retrieval import Retriever, Stores, System


def ingest(pages: DataFrame, done: DataFrame | None, config: Config, providers: Providers) -> DataFrame:
    """Regions with their text of pages that haven't been processed (``done``: page_key)."""
    if done is not None:
        pages = pages.join(done.select(F.col("page_key").alias("key")), "key", "left_anti")
    regions = layout.extract_regions(pages, config.paths.crops_dir)
    images = pages.select(F.col("key").alias("page_key"), "image")
    read = regions.join(images, "page_key").withColumn("text", F.when(F.col("category").isin(1, 2, 3), providers.ocr(F.col("image"))))
    return read.drop("image").select(*regions.columns)


def chunk(regions: DataFrame, config: Config) -> DataFrame:
    c = config.chunk
    return chunking.chunk_regions(regions, c.max_chars, c.overlap_chars, c.min_chars)


def captions(regions: DataFrame, files: DataFrame, config: Config, providers: Providers) -> DataFrame:
    """(region_id, caption) for a seeded sample of uncaptioned crops (``files``: path, content)."""
    todo = layout.uncaptioned(regions, files)
    drawn = qa.seeded_sample(todo, "region_id", config.eval.caption_sample_size, config.eval.seed)
    crops = drawn.join(files.select(F.col("path").alias("crop_path"), "content"), "crop_path")
    return crops.select("region_id", tx.strip(providers.caption(F.col("content"))).alias("caption"))


def index_text(chunks: DataFrame, stored: DataFrame | None, providers: Providers) -> DataFrame:
    """The text index with the chunks that it lacked; only those are embedded."""
    todo = chunks if stored is None else search.pending(chunks, stored, "chunk_id")
    made = todo.select("chunk_id", providers.embed_text(F.col("text")).alias("dense"), providers.embed_sparse(F.col("text")).alias("sparse"))
    return search.upsert(stored, search.text_points(todo, made))


def index_images(regions: DataFrame, files: DataFrame, stored: DataFrame | None, providers: Providers) -> DataFrame:
    """The image index with the crops that it lacked; unreadable and tiny images are skipped (``files``: path, content, width, height)."""
    todo = layout.visual_with_crop(regions)
    todo = todo if stored is None else search.pending(todo, stored, "region_id")
    images = todo.join(layout.large_enough(files).select(F.col("path").alias("crop_path"), "content"), "crop_path")
    made = images.select("region_id", providers.embed_image(F.col("content")).alias("image"))
    return search.upsert(stored, search.image_points(todo, made))


def extract_entities(chunks: DataFrame, config: Config, providers: Providers) -> DataFrame:
    """Distinct mentions of each chunk from overlapping word windows, with the configured labels and threshold."""
    windows = chunks.select("chunk_id", F.posexplode(chunking.word_windows(F.col("text"))).alias("window", "part"))
    found = windows.select("chunk_id", "window", F.posexplode(providers.entities(F.col("part"))).alias("pos", "e")).select("chunk_id", "window", "pos", "e.*")
    kg = config.kg
    return graph.distinct_mentions(found.filter(F.col("label").isin(*kg.entity_labels) & (F.col("score") >= kg.ner_threshold)))


def extract_triples(chunks: DataFrame, config: Config, providers: Providers) -> DataFrame:
    """Triples of the first ``max_relation_chunks`` chunks by ``ord`` (0: all); the cut comes before the model."""
    n = config.kg.max_relation_chunks
    budget = chunks if not n else chunks.orderBy("ord").limit(n)
    each = budget.select("chunk_id", F.posexplode(tx.triples(providers.relations(F.col("text")))).alias("pos", "t"))
    return each.select("chunk_id", "pos", "t.*")


def build_graph(chunks: DataFrame, config: Config, providers: Providers) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all chunks (with ``ord``, their order of arrival)."""
    mentions = extract_entities(chunks, config, providers)
    triples = extract_triples(chunks, config, providers) if config.kg.use_llm_relations else None
    return graph.build(chunks, mentions, triples, config.kg.cooccurrence)


def merge_graph(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph and a later part of it: known names keep their node, later relations replace earlier ones."""
    name = lambda df: df.filter("ntype = 'entity'").select(tx.normal_name(F.col("name")).alias("n"), F.col("id"))
    known = name(nodes).withColumnRenamed("id", "old")
    renamed = name(more_nodes).join(known, "n").select(F.col("id").alias("from"), F.col("old").alias("to")).filter("`from` <> `to`")
    swap = lambda df, c: df.join(renamed.withColumnRenamed("from", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    more_edges = swap(swap(more_edges, "src"), "dst").select(*edges.columns)
    fresh = more_nodes.join(renamed.select(F.col("from").alias("id")), "id", "left_anti").join(nodes.select("id"), "id", "left_anti")
    both = edges.withColumn("age", F.lit(0)).unionByName(more_edges.withColumn("age", F.lit(1)))
    last = both.groupBy("src", "dst", "key").agg(F.max_by(F.struct("relation", "chunk_id"), F.struct("age", "chunk_id")).alias("l"))
    return nodes.unionByName(fresh.select(*nodes.columns)), last.select("src", "dst", "key", F.col("l.relation").alias("relation"), F.col("l.chunk_id").alias("chunk_id"))


def synthesise_multihop(config: Config, stores: Stores, chunks: DataFrame, providers: Providers, reply) -> DataFrame:
    """Questions on A answered by a bridge chunk about B, which the graph reaches and the baseline misses."""
    n, hops, k = config.eval.num_multihop_questions, config.retrieval.graph_hops, config.retrieval.candidate_k
    candidates = graph.multihop_candidates(stores.nodes, stores.edges, qa.eligible_chunks(chunks), seed=str(config.eval.seed))
    tried = qa.multihop_attempts(candidates, n, seed=config.eval.seed).filter("fresh")
    names = stores.nodes.select(F.col("id").alias("a"), F.col("name").alias("a_name"))
    texts = chunks.select(F.col("chunk_id").alias("c2"), "text", "doc_id", "page_index")
    rows = tried.join(names, "a").join(texts, "c2").withColumn("qid", F.concat_ws("|", "b", "c1"))
    prompt = F.concat(F.lit("Write one question that names "), "a_name", F.lit(" and that this passage answers:\n"), "text")
    asked = rows.withColumn("question", tx.clean_question(reply(prompt))).drop("a").withColumnRenamed("a_name", "a").withColumn("gold_id", F.col("c2"))
    base = Retriever(variant(config, "baseline"), stores, providers).retrieve(asked.select("qid", "question"))
    linked = graph.link_entities(graph.anchor_index(stores.nodes, stores.edges), asked.select("qid", "question"))
    reach = graph.ranked_chunks(stores.edges, graph.reached_entities(stores.nodes, stores.edges, linked, hops)).filter(F.col("rank") <= k)
    kept = qa.verified_multihop(asked, base.select("qid", "item"), reach.select("qid", F.col("chunk_id").alias("item")), n)
    return kept.select("question", F.lit("multihop").alias("qtype"), "gold_id", F.lit("chunk").alias("gold_kind"), F.col("doc_id").alias("gold_doc_id"), F.col("page_index").alias("gold_page_index"))


def ensure_questions(stored: DataFrame | None, made: DataFrame) -> DataFrame:
    return made if stored is None else qa.append_missing_splits(qa.upgrade(stored), made)


def evaluate(config: Config, stores: Stores, questions: DataFrame, providers: Providers, names: list[str], judged: tuple[str, ...] = ()) -> DataFrame:
    """(variant, qtype, metric, value) of each named variant; ``judged`` ones get judge scores on a sample.

    ``questions`` has qid, place, question, qtype and the gold columns. All questions go through one plan
    per variant; generation and judging see the sample only.
    """
    out = None
    for name in names:
        system = System(variant(config, name), stores, providers)
        found = system.retriever.retrieve(questions.select("qid", "question"))
        ranked = evaluation.with_gold_ranks(questions, found)
        part = evaluation.metrics(ranked, config.eval.ks)
        if name in judged and config.eval.use_llm_judge:
            sample = evaluation.judged_sample(questions, config.eval.judge_sample_size)
            answered = system.answer(sample.select("qid", "question")).join(sample.select("qid", "qtype"), "qid")
            context = F.array_join(F.transform("evidence", lambda x: x["text"]), "\n")
            faith, relevant = providers.judge(F.col("question"), F.col("text"), context)
            scored = answered.select("qtype", tx.judge_score(faith).alias("faithfulness"), tx.judge_score(relevant).alias("answer_relevancy"))
            part = part.unionByName(evaluation.judge_means(scored))
        part = part.select(F.lit(name).alias("variant"), "qtype", "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def comparison(values: DataFrame, names: list[str]) -> DataFrame:
    """(variant, place, metrics, delta) in the order asked for, as JSON texts by type and metric."""
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    folded = lambda df, v: df.groupBy("variant").agg(F.to_json(F.array_sort(F.collect_list(F.struct("qtype", "metric", F.col(v).alias("value"))))).alias(v))
    deltas = folded(evaluation.deltas(values), "delta")
    out = folded(values.select("variant", "qtype", "metric", F.col("value").alias("metrics")), "metrics").join(deltas, "variant", "left")
    order = Window.orderBy("asked")
    return out.withColumn("asked", F.try_element_at(place, F.col("variant"))).filter("asked is not null").withColumn("place", F.row_number().over(order)).select("variant", "place", "metrics", "delta")


def diagnose(config: Config, stores: Stores, queries: DataFrame, providers: Providers) -> tuple[DataFrame, DataFrame]:
    """Counts of the graph's parts, and how often each channel fires on ``queries``."""
    hits = Retriever(variant(config, "enhanced"), stores, providers).channels(queries)
    return graph.type_counts(stores.nodes, stores.edges), evaluation.channel_firing(hits, queries)
