"""The retriever over a batch of questions: channels, fusion, reranking, cut; variants prune channels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..models import Providers
from ..operators import answering, fusion, graph, search
from ..schemas import CATEGORY_NAMES
from .storage import stored


@dataclass(frozen=True)
class Stores:
    """Text index, image index, and the graph's nodes and edges; the last three may be missing.

    ``implied`` says that co-occurrence counts as an edge though the table doesn't list it.
    """

    text: DataFrame
    image: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    implied: bool = False


class Retriever:
    def __init__(self, config: Config, stores: Stores, providers: Providers):
        self.config, self.stores, self.providers = config, stores, providers
        self._linked: tuple[DataFrame, DataFrame] | None = None

    def text_channel(self, queries: DataFrame) -> DataFrame:
        """(qid, item, rank, score, source) of dense search, fused with sparse search where that is on."""
        cfg = self.config.retrieval
        dense = queries.select("qid", self.providers.embed_text(F.col("question")).alias("dense"))
        found = search.dense_topk(self.stores.text, dense, cfg.candidate_k, "chunk_id", "dense")
        source = "text_dense"
        if cfg.use_sparse:
            terms = queries.select("qid", self.providers.embed_sparse(F.col("question")).alias("sparse"))
            sparse = search.sparse_topk(self.stores.text, terms, cfg.candidate_k)
            found, source = search.hybrid_topk(found, sparse, cfg.candidate_k, "chunk_id", cfg.hybrid_rrf_k), "text_hybrid"
        return found.select("qid", F.col("chunk_id").alias("item"), "rank", "score", F.lit(source).alias("source"))

    def linked(self, queries: DataFrame) -> DataFrame:
        """The anchors of ``queries``, found once for the channel and the paths."""
        if self._linked is None or self._linked[0] is not queries:
            self._linked = queries, stored(graph.link_entities(stored(graph.asked_anchors(self.stores.nodes, self.stores.edges, queries, stored)), queries))
        return self._linked[1]

    def graph_channel(self, queries: DataFrame) -> DataFrame:
        cfg = self.config.retrieval
        ranked = graph.best_chunks(self.stores.edges, self.linked(queries), cfg.graph_hops, cfg.candidate_k, self.stores.implied, stored)
        indexed = ranked.join(self.stores.text.select("chunk_id"), "chunk_id", "left_semi")
        return indexed.select("qid", F.col("chunk_id").alias("item"), "rank", F.lit(0.0).alias("score"), F.lit("graph").alias("source"))

    def image_channel(self, queries: DataFrame) -> DataFrame:
        cfg = self.config.retrieval
        asked = queries.select("qid", self.providers.embed_image_query(F.col("question")).alias("image"))
        found = search.dense_topk(self.stores.image, asked, cfg.candidate_k, "region_id", "image")
        return found.select("qid", F.col("region_id").alias("item"), "rank", "score", F.lit("image").alias("source"))

    def channels(self, queries: DataFrame) -> DataFrame:
        """All active channels' hits, tagged; a channel that is off is not planned at all."""
        cfg = self.config.retrieval
        hits = fusion.tagged(self.text_channel(queries), "text", cfg.text_weight)
        if cfg.use_graph and self.stores.nodes is not None:
            hits = hits.unionByName(fusion.tagged(self.graph_channel(queries), "graph", cfg.graph_weight))
        if cfg.use_image and self.stores.image is not None:
            hits = hits.unionByName(fusion.tagged(self.image_channel(queries), "image", cfg.image_weight))
        return hits

    def fetched(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (item, …) with its evidence, from each index; images without a caption are named by their category."""
        null = lambda n: F.lit(None).cast("string").alias(n)
        text = self.stores.text.select(F.col("chunk_id").alias("item"), "doc_id", "page_index", F.lit("text").alias("modality"), "text", "chunk_id", null("region_id"), null("crop_path"))
        if self.stores.image is None:
            return wanted.join(text, "item")
        names = F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv])
        label = F.concat(F.lit("["), F.coalesce(F.try_element_at(names, F.col("category")), F.lit("figure")), F.lit(" region]"))
        shown = F.coalesce(F.when(F.col("caption") != "", F.col("caption")), label)
        image = self.stores.image.select(F.col("region_id").alias("item"), "doc_id", "page_index", F.lit("image").alias("modality"), shown.alias("text"), null("chunk_id"), "region_id", "crop_path")
        return wanted.join(text, "item").unionByName(wanted.join(image, "item"))

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """(qid, position, item, score, source, payload…) for ``queries`` (qid, question): the top_k of each."""
        cfg = self.config.retrieval
        fused = fusion.fuse(self.channels(queries), cfg.rrf_k)
        # Written, so that its size is known and the items' texts aren't shuffled where it is small.
        fused = stored(fused if cfg.use_rerank else fusion.cut(fused, cfg.top_k))
        if cfg.use_rerank:
            # Texts are scored where they are read; only those of the items that stay are sent on.
            texts = self.fetched(fused.select("qid", "item")).join(queries, "qid")
            scores = texts.select("qid", "item", self.providers.rerank(F.col("question"), F.col("text")).alias("rerank"))
            fused = stored(fusion.cut(fusion.rerank(fused, scores), cfg.top_k))
        items = self.fetched(fused)
        return items.select("qid", "position", "item", *answering.ITEM_FIELDS)

    def paths(self, queries: DataFrame) -> DataFrame | None:
        if not (self.config.retrieval.use_graph and self.stores.nodes is not None):
            return None
        found = graph.relation_paths(self.stores.nodes, self.stores.edges, self.linked(queries))
        listed = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("p"))
        return listed.select("qid", F.col("p.path").alias("paths"))


class System:
    """Questions in, answers with provenance out."""

    def __init__(self, config: Config, stores: Stores, providers: Providers):
        self.config, self.providers = config, providers
        self.retriever = Retriever(config, stores, providers)

    def answer(self, queries: DataFrame) -> DataFrame:
        gen = self.config.generation
        lists = answering.evidence_lists(self.retriever.retrieve(queries), queries, gen.max_context_items)
        prompted = answering.prompts(lists, gen.chain_of_thought, gen.vision_generation, gen.max_images)
        reply = self.providers.vision if gen.vision_generation else self.providers.chat
        return answering.answers(prompted, reply, self.retriever.paths(queries))

    def explain(self, queries: DataFrame) -> DataFrame:
        return answering.provenance(self.answer(queries))
