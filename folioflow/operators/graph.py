"""The document, chunk and entity graph as node and edge tables, and what is asked of it."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LEAST_NAME, FREQUENCY_CAP, MOST_ANCHORS, MOST_PATHS = 4, 40, 8, 10
#: Queries, about, that a task numbers.
BLOCK = 16_384
#: Lists of at least so many queries are sent to all tasks, the longest first, up to so many numbers in all.
LONG_LIST, LISTED = 8, 2_000_000
#: Numbers of documents, about, that are sent to queries at once: 2 GB before compression.
SENT = 500_000_000


def release_unused(spark: SparkSession) -> None:
    """Have the driver find plans that nothing refers to any more, so that Spark's cleaner drops their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def distinct_mentions(found: DataFrame) -> DataFrame:
    """Entities of all windows of a chunk (chunk_id, window, pos, text, label, score): first of each name and label.

    Blank names drop out; positions are numbered anew in order of appearance. Mentions may come as a list ``said``
    (window, pos, text, label, score) in their chunk's row; then they stay in it, and nothing is shuffled.
    """
    if "said" in found.columns:
        named = F.transform("said", lambda m: F.struct(tx.normal_name(m["text"]).alias("name"), *[m[c].alias(c) for c in ("label", "window", "pos", "text", "score")]))
        again = lambda s, x, i: (i > 0) & F.get(s, i - 1)["name"].eqNullSafe(x["name"]) & F.get(s, i - 1)["label"].eqNullSafe(x["label"])
        firsts = _bound(F.sort_array(F.filter(named, lambda m: m["name"] != "")), lambda s: F.filter(s, lambda x, i: ~again(s, x, i)))
        placed = F.sort_array(F.transform(firsts, lambda m: F.struct(*[m[c].alias(c) for c in ("window", "pos", "text", "label", "score")])))
        return found.withColumn("said", F.transform(placed, lambda m, i: F.struct(i.alias("pos"), *[m[c].alias(c) for c in ("text", "label", "score")])))
    named = found.withColumn("name", tx.normal_name(F.col("text"))).filter("name <> ''")
    first = named.groupBy("chunk_id", "name", "label").agg(F.min(F.struct("window", "pos", "text", "score")).alias("f"))
    order = Window.partitionBy("chunk_id").orderBy("f.window", "f.pos")
    return first.select("chunk_id", (F.row_number().over(order) - 1).alias("pos"), F.col("f.text").alias("text"), "label", F.col("f.score").alias("score"))


def _within(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with their chunk's ``ord``, which they may have already."""
    return rows if "ord" in rows.columns else rows.join(chunks.select("chunk_id", "ord"), "chunk_id")


def _spoken(mentions: DataFrame) -> DataFrame:
    """Mentions as rows; they may come as a list ``said`` (pos, text, label) in their chunk's row."""
    if "said" not in mentions.columns:
        return mentions
    return mentions.select(*[c for c in mentions.columns if c != "said"], F.explode("said").alias("m")).select("*", "m.*").drop("m")


def _listed(mentions: DataFrame) -> DataFrame:
    """Mentions as one row for each chunk, with a list ``said`` (pos, text, label) by position."""
    if "said" in mentions.columns:
        return mentions
    return mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "label"))).alias("said"))


def _uses(chunks: DataFrame, mentions: DataFrame, triples: DataFrame | None) -> DataFrame:
    """(text, label, hint, first): each spelling under each label, and its first use as one number.

    Numbers are kept by a hash aggregate where structs would be sorted, and spellings are few beside their uses.
    """
    rows = _spoken(_within(chunks, mentions))
    used = rows.select("text", "label", F.coalesce("label", F.lit("")).alias("hint"), "ord", F.lit(0).alias("kind"), "pos", F.lit(0).alias("side"))
    if triples is not None:
        placed = _within(chunks, triples)
        for side, end in enumerate(("subject", "object")):
            used = used.unionByName(placed.select(F.col(end).alias("text"), F.lit("concept").alias("label"), _hint(triples, end).alias("hint"), "ord", F.lit(1).alias("kind"), "pos", F.lit(side).alias("side")))
    # ord, kind, pos and side in one number, in this order
    within = ((F.shiftleft(F.col("kind").cast("long"), 32) + F.col("pos")) * 2 + F.col("side")).cast("decimal(11,0)")
    place = F.col("ord").cast("decimal(19,0)") * F.lit(10**11).cast("decimal(12,0)") + within
    return used.groupBy("text", "label", "hint").agg(F.min(place).alias("first"))


def _hint(triples: DataFrame, end: str) -> Column:
    """The label that the end of a triple is expected to have; where it holds, no join is needed to name its node."""
    return F.col(f"{end}_label") if f"{end}_label" in triples.columns else F.lit("concept")


def _names(chunks: DataFrame, mentions: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """(name, id, label, surface, contested): contested is a name that some use expects under another label."""
    first = F.min_by(F.struct("label", "text"), "first").alias("f")
    names = _uses(chunks, mentions, triples).withColumn("name", tx.normal_name(F.col("text"))).groupBy("name").agg(first, F.collect_set("hint").alias("hints"))
    return names.select(
        "name", F.concat(F.lit("entity::"), F.col("f.label"), F.lit("::"), F.col("name")).alias("id"), F.col("f.label").alias("label"), tx.strip(F.col("f.text")).alias("surface"),
        F.exists("hints", lambda h: ~h.eqNullSafe(F.col("f.label"))).alias("contested"),
    )


def resolve_names(chunks: DataFrame, mentions: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """(name, id, label, surface): the node of each entity name.

    The first to use a name gives it its label and spelling for good. Chunks come in order of ``ord``;
    within one, mentions precede triple ends, which are concepts, subject before object.
    """
    return _names(chunks, mentions, triples).drop("contested")


def build(chunks: DataFrame, mentions: DataFrame, triples: DataFrame | None = None, cooccurrence: bool = True, keep: Callable[..., DataFrame] = lambda df, *by: df) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``chunks`` (chunk_id, doc_id, page_index, ord), their mentions and triples.

    There is one edge per pair and key: mentions and co-occurrences are idempotent, of several relations
    between two entities the last one stays. Ends of triples are not mentioned by their chunk. ``keep`` writes
    a table once, in folders by a column, as the names are read by several parts. A mention's node follows from its own
    label but for contested names, so mentions are not shuffled where these are few.
    """
    names = keep(_names(chunks, mentions, triples), "contested")
    blank = lambda n, kind: F.lit(None).cast(kind).alias(n)
    nodes = chunks.select(F.col("doc_id").alias("id"), F.lit("document").alias("ntype"), blank("label", "string"), blank("name", "string"), blank("doc_id", "string"), blank("page_index", "int")).distinct()
    nodes = nodes.unionByName(chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("ntype"), blank("label", "string"), blank("name", "string"), F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index")))
    nodes = nodes.unionByName(names.select("id", F.lit("entity").alias("ntype"), "label", F.col("surface").alias("name"), blank("doc_id", "string"), blank("page_index", "int")))
    contested = keep(names.filter("contested").select("name", "id"))  # of its own, so that its size is known
    plain = lambda df, k: df.select("src", "dst", F.lit(k).alias("key"), blank("relation", "string"), blank("chunk_id", "string"))

    def at(df: DataFrame, name: str, hint: str, out: str) -> DataFrame:
        """``df`` with the node of a name as ``out``."""
        known = contested.select(F.col("name").alias(name), F.col("id").alias("found"))
        return df.join(known, name, "left").withColumn(out, F.coalesce("found", F.concat(F.lit("entity::"), F.col(hint), F.lit("::"), F.col(name)))).drop("found")

    named = lambda m: F.struct(tx.normal_name(m["text"]).alias("name"), m["pos"].alias("pos"), m["label"].alias("label"))
    once = lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["name"].eqNullSafe(x["name"]))
    rows = _listed(mentions).select("chunk_id", F.transform("said", named).alias("said"))
    each = rows.select("chunk_id", F.explode(_bound(F.sort_array("said"), once)).alias("m")).select(F.col("chunk_id").alias("src"), "m.name", "m.label").filter("name is not null")
    edges = plain(chunks.select(F.col("doc_id").alias("src"), F.col("chunk_id").alias("dst")).distinct(), "HAS_CHUNK")
    edges = edges.unionByName(plain(at(each, "name", "label", "dst"), "MENTIONS"))
    if cooccurrence:
        pairs = cooccurring(rows).filter("a is not null and b is not null")
        edges = edges.unionByName(plain(at(at(pairs, "a", "a_label", "src"), "b", "b_label", "dst").select("src", "dst").distinct(), "CO_OCCURS"))
    if triples is not None:
        ends = _within(chunks, triples).withColumn("s", tx.normal_name(F.col("subject"))).withColumn("o", tx.normal_name(F.col("object")))
        ends = ends.withColumn("s_label", _hint(triples, "subject")).withColumn("o_label", _hint(triples, "object")).filter("s is not null and o is not null")
        ends = at(at(ends, "s", "s_label", "src"), "o", "o_label", "dst")
        last = ends.groupBy("src", "dst").agg(F.max_by(F.struct("relation", "chunk_id"), F.struct("ord", "pos")).alias("l"))
        edges = edges.unionByName(last.select("src", "dst", F.lit("RELATES").alias("key"), F.col("l.relation").alias("relation"), F.col("l.chunk_id").alias("chunk_id")))
    return nodes, edges


def cooccurring(rows: DataFrame) -> DataFrame:
    """(a, a_label, b, b_label): ordered pairs of a chunk's names, earlier first; one name under two labels loops.

    Pairs are made inside the chunk's row, so a frequent entity is not joined with itself over all chunks.
    """
    by_place = F.array_sort(F.transform("said", lambda m: F.struct(m["pos"].alias("pos"), m["name"].alias("name"), m["label"].alias("label"))))
    each = rows.select(by_place.alias("e")).select("e", F.posexplode("e").alias("i", "x"))
    pairs = each.select("x", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("y"))
    return pairs.select(F.col("x.name").alias("a"), F.col("x.label").alias("a_label"), F.col("y.name").alias("b"), F.col("y.label").alias("b_label"))


def entity_frequency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, freq): chunks that mention an entity, each by one edge; 0 for those only triples name."""
    counts = edges.filter("key = 'MENTIONS'").groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("freq"))
    entities = nodes.filter("ntype = 'entity'").select(F.col("id").alias("entity"))
    return entities.join(counts, "entity", "left").select("entity", F.coalesce("freq", F.lit(0)).alias("freq"))


def anchor_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, name, surface, freq) of entities fit to anchor a query: four characters, in 1 to 40 chunks."""
    return _mentioned(_anchor_names(nodes), edges.filter("key = 'MENTIONS'").select(F.col("dst").alias("entity")))


def _anchor_names(nodes: DataFrame) -> DataFrame:
    named = nodes.filter("ntype = 'entity'").select(F.col("id").alias("entity"), tx.normal_name(F.col("name")).alias("name"), F.col("name").alias("surface"))
    return named.filter(F.char_length("name") >= LEAST_NAME)


def _mentioned(named: DataFrame, mention: DataFrame) -> DataFrame:
    counts = mention.groupBy("entity").agg(F.count("*").alias("freq"))
    return named.join(counts.filter(F.col("freq").between(1, FREQUENCY_CAP)), "entity")


def asked_anchors(nodes: DataFrame, edges: DataFrame, queries: DataFrame, keep: Callable[..., DataFrame] = lambda df, *by: df) -> DataFrame:
    """The rows of ``anchor_index`` whose names stand in some question; mentions of others are neither counted nor shuffled."""
    named = _anchor_names(nodes)
    said = keep(_said(named, queries).select("name").distinct())
    named = keep(named.join(said, "name", "left_semi").select("entity", "name", "surface"))
    mention = edges.filter("key = 'MENTIONS'").select(F.col("dst").alias("entity"))
    return _mentioned(named, mention.join(named.select("entity"), "entity", "left_semi"))


def link_entities(anchors: DataFrame, queries: DataFrame, most: int = MOST_ANCHORS) -> DataFrame:
    """(qid, entity, name, surface, freq, rank): anchors whose names stand in the question as whole words.

    A question is exploded into its stretches that begin and end at word edges, have as many space-free runs as
    some name has, and outer runs no longer than any name's runs; these join the index by hash. So the cost is
    linear in a question's length, also where it has no space, and doesn't grow with the number of anchors.
    """
    once = _said(anchors, queries).join(anchors, "name").dropDuplicates(["qid", "name"]).select("qid", "entity", "name", "surface", "freq")
    order = Window.partitionBy("qid").orderBy("freq", "name")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _said(named: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, name): stretches of the questions that may be names; those of ``named`` (name) that stand there are among them."""
    runs = F.split("name", " ")
    # One row: the numbers of runs that names have, which are few, and the length of their longest run.
    shape = named.agg(F.collect_set(F.size(runs)).alias("sizes"), F.coalesce(F.max(F.array_max(F.transform(runs, lambda r: F.char_length(r)))), F.lit(0)).alias("longest"))
    words = queries.select("qid", F.split(F.lower("question"), " ").alias("w")).filter("w is not null").crossJoin(F.broadcast(shape))
    single = words.filter(F.array_contains("sizes", 1)).select("qid", "longest", F.explode("w").alias("run"))
    single = single.select("qid", F.explode(_stretches(F.col("run"), F.col("longest"))).alias("name"))
    sized = words.select("qid", "w", "longest", F.explode("sizes").alias("n")).filter("n > 1 and n <= size(w)")
    at = sized.select("qid", "longest", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
    spans = at.select("qid", "longest", F.slice("w", F.col("i"), F.col("n")).alias("s"))
    # A name's outer runs may be parts of the text's outer runs ("(bert)").
    spans = spans.filter(F.forall(F.slice("s", 2, F.size("s") - 2), lambda r: F.char_length(r) <= F.col("longest")))
    heads = spans.select("longest", "qid", "s", F.explode(_outer(F.element_at("s", 1), F.col("longest"), True)).alias("head"))
    grams = heads.select("qid", "s", "head", F.explode(_outer(F.element_at("s", -1), F.col("longest"), False)).alias("end"))
    name = F.array_join(F.concat(F.array("head"), F.slice("s", 2, F.size("s") - 2), F.array("end")), " ")
    return single.unionByName(grams.select("qid", name.alias("name"))).filter("name <> ''").distinct()


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once and not again for each element of a lambda."""
    return F.transform(F.array(value), use)[0]


def _in_word(char: Column) -> Column:
    return F.rlike(char, F.lit(r"(?U)\w"))


def _text(chars: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(chars, first, last - first + 1), "")


def _outer(run: Column, longest: Column, suffixes: bool) -> Column:
    """Suffixes or prefixes of a run, of at most ``longest`` characters, that begin or end at a word edge."""

    def cuts(chars: Column) -> Column:
        n = F.size(chars)
        if suffixes:
            at = F.filter(F.sequence(F.greatest(n - longest + 1, F.lit(1)), n), lambda i: (i == 1) | ~_in_word(F.get(chars, i - 2)))
            return F.transform(at, lambda i: _text(chars, i, n))
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.least(n, longest), F.lit(1))), lambda i: (i == n) | ~_in_word(F.get(chars, i)))
        return F.transform(at, lambda i: _text(chars, F.lit(1), i))

    return _bound(F.split(run, ""), cuts)


def _stretches(run: Column, longest: Column) -> Column:
    """Parts of a run, of at most ``longest`` characters, that begin and end at word edges."""

    def cuts(chars: Column) -> Column:
        n = F.size(chars)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~_in_word(F.get(chars, i - 2)))

        def of(i: Column) -> Column:
            ends = F.filter(F.sequence(i, F.greatest(F.least(n, i + longest - 1), i)), lambda j: (j == n) | ~_in_word(F.get(chars, j)))
            return F.transform(ends, lambda j: _text(chars, i, j))

        return F.flatten(F.transform(starts, of))

    return _bound(F.split(run, ""), cuts)


def _only(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``key`` may be a node of ``known`` (node), a written table.

    Up to ``LISTED`` nodes go to all tasks as hashes, so that the other rows are not shuffled; of more, all rows stay.
    """
    if known.count() > LISTED:
        return rows
    hashes = known.select(F.xxhash64("node").alias("node_hash")).distinct()
    return rows.join(F.broadcast(hashes), F.xxhash64(key) == F.col("node_hash"), "left_semi")


def neighbours(frontier: DataFrame, edges: DataFrame, back: DataFrame | None = None) -> DataFrame:
    """(qid, node): nodes beside those of ``frontier`` (qid, node), edges taken both ways; the edges are not turned round as a table.

    ``back`` are the edges to take against their direction, where these are fewer.
    """
    edges, back = edges.select("src", "dst"), (edges if back is None else back).select("src", "dst")
    out = frontier.join(edges, frontier["node"] == edges["src"]).select("qid", F.col("dst").alias("node"))
    return out.unionByName(frontier.join(back, frontier["node"] == back["dst"]).select("qid", F.col("src").alias("node")))


def reached_entities(nodes: DataFrame, edges: DataFrame, linked: DataFrame, hops: int = 1, implied: bool = False) -> DataFrame:
    """(qid, entity, dist): entities within ``hops`` undirected edges of a query's anchors, nearest distance.

    The search passes through chunks and documents too. It is one join per hop over the frontier. With
    ``implied`` two entities of one chunk are neighbours, as if co-occurrence edges stood in the table; their
    number is quadratic in a chunk's entities, and the search needs the frontier's only.
    """
    entities = nodes.filter("ntype = 'entity'").select(F.col("id").alias("entity"))
    return _reached(edges, linked, hops, implied).join(entities, "entity", "left_semi").select("qid", "entity", "dist")


def _reached(edges: DataFrame, linked: DataFrame, hops: int, implied: bool) -> DataFrame:
    """``reached_entities``, with chunks and documents under way among them."""
    known, step = _steps(edges, linked, hops, implied)
    if step is not None:
        known = known.unionByName(_new(step, known, hops))
    return known.select("qid", F.col("node").alias("entity"), "dist")


def _new(step: DataFrame, known: DataFrame, dist: int) -> DataFrame:
    return step.distinct().join(known.select("qid", "node"), ["qid", "node"], "left_anti").withColumn("dist", F.lit(dist))


def _steps(edges: DataFrame, linked: DataFrame, hops: int, implied: bool, keep: Callable[..., DataFrame] = lambda df, *by: df) -> tuple[DataFrame, DataFrame | None]:
    """(qid, node, dist) of what is reached before the last hop, and (qid, node) of the last hop, where nodes may repeat and be known.

    With ``keep`` the size of each frontier but the last is known.
    """
    frontier = keep(linked.select("qid", F.col("entity").alias("node"), F.lit(0).alias("dist")).distinct())
    known, step, plain = frontier, None, edges.select("src", "dst")
    mention = edges.filter("key = 'MENTIONS'").select(F.col("src").alias("chunk"), F.col("dst").alias("entity"))
    for d in range(1, hops + 1):
        step = neighbours(frontier.select("qid", "node"), plain) if d < hops else _beside(frontier.select("qid", "node"), edges)
        if implied:
            at = keep(frontier.join(mention, frontier["node"] == mention["entity"]).select("qid", "chunk").distinct())
            step = step.unionByName(at.join(mention, "chunk").select("qid", F.col("entity").alias("node")))
        if d < hops:
            frontier = keep(_new(step, known, d))
            known = known.unionByName(frontier)
    return known, step


def ranked_chunks(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(qid, chunk_id, score, rank): sum of 1 / (dist + 1) over the reached entities that a chunk mentions."""
    mention = edges.filter("key = 'MENTIONS'").select(F.col("src").alias("chunk_id"), F.col("dst").alias("entity"))  # one edge for each
    scored = reached.join(mention, "entity").groupBy("qid", "chunk_id").agg(F.round(F.sum(1 / (F.col("dist") + F.lit(1.0))), 12).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order))


def best_chunks(edges: DataFrame, linked: DataFrame, hops: int, k: int, implied: bool, keep: Callable[..., DataFrame] = lambda df, *by: df) -> DataFrame:
    """The k best of ``ranked_chunks`` of what ``reached_entities`` gives, where nearly every chunk is reached by nearly every query.

    A mention goes to its chunk once, with the list of the queries that reach its entity; (query, mention) pairs are only made
    and counted where the chunk is put together, and not shuffled. Few (query, chunk) rows leave a task. Long lists are those of
    frequent entities: they go to all tasks, as far as they are few, and their mentions take only the list's number along.
    ``keep`` writes a table that is read several times.
    """
    asked = keep(linked.select("qid").distinct())
    asked = keep(_numbered(asked, "qid", asked.count() // BLOCK + 1).withColumnRenamed("no", "who"))
    known, step = _steps(edges, linked.join(asked, "qid").select(F.col("who").alias("qid"), "entity"), hops, implied, keep)
    # A query and its distance in one number, in this order, so that of a query's numbers in a sorted list the first is its nearest.
    code = lambda dist: (F.col("qid") * (hops + 1) + dist).cast("int").alias("code")
    seen = known.select("node", code(F.col("dist")))
    seen = seen if step is None else seen.unionByName(step.select("node", code(F.lit(hops))))
    query = lambda c: F.floor(c / (hops + 1))
    nearest = lambda s: F.filter(s, lambda x, i: (i == 0) | (query(F.get(s, i - 1)) != query(x)))
    lists = seen.groupBy(F.col("node").alias("entity")).agg(F.collect_set("code").alias("codes"))
    near = keep(lists.select("entity", _bound(F.sort_array("codes"), nearest).alias("nos")))
    size = _least_size(near)
    shared = keep(_numbered(near.filter(F.size("nos") >= size), "entity", 64).withColumnRenamed("no", "list"))
    mention = edges.filter("key = 'MENTIONS'").select(F.col("src").alias("chunk_id"), F.col("dst").alias("entity"))
    met = mention.join(F.broadcast(shared.select("entity", "list")), "entity", "left")
    sent = met.filter("list is not null").select("chunk_id", "list", F.lit(None).cast("array<int>").alias("own"))
    sent = sent.unionByName(met.filter("list is null").join(near.filter(F.size("nos") < size), "entity").select("chunk_id", "list", F.col("nos").alias("own")))
    sent = sent.repartition("chunk_id").join(F.broadcast(shared.select("list", "nos")), "list", "left").select("chunk_id", F.coalesce("own", "nos").alias("nos"))
    each = sent.select("chunk_id", F.explode("nos").alias("no")).select("chunk_id", query(F.col("no")).cast("int").alias("who"), (F.col("no") % (hops + 1)).alias("dist"))
    scored = each.groupBy("chunk_id", "who").agg(F.round(F.sum(1 / (F.col("dist") + F.lit(1.0))), 12).alias("score"))
    order = Window.partitionBy("who").orderBy(F.desc("score"), "chunk_id")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked, "who").select("qid", "chunk_id", "score", "rank")


def _numbered(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """``rows`` with ``no``, a number for each key, the same wherever it is made; keys are dealt to ``blocks``."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    within = F.row_number().over(Window.partitionBy("block").orderBy(key))
    return rows.withColumn("block", block).withColumn("no", within * blocks + F.col("block")).drop("block")


def _least_size(lists: DataFrame) -> int:
    """The least size of lists ``nos`` from which on all of them hold no more than ``LISTED`` numbers; ``LONG_LIST`` at least."""
    sizes = lists.filter(F.size("nos") >= LONG_LIST).groupBy(F.size("nos").alias("size")).agg(F.count("*").alias("n"))
    total = F.sum(F.col("size") * F.col("n")).over(Window.orderBy(F.desc("size")))
    fits = sizes.withColumn("total", total).filter(F.col("total") <= LISTED).agg(F.min("size").alias("size"))
    return fits.first()[0] or (1 << 31) - 1


def top_chunks(edges: DataFrame, linked: DataFrame, hops: int, k: int, keep: Callable[..., DataFrame] = lambda df, *by: df) -> DataFrame:
    """The k best of ``ranked_chunks`` of what ``reached_entities`` gives, without scoring all chunks that are reached.

    Chunks that mention an entity within s edges of a query's anchors are scored whole: what else such a chunk mentions is
    at most s + 2 edges away, through the chunk. All other chunks score at most m / (s + 2), m being the most entities that a
    chunk has. A query with k better ones is settled; only the others search on, from s = 0 to ``hops``. ``keep`` writes
    a table that is read several times.
    """
    mention = edges.filter("key = 'MENTIONS'").select(F.col("src").alias("chunk_id"), F.col("dst").alias("entity"))
    # Two chunks of one hash would make the bound larger, and no less true.
    most = mention.groupBy(F.xxhash64("chunk_id").alias("chunk")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    known = frontier = keep(linked.select("qid", F.col("entity").alias("node"), F.lit(0).alias("dist")).distinct())
    order, out = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"), None
    for s in range(hops + 1):
        seen = known
        if s < hops:
            away, back = _only(edges, "src", frontier), _only(edges, "dst", frontier)
            step = neighbours(frontier.select("qid", "node"), away, back) if s + 1 < hops else _beside(frontier.select("qid", "node"), away, back)
            frontier = keep(step.distinct().join(known.select("qid", "node"), ["qid", "node"], "left_anti").withColumn("dist", F.lit(s + 1)))
            seen = known.unionByName(frontier)
        found = known.select("qid", F.col("node").alias("entity")).join(_only(mention, "entity", known), "entity").select("qid", "chunk_id").distinct()
        near = seen.select("qid", F.col("node").alias("entity"), "dist")
        dist = F.coalesce("dist", F.lit(s + 2 if s + 2 <= hops else None).cast("int"))
        each = found.join(mention, "chunk_id").join(near, ["qid", "entity"], "left").withColumn("dist", dist)
        scored = each.groupBy("qid", "chunk_id").agg(F.round(F.sum(1 / (F.col("dist") + F.lit(1.0))), 12).alias("score"))
        best = keep(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        if s < hops:
            settled = keep(best.filter((F.col("rank") == k) & (F.col("score") > most / (s + 2) + 1e-9)).select("qid"))
            best = best.join(settled, "qid", "left_semi")
            known = keep(seen.join(settled, "qid", "left_anti"))
            frontier = keep(frontier.join(settled, "qid", "left_anti"))
        out = best if out is None else out.unionByName(best)
    return out.select("qid", "chunk_id", "score", "rank")


def _beside(frontier: DataFrame, edges: DataFrame, back: DataFrame | None = None) -> DataFrame:
    """``neighbours`` that are entities."""
    away = edges.filter("key <> 'HAS_CHUNK'").select("src", "dst")
    back = (edges if back is None else back).filter("key not in ('HAS_CHUNK', 'MENTIONS')").select("src", "dst")
    out = frontier.join(away, frontier["node"] == away["src"]).select("qid", F.col("dst").alias("node"))
    return out.unionByName(frontier.join(back, frontier["node"] == back["dst"]).select("qid", F.col("src").alias("node")))


def count_documents(mentioned: DataFrame, reached: DataFrame, keep: Callable[..., DataFrame] = lambda df, *by: df, at_once: int = SENT) -> DataFrame:
    """(qid, n_docs, first): documents of the reached entities' chunks, counted, and the first one's number.

    ``mentioned`` (entity, doc) has numbers for documents. An entity's documents go to a query as lists of numbers, one
    for each million documents, and not as rows of names. Queries take turns, so that about ``at_once`` numbers are sent before
    the files of the turn can go; ``keep`` writes a turn's result.
    """
    part = F.shiftright("doc", 20)
    lists = keep(mentioned.groupBy("entity", part.alias("part")).agg(F.collect_set("doc").alias("docs")))
    reached = keep(reached.select("qid", "entity").distinct())
    sizes = lists.groupBy("entity").agg(F.sum(F.size("docs").cast("long")).alias("n"))
    total = reached.groupBy("entity").agg(F.count("*").alias("queries")).join(sizes, "entity").agg(F.sum(F.col("queries") * F.col("n"))).first()[0] or 0
    turns, out = -(-int(total) // at_once) or 1, None
    for turn in range(turns):
        asked = reached.filter(F.pmod(F.xxhash64("qid"), F.lit(turns)) == turn)
        sent = asked.join(lists, "entity").select("qid", "part", "docs")
        each = sent.groupBy("qid", "part").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))
        counted = keep(each.groupBy("qid").agg(F.sum(F.size("docs").cast("long")).alias("n_docs"), F.min(F.array_min("docs")).alias("first")))
        out = counted if out is None else out.unionByName(counted)
        if turn + 1 < turns:
            del asked, sent, each
            release_unused(out.sparkSession)
    return out


def reached_documents(nodes: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, doc_ids): documents of the ranked chunks, sorted."""
    docs = nodes.filter("ntype = 'chunk'").select(F.col("id").alias("chunk_id"), "doc_id")
    return ranked.join(docs, "chunk_id").groupBy("qid").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def relation_paths(nodes: DataFrame, edges: DataFrame, linked: DataFrame, most: int = MOST_PATHS) -> DataFrame:
    """(qid, pos, path): relations that leave a query's anchors, by anchor's rank and then target's name."""
    target = nodes.filter("ntype = 'entity'").select(F.col("id").alias("dst"), F.col("name").alias("target"))
    out = edges.filter("relation is not null").select("src", "dst", "relation")
    hits = linked.join(out, linked["entity"] == out["src"]).join(target, "dst")
    order = Window.partitionBy("qid").orderBy("rank", "target", "dst")
    paths = hits.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)
    return paths.select("qid", "pos", tx.path_text(F.col("surface"), F.col("relation"), F.col("target")).alias("path"))


def expand(nodes: DataFrame, edges: DataFrame, queries: DataFrame, hops: int = 1) -> DataFrame:
    """(qid, chunk_ids, doc_ids, entity_names, paths) of each query that has an anchor."""
    linked = link_entities(anchor_index(nodes, edges), queries)
    ranked = ranked_chunks(edges, reached_entities(nodes, edges, linked, hops))
    listed = lambda df, at, what, out: df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(at, what))).alias("x")).select("qid", F.col(f"x.{what}").alias(out))
    names = listed(linked, "rank", "surface", "entity_names")
    chunks = listed(ranked, "rank", "chunk_id", "chunk_ids")
    paths = listed(relation_paths(nodes, edges, linked), "pos", "path", "paths")
    out = names.join(chunks, "qid", "left").join(reached_documents(nodes, ranked), "qid", "left").join(paths, "qid", "left")
    none = F.array().cast("array<string>")
    return out.select("qid", *[F.coalesce(c, none).alias(c) for c in ("chunk_ids", "doc_ids", "entity_names", "paths")])


def multihop_candidates(nodes: DataFrame, edges: DataFrame, eligible: DataFrame | None = None, bridges: DataFrame | None = None, seed: str = "42", tries: int = 8, keep: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(a, b, c1, c2): entity A beside B in chunk C1, and a bridge chunk C2 about B, of another document, without A.

    One candidate per (B, C1): B's chunks have a seeded order, and the first that fits is taken, with the least
    A. B occurs in at least two ``eligible`` chunks (chunk_id); ``bridges`` (entity) restricts B. The first
    ``tries`` chunks of each B nearly always hold one that fits, so B's chunks are not paired with each other;
    only a (B, C1) that none of them fits is held against all of B's chunks. Chunks are ordered by name alone, and only the
    first ones of each B get their entities. With ``keep``, which writes a table, all chunks of a B meet only where such a (B, C1) is left.
    """
    named = nodes.filter("ntype = 'entity'").select(F.col("id").alias("entity"), tx.normal_name(F.col("name")).alias("name")).filter(F.char_length("name") >= LEAST_NAME)
    mention = edges.filter("key = 'MENTIONS'").select(F.col("src").alias("chunk"), F.col("dst").alias("entity")).join(named, "entity")
    docs = nodes.filter("ntype = 'chunk'").select(F.col("id").alias("chunk"), "doc_id")
    # A chunk's entities stay in one row, which goes to each of them as a bridge; so (B, C1) is never put together again.
    inside = mention.groupBy("chunk").agg(F.collect_set(F.struct("entity", "name")).alias("inside")).join(docs, "chunk")
    inside = inside if eligible is None else inside.join(eligible.select(F.col("chunk_id").alias("chunk")), "chunk", "left_semi")
    about = inside.select("chunk", "doc_id", "inside", F.explode("inside").alias("e")).select(F.col("e.entity").alias("b"), F.col("e.name").alias("b_name"), "chunk", "doc_id", "inside")
    about = about if bridges is None else about.join(bridges.select(F.col("entity").alias("b")), "b", "left_semi")
    draw = F.md5(F.concat(F.lit(seed), F.col("b"), F.lit("|"), F.col("chunk")))
    second = about.select("b", draw.alias("draw"), F.col("chunk").alias("c2"), F.col("doc_id").alias("doc2"), F.col("inside.entity").alias("inside"))
    others = F.filter("inside", lambda x: (x["entity"] != F.col("b")) & (x["name"] != F.col("b_name")))
    asked = about.select("b", F.col("chunk").alias("c1"), F.col("doc_id").alias("doc1"), F.transform(others, lambda x: x["entity"]).alias("as")).filter("size(as) > 0")

    place = Window.partitionBy("b").orderBy("draw", "chunk")
    # The draw follows from the two names, so it is made after these have been shuffled.
    firsts = about.select("b", "chunk").repartition("b").withColumn("draw", draw).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= tries)
    firsts = firsts.join(inside.select("chunk", F.col("doc_id").alias("doc2"), F.col("inside.entity").alias("inside")), "chunk")
    firsts = firsts.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("draw", F.col("chunk").alias("c2"), "doc2", "inside"))).alias("firsts"))
    fits = lambda x, a: (x["c2"] != F.col("c1")) & ~x["doc2"].eqNullSafe(F.col("doc1")) & ~F.array_contains(x["inside"], a)
    hit = lambda a: F.transform(F.slice(F.filter("firsts", lambda x: fits(x, a)), 1, 1), lambda x: F.struct(x["draw"].alias("draw"), a.alias("a"), x["c2"].alias("c2")))
    tried = asked.join(firsts, "b").withColumn("m", F.array_min(F.flatten(F.transform("as", hit))))
    # Only where as many were tried as there may be is there anything left to try.
    left = F.col("m").isNull() & (F.size("firsts") == tries)
    tried = tried.select("b", "c1", F.when(left, F.col("doc1")).alias("doc1"), F.when(left, F.col("as")).alias("as"), F.struct("m.a", "m.c2").alias("m"), left.alias("left")).filter(F.col("m.a").isNotNull() | F.col("left"))
    tried = tried if keep is None else keep(tried)
    open_ = tried.filter("left").select("b", "c1", "doc1", F.explode("as").alias("a"))
    second = second if keep is None else _only(second, "b", keep(open_.select(F.col("b").alias("node")).distinct()))
    rest = open_.join(second, "b").filter((F.col("c2") != F.col("c1")) & ~F.col("doc2").eqNullSafe(F.col("doc1")) & ~F.array_contains("inside", F.col("a")))
    rest = rest.groupBy("b", "c1").agg(F.min(F.struct("draw", "a", "c2")).alias("m")).select("b", "c1", F.struct("m.a", "m.c2").alias("m"))
    one = tried.filter("not left").select("b", "c1", "m").unionByName(rest.select("b", "c1", "m"))
    return one.select(F.col("m.a").alias("a"), "b", "c1", F.col("m.c2").alias("c2"))


def ego(nodes: DataFrame, edges: DataFrame, names: list[str], hops: int = 1, label_chars: int = 24, keep: Callable[..., DataFrame] = lambda df, *by: df) -> tuple[DataFrame, DataFrame]:
    """Nodes, with a short display label, and induced edges around the entities with the given names.

    With ``keep`` what was reached is written, so its size is known, and where it is small the edges aren't shuffled.
    """
    start = nodes.filter(F.lower("name").isin([n.lower() for n in names])).select(F.lit(0).alias("qid"), F.col("id").alias("node"))
    known = keep(start.distinct())
    for _ in range(hops):
        known = keep(known.unionByName(neighbours(known, edges.select("src", "dst"))).distinct())
    inside = known.select(F.col("node").alias("id"))
    shown = nodes.join(inside, "id", "left_semi").withColumn("display", F.substring(F.coalesce("name", "id"), 1, label_chars))
    induced = edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
    return shown, induced


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): nodes by type, edges by key."""
    a = nodes.groupBy(F.concat(F.lit("node:"), "ntype").alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.concat(F.lit("edge:"), "key").alias("kind")).agg(F.count("*").alias("n")))
