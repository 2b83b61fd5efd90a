"""Model providers as column functions, with deterministic stand-ins.

The stand-ins are for tests and offline runs: they read no weights and make no claim to quality. A real
provider is any function of columns with the same shape, best an iterator pandas UDF that loads its
model once per worker.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import text as tx

Unary = Callable[[Column], Column]


@dataclass(frozen=True)
class Providers:
    """OCR, dense and sparse text embedding, image embedding, captions, entities, relations, reranking, chat, vision, judge."""

    ocr: Unary
    embed_text: Unary
    embed_sparse: Unary
    embed_image: Unary
    embed_image_query: Unary
    caption: Unary
    entities: Unary
    relations: Unary
    rerank: Callable[[Column, Column], Column]
    chat: Callable[[Column, Column, Column], Column]
    vision: Callable[[Column, Column, Column], Column]
    judge: Callable[[Column, Column, Column], tuple[Column, Column]]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Counts of words in ``dim`` hashed places, as floats."""
    places = F.transform(words_of(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))


def term_weights(text: Column) -> Column:
    """map<int, float> of word counts by hashed term."""
    terms = F.transform(words_of(text), lambda w: F.hash(w))
    return F.map_from_entries(F.transform(F.array_distinct(terms), lambda t: F.struct(t, F.size(F.filter(terms, lambda x: x == t)).cast("float"))))


def overlap(query: Column, passage: Column) -> Column:
    """Share of the query's distinct words that the passage has."""
    q = F.array_distinct(words_of(query))
    return F.size(F.array_intersect(q, words_of(passage))) / F.greatest(F.size(q), F.lit(1))


def stand_ins(dim: int = 64) -> Providers:
    """Word counts for vectors, capitalised words for entities, echoes for generated text."""
    spelled = lambda c: tx.strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s*\n\s*", "\n"))
    first = lambda c, n: F.array_join(F.slice(F.split(tx.strip(c), r"\s+"), 1, n), " ")
    capitals = lambda c: F.transform(
        F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([A-Z][A-Za-z0-9]{3,})\b"), F.lit(1))),
        lambda w: F.struct(w.alias("text"), F.lit("method").alias("label"), F.lit(1.0).alias("score")),
    )
    echo = lambda s, u, i: F.concat(F.lit("Reasoning: the first item. Answer: "), first(F.regexp_extract(u, r"(?s)\)\n(.*?)(\n\n|$)", 1), 12), F.lit(" [S1]"))
    return Providers(
        ocr=spelled,
        embed_text=lambda c: hashed_vector(c, dim),
        embed_sparse=term_weights,
        embed_image=lambda c: hashed_vector(c.cast("string"), dim),
        embed_image_query=lambda c: hashed_vector(c, dim),
        caption=lambda c: F.concat(F.lit("Image of "), F.octet_length(c).cast("string"), F.lit(" bytes")),
        entities=capitals,
        relations=lambda c: F.lit("[]"),
        rerank=overlap,
        chat=echo,
        vision=echo,
        judge=lambda q, a, e: (F.round(overlap(a, e), 2).cast("string"), F.round(overlap(q, a), 2).cast("string")),
    )


def require(package: str, purpose: str) -> None:
    """Fail when a provider is made, and not in the middle of a job, if its library is missing."""
    if importlib.util.find_spec(package) is None:
        raise ImportError(f"{package} is needed for {purpose}")
