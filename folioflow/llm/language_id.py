"""Language identification of mixed-language text.

The script of a word, told by code point ranges, leaves the languages written in it. Each word gets a
log-probability under each of them from hashed letter trigrams, and a Viterbi pass with a penalty for
each switch labels the words, which gives spans. The document's language is the one with most letters.

Training counts trigrams on a bounded sample of distinct labelled texts (``sample_docs``), of each language
an equal number or all it has, so rare languages are learned at any size; the model has
``BUCKETS`` numbers per language and travels to the workers in the task. Labelling reads whole texts;
words' scores are computed once per worker, and the Viterbi pass steps through all documents of a
block at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import blocks
from .workspace import cut, ship

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
SWITCH_PENALTY = 8.0
LEAST_SAMPLE = 30
RARE_SCRIPT = 0.002
BLOCK_CHARS = 12_000_000
CACHE_WORDS = 800_000
#: First and last code points of scripts, by Unicode block; what none covers is one more script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("hangul", 0xAC00, 0xD7AF), ("hangul", 0x1100, 0x11FF),
    ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FFFF),
)
SCRIPT_NAMES = tuple(dict.fromkeys(s for s, _, _ in SCRIPTS)) + ("other",)


@dataclass
class Model:
    """languages; log-probabilities (bucket, language); which languages are written in each script."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray


def script_of(word: str) -> int:
    cp = ord(word[0])
    return next((SCRIPT_NAMES.index(s) for s, a, b in SCRIPTS if a <= cp <= b), len(SCRIPT_NAMES) - 1)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of the words, spaces around, and where each word's begin."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    bucket = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    owned = np.ones(len(bucket), bool)
    starts = np.cumsum(lengths + 1) - lengths - 1
    owned[(starts + lengths)[:-1]] = False  # trigrams around the space between two words
    return bucket[owned], np.cumsum(lengths) - lengths


def train(docs: DataFrame, sample_docs: int = 3000, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``sample_docs`` distinct texts with a non-null label, taken by a hash of the text.

    Each language has an equal share of them, at least about ``LEAST_SAMPLE``; a language with fewer texts
    gives all. Rows without label or text teach nothing; a table without labels gives a model without languages.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    ship(docs.sparkSession)
    texts = labelled.select("lang", F.xxhash64("text", F.lit("lang")).alias("place")).distinct().groupBy("lang").count().collect()
    share = max(LEAST_SAMPLE, -(-sample_docs // max(1, len(texts))))
    limits = [(r["lang"], int(min(1.0, share / r["count"]) * (1 << 30))) for r in texts]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, below long")
    drawn = labelled.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64("text", F.lit("lang")), F.lit(1 << 30)) < F.col("below"))
    drawn = drawn.select("text", "lang").dropDuplicates(["text", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words = [w.lower() for w in WORD.findall(text)]
                if words:
                    grams, scripts = totals.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
                    bucket, _ = trigrams(words)
                    grams += np.bincount(bucket, minlength=BUCKETS)
                    scripts += np.bincount([script_of(w) for w in words], minlength=len(SCRIPT_NAMES))
        for lang, (grams, scripts) in totals.items():
            both = np.concatenate((grams, scripts))
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(both[at])], ["lang", "cell", "n"])

    cells = drawn.mapInArrow(count, "lang string, cell long, n long")
    rows = cut(cells.groupBy("lang", "cell").agg(F.sum("n").alias("n"))).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    counts[rows["cell"].to_numpy(int), rows["lang"].map(place).to_numpy(int)] = rows["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    seen = max(1, int((grams.sum(1) > 0).sum())) if languages else 1
    scores = np.log((grams + 0.3) / (grams.sum(0) + 0.3 * seen)).astype(np.float32)
    return Model(languages, scores, scripts >= np.maximum(1, RARE_SCRIPT * scripts.sum(0)))


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label path of each document; ``scores`` are (words, languages). All documents step together."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order])
    n_lang = scores[0].shape[1]
    flat = np.concatenate([scores[k] for k in order])
    starts = np.cumsum(lengths) - lengths
    came = np.zeros(len(flat), np.int16)  # best label of the word before
    stays = np.ones((len(flat), n_lang), bool)
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents with more than t words
    state = flat[starts[: active[0]]].copy()
    last = np.zeros((len(order), n_lang), np.float32)
    for t in range(1, longest):
        n = active[t]
        if n < len(state):
            last[n : len(state)] = state[n:]
            state = state[:n]
        at = starts[:n] + t
        top = state.argmax(1)
        switch = state.max(1) - penalty
        keep = state >= switch[:, None]
        came[at], stays[at] = top, keep
        state = np.where(keep, state, switch[:, None]) + flat[at]
    last[: len(state)] = state
    labels = np.zeros(len(flat), np.int16)
    ends = lengths > 0
    now = np.zeros(len(order), np.int64)
    now[ends] = last[ends].argmax(1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = np.where(stays[at, now[:n]], now[:n], came[at])
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(order)
    for k, s, n in zip(order, starts.tolist(), lengths.tolist(), strict=True):
        out[k] = labels[s : s + n]
    return out


class Labeller:
    def __init__(self, model: Model, penalty: float = SWITCH_PENALTY):
        self.model, self.penalty = model, penalty
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def learn(self, found: list[list[str]]) -> None:
        new = list(set().union(*found).difference(self.code)) if found else []
        if not new:
            return
        low = [w.lower() for w in new]
        bucket, starts = trigrams(low)
        scores = np.add.reduceat(self.model.scores[bucket], starts, axis=0)
        allowed = self.model.allowed[np.fromiter(map(script_of, low), np.int64, len(low))]
        some = allowed.any(1)
        scores[some] = np.where(allowed[some], scores[some], scores[some].min(1, keepdims=True) - 50)
        scores[~some] = 0
        scores -= scores.max(1, keepdims=True)
        letters = np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new), np.int64, len(new))
        scores[letters == 0] = 0
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.scores = np.concatenate((self.scores, scores))
        self.letters = np.concatenate((self.letters, letters))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        """Language, share of letters in it, and spans (start, end, lang) in code points, of each text."""
        if len(self.code) > CACHE_WORDS:
            self.forget()
        found = [WORD.findall(t) if t else [] for t in texts]
        if not self.model.languages:
            return [("und", 0.0, [])] * len(texts)
        self.learn(found)
        codes = [np.fromiter(map(self.code.__getitem__, words), np.int64, len(words)) for words in found]
        paths = viterbi([self.scores[c] for c in codes], self.penalty) if any(found) else [np.zeros(0, np.int16)] * len(texts)
        out = []
        for text, c, path in zip(texts, codes, paths, strict=True):
            letters = np.bincount(path, self.letters[c], len(self.model.languages)) if len(c) else np.zeros(1)
            total = letters.sum()
            if not total:
                out.append(("und", 0.0, []))
                continue
            best = int(letters.argmax())
            out.append((self.model.languages[best], float(letters[best] / total), self.spans(text, path)))
        return out

    def spans(self, text: str, path: np.ndarray) -> list[dict]:
        names = self.model.languages
        turns = np.flatnonzero(np.diff(path)) + 1
        if len(turns) == 0:
            first = WORD.search(text).start()
            tail = len(text)
            while not WORD.match(text, tail - 1):
                tail -= 1
            return [{"start": first, "end": tail, "lang": names[path[0]]}]
        places = [m.span() for m in WORD.finditer(text)]
        bounds = [0, *turns.tolist(), len(path)]
        return [{"start": places[a][0], "end": places[b - 1][1], "lang": names[path[a]]} for a, b in zip(bounds, bounds[1:], strict=False)]


def label(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` without its text, with lang_pred, score and spans.

    lang_pred is ``und`` and score 0 where the text is null, has no letter, or the model knows no
    language. Columns of ``docs`` that are named like a result are replaced; repeated rows are labelled
    alike; an empty table gives an empty result.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", span)]
    others = [f for f in docs.schema.fields if f.name not in (text_col, "lang_pred", "score", "spans")]
    names = [f.name for f in others]
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        labeller = Labeller(model, penalty)
        for batch in batches:
            for part in blocks(batch, text_col, BLOCK_CHARS):
                rows = labeller.label(part.column(text_col).to_pylist())
                made = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], arrow)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, "lang_pred", "score", "spans"])

    ship(docs.sparkSession)
    return docs.select(*names, text_col).mapInArrow(run, T.StructType([*others, *results]))
