"""Secret scans, in DataFrame operations only: fixed patterns plus character Markov models.

The base patterns give spans of kind ``assign``, ``access`` and ``hex``. The method adds spans of kind
``random``: long unbroken strings that a Markov model of random strings explains better than one of
ordinary identifiers, by mean log-likelihood ratio per transition. Both models are trained from a
labelled sample: values of base spans in the corpus are the random strings, together with SHA-256
digests in base 64 and hex for texts without any; the words of texts without base spans, joined in the ways
that identifiers are written, are the ordinary ones.

A span's place comes from splitting the text at the pattern: pieces and matches alternate, so running
sums of their lengths are code point offsets. Everything happens within a row; nothing but the model's
counts and its sample is shuffled. The work on a text is linear but for running sums, which take n * sqrt(n) steps
for n matches.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import cut, spare_name

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole run is taken, so a lower bound in the pattern drops the same matches
HEX = r"[0-9a-f]{24,}"  # likewise
STRAND = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6
COVER = "\x01"  # stands for a covered character; a text's own are taken for spaces
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
SIZE = len(ALPHABET)


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio, random over ordinary, of each pair of characters; row-major."""

    ratio: tuple[float, ...]
    threshold: float


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where it stands in another function's lambda."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """All partial results of folding ``step``, which is associative, over an array, the first one after one element.

    It goes by blocks of sqrt(n) elements, since an array that grows in a fold is copied in each step.
    """

    def fold(part: Column) -> Column:
        begin = F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out"))

        def one(s: Column, x: Column) -> Column:
            return _let(step(s["at"], x), lambda at: F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out")))

        return F.aggregate(part, begin, one, lambda s: s["out"])

    def by_blocks(v: Column, width: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda b: fold(F.slice(v, b * width + 1, width)))

        def moved(parts: Column) -> Column:
            whole = F.concat(F.array(F.lit(start)), fold(F.transform(parts, lambda p: F.element_at(p, -1))))
            return F.flatten(F.zip_with(parts, F.slice(whole, F.lit(1), F.size(parts)), lambda p, x: F.transform(p, lambda y: step(x, y))))

        return _let(parts, moved)

    some = lambda v: _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: by_blocks(v, width))
    return _let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(some(v)))


def _spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's leftmost non-overlapping matches."""

    def rows(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "assign" else found
        both = F.arrays_zip(found.alias("m"), values.alias("v"))
        row = lambda e, r: F.struct((e - F.char_length(r["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end"), r["v"].alias("value"))
        return F.zip_with(_running(lengths, 0, lambda a, b: a + b), both, row)

    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rows)
    spans = F.filter(spans, lambda s: F.char_length(s["value"]) >= least) if least else spans
    blank = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(blank)


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start and then kind."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, "assign", ASSIGN_LEAST), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def _covered(text: Column, pattern: str, least: int = 0) -> Column:
    """The text with the characters of long strings under a base pattern's spans turned into ``COVER``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hidden = F.transform(found, lambda m: F.translate(m, ALPHABET, COVER * SIZE))
    if least:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        hidden = F.zip_with(F.arrays_zip(found.alias("m"), hidden.alias("h")), values, lambda r, v: F.when(F.char_length(v) >= least, r["h"]).otherwise(r["m"]))
    whole = F.array_join(F.zip_with(F.split(text, pattern, -1), hidden, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def _strands(text: Column) -> Column:
    """Long unbroken strings that overlap no base span: they are the same stretches in the text and in the covered ones."""
    plain = F.translate(text, COVER, " ")
    covered = [_covered(plain, ASSIGN, ASSIGN_LEAST), _covered(plain, ACCESS), _covered(plain, HEX)]
    long_ = STRAND.replace("[", f"[{COVER}")
    touched = [F.transform(F.regexp_extract_all(c, F.lit(long_), F.lit(0)), lambda x: F.contains(x, F.lit(COVER))) for c in covered]
    either = lambda a, b: F.zip_with(a, b, lambda x, y: x | y)
    marked = F.zip_with(_spans(plain, STRAND, "random"), either(either(*touched[:2]), touched[2]), lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    free = F.transform(F.filter(marked, lambda x: ~F.coalesce(x["t"], F.lit(False))), lambda x: x["s"])
    return F.when(plain.rlike(STRAND), free).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _pairs(value: Column) -> Column:
    """Cells of the transition table that a string visits, in order; characters outside the alphabet break it."""
    codes = F.transform(F.split(value, ""), lambda c: F.when(c != "", F.instr(F.lit(ALPHABET), c) - 1).otherwise(-1))
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    cells = F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.when((a >= 0) & (b >= 0), a * SIZE + b).otherwise(-1))
    return F.filter(cells, lambda c: c >= 0)


def _counts(strings: DataFrame) -> dict[int, int]:
    """Transition counts of the column ``value``: at most SIZE ** 2 rows come to the driver."""
    cells = strings.select(F.explode(_pairs(F.col("value"))).alias("cell"))
    return {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def _rows(counts: dict[int, int]) -> list[float]:
    """Transition probabilities, smoothed by half a count per cell."""
    out = []
    for a in range(SIZE):
        row = [counts.get(a * SIZE + b, 0) + 0.5 for b in range(SIZE)]
        out += [x / sum(row) for x in row]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 400, threshold: float = 0.75) -> Markov:
    """Fit both models on a sample that is expected to hold ``sample_docs`` documents at any size.

    Labels come from the base patterns: values of base spans are random strings, the documents' words,
    written in the ways identifiers and rules of marks are, are ordinary ones. Digests of 0, 1, 2, ... count as random
    too, so that a sample without secrets still gives a model. The sample takes the texts whose hash is
    low, each once, so it depends neither on ids nor on how the table is dealt out.
    """
    rate = min(1.0, sample_docs / max(1, docs.count()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(text, F.lit("sample"))
    low = docs.filter(F.pmod(mark, F.lit(1 << 30)) < int(rate * (1 << 30)))
    once = low.groupBy(mark.alias("mark")).agg(F.min(text).alias("text"))
    rows = cut(once.select("text", base_spans(F.col("text")).alias("base")))
    found = _counts(rows.select(F.explode("base").alias("s")).select(F.col("s.value").alias("value")))
    made = docs.sparkSession.range(0, 1000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), "id")
    digest = F.when(F.col("id") % 4 == 0, F.substring("h", 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.substring("h", 1, 20)))
    made = _counts(made.select(digest.otherwise(F.regexp_replace(F.base64(F.unhex("h")), "=+$", "")).alias("value")))
    words = F.filter(F.split(F.col("text"), r"[^A-Za-z]+"), lambda w: F.char_length(w) >= 3)
    mark = F.element_at(F.array(*[F.lit(c) for c in "_/-="]), (F.pmod(F.xxhash64("text"), F.lit(4)) + 1).cast("int"))
    forms = [
        F.replace(F.array_join(words, "_"), F.lit("_"), mark),
        F.array_join(F.transform(words, lambda w: F.initcap(w)), ""),
        F.upper(F.replace(F.array_join(words, "_"), F.lit("_"), mark)),
        F.array_join(F.transform(words, lambda w: F.concat(w, F.pmod(F.xxhash64(w), F.lit(2100)).cast("string"))), "_"),
        F.repeat(mark, F.lit(400)),
    ]
    plain = _counts(rows.filter(F.size("base") == 0).select(F.explode(F.array(*forms)).alias("value")))
    one, two = _rows(made), _rows(found)
    ordinary = _rows(plain)
    mix = [(a + b) / 2 for a, b in zip(one, two, strict=True)] if found else one
    return Markov(tuple(round(math.log(a / b), 4) for a, b in zip(mix, ordinary, strict=True)), threshold)


def likeness(value: Column, model: Markov) -> Column:
    """Mean log-likelihood ratio per transition; 0 for strings without one."""
    ratio = F.split(F.lit(",".join(map(str, model.ratio))), ",").cast("array<double>")
    cells = _pairs(value)
    total = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.element_at(ratio, c + 1))
    return total / F.greatest(F.size(cells), F.lit(1))


def all_spans(text: Column, base: Column, model: Markov) -> Column:
    """Base spans and the model's own, by start and then kind."""
    extra = F.filter(_strands(text), lambda s: likeness(s["value"], model) > model.threshold)
    return F.array_sort(F.concat(base, extra))


def find(docs: DataFrame, model: Markov | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id alone by default) with ``base`` and ``spans``: arrays of start, kind, end, value.

    Offsets are code points, ends exclusive; kinds are places in ``KINDS``. Null and empty texts have
    empty arrays. Repeated rows are scanned alike, other columns aren't read, and an empty table gives
    an empty result.
    """
    model = model or train(docs, id_col, text_col)
    keep = [id_col] if keep is None else keep
    text, base = (spare_name(docs.columns, c) for c in ("s_text", "s_base"))
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(base, base_spans(F.col(text)))
    return df.select(*keep, F.col(base).alias("base"), all_spans(F.col(text), F.col(base), model).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans written out."""
    df = find(docs, None, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return df.select(id_col, *map(count, KINDS[:3]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the text under every span replaced by ``mark``; spans that overlap become one.

    Rows without a span keep their text, null included.
    """
    model = train(docs, id_col, text_col)
    held, text = (spare_name(docs.columns, c) for c in ("held_row", "s_text"))
    rows = docs.withColumn(held, F.struct(*docs.columns)).select(held, F.col(text_col).alias(text))
    df = find(rows, model, held, text, keep=[held, text])
    t, n = F.col(text), F.size("spans")
    # How far the spans before each one reach, and the text between; a span that begins under another one is part of it.
    reach = _running(F.transform("spans", lambda x: x["end"]), 0, F.greatest)
    before = F.concat(F.array(F.lit(0)), reach)
    starts = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.char_length(t)))

    def joined(part: Callable[[Column, Column], Column]) -> Column:
        piece = lambda a, b: F.concat(part(a, F.greatest(b - a, F.lit(0))), F.lit(mark))
        pieces = F.zip_with(before, starts, lambda a, b: F.when(b >= a, piece(a, b)).otherwise(""))
        whole = F.array_join(pieces, "")
        return F.substring(whole, F.lit(1), F.char_length(whole) - len(mark))  # the last piece is the text's rest

    few = joined(lambda a, size: F.substring(t, a + 1, size))
    # Finding a place in a string takes a pass over it, so many places are found in the list of its characters.
    many = _let(F.split(t, ""), lambda chars: joined(lambda a, size: F.array_join(F.slice(chars, a + 1, size), "")))
    clean = F.when(n == 0, t).when(n <= 64, few).otherwise(many)
    return df.select(*[(clean if c == text_col else F.col(held).getField(c)).alias(c) for c in docs.columns])
