"""Quality rules under weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (0) or abstains (null). Expectation-maximisation over the table of
vote patterns estimates, for each rule, how often it is right on good and on bad documents; the
posterior probability that a document is good replaces an all-must-pass filter.

Counts cover all documents. What is iterated on is the pattern table, with at most 3 ** rules rows
whatever the input's size, on the driver. A document's repeated three-word windows are found inside its row, so
nothing is shuffled but the pattern counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .workspace import cut, spare_name

SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

#: name, vote good below or from this value, vote bad beyond that value: between them the rule abstains.
#: ``low`` rules say good at or under the first value and bad over the second; ``high`` rules the reverse.
RULES = (
    ("symbols", "low", 0.02, 0.10),
    ("capitals", "low", 0.25, 0.50),
    ("dup_lines", "low", 0.10, 0.30),
    ("repeats", "low", 0.15, 0.30),
    ("shouts", "low", 0.05, 0.20),
    ("word_length", "low", 11.0, 16.0),
    ("letters", "high", 0.92, 0.85),
    ("well_formed", "high", 0.90, 0.70),
)


@dataclass(frozen=True)
class Model:
    """Share of good documents, and each rule's accuracy on good and on bad ones."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


#: Where the iteration starts from: several shares of good documents, with the rules' expected accuracies.
STARTS = (0.97, 0.85, 0.5)
#: What is expected of a rule before any document is seen: to be right on a good one, and on a bad one. The
#: rules look for different faults, so a bad document fails few of them while a good one should fail none.
EXPECTED = (0.98, 0.3)
#: Weight of the expectation beside a class's votes. It is a small share, so the data decide, and estimates are
#: alike at every size; the one vote that comes on top matters to the smallest tables only.
WEIGHT = 0.02


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def _placed(keys: Column) -> Column:
    """Sorted (hash, place) pairs of a text's windows; null where no two windows are equal."""
    pairs = F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.sort_array(pairs))


def _repeated(placed: Column) -> Column:
    """Places, ascending, of the windows that equal a neighbour in hash order."""
    n = F.size(placed)
    same = F.zip_with(F.slice(placed, 1, n - 1), F.slice(placed, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))


def _covered(places: Column) -> Column:
    """Words in windows of three that begin at ``places``: each adds what the one before has not covered."""
    n = F.size(places)
    steps = F.zip_with(F.slice(places, 1, n - 1), F.slice(places, 2, n - 1), lambda a, b: F.least(F.lit(3), b - a))
    return F.when(places.isNull() | (n == 0), F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x)).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The contract's counts and the values that the rules look at; ``keep`` columns ride along.

    Null and empty texts have no words and zeros everywhere.
    """
    keep = [id_col] if keep is None else keep
    text, words, hashes, placed, repeated, lines_of = (spare_name(docs.columns, c) for c in ("q_text", "q_words", "q_hashes", "q_placed", "q_repeated", "q_lines"))
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(words, _words(F.col(text)))
    w = F.col(words)
    n = F.size(w)
    df = df.withColumn(hashes, F.transform(w, lambda x: F.xxhash64(x)))
    part = lambda i: F.slice(F.col(hashes), i, F.greatest(n - 2, F.lit(0)))
    pair = F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b))
    keys = spare_name(docs.columns, "q_keys")
    df = df.withColumn(keys, F.zip_with(pair, part(3), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(placed, _placed(F.col(keys))).withColumn(repeated, _repeated(F.col(placed)))
    t = F.col(text)
    df = df.withColumn(lines_of, F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    lines = F.col(lines_of)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    df = df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count(SYMBOL).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col(repeated)).alias("n_repeat_words"),
        F.size(lines).alias("v_lines"),
        (F.char_length(t) - F.char_length(F.replace(t, F.lit("!"), F.lit("")))).alias("v_shouts"),
        count(r"\p{Lu}").alias("v_upper"),
        count(r"[^\p{L}\x20\x09-\x0D]").alias("v_marks"),
        F.regexp_count(F.concat(t, F.lit(" ")), F.lit(r"\s(?<=\p{L}[.,;:!?]?\s)")).alias("v_formed"),
    )
    nw = F.col("n_words")
    df = df.withColumn("base_failed", (nw < 50) | (100 * F.col("n_repeat_words") > 50 * nw))
    letters = F.col("word_chars") - F.col("v_marks")
    values = {
        "symbols": share(F.col("n_symbols"), nw),
        "capitals": share(F.col("v_upper"), letters),
        "dup_lines": share(F.col("n_dup_lines"), F.col("v_lines")),
        "repeats": share(F.col("n_repeat_words"), nw),
        "shouts": share(F.col("v_shouts"), nw),
        "word_length": share(F.col("word_chars"), nw),
        "letters": share(letters, F.col("word_chars")),
        "well_formed": share(F.col("v_formed"), nw),
    }
    votes = []
    for name, side, good, bad in RULES:
        v = values[name]
        says = (v <= good, v > bad) if side == "low" else (v >= good, v < bad)
        votes.append(F.when(says[0], F.lit(1)).when(says[1], F.lit(0)).cast("int").alias(f"vote_{name}"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return df.select(*keep, *counts, *votes)


def start(prior: float) -> Model:
    return Model(prior, (EXPECTED[0],) * len(RULES), (EXPECTED[1],) * len(RULES))


def _logs(model: Model) -> list[float]:
    """Logarithms of the probabilities of being good, of being bad, and of each rule's votes given either."""
    out = [math.log(model.prior), math.log(1 - model.prior)]
    for g, b in zip(model.on_good, model.on_bad, strict=True):
        out += [math.log(g), math.log(1 - g), math.log(1 - b), math.log(b)]
    return out


def _log_joint(logs: Callable[[int], Column]) -> tuple[Column, Column]:
    """Log-probabilities of being good, and bad, and voting so; ``logs`` gives the numbers of ``_logs``."""
    good, bad = logs(0), logs(1)
    for i, (name, *_) in enumerate(RULES):
        vote, at = F.col(f"vote_{name}"), 2 + 4 * i
        good = good + F.when(vote == 1, logs(at)).when(vote == 0, logs(at + 1)).otherwise(0.0)
        bad = bad + F.when(vote == 1, logs(at + 2)).when(vote == 0, logs(at + 3)).otherwise(0.0)
    return good, bad


def posterior(model: Model) -> Column:
    """Probability that the document is good, given its votes."""
    values = _logs(model)
    good, bad = _log_joint(lambda i: F.lit(values[i]))
    return 1 / (1 + F.exp(bad - good))


def _iterate(votes: np.ndarray, n: np.ndarray, model: Model, steps: int, tolerance: float) -> tuple[float, Model]:
    """The log-likelihood and model after expectation-maximisation over patterns (nan: abstains) that occur ``n`` times."""
    ones, zeros = (votes == 1).astype(float), (votes == 0).astype(float)

    def rate(right: np.ndarray, wrong: np.ndarray, expected: float) -> np.ndarray:
        weight = WEIGHT * (right + wrong) + 1
        return (right + weight * expected) / (right + wrong + weight)

    prior, on_good, on_bad = model.prior, np.array(model.on_good), np.array(model.on_bad)
    fit = 0.0
    for _ in range(steps):
        good = math.log(prior) + ones @ np.log(on_good) + zeros @ np.log(1 - on_good)
        bad = math.log(1 - prior) + ones @ np.log(1 - on_bad) + zeros @ np.log(on_bad)
        both = np.logaddexp(good, bad)
        fit = float(n @ both)
        g = n * np.exp(good - both)
        b = n * np.exp(bad - both)
        last = np.concatenate([[prior], on_good, on_bad])
        prior = (g.sum() + 1) / (n.sum() + 2)
        on_good, on_bad = rate(g @ ones, g @ zeros, EXPECTED[0]), rate(b @ zeros, b @ ones, EXPECTED[1])
        if np.abs(np.concatenate([[prior], on_good, on_bad]) - last).max() < tolerance:
            break
    return fit, Model(float(prior), tuple(map(float, on_good)), tuple(map(float, on_bad)))


def fit(voted: DataFrame, steps: int = 500, tolerance: float = 1e-7) -> Model:
    """Expectation-maximisation over the vote patterns of all documents, from several starts.

    Counting the patterns is the only work on documents. There are at most 3 ** rules patterns (6,561)
    at every size of input, so they are brought to the driver once and iterated on there. A rule's accuracies
    are what its votes show, moved by ``WEIGHT`` towards what is expected of it (``EXPECTED``). The most likely
    of the models stays; an empty table leaves the middle start.
    """
    names = [f"vote_{r[0]}" for r in RULES]
    rows = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    if not rows:
        return start(STARTS[1])
    table = np.array(sorted([-1 if r[c] is None else r[c] for c in names] + [r["n"]] for r in rows), dtype=float)
    votes = np.where(table[:, :-1] < 0, np.nan, table[:, :-1])
    found = [_iterate(votes, table[:, -1], start(p), steps, tolerance) for p in STARTS]
    return max(found, key=lambda x: round(x[0], 3))[1]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: the counts, base_failed, p_good and kept.

    Defined cases: null or empty text has no words and fails the base; repeated rows and ties are
    judged alike; an empty table gives an empty result; other columns are not read.
    """
    voted = cut(features(docs, id_col, text_col))
    model = fit(voted)
    out = voted.withColumn("p_good", posterior(model))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    return out.drop(*[f"vote_{r[0]}" for r in RULES])


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Texts are measured once; of them only an id, a hash and the votes are written. Rows are judged by their
    texts, so repeated rows, ties and rows that share an id or have none are judged each for itself. Null and
    empty texts go, and an empty table gives no rows.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    name = spare_name(docs.columns, "row_key")
    voted = cut(features(docs.withColumn(name, key), id_col, text_col, keep=[name]))
    model = fit(voted)
    bad = voted.filter(F.col("base_failed") | (posterior(model) < threshold)).select(F.col(name).alias("key"), F.lit(False).alias("stays"))
    return bloom.settle(docs, key, cut(bad.distinct()))
