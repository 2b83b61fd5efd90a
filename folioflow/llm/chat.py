"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

Loggers write a conversation again each time it grows. A rolling hash over the turns names every prefix
of a conversation; one whose whole hash is a proper prefix of another is a snapshot of it. Equal
conversations become one class first; then an anti-join of the classes' whole hashes against the
distinct proper-prefix hashes leaves the maximal conversations, which are rendered.

The rolling hash chains SHA-256 over a conversation's turns in order, so each conversation is gathered
once, as it must be to be rendered; a first turn that very many conversations share is one row of the
distinct prefixes, however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def _chain(turns: Column) -> Column:
    """Rolling hashes of all prefixes of an array of turns, shortest first."""
    step = lambda s, t: F.struct(
        F.sha2(F.concat_ws(":", s["last"], F.char_length(t["role"]).cast("string"), t["role"], t["text"]), 256).alias("last"),
        F.concat(s["all"], F.array(F.sha2(F.concat_ws(":", s["last"], F.char_length(t["role"]).cast("string"), t["role"], t["text"]), 256))).alias("all"),
    )
    return F.aggregate(turns, F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")), step, lambda s: s["all"])


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, prefix_hash, status, kept, rendered.

    status is ``kept``, ``snapshot`` (a proper prefix of another conversation) or ``copy`` (equal to one
    with a smaller id); rendered is null unless kept. Turns are ordered by number, then role, then text;
    null roles count as ``user``, null texts as empty, null turn numbers come first, and exactly repeated
    rows count once. A row with a null conversation id is a conversation of one turn, so that strangers
    aren't mixed and none of them gathers all such rows; null loses against any id. Other columns are not
    read, and an empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("user")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    alone = F.when(F.col("conv").isNull(), F.sha2(F.to_json(F.struct("turn", "role", "text")), 256))
    rows = rows.select(F.struct("conv", alone.alias("alone")).alias("unit"), "turn", "role", "text")
    gathered = rows.groupBy("unit").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    hashed = gathered.select("unit", F.size("turns").alias("n"), _chain(F.col("turns")).alias("prefixes"))
    hashed = cut(hashed)
    whole = hashed.select("unit", "n", F.element_at("prefixes", -1).alias("hash"))
    classes = whole.groupBy("hash").agg(F.min(F.struct(F.col("unit.conv").isNull().alias("void"), "unit")).alias("first"))
    classes = cut(classes.select("hash", F.col("first.unit").alias("first")))
    proper = hashed.filter("n > 1").select(F.explode(F.slice("prefixes", 1, F.col("n") - 1)).alias("hash")).distinct()
    maximal = classes.join(proper, "hash", "left_anti").select("hash", F.lit(True).alias("maximal"))
    state = whole.join(classes, "hash").join(cut(maximal), "hash", "left")
    status = F.when(F.col("maximal").isNull(), "snapshot").when(F.col("unit") == F.col("first"), "kept").otherwise("copy")
    state = state.select("unit", "n", "hash", status.alias("status"))
    # Only kept conversations are gathered again, with their texts.
    kept = state.filter("status = 'kept'").select("unit")
    texts = rows.join(kept, "unit", "left_semi")
    texts = texts.groupBy("unit").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    texts = texts.select("unit", F.array_join(F.transform("turns", lambda t: _turn_text(t["role"], t["text"])), "").alias("rendered"))
    out = state.join(texts, "unit", "left")
    return out.select(
        F.col("unit.conv").alias(conv_col), F.col("n").cast("long").alias("n_turns"), F.col("hash").alias("prefix_hash"), "status", (F.col("status") == "kept").alias("kept"), "rendered"
    )
