"""Near-duplicate documents by DartMinHash signatures and banded joining.

1. Each text becomes its bag of five-word shingles. Weighted by their numbers, the shingles give a
   DartMinHash signature of ``BANDS * ROWS`` coordinates. Texts with equal bags are one class from here on.
2. Classes that agree in a band share a bucket. In each bucket all classes are compared with the bucket's
   least class only, so a bucket of m classes gives m - 1 pairs and not m * m / 2.
3. Pairs whose exact weighted Jaccard similarity (sum of the lesser numbers over sum of the greater ones)
   reaches the threshold are links, and links make components.
4. Classes of buckets that still hold several components are compared across components, so that no link is
   lost that would join two; pairs within a component need no comparison. In buckets of more than ``FULL``
   classes, as a common phrase makes them, only classes that share one of their rarest shingles are.

Before two classes are compared, a bound on how far their parity bits differ rules out most pairs below the
threshold and none at it (``_alike``), so that few texts are read again.

At a similarity of 0.8 a pair misses all 30 bands of 6 rows with a probability of 1 in 9,000. Steps 3 and 4
are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import connected_components
from .dart_minhash import signatures
from .hashing import Hasher, U, mixed, shingle_bags, word_hashes
from .workspace import cut, ship, spare_name

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 6
VOID = (1 << 63) - 1  # stands for a null id
BLOCK = 1 << 20
WORDS = 16  # longs of a document's parity bits
FULL = 256


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    texts = batch.column("data").to_pylist()
    sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts))
    group = (np.cumsum(sizes) - sizes) // BLOCK
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for s, e in zip(bounds, bounds[1:], strict=False):
        if e > s:
            yield batch.slice(s, e - s), texts[s:e]


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def set_hashes(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set; ``elements`` are the sets' end to end, ``counts`` their sizes."""
    ends = np.cumsum(counts)
    sums = [np.concatenate((np.zeros(1, U), np.cumsum(mixed(elements ^ U(s))))) for s in (0x1234567, 0x89ABCDE)]
    one, two = (mixed(x[ends] - x[ends - counts] + counts.astype(U)).view(np.int64) for x in sums)
    return one, two


def band_values(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(items, bands): one hash of each band's coordinates and number."""
    keys = np.arange(bands, dtype=U)[None, :] + np.zeros((len(sig), 1), U)
    for r in range(rows):
        keys = mixed(keys * U(31) + sig[:, r::rows] + U(1))
    return keys.view(np.int64)


def _occurrences(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Names of first, second, ... occurrences: a bag as a set, of which Jaccard similarity is the weighted one."""
    at = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    return mixed(np.repeat(elements, weights) + at.astype(U) * U(0x9E3779B97F4A7C15))


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, width: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(5)
    for batch in batches:
        for part, texts in blocks(batch):
            n = len(texts)
            hashes, words_of, _, _ = word_hashes(texts, hasher)
            elements, owner, weights = shingle_bags(hashes, words_of, n, width)
            total = np.bincount(owner, weights, minlength=n).astype(np.int64)
            named, of = _occurrences(elements, weights), np.repeat(owner, weights)
            one, two = set_hashes(named, total)
            bits = parity_bits(named, of, n, WORDS)
            values = band_values(signatures(elements, weights, owner, n, bands * rows), bands, rows)
            some = total > 0
            columns = [part.column("key"), pa.array(one), pa.array(two), pa.array(total)]
            columns += [lists(bits.ravel(), np.full(n, WORDS)), lists(values[some].ravel(), np.where(some, bands, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "one", "two", "n", "bits", "bands"])


def _bags(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(5)
    for batch in batches:
        for part, texts in blocks(batch):
            hashes, words_of, _, _ = word_hashes(texts, hasher)
            elements, owner, weights = shingle_bags(hashes, words_of, len(texts), width)
            counts = np.bincount(owner, weights, minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("class"), lists(_occurrences(elements, weights).view(np.int64), counts)], ["class", "items"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact Jaccard similarity reaches the threshold."""
    left = sets.select(F.col("class").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("class").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(shared >= threshold * (F.size("items_a") + F.size("items_b") - shared)).select("a", "b")


def parity_bits(elements: np.ndarray, owner: np.ndarray, n: int, words: int) -> np.ndarray:
    """(n, words) longs: for each bit, whether an odd number of the set's elements fall on it.

    An element that only one of two sets has changes one bit, so at most as many bits differ as elements do.
    """
    width = 64 * words
    odd = np.bincount(owner * width + (mixed(elements) % U(width)).astype(np.int64), minlength=n * width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, words)


def _alike(words: int, threshold: float) -> Column:
    """Whether sizes ``n`` and ``n_b`` and parity bits of two sets leave it possible that they are similar.

    Of two sets at the threshold at most (1 - threshold) / (1 + threshold) * (n + n_b) elements are in one only.
    """
    apart = reduce(add, [F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(words)])
    return (F.least("n", "n_b") >= threshold * F.greatest("n", "n_b")) & (apart <= (1 - threshold) / (1 + threshold) * (F.col("n") + F.col("n_b")) + 1e-9)


def _second(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_b") for c in df.columns])


def _in_bucket(rest: DataFrame, alike: Column) -> DataFrame:
    """(a, b) of a bucket's classes (value, class, part, n, bits) of different parts that may be similar."""
    found = rest.join(_second(rest), (F.col("value") == F.col("value_b")) & (F.col("part") < F.col("part_b")) & alike)
    return found.select(F.least("class", "class_b").alias("a"), F.greatest("class", "class_b").alias("b"))


def _by_rarest(rest: DataFrame, alike: Column, threshold: float) -> DataFrame:
    """(a, b) of classes (class, part, n, bits, items) of different parts that share one of their rarest elements.

    With all elements in one order, rarest first, two sets at the threshold share one among the first
    n - ceil(threshold * n) + 1 of each; and from the first shared one on, as many are left in each as the two
    must share at least.
    """
    each = rest.select("class", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("often")).filter("often > 1")
    # Elements that no other class has come first in the order, join nothing, and needn't be listed.
    listed = each.join(often, "item").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("order"))
    alone = F.col("n") - F.size("order")
    most = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - alone
    firsts = F.transform(F.slice("order", 1, F.greatest(most, F.lit(0)).cast("int")), lambda o: o["item"])
    keys = listed.join(rest.drop("items"), "class").select("class", "part", "n", "bits", alone.alias("alone"), F.posexplode(firsts).alias("at", "item"))
    keys = keys.select("class", "part", "n", "bits", "item", (F.col("n") - F.col("alone") - F.col("at")).alias("left"))
    enough = F.least("left", "left_b") >= threshold / (1 + threshold) * (F.col("n") + F.col("n_b")) - 1e-9
    found = keys.join(_second(keys), (F.col("item") == F.col("item_b")) & (F.col("part") < F.col("part_b")) & enough & alike)
    return found.select(F.least("class", "class_b").alias("a"), F.greatest("class", "class_b").alias("b"))


def linked_classes(signed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], words: int, threshold: float = THRESHOLD, full: int = FULL) -> DataFrame:
    """(class, component) of the classes in ``signed`` (one, n, bits, bands) that are similar to another one.

    A class is its set's hash ``one``; a component is named by its least class. ``bits`` are ``words`` longs of
    parity bits. ``sets_of`` gives (class, items) for a table of classes (class). Buckets of more than ``full``
    classes are searched by rarest elements.
    """
    spots = signed.select("one", F.explode("bands").alias("value"))
    # The least is taken in another order in each bucket, so that a family's buckets have many leads. Partial
    # aggregation reduces copies and hot buckets before they are shuffled.
    turned = F.col("one").bitwiseXOR(F.col("value"))
    buckets = spots.groupBy("value").agg(F.min(turned).alias("low"), F.max(turned).alias("high")).filter("low < high")
    buckets = cut(buckets.select("value", F.col("low").bitwiseXOR(F.col("value")).alias("lead")), release=True)
    crowd = signed.select("one", "n", "bits", F.explode("bands").alias("value"))
    crowd = cut(bloom.maybe(crowd, F.col("value"), bloom.of_keys(buckets, F.col("value"))).join(buckets, "value").distinct())
    alike = _alike(words, threshold)
    leads = crowd.filter("one = lead").select(F.col("one").alias("a"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")).distinct()
    pairs = crowd.filter("one <> lead").select(F.col("lead").alias("a"), F.col("one").alias("b"), "n", "bits").distinct()
    pairs = cut(pairs.join(leads, "a").filter(alike).select("a", "b"))
    links = cut(_verified(pairs, sets_of(_ends(pairs)), threshold), release=True)

    parts = connected_components(links)
    placed = crowd.join(parts.withColumnRenamed("node", "one"), "one", "left").select("value", F.col("one").alias("class"), F.coalesce("component", "one").alias("part"), "n", "bits")
    several = placed.groupBy("value").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    rest = cut(placed.join(several.select("value", "size"), "value"))
    if rest.isEmpty():
        return parts.withColumnRenamed("node", "class")
    more = _in_bucket(rest.filter(F.col("size") <= full).drop("size"), alike)
    large = rest.filter(F.col("size") > full)
    if not large.isEmpty():
        large = cut(large.select("class", "part", "n", "bits").distinct())
        more = more.unionByName(_by_rarest(cut(large.join(sets_of(large.select("class")), "class")), alike, threshold))
    more = cut(more.distinct(), release=True)
    more = cut(_verified(more, sets_of(_ends(more)), threshold), release=True)
    return connected_components(links.unionByName(more)).withColumnRenamed("node", "class")


def _ends(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct())


def repeated(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    """(one, two, lead, size) of the classes of ``keyed`` (key, one, two) that don't stand alone.

    ``lead`` is the least key of the class's component, ``size`` the number of rows in it. A class that no
    link touches is told apart by its second hash too.
    """
    parts = cut(parts)
    each = keyed.groupBy("one", "two").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    each = bloom.flagged(each, F.col("one"), bloom.of_keys(parts, F.col("class")), "linked").filter("copies > 1 or linked")
    each = each.join(parts, F.col("one") == F.col("class"), "left").select("one", "two", "first", "copies", "component")
    each = cut(each.filter("copies > 1 or component is not null"))
    alone = each.filter("component is null").select("one", "two", F.col("first").alias("lead"), F.col("copies").alias("size"))
    linked = each.filter("component is not null")
    whole = linked.groupBy("component").agg(F.min("first").alias("lead"), F.sum("copies").alias("size"))
    return cut(alone.unionByName(linked.join(whole, "component").select("one", "two", "lead", "size")))


def placed(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that are in ``groups``, with lead and size; the others aren't shuffled."""
    return bloom.maybe(keyed, F.col("one"), bloom.of_keys(groups, F.col("one"))).join(groups, ["one", "two"])


def _row_key(id_col: str, text_col: str) -> Column:
    """Id and text's hash: rows that share an id, or have none, are told apart by their texts."""
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(VOID)).alias("id"), F.xxhash64(text_col).alias("mark"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, one, two) of all rows, without the first hash where there is no word, and the groups (see ``repeated``)."""
    ship(docs.sparkSession)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")
    # Rows of one id and text differ in their number, which holds since the table is cut.
    items = docs.select(F.struct(_row_key(id_col, text_col).getField("id").alias("id"), _row_key(id_col, text_col).getField("mark").alias("mark"), F.monotonically_increasing_id().alias("row")).alias("key"), data)
    schema = f"key {items.schema['key'].dataType.simpleString()}, one bigint, two bigint, n bigint, bits array<bigint>, bands array<bigint>"
    signed = cut(items.mapInArrow(lambda batches: _sign(batches, bands, rows, width), schema))
    keyed = signed.select("key", F.when(F.col("n") > 0, F.col("one")).alias("one"), "two")

    def sets_of(wanted: DataFrame) -> DataFrame:
        # One member's text stands for its class.
        member = bloom.maybe(keyed, F.col("one"), bloom.of_keys(wanted, F.col("class"))).join(wanted, F.col("one") == F.col("class"), "left_semi")
        member = member.groupBy(F.col("one").alias("class")).agg(F.min("key").alias("key")).select("class", F.struct("key.id", "key.mark").alias("key"))
        member, texts = cut(member), docs.select(_row_key(id_col, text_col).alias("key"), data)
        texts = bloom.maybe(texts, F.col("key"), bloom.of_keys(member, F.col("key"))).join(member, "key").dropDuplicates(["class"])
        return cut(texts.select("class", "data").mapInArrow(lambda batches: _bags(batches, width), "class bigint, items array<bigint>"))

    parts = linked_classes(signed.filter("n > 0"), sets_of, WORDS, threshold)
    return keyed, repeated(keyed.filter("one is not null"), parts)


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: id, group_id (least id of its group), group_size, kept.

    A row with the least id of a group stays, one only. Ids are whole numbers; a null id counts as the
    largest, and rows that share an id are told apart by their texts. Words are parted by ASCII white space
    and compared as they are; a text of one to four words is one shingle; null texts and texts without words
    stand alone. Only the two named columns are read, and an empty table gives no rows.
    """
    keyed, groups = _grouped(docs, id_col, text_col, threshold, width, bands, rows)
    rows_of = bloom.flagged(keyed, F.col("one"), bloom.of_keys(groups, F.col("one")), "may")
    some = rows_of.filter("may").join(groups, ["one", "two"], "left").select("key", F.coalesce("lead", "key").alias("lead"), F.coalesce("size", F.lit(1)).alias("size"))
    alone = rows_of.filter("not may").select("key", F.col("key").alias("lead"), F.lit(1).cast("long").alias("size"))
    back = lambda c: F.when(F.col(f"{c}.id") != VOID, F.col(f"{c}.id")).cast(docs.schema[id_col].dataType)
    return some.unionByName(alone).select(back("key").alias(id_col), back("lead").alias("group_id"), F.col("size").alias("group_size"), (F.col("key") == F.col("lead")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group (see ``classes``).

    A row that certainly stays and repeats no other is not shuffled.
    """
    keyed, groups = _grouped(docs, id_col, text_col, THRESHOLD, SHINGLE, BANDS, ROWS)
    members = placed(keyed, groups).groupBy("key.id", "key.mark").agg(F.max(F.col("key") == F.col("lead")).alias("stays"), F.count("*").alias("n"))
    todo = cut(members.filter("not stays or n > 1").select(F.struct("id", "mark").alias("key"), "stays"))
    return bloom.settle(docs, _row_key(id_col, text_col), todo)
