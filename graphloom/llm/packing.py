"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all rows with one text; its size is the bytes of its rows plus one each.  Groups enter bins
in decreasing size, each into the bin with the tightest remaining capacity that holds it, found in a
balanced tree over the remaining capacities.  Groups of one size are alike, so the packing works on
the histogram of sizes, and the driver sees that histogram only.  Sizes from 65,536 on are rounded up to
16 significant bits, at every size of the table, so it has at most 32,768 entries for each doubling of the
size beyond that.  The groups of a size are then numbered across the cluster and take the places that the
packing has for that size.

For a given number of shards a capacity that suffices is found by bisection, to one part in 65,536; as
best fit is not monotone in the capacity, a smaller one that suffices by chance may exist.  Groups larger than
an equal share have a shard each, and the others share the remaining shards evenly.

Defined results: a null text counts as empty (size 1, one group with empty texts); repeated rows and
ties are copies that stay together; slots number a shard's rows from 0 without gaps; null doc_ids
are rows like others; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.scratch import Scratch

SHARDS = 16
#: Significant bits of sizes, and of the capacity that is looked for.
SIZE_BITS = 16
#: Hash ranges in which rows of one size or shard are numbered side by side.
LANES = 512


class CapacityTree:
    """An AVL tree of (remaining capacity, bin), for the tightest bin that holds a size."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _balanced(self, key, left, right):
        height = self._height
        if height(left) > height(right) + 1:
            k, a, b, _ = left
            if height(a) >= height(b):
                return self._node(k, a, self._node(key, b, right))
            kb, ba, bb, _ = b
            return self._node(kb, self._node(k, a, ba), self._node(key, bb, right))
        if height(right) > height(left) + 1:
            k, a, b, _ = right
            if height(b) >= height(a):
                return self._node(k, self._node(key, left, a), b)
            ka, aa, ab, _ = a
            return self._node(ka, self._node(key, left, aa), self._node(k, ab, b))
        return self._node(key, left, right)

    def _node(self, key, left, right):
        return (key, left, right, 1 + max(self._height(left), self._height(right)))

    def _insert(self, node, key):
        if node is None:
            return self._node(key, None, None)
        k, a, b, _ = node
        return self._balanced(k, self._insert(a, key), b) if key < k else self._balanced(k, a, self._insert(b, key))

    def _least(self, node):
        while node[1]:
            node = node[1]
        return node[0]

    def _remove(self, node, key):
        k, a, b, _ = node
        if key < k:
            return self._balanced(k, self._remove(a, key), b)
        if key > k:
            return self._balanced(k, a, self._remove(b, key))
        if a is None or b is None:
            return a or b
        low = self._least(b)
        return self._balanced(low, a, self._remove(b, low))

    def add(self, capacity: int, number: int) -> None:
        self.root = self._insert(self.root, (capacity, number))

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin with at least `size` left (the first of equal ones)."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self.root = self._remove(self.root, best)
        return best


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Places of each size: (size, first, count, bin), `first` numbering the groups of that size.

    `histogram` holds (size, count).  Bins are opened as needed; with `most`, None if they don't suffice.
    """
    tree, opened, out = CapacityTree(), 0, []
    for size, count in sorted(histogram, reverse=True):
        if size > capacity:
            return None if most is not None else _too_large(size, capacity)
        first = 0
        while count:
            found = tree.take(size)
            if found is None:
                if most is not None and opened >= most:
                    return None
                found, opened = (capacity, opened), opened + 1
            n = min(count, found[0] // size)
            out.append((size, first, n, found[1]))
            tree.add(found[0] - n * size, found[1])
            first, count = first + n, count - n
    return out


def _too_large(size: int, capacity: int):
    raise ValueError(f"a group of {size} bytes is larger than a shard's capacity of {capacity}")


def smallest_capacity(histogram: list[tuple[int, int]], shards: int) -> int:
    """A capacity for which best-fit-decreasing needs at most `shards` bins; one a step smaller does not do."""
    total = sum(s * n for s, n in histogram)
    low = max(max((s for s, _ in histogram), default=1), -(-total // shards))
    high = low
    while best_fit_decreasing(histogram, high, shards) is None:
        high += max(1, high // 64)
    while low < high and high - low > high >> SIZE_BITS:
        mid = (low + high) // 2
        if best_fit_decreasing(histogram, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return high


def even_places(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Places (as in `best_fit_decreasing`) in `shards` bins of near equal size: groups larger than an equal share of
    what is left have a bin each, the rest enter the other bins by best fit."""
    rest, left, total, out = dict(histogram), shards, sum(s * n for s, n in histogram), []
    for size, count in sorted(histogram, reverse=True):
        alone = 0
        while alone < count and left > 1 and size * left > total:
            out.append((size, alone, 1, shards - left))
            alone, left, total = alone + 1, left - 1, total - size
        if alone:
            rest[size] -= alone
        if alone < count:
            break
    rest = [(s, n) for s, n in rest.items() if n]
    lone: dict[int, int] = {}
    for size, *_ in out:
        lone[size] = lone.get(size, 0) + 1
    packed = best_fit_decreasing(rest, smallest_capacity(rest, left), left) if rest else []
    return out + [(s, first + lone.get(s, 0), n, b + shards - left) for s, first, n, b in packed]


def _numbered(df: DataFrame, group: str, order: list[str], lane, name: str, scratch: Scratch) -> DataFrame:
    """df with a gapless number from 0 within `group`, counted in lanes so that a large group is many tasks."""
    df = scratch.put(df.withColumn("__lane", lane), name)
    counts = df.groupBy(group, "__lane").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("__g"), F.col("__lane").alias("__l"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(group, "__lane").orderBy(*order)) - 1
    joined = df.withColumn("__own", own).join(starts, (F.col(group) == F.col("__g")) & (F.col("__lane") == F.col("__l")))
    return joined.withColumn(name, F.col("__start") + F.col("__own")).drop("__lane", "__own", "__g", "__l", "__start")


def _class_size(size):
    """A size rounded up to `SIZE_BITS` significant bits."""
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.length(F.bin(size)) - SIZE_BITS))
    return (F.floor((size - 1) / unit) + 1) * unit


def pack(documents: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    With `capacity` (bytes) shards are opened as needed; else `shards` are filled evenly."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = scratch.put(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"),
        ), "rows",
    )
    groups = rows.groupBy("g1", "g2", "size").agg(F.sum("size").alias("class")).select("g1", "g2", "size", "class")
    groups = scratch.put(groups.withColumn("class", _class_size(F.col("class")).cast("long")), "groups")
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"))
    counts = [(r["class"], r["n"]) for r in histogram.toLocalIterator()]
    places = best_fit_decreasing(counts, capacity) if capacity else even_places(counts, shards)
    plan = pd.DataFrame(places, columns=["place_class", "first", "count", "shard"]).astype("int64")
    plan = spark.createDataFrame(plan, "place_class long, first long, count long, shard long").withColumn("shard", F.col("shard").cast("int"))
    ranked = _numbered(groups, "class", ["g1", "g2", "size"], F.pmod(F.hash("g1", "g2"), F.lit(LANES)), "rank", scratch)
    here = (F.col("class") == F.col("place_class")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    homes = ranked.join(plan, here).select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("size").alias("h_size"), "shard")
    placed = rows.join(homes, (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")) & (F.col("size") == F.col("h_size"))).select("doc_id", "size", "text_crc32", "g1", "shard")
    lane = F.pmod(F.hash("doc_id", "g1"), F.lit(LANES))
    return _numbered(placed, "shard", ["doc_id", "g1"], lane, "slot", scratch).select("doc_id", "size", "text_crc32", "shard", "slot")
