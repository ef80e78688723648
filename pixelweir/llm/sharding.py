"""Sharding by best-fit decreasing bin packing.

Rows that belong together (here: equal texts) form a group that no shard boundary cuts. Groups are packed by falling size,
each into the shard with the least remaining capacity that still holds it, found in a balanced tree.

Groups of one size are interchangeable, so the packing works on runs of them: the driver gets one row for each distinct size with
the number of its groups, and the tightest shard takes as many of a run as it holds before the next is looked for, just as it would
one by one. Distinct sizes are at most the root of twice all bytes. Groups are numbered by falling size on the executors; the
plan is a list of ranges of these numbers with their shards.

For a given number of shards the capacity is the smallest, within a thousandth, that the packing fills with that many.

Defined results: a null text has no bytes and counts as an empty one in its group; groups of equal size go in the order of their
names; rows are never merged; a group larger than the capacity (or the fair share) gets a shard to itself; texts are read only
to their length and digests, so a very long one is a large group and no more; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweir.llm import common
from pixelweir.llm.common import documents, hot_join, written

SHARDS = 8
#: Numbers of groups that are looked up in the plan together.
SLICE = 1024


class _Node:
    __slots__ = ("key", "left", "rank", "right")

    def __init__(self, key: tuple[int, int], rank: float):
        self.key, self.rank, self.left, self.right = key, rank, None, None


class CapacityTree:
    """Open bins ordered by remaining capacity, in a treap: a search tree kept balanced by random ranks (from a fixed seed)."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self.random = random.Random(11)

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b

    def add(self, remaining: int, number: int) -> None:
        low, high = self._split(self.root, (remaining, number))
        self.root = self._join(self._join(low, _Node((remaining, number), self.random.random())), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin of least remaining capacity that holds size, the lower number first."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        first = high
        while first.left is not None:
            first = first.left
        _, rest = self._split(high, (first.key[0], first.key[1] + 1))
        self.root = self._join(low, rest)
        return first.key


#: Numbers of groups from the first up to (not with) the second, and their bin.
Piece = tuple[int, int, int]


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Piece] | None:
    """The bins of groups numbered by falling size, given as runs of (size, number of groups); None if there would be more than `most` bins.

    A group larger than the capacity gets a bin of its own.
    """
    tree, bins, at, out = CapacityTree(), 0, 0, []
    for size, count in runs:
        end = at + count
        while at < end:
            found = tree.take(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            remaining, number = found
            n = min(end - at, max(1, remaining // size) if size else end - at)
            if out and out[-1][2] == number:
                out[-1] = (out[-1][0], at + n, number)
            else:
                out.append((at, at + n, number))
            tree.add(max(0, remaining - n * size), number)
            at += n
    return out


def pack_into(runs: list[tuple[int, int]], shards: int) -> list[Piece]:
    """A packing of least capacity, within a thousandth, that needs no more than the given number of bins."""
    if not runs:
        return []
    low = high = max(1, math.ceil(sum(size * count for size, count in runs) / shards))
    while (found := best_fit_decreasing(runs, high, shards)) is None:
        high += max(1, high // 64)
    while high - low > max(1, low // 1000):
        middle = (low + high) // 2
        tried = best_fit_decreasing(runs, middle, shards)
        if tried is None:
            low = middle
        else:
            high, found = middle, tried
    return found


def _placed(groups: DataFrame, pieces: list[Piece], n_groups: int) -> DataFrame:
    """Numbered groups with the shard of the piece that their number lies in; both are cut into slices of numbers and joined by these."""
    plan = groups.sparkSession.createDataFrame(pieces, "from_ long, to_ long, shard int")
    sliced = plan.withColumn("slice_", F.explode(F.sequence(F.expr(f"from_ DIV {SLICE}"), F.expr(f"(to_ - 1) DIV {SLICE}"))))
    if len(pieces) + n_groups // SLICE <= common.BROADCAST_ROWS:
        sliced = F.broadcast(sliced)
    return groups.withColumn("slice_", F.expr(f"number_ DIV {SLICE}")).join(sliced, "slice_").where("from_ <= number_ AND number_ < to_").select("group_", "n_", "shard")


def packed(rows: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """rows (with size and group_) with a column shard: `shards` of equal capacity, or as few as hold `capacity` each.

    rows are read several times, so they should be stored.
    """
    groups = rows.groupBy("group_").agg(F.sum("size").alias("bytes_"), F.count("*").alias("n_"))
    held = written(common.numbered(written(groups, "groups"), [F.col("bytes_").desc(), F.col("group_")], "number_"), "numbers")
    sizes = held.groupBy("bytes_").agg(F.count("*").alias("groups_"), F.sum("n_").alias("rows_")).toArrow().sort_by([("bytes_", "descending")])
    runs = list(zip(sizes.column("bytes_").to_pylist(), sizes.column("groups_").to_pylist(), strict=True))
    pieces = best_fit_decreasing(runs, capacity) if capacity else pack_into(runs, shards)
    where = _placed(held, pieces, held.count())
    return hot_join(rows, where, "group_", "n_", sum(sizes.column("rows_").to_pylist()))


def numbered(rows: DataFrame, by: list[Column], slot: str = "slot") -> DataFrame:
    """rows with a number within their shard, gapless from 0; no task orders a whole shard."""
    held = common.numbered(rows, [F.col("shard"), *by], "number_")
    counts = rows.groupBy("shard").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", F.coalesce(before, F.lit(0)).alias("start_"))
    starts = F.broadcast(starts) if counts.count() <= common.BROADCAST_ROWS else starts
    return held.join(starts, "shard").withColumn(slot, (F.col("number_") - F.col("start_")).cast("long")).drop("number_", "start_")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, by the law `bytes`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("group_"))
    placed = numbered(written(packed(written(rows, "rows"), shards), "placed"), [F.col("doc_id"), F.col("group_")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
