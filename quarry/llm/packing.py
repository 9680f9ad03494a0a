"""Sharding by best-fit-decreasing bin packing.

Groups (rows of equal text) are indivisible. Items go in order of falling size, each into the bin with the
smallest remaining capacity that still holds it, found in a balanced tree (a treap keyed by remaining capacity);
a new bin is opened only if no bin fits. With a fixed number of shards, the smallest capacity for which the
packing needs no more bins is searched for.

Packing is sequential, so it runs on two levels. Tasks pack their own groups into bundles of 1 / (shards *
BUNDLES) of all bytes; a group that is larger stays alone. At most 2 * shards * BUNDLES bundles, that many large
groups, and one bundle per task reach the driver, whatever the size of the corpus; they are packed into the
shards there and the table bundle -> shard is broadcast under that same bound.

Sizes are UTF-8 bytes of the text plus 1. A null text has no bytes and groups with empty texts. Repeated rows
are rows of one group. Slots number the rows of a shard from 0 by key, without gaps; rows with equal keys come
in any order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, shuffle_partitions

BUNDLES = 512  # bundles of each shard that the driver packs, on average


class Bins:
    """Open bins in a treap ordered by (remaining capacity, number)."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.key: list[tuple[int, int]] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.rank: list[float] = []
        self.root = -1
        self._draw = random.Random(7).random

    def _insert(self, node: int) -> None:
        """Adds the node at the place its rank gives, and splits what lies below."""
        key, path, at = self.key[node], None, self.root
        while at >= 0 and self.rank[at] >= self.rank[node]:
            side = self.left if key < self.key[at] else self.right
            path, at = (side, at), side[at]
        low, high = (self.left, node), (self.right, node)
        while at >= 0:  # keys below go to the left tree, keys above to the right one
            if self.key[at] < key:
                low[0][low[1]] = at
                low, at = (self.right, at), self.right[at]
            else:
                high[0][high[1]] = at
                high, at = (self.left, at), self.left[at]
        low[0][low[1]] = high[0][high[1]] = -1
        if path:
            path[0][path[1]] = node
        else:
            self.root = node

    def _remove(self, key: tuple[int, int]) -> int:
        path, at = None, self.root
        while self.key[at] != key:
            side = self.left if key < self.key[at] else self.right
            path, at = (side, at), side[at]
        a, b = self.left[at], self.right[at]
        gone = at
        while True:  # joins the two subtrees
            if a < 0 or b < 0:
                top = b if a < 0 else a
            elif self.rank[a] >= self.rank[b]:
                top = a
            else:
                top = b
            if path:
                path[0][path[1]] = top
            else:
                self.root = top
            if a < 0 or b < 0:
                return gone
            if top == a:
                path, a = (self.right, a), self.right[a]
            else:
                path, b = (self.left, b), self.left[b]

    def add(self, size: int) -> int:
        """Number of the bin that takes an item; a bin of its own if it exceeds the capacity."""
        at, best = self.root, -1
        while at >= 0:
            if self.key[at][0] >= size:
                best, at = at, self.left[at]
            else:
                at = self.right[at]
        if best < 0:
            number, node, room = self.count, len(self.key), max(self.capacity, size)
            self.count += 1
            self.key.append((0, 0))
            self.left.append(-1)
            self.right.append(-1)
            self.rank.append(self._draw())
        else:
            room, number = self.key[best]
            node = self._remove((room, number))
        if room > size:
            self.key[node] = (room - size, number)
            self._insert(node)
        return number


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; items must come by falling size."""
    bins = Bins(capacity)
    return [bins.add(s) for s in sizes]


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Bin of each item with the smallest capacity found that needs no more than ``shards`` bins."""
    low = max(-(-sum(sizes) // shards), sizes[0] if sizes else 1)
    best, high = pack(sizes, low), low
    step = max(1, low // 4096)
    while max(best, default=0) >= shards:
        low, high, step = high + 1, high + step, step * 2
        best = pack(sizes, high)
    while low < high and high - low > max(1, low // 65536):
        mid = (low + high) // 2
        got = pack(sizes, mid)
        if max(got, default=0) < shards:
            best, high = got, mid
        else:
            low = mid + 1
    return best


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), one row per row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = save(docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"),
                            F.crc32(body).alias("text_crc32"), F.md5(F.encode(body, "UTF-8")).alias("_g")), "pack-rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    unit = max(1, -(-total // (shards * BUNDLES)))
    P = shuffle_partitions(spark)
    groups = rows.groupBy("_g").agg(F.sum("size").alias("_bytes"))
    dealt = groups.repartition(P, "_g").sortWithinPartitions(F.desc("_bytes"), "_g").withColumn("_pid", F.spark_partition_id())

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(unit)
        for b in batches:
            number = [bins.add(s) for s in b.column(1).to_pylist()]
            item = b.column(2).to_numpy().astype(np.int64) * (1 << 40) + np.array(number, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(item)], ["_g", "_bytes", "_item"])

    placed = save(dealt.mapInArrow(bundle, "_g string, _bytes long, _item long"), "pack-groups")
    items = sorted((-r[1], r[0]) for r in placed.groupBy("_item").agg(F.sum("_bytes")).collect())
    bins = pack_into([-b for b, _ in items], shards)
    table = spark.createDataFrame([(i, s) for (_, i), s in zip(items, bins)], "_item long, shard int")
    sharded = rows.join(placed.join(F.broadcast(table), "_item").select("_g", "shard"), "_g").drop("_g")

    # slots: the rows by (shard, key) over ranges; counts per range and shard give each range its first slot
    ranged = sharded.repartitionByRange(P, "shard", key, "text_crc32").sortWithinPartitions("shard", key, "text_crc32")
    ranged = ranged.withColumn("_pid", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shards, np.int64)
        for b in batches:
            s = b.column(b.schema.get_field_index("shard")).to_numpy()
            at = np.empty(len(s), np.int64)
            for x in np.unique(s):
                mine = s == x
                at[mine] = seen[x] + np.arange(mine.sum())
                seen[x] += mine.sum()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "_at"])

    numbered = save(ranged.mapInArrow(number, T.StructType([*ranged.schema.fields, T.StructField("_at", T.LongType())])),
                    "pack-slots")
    first, ahead = [], {}
    for pid, s, n in sorted(map(tuple, numbered.groupBy("_pid", "shard").count().collect())):
        first.append((pid, s, ahead.get(s, 0)))
        ahead[s] = ahead.get(s, 0) + n
    start = spark.createDataFrame(first, "_pid int, shard int, _first long")  # partitions x shards rows at most
    return numbered.join(F.broadcast(start), ["_pid", "shard"]).select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.col("_at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
