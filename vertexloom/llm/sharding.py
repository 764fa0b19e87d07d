"""Shards of near-equal size: minimax contiguous partition of ordered atomic groups.

Documents with equal texts are one group and stay together; groups are ordered by the hash of their text. The smallest
capacity C is sought such that cutting greedily (a shard takes groups until the next would exceed C) needs no more than
the given number of shards. Checking one C needs the place of a few cuts only, so the groups themselves are never
gathered: the driver holds sums over a bounded number of ranges of the hash. A check with sums gives a lower answer (a
range may be cut anywhere) and an upper one (a range is cut at its ends only), hence an interval for C; only ranges in
which a cut for that interval can lie are split further, 1024-fold each time, until every such range is one group. A
document's shard then follows from its hash and the cuts, without a join; slots are numbered by counts per shard and
block, so no task holds a shard.

Null texts count as empty ones and their size is 1. Ids may be null or repeat; every row gets its own slot. An empty
table gives no rows. The other two laws need no partition: `rows` deals slots round robin and `key` gives each id the
shard of the largest hash over (id, shard), so that one shard more takes rows only into itself.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Bits of the hash that one round resolves, so 1024 sums for each range that is split.
BITS = 10
#: Rows of one shard that a task numbers, about.
BLOCK_ROWS = 50_000


def greedy(sums: list[int], capacity: int, shards: int, ends: list[int] | None = None) -> list[int] | None:
    """Cuts (indexes into the running sums) of the greedy partition, or None if it needs more shards."""
    cuts, at, total = [], 0, sums[-1]
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity, at) - 1
        cuts.append(at)
        if sums[at] == total:
            return cuts
    return None


def smallest(sizes: list[int], shards: int) -> int:
    """The smallest feasible capacity for the sizes as atoms."""
    sums = [0, *accumulate(sizes)]
    low, high = max([*sizes, -(-sums[-1] // shards)]), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(sums, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def spans(sizes: list[int], single: list[bool], shards: int) -> set[int]:
    """The ranges in which a cut can lie for a capacity that may be the smallest one.

    sizes: of the ranges in order. single: whether the range is one group, which can't be cut.
    """
    sums = [0, *accumulate(sizes)]
    total = sums[-1]

    def loose(capacity: int) -> list[int] | None:
        """The farthest that each cut can lie if ranges can be cut anywhere; None if even so the capacity is too small."""
        at, out = 0, []
        for _ in range(shards):
            at = min(at + capacity, total)
            k = bisect_right(sums, at) - 1
            if k < len(sizes) and single[k]:
                at = sums[k]
            out.append(at)
            if at == total:
                return out
        return None

    high = smallest(sizes, shards)
    low = max([-(-total // shards), *(s for s, one in zip(sizes, single, strict=True) if one)], default=0)
    top = high
    while low < top:
        middle = (low + top) // 2
        if loose(middle) is None:
            low = middle + 1
        else:
            top = middle
    # a cut for any capacity from low to high lies between the cuts with whole ranges at low and anywhere at high
    least, at = [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + low, at) - 1
        least.append(sums[at])
    most = loose(high) or []
    open_ranges = set()
    for k in range(shards):
        a, b = least[k], most[k] if k < len(most) else total
        first, last = bisect_right(sums, a) - 1, bisect_right(sums, b) - 1
        open_ranges.update(i for i in range(first, min(last + 1, len(sizes))) if not single[i])
    return open_ranges


def minimax_cuts(hashed: DataFrame, shards: int, key: str = "key", size: str = "size") -> tuple[int, list[int]]:
    """The smallest capacity and the first key of shards 1, 2, ...; hashed: rows with a long key and a size."""
    shift = 64 - BITS
    first = F.shiftright(key, shift)
    rows = hashed.groupBy(first.alias("part")).agg(F.sum(size).alias("size"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("part").collect()
    ranges = [(r["low"], r["high"], int(r["size"])) for r in rows]
    if not ranges:
        return 0, []
    while True:
        single = [a == b for a, b, _ in ranges]
        sizes = [s for *_, s in ranges]
        # while some ranges are large the interval is wide, so these come first; there are few of them
        wide = {i for i, s in enumerate(sizes) if not single[i] and s > sum(sizes) // (64 * shards)}
        wide = wide or spans(sizes, single, shards)
        if not wide:
            break
        shift = max(0, shift - BITS)
        inside = F.lit(False)
        for a, b in stretches(sorted(wide)):
            inside = inside | F.col(key).between(ranges[a][0], ranges[b][1])
        finer = hashed.where(inside).groupBy(F.shiftright(key, shift).alias("part")).agg(F.sum(size).alias("size"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        ranges = sorted([r for i, r in enumerate(ranges) if i not in wide] + [(r["low"], r["high"], int(r["size"])) for r in finer])
    sizes = [s for *_, s in ranges]
    capacity = smallest(sizes, shards)
    cuts = greedy([0, *accumulate(sizes)], capacity, shards) or []
    return capacity, [ranges[c][0] for c in cuts if c < len(ranges)]


def stretches(indexes: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for i in indexes:
        out = [*out[:-1], (out[-1][0], i)] if out and out[-1][1] == i - 1 else [*out, (i, i)]
    return out


def numbered(rows: DataFrame, group: str, keys: list[str], total: int, slot: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 in each group: rows are numbered in blocks, dealt by a hash, after the blocks before."""
    blocks = max(16, -(-total // BLOCK_ROWS))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    counts = rows.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy(group, "_block").orderBy(*keys)
    rows = rows.withColumn("_k", F.row_number().over(order) - 1).join(counts, [group, "_block"])
    return rows.withColumn(slot, (F.col("_start") + F.col("_k")).cast("long")).drop("_block", "_k", "_start")


def shard(docs: DataFrame, shards: int = 8, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"))
    rows = written(rows, "shard-rows")
    total = rows.count()
    grown = F.lit(None).cast("int")
    if law == "bytes":
        _, cuts = minimax_cuts(rows, shards)
        where = sum([(F.col("key") >= c).cast("int") for c in cuts], F.lit(0))
        rows = numbered(rows.withColumn("shard", where), "shard", ["id", "crc", "key"], total)
    elif law == "rows":
        rows = numbered(rows.withColumn("all", F.lit(0)), "all", ["id", "crc", "key"], total, "k").drop("all")
        rows = rows.withColumns({"shard": (F.col("k") % shards).cast("int"), "slot": F.floor(F.col("k") / shards)})
    elif law == "key":
        best = lambda n: F.array_max(F.array(*[F.struct(F.xxhash64(F.col("id"), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(n)]))["s"]
        rows = numbered(rows.withColumns({"shard": best(shards), "grown": best(shards + 1)}), "shard", ["id", "crc", "key"], total)
        grown = F.col("grown")
    else:
        raise ValueError(f"no law {law!r}")
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), "slot", grown.alias("grown_shard"))


def op4_shards(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 8, "bytes")
