"""Reuse distances of the access stream of a sparse multiplication, exact and sampled.

The stream is the row of each edge in the order (col, row), cut to sectors. A reuse's distance is the number of different
sectors between it and the access before to its sector.

With prev(j) the place of the access before, the distance of a reuse k after p is the number of j < k with prev(j) < p, less
p + 1 (first touches have prev = -1). That is a count of points below and left of each point. Places are cut into blocks:

* points of the same block of places are counted within it;
* points of earlier blocks whose prev lies in the same block as p are counted within that block of prev, which holds no more
  points than places, since each place is the prev of at most one other;
* all others are sums over a grid of blocks, by two running sums.

So no task holds more than a block, whatever the graph and however hot a sector is. Blocks grow with the root of the number
of places, so that the grid stays small beside them.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import estimate, registers
from ..functions.scalars import EDGES, SECTOR, bin_of
from ..storage import written
from .graph import Graph
from .positions import with_positions, with_previous


def access_stream(g: Graph, sector: int = SECTOR) -> DataFrame:
    """k, sector: the accesses in order."""
    if sector <= 0:
        raise ValueError("sectors need at least one row")
    placed = with_positions(g.edges.select("col", "row"), "col", "row")
    return placed.select("k", F.expr(f"row div {sector}").cast("int").alias("sector"))


def reuse_gaps(stream: DataFrame, block: int = 1 << 16) -> DataFrame:
    """k, sector, prev: each access with the place of the one before to its sector, null for first touches."""
    return with_previous(stream, "sector", "k", block)


def counted_below(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each point how many points before it (in `order`) have a smaller value: merge by doubling, in numpy."""
    n = len(values)
    at = np.argsort(order, kind="stable")
    rank = np.empty(n, np.int64)
    rank[np.argsort(values[at], kind="stable")] = np.arange(n)
    # equal values count as not smaller: they get the first of their ranks
    ordered = np.sort(values)
    below = np.searchsorted(ordered, values[at], "left")
    out = np.zeros(n, np.int64)
    width = 1
    while width < n:
        # within each pair of stretches, points of the right one count points of the left one
        pair = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        keys = np.where(left, rank, below) * 2 + np.where(left, 1, 0)
        turn = np.lexsort((keys, pair))
        gone = np.cumsum(left[turn])
        starts = np.concatenate([[0], gone])[np.searchsorted(pair[turn], pair[turn], "left")]
        right = ~left[turn]
        out[turn[right]] += gone[right] - starts[right]
        width *= 2
    result = np.empty(n, np.int64)
    result[at] = out
    return result


def block_for(places: int) -> int:
    """Places in a block: a power of two, at least twice the root of all, so that the grid has an eighth of the places' cells
    at most."""
    return max(1 << 16, 1 << (2 * isqrt(max(1, places)) - 1).bit_length())


def reuse_distances(stream: DataFrame, block: int | None = None) -> DataFrame:
    """k, sector, prev, rd of each reuse."""
    block = block or block_for(stream.count())
    points = reuse_gaps(stream, block).select("k", "sector", F.coalesce("prev", F.lit(-1)).cast("long").alias("prev"))
    points = points.withColumns({"kb": F.expr(f"k div {block}"), "pb": F.when(F.col("prev") >= 0, F.expr(f"prev div {block}"))})
    points = written(points, "reuse-points")

    def in_place_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(own=counted_below(rows["k"].to_numpy(), rows["prev"].to_numpy()))
        return rows[rows["prev"] >= 0][["k", "sector", "prev", "kb", "pb", "own"]]

    own = points.groupBy("kb").applyInPandas(in_place_block, "k long, sector int, prev long, kb long, pb long, own long")

    def in_prev_block(rows: pd.DataFrame) -> pd.DataFrame:
        k, prev, kb = (rows[c].to_numpy() for c in ("k", "prev", "kb"))
        every = counted_below(k, prev)
        # less those of the same block of places, which are counted there
        same = np.zeros(len(rows), np.int64)
        order = np.argsort(kb, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(kb[order])) + 1):
            same[part] = counted_below(k[part], prev[part])
        return rows.assign(beside=every - same)[["k", "sector", "prev", "kb", "pb", "own", "beside"]]

    both = own.groupBy("pb").applyInPandas(in_prev_block, "k long, sector int, prev long, kb long, pb long, own long, beside long")
    # the grid: points by block of places and block of prev, first touches left of all
    cells = points.groupBy("kb", F.coalesce("pb", F.lit(-1)).alias("pb")).agg(F.count("*").alias("cnt"))
    blocks = cells.agg(F.max("kb")).first()[0]
    if blocks is None or blocks == 0:
        grid = None
    else:
        full = points.sparkSession.range(blocks + 1).select(F.col("id").alias("kb")).select("kb", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("kb"))).alias("pb"))
        full = full.join(cells, ["kb", "pb"], "left").na.fill(0, ["cnt"])
        left = Window.partitionBy("kb").orderBy("pb").rowsBetween(Window.unboundedPreceding, -1)
        above = Window.partitionBy("pb").orderBy("kb").rowsBetween(Window.unboundedPreceding, -1)
        full = full.withColumn("row_sum", F.coalesce(F.sum("cnt").over(left), F.lit(0)))
        # a block of places before pb has all its points left of pb, and no cell there: its whole size counts
        totals = cells.groupBy("kb").agg(F.sum("cnt").alias("size"))
        upto = Window.orderBy("kb").rowsBetween(Window.unboundedPreceding, -1)
        sizes = totals.select(F.col("kb").alias("pb"), F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("earlier"))
        grid = full.withColumn("grid", F.coalesce(F.sum("row_sum").over(above), F.lit(0))).select("kb", "pb", "grid").join(sizes, "pb").select("kb", "pb", (F.col("grid") + F.col("earlier")).alias("grid"))
    if grid is None:
        both = both.withColumn("grid", F.lit(0))
    else:
        both = both.join(grid, ["kb", "pb"])
    return both.select("k", "sector", "prev", (F.col("own") + F.col("beside") + F.col("grid") - F.col("prev") - 1).alias("rd"))


def histogram(distances: DataFrame, edges=EDGES) -> DataFrame:
    """bin (1 to the number of edges and one), cnt, prob; all bins, with prob 0 where there is no reuse."""
    if not len(edges):
        raise ValueError("bin edges are needed")
    counted = distances.groupBy(bin_of(F.col("rd"), edges).alias("bin")).agg(F.count("*").alias("cnt"))
    bins = distances.sparkSession.range(1, len(edges) + 2).select(F.col("id").cast("int").alias("bin"))
    every = Window.partitionBy()  # a row for each bin
    rows = bins.join(counted, "bin", "left").na.fill(0, ["cnt"])
    total = F.sum("cnt").over(every)
    return rows.select("bin", "cnt", F.when(total > 0, F.col("cnt") / total).otherwise(0.0).alias("prob"))


def wide(hist: DataFrame, bins: int = 10, prefix: str = "r") -> DataFrame:
    """One row r1, r2, ... from bin, prob."""
    return hist.agg(*[F.coalesce(F.max(F.when(F.col("bin") == i, F.col("prob"))), F.lit(0.0)).alias(f"{prefix}{i}") for i in range(1, bins + 1)])


def exact_histogram(g: Graph, sector: int = SECTOR, edges=EDGES, block: int | None = None) -> DataFrame:
    return histogram(reuse_distances(access_stream(g, sector), block), edges)


# fixed values: samples, precision, limits, and what seeds are made of
SAMPLES, PRECISION, SEED, SEED_GRAPH, SEED_STREAM, SPREAD = 30960, 12, 246813579, 1009, 9176, 0x9E3779B9
FOUND, COLD, BEYOND, UNRESOLVED = 0, 1, 2, 3


def sample_places(spark, nnz: int, samples: int, seed: int) -> DataFrame:
    """sid, k: places from 1 to nnz - 1, with replacement, from the mixer."""
    from ..functions.hashing import mix32

    salt = F.pmod(F.col("id") * F.lit(SPREAD & 0xFFFF) + F.shiftleft(F.pmod(F.col("id") * F.lit(SPREAD >> 16), F.lit(1 << 16)), 16) + 17, F.lit(1 << 32))
    h = mix32(F.lit(seed & 0xFFFFFFFF).cast("long").bitwiseXOR(salt))
    return spark.range(samples).select(F.col("id").alias("sid"), (1 + F.pmod(h, F.lit(nnz - 1))).alias("k"))


def sampled_distances(g: Graph, graph_id: int = 0, stream_type: int = 0, sector: int = SECTOR, samples: int = SAMPLES, precision: int = PRECISION, cap: int = EDGES[-1], max_scan: int | None = None, block: int = 1 << 14) -> DataFrame:
    """sid, k, status, rd: for each sampled access the estimated number of sectors since the access before.

    HyperLogLog registers of an interval are the largest of those of the blocks within it, kept for each block, and those of
    the two stretches at its ends, made where these blocks' accesses are.
    """
    precision = min(14, max(4, precision))
    nnz = g.nnz()
    if sector <= 0:
        raise ValueError("sectors need at least one row")
    if cap <= 0:
        raise ValueError("the cap is the last bin's edge or more, so above 0")
    if samples <= 0 or nnz <= 1:
        return g.spark.createDataFrame([], "sid long, k long, status int, rd double")
    seed = (SEED + SEED_GRAPH * graph_id + SEED_STREAM * stream_type) & 0xFFFFFFFF
    points = written(reuse_gaps(access_stream(g, sector)).withColumn("block", F.expr(f"k div {block}")), "sampled-stream")
    asked = sample_places(g.spark, nnz, samples, seed).join(points.select("k", "prev"), "k")
    status = F.when(F.col("prev").isNull(), COLD)
    if max_scan is not None:
        status = F.when(F.least(F.col("k") - 1 - F.coalesce("prev", F.lit(-1)), F.col("k")) > max_scan, UNRESOLVED).otherwise(status)
    asked = written(asked.withColumn("status", F.coalesce(status, F.lit(FOUND))), "sampled-asked")
    near = asked.where(F.col("status") == FOUND).select("sid", "k", "prev", F.expr(f"k div {block}").alias("kb"), F.expr(f"prev div {block}").alias("pb"))
    # stretches within one block: from after prev to before k, or to either end of the block
    ends = near.select("sid", F.explode(F.when(F.col("kb") == F.col("pb"), F.array(F.struct(F.col("kb").alias("block"), (F.col("prev") + 1).alias("low"), (F.col("k") - 1).alias("high")))).otherwise(F.array(F.struct(F.col("pb").alias("block"), (F.col("prev") + 1).alias("low"), ((F.col("pb") + 1) * block - 1).alias("high")), F.struct(F.col("kb").alias("block"), (F.col("kb") * block).alias("low"), (F.col("k") - 1).alias("high"))))).alias("e")).select("sid", "e.*")

    def stretches(key, asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        places, sectors = rows["k"].to_numpy(), rows["sector"].to_numpy()
        low, high = np.searchsorted(places, asks["low"].to_numpy(), "left"), np.searchsorted(places, asks["high"].to_numpy(), "right")
        return pd.DataFrame({"sid": asks["sid"], "regs": [registers(sectors[a:b], precision).tobytes() for a, b in zip(low, high, strict=True)]})

    parts = ends.groupBy("block").cogroup(points.select("block", "k", "sector").groupBy("block")).applyInPandas(stretches, "sid long, regs binary")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "regs": [registers(rows["sector"].to_numpy(), precision).tobytes()]})

    blocks = points.groupBy("block").applyInPandas(whole, "block long, regs binary")
    # whole blocks between the ends, by powers of two: a table of doubling spans answers each interval with two of them
    spans = written(doubled(blocks, precision, block, nnz), "sampled-spans")
    inner = near.where("kb - pb > 1").select("sid", (F.col("pb") + 1).alias("low"), (F.col("kb") - 1).alias("high"))
    inner = inner.withColumn("level", F.floor(F.log2(F.col("high") - F.col("low") + 1) + 1e-12).cast("int"))
    two = inner.select("sid", "level", F.explode(F.array(F.col("low"), F.col("high") - F.expr("cast(shiftleft(1L, level) as bigint)") + 1)).alias("block"))
    parts = parts.unionByName(two.join(spans, ["level", "block"]).select("sid", "regs"))

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        sids, starts = np.unique(rows["sid"].to_numpy(), return_index=True)
        found = np.frombuffer(b"".join(rows["regs"]), np.uint8).reshape(len(rows), -1)
        return pd.DataFrame({"sid": sids, "rd": estimate(np.maximum.reduceat(found, starts, axis=0))})

    # a task gets the registers of some hundred samples at a time
    dealt = parts.withColumn("deal", F.pmod("sid", F.lit(max(1, samples // 400))))
    measured = dealt.groupBy("deal").applyInPandas(merged, "sid long, rd double")
    out = asked.join(measured, "sid", "left")
    status = F.when((F.col("status") == FOUND) & (F.col("rd") > cap * 1.03), BEYOND).otherwise(F.col("status"))
    return out.select("sid", "k", status.cast("int").alias("status"), "rd")


def doubled(blocks: DataFrame, precision: int, block: int, nnz: int) -> DataFrame:
    """level, block, regs: registers of 2**level blocks from each block on."""
    last = (nnz - 1) // block
    out = current = blocks.select(F.lit(0).alias("level"), "block", "regs")
    level = 0

    @F.pandas_udf("binary")
    def largest(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.maximum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b, strict=True)])

    while (2 << level) <= last + 1:
        shifted = current.select((F.col("block") - (1 << level)).alias("block"), F.col("regs").alias("more"))
        current = current.join(shifted, "block").select(F.lit(level + 1).alias("level"), "block", largest("regs", "more").alias("regs"))
        current = written(current, "sampled-level")
        out = out.unionByName(current)
        level += 1
    return out


def sampled_histogram(distances: DataFrame, edges=EDGES) -> DataFrame:
    """bin, cnt, prob over the samples with an access before; those beyond the cap are in the last bin."""
    if not len(edges) or list(edges) != sorted(edges):
        raise ValueError("bin edges in order are needed")
    used = distances.where(F.col("status").isin(FOUND, BEYOND))
    return histogram(used.withColumn("rd", F.when(F.col("status") == BEYOND, F.lit(float(edges[-1]))).otherwise(F.col("rd"))), edges)


def status_counts(distances: DataFrame) -> DataFrame:
    """found, cold, beyond, unresolved."""
    return distances.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in ((FOUND, "found"), (COLD, "cold"), (BEYOND, "beyond"), (UNRESOLVED, "unresolved"))])


# fixed values: limits of the three classes, in sectors
TILE_LIMIT, FAR_LIMIT = 448, 1179648


def three_bins(stream: DataFrame, probability: float = 1.0, seed: int = 1, limits=(TILE_LIMIT, FAR_LIMIT), block: int | None = None) -> DataFrame:
    """class, cnt, prob, sampled_cnt, total_reuse_cnt: reuses, each taken with a probability, as tile, mid or far."""
    found = reuse_distances(stream, block)
    taken = F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(probability * (1 << 30)))
    kind = F.when(F.col("rd") <= limits[0], "tile").when(F.col("rd") <= limits[1], "mid").otherwise("far")
    totals = found.agg(F.count("*").alias("total_reuse_cnt"), F.count_if(taken).alias("sampled_cnt"))
    names = found.sparkSession.createDataFrame([("tile",), ("mid",), ("far",)], "class string")
    counted = names.join(found.where(taken).groupBy(kind.alias("class")).agg(F.count("*").alias("cnt")), "class", "left").na.fill(0)
    counted = counted.join(F.broadcast(totals))  # one row
    return counted.withColumn("prob", F.when(F.col("sampled_cnt") > 0, F.col("cnt") / F.col("sampled_cnt")).otherwise(0.0))
