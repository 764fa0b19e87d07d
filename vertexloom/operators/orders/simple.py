"""Orderings that follow from a sort, and their application.

An ordering is a table perm(old_id, new_id), a bijection on 0 to n - 1. Ties go to the smaller id throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...storage import written
from ..graph import OUT, Graph, degrees
from ..positions import with_positions


def _perm(placed: DataFrame, name: str = "new_id") -> DataFrame:
    return placed.select(F.col("id").cast("int").alias("old_id"), F.col(name).cast("int").alias("new_id"))


def identity(g: Graph) -> DataFrame:
    return g.vertices().select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"))


def relabel(g: Graph, perm: DataFrame) -> Graph:
    """The graph with both endpoints in new numbers."""
    rows = perm.select(F.col("old_id").alias("row"), F.col("new_id").alias("new_row"))
    cols = perm.select(F.col("old_id").alias("col"), F.col("new_id").alias("new_col"))
    moved = g.edges.join(rows, "row").join(cols, "col")
    return g.with_edges(moved.select(F.col("new_row").alias("row"), F.col("new_col").alias("col"), "val"))


def random_order(g: Graph, seed: int = 0) -> DataFrame:
    """A seeded shuffle."""
    return _perm(with_positions(g.vertices(), F.xxhash64("id", F.lit(seed)), "id", name="new_id"))


def degree_order(g: Graph, side: str = OUT) -> DataFrame:
    """By degree, descending."""
    return _perm(with_positions(degrees(g, side), F.desc("deg"), "id", name="new_id"))


def group_of(degree):
    """The power of two that a degree's group goes up to."""
    return F.ceil(F.log2(degree + 1) - 1e-9).cast("int")


def grouped_order(g: Graph, side: str = OUT) -> DataFrame:
    """By group of degrees, descending, so that ids keep their order within a group."""
    rows = degrees(g, side).withColumn("grp", group_of(F.col("deg")))
    return _perm(with_positions(rows, F.desc("grp"), "id", name="new_id"))


def block_shuffle(g: Graph, share: float, block: int, seed: int) -> DataFrame:
    """A shuffle of the vertices within each of a share of the blocks, which a hash picks."""
    from math import ceil

    from pyspark.sql import Window

    blocks = ceil(g.n / block) if block > 0 else 0
    count = int(share * blocks + 0.5)
    rows = g.vertices().withColumn("block", F.expr(f"id div {max(1, block)}"))
    picked = g.spark.range(blocks).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count).select(F.col("id").alias("block"), F.lit(True).alias("picked"))
    order = Window.partitionBy("block").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id")
    rows = rows.join(picked, "block", "left").withColumn("place", F.row_number().over(order) - 1)
    return rows.select(F.col("id").alias("old_id"), F.when(F.col("picked"), F.col("block") * block + F.col("place")).otherwise(F.col("id")).cast("int").alias("new_id"))


# fixed values: the settings (share, nearest, farthest) that training graphs are perturbed with, and the seed for graph 0
PERTURBATIONS = (
    (0.10, 64, 256),
    (0.10, 256, 1024),
    (0.20, 1024, 4096),
    (0.30, 4096, 16384),
    (0.30, 16384, 65536),
    (0.40, 65536, 262144),
    (0.50, 262144, 1048576),
    (0.70, 1048576, 4194304),
    (0.90, 0, 10000000),
)
PERTURBATION_SEED = 20260224


def local_swaps(n: int, share: float, near: int, far: int, seed: int):
    """old -> new after swapping a share of places, in turn, each with a partner at a distance from near to far.

    The side is drawn by the lengths of the two intervals. Swaps follow one another, so this is a sequence on the driver;
    its array has a number for each vertex.
    """
    if share and (not 0 <= share <= 1 or near < 0 or far < max(1, near)):
        raise ValueError("the share lies between 0 and 1, and distances from 1 on")
    near = max(1, near)
    rng = np.random.default_rng(seed)
    content = np.arange(n)
    count = int(share * n + 0.5)
    for i in rng.permutation(n)[:count].tolist() if count else []:
        left, right = (max(0, i - far), i - near), (i + near, min(n - 1, i + far))
        lengths = [max(0, b - a + 1) for a, b in (left, right)]
        if not sum(lengths):
            continue
        at = int(rng.integers(sum(lengths)))
        j = left[0] + at if at < lengths[0] else right[0] + at - lengths[0]
        content[i], content[j] = content[j], content[i]
    perm = np.empty(n, np.int64)
    perm[content] = np.arange(n)
    return perm


def perturbed(g: Graph, share: float, near: int, far: int, graph_id: int = 0) -> tuple[Graph, DataFrame]:
    """The graph after local swaps, and the ordering that they make."""
    perm = local_swaps(g.n, share, near, far, PERTURBATION_SEED + graph_id)
    rows = pa.table({"old_id": pa.array(np.arange(g.n, dtype=np.int32)), "new_id": pa.array(perm.astype(np.int32))})
    table = written(g.spark.createDataFrame(rows, "old_id int, new_id int"), "perturbed")
    return relabel(g, table), table


