"""Synthetic graphs from seeded hashes: the same seed gives the same graph on any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.orders.simple import random_order, relabel

# fixed values: probabilities of the first three quadrants
QUADRANTS = (0.57, 0.19, 0.19)


def uniform(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def rmat(spark: SparkSession, scale: int, degree: int, seed: int = 0, permute: bool = True) -> Graph:
    """2**scale vertices, degree times as many edges; each bit of an edge's ends picks a quadrant. permute: ids are shuffled."""
    a, b, c = QUADRANTS
    row, col = F.lit(0), F.lit(0)
    edges = spark.range(degree << scale)
    for bit in range(scale):
        u = uniform("id", F.lit(bit), F.lit(seed))
        low, right = u >= a + b, ((u >= a) & (u < a + b)) | (u >= a + b + c)
        row, col = row + low.cast("int") * (1 << bit), col + right.cast("int") * (1 << bit)
    g = Graph(edges.select(row.alias("row"), col.alias("col"), F.lit(1.0).alias("val")), 1 << scale, f"rmat_{scale}_{degree}")
    return relabel(g, random_order(g, seed + 1)) if permute else g


def random_graph(spark: SparkSession, n: int, edges: int, seed: int = 0) -> Graph:
    """Independent ends."""
    end = lambda k: F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(n)).cast("int")
    return Graph(spark.range(edges).select(end(0).alias("row"), end(1).alias("col"), F.lit(1.0).alias("val")), n, f"uniform_{n}_{edges}")


def with_weights(g: Graph, seed: int = 0) -> Graph:
    """Whole weights from 1 to 255, by the ends of an edge, so that an edge and its inverse agree."""
    weight = 1 + F.pmod(F.xxhash64(F.least("row", "col"), F.greatest("row", "col"), F.lit(seed)), F.lit(255))
    return g.with_edges(g.edges.withColumn("val", weight.cast("double")))
