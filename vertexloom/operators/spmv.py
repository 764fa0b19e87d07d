"""Sparse matrix times vector, as join and aggregation, and its verification.

The multiplication is with the transpose: y[c] is the sum of val * x[r] over the edges r -> c.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph


def ones(g: Graph) -> DataFrame:
    return g.vertices("idx").withColumn("val", F.lit(1.0))


def multiply(g: Graph, x: DataFrame | None = None) -> DataFrame:
    """idx, val for every vertex; x: idx, val, or all ones.

    Without x there is nothing to join: partial sums are made before the shuffle, so a hub costs a row for each task.
    """
    if x is None:
        products = g.edges.select(F.col("col").alias("idx"), F.col("val").alias("product"))
    else:
        products = g.edges.join(x.select(F.col("idx").alias("row"), F.col("val").alias("x")), "row").select(F.col("col").alias("idx"), (F.col("val") * F.col("x")).alias("product"))
    sums = products.groupBy("idx").agg(F.sum("product").alias("val"))
    return g.vertices("idx").join(sums, "idx", "left").na.fill(0.0, ["val"])


def power(g: Graph, x: DataFrame | None, times: int) -> DataFrame:
    """The multiplication applied again and again."""
    from ..storage import written

    y = ones(g) if x is None else x
    for _ in range(times):
        y = written(multiply(g, y), "spmv")
    return y


def timed(g: Graph, x: DataFrame | None = None, trials: int = 5, check=None) -> dict:
    """Mean seconds of a multiplication over some trials; check: a function of the vector that fails if it is wrong."""
    from time import perf_counter

    took = []
    for _ in range(trials):
        began = perf_counter()
        y = multiply(g, x)
        y.write.format("noop").mode("overwrite").save()
        took.append(perf_counter() - began)
        if check is not None:
            check(y)
    return {"trials": trials, "mean_s": sum(took) / max(1, trials), "best_s": min(took, default=0.0)}


def unpermuted(y: DataFrame, perm: DataFrame) -> DataFrame:
    """The vector in old numbers: z[i] = y[perm[i]]."""
    return y.withColumnRenamed("idx", "new_id").join(perm, "new_id").select(F.col("old_id").alias("idx"), "val")


def mismatches(x: DataFrame, y: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """idx, expected, found of the elements that differ by more than the tolerance, relative to x; missing ones are 0."""
    both = x.select("idx", F.col("val").alias("expected")).join(y.select("idx", F.col("val").alias("found")), "idx", "full").na.fill(0.0)
    return both.where(F.abs(F.col("expected") - F.col("found")) > tolerance * F.abs("expected"))


def difference(x: DataFrame, y: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """mismatched, total_difference: how many elements differ, and by how much in sum."""
    return mismatches(x, y, tolerance).agg(F.count("*").alias("mismatched"), F.coalesce(F.sum(F.abs(F.col("expected") - F.col("found"))), F.lit(0.0)).alias("total_difference"))
