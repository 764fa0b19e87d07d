"""Weakly connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, comp (the smallest id of the component); vertices: id; edges: row, col in any direction.

    Each vertex points to its smallest neighbour or itself, pointers are doubled until all point to the end of their chain,
    edges are relabelled by them, and edges within one label go, until none is left; labels never grow, and the smallest id of a
    component points to itself. A chain takes as many doublings as its length has binary digits. A vertex that is left while a
    neighbour of its went elsewhere is next to a smaller one then, so two rounds leave at most half of the vertices.
    """
    labels = written(vertices.select("id", F.col("id").alias("comp")), "components")
    edges = written(edges.where("row <> col").select("row", "col").distinct(), "component-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("col").alias("row"), F.col("row").alias("col")))
        up = both.groupBy("row").agg(F.min("col").alias("least")).select("row", F.least("row", "least").alias("to"))
        up = written(up, "component-pointers")
        while True:
            on = up.join(up.select(F.col("row").alias("to"), F.col("to").alias("on")), "to").select("row", F.col("on").alias("to"), (F.col("to") != F.col("on")).alias("moved"))
            up = written(on, "component-pointers", up)
            if up.where("moved").isEmpty():
                break
        left, right = up.select("row", F.col("to").alias("a")), up.select(F.col("row").alias("col"), F.col("to").alias("b"))
        rest = edges.join(left, "row").join(right, "col").where("a <> b").select(F.least("a", "b").alias("row"), F.greatest("a", "b").alias("col")).distinct()
        edges = written(rest, "component-edges", edges)
        named = labels.join(up.select(F.col("row").alias("comp"), "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        labels = written(named, "components", labels, up)
    return labels


def sizes(labels: DataFrame) -> DataFrame:
    """comp, size."""
    return labels.groupBy("comp").agg(F.count("*").alias("size"))


def largest(labels: DataFrame) -> DataFrame:
    """comp, size of the largest component, ties to the smaller id."""
    return sizes(labels).orderBy(F.desc("size"), "comp").limit(1)
