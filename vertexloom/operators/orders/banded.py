"""Reverse breadth-first ordering by degree, which keeps a matrix near its diagonal.

A component goes level by level, in one worker if it is small, else by a join and a sort for each level over the whole
table; components follow one another by their smallest degree, then id, and the whole is reversed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...storage import written
from ..components import components
from ..graph import Graph
from ..positions import running_sum, with_positions


def breadth_first(ids: np.ndarray, row: np.ndarray, col: np.ndarray) -> list[int]:
    """A component from its vertex of least degree: neighbours by (degree, id). Edges are there in both directions.

    A level at a time: a vertex follows the first of its neighbours, and those that follow the same one are by degree, id.
    """
    order = np.argsort(ids, kind="stable")
    a, b = (order[np.searchsorted(ids[order], x)] for x in (row, col))
    degree = np.bincount(a, minlength=len(ids))
    near = b[np.argsort(a, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(degree)])
    seen = np.zeros(len(ids), bool)
    out: list[np.ndarray] = []
    for start in np.lexsort((ids, degree)):
        if seen[start]:
            continue
        level = np.array([start])
        while len(level):
            seen[level] = True
            out.append(level)
            sizes = degree[level]
            at = np.repeat(starts[level] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            found, parents = near[at], np.repeat(np.arange(len(level)), sizes)
            fresh = ~seen[found]
            found, first = np.unique(found[fresh], return_index=True)
            level = found[np.lexsort((ids[found], degree[found], parents[fresh][first]))]
    return ids[np.concatenate(out)].tolist() if out else []


#: Entries of a component that a worker orders by itself; larger ones go level by level over the whole table.
IN_WORKER = 1 << 23


def banded(g: Graph, in_worker: int = IN_WORKER) -> DataFrame:
    """perm(old_id, new_id)."""
    both = g.edges.where("row <> col").select("row", "col")
    both = written(both.unionByName(both.select(F.col("col").alias("row"), F.col("row").alias("col"))), "banded-edges")
    labels = written(components(g.vertices(), both), "banded-labels")
    degrees = both.groupBy(F.col("row").alias("id")).agg(F.count("*").alias("deg"))
    rows = written(labels.join(degrees, "id", "left").na.fill(0, ["deg"]), "banded-degrees")
    sizes = rows.groupBy("comp").agg(F.count("*").alias("size"), F.sum("deg").alias("entries"), F.min(F.struct("deg", "id")).alias("first"))
    starts = running_sum(with_positions(sizes, "first", name="turn"), "turn", "size", "start").select("comp", "start", "entries", F.col("first.id").alias("first"))
    starts = written(starts, "banded-starts")
    whole, apart = starts.where(F.col("entries") <= in_worker), starts.where(F.col("entries") > in_worker)
    # vertices without edges are rows without a neighbour
    linked = rows.join(whole.select("comp"), "comp", "left_semi").join(both.select(F.col("row").alias("id"), "col"), "id", "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ends = part[part["col"].notna()]
        order = breadth_first(np.sort(part["id"].unique()), ends["id"].to_numpy(), ends["col"].to_numpy(np.int64))
        return pd.DataFrame({"id": np.array(order, np.int32), "comp": part["comp"].iloc[0], "at": np.arange(len(order), dtype=np.int64)})

    placed = linked.groupBy("comp").applyInPandas(run, "id int, comp int, at long")
    if not apart.isEmpty():
        placed = placed.unionByName(by_levels(rows.join(apart.select("comp"), "comp", "left_semi"), both, apart))
    placed = placed.join(starts.select("comp", "start"), "comp")
    return placed.select(F.col("id").alias("old_id"), (F.lit(g.n - 1) - F.col("start") - F.col("at")).cast("int").alias("new_id"))


def by_levels(rows: DataFrame, both: DataFrame, starts: DataFrame) -> DataFrame:
    """id, comp, at: places within components, all of which advance by a level with each join.

    rows: id, comp, deg. A new vertex's parent is its neighbour with the least place in the level before; a level is in
    order of (parent's place, degree, id).
    """
    level = written(starts.select(F.col("first").alias("id"), "comp", F.lit(0).cast("long").alias("place")), "levels")
    seen, depth, parts = level.select("id"), 0, [level.withColumn("depth", F.lit(0))]
    while True:
        reached = both.join(level.select(F.col("id").alias("row"), "place"), "row").groupBy(F.col("col").alias("id")).agg(F.min("place").alias("parent"))
        fresh = reached.join(seen, "id", "left_anti").join(rows, "id")
        level = written(with_positions(fresh, "parent", "deg", "id", name="place").select("id", "comp", "place"), "levels")
        if level.isEmpty():
            break
        depth += 1
        parts.append(level.withColumn("depth", F.lit(depth)))
        # only the level before can be reached again, besides the one before that
        seen = parts[-2].select("id").unionByName(level.select("id"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    numbered = with_positions(every, "comp", "depth", "place", name="turn")
    begin = numbered.groupBy("comp").agg(F.min("turn").alias("begin"))
    return numbered.join(begin, "comp").select("id", "comp", (F.col("turn") - F.col("begin")).alias("at"))


def bandwidth(g: Graph) -> DataFrame:
    """bandwidth, profile of the matrix: the farthest entry from the diagonal, and the sum over rows of the farthest left."""
    reach = g.edges.groupBy("row").agg(F.max(F.greatest(F.col("row") - F.col("col"), F.lit(0))).alias("left"), F.max(F.abs(F.col("row") - F.col("col"))).alias("far"))
    return reach.agg(F.coalesce(F.max("far"), F.lit(0)).alias("bandwidth"), F.coalesce(F.sum("left"), F.lit(0)).alias("profile"))
