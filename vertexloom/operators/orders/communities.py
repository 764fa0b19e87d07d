"""Community ordering: vertices merge by modularity into trees, and a walk over the trees numbers them.

`merged` is sequential within a component (vertices by degree, each into the neighbour with the largest gain), so a component is a
task. `merged_in_rounds` is for components that don't fit: in a round each community picks its best neighbour, merges go from the
lighter to the heavier only, and edges between communities are summed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...storage import written
from ..components import components
from ..graph import Graph, undirected_weights
from ..positions import running_sum, with_positions


def merge_trees(n: int, row: np.ndarray, col: np.ndarray, weight: np.ndarray, total: float) -> tuple[dict[int, list[int]], list[int]]:
    """Children of each vertex that has any, and the roots, in order of merging, of vertices 0 to n - 1. Edges are there in
    both directions, by row.

    A vertex's neighbours are put together only when its turn comes: its own edges and what its children had then, each end
    replaced by the community that holds it now. So there is one array of edges, and a list for each vertex that merged but whose
    community hasn't had its turn.
    """
    starts = np.searchsorted(row, np.arange(n + 1))
    strength = np.bincount(row, weight, n)
    # by the number of different neighbours
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1])
    turns = np.lexsort((np.arange(n), np.bincount(row[fresh], minlength=n)))
    del fresh
    holder, to_come = np.arange(n), np.ones(n, bool)
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    children: dict[int, list[int]] = {}
    roots = []
    for v in turns.tolist():
        to_come[v] = False
        parts = [(col[starts[v] : starts[v + 1]], weight[starts[v] : starts[v + 1]]), *waiting.pop(v, [])]
        ends, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = holder[ends]
        while True:
            up = holder[at]
            if (up == at).all():
                break
            holder[at] = at = holder[up]
        holder[ends] = at
        apart = at != v
        at, weights = at[apart], weights[apart]
        if len(at):
            order = at.argsort(kind="stable")
            at, weights = at[order], weights[order]
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            at, weights = at[begins], np.add.reduceat(weights, begins)
            gains = weights - strength[v] * strength[at] / total
            k = int(gains.argmax())  # the first of equals, which is the smallest
        if not len(at) or gains[k] <= 0:
            roots.append(v)
            continue
        best = int(at[k])
        children.setdefault(best, []).append(v)
        strength[best] += strength[v]
        holder[v] = best
        if to_come[best]:
            others = at != best
            waiting.setdefault(best, []).append((at[others].astype(col.dtype), weights[others]))
    return children, roots


def walk(children: dict[int, list[int]], roots: list[int]) -> list[tuple[int, int]]:
    """(vertex, root) in depth-first order, last merged first."""
    out = []
    for root in roots:
        stack = [root]
        while stack:
            v = stack.pop()
            out.append((v, root))
            stack.extend(children.get(v, ()))
    return out


def merged(g: Graph, inverted: bool = False) -> DataFrame:
    """perm(old_id, new_id). inverted: the inverse is given, as older results have it."""
    weights = written(undirected_weights(g), "community-weights")
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(1.0)).alias("w")).first()["w"]
    labels = components(g.vertices(), weights)
    ends = labels.join(weights.withColumnRenamed("row", "id"), "id").select("comp", "id", "col", "weight")
    # a row for each vertex, without an edge, and one for each edge
    rows = labels.select("comp", "id", F.lit(-1).alias("col"), F.lit(0.0).alias("weight")).unionByName(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        comp = parts[0][0][0]
        row, col, weight = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        parts.clear()
        alone = col < 0
        ids = np.sort(row[alone])
        row, col, weight = row[~alone], col[~alone], weight[~alone]
        order = np.lexsort((col, row))
        row, col, weight = np.searchsorted(ids, row[order]), np.searchsorted(ids, col[order]).astype(np.int32), weight[order]
        del order, alone
        found = np.array(walk(*merge_trees(len(ids), row, col, weight, total)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]]), pa.array(np.full(len(ids), comp, np.int32)), pa.array(np.arange(len(ids)))], names=["id", "root", "comp", "at"])

    local = rows.groupBy("comp").applyInArrow(run, "id int, root int, comp int, at long")
    return _numbered(local, inverted)


def _numbered(local: DataFrame, inverted: bool) -> DataFrame:
    """perm from id, comp, at: components by id, one after the other."""
    local = written(local, "community-local")
    sizes = local.groupBy("comp").agg(F.count("*").alias("size"))
    starts = running_sum(with_positions(sizes, "comp", name="turn"), "turn", "size", "start").select("comp", "start")
    placed = local.join(starts, "comp").select(F.col("id").cast("int").alias("old_id"), (F.col("start") + F.col("at")).cast("int").alias("new_id"))
    return placed.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id")) if inverted else placed


def communities_in_rounds(g: Graph, rounds: int = 20) -> DataFrame:
    """id, com: the community of each vertex, named by one of its vertices."""
    weights = written(undirected_weights(g), "community-weights")
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(1.0)).alias("w")).first()["w"]
    strength = weights.groupBy("row").agg(F.sum("weight").alias("s"))
    coms = g.vertices().select("id", F.col("id").alias("com"))
    strength = written(g.vertices().join(strength.withColumnRenamed("row", "id"), "id", "left").select(F.col("id").alias("com"), F.coalesce("s", F.lit(0.0)).alias("s")), "community-strength")
    for _ in range(rounds):
        mine, theirs = strength.select(F.col("com").alias("row"), F.col("s").alias("sr")), strength.select(F.col("com").alias("col"), F.col("s").alias("sc"))
        gains = weights.join(mine, "row").join(theirs, "col").withColumn("gain", F.col("weight") - F.col("sr") * F.col("sc") / F.lit(float(total)))
        best = gains.where("gain > 0").groupBy("row").agg(F.max(F.struct("gain", (-F.col("col")).alias("minus"), "sr", "sc")).alias("b")).select("row", (-F.col("b.minus")).alias("to"), "b.sr", "b.sc")
        # from the lighter to the heavier, so that merges make no circle; of the pair with the largest gain one merges
        best = best.where((F.col("sr") < F.col("sc")) | ((F.col("sr") == F.col("sc")) & (F.col("row") < F.col("to")))).select("row", "to")
        best = written(best, "community-merges")
        if best.isEmpty():
            break
        # only into communities that don't merge themselves, the rest waits for the next round
        free = best.join(best.select(F.col("row").alias("to")), "to", "left_anti")
        coms = written(coms.join(free.withColumnRenamed("row", "com"), "com", "left").select("id", F.coalesce("to", "com").alias("com")), "community-labels")
        step = free.select(F.col("row").alias("com"), "to")
        strength = written(strength.join(step, "com", "left").groupBy(F.coalesce("to", "com").alias("com")).agg(F.sum("s").alias("s")), "community-strength")
        left, right = step.select(F.col("com").alias("row"), F.col("to").alias("a")), step.select(F.col("com").alias("col"), F.col("to").alias("b"))
        weights = weights.join(left, "row", "left").join(right, "col", "left").select(F.coalesce("a", "row").alias("row"), F.coalesce("b", "col").alias("col"), "weight")
        weights = written(weights.where("row <> col").groupBy("row", "col").agg(F.sum("weight").alias("weight")), "community-weights")
    return coms


def merged_in_rounds(g: Graph, rounds: int = 20) -> DataFrame:
    """perm(old_id, new_id): communities by name, ids in order within."""
    coms = communities_in_rounds(g, rounds)
    return with_positions(coms, "com", "id", name="place").select(F.col("id").alias("old_id"), F.col("place").cast("int").alias("new_id"))


def modularity(g: Graph, coms: DataFrame) -> DataFrame:
    """modularity of a labelling id, com."""
    weights = undirected_weights(g)
    total = F.sum("weight").over(Window.partitionBy())
    a, b = coms.select(F.col("id").alias("row"), F.col("com").alias("a")), coms.select(F.col("id").alias("col"), F.col("com").alias("b"))
    both = weights.join(a, "row").join(b, "col")
    inside = both.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("weight"))
    return inside.withColumn("total", total).agg(F.sum(F.col("inside") / F.col("total") - (F.col("weight") / F.col("total")) ** 2).alias("modularity"))
