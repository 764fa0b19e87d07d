"""Hub-and-spoke ordering: remove the highest degrees, put what falls off at the back, go on with the largest component.

Each round is a top-k, an aggregation of lost edges, and connected components; the driver holds counts only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...storage import written
from ..components import components
from ..graph import Graph, symmetrised, without_loops_and_repeats
from ..positions import running_sum, with_positions


@dataclass
class Ends:
    """The next free places at the front and behind the last free one."""

    front: int
    back: int


def hubs_of(degree: DataFrame, k: int) -> DataFrame:
    """id, place in order of (degree descending, id): the k first."""
    best = degree.orderBy(F.desc("deg"), "id").limit(k)
    return best.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("deg"), "id")) - 1)  # k rows


def lost_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """id, lost: how many neighbours of each vertex go."""
    return edges.join(gone.select(F.col("id").alias("col")), "col").groupBy(F.col("row").alias("id")).agg(F.count("*").alias("lost"))


def burned(g: Graph, share: float = 0.005, rounds: int | None = None) -> DataFrame:
    """perm(old_id, new_id). share: of all vertices, at least one, that are removed as hubs in a round."""
    k = max(1, int(g.n * share))
    edges = written(symmetrised(without_loops_and_repeats(g), only_missing=True).edges.select("row", "col"), "burning-edges")
    counted = edges.groupBy(F.col("row").alias("id")).agg(F.count("*").alias("deg"))
    active = written(g.vertices().join(counted, "id", "left").na.fill(0, ["deg"]), "burning-active")
    ends, parts, turn = Ends(0, g.n), [], 0
    while ends.front < ends.back and (rounds is None or turn < rounds):
        turn += 1
        top = active.agg(F.max("deg").alias("d")).first()["d"]
        if not top:
            break
        hubs = written(hubs_of(active, k), "burning-hubs")
        taken = hubs.count()
        parts.append(hubs.select("id", (F.col("turn") + ends.front).alias("place")))
        ends.front += taken
        left = active.join(hubs.select("id"), "id", "left_anti").join(lost_edges(edges, hubs), "id", "left")
        left = written(left.select("id", "deg", F.greatest(F.col("deg") - F.coalesce("lost", F.lit(0)), F.lit(0)).alias("now")), "burning-left")
        single = written(with_positions(left.where("now = 0"), "id", name="turn").select("id", "turn"), "burning-single")
        ends.back -= (alone := single.count())
        parts.append(single.select("id", (F.col("turn") + ends.back).alias("place")))
        active = written(left.where("now > 0").select("id", F.col("now").alias("deg")), "burning-active")
        if alone + taken and ends.front >= ends.back:
            break
        keep = active.select("id")
        edges = written(edges.join(keep.withColumnRenamed("id", "row"), "row", "left_semi").join(keep.withColumnRenamed("id", "col"), "col", "left_semi"), "burning-edges")
        labels = components(keep, edges)
        sizes = written(labels.groupBy("comp").agg(F.count("*").alias("size")), "burning-sizes")
        giant = sizes.orderBy(F.desc("size"), "comp").first()
        last = giant["size"] <= k
        spokes = sizes if last else sizes.where(F.col("comp") != giant["comp"])
        if spokes.isEmpty():
            continue
        starts = running_sum(with_positions(spokes, F.desc("size"), "comp", name="turn"), "turn", "size", "start").select("comp", "start", "size")
        within = F.row_number().over(Window.partitionBy("comp").orderBy("id")) - 1
        total = spokes.agg(F.sum("size")).first()[0]
        ends.back -= total
        moved = written(labels.withColumn("at", within).join(starts, "comp").select("id", (F.col("start") + F.col("at") + ends.back).alias("place")), "burning-spokes")
        parts.append(moved)
        active = written(active.join(moved, "id", "left_anti"), "burning-active")
        if last:
            break
    rest = with_positions(active, "id", name="turn").select("id", (F.col("turn") + ends.front).alias("place"))
    out = rest
    for part in parts:
        out = out.unionByName(part)
    return out.select(F.col("id").cast("int").alias("old_id"), F.col("place").cast("int").alias("new_id"))
