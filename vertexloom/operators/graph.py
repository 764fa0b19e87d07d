"""Directed graphs as edge tables: row -> col, with multiplicity, over vertices 0 to n - 1."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .positions import running_sum, with_positions

OUT, IN = "row", "col"


@dataclass(frozen=True)
class Graph:
    """edges: row int, col int, val double. Immutable: each operation gives another graph."""

    edges: DataFrame
    n: int
    name: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges.select("row", "col", "val"))

    def vertices(self, name: str = "id") -> DataFrame:
        return self.spark.range(self.n).select(F.col("id").cast("int").alias(name))

    def nnz(self) -> int:
        return self.edges.count()


def from_pairs(pairs: DataFrame, n: int, row: str = "row", col: str = "col", val: str | None = None, name: str = "") -> Graph:
    """A graph from a table of endpoints; values are 1.0 unless a column holds them."""
    value = F.lit(1.0) if val is None else F.col(val).cast("double")
    return Graph(pairs.select(F.col(row).cast("int").alias("row"), F.col(col).cast("int").alias("col"), value.alias("val")), n, name)


def from_arrays(spark: SparkSession, rows, cols, n: int, name: str = "") -> Graph:
    data = [(int(a), int(b)) for a, b in zip(rows, cols, strict=True)]
    return from_pairs(spark.createDataFrame(data, "row int, col int"), n, name=name)


def largest_id(edges: DataFrame) -> int:
    """The largest endpoint, -1 without edges."""
    found = edges.agg(F.greatest(F.max("row"), F.max("col")).alias("m")).first()["m"]
    return -1 if found is None else int(found)


def sorted_edges(g: Graph, by: str = IN) -> DataFrame:
    """Edges in order of (row, col), or of (col, row) for by="col"."""
    return g.edges.orderBy(*(("row", "col") if by == OUT else ("col", "row")))


def degrees(g: Graph, side: str = OUT, name: str = "deg") -> DataFrame:
    """id, deg for every vertex, with multiplicity; vertices without edges have 0."""
    counted = g.edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias(name))
    return g.vertices().join(counted, "id", "left").na.fill(0, [name])


def both_degrees(g: Graph) -> DataFrame:
    """id, outdeg, indeg in one aggregation."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("row").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("col").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("o").cast("long").alias("outdeg"), F.sum("i").cast("long").alias("indeg"))
    return g.vertices().join(counted, "id", "left").na.fill(0, ["outdeg", "indeg"])


def offsets(g: Graph, side: str = OUT) -> DataFrame:
    """id, start, end of each vertex's stretch of the edges sorted by `side`: an exclusive scan of degrees."""
    rows = running_sum(degrees(g, side), "id", "deg", "start")
    return rows.select("id", "start", (F.col("start") + F.col("deg")).alias("end"))


def adjacency(g: Graph, side: str = OUT) -> DataFrame:
    """id, neighbours (sorted, with multiplicity) of each vertex that has any."""
    other = IN if side == OUT else OUT
    return g.edges.groupBy(F.col(side).alias("id")).agg(F.sort_array(F.collect_list(other)).alias("neighbours"))


def neighbours(g: Graph, vertex: int, skip: int = 0, side: str = OUT) -> DataFrame:
    """One vertex's neighbours in order, without the first `skip`."""
    other = IN if side == OUT else OUT
    return g.edges.where(F.col(side) == vertex).select(F.col(other).alias("id")).orderBy("id").offset(skip)


def without_loops_and_repeats(g: Graph, weighted: bool = False) -> Graph:
    """One edge for each pair of different vertices, of the smallest weight."""
    kept = g.edges.where("row <> col").groupBy("row", "col").agg(F.min("val").alias("val"))
    return g.with_edges(kept if weighted else kept.withColumn("val", F.lit(1.0)))


def transposed(g: Graph) -> Graph:
    return g.with_edges(g.edges.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))


def symmetrised(g: Graph, only_missing: bool = False) -> Graph:
    """With each edge's inverse added; only_missing: pairs become distinct, so that no edge is there twice."""
    both = g.edges.unionByName(transposed(g).edges)
    return g.with_edges(both.groupBy("row", "col").agg(F.min("val").alias("val")) if only_missing else both)


def undirected_weights(g: Graph) -> DataFrame:
    """row, col, weight in both directions, without loops, parallel edges summed."""
    both = symmetrised(g).edges.where("row <> col")
    return both.groupBy("row", "col").agg(F.sum("val").alias("weight"))


def relabel_by_degree(g: Graph) -> DataFrame:
    """old_id, new_id by (degree, id), both descending; for undirected graphs."""
    ranked = with_positions(degrees(g), F.desc("deg"), F.desc("id"), name="new_id")
    return ranked.select(F.col("id").alias("old_id"), F.col("new_id").cast("int").alias("new_id"))


def top_k(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k largest by value, ties to larger keys."""
    return rows.orderBy(F.desc(value), F.desc(key)).limit(k)


def pick_source(g: Graph, seed: int) -> int | None:
    """A vertex with an outgoing edge, by a seeded hash."""
    first = g.edges.select("row").distinct().orderBy(F.xxhash64("row", F.lit(seed)), "row").first()
    return None if first is None else int(first["row"])


def summary(g: Graph, directed: bool = True) -> dict:
    """What a graph prints of itself; an undirected graph stores each edge twice."""
    m = g.nnz()
    return {"name": g.name, "nodes": g.n, "edges": m if directed else m // 2, "degree": m / g.n if g.n else 0.0, "directed": directed}
