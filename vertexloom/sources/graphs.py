"""Graph files by suffix, permutations, catalogues, and the sinks of graphs and densities."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, adjacency, largest_id, offsets
from ..operators.positions import with_positions
from ..storage import write_bytes, write_lines
from . import matrix_market


def _words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("w"), F.col("value"))


def _graph(edges: DataFrame, path: str, n: int | None = None) -> Graph:
    return Graph(edges, largest_id(edges) + 1 if n is None else n, path.rstrip("/").rsplit("/", 1)[-1])


def _edges(rows: DataFrame, at: int = 0, base: int = 0, weighted: bool = False) -> DataFrame:
    part = lambda k: F.get("w", F.lit(at + k))
    return rows.select((part(0).cast("int") - base).alias("row"), (part(1).cast("int") - base).alias("col"), (part(2).cast("double") if weighted else F.lit(1.0)).alias("val"))


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> Graph:
    """`u v` or `u v w` on each line, 0-based."""
    return _graph(_edges(_words(spark, path), weighted=weighted), path)


def read_dimacs(spark: SparkSession, path: str) -> Graph:
    """Lines `a u v w`, 1-based; others are skipped."""
    return _graph(_edges(_words(spark, path).where(F.get("w", F.lit(0)) == "a"), 1, 1, True), path)


def read_metis(spark: SparkSession, path: str) -> Graph:
    """`n m [fmt]`, then a line of neighbours for each vertex, 1-based; blank lines are vertices without any."""
    placed = with_positions(matrix_market.lines(spark, path).where(~F.col("value").startswith("%")), "block", "mid").select("k", F.trim("value").alias("value"))
    head = placed.where("k = 0").first()
    if head is None:
        raise matrix_market.BadHeader("premature_eof", "no size line")
    words = head["value"].split()
    if len(words) < 2 or len(words) > 2 and words[2] not in ("0", "00", "000", "100", "1", "001"):
        raise matrix_market.BadHeader("unsupported_type", head["value"])
    weighted = len(words) > 2 and words[2].endswith("1")
    rows = placed.where((F.col("k") > 0) & (F.col("value") != "")).select((F.col("k") - 1).cast("int").alias("row"), F.posexplode(F.split("value", r"\s+")).alias("at", "word"))
    if weighted:
        both = rows.groupBy("row", F.expr("at div 2").alias("pair")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("word"))).alias("v"), F.max(F.when(F.col("at") % 2 == 1, F.col("word"))).alias("x"))
        edges = both.select("row", (F.col("v").cast("int") - 1).alias("col"), F.col("x").cast("double").alias("val"))
    else:
        edges = rows.select("row", (F.col("word").cast("int") - 1).alias("col"), F.lit(1.0).alias("val"))
    return _graph(edges, path, int(words[0]))


def read_serialised(spark: SparkSession, path: str, weighted: bool = False) -> Graph:
    """The binary form: directed flag, numbers of edges and nodes, offsets, neighbours. A file is one task's; Parquet is the form for
    large graphs."""

    def run(parts):
        for part in parts:
            for content in part["content"]:
                _, nodes = struct.unpack_from("<qq", content, 1)
                offsets = np.frombuffer(content, "<i8", nodes + 1, 17)
                kind = np.dtype([("v", "<i4"), ("w", "<i4")]) if weighted else np.dtype([("v", "<i4")])
                near = np.frombuffer(content, kind, int(offsets[-1]), 17 + 8 * (nodes + 1))
                rows = np.repeat(np.arange(nodes, dtype=np.int32), np.diff(offsets))
                yield pd.DataFrame({"row": rows, "col": near["v"].astype(np.int32), "val": near["w"].astype(float) if weighted else np.ones(len(rows)), "n": nodes})

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row int, col int, val double, n long")
    nodes = spark.read.format("binaryFile").load(path).select(F.expr("substring(content, 10, 8)").alias("n")).first()["n"]
    return _graph(found.select("row", "col", "val"), path, int.from_bytes(nodes, "little"))


READERS = {
    "mtx": lambda s, p: matrix_market.read_graph(s, p),
    "el": read_edge_list,
    "net": read_edge_list,
    "wel": lambda s, p: read_edge_list(s, p, True),
    "gr": read_dimacs,
    "graph": read_metis,
    "sg": read_serialised,
    "wsg": lambda s, p: read_serialised(s, p, True),
    "parquet": lambda s, p: _graph(s.read.parquet(p), p),
}


def load_graph(spark: SparkSession, path: str) -> Graph:
    """The graph in a file, whose suffix says the form."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for .{suffix}; there are {', '.join(sorted(READERS))}")
    return READERS[suffix](spark, path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """id, path, nrow, ncol, nnz of each line; the last three may be missing."""
    part = lambda k, t: F.get("w", F.lit(k)).cast(t)
    return _words(spark, path).select(part(0, "string").alias("id"), part(1, "string").alias("path"), part(2, "long").alias("nrow"), part(3, "long").alias("ncol"), part(4, "long").alias("nnz"))


def catalog_path(spark: SparkSession, catalog: str, graph_id: str) -> str:
    found = read_catalog(spark, catalog).where(F.col("id") == str(graph_id)).first()
    if found is None:
        raise KeyError(f"{catalog} has no graph {graph_id}")
    return found["path"]


def write_edge_list(g: Graph, path: str, weighted: bool = False) -> None:
    line = F.concat_ws(" ", "row", "col", "val") if weighted else F.concat_ws(" ", "row", "col")
    g.edges.select(line.alias("value")).write.mode("overwrite").text(path)


def write_serialised(g: Graph, path: str, directed: bool = True, weighted: bool = False) -> None:
    """The binary form: directed flag, numbers of edges and nodes, offsets and neighbours, of a directed graph by source and
    then by target. Tasks pack their stretch of the sorted edges; the driver writes them one after another."""

    def packed(rows: DataFrame, columns: list[str], kind: str):
        def run(batches):
            for batch in batches:
                found = np.stack([np.asarray(batch.column(c)).astype(kind) for c in columns], 1)
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["part"])

        for r in rows.mapInArrow(run, "part binary").toLocalIterator(prefetchPartitions=True):
            yield bytes(r["part"])

    def side(one: str, other: str):
        yield struct.pack("<q", 0)
        yield from packed(offsets(g, one).select("id", "end").repartitionByRange("id").sortWithinPartitions("id"), ["end"], "<i8")
        columns = [other, "val"] if weighted else [other]
        yield from packed(g.edges.repartitionByRange(one, other, "val").sortWithinPartitions(one, other, "val"), columns, "<i4")

    def parts():
        yield struct.pack("<?qq", directed, g.nnz(), g.n)
        yield from side("row", "col")
        if directed:
            yield from side("col", "row")

    write_bytes(g.spark, path, parts())


def write_dimacs(g: Graph, path: str, weighted: bool = True) -> None:
    """`p sp n m`, then `a u v w` for each edge, 1-based."""
    weight = F.col("val").cast("long") if weighted else F.lit(1)
    body = g.edges.select(F.lit(1).alias("part"), "row", "col", F.concat_ws(" ", F.lit("a"), F.col("row") + 1, F.col("col") + 1, weight).alias("value"))
    top = g.spark.createDataFrame([(0, 0, 0, f"p sp {g.n} {g.nnz()}")], "part int, row int, col int, value string")
    write_lines(body.unionByName(top), path, "part", "row", "col")


def write_metis(g: Graph, path: str) -> None:
    """`n m`, then a line of neighbours for each vertex, 1-based; vertices without any are blank lines. A line is a vertex's."""
    near = adjacency(g).select("id", F.array_join(F.transform("neighbours", lambda v: (v + 1).cast("string")), " ").alias("value"))
    body = g.vertices().join(near, "id", "left").na.fill("", ["value"])
    top = g.spark.createDataFrame([(-1, f"{g.n} {g.nnz()}")], "id int, value string")
    write_lines(body.unionByName(top), path, "id")


def write_parquet(g: Graph, path: str, clustered: bool = True) -> None:
    """Edges by ranges of (col, row), so that row groups hold neighbouring vertices."""
    edges = g.edges.repartitionByRange("col", "row").sortWithinPartitions("col", "row") if clustered else g.edges
    edges.write.mode("overwrite").parquet(path)


def write_permutation(perm: DataFrame, n: int, m: int, path: str) -> None:
    """n, m, then `old new` by old, in one file."""
    top = perm.sparkSession.createDataFrame([(-2, str(n)), (-1, str(m))], "at int, value string")
    body = perm.select(F.col("old_id").alias("at"), F.concat_ws(" ", "old_id", "new_id").alias("value"))
    write_lines(top.unionByName(body), path, "at")


def read_permutation(spark: SparkSession, path: str) -> DataFrame:
    rows = _words(spark, path).where(F.size("w") == 2)
    return rows.select(F.get("w", F.lit(0)).cast("int").alias("old_id"), F.get("w", F.lit(1)).cast("int").alias("new_id"))


def write_relabelled(g: Graph, perm: DataFrame, path: str, ordered: bool = True) -> None:
    """The edge list in new numbers."""
    from ..operators.orders.simple import relabel

    new = relabel(g, perm).edges
    (new.orderBy("row", "col") if ordered else new).select(F.concat_ws(" ", "row", "col").alias("value")).write.mode("overwrite").text(path)


def png(width: int, height: int, pixels: np.ndarray) -> bytes:
    """A picture of red, green, blue, alpha bytes."""
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 4)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def density_picture(g: Graph, cells: int = 1024) -> bytes:
    """The density grid as a PNG; the driver gets a row for each non-empty cell, at most cells squared."""
    from ..operators.stats import colours, density_grid

    out = np.zeros((cells, cells, 4), np.uint8)
    for r in colours(density_grid(g, cells)).select("cell_row", "cell_col", "red", "green", "blue", "alpha").collect():
        out[r["cell_row"], r["cell_col"]] = r[2:]
    return png(cells, cells, out)
