"""Statistics of a graph: degree distribution, density, sharing between neighbours, merge-path tiles."""

from __future__ import annotations

from math import ceil, log2, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .graph import IN, OUT, Graph, both_degrees, degrees, offsets
from .positions import running_sum


def degree_cdf(g: Graph) -> DataFrame:
    """For each degree that occurs: the shares of vertices with at most that degree and of the edges they have, in and out."""
    m = g.nnz()
    both = both_degrees(g).select(F.explode(F.array(F.struct(F.col("indeg").alias("degree"), F.lit(1).alias("hin"), F.lit(0).alias("hout")), F.struct(F.col("outdeg").alias("degree"), F.lit(0).alias("hin"), F.lit(1).alias("hout")))).alias("e")).select("e.*")
    hist = both.groupBy("degree").agg(F.sum("hin").alias("hin"), F.sum("hout").alias("hout"))
    upto = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)  # a row for each degree
    share = lambda c, total: (F.sum(c).over(upto) / F.lit(float(max(1, total))))
    return hist.select("degree", share(F.col("hin"), g.n).alias("rows_in"), share(F.col("hin") * F.col("degree"), m).alias("nnz_in"), share(F.col("hout"), g.n).alias("rows_out"), share(F.col("hout") * F.col("degree"), m).alias("nnz_out"))


def dangling(g: Graph, side: str = OUT) -> DataFrame:
    """Vertices without an edge on this side."""
    return g.vertices().join(g.edges.select(F.col(side).alias("id")).distinct(), "id", "left_anti")


def dense(g: Graph) -> DataFrame:
    """A small matrix as a table: a row for each vertex, a column for each; of repeated entries the largest."""
    return g.vertices("row").join(g.edges, "row", "left").groupBy("row").pivot("col", list(range(g.n))).agg(F.max("val")).na.fill(0.0).orderBy("row")


def density_grid(g: Graph, cells: int = 1024) -> DataFrame:
    """cell_row, cell_col, cnt, density of the non-empty cells of a grid over the matrix."""
    size = max(1, ceil(g.n / cells))
    grid = g.edges.groupBy(F.expr(f"row div {size}").alias("cell_row"), F.expr(f"col div {size}").alias("cell_col")).agg(F.count("*").alias("cnt"))
    return grid.withColumn("density", F.least(F.lit(1.0), F.col("cnt") / F.lit(float(size))))


def colours(grid: DataFrame) -> DataFrame:
    """The grid with red, green, blue, alpha: blue to green up to 0.1, green to yellow up to 0.5, yellow to red above."""
    d = F.col("density")
    step = lambda low, high: (d - low) / (high - low)
    byte = lambda x: F.round(x * 255).cast("int")
    red = F.when(d <= 0.1, F.lit(0.0)).when(d <= 0.5, step(0.1, 0.5)).otherwise(F.lit(1.0))
    green = F.when(d <= 0.1, step(0.0, 0.1)).when(d <= 0.5, F.lit(1.0)).otherwise(1.0 - step(0.5, 1.0))
    blue = F.when(d <= 0.1, 1.0 - step(0.0, 0.1)).otherwise(F.lit(0.0))
    return grid.withColumns({"red": byte(red), "green": byte(green), "blue": byte(blue), "alpha": F.when(d > 0, 255).otherwise(0)})


def ordering_width(n: int, nnz: int) -> int:
    """The batch width that suits a graph's size and mean degree."""
    mean = nnz // n if n else 0
    if not mean:
        return 1024
    scale = round(log2(sqrt(n // mean))) if n // mean else 0
    return 1024 if scale < 10 else 16384 if scale < 12 else 262144


def gscore(g: Graph, width: int) -> DataFrame:
    """score: pairs of columns at most `width` apart that share a row, with multiplicity.

    Columns are cut into buckets of `width`, so a pair lies in one bucket or in two that adjoin; the join is on row and
    bucket, and a row with many entries makes no more than the pairs near each other.
    """
    edges = g.edges.select("row", "col", F.expr(f"col div {width}").alias("bucket"))
    right = edges.select(F.col("row"), F.col("col").alias("other"), F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"))
    near = (F.col("other") > F.col("col")) & (F.col("other") - F.col("col") <= width)
    return edges.join(right, ["row", "bucket"]).where(near).agg(F.count("*").alias("score"))


def is_permutation(perm: DataFrame, n: int, column: str = "new_id") -> DataFrame:
    """ok: the column holds each of 0 to n - 1 once."""
    found = perm.agg(F.count(column).alias("c"), F.countDistinct(column).alias("d"), F.min(column).alias("low"), F.max(column).alias("high"))
    good = (F.col("c") == n) & (F.col("d") == n) & ((F.lit(n) == 0) | ((F.col("low") == 0) & (F.col("high") == n - 1)))
    return found.select(F.coalesce(good, F.lit(n == 0)).alias("ok"), F.col("c").alias("rows"), F.col("d").alias("distinct_ids"))


#: Items of a lane, lanes of a tile.
LANE, LANES = 14, 32


def lane_coordinates(g: Graph, side: str = IN, lane: int = LANE, edges: int | None = None) -> DataFrame:
    """diag, x, y for each lane of the merge path over row ends and entries: y rows end and x entries lie before diag.

    Row i ends at key end(i) + i + 1; y counts the keys up to diag. Keys and lanes are merged by one running count.
    """
    m = g.nnz() if edges is None else edges
    lanes = -(-(g.n + m) // lane)
    keys = offsets(g, side).select((F.col("end") + F.col("id") + 1).cast("long").alias("at"), F.lit(1).alias("one"))
    marks = g.spark.range(lanes).select((F.col("id") * lane).alias("at"), F.lit(0).alias("one"))
    # keys come before a lane at the same place; keys differ from each other
    merged = running_sum(keys.unionByName(marks).withColumn("late", 1 - F.col("one")), "at", "one", "y", block=lane * 4096, inclusive=True, ties=["late"])
    return merged.where("one = 0").select(F.col("at").alias("diag"), (F.col("at") - F.col("y")).alias("x"), "y")


def tiles(g: Graph, side: str = IN, lane: int = LANE, lanes: int = LANES) -> DataFrame:
    """tile_id, x, y at its start, fast (no row ends in it), empty (no entry lies in it)."""
    m = g.nnz()
    total = g.n + m
    starts = lane_coordinates(g, side, lane, m).where(F.col("diag") % (lane * lanes) == 0)
    starts = starts.select((F.col("diag") / (lane * lanes)).cast("long").alias("tile_id"), "x", "y")
    after = starts.select((F.col("tile_id") - 1).alias("tile_id"), F.col("x").alias("x_to"), F.col("y").alias("y_to"))
    end_y, end_x = F.coalesce("y_to", F.lit(g.n)), F.coalesce("x_to", F.lit(m))
    return starts.join(after, "tile_id", "left").select("tile_id", "x", "y", (end_y == F.col("y")).alias("fast"), (end_x == F.col("x")).alias("empty")).where(F.lit(total > 0))


def tile_summary(g: Graph, side: str = IN) -> DataFrame:
    """tiles, fast_tiles, empty_tiles."""
    # counted and scanned more than once
    g = g.with_edges(written(g.edges, "tile-edges"))
    return tiles(g, side).agg(F.count("*").alias("tiles"), F.count_if("fast").alias("fast_tiles"), F.count_if("empty").alias("empty_tiles"))


def lane_bits(g: Graph, side: str = IN, lane: int = LANE) -> DataFrame:
    """For each lane a descriptor: bit i is set if the i-th item on its path is a row end; and the row ends in it."""
    g = g.with_edges(written(g.edges, "tile-edges"))
    keys = offsets(g, side).select((F.col("end") + F.col("id")).cast("long").alias("at"))
    marked = keys.groupBy(F.expr(f"at div {lane}").alias("lane")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(at % {lane} as int))")).alias("bits"), F.count("*").alias("row_ends"))
    lanes = -(-(g.n + g.nnz()) // lane)
    return g.spark.range(lanes).select(F.col("id").alias("lane")).join(marked, "lane", "left").na.fill(0, ["bits", "row_ends"])


def hub_share(g: Graph, top: int) -> DataFrame:
    """The share of edges that the `top` vertices of highest out-degree have."""
    best = degrees(g).orderBy(F.desc("deg"), "id").limit(top)
    return best.agg((F.sum("deg") / F.lit(float(max(1, g.nnz())))).alias("share"))
