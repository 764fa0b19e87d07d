"""Small expressions: bins, identifiers of perturbed graphs, natural order, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: reuse-distance bin edges, in sectors
EDGES = (1, 112, 512, 18432, 36864, 73728, 147456, 294912, 589824)
#: Rows of a sector.
SECTOR = 32


def bin_of(distance: Column, edges=EDGES) -> Column:
    """1 for distances below the first edge, i + 1 from the i-th edge on."""
    out = F.lit(1)
    for i, edge in enumerate(edges):
        out = F.when(distance >= edge, F.lit(i + 2)).otherwise(out)
    return out.cast("int")


NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"
WHOLE = r"^[+-]?\d+$"


def base_graph(name: Column) -> Column:
    """The graph that a perturbed graph's name stands for: without a tail of number, whole and whole; or the first token if
    the second is a number; else the name."""
    parts = F.split(F.trim(name), "_")
    size = F.size(parts)
    at = lambda k: F.element_at(parts, F.greatest(size + k, F.lit(1)))
    tail = (size >= 4) & at(-2).rlike(NUMBER) & at(-1).rlike(WHOLE) & at(0).rlike(WHOLE)
    second = (size >= 2) & F.element_at(parts, F.least(size, F.lit(2))).rlike(NUMBER)
    return F.when(tail, F.array_join(F.slice(parts, 1, F.greatest(size - 3, F.lit(1))), "_")).when(second, F.element_at(parts, 1)).otherwise(F.trim(name))


def natural_order(name: Column) -> list[Column]:
    """Whole numbers first, by value, then other names."""
    number = F.expr("1") if name is None else F.when(name.rlike(WHOLE), name.cast("decimal(38,0)"))
    return [number.isNull(), number, name]


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom)
