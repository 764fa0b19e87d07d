"""Predict, order, multiply, verify: the steps of a run as one plan, and its record."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import predictor, reuse, spmv
from ..operators.graph import Graph
from ..operators.orders import banded, burning, communities, greedy, simple
from ..operators.stats import is_permutation, ordering_width
from ..storage import written

#: Orderings by name, from a graph and two numbers that some of them take.
ORDERS = {
    "origin": lambda g, a=0, b=0: simple.identity(g),
    "random": lambda g, a=0, b=0: simple.random_order(g, int(a)),
    "degree": lambda g, a=0, b=0: simple.degree_order(g),
    "dbg": lambda g, a=0, b=0: simple.grouped_order(g),
    "rcm": lambda g, a=0, b=0: banded.banded(g),
    "rabbit": lambda g, a=0, b=0: communities.merged(g),
    "rabbit_rounds": lambda g, a=0, b=0: communities.merged_in_rounds(g),
    "slashburn": lambda g, a=0, b=0: burning.burned(g, float(a) or 0.005),
    "gorder1": lambda g, a=0, b=0: greedy.sliding(g, int(a) or 5),
    "gorder2": lambda g, a=0, b=0: greedy.batch_greedy(g, int(a) or ordering_width(g.n, g.nnz()), int(b) or 1),
    "gorder3": lambda g, a=0, b=0: greedy.batch_greedy_refined(g, int(a) or ordering_width(g.n, g.nnz()), int(b) or 1, 5),
    "gorder4": lambda g, a=0, b=0: greedy.block_refined(g, int(a) or ordering_width(g.n, g.nnz()), int(b) or 5),
    "gorder5": lambda g, a=0, b=0: greedy.batch_greedy_refined(g, int(a) or ordering_width(g.n, g.nnz()), int(b) or 1, 5, "row", None),
    "gorder6": lambda g, a=0, b=0: greedy.growing(g, int(a) or ordering_width(g.n, g.nnz())),
    "order": lambda g, a=0, b=0: greedy.tiled(g, int(a) or 14 * 32, int(b) or greedy.hub_limit(g.n)),
}


def order(g: Graph, method: str, a: float = 0, b: float = 0) -> DataFrame:
    if method not in ORDERS:
        raise ValueError(f"no ordering {method!r}; there are {', '.join(ORDERS)}")
    return ORDERS[method](g, a, b)


def predicted_speedup(g: Graph, sampled: bool = True, graph_id: int = 0, sector: int = reuse.SECTOR, edges=reuse.EDGES, **how) -> float:
    """From the reuse distances of the graph as it is."""
    hist = reuse.sampled_histogram(reuse.sampled_distances(g, graph_id, sector=sector, **how), edges) if sampled else reuse.exact_histogram(g, sector, edges)
    return predictor.predict(reuse.wide(hist)).first()["predicted_speedup"]


@dataclass
class Run:
    """What a run has found; vector is in the graph's own numbers."""

    method: str
    predicted: float
    reordered: bool
    vector: DataFrame
    mismatched: int
    record: dict


def optimise(g: Graph, method: str = "gorder6", tau: float | None = 1.0, a: float = 0, b: float = 0, sampled: bool = True, x: DataFrame | None = None) -> Run:
    """Predicts, orders where the prediction reaches tau (always if tau is None), multiplies, and compares with the plain product."""
    began = time.perf_counter()
    predicted = predicted_speedup(g, sampled)
    t_feature = time.perf_counter() - began
    record = {"method": method, "t_feature_ms": 1e3 * t_feature, "predicted_speedup": predicted}
    plain = spmv.multiply(g, x)
    if tau is not None and predicted < tau:
        return Run("origin", predicted, False, plain, 0, record)
    began = time.perf_counter()
    perm = written(order(g, method, a, b), "perm")
    record["t_order_ms"] = 1e3 * (time.perf_counter() - began)
    if not is_permutation(perm, g.n).first()["ok"]:
        raise AssertionError(f"{method} gave no permutation")
    new_x = None if x is None else x.join(perm, F.col("idx") == F.col("old_id")).select(F.col("new_id").alias("idx"), "val")
    began = time.perf_counter()
    vector = written(spmv.unpermuted(spmv.multiply(simple.relabel(g, perm), new_x), perm), "vector")
    record["t_spmv_ms"] = 1e3 * (time.perf_counter() - began)
    return Run(method, predicted, True, vector, spmv.difference(plain, vector).first()["mismatched"], record)
