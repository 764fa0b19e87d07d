"""Degrees and reuse distances of edges that arrive over time, with Structured Streaming.

An extension: graphs in files are batches. A micro-batch adds its edges to a state in the shared folder; nothing is kept
on the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import SECTOR


def running_degrees(edges: DataFrame, side: str = "row") -> DataFrame:
    """id, deg so far, as a streaming aggregation; edges: a stream with row, col."""
    return edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("deg"))


def windowed_degrees(edges: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes", side: str = "row") -> DataFrame:
    """Degrees by window of event time; edges later than `late` are left out."""
    return edges.withWatermark(time, late).groupBy(F.window(time, window), F.col(side).alias("id")).agg(F.count("*").alias("deg"))


def reuse_gaps(accesses: DataFrame, sector: int = SECTOR) -> DataFrame:
    """k, sector, prev: each access (k, row) with the access before to its sector, across micro-batches.

    The state of a sector is the place of its last access; accesses of a micro-batch are taken in order of k.
    """
    keyed = accesses.select("k", F.expr(f"row div {sector}").cast("int").alias("sector"))

    def step(key, parts, state: GroupState):
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(parts)).sort_values("k")
        prev = rows["k"].shift(1).fillna(last).astype("int64")
        state.update((int(rows["k"].iloc[-1]),))
        yield pd.DataFrame({"k": rows["k"], "sector": key[0], "prev": prev.where(prev >= 0, -1)})

    return keyed.groupBy("sector").applyInPandasWithState(step, "k long, sector int, prev long", "last long", "append", GroupStateTimeout.NoTimeout)
