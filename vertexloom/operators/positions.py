"""Global order without a single task: positions, running sums, neighbours in a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Rows of a block for running sums and neighbours.
BLOCK = 1 << 16
#: Rows that one task may number by itself.
SMALL = 1 << 17


def with_positions(df: DataFrame, *order: Column | str, name: str = "k", start: int = 0) -> DataFrame:
    """df with each row's place in the order, from `start`; ties get different places.

    Rows are range-partitioned and sorted, once, into the shared folder; a row's place is its index in its partition after
    the counts of the partitions before.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    spread = written(spread.withColumn("_mid", F.monotonically_increasing_id()), "positions")
    spread = spread.withColumns({"_part": F.shiftright("_mid", 33), "_at": F.col("_mid").bitwiseAND((1 << 33) - 1)}).drop("_mid")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition
    starts = spread.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = spread.join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_at") + start).drop("_part", "_at", "_start")


def running_sum(df: DataFrame, key: str, value: str, name: str, block: int = BLOCK, inclusive: bool = False, ties: list[str] | None = None, kind: str = "long") -> DataFrame:
    """df with the sum of `value` over the rows before (or up to) it by the whole number `key`; blocks of keys are summed first."""
    rows = df.withColumn("_block", F.expr(f"`{key}` div {block}"))
    to = 0 if inclusive else -1
    sums = rows.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy(key, *(ties or [])).rowsBetween(Window.unboundedPreceding, to)
    rows = rows.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, "_block")
    return rows.withColumn(name, (F.col(name) + F.col("_before")).cast(kind)).drop("_block", "_before")


def with_previous(stream: DataFrame, group: str, place: str = "k", block: int = BLOCK, previous: str = "prev", following: str | None = None) -> DataFrame:
    """stream with the place of the previous (and next) row of the same group, null if there is none.

    Places are cut into blocks: within a group and block a window looks back; across blocks only the first and last place of
    each group and block are looked at, so that a group with most of the rows is still many windows.
    """
    rows = stream.withColumn("_block", F.expr(f"`{place}` div {block}"))
    within = Window.partitionBy(group, "_block").orderBy(place)
    across = Window.partitionBy(group).orderBy("_block")
    ends = rows.groupBy(group, "_block").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    ends = ends.select(group, "_block", F.lag("_last").over(across).alias("_came"), F.lead("_first").over(across).alias("_comes"))
    rows = rows.withColumn("_back", F.lag(place).over(within))
    if following:
        rows = rows.withColumn("_on", F.lead(place).over(within))
    rows = rows.join(ends, [group, "_block"])
    rows = rows.withColumn(previous, F.coalesce("_back", "_came"))
    if following:
        rows = rows.withColumn(following, F.coalesce("_on", "_comes"))
    return rows.drop("_block", "_back", "_on", "_came", "_comes")
