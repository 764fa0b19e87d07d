"""Greedy orderings: place next the vertex that shares most with those placed last.

The sequential ones take one vertex at a time and need the whole graph in one Python worker; they are there for parity and
for graphs that fit. The batched ones place many vertices in a step, which is a pair of joins, an aggregation and a top-k, and
then refine each batch by itself, in as many tasks as there are batches. Scores tie to the smaller id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...storage import fresh_path, written
from ..graph import IN, OUT, Graph, both_degrees
from ..positions import with_positions


LOW = (1 << 32) - 1
#: The score of what is placed, below all others.
PLACED = -(1 << 30)
NONE = np.empty(0, np.int32)
#: Pairs that are changed at once where an array of all would be needed beside them.
BLOCK = 1 << 18


def pairs_of(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Two columns of ids as one of whole numbers, which sort by both."""
    return row.astype(np.int64) << 32 | col


def halves(pairs: np.ndarray) -> np.ndarray:
    """The columns of pairs where they lie: the second, then the first."""
    return pairs.astype("<i8", copy=False).view("<i4").reshape(-1, 2)


class Gathered:
    """Pairs that come in parts, in one array, which grows where it lies: the parts aren't held beside it."""

    def __init__(self):
        self.pairs, self.size = np.empty(BLOCK, np.int64), 0

    def add(self, part: np.ndarray) -> None:
        end = self.size + len(part)
        if end > len(self.pairs):
            self.pairs.resize(max(end, len(self.pairs) * 9 // 8), refcheck=False)
        self.pairs[self.size : end] = part
        self.size = end

    def taken(self) -> np.ndarray:
        """All of them; they are no longer held here."""
        pairs, self.pairs = self.pairs, NONE
        pairs.resize(self.size, refcheck=False)
        return pairs


class Lists:
    """The values of each key from 0 to n - 1 in order, with repeats, one list after the other. pairs are sorted in place;
    `last` says that they aren't needed afterwards: values then lie in what was theirs, and the rest is given back."""

    def __init__(self, n: int, pairs: np.ndarray, last: bool = False):
        pairs.sort()
        self.starts = np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) << 32)
        self.counts = np.diff(self.starts)
        if not last or not pairs.flags.owndata:
            self.values = halves(pairs)[:, 0].copy()
            return
        m, flat = len(pairs), pairs.view("<i4")
        for at in range(0, m, BLOCK):
            part = flat[2 * at : 2 * (at + BLOCK) : 2].copy()
            flat[at : at + len(part)] = part
        del flat
        pairs.resize((m + 1) // 2, refcheck=False)
        self.values = pairs.view("<i4")[:m]

    def __getitem__(self, key: int) -> np.ndarray:
        return self.values[self.starts[key] : self.starts[key + 1]]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of some keys, one list after the other."""
        counts = self.counts[keys]
        ends = counts.cumsum()
        if not len(ends) or not ends[-1]:
            return NONE
        return self.values[np.arange(ends[-1]) + (self.starts[keys] - ends + counts).repeat(counts)]


def both_lists(n: int, pairs: np.ndarray) -> tuple[Lists, Lists]:
    """Targets by source and sources by target, of edges as pairs, which are used up: 12 bytes an edge at most, then 8."""
    targets = Lists(n, pairs)
    for at in range(0, len(pairs), BLOCK):
        both = halves(pairs[at : at + BLOCK])
        both[:] = both[:, ::-1].copy()
    return targets, Lists(n, pairs, last=True)


def windowed_order(n: int, first: int, raised: Callable[[int], np.ndarray], width: int) -> list[int]:
    """New -> old, from `first` on: next comes the vertex that the last `width` raise most often, the smallest of them. raised:
    the vertices that one raises, with repeats. Only what the window raises is looked at, so a step costs as much as its
    window's paths, and memory is a number for each vertex."""
    score, waits = np.zeros(n, np.int64), np.ones(n, bool)
    window: deque[np.ndarray] = deque()
    out, u, least = [], first, 0
    for _ in range(n):
        out.append(u)
        waits[u] = False
        score[u] = PLACED
        mine = raised(u)
        mine = mine[waits[mine]]
        np.add.at(score, mine, 1)
        window.append(mine)
        if len(window) > width:
            np.subtract.at(score, window.popleft(), 1)
        near = np.concatenate(window) if window else NONE
        # the largest score, then the smallest id; those that are placed are far below
        u = int(near[(score[near] * n - near).argmax()]) if len(near) else u
        if not waits[u]:
            while least < n and not waits[least]:
                least += 1
            u = least
    return out


def sliding_order(n: int, row: np.ndarray, col: np.ndarray, width: int, hub: int) -> list[int]:
    """New -> old. A placed vertex raises its out- and in-neighbours, and the other targets of its sources; leaving the window
    of the last `width` it lowers them again. Vertices with `hub` or more targets raise none through them."""
    return sliding_pairs(n, pairs_of(row, col), width, hub)


def sliding_pairs(n: int, pairs: np.ndarray, width: int, hub: int) -> list[int]:
    """The same of edges as pairs, which are used up."""
    if not n:
        return []
    targets, sources = both_lists(n, pairs)

    def raised(u: int) -> np.ndarray:
        near = sources[u]
        others = targets.of(near[targets.counts[near] < hub])
        return np.concatenate([targets[u] if targets.counts[u] < hub else NONE, near, others[others != u]])

    return windowed_order(n, int(sources.counts.argmax()), raised, width)


def tile_order(n: int, row: np.ndarray, col: np.ndarray, slots: int, hub: int) -> list[int]:
    """New -> old. Tiles of `slots` sources are filled by vertices that share sources with those in the tile; a vertex that
    doesn't fit begins the next tile, where all scores are zero again but for its sources in the new tile."""
    return tile_pairs(n, pairs_of(row, col), slots, hub)


def tile_pairs(n: int, pairs: np.ndarray, slots: int, hub: int) -> list[int]:
    """The same of edges as pairs, which are used up."""
    if not n:
        return []
    targets, sources = both_lists(n, pairs)
    score, waits = np.zeros(n, np.int64), np.ones(n, bool)
    near = NONE  # the vertices with a score, as often as the first to raise them did
    start = at = least = 0
    out, u = [], int(sources.counts.argmax())
    for _ in range(n):
        out.append(u)
        waits[u] = False
        into = sources[u]
        need = len(into)
        if at - start + need >= slots:
            score[near] = 0
            near = NONE
            start = (at + need) // slots * slots
            into = into[max(0, start - at) :]
        at += need
        mine = targets.of(into[targets.counts[into] < hub])
        mine = mine[waits[mine]]
        near = np.concatenate([near, mine[score[mine] == 0]])
        near = near[waits[near]]
        np.add.at(score, mine, 1)
        if len(near):
            found = score[near]
            u = int(near[found == found.max()].min())
        else:
            while least < n and not waits[least]:
                least += 1
            u = least
    return out


def sibling_order(n: int, first: int, incoming: np.ndarray, pairs: np.ndarray, width: int, hub: int) -> list[int]:
    """The members 0 to n - 1 of a batch in a new order: as sliding_order, with the terms through shared sources only.

    first: the member with most targets, which comes first; incoming: all edges into each; pairs: source and member of the
    edges whose sources have less than `hub` targets. Members with `hub` or more edges raise none.
    """
    # sources by turn instead of by id
    pairs.sort()
    last = turn = -1
    for at in range(0, len(pairs), BLOCK):
        part = pairs[at : at + BLOCK]
        row = part >> 32
        turns = turn + np.diff(row, prepend=last).astype(bool).cumsum()
        last, turn = int(row[-1]), int(turns[-1])
        part &= LOW
        part |= turns << 32
    shared, own = both_lists(max(n, turn + 1), pairs)

    def raised(u: int) -> np.ndarray:
        if incoming[u] >= hub:
            return NONE
        others = shared.of(own[u])
        return others[others != u]

    return windowed_order(n, first, raised, width)


def edge_pairs(batches) -> np.ndarray:
    """The edges of Arrow batches as pairs, without rows that are none."""
    found = Gathered()
    for b in batches:
        row, col = (c.to_numpy() for c in b.columns)
        edge = row >= 0
        found.add(pairs_of(row[edge], col[edge]))
    return found.taken()


def _whole(g: Graph, order) -> DataFrame:
    """perm from a function over all edges, as pairs, in one worker; edges come there in batches, 8 bytes each."""
    n = g.n

    def run(batches):
        sequence = order(n, edge_pairs(batches))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(sequence, np.int32)), pa.array(np.arange(n, dtype=np.int32))], names=["old_id", "new_id"])

    # a row beside the edges, so that a graph without edges is ordered too
    rows = g.edges.select("row", "col").unionByName(g.spark.createDataFrame([(-1, -1)], "row int, col int"))
    return rows.repartition(1).mapInArrow(run, "old_id int, new_id int")


def hub_limit(n: int) -> int:
    """A quarter of the root of the number of vertices."""
    return isqrt(n) // 4


def sliding(g: Graph, width: int = 5, hub: int | None = None) -> DataFrame:
    limit = hub_limit(g.n) if hub is None else hub
    return _whole(g, lambda n, pairs: sliding_pairs(n, pairs, width, limit))


def tiled(g: Graph, slots: int, hub: int) -> DataFrame:
    return _whole(g, lambda n, pairs: tile_pairs(n, pairs, slots, hub))


@dataclass(frozen=True)
class Step:
    """One batch: the places it fills, and the places whose vertices score the next candidates."""

    start: int
    size: int
    from_place: int
    scored: int


def even_steps(n: int, size: int, width: int) -> list[Step]:
    """Batches of one size; the last `width` of them score."""
    starts = range(0, n, size)
    return [Step(s, min(size, n - s), max(0, s + size - width * size), min(width * size, s + size)) for s in starts]


def growing_steps(n: int, width: int, first: int = 32) -> list[Step]:
    """Batches of 32, 32, 64, 128, ... up to `width`, scored by all that is placed; then of `width`, scored by the last."""
    steps, at, size = [], 0, min(first, width)
    while at < n:
        take = min(size, n - at)
        warm = at < width
        steps.append(Step(at, take, 0 if warm else at, at + take if warm else take))
        at += take
        if warm:
            size = min(width, at) if at < width else width
    return steps


#: Edges that one worker holds, at 12 bytes each while they are sorted; steps from which on it makes them all, if they fit.
IN_WORKER, MANY = 32_000_000, 8
#: Paths that are counted together.
PATHS = 1 << 21


def batches_of_pairs(n: int, pairs: np.ndarray, steps: list[Step], seeds: str | None, hub: int | None, by_id: bool) -> np.ndarray:
    """Vertices by place, as `batches` has them, of edges as pairs, which are used up."""
    targets, sources = both_lists(n, pairs)
    score = {None: np.zeros(n, np.int64), OUT: targets.counts, IN: sources.counts}[seeds].copy()
    waits = np.ones(n, bool)
    out = np.empty(n, np.int32)
    for number, step in enumerate(steps):
        if number:
            last = steps[number - 1]
            window = out[last.from_place : min(last.from_place + last.scored, step.start)]
            if hub is not None:
                window = window[sources.counts[window] < hub]
            # a source that many of the window share goes through its targets once, with their number
            shared, ways = np.unique(sources.of(window), return_counts=True)
            if hub is not None:
                few = targets.counts[shared] < hub
                shared, ways = shared[few], ways[few]
            score[:] = 0
            block = targets.counts[shared].cumsum() // PATHS
            for at in np.split(np.arange(len(shared)), np.flatnonzero(np.diff(block)) + 1):
                np.add.at(score, targets.of(shared[at]), ways[at].repeat(targets.counts[shared[at]]))
        # those with a score by it, then the first of the others
        best = np.flatnonzero(waits & (score > 0))
        if len(best) > step.size:
            floor = np.partition(score[best], len(best) - step.size)[len(best) - step.size]
            best = best[score[best] >= floor]
        best = best[np.lexsort((best, -score[best]))][: step.size]
        if len(best) < step.size:
            best = np.concatenate([best, np.flatnonzero(waits & (score == 0))[: step.size - len(best)]])
        out[step.start : step.start + step.size] = np.sort(best) if by_id else best
        waits[best] = False
    return out


def batches(g: Graph, steps: list[Step], seeds: str = IN, hub: int | None = None, by_id: bool = False, in_worker: int = IN_WORKER) -> DataFrame:
    """id, batch, place: vertices by steps. seeds: what scores the first batch, out- or in-degree, or id.

    The score of an open vertex w is the number of paths u <- v -> w from the scored places' vertices u, with
    multiplicity; u with `hub` or more sources and v with `hub` or more targets count for nothing. by_id: within a batch
    places follow ids, not scores.

    Few steps, or a graph of more than `in_worker` edges: each step is joins over all edges. Many steps over a smaller graph are
    made in one worker, where a step only looks at its paths.
    """
    if len(steps) >= MANY:
        g = g.with_edges(written(g.edges, "order-graph"))  # counted, and read again
        if g.nnz() <= in_worker:
            key = {IN: IN, OUT: OUT}.get(seeds)
            perm = _whole(g, lambda n, pairs: batches_of_pairs(n, pairs, steps, key, hub, by_id))
            begins = [s.start for s in steps]

            def numbered(tables):
                for t in tables:
                    place = t.column(1)
                    batch = np.searchsorted(begins, place.to_numpy(), "right") - 1
                    yield pa.RecordBatch.from_arrays([t.column(0), pa.array(batch.astype(np.int32)), place], names=["id", "batch", "place"])

            return perm.mapInArrow(numbered, "id int, batch int, place int")
    fans = written(both_degrees(g), "order-degrees")
    edges = g.edges.select("row", "col").join(fans.select(F.col("id").alias("row"), "outdeg"), "row").join(fans.select(F.col("id").alias("col"), "indeg"), "col")
    edges = written(edges, "order-edges")
    sources = edges if hub is None else edges.where((F.col("indeg") < hub) & (F.col("outdeg") < hub))
    targets = edges.select("row", F.col("col").alias("w"))
    vertices = g.vertices()
    scores = {"id": None, OUT: fans.select("id", F.col("outdeg").alias("deg")), IN: fans.select("id", F.col("indeg").alias("deg"))}[seeds]
    # a batch is a folder of its own, which isn't written again; the window reads its batches only
    spark, base = g.spark, fresh_path(g.spark, "order-placed")
    read = lambda: spark.read.schema("id int, place int, batch int").parquet(base)
    for number, step in enumerate(steps):
        if not number:
            rows = vertices.withColumn("score", F.lit(0)) if scores is None else scores.select("id", F.col("deg").alias("score"))
        else:
            placed, last = read(), steps[number - 1]
            begin = next(k for k, s in enumerate(steps) if s.start + s.size > last.from_place)
            window = placed.where((F.col("batch") >= begin) & (F.col("place") >= last.from_place) & (F.col("place") < last.from_place + last.scored)).select(F.col("id").alias("col"))
            # a source that many of the window share goes through its targets once, with their number
            paths = sources.join(window, "col").groupBy("row").agg(F.count("*").alias("ways")).join(targets, "row")
            counted = paths.groupBy(F.col("w").alias("id")).agg(F.sum("ways").alias("score"))
            rows = vertices.join(placed.select("id"), "id", "left_anti").join(counted, "id", "left").na.fill(0, ["score"])
        best = rows.orderBy(F.desc("score"), "id").limit(step.size)
        order = Window.orderBy(*(["id"] if by_id else [F.desc("score"), "id"]))  # a batch at most
        taken = best.withColumn("place", (F.row_number().over(order) - 1 + step.start).cast("int")).select("id", "place")
        taken.write.parquet(f"{base}/batch={number}")
    if not steps:
        return vertices.select("id", F.lit(0).alias("batch"), F.col("id").alias("place"))
    return read().select("id", "batch", "place")


def refined(g: Graph, placed: DataFrame, width: int, hub: int, from_batch: int = 0, restrict: bool = True) -> DataFrame:
    """placed with the batches from `from_batch` on ordered anew within their places, each in a task of its own."""
    placed, fans = written(placed, "order-batches"), written(both_degrees(g), "order-degrees")
    todo = placed.where(F.col("batch") >= from_batch)
    no = F.lit(0)
    few = fans.where(F.col("outdeg") < hub).select(F.col("id").alias("row"))
    edges = g.edges.select("row", F.col("col").alias("id")).join(few, "row").join(todo.select("id", "batch"), "id")
    # a row for each member, without a source, and one for each edge
    rows = todo.join(fans, "id").select("batch", "id", F.lit(-1).alias("row"), "place", "outdeg", "indeg")
    rows = rows.unionByName(edges.select("batch", "id", "row", no.alias("place"), no.cast("long").alias("outdeg"), no.cast("long").alias("indeg")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, found = [], Gathered()
        for b in batches:
            batch, ids, row, *more = (c.to_numpy() for c in b.columns)
            edge = row >= 0
            found.add(pairs_of(row[edge], ids[edge]))
            if not edge.all():
                members.append([x[~edge] for x in (ids, *more, batch)])
        ids, place, out, incoming, batch = (np.concatenate(x) for x in zip(*members, strict=True))
        del members
        order = ids.argsort()
        ids, place, out, incoming = ids[order], place[order], out[order], incoming[order]
        pairs = found.taken()
        for at in range(0, len(pairs), BLOCK):
            part = pairs[at : at + BLOCK]
            low = part & LOW
            part -= low
            part |= np.searchsorted(ids, low.astype(np.int32))
        # most targets first, which is where a batch starts
        new = sibling_order(len(ids), int(out.argmax()), incoming, pairs, width, hub)
        places = np.arange(len(new), dtype=np.int32) + place.min()
        yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(batch), pa.array(places.astype(np.int32))], names=["id", "batch", "place"])

    done = rows.groupBy("batch").applyInArrow(run, "id int, batch int, place int")
    return placed.where(F.col("batch") < from_batch).unionByName(done)


def _perm(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("id").alias("old_id"), F.col("place").cast("int").alias("new_id"))


def batch_greedy(g: Graph, size: int, width: int) -> DataFrame:
    """Batches seeded by the first ids, scored by the last `width` batches, ids in order within a batch."""
    return _perm(batches(g, even_steps(g.n, size, width), "id", by_id=True))


def batch_greedy_refined(g: Graph, size: int, width: int, inner: int, seeds: str = "id", hub: int | None = 1000) -> DataFrame:
    """The same, each batch refined."""
    placed = batches(g, even_steps(g.n, size, width), seeds, by_id=True)
    return _perm(refined(g, placed, inner, hub_limit(g.n) if hub is None else hub))


def block_refined(g: Graph, size: int, width: int, hub: int | None = None) -> DataFrame:
    """Blocks of consecutive ids, each refined; no step across blocks."""
    placed = g.vertices().select("id", F.expr(f"id div {size}").cast("int").alias("batch"), F.col("id").alias("place"))
    return _perm(refined(g, placed, width, hub_limit(g.n) if hub is None else hub))


def growing(g: Graph, width: int, inner: int = 5, hub: int = 10_000, inner_hub: int | None = None, refine_from: int | None = None) -> DataFrame:
    """The deployed ordering: seeded by in-degree, growing batches, hubs skipped, later batches refined."""
    placed = batches(g, growing_steps(g.n, width), IN, hub)
    first = int(log2(width)) if refine_from is None else refine_from
    return _perm(refined(g, placed, inner, hub_limit(g.n) if inner_hub is None else inner_hub, first))


def by_score(rows: DataFrame, *order) -> DataFrame:
    """perm of all vertices by a given order, for other scores."""
    return _perm(with_positions(rows, *order, name="place"))
