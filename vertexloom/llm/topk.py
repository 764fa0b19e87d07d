"""Exact top-k search by inner product, with multi-resolution segment statistics.

For a segment of L components with means m and deviations s, the squared distance of two vectors is at least
L ((m1 - m2)^2 + (s1 - s2)^2), so their inner product is at most L (m1 m2 + s1 s2); summed over segments this bounds the
score, and finer segments bound it tighter. Vectors are turned first, which changes no inner product, so that their energy
lies in the first components, and segments are cut to hold about equal energy. A block of queries meets the candidates
chunk by chunk: pairs whose bound is below the query's floor drop out, coarse to fine, each level looking at the survivors
of the one before, and only what survives all counts by its exact score, in integers. A query's floor is its k-th best
score so far; it begins with that among some hundred to some thousand candidates, which all parts share. A level that
drops hardly any pair in a task is left out there but for every eighth chunk.

Every row is a candidate for every query, in blocks: queries are dealt to blocks, candidates to parts, and a task joins
one block with one part, so that a query gets k rows from each part, of which a window keeps k. Neither side is
broadcast; what is, is a square matrix of the vectors' width, which is bounded. Blocks and parts have a size in bytes, so a
row is shuffled once for each block (part) of the other side.

Rows whose vector is null, empty, or holds a null or a component that isn't finite take no part, nor do rows without an
id. Vectors of unlike length are compared as if the shorter ended in zeros. Equal scores go to the smaller id; a row
doesn't meet rows with its own id, and rows that share an id ask together, for k results in all. Scores beyond 64 bits are
held at the largest or smallest long. Rows too large for exact sums of doubles are worked out in whole numbers, pair by
pair; others aren't slowed by them. Further columns aren't looked at. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, table, written

#: Bytes of the queries in a block and of the candidates in a part, and rows of either at least; queries and candidates that are compared at a time.
SIDE_BYTES, LEAST_SIDE, STRIP, CHUNK = 8 << 20, 256, 2048, 1024
#: Segments at each resolution; more than a quarter of the width would cost more than exact scores.
LEVELS = (1, 4, 16)
#: Rows that the turn is worked out from at most, and the largest width it is for; candidates that floors begin with, about.
TURN_SAMPLE, TURN_WIDTH, PROBES = 4096, 1024, 2048
#: Sums of integers are exact in doubles below this.
EXACT = float(1 << 53)
#: What bounds may be off by, as a share of the product of the norms: well above their rounding.
MARGIN = 1e-9


def integers(vectors, scale: float, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows of floor(scale * x) as doubles, padded with zeros to one length; which of them doubles multiply exactly."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(out * scale)
        return out, np.abs(out).max(1, initial=0.0) ** 2 * width < EXACT


def turned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The directions of x by energy, as columns, and the share of each."""
    energy, directions = np.linalg.eigh(x.T @ x)
    order = np.argsort(-energy)
    energy = np.maximum(energy[order], 0)
    return directions[:, order], energy / max(energy.sum(), 1e-300)


def cuts_of(energy: np.ndarray, segments: int) -> np.ndarray:
    """Where segments begin and end, so that they hold about equal energy and none is empty."""
    n = len(energy)
    segments = min(segments, n)
    inner = np.searchsorted(np.cumsum(energy), np.arange(1, segments) / segments) + 1
    inner = np.maximum.accumulate(np.maximum(inner, np.arange(1, segments)) - np.arange(segments - 1)) + np.arange(segments - 1)
    inner = np.minimum(inner, n - np.arange(segments - 1, 0, -1))
    return np.concatenate([[0], inner, [n]]).astype(int)


def statistics(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Means and deviations of each row's segments, each times the root of the segment's length, side by side."""
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part, root = x[:, a:b], np.sqrt(b - a)
        found += [part.mean(1) * root, part.std(1) * root]
    return np.stack(found, 1)


def exact_scores(q: np.ndarray, x: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """Inner products of rows of q with rows of x, pair by pair, as 64-bit integers; exact: the pairs doubles are exact for."""
    out = np.zeros(len(q), np.int64)
    out[exact] = np.einsum("ij,ij->i", q[exact], x[exact]).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    for n in np.flatnonzero(~exact).tolist():
        out[n] = min(high, max(low, sum(int(a) * int(b) for a, b in zip(q[n], x[n], strict=True) if a and b)))
    return out


class Survivors:
    """Drops pairs by the bounds of the levels, and counts what each level was given and left over."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, directions: np.ndarray | None, energy: np.ndarray | None):
        width = queries.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            self.norms = [np.sqrt((x * x).sum(1)) for x in (queries, rows)]
            if directions is not None and len(directions) == width:
                queries, rows = queries @ directions, rows @ directions
            else:
                energy = np.full(width, 1.0 / width)
            cuts = [cuts_of(energy, n) for n in LEVELS if 4 * n <= width]
            self.levels = [(statistics(queries, c), statistics(rows, c)) for c in cuts]
        self.given, self.left, self.after = np.zeros((3, len(cuts)))
        self.chunks = 0

    def among(self, alive: np.ndarray, strip: slice, part: slice, floor: np.ndarray) -> np.ndarray:
        """alive, less the pairs that no bound lets reach the floor."""
        self.chunks += 1
        now = np.count_nonzero(alive)
        begun = np.isfinite(floor[strip]).all()
        with np.errstate(over="ignore", invalid="ignore"):
            least = floor[strip, None] - MARGIN * self.norms[0][strip, None] * self.norms[1][None, part] - 1e-6
            for n, (q, x) in enumerate(self.levels):
                # a level that drops less than a fiftieth isn't worth its cost
                if now and (self.left[n] <= 0.98 * self.given[n] or self.chunks % 8 == 0):
                    before = now
                    # a bound that isn't a number drops nothing
                    if before > alive.size // 16:
                        alive &= ~(q[strip] @ x[part].T < least)
                    else:
                        i, j = np.nonzero(alive)
                        far = np.einsum("ij,ij->i", q[strip][i], x[part][j]) < least[i, j]
                        alive[i[far], j[far]] = False
                    now = np.count_nonzero(alive)
                    # of late, and not before there are floors
                    if begun:
                        self.given[n], self.left[n] = self.given[n] / 2 + before, self.left[n] / 2 + now
                self.after[n] += now
        return alive


def best(q_ids, queries, x_ids, rows, k: int, q_exact, x_exact, floor=None, directions=None, energy=None, counts: list | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score): the k best of the candidates for each query that reach its floor, ties to smaller ids.

    counts: if given, gets the pairs there are, and those that are left behind each level, to look at.
    """
    order = np.argsort(x_ids, kind="stable")
    x_ids, rows, x_exact = x_ids[order], rows[order], x_exact[order]
    survivors = Survivors(queries, rows, directions, energy)
    held: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf) if floor is None else floor.astype(float)
    exact_pairs = 0
    for top in range(0, len(q_ids), STRIP):
        strip = slice(top, top + STRIP)
        q = queries[strip]
        for at in range(0, len(rows), CHUNK):
            part = slice(at, at + CHUNK)
            x = rows[part]
            alive = survivors.among(q_ids[strip, None] != x_ids[None, part], strip, part, floor)
            i, j = np.nonzero(alive)
            if not len(i):
                continue
            exact_pairs += len(i)
            both = q_exact[strip][i] & x_exact[part][j]
            if len(i) > alive.size // 16 and both.all():
                # where many pairs of a chunk survive, their scores are cheapest as one product
                scores = (q @ x.T)[i, j].astype(np.int64)
            else:
                scores = exact_scores(q[i], x[j], both)
            keep = scores >= floor[strip][i]
            i, j, scores = i[keep], j[keep], scores[keep]
            for n in np.unique(i):
                own = slice(np.searchsorted(i, n), np.searchsorted(i, n, "right"))
                s, c = scores[own], j[own]
                first = np.lexsort((c, [-int(v) for v in s]))[:k] if s.min(initial=0) == -(1 << 63) else np.argsort(-s, kind="stable")[:k]
                mine = held[top + n] = sorted(held[top + n] + [(-int(s[t]), int(x_ids[at + c[t]])) for t in first])[:k]
                if len(mine) == k:
                    floor[top + n] = max(floor[top + n], -mine[-1][0])
    if counts is not None:
        counts += [len(q_ids) * len(rows), *survivors.after.astype(int).tolist(), exact_pairs]
    return [(int(q), c, -s) for q, found in zip(q_ids, held, strict=True) for s, c in found]


def search(rows: DataFrame, queries, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. queries: a condition on `id` that says which rows are queries too."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.size("v") > 0
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where("id is not null and v is not null").where(good & finite)
    rows = written(rows, "topk-rows")
    total, asked, width = rows.agg(F.count("*"), F.count_if(queries), F.max(F.size("v"))).first()
    width = width or 1
    side, cores = max(LEAST_SIDE, SIDE_BYTES // (8 * width)), rows.sparkSession.sparkContext.defaultParallelism
    # small tables are cut further, to keep the cores busy
    parts = max(1, -(-total // side), min(2 * cores, -(-total // 1024)))
    blocks = max(1, -(-asked // side))
    # a hash over the vector too, so that rows with one id are spread
    salt = F.xxhash64("id", "v")
    shared = rows.sparkSession.sparkContext.broadcast(_turn(rows, total, width, scale))
    asking = rows.where(queries).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def run(cell: pa.Table) -> pa.Table:
        let_go()
        # a worker's arrays: the ids, and the vectors' values end to end
        asks = np.array(cell["asks"].to_pylist(), bool)
        ids = np.array(cell["id"].to_pylist(), np.int64)
        floor = cell["floor"].cast(pa.float64()).fill_null(float("-inf")).to_numpy()
        vectors, exact = integers([np.asarray(v.values) for v in cell["v"]], scale, width)
        directions, energy = shared.value
        found = []
        if asks.any() and not asks.all():
            found = best(ids[asks], vectors[asks], ids[~asks], vectors[~asks], k, exact[asks], exact[~asks], floor[asks], directions, energy)
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    def ranked(cells: DataFrame) -> DataFrame:
        found = cells.groupBy("block", "part").applyInArrow(run, "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    none = F.lit(None).cast("long")
    if parts > 1:
        # about PROBES candidates meet all queries first: a query's k-th best score among them is its floor in every part
        probes = rows.where(F.pmod(F.xxhash64("id", "v", F.lit(9)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, PROBES / total))))
        cells = probes.select("id", "v", none.alias("floor"), F.lit(False).alias("asks"), F.lit(0).alias("part"), every)
        cells = cells.unionByName(asking.select("id", "v", none.alias("floor"), F.lit(True).alias("asks"), F.lit(0).alias("part"), "block"))
        floors = written(ranked(cells).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor")), "topk-floors")
        asking = asking.join(floors, "id", "left")
    else:
        asking = asking.withColumn("floor", none)
    candidates = rows.select("id", "v", none.alias("floor"), F.lit(False).alias("asks"), F.pmod(salt, F.lit(parts)).cast("int").alias("part"), every)
    asking = asking.select("id", "v", "floor", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block")
    return ranked(candidates.unionByName(asking)).select("query_id", "rank", "vec_id", "score")


def _turn(rows: DataFrame, total: int, width: int, scale: float) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Directions by energy, from a bounded sample; any would give the same results, others at another speed."""
    if not total or width > TURN_WIDTH:
        return None, None
    share = F.pmod(F.xxhash64("id", "v", F.lit(8)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, TURN_SAMPLE / total)))
    some = rows.where(share).limit(2 * TURN_SAMPLE).select("v").toArrow()
    x, exact = integers([np.asarray(v.values) for v in some["v"]], scale, width)
    return turned(x[exact]) if exact.any() else (None, None)


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP6_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
           from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 20
"""
