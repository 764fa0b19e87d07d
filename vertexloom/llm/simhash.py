"""SimHash near-duplicates: tiled exact comparison of fingerprints, and connected components.

A fingerprint has a bit for each bit of the 64-bit hashes of a text's word shingles, set where over half of the hashes
have it. Equal fingerprints are one node from the start, by an aggregation. Two that differ in at most r bits agree in
at least one of r + 1 bands of bits (or, with more blocks of bits, in one of the unions of some of them), so fingerprints are
dealt by band into tiles; tiles that share a band's bits are compared exactly, by exclusive-or and bit counts in numpy, unless their population counts differ beyond r: then no pair
in them can link. A band's bits that very many fingerprints share make many tiles, by population count and a hash, each
pair of which is a row of its own, so such a group is spread over tasks. A tile pair yields a star for each of its
components rather than every pair of it, and components are found by contraction: each node points to its smallest
neighbour, pointers are doubled, edges are relabelled, until none is left.

Null and empty texts, and texts of white space only, have fingerprint zero and link like any other. Rows that repeat an
id are nodes alike. Rows with a null id link others but don't name a component; one of such rows only is null. An empty
table gives no rows. Columns besides id and text aren't looked at, or pass through, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, slices, table, unused, written

#: Fingerprints in a tile, about: a pair of tiles makes matrices of 8 MB.
TILE = 1024
#: Shingles hashed at a time, which bounds the memory that a long text takes.
STRETCH = 1 << 15


def fingerprint(text: str, words: int, seed: int) -> int:
    """64-bit SimHash over the shingles of `words` words; bytes.split knows the same white space as the word pattern."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, size = b" ".join(found), min(words, len(found))
    ends = [n - 1 for n in accumulate(len(w) + 1 for w in found)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = len(found) - size + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STRETCH):
        to = min(n, at + STRETCH)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to], ends[at + size - 1 : to + size - 1], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches):
        for batch in slices(batches):
            made = np.array([fingerprint(x or "", words, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def stars(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the least of its component, for links within a, or between a and b."""
    if b is None:
        near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
        label = np.arange(len(a))
        while True:
            least = np.where(near, label[None, :], len(a)).min(1)
            least = least[least]
            if (least == label).all():
                break
            label = least
        far = label != np.arange(len(a))
        return a[far], a[label[far]]
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if not near.any():
        return a[:0], a[:0]
    left, right, none = np.arange(len(a)), np.full(len(b), len(a)), len(a)
    while True:
        new_right = np.minimum(right, np.where(near, left[:, None], none).min(0))
        new_left = np.minimum(left, np.where(near, new_right[None, :], none).min(1))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    moved, met = left != np.arange(len(a)), right < none
    return np.concatenate([a[moved], b[met]]), np.concatenate([a[left[moved]], a[right[met]]])


def band_masks(n: int, radius: int) -> list[int]:
    """Sets of bits, as masks, in one of which two fingerprints within the radius agree.

    Bits are cut into more blocks than the radius; a pair agrees in all blocks but `radius`, so the masks are the unions of
    that many. The more fingerprints, the more blocks, so that few share a mask's bits by chance: with 5 bands of 12 bits at
    a radius of 4, 15 of 21 bits, 35 of 27, or 70 of 32.
    """
    for blocks in range(radius + 1, radius + 5):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
        masks = [sum(c) for c in combinations(parts, blocks - radius)]
        if n >> min(m.bit_count() for m in masks) <= TILE // 4:
            break
    return masks


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges u, v that join all fingerprints (column fp, distinct) at distance 1 to radius, directly or by others."""
    masks = [m - (1 << 64) if m >> 63 else m for m in band_masks(nodes.count(), radius)]
    band = [F.col("fp").bitwiseAND(F.lit(m)) for m in masks]
    rows = nodes.select("fp", F.bit_count("fp").cast("int").alias("ones"), F.posexplode(F.array(*band)).alias("band", "key"))
    rows = written(rows, "simhash-bands")
    large = written(rows.groupBy("band", "key").count().where(F.col("count") > TILE).select("band", "key"), "simhash-large")
    pack = [F.sort_array(F.collect_list("fp")).alias("a")]
    single = rows
    pairs = None
    if not large.isEmpty():
        single = rows.join(large, ["band", "key"], "left_anti")
        crowd = rows.join(large, ["band", "key"])
        cuts = crowd.groupBy("band", "key", "ones").agg(F.ceil(F.count("*") / TILE).alias("cuts"))
        crowd = crowd.join(cuts, ["band", "key", "ones"]).withColumn("cut", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cuts")))
        tiles = written(crowd.groupBy("band", "key", "ones", "cut").agg(*pack), "simhash-tiles")
        # tiles whose population counts differ by more never meet: a tile looks for those with as many ones and up to the
        # radius more, so a crowded key is many keys of the join
        asking = tiles.select("band", "key", F.col("ones").alias("own"), "cut", "a", F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)).alias("ones"))
        other = tiles.select("band", "key", "ones", F.col("cut").alias("cut_b"), F.col("a").alias("b"))
        pairs = asking.join(other, ["band", "key", "ones"]).where((F.col("own") < F.col("ones")) | (F.col("cut") <= F.col("cut_b")))
        same = (F.col("own") == F.col("ones")) & (F.col("cut") == F.col("cut_b"))
        pairs = pairs.select("a", F.when(~same, F.col("b")).alias("b")).repartition(nodes.sparkSession.sparkContext.defaultParallelism * 4)
    alone = single.groupBy("band", "key").agg(*pack).where(F.size("a") > 1).select("a", F.lit(None).cast("array<bigint>").alias("b"))

    def run(batches):
        for batch in slices(batches):
            us, vs = [], []
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                left = a.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                right = b.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if b.is_valid else None
                u, v = stars(left, right, radius)
                us.append(u)
                vs.append(v)
            u, v = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in (us, vs))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    found = alone.mapInArrow(run, "u long, v long")
    if pairs is not None:
        found = found.unionByName(pairs.mapInArrow(run, "u long, v long"))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each end of an edge u, v; root is the same for all that are connected."""
    edges = written(edges.where("u <> v"), "cc-edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    roots = written(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), "cc-roots")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        first = up = written(up, "cc-up")
        for _ in range(2):
            up = up.join(up.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p"))
        up = written(up, "cc-up", first)
        joined = edges.join(up.withColumnRenamed("p", "a"), "u").join(up.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
        edges = written(joined.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-edges", edges)
        named = roots.join(up.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        roots = written(named, "cc-roots", roots, up)
    return roots


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id that links reach) of each row."""
    rows = written(fingerprints(docs, words, seed, id_col, text_col), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    linked = components(links(nodes.select("fp"), radius))
    members = nodes.join(linked.withColumnRenamed("node", "fp"), "fp")
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    named = members.join(least, "root").select("fp", "least")
    # written, so that the join with the rows has plain sides, of which Spark can split a crowded fingerprint's
    nodes = written(nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-named")
    return rows.join(nodes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of 64 bits in a wide fingerprint, rows of a block (a task compares two blocks, tile by tile) and of a tile, all of
#: whose pairs may be near.
WIDE, BLOCK, WIDE_TILE = 4, 1 << 16, 384
#: Shingles among which a task confirms links, about; a row counts as so many besides its own, as it costs comparisons.
SETS, ROW = 1 << 20, 512


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit hash of values that have a hash (the finaliser of SplitMix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int, seed: int) -> tuple[int, np.ndarray]:
    """Hash of the text's words in order, and the different hashes of its shingles in order of size."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0, np.empty(0, np.uint64)
    joined, size = b" ".join(found), min(words, len(found))
    ends = [n - 1 for n in accumulate(len(w) + 1 for w in found)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return digest(joined, seed), np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)], np.uint64))


def wide_fingerprint(text: str, words: int, seed: int) -> tuple[int, int, bytes]:
    """Hash of the text's words in order, number of different shingles, and WIDE x 64 bits over them."""
    key, hashes = shingles(text, words, seed)
    counts = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(hashes), STRETCH):
        part = hashes[at : at + STRETCH]
        for k in range(WIDE):
            counts[k] += np.unpackbits(mixed(part, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return key, len(hashes), np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").tobytes()


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose distance over all words is at most radius.

    The first two words go first: a pair passes if it differs in either in no more than 3/2 of its share of the radius. At a
    radius of 64 that is 24 bits, where pairs of a similarity of 0.8 differ in 10 with a deviation of 3.
    """
    width = a.shape[1]
    share = 3 * radius // (2 * width) if width > 1 else radius
    i, j = np.nonzero(np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) <= share)
    if width > 1 and len(i):
        near = np.bitwise_count(a[i, 1] ^ b[j, 1]) <= share
        i, j = i[near], j[near]
        total = np.bitwise_count(a[i] ^ b[j]).sum(1)
        i, j = i[total <= radius], j[total <= radius]
    return i, j


def forest(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(nodes)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def block_links(a: np.ndarray, b: np.ndarray | None, radius: int, similarity: float, a_sizes: np.ndarray, b_sizes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j (numbered through a, then b) that join all that links within a, or between a and b."""
    within = b is None
    if within:
        b, b_sizes = a, a_sizes
    orders = [np.lexsort((np.bitwise_count(x).sum(1), n)) for x, n in ((a, a_sizes), (b, b_sizes))]
    ones = [np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b)]
    shift = 0 if within else len(a)
    lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for p in range(0, len(a), WIDE_TILE):
        own = orders[0][p : p + WIDE_TILE]
        for q in range(p if within else 0, len(b), WIDE_TILE):
            other = orders[1][q : q + WIDE_TILE]
            # sizes rule out a similarity as high, or population counts a distance as low
            sizes = (a_sizes[own], b_sizes[other])
            if sizes[0].max() < similarity * sizes[1].min() or sizes[1].max() < similarity * sizes[0].min():
                continue
            counts = (ones[0][own], ones[1][other])
            if counts[0].min() - counts[1].max() > radius or counts[1].min() - counts[0].max() > radius:
                continue
            i, j = near_pairs(a[own], b[other], radius)
            i, j = own[i], other[j]
            fits = np.minimum(a_sizes[i], b_sizes[j]) >= similarity * np.maximum(a_sizes[i], b_sizes[j])
            i, j = i[fits], j[fits] + shift
            if len(i):
                ends, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                label = forest(len(ends), back[: len(i)], back[len(i) :])
                far = label != np.arange(len(ends))
                lefts.append(ends[far])
                rights.append(ends[label[far]])
    return np.concatenate(lefts), np.concatenate(rights)


def wide_links(nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Candidates: edges u, v between keys of nodes (key, n, bits) within the radius and of sizes that allow the similarity.

    Sizes are cut into classes so that only a class and the next can hold similar ones; a class is dealt to blocks by a
    hash, and each pair of blocks is a task.
    """
    step = F.lit(float(-np.log(similarity)))
    rows = nodes.withColumn("class", F.floor(F.log(F.greatest("n", F.lit(1))) / step + 1e-9).cast("int"))
    # classes of some size are a few blocks, so that no task has most of the rows; large ones are as many as it takes
    block = F.greatest(F.lit(BLOCK // 8), F.least(F.lit(BLOCK), F.ceil(F.count("*") / 8)))
    cuts = rows.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    after = cuts.select((F.col("class") - 1).alias("class"), F.col("cuts").alias("cuts_after"))
    before = cuts.select((F.col("class") + 1).alias("class"), F.col("cuts").alias("cuts_before"))
    # as many rows as there are classes, which follow the logarithm of the longest text
    plan = written(cuts.join(after, "class", "left").join(before, "class", "left").na.fill(0), "simhash-classes")
    rows = rows.join(F.broadcast(plan), "class").withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("cuts")).cast("int"))
    # a cell is a class, a block of it, and a block of it or of the next; a row is on the left (of the two) or on the right
    none = F.array().cast("array<int>")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(none)
    cell = lambda c, x, kind, y, side: F.struct(c.alias("class"), x.alias("x"), F.lit(kind).alias("kind"), y.alias("y"), F.lit(side).alias("side"))
    own = F.transform(F.filter(upto("cuts"), lambda y: y >= F.col("block")), lambda y: cell(F.col("class"), F.col("block"), 0, y, 0))
    mine = F.transform(F.filter(upto("cuts"), lambda x: x < F.col("block")), lambda x: cell(F.col("class"), x, 0, F.col("block"), 1))
    up = F.transform(upto("cuts_after"), lambda y: cell(F.col("class"), F.col("block"), 1, y, 0))
    down = F.transform(upto("cuts_before"), lambda x: cell(F.col("class") - 1, x, 1, F.col("block"), 1))
    cells = rows.select("key", "n", "bits", F.explode(F.concat(own, mine, up, down)).alias("cell")).select("key", "n", "bits", "cell.*")

    def run(cell: pa.Table) -> pa.Table:
        keys, sizes, side = (np.asarray(cell[c].to_numpy()) for c in ("key", "n", "side"))
        bits = np.frombuffer(b"".join(cell["bits"].to_pylist()), "<u8").reshape(len(keys), -1)
        left = side == 0
        alone = cell["kind"][0].as_py() == 0 and cell["x"][0].as_py() == cell["y"][0].as_py()
        if not alone and left.all():
            i = j = np.empty(0, np.int64)
        elif alone:
            i, j = block_links(bits, None, radius, similarity, sizes, None)
        else:
            i, j = block_links(bits[left], bits[~left], radius, similarity, sizes[left], sizes[~left])
            keys = np.concatenate([keys[left], keys[~left]])
        release()
        return pa.table({"u": pa.array(keys[i]), "v": pa.array(keys[j])})

    return cells.groupBy("class", "x", "kind", "y").applyInArrow(run, "u long, v long").distinct()


def agreeing(sets: list[np.ndarray], bits: np.ndarray, label: np.ndarray, radius: int, similarity: float) -> tuple[list[int], list[int]]:
    """Pairs within the radius whose shingle sets have the similarity: as many as join all that such pairs join.

    Rows that have a label in common are joined already; a pair is only looked at if its rows aren't.
    """
    sizes, label = np.array([len(x) for x in sets], np.int64), label.copy()
    us, vs = [], []
    for p in range(0, len(sets), WIDE_TILE):
        for q in range(p, len(sets), WIDE_TILE):
            i, j = near_pairs(bits[p : p + WIDE_TILE], bits[q : q + WIDE_TILE], radius)
            i, j = i + p, j + q
            fits = (i < j) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]))
            i, j = i[fits], j[fits]
            while len(i):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                # one pair a row, then those that are still apart
                now = np.unique(i, return_index=True)[1]
                for a, b in zip(i[now].tolist(), j[now].tolist(), strict=True):
                    if label[a] == label[b]:
                        continue
                    few, many = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
                    both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                    if both / (len(few) + len(many) - both) >= similarity:
                        us.append(a)
                        vs.append(b)
                        label[label == label[b]] = label[a]
                i, j = np.delete(i, now), np.delete(j, now)
    return us, vs


def agreed(rows: DataFrame, by: list[str], radius: int, similarity: float) -> DataFrame:
    """Edges u, v that `agreeing` finds within each group of rows (key, bits, set, label)."""

    def run(cell: pa.Table) -> pa.Table:
        keys, label = (np.asarray(cell[c].to_numpy()) for c in ("key", "label"))
        bits = np.frombuffer(b"".join(cell["bits"].to_pylist()), "<u8").reshape(len(keys), -1)
        u, v = agreeing([np.frombuffer(x, "<u8") for x in cell["set"].to_pylist()], bits, label, radius, similarity)
        release()
        return pa.table({"u": pa.array(keys[u], pa.int64()), "v": pa.array(keys[v], pa.int64())})

    return rows.select(*by, "key", "bits", "set", "label").groupBy(*by).applyInArrow(run, "u long, v long")


def labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with the component that the edges give their key as their label."""
    named = components(edges).select(F.col("node").alias("key"), F.col("root").alias("_label"))
    return rows.drop("label").join(named, "key", "left").withColumn("label", F.coalesce("_label", "key")).drop("_label")


def dealt(kept: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes (key, n) of candidate groups (key, root) dealt to blocks: key, weight, crowd, block.

    Groups that a task can hold are whole in a block, many to one, and their crowd is null; others are many blocks.
    """
    rows = written(kept.join(nodes.select("key", "n"), "key").withColumn("weight", F.col("n") + ROW).drop("n"), "dedup-groups")
    bins = max(1, -(-2 * (rows.agg(F.sum("weight")).first()[0] or 0) // SETS))
    # there are at most as many as the weight of all rows has multiples of SETS
    large = rows.groupBy("root").agg(F.sum("weight").alias("w")).where(F.col("w") > SETS).select("root", F.ceil(F.col("w") / SETS).alias("cuts"))
    rows = rows.join(F.broadcast(written(large, "dedup-large")), "root", "left")
    block = F.when(F.col("cuts").isNull(), F.pmod(F.xxhash64("root", F.lit(3)), F.lit(bins))).otherwise(F.pmod(F.xxhash64("key", F.lit(4)), F.col("cuts")))
    return rows.select("key", "weight", F.when(F.col("cuts").isNotNull(), F.col("root")).alias("crowd"), block.cast("long").alias("block"))


def confirmed(sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Edges u, v that join all whose sets have the similarity, of rows that are `dealt` and have bits and a set.

    Rows of a block first. In groups of many blocks, then one row of each component found so far; what is still apart then
    meets by pairs of blocks, those of one component only left out.
    """
    edges = written(agreed(sets.withColumn("label", F.col("key")), ["crowd", "block"], radius, similarity), "dedup-edges")
    crowds = sets.where("crowd is not null")
    if crowds.isEmpty():
        return edges
    crowds = written(labelled(crowds, edges), "dedup-crowds")
    first = crowds.where("key = label")
    cuts = first.groupBy("crowd").agg(F.ceil(F.sum("weight") / SETS).alias("cuts"))
    first = first.join(F.broadcast(written(cuts, "dedup-cuts")), "crowd").withColumn("block", F.pmod(F.xxhash64("key", F.lit(5)), F.col("cuts")))
    edges = written(edges.unionByName(agreed(first, ["crowd", "block"], radius, similarity)), "dedup-edges")
    crowds = labelled(crowds, edges)
    # a component that fills blocks has blocks of its own
    weights = written(crowds.groupBy("crowd", "label").agg(F.sum("weight").alias("w")), "dedup-weights")
    apart = weights.groupBy("crowd").count().where(F.col("count") > 1).select("crowd")
    weights = weights.join(F.broadcast(apart), "crowd")
    if weights.isEmpty():
        return edges
    half = SETS // 2
    large = written(weights.where(F.col("w") > half).select("crowd", "label", F.col("label").alias("own")), "dedup-own")
    cuts = weights.join(F.broadcast(large), ["crowd", "label"], "left").groupBy("crowd", "own").agg(F.ceil(F.sum("w") / half).alias("cuts"))
    cuts = written(cuts, "dedup-cuts")
    name = F.concat_ws(":", F.coalesce(F.col("own").cast("string"), F.lit("-")), F.col("cut").cast("string")).alias("block")
    blocks = cuts.select("crowd", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut")).select("crowd", "own", name)
    other = blocks.select("crowd", F.col("own").alias("own_b"), F.col("block").alias("block_b"))
    pairs = blocks.join(other, "crowd").where((F.col("block") <= F.col("block_b")) & (F.col("own").isNull() | F.col("own_b").isNull() | (F.col("own") != F.col("own_b"))))
    pair = F.concat_ws("|", "block", "block_b").alias("pair")
    ends = pairs.select("crowd", "block", pair).unionByName(pairs.select("crowd", F.col("block_b").alias("block"), pair)).distinct()
    rows = crowds.drop("block").join(F.broadcast(large), ["crowd", "label"], "left").join(F.broadcast(cuts.withColumnRenamed("own", "_own").withColumnRenamed("crowd", "_crowd")), (F.col("crowd") == F.col("_crowd")) & F.col("own").eqNullSafe(F.col("_own")))
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("key", F.lit(6)), F.col("cuts"))).select("crowd", name, "key", "bits", "set", "label").join(ends, ["crowd", "block"])
    return written(edges.unionByName(agreed(rows, ["crowd", "pair"], radius, similarity)), "dedup-edges")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 64, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; all columns.

    Groups are connected by links: a link is a Jaccard similarity of the sets of `words`-word shingles of at least
    `similarity`, which is computed over the whole sets. Pairs it is computed for have sizes that allow it and fingerprints,
    of 256 bits, within the radius: at a similarity of 0.8 the expected distance is 39 with a deviation of 6 (48 for texts
    of 4 and 5 shingles), and texts without common passages are at 128 with a deviation of 8. Rows with equal words in
    order are one group from the start.
    """
    identity = F.xxhash64(F.col(id_col), F.col(text_col))

    def run(batches):
        for batch in slices(batches):
            made = [wide_fingerprint(x or "", words, seed) for x in batch.column(2).to_pylist()]
            key = pa.array(np.array([m[0] for m in made], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), key, pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary())], names=["row", "id", "key", "n", "bits"])

    rows = docs.select(identity.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(run, "row long, id long, key long, n long, bits binary"), "dedup-rows")
    # null ids come last; equal rows share the identity
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = written(rows.groupBy("key").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), first), "dedup-nodes")
    groups = components(wide_links(nodes.select("key", "n", "bits"), radius, similarity)).withColumnRenamed("node", "key")
    groups = written(dealt(groups, nodes), "dedup-dealt")

    def sets(batches):
        for batch in slices(batches):
            made = [shingles(x or "", words, seed)[1].astype("<u8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "set"])

    wanted = groups.join(nodes.select("key", "bits", F.col("first.row").alias("row")), "key")
    found = docs.select(identity.alias("row"), F.col(text_col).cast("string").alias("text")).join(wanted.select("row", "key"), "row").select("key", "text")
    # rows that are all alike share the identity: one set is enough
    found = found.mapInArrow(sets, "key long, set binary").groupBy("key").agg(F.min("set").alias("set"))
    found = written(wanted.drop("row").join(found, "key"), "dedup-sets")
    roots = components(confirmed(found, radius, similarity))
    kept = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    kept = written(kept.select(F.col("first.row").alias("_row")), "dedup-kept")
    key, again = unused(docs, "_row"), unused(docs, "_again")
    once = Window.partitionBy(key).orderBy(F.lit(0))
    out = docs.withColumn(key, identity).join(kept.withColumnRenamed("_row", key), key, "left_semi").withColumn(again, F.row_number().over(once))
    return out.where(F.col(again) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
