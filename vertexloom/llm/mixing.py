"""Mixing sources to target weights by Pareto order sampling.

Each source has a target size: its share, by weight, of a multiple of all sizes, at most a limit times its own size, the
excess going to the others by weight. A document is wanted target / size-of-source times: the whole part is allocated as
certain copies, the rest is sampled. Inclusion odds are unequal: longer documents are favoured over short ones, by classes
of length, and a factor for each source brings the expected words to what is wanted of it. Documents are ranked by random
odds u / (1 - u) over their inclusion odds, u being a hash of id, text and a seed, and the first are taken. The sample's
fixed size is in words, as the targets are, so the cut lies where the words taken come nearest to what is wanted.

No task holds a source: ranks are whole numbers, which are summed by their first bits, then, where the cut lies, by the
next ones, until few are left. Sources, of which there may be many, stay a table; targets come from running sums over it.
Rows alike in id, text and source share a rank; if the cut lies among them, as many of them are taken as it needs, whichever.
Null texts have size 0, null sources are one source, which comes last; null and equal ids are as good as any, as the text
takes part in the hash. Further columns aren't looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import running_sum, with_positions
from .common import table, unused, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a rank, bits that are looked at in a round, and rows of a source (or distinct ranks) that a task may look through.
RANK_BITS, ROUND_BITS, EDGE = 52, 12, 1 << 16
#: A document of so many words has half the odds of an endless one; a longest class of length.
FAVOUR, LONGEST = 64.0, 40


def targets(sources: DataFrame, weights: list[float], total_share: float, limit: float) -> DataFrame:
    """source, source_size, target, from source and source_size: water filling in closed form.

    A source is capped if its cap is below its weight's share of what the sources with larger caps per weight have left;
    in order of cap per weight these come first, so one running sum finds the level.
    """
    sources = written(sources, "mix-sources")
    by_name, by_cap = (F.col("source").isNull(), F.col("source")), (F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    # few rows are cheapest in one task; the places and sums are the same
    few = sources.count() <= EDGE
    place = lambda df, order: df.withColumn("k", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")) if few else with_positions(df, *order, name="k")
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda df, c, name: df.withColumn(name, F.coalesce(F.sum(c).over(before), F.lit(0.0))) if few else running_sum(df, "k", c, name, kind="double")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    rows = place(sources, by_name).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit))).drop("k")
    rows = written(total(total(place(rows, by_cap), "cap", "caps"), "weight", "above"), "mix-filled")
    size, weighs = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(total_share)) * F.lit(float(size or 0)) - F.col("caps")) / (F.lit(weighs or 0.0) - F.col("above"))
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    found = rows.agg(F.min_by("level", F.when(F.col("level").isNotNull(), F.col("k")))).first()[0]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.lit(found).cast("double") * F.col("weight"), F.col("cap"))).alias("target"))


def class_of(size):
    """The class of length: the logarithm of the size."""
    return F.least(F.lit(LONGEST), F.floor(F.log2(size + 1))).cast("int")


def favour(kind):
    """What a class's odds are, among others of the source."""
    longest = F.pow(F.lit(2.0), kind)
    return longest / (longest + FAVOUR)


def expected(factor, classes):
    """Words that a source's classes (kind, words) give if odds are this factor times what favours them."""
    odds = lambda c: factor * favour(c["kind"])
    return F.aggregate(classes, F.lit(0.0), lambda n, c: n + c["words"] * odds(c) / (1 + odds(c)))


def factor_for(wanted, classes):
    """The factor at which `expected` is what is wanted, by halving an interval of its logarithm."""
    middle = lambda x: (x["low"] + x["high"]) / 2
    few = lambda x: expected(F.exp(middle(x)), classes) < wanted
    half = lambda x, _: F.struct(F.when(few(x), middle(x)).otherwise(x["low"]).alias("low"), F.when(few(x), x["high"]).otherwise(middle(x)).alias("high"))
    return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-60.0).alias("low"), F.lit(60.0).alias("high")), half, middle))


def _rank(u, odds):
    """Random odds over inclusion odds as a whole number of RANK_BITS bits, null where there is nothing to sample."""
    ratio = (u / (1 - u)) / odds
    most = float(1 << RANK_BITS)
    return F.when(odds > 0, F.least(F.lit(most - 1), F.floor(ratio / (1 + ratio) * most)).cast("long"))


def _cuts(rows: DataFrame) -> DataFrame:
    """of, cut, some, same: where the cut of each source lies, and how many of the rows with that rank are taken, of how many.

    rows: source, size, rank, wanted. Sources from which all or nothing is taken aren't there.
    """
    shift = RANK_BITS - ROUND_BITS
    rows = rows.where("rank is not null").withColumns({"gone": F.lit(0).cast("long")})
    while True:
        key = F.shiftright("rank", shift)
        sums = rows.groupBy("source", key.alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("wanted").alias("wanted"), F.first("gone").alias("gone"))
        before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("gone", F.col("gone") + F.coalesce(F.sum("words").over(before), F.lit(0)))
        sums = sums.where("gone < wanted and gone + words >= wanted")
        if not shift:
            break
        at = written(sums.select(F.col("source").alias("of"), F.col("bin").alias("_bin"), F.col("gone").alias("_gone"), F.col("n").alias("_n")), "mix-bins")
        rows = rows.join(at, rows["source"].eqNullSafe(at["of"]) & (key == at["_bin"])).select("source", "size", "rank", "wanted", F.col("_gone").alias("gone"))
        # what is left is few rows for each source, or as many bits more are looked at
        shift = 0 if (at.agg(F.max("_n")).first()[0] or 0) <= EDGE else max(0, shift - ROUND_BITS)
    # rows with one rank are as long as one another; a row is taken if half of it or more lies below what is wanted
    each = F.greatest(F.col("words") / F.col("n"), F.lit(1e-9))
    some = F.least(F.col("n"), F.floor((F.col("wanted") - F.col("gone")) / each + 0.5))
    return written(sums.select(F.col("source").alias("of"), F.col("bin").alias("cut"), some.alias("some"), F.col("n").alias("same")), "mix-cut")


def with_copies(docs: DataFrame, weights=(5.0, 2.0, 1.0), total_share: float = 1.5, limit: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """docs with size, source_size, target, odds (of one more copy than is certain), and copies, and these columns' names.

    Rows aren't shuffled, unless a source's cut lies among rows that are alike: these are dealt out, by no key.
    """
    names = {n: unused(docs, f"_{n}") for n in ("size", "source_size", "target", "odds", "copies", "rank", "u", "of", "salt")}
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    # u lies strictly between 0 and 1
    u = (F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = written(docs.select(size.alias("size"), source.alias("source"), u.alias("u")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = targets(sizes, list(weights), total_share, limit)
    plan = plan.withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("sure", F.floor(F.col("times") + 1e-12))
    plan = plan.withColumn("wanted", F.when(F.col("times") - F.col("sure") > 1e-12, F.col("target") - F.col("sure") * F.col("source_size")).otherwise(0.0))
    # at most LONGEST + 1 classes for each source
    classes = rows.groupBy("source", class_of(F.col("size")).alias("kind")).agg(F.sum("size").alias("words"))
    classes = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("kind", "words"))).alias("classes")).withColumnRenamed("source", "of")
    plan = plan.join(classes, plan["source"].eqNullSafe(classes["of"])).drop("of")
    plan = plan.withColumn("factor", F.when(F.col("wanted") > 0, factor_for(F.col("wanted"), F.col("classes"))))
    plan = written(plan.select(F.col("source").alias("of"), "source_size", "target", "sure", "wanted", "factor"), "mix-plan")
    odds = lambda n: F.coalesce(F.col("factor") * favour(class_of(n)), F.lit(0.0))
    ranked = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).select("source", "size", "wanted", _rank(F.col("u"), odds(F.col("size"))).alias("rank"))
    cuts = _cuts(ranked)
    plan = written(plan.join(cuts.withColumnRenamed("of", "_of"), plan["of"].eqNullSafe(F.col("_of")), "left").drop("_of"), "mix-plan")

    # the plan's columns get names that docs don't have
    own = plan.select(*[F.col(c).alias(names["of"] if c == "of" else f"{names['of']}_{c}") for c in plan.columns])
    at = lambda c: F.col(f"`{names['of']}_{c}`")
    col = lambda n: F.col(f"`{names[n]}`")
    out = docs.withColumns({names["size"]: size, names["u"]: u}).join(own, source.eqNullSafe(F.col(f"`{names['of']}`")))
    out = out.withColumn(names["odds"], F.coalesce(at("factor") * favour(class_of(col("size"))), F.lit(0.0)))
    out = out.withColumn(names["rank"], _rank(col("u"), col("odds")))
    chance = col("odds") / (1 + col("odds"))
    among = (col("rank") == at("cut")) & (at("some") > 0) & (at("some") < at("same"))
    more = F.when(col("rank").isNull(), 0).when(at("cut").isNull(), (at("wanted") > 0).cast("int")).otherwise(((col("rank") < at("cut")) | (col("rank") == at("cut")) & (at("some") > 0)).cast("int"))
    done = lambda df, n: df.select(*[F.col(f"`{c}`") for c in docs.columns], col("size"), at("source_size").alias(names["source_size"]), at("target").alias(names["target"]), chance.alias(names["odds"]), (at("sure") + n).cast("int").alias(names["copies"]))
    kept = {n: names[n] for n in ("size", "source_size", "target", "odds", "copies")}
    split = cuts.where("some > 0 and some < same").agg(F.max("same")).first()[0]
    if split is None:
        return done(out, more), kept
    # rows that are alike, of which some are taken: dealt out as they come, then so many of each lot
    lots = -(-split // EDGE)
    alike = written(out.where(among).withColumn(names["salt"], F.pmod(F.monotonically_increasing_id(), F.lit(lots))), "mix-alike")
    lot = alike.groupBy(names["of"], names["salt"]).agg(F.count("*").alias("n"))
    before = Window.partitionBy(names["of"]).orderBy(names["salt"]).rowsBetween(Window.unboundedPreceding, -1)
    lot = lot.select(F.col(f"`{names['of']}`").alias(names["rank"] + "of"), F.col(f"`{names['salt']}`").alias(names["rank"] + "salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(names["rank"] + "before"))
    alike = alike.join(lot, col("of").eqNullSafe(F.col(f"`{names['rank']}of`")) & (col("salt") == F.col(f"`{names['rank']}salt`")))
    number = F.row_number().over(Window.partitionBy(names["of"], names["salt"]).orderBy(F.lit(0))) + F.col(f"`{names['rank']}before`")
    alike = alike.withColumn(names["u"], (number <= at("some")).cast("int"))
    return done(out.where(~F.coalesce(among, F.lit(False))), more).unionByName(done(alike, col("u").cast("int"))), kept


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """id, size, source, source_size, target, odds, copies of each row, in which the row's id stays what it was."""
    docs = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`"))
    out, names = with_copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    return out.select(F.col(f"`{id_col}`"), *[F.col(f"`{names['size']}`").alias("size")], F.col(f"`{source_col}`").alias("source"), *[F.col(f"`{names[n]}`").alias(n) for n in ("source_size", "target", "odds", "copies")])


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows as often as the mix takes them, with all their columns."""
    out, names = with_copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    copies = F.col(f"`{names['copies']}`")
    out = out.where(copies > 0).withColumn(names["copies"], F.explode(F.sequence(F.lit(1), copies)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
