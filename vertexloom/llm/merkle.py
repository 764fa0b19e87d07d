"""Document fingerprints: Merkle trees over sections and paragraphs, in built-in functions only.

A text is cut into sections (at blank lines), these into paragraphs (lines), these into passages (sentences, and stretches
of a bounded length where there is no sentence end). A leaf is the hash of a passage with its length in code points, a
paragraph's hash is over its leaves, a section's over its paragraphs, the root over the sections' hashes. The whole tree is
a text:

    root "|" section ("|" section)*    section = hash "{" paragraph (";" paragraph)* "}"    paragraph = hash "[" leaves "]"

Behind the tree of a short text, "#[" leaves "]" has leaves of finer passages, since an edit may leave none of the others.

Hashes are SHA-256: the root whole, those below it to 128 bits. Equal roots mean equal texts; where roots differ, sections
whose hash the other tree doesn't have, and below them paragraphs and leaves, are where the edit is. Likeness is the share
of both texts, in code points over leaves, that lies in leaves both have, each as often as both have it; of two short
texts over the finer leaves. `summary` is the
tree's top, the root and the sections' hashes, which is short beside the text; a query returns it as the fingerprint.

A document's neighbour is the row with the next larger id, and the first one's for the last. Rows are dealt to ranges of
ids, which are halved until none holds many rows, and by a hash of the text where one id has many, so that a window never
spans more than a range; the first row of each range is copied to the range before it.

Null texts are the empty text, whose tree has no leaf. The likeness of equal texts is 1, and less than 1 for any
others. Rows that repeat an id follow one another in the order of their texts' hashes. Null ids come first. One row alone
is its own neighbour. An empty table gives no rows. Columns besides id and text aren't looked at, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Ranges of ids at most, about; the first rows of all ranges are broadcast, 40 bytes each.
RANGES = 100_000
#: Rows in a range, about; a range is cut again beyond so many times that.
RANGE_ROWS, CROWDED = 256, 8
#: A passage: up to so many code points without a sentence end, with the marks and spaces that end it; finer ones, and the
#: code points below which a text has them too.
PASSAGE, FINE, SHORT = "(?s)[^.!?]{0,48}+[.!?]*+\\s*+", "(?s)[^.!?]{0,8}+[.!?]*+\\s*+", 256
LEAF, PARAGRAPH = "(?<=[\\[,])[0-9a-f]{32}:[0-9]+", "(?<=[{;])[0-9a-f]{32}\\[[^\\]]*\\]"


def digits(c):
    """128 bits of the hash, as hex digits."""
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(32))


def bound(value, use):
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(text):
    """The tree of a text column (not null), as text."""
    leaf = lambda p: F.concat(digits(p), F.lit(":"), F.char_length(p))
    # the pattern matches the empty string at the end of each paragraph, which is no leaf
    passages = lambda p, pattern=PASSAGE: F.filter(F.regexp_extract_all(p, F.lit(pattern), 0), lambda x: x != "")
    over = lambda children, left, right: bound(children, lambda c: F.concat(digits(c), F.lit(left), c, F.lit(right)))
    paragraph = lambda p: over(F.array_join(F.transform(passages(p), leaf), ","), "[", "]")
    section = lambda s: over(F.array_join(F.transform(F.split(s, "\n"), paragraph), ";"), "{", "}")
    parts = F.transform(F.split(text, "\n(?=\n)"), section)
    fine = F.concat(F.lit("#["), F.array_join(F.transform(passages(text, FINE), leaf), ","), F.lit("]"))
    return bound(parts, lambda x: F.concat(root_of(heads(x)), F.lit("|"), F.array_join(x, "|"), F.when(F.char_length(text) < SHORT, fine).otherwise("")))


def tree(print_):
    return F.substring_index(print_, "#", 1)


def heads(parts):
    """The hashes of an array of sections."""
    return F.transform(parts, lambda s: F.substring_index(s, "{", 1))


def sections(print_):
    """The sections of a tree, in order."""
    return F.filter(F.split(tree(print_), "\\|"), lambda s: F.contains(s, F.lit("{")))


def root_of(hashes):
    """The whole hash over the sections' hashes."""
    return F.sha2(F.array_join(hashes, ",").cast("binary"), 256)


def summary(print_):
    """The root and the sections' hashes."""
    return F.concat_ws("|", root(print_), F.array_join(heads(sections(print_)), "|"))


def root(print_):
    return F.substring_index(print_, "|", 1)


def leaves(print_):
    """The leaves of a tree, each with the number of its occurrence before it, so that all are different."""
    return numbered(tree(print_))


def fine_leaves(print_):
    """The same of the finer leaves of a short text."""
    return numbered(F.substring_index(print_, "#", -1))


def numbered(part):
    found = F.array_sort(F.regexp_extract_all(part, F.lit(LEAF), 0))
    starts = lambda v: F.filter(F.transform(v, lambda x, i: F.when((i == 0) | (F.get(v, i - 1) != x), i)), lambda i: i.isNotNull())
    run = lambda v, s: lambda at, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(s, k + 1), F.size(v)) - at), lambda n: F.concat(n.cast("string"), F.lit("*"), F.get(v, at)))
    return bound(found, lambda v: bound(starts(v), lambda s: F.flatten(F.transform(s, run(v, s)))))


def length(found):
    """Code points in an array of leaves."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + F.substring_index(x, ":", -1).cast("long"))


def likeness(one, two, one_leaves, two_leaves):
    """Of two fingerprints with their leaves, from 0 to 1; 1 only for equal roots."""
    def share(x, y):
        both = length(x) + length(y)
        return F.when(both > 0, 2.0 * length(F.array_intersect(x, y)) / both).otherwise(0.0)

    short = F.contains(one, F.lit("#")) & F.contains(two, F.lit("#"))
    found = F.when(short, share(fine_leaves(one), fine_leaves(two))).otherwise(share(one_leaves, two_leaves))
    return F.when(root(one) == root(two), 1.0).otherwise(F.least(found, F.lit(0.999999)))


def changed_sections(one, two):
    """Sections of the first fingerprint that the second doesn't have."""
    return F.array_except(sections(one), sections(two))


def changed_paragraphs(one, two):
    """Paragraphs of the changed sections that the second fingerprint doesn't have: where the edit is."""
    return F.array_except(F.regexp_extract_all(F.array_join(changed_sections(one, two), "|"), F.lit(PARAGRAPH), 0), F.regexp_extract_all(tree(two), F.lit(PARAGRAPH), 0))


def changed_leaves(one, two):
    """Leaves of the changed paragraphs that the second fingerprint doesn't have."""
    return F.array_except(F.regexp_extract_all(F.array_join(changed_paragraphs(one, two), ";"), F.lit(LEAF), 0), F.regexp_extract_all(tree(two), F.lit(LEAF), 0))


def dealt(rows: DataFrame) -> DataFrame:
    """rows (id, text, tie) with part, a range of (id, tie) that holds few rows; parts are in order as their rows are.

    A range is the ids that are alike down to bit `s`. It begins with the bits that all ids share, and what is crowded is
    cut again, by the bits that its own ids don't share; that takes a round for each sort of gap between ids.
    """
    none = F.col("id").isNull()
    number = F.coalesce("id", F.lit(0).cast("long"))
    rows = rows.withColumns({"none": none, "number": number})
    least, most, n = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    target = max(RANGE_ROWS, -(-n // RANGES))
    differ = (least ^ most).bit_length() if least is not None and (least < 0) == (most < 0) else 64 if least is not None else 0
    begin = min(63, max(0, differ - ceil(log2(max(1, n / target)))))
    rows = rows.withColumns({"s": F.lit(begin), "key": F.shiftright("number", begin), "sub": F.lit(None).cast("long")})
    cell = ["none", "s", "key", "sub"]
    while True:
        cells = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.min("number").alias("a"), F.max("number").alias("b"), F.min("tie").alias("c"), F.max("tie").alias("d"))
        # as many bits less as it takes, by the count, from the highest bit in which ids differ; then of the ties
        less = F.ceil(F.log2(F.col("n") / target)).cast("int")
        bits = lambda x, y: F.when(F.col(x) == F.col(y), 0).otherwise(F.length(F.bin(F.col(x).bitwiseXOR(F.col(y)))))
        cells = cells.where((F.col("n") > CROWDED * target) & ((F.col("a") < F.col("b")) | F.col("sub").isNull() & (F.col("c") < F.col("d"))))
        cells = cells.select(*[F.col(c).alias(f"_{c}") for c in cell], F.when(F.col("a") < F.col("b"), F.greatest(F.lit(0), F.least(F.lit(63), bits("a", "b")) - less)).alias("_to"), F.greatest(F.lit(0), F.least(F.lit(63), bits("c", "d")) - less).alias("_tie"))
        # one in CROWDED x target rows at most
        crowded = written(cells, "merkle-crowded")
        if crowded.isEmpty():
            break
        same = (F.col("none") == F.col("_none")) & (F.col("s") == F.col("_s")) & (F.col("key") == F.col("_key")) & F.col("sub").eqNullSafe(F.col("_sub"))
        rows = rows.join(F.broadcast(crowded), same, "left")
        s = F.coalesce("_to", "s")
        sub = F.when(F.col("_s").isNotNull() & F.col("_to").isNull(), F.expr("shiftright(tie, _tie)")).otherwise(F.col("sub"))
        rows = rows.withColumns({"s": s, "sub": sub}).withColumn("key", F.expr("shiftright(number, s)")).drop("_none", "_s", "_key", "_sub", "_to", "_tie")
    # null ids first; the first number of a range is its place
    part = F.struct((~F.col("none")).alias("some"), F.expr("shiftleft(key, s)").alias("from"), F.coalesce("sub", F.lit(0).cast("long")).alias("sub"))
    return rows.select("id", "text", "tie", part.alias("part"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, next: each row with the text of the row that follows by id, the last with the first's."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = dealt(rows.withColumn("tie", F.xxhash64("text")))
    firsts = rows.groupBy("part").agg(F.min(F.struct("id", "tie")).alias("first"))
    order = Window.orderBy("part")  # a row for each range
    last = Window.partitionBy()
    # the range before: cyclic, so the first range's first row goes behind the last range
    firsts = firsts.withColumn("to", F.coalesce(F.lag("part").over(order), F.max("part").over(last)))
    firsts = written(firsts.select("part", F.col("first.id").alias("first_id"), F.col("first.tie").alias("first_tie"), "to"), "merkle-firsts")
    at_first = (rows["part"] == firsts["part"]) & rows["id"].eqNullSafe(firsts["first_id"]) & (rows["tie"] == firsts["first_tie"])
    # at most about RANGES rows, by the choice of ranges
    copies = rows.join(F.broadcast(firsts), at_first).select(rows["id"], "text", F.col("to").alias("part"), "tie", F.lit(True).alias("copy"))
    # equal rows may be first together: one copy is enough
    copies = copies.dropDuplicates(["part"])
    spread = rows.select("id", "text", "part", "tie", F.lit(False).alias("copy")).unionByName(copies)
    within = Window.partitionBy("part").orderBy("copy", "id", "tie")
    return spread.withColumn("next", F.lead("text").over(within)).where(~F.col("copy")).select("id", "text", "next")


def edited(text, following):
    """text with its last quarter replaced by the beginning of the one that follows."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Each document with the top of its tree and of that of its edited text, and the likeness of its tree to that of the
    edited text and of the next document."""
    rows = with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next")))
    rows = rows.select(
        F.col("id").alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("edit"), fingerprint(F.col("next")).alias("next"),
    )
    rows = rows.withColumns({"a": leaves("own"), "b": leaves("edit"), "c": leaves("next")})
    near = lambda x, y: likeness(F.col("own"), F.col(x), F.col("a"), F.col(y))
    return rows.select("doc_id", "n_chars", "edited_sha256", summary(F.col("own")).alias("fingerprint"), summary(F.col("edit")).alias("edited_fingerprint"), near("edit", "b").alias("near_edited"), near("next", "c").alias("near_next"))
