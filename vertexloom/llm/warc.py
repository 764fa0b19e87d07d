"""WARC archives: writing with deduplicated payloads, and reading by boundary-chain verification.

Writing uses Spark's text sink with the record separator of the format, so any store, task retries and commits work as
for other tables. Reading uses the text source with the record magic as the separator, so archives are split over tasks
and no task holds a file. Every place where the magic stands is a candidate: the task that meets it parses a header and
emits the offset and the offset of the successor, as the header's Content-Length has it. A payload may hold the magic,
even with a whole header, so a candidate counts only if the chain from the start of its file reaches it. Candidates that
follow one another are first contracted to runs (one a file if no payload holds the magic), then pointer jumping over
the runs doubles the distance each round, and what isn't reached is dropped.

Null payloads are written as empty ones; equal payloads shorter than the least size stay responses. Rows that repeat an
id and its payload are all responses. A null id is written as an empty one and read as null; among equal payloads it is
never the first, unless all ids are null, then all are responses. An empty table gives an empty archive and no rows.
Columns other than the three named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table, written

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
#: Repeated payloads that are broadcast to the writers at most (about 100 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 100_000
DATE = "1970-01-01T00:00:00Z"


def write_archive(pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html", least: int = 100, date: str = DATE) -> None:
    """Writes a record per row under `path`; of equal payloads of at least `least` bytes the smallest id is the response."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    again = written(rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "warc-again")
    few = again.limit(BROADCAST_ROWS + 1).count()
    if few:
        rows = rows.join(F.broadcast(again) if few <= BROADCAST_ROWS else again, "digest", "left")
    else:
        rows = rows.withColumn("first", F.lit(None).cast("long"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))

    def field(name, value, when=None):
        line = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return line if when is None else F.when(when, line).otherwise(F.lit(""))

    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", urn(F.col("id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", ""), F.col("url").isNotNull()),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        field("WARC-Refers-To", urn(F.col("first")), revisit),
        field("X-Payload-Length", F.col("size").cast("string")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, by file, block of the file that was read, and place in it."""
    rows = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, next, and the header's fields, for each place with the magic and a header that can be read."""
    header = F.substring_index("value", END, 1)

    def get(name):
        return F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1)

    found = segments(spark, path).withColumn("header", F.when(F.instr("value", END) > 0, header))
    found = found.withColumns({"size": F.octet_length("value").cast("long"), "head": F.octet_length("header").cast("long"), "length": F.expr(r"try_cast(nullif(regexp_extract(header, '(?im)^Content-Length:[ \t]*(\\d{1,18})[ \t]*$', 1), '') as bigint)")})
    whole = F.col("size") >= F.col("head") + 8 + F.col("length")
    digest = F.when(whole, F.sha2(F.expr("substring(cast(value as binary), cast(head + 5 as int), cast(length as int))"), 256))
    found = found.select(
        "file", "block", "place", "size", "head", "length", get("WARC-Type").alias("kind"), get("WARC-Record-ID").alias("id"), get("WARC-Refers-To").alias("refers"),
        F.expr("try_cast(regexp_extract(header, '(?im)^X-Payload-Length:[ \\t]*(\\\\d+)', 1) as bigint)").alias("payload_size"), F.regexp_extract("header", r"(?im)^WARC-Payload-Digest:[ \t]*sha256:([0-9a-f]{64})", 1).alias("payload_digest"), whole.alias("whole"), digest.alias("digest"),
    )
    found = written(found, "warc-candidates")
    taken = F.col("size") + len(MAGIC)
    blocks = found.groupBy("file", "block").agg(F.sum(taken).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("gone", F.coalesce(F.sum(taken).over(within), F.lit(0))).join(blocks, ["file", "block"])
    found = found.withColumn("offset", F.col("start") + F.col("gone") - len(MAGIC)).drop("start", "gone")
    return found.withColumn("next", F.col("offset") + len(MAGIC) + F.col("head") + 4 + F.col("length") + 4)


def chained(found: DataFrame) -> DataFrame:
    """The candidates that the chain from offset 0 of their file reaches."""
    order = Window.partitionBy("file").orderBy("offset")
    valid = found.where("offset >= 0 and length is not null")
    heads = valid.withColumn("start", F.coalesce(F.lag("next").over(order) != F.col("offset"), F.lit(True)).cast("long"))
    runs = written(heads.withColumn("run", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("start"), "warc-runs")
    exits = runs.groupBy("file", "run").agg(F.max("next").alias("offset"))
    jump = written(exits.join(runs.select("file", "offset", F.col("run").alias("to")), ["file", "offset"]).select("file", "run", "to", F.col("offset").alias("entry")), "warc-jumps")
    reached = runs.where("offset = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))
    while not jump.isEmpty():
        step = reached.join(jump.select("file", "run", "to", F.col("entry").alias("at")), ["file", "run"]).select("file", F.col("to").alias("run"), F.col("at").alias("entry"))
        reached = written(reached.unionByName(step).distinct(), "warc-reached")
        after = jump.select("file", F.col("run").alias("to"), F.col("to").alias("over"), F.col("entry").alias("at"))
        jump = written(jump.join(after, ["file", "to"]).select("file", "run", F.col("over").alias("to"), F.col("at").alias("entry")), "warc-jumps")
    return runs.join(reached, ["file", "run"]).where("offset >= entry").drop("run", "entry")


def rejoined(spark: SparkSession, path: str, found: DataFrame, spread: DataFrame) -> DataFrame:
    """file, offset and digest of records whose payloads hold the magic: their segments are put together again."""
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marks = found.select("file", "block", "place", F.col("offset").alias("at")).join(spread.select("file", F.col("offset").alias("at"), F.col("offset").alias("own"), F.col("next").alias("to")), ["file", "at"], "left")
    marks = marks.withColumns({"own": F.last("own", True).over(order), "to": F.last("to", True).over(order)}).where("at < to and own is not null")
    parts = segments(spark, path).join(marks, ["file", "block", "place"])
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC)
    parts = parts.groupBy("file", F.col("own").alias("offset")).agg(whole.alias("value")).join(spread.select("file", "offset", "head", "length"), ["file", "offset"])
    return parts.select("file", "offset", F.sha2(F.expr("substring(cast(value as binary), cast(head + 5 as int), cast(length as int))"), 256).alias("joined"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, file, record_offset of each record."""
    found = candidates(spark, path)
    records = chained(found)
    spread = records.where("not whole")
    if not spread.isEmpty():
        records = records.join(rejoined(spark, path, found, spread), ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "joined")).drop("joined")
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?\\\\d*)>', 1), '') as bigint)")
    again = F.col("kind") == "revisit"
    return records.select(
        number("id").alias("page_id"), F.when(again, F.col("payload_size")).otherwise(F.col("length")).alias("payload_bytes"), F.when(again, F.col("payload_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(again, number("refers")).alias("refers_to"), F.col("file").alias("archive"), F.col("offset").alias("record_offset"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).drop("archive", "record_offset")


OP2_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
     f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
