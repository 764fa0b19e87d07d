from pyspark.sql import functions as F

from vertexloom.streaming import incremental


def feed(spark, tmp_path, batches, schema):
    """A stream of the batches, one file each, in order."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        part = tmp_path / f"part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{part}")
        next(part.glob("*.parquet")).rename(folder / f"{i:03}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_running_degrees(spark, tmp_path):
    edges = feed(spark, tmp_path, [[(0, 1), (0, 2)], [(0, 3), (4, 1)]], "row int, col int")
    out = run(incremental.running_degrees(edges), "degrees", "complete", tmp_path)
    assert sorted(map(tuple, out.collect())) == [(0, 3), (4, 1)]


def test_gaps_across_batches(spark, tmp_path):
    accesses = feed(spark, tmp_path, [[(0, 0), (1, 40), (2, 1)], [(3, 41), (4, 2), (5, 99)]], "k long, row int")
    out = run(incremental.reuse_gaps(accesses), "gaps", "append", tmp_path)
    assert sorted(map(tuple, out.select("k", "sector", "prev").collect())) == [(0, 0, -1), (1, 1, -1), (2, 0, 0), (3, 1, 1), (4, 0, 2), (5, 3, -1)]


def test_windows_of_event_time(spark, tmp_path):
    rows = [[("2024-01-01 00:00:00", 1, 2), ("2024-01-01 00:01:00", 1, 3)], [("2024-01-01 01:00:00", 1, 2)], [("2024-01-01 03:00:00", 5, 2)]]
    text = feed(spark, tmp_path, rows, "ts string, row int, col int").withColumn("ts", F.to_timestamp("ts"))
    out = run(incremental.windowed_degrees(text), "windows", "append", tmp_path)
    assert sorted((r["id"], r["deg"]) for r in out.collect()) == [(1, 1), (1, 2)]
