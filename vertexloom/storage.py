"""The shared folder of a session, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a folder is made, if all run in one process (a local master, as in tests); on a cluster a folder of
    the driver's machine would be no use to executors, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_vertexloom_shared", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vertexloom-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark._vertexloom_shared = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has; `Scratch` knows of it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for scratch in getattr(spark, "_vertexloom_scratch", ()):
        scratch.paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str, *replaced: DataFrame | None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there and outlives lost executors.

    replaced: tables that this function made and that no plan needs once df is written; their files go.
    """
    spark, path, schema = df.sparkSession, fresh_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._vertexloom_path = path
    for old in replaced:
        drop_written(old)
    return out


def drop_written(df: DataFrame | None) -> None:
    """Deletes the files of a table that `written` made, once no plan needs them; does nothing to others."""
    path = getattr(df, "_vertexloom_path", None)
    if path:
        delete(df.sparkSession, path)


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """One file from the parts of a folder, in the order of their names; bytes are copied as they stream by."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    source, target = at(folder), at(path)
    files, to = source.getFileSystem(conf), target.getFileSystem(conf)
    to.delete(target, True)
    out = to.create(target, True)
    try:
        for name in sorted(n for n in (f.getPath().getName() for f in files.listStatus(source)) if n.startswith("part-")):
            part = files.open(at(source, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()


def write_lines(lines: DataFrame, path: str, *order) -> None:
    """One text file of the column `value` in this order. Parts are sorted and written by all tasks, then joined."""
    spark, parts = lines.sparkSession, f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    lines.orderBy(*order).select("value").write.text(parts)
    join_files(spark, parts, path)
    delete(spark, parts)


def write_bytes(spark: SparkSession, path: str, parts) -> None:
    """One file of the given bytes, each part written as it comes."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for part in parts:
            out.write(part)
    finally:
        out.close()


class Scratch:
    """with Scratch(spark) as scratch: tables written within go at its end, but those that are kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        self.spark._vertexloom_scratch = [*getattr(self.spark, "_vertexloom_scratch", ()), self]
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(getattr(df, "_vertexloom_path", None))
        return df

    def __exit__(self, *_) -> None:
        self.spark._vertexloom_scratch = [s for s in self.spark._vertexloom_scratch if s is not self]
        for path in self.paths:
            if path not in self.kept:
                delete(self.spark, path)
