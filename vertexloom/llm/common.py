"""What the operators share: reading tables, Arrow helpers, and, from the rest, the shared folder and written stages."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..storage import Scratch, drop_written, fresh_path, shared_dir, written

__all__ = ["Scratch", "appended", "drop_written", "fresh_path", "held", "let_go", "release", "shared_dir", "slices", "table", "texts_of", "unused", "written"]

#: Rows of one Arrow record batch that are worked on together in Python; bounds a worker's memory with long texts.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on between stages, and others need its share."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


_held: dict = {}


def held(key, make):
    """make(), kept in this worker for its next tasks. A reused worker holds one operator's state at a time."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    if _held:
        _held.clear()
        release()


def slices(batches, rows: int = SLICE_ROWS, holding=None):
    """Record batches cut to at most `rows` rows each, without copying; memory is released behind the last.

    holding: the key of the state that the task works with; what another operator held goes.
    """
    if holding not in _held:
        let_go()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def appended(df: DataFrame, inputs: list[str], fields: str, make, holding=None) -> DataFrame:
    """df with further columns: make(list of Arrow arrays of the inputs) gives an Arrow array for each of `fields`.

    All of df's columns pass through, by place, so their names and number don't matter, save that inputs are distinct. A
    column of df that has the name of a new one, in whatever case, is kept with underscores before its name.
    """
    places = [df.columns.index(c) for c in inputs]
    new = T.StructType.fromDDL(fields).fields
    taken = {f.name.lower() for f in new} | {c.lower() for c in df.columns}
    old = []
    for field in df.schema.fields:
        name = field.name
        if name.lower() in {f.name.lower() for f in new}:
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
        old.append(T.StructField(name, field.dataType, field.nullable, field.metadata))
    schema = T.StructType([*old, *new])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in slices(batches, holding=holding):
            made = make([batch.column(i) for i in places])
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]
