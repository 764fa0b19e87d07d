"""Matrix Market files: headers, coordinate and array sizes, entries, and writing.

Files are read as lines, in splits; the header and the size line are the first lines of the file, which the driver looks
at. Entries keep their multiplicity. A symmetric file's entries are mirrored; off the diagonal in the strict reading, also on
it in the plain one, where a diagonal entry counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.positions import with_positions
from ..storage import write_lines

OBJECTS, FORMATS = ("matrix",), ("coordinate", "array")
FIELDS = ("real", "double", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "hermitian", "skew-symmetric")


class BadHeader(ValueError):
    """code: no_header, unsupported_type, premature_eof, or bad_size."""

    def __init__(self, code: str, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


@dataclass(frozen=True)
class Header:
    """What the first line says, and the sizes of the second."""

    format: str = "coordinate"
    field: str = "real"
    symmetry: str = "general"
    zero_based: bool = False
    rows: int = 0
    cols: int = 0
    entries: int = 0

    def type_name(self) -> str:
        return f"matrix {self.format} {self.field} {self.symmetry}"

    def valid(self) -> bool:
        """Dense patterns, real Hermitian matrices, and patterns with signs aren't."""
        if self.format == "array" and self.field == "pattern":
            return False
        if self.field in ("real", "double", "integer") and self.symmetry == "hermitian":
            return False
        return not (self.field == "pattern" and self.symmetry in ("hermitian", "skew-symmetric"))


def parse_banner(line: str) -> Header:
    words = line.split()
    if not words or words[0] != "%%MatrixMarket":
        raise BadHeader("no_header", f"{line[:60]!r} is no banner")
    if len(words) < 5:
        raise BadHeader("premature_eof", f"{line[:60]!r} ends too soon")
    kind, form, field, symmetry, *rest = (w.lower() for w in words[1:])
    if kind not in OBJECTS or form not in FORMATS or field not in FIELDS or symmetry not in SYMMETRIES:
        raise BadHeader("unsupported_type", f"{' '.join(words[1:5])!r}")
    header = Header(form, field, symmetry, "basezero" in rest)
    if not header.valid():
        raise BadHeader("unsupported_type", header.type_name())
    return header


def parse_size(line: str, form: str = "coordinate") -> tuple[int, int, int]:
    """rows, columns, entries; of an array, entries are rows times columns."""
    try:
        numbers = [int(w) for w in line.split()]
    except ValueError:
        numbers = []
    if len(numbers) != (3 if form == "coordinate" else 2) or min(numbers, default=-1) < 0:
        raise BadHeader("bad_size", f"{line[:60]!r}")
    return (*numbers, numbers[0] * numbers[1])[:3]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, block, mid: lines, whose order is that of (block, mid)."""
    return spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))


def _firsts(spark: SparkSession, path: str) -> tuple[str, str, DataFrame]:
    """The first line, the first that is no comment, and the lines behind that one."""
    every = lines(spark, path)
    data = every.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = every.where("block = 0").orderBy("mid").limit(1).collect()
    size = data.agg(F.min(F.struct("block", "mid", "value")).alias("m")).first()["m"]
    if not first or size is None:
        raise BadHeader("premature_eof", "no size line")
    return first[0]["value"], size["value"], data.where((F.col("block") != size["block"]) | (F.col("mid") != size["mid"]))


def read_header(spark: SparkSession, path: str) -> Header:
    banner, size, _ = _firsts(spark, path)
    header = parse_banner(banner)
    return Header(header.format, header.field, header.symmetry, header.zero_based, *parse_size(size, header.format))


def _split(data: DataFrame) -> DataFrame:
    return data.select(F.split(F.trim("value"), r"\s+").alias("w"))


def read_entries(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """The header, and i, j, re, im of each entry as it stands, 0-based; patterns have re 1, real entries im 0."""
    banner, size, data = _firsts(spark, path)
    head = parse_banner(banner)
    header = Header(head.format, head.field, head.symmetry, head.zero_based, *parse_size(size, head.format))
    if header.format != "coordinate":
        raise BadHeader("unsupported_type", "entries of arrays")
    base = 0 if header.zero_based else 1
    part = lambda k: F.get("w", F.lit(k))
    re = F.lit(1.0) if header.field == "pattern" else part(2).cast("double")
    im = part(3).cast("double") if header.field == "complex" else F.lit(0.0)
    return header, _split(data).select((part(0).cast("int") - base).alias("i"), (part(1).cast("int") - base).alias("j"), re.alias("re"), im.alias("im"))


def read_unsymmetric(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """i, j, re of a real general matrix."""
    header, entries = read_entries(spark, path)
    if header.field not in ("real", "double") or header.symmetry != "general":
        raise BadHeader("unsupported_type", header.type_name())
    return header, entries.select("i", "j", "re")


def read_graph(spark: SparkSession, path: str, strict: bool = False, weighted: bool = False) -> Graph:
    """The matrix as edges i -> j.

    Plainly, only the words `symmetric` and `basezero` of the first line count, any number of columns will do, and values are 1.
    strict: the banner must be valid, the matrix square and not complex; values are kept if weighted.
    """
    banner, size, data = _firsts(spark, path)
    if strict:
        header = parse_banner(banner)
        rows, cols, _ = parse_size(size, header.format)
        if header.format != "coordinate" or header.field == "complex":
            raise BadHeader("unsupported_type", header.type_name())
        if rows != cols:
            raise BadHeader("bad_size", f"{rows} rows, {cols} columns")
        mirror, zero, valued = header.symmetry != "general", header.zero_based, weighted and header.field != "pattern"
        sign = -1.0 if header.symmetry == "skew-symmetric" and weighted else 1.0
    else:
        rows, mirror, zero, valued, sign = int(size.split()[0]), "symmetric" in banner, "basezero" in banner, False, 1.0
    base = 0 if zero else 1
    value = F.coalesce(F.get("w", F.lit(2)).cast("double"), F.lit(1.0)) if valued else F.lit(1.0)
    edges = _split(data).select((F.get("w", F.lit(0)).cast("int") - base).alias("row"), (F.get("w", F.lit(1)).cast("int") - base).alias("col"), value.alias("val"))
    if mirror:
        back = edges.where("row <> col") if strict else edges
        edges = edges.unionByName(back.select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val")))
    return Graph(edges, rows, path.rstrip("/").rsplit("/", 1)[-1])


def write_coordinate(g: Graph, path: str, field: str = "pattern", symmetry: str = "general") -> None:
    """One file: banner, size, entries by (row, col), 1-based. The header comes first by its place in the sort."""
    header = Header("coordinate", field, symmetry)
    if not header.valid():
        raise BadHeader("unsupported_type", header.type_name())
    ends = F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1)
    entry = ends if field == "pattern" else F.concat_ws(" ", ends, F.col("val").cast("long" if field == "integer" else "double"))
    body = g.edges.select(F.lit(2).alias("part"), "row", "col", entry.alias("value"))
    top = g.spark.createDataFrame([(0, 0, 0, f"%%MatrixMarket {header.type_name()}"), (1, 0, 0, f"{g.n} {g.n} {g.nnz()}")], "part int, row int, col int, value string")
    write_lines(body.unionByName(top), path, "part", "row", "col")


def write_array(entries: DataFrame, rows: int, cols: int, path: str, field: str = "real") -> None:
    """One file of a dense matrix from i, j, re: banner, size, all values by column; entries that aren't there are 0."""
    header = Header("array", field)
    if not header.valid():
        raise BadHeader("unsupported_type", header.type_name())
    spark = entries.sparkSession
    kind = "long" if field == "integer" else "double"
    given = entries.select((F.col("j").cast("long") * rows + F.col("i")).alias("at"), F.col("re"))
    body = spark.range(rows * cols).withColumnRenamed("id", "at").join(given, "at", "left").select("at", F.coalesce("re", F.lit(0.0)).cast(kind).cast("string").alias("value"))
    top = spark.createDataFrame([(-2, f"%%MatrixMarket {header.type_name()}"), (-1, f"{rows} {cols}")], "at long, value string")
    write_lines(body.unionByName(top), path, "at")


def read_array(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """The header, and i, j, re of each value of a real dense matrix, 0-based."""
    banner, size, data = _firsts(spark, path)
    head = parse_banner(banner)
    header = Header(head.format, head.field, head.symmetry, head.zero_based, *parse_size(size, head.format))
    if header.format != "array" or header.field == "complex" or header.symmetry != "general":
        raise BadHeader("unsupported_type", header.type_name())
    placed = with_positions(data, "block", "mid", name="at").select("at", F.trim("value").cast("double").alias("re"))
    rows = max(1, header.rows)
    return header, placed.select(F.expr(f"cast(at % {rows} as int)").alias("i"), F.expr(f"cast(at div {rows} as int)").alias("j"), "re")
