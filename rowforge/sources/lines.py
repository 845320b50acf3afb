"""Sources of ordered lines."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OpenInput
from ..operators.ordering import Order, positions
from ..operators.scratch import forget_at_exit, shared_dir


@dataclass
class LineFrame:
    """Lines: ``content``, ``terminator``, and the columns of their total order. Where that is ``row_no`` alone, it is the
    line's number, dense from 1. ``validate`` asks for a UTF-8 check of the lines that a job works on."""

    df: DataFrame
    validate: bool = False
    _total: int | None = None
    order: Order = field(default_factory=lambda: [("row_no", False)])

    @property
    def total(self) -> int:
        if self._total is None:
            self._total = self.df.count()
        return self._total

    @property
    def dense(self) -> bool:
        return self.order == [("row_no", False)]

    def numbered(self) -> LineFrame:
        """The lines with their numbers. Most jobs need none: an order is enough."""
        if self.dense:
            return self
        df = positions(self.df, self.order, "row_no", self.total).select("row_no", "content", "terminator")
        return LineFrame(df, self.validate, self.total)


def from_column(df: DataFrame, column: str, order_by: list[str]) -> LineFrame:
    """The lines of a text column, rows in the order of unique columns; a null text has none."""
    lines = df.select(*order_by, F.posexplode(F.split(F.col(column), "\n", -1)).alias("__i", "content"))
    return LineFrame(lines.withColumn("terminator", F.lit("\n")), order=[*((c, False) for c in order_by), ("__i", False)])


def from_table(df: DataFrame, columns: list[Column], delimiter: str, order_by: list[str], unique: bool = False) -> LineFrame:
    """A line for each row: the columns' texts joined; unless the order is said to be unique, ties go by the line. Null
    reads as empty."""
    content = F.concat_ws(delimiter, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    lines = df.select(*order_by, content.alias("content"), F.lit("\n").alias("terminator"))
    order = [(c, False) for c in order_by]
    return LineFrame(lines, order=order) if unique else LineFrame(lines.withColumn("__line", F.col("content")), order=[*order, ("__line", False)])


def from_lines(spark: SparkSession, lines: Iterable[str]) -> LineFrame:
    """Lines at hand; each with its terminator or without."""
    rows = []
    for i, line in enumerate(lines, 1):
        end = "\r\n" if line.endswith("\r\n") else "\n" if line.endswith("\n") else ""
        rows.append((i, line[: len(line) - len(end)], end))
    return LineFrame(spark.createDataFrame(rows, "row_no long, content string, terminator string"), _total=len(rows))


def _ends(spark: SparkSession, path: str) -> tuple[int, bool]:
    """A file's size, and whether it ends with a line feed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise OpenInput(f"cannot open {path}")
    size = fs.getFileStatus(p).getLen()
    if not size:
        return 0, True
    with_stream = fs.open(p)
    try:
        with_stream.seek(size - 1)
        return size, with_stream.read() == 10
    finally:
        with_stream.close()


def staged(spark: SparkSession, stream, step: int = 1 << 20) -> str:
    """Copies a stream of bytes, such as standard input, to a file in the shared folder, a part at a time; its path."""
    path = f"{shared_dir(spark)}/rowforge/input-{uuid.uuid4().hex}"
    forget_at_exit(spark, path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        while part := stream.read(step):
            out.write(bytearray(part))
    finally:
        out.close()
    return path


def from_files(spark: SparkSession, paths: list[str]) -> LineFrame:
    """Files one after the other, byte by byte: a last line without a line feed goes on in the next file.

    Lines are numbered where they are read: a split of a file knows where it begins, its lines come one after another, and
    one count of lines for each split gives the numbers, so nothing is sorted or shuffled.
    """
    ends = [_ends(spark, p) for p in paths]
    parts = []
    for i, path in enumerate(paths):
        if ends[i][0]:
            read = spark.read.option("lineSep", "\n").text(path)
            parts.append(read.select(F.lit(i).alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"), F.col("value").alias("content")))
    if not parts:
        return from_lines(spark, [])
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    splits = lines.groupBy("__f", "__b").agg(F.count("*").alias("n"), F.min("__i").alias("i")).collect()  # a row for each split
    counts: dict[int, int] = {}
    total, begins = 0, []
    for r in sorted(splits, key=lambda r: (r["__f"], r["__b"])):
        begins.append((r["__f"], r["__b"], total + 1 - r["i"]))
        counts[r["__f"]] = counts.get(r["__f"], 0) + r["n"]
        total += r["n"]
    begins = spark.createDataFrame(begins, "__f int, __b long, __begin long")
    numbered = lines.join(F.broadcast(begins), ["__f", "__b"]).select((F.col("__begin") + F.col("__i")).alias("row_no"), "content")
    filled = [i for i in range(len(paths)) if ends[i][0]]
    # rows that go on in the next file
    open_rows, at = [], 0
    for i in filled:
        at += counts.get(i, 0)
        if not ends[i][1] and i != filled[-1]:
            open_rows.append(at)
    if open_rows:
        shift = sum((F.when(F.col("row_no") > r, 1).otherwise(0) for r in open_rows), F.lit(0))
        numbered = numbered.select((F.col("row_no") - shift).alias("row_no"), F.col("row_no").alias("__o"), "content")
        touched = sorted({r - sum(o < r for o in open_rows) for r in open_rows})
        whole = numbered.filter(F.col("row_no").isin(touched)).groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("__o", "content"))).alias("x"))
        whole = whole.select("row_no", F.array_join(F.transform("x", lambda x: x["content"]), "").alias("content"))
        numbered = numbered.filter(~F.col("row_no").isin(touched)).select("row_no", "content").unionByName(whole)
        total -= len(open_rows)
    closed = F.lit(True) if ends[filled[-1]][1] else F.col("row_no") < total
    crlf = closed & F.col("content").endswith("\r")
    return LineFrame(
        numbered.select(
            "row_no",
            F.when(crlf, F.expr("left(content, length(content) - 1)")).otherwise(F.col("content")).alias("content"),
            F.when(crlf, "\r\n").when(closed, "\n").otherwise("").alias("terminator"),
        ),
        validate=True,
        _total=total,
    )
