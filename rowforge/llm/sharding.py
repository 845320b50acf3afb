"""Contiguous shards of equal bytes, with DataFrame functions only.

Rows are laid out in one order in which equal texts stand together. Totals by piece (equal texts, split once more
by a hash of the id so that a group of a third of all rows is many pieces) give prefix sums within the parts of
the order, the totals of the parts give the parts' own offsets, and the position in bytes over the shard size is
the shard. The cuts are thus equal targets; a group of equal texts goes whole to the shard of its middle, unless it
is too large for that, when it is laid out first and cut where a cut falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The parts of the order whose totals are summed in one task.
PARTS_BITS = 12


def shard(docs: DataFrame, shards: int = 16, whole: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row.

    ``size`` is the text's UTF-8 bytes and 1; a null text counts as the empty one. Groups of equal texts of up to
    1/``whole`` of a shard are never cut; larger ones (fewer than ``shards * whole`` of them) only where they cross
    the end of a shard. ``slot`` counts the rows of a shard from 0 by their order. Ties and repeated rows go by id;
    rows equal in all are interchangeable, and rows without an id are dealt out one by one. An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.monotonically_increasing_id().cast("string")))).alias("g"),
    )
    rows = cut(rows, "shard-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n, total = int(n), max(int(total), 1)
    pieces = max(64, min(65_536, n >> 18))
    key = ["h", "crc", "piece"]
    rows = rows.withColumn("piece", F.pmod("g", F.lit(pieces)).cast("int"))
    sums = cut(rows.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-pieces")

    # Fewer than shards * whole groups can be this large.
    large = sums.groupBy("h", "crc").agg(F.sum("bytes").alias("all"), F.sum("rows").alias("copies")).filter((F.col("all") * (shards * whole) > total) & (F.col("copies") > 1))
    large = sorted(((r["all"], r["h"], r["crc"]) for r in large.collect()), reverse=True)
    spark = docs.sparkSession
    large = spark.createDataFrame([(h, c, i - len(large)) for i, (_, h, c) in enumerate(large)], "h long, crc long, first int")
    sums = sums.join(F.broadcast(large), ["h", "crc"], "left")
    part = F.coalesce(F.col("first"), F.shiftright("h", 64 - PARTS_BITS).cast("int") + (1 << (PARTS_BITS - 1)))
    sums = sums.withColumn("part", part)

    # A global window, but over at most 2^PARTS_BITS + shards * whole totals.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("bytes").alias("pb"), F.sum("rows").alias("pr"))
    parts = parts.select("part", F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("pb"), F.coalesce(F.sum("pr").over(before), F.lit(0)).alias("pr"))
    inside = Window.partitionBy("part").orderBy("h", "crc", "piece").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("part", "h", "crc")
    sums = sums.select(
        "*", F.coalesce(F.sum("bytes").over(inside), F.lit(0)).alias("ib"), F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("ir"),
    )
    sums = sums.select("*", F.min("ib").over(group).alias("gb"), F.sum("bytes").over(group).alias("gall")).join(F.broadcast(parts), "part")
    sums = sums.select(
        *key, (F.col("pb") + F.col("ib")).alias("at"), (F.col("pr") + F.col("ir")).alias("nth"),
        # twice the middle of the group, where it stays whole
        F.when(F.col("first").isNull(), 2 * (F.col("pb") + F.col("gb")) + F.col("gall")).alias("mid"),
    )
    own = Window.partitionBy(*key).orderBy("doc_id", "size")
    placed = rows.select(*key, "doc_id", "size", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(own).alias("rank"))
    placed = placed.join(sums, key)
    placed = placed.withColumn("mid", F.coalesce("mid", 2 * (F.col("at") + F.col("upto")) - F.col("size")))
    placed = placed.select(
        "doc_id", "size", "crc", F.least(F.expr(f"mid * {shards} div {2 * total}"), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("nth") + F.col("rank") - 1).alias("nth"),
    )
    placed = cut(placed, "shard-placed")
    starts = placed.groupBy("shard").agg(F.min("nth").alias("start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("nth") - F.col("start")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes every shard to a folder of its own, in the order of ``slot``; joins by id, which must be unique."""
    placed = shard(docs, **options)
    ids = options.get("id_col", "doc_id")
    placed = placed.select(F.col("doc_id").alias(ids), "shard", "slot")
    docs.join(placed, ids).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
