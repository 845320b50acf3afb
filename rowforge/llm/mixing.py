"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source asks for its weight's share of the budget; a source stops at ``max_epochs`` times its size and the
excess goes to the others by weight until none is above. As the level at which the water stands is the first,
in order of cap over weight, that the next cap does not undercut, prefix sums over the sources find it at once.

A source's target is then filled by whole repetitions of all its documents and one fractional repetition: in the
order of a seeded hash, documents are taken whole until the rest of the target is used up, and the one at the edge
in part. The order's prefix sums come from totals by hash prefix, so a source that holds a third of all rows is
spread over many tasks and no task sorts a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, join_counted, n_words

#: Documents that share a hash prefix, on average, at most.
PER_BUCKET = 4096


def _key(source_col: str):
    """Sorts by code point, null last."""
    return F.when(F.col(source_col).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(source_col).cast("string")))


def _hash(seed: int, id_col: str, text_col: str):
    """The place in the seeded order, by id; rows without an id are spread by their texts."""
    text = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), text)).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """``sk, source_size, target`` of each source; ``sizes`` has a row ``sk, source_size`` for each source."""
    alone = Window.partitionBy(F.lit(0))  # the sources only
    by_name = alone.orderBy("sk")
    level = alone.orderBy("r", "sk")
    w = sizes.select(
        "*",
        F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("w"),
        (F.lit(float(share)) * F.sum("source_size").over(alone)).alias("budget"),
        (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"),
    ).withColumn("r", F.col("cap") / F.col("w"))
    below = level.rowsBetween(Window.unboundedPreceding, -1)
    w = w.select(
        "*",
        ((F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing))).alias("lam"),
    )
    # the first level that its own cap does not undercut
    w = w.withColumn("lam", F.min(F.when(F.col("lam") <= F.col("r"), F.struct("r", "sk", "lam"))).over(alone)["lam"])
    return w.select("sk", "source_size", F.when(F.col("lam").isNull() | (F.col("cap") <= F.col("lam") * F.col("w")), F.col("cap")).otherwise(F.col("lam") * F.col("w")).alias("target"))


def _plan(sized: DataFrame, weights, share, max_epochs) -> tuple[DataFrame, DataFrame]:
    """The sized rows with their hash bucket, and the sources with ``full`` repetitions and ``part`` words."""
    n = sized.count()
    digits = min(6, max(2, math.ceil(math.log(max(n, 1) / PER_BUCKET + 1, 16))))
    sources = targets(sized.groupBy("sk").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("full", full).withColumn("part", F.floor(F.col("target") + 0.5).cast("long") - F.col("full") * F.col("source_size"))
    return sized.withColumn("b", F.substring("h", 1, digits)), sources


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``h``, the place in the seeded order, of each row.

    Weights go to the sources by code point, a null source last, and repeat. A null or empty text has size 0
    and nothing is taken of it; a source without words has target 0; ties in the hash (repeated rows, rows with
    a null id) go by id and size, so equal rows may differ in ``taken`` but their sum is fixed; an empty table
    gives an empty result. Other columns are not read.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), _key(source_col).alias("sk"), n_words(F.col(text_col)).alias("size"), _hash(seed, id_col, text_col).alias("h"))
    rows, sources = _plan(cut(sized, "mix"), weights, share, max_epochs)
    buckets = rows.groupBy("sk", "b").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sk").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("sk", "b", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")).join(sources, "sk")
    inside = Window.partitionBy("sk", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets, ["sk", "b"])
    rest = F.col("part") - F.col("ahead") - F.col("inside")
    return placed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"),
        "h", "sk", "full",
    )


def repeat_documents(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them: whole repetitions, and once more where
    the fractional repetition takes half the document or more. Texts are not shuffled: the seeded order's place
    at which each source's fractional repetition ends decides for every row where it is."""
    taken = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    extra = 2 * (F.col("taken") - F.col("full") * F.col("size")) >= F.greatest(F.col("size"), F.lit(1))
    sk, h, full, edge, copy, rows = fresh(docs, "mix_sk", "mix_h", "mix_full", "mix_edge", "mix_copy", "mix_rows")
    edges = taken.groupBy("sk").agg(F.first("full").alias(full), F.max(F.when(extra, F.col("h"))).alias(edge), F.count("*").alias(rows))
    edges = cut(edges.withColumnRenamed("sk", sk), "mix-edges")  # a row for each source
    own = docs.withColumns({sk: _key(source_col), h: _hash(seed, id_col, text_col)})
    own = own.join(F.broadcast(edges), sk) if edges.count() <= 100_000 else join_counted(own, edges, sk, rows, edges.agg(F.sum(rows)).first()[0])
    copies = F.coalesce(F.col(full) + F.when(F.col(h) <= F.col(edge), 1).otherwise(0), F.lit(0))
    return own.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)


def oracle_sql(weights=(5, 2, 1), share=1.5, max_epochs=2.0, seed=7) -> str:
    """DuckDB's SQL for ``doc_id, size, source_size, target, taken`` of :func:`mix`."""
    return f"""
    WITH s AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS sk,
                 coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                 md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS h FROM documents),
    t AS (SELECT sk, sum(size)::BIGINT AS source_size FROM s GROUP BY sk),
    w AS (SELECT *, list_extract([{", ".join(map(str, weights))}], ((row_number() OVER (ORDER BY sk) - 1) % {len(weights)} + 1)::INT)::DOUBLE AS w,
            {share}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget, {max_epochs}::DOUBLE * source_size AS cap FROM t),
    l AS (SELECT *, cap / w AS r, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM w),
    m AS (SELECT first(lam ORDER BY r, sk) AS lam FROM l WHERE lam <= r),
    p AS (SELECT sk, source_size, CASE WHEN m.lam IS NULL OR cap <= m.lam * w THEN cap ELSE m.lam * w END AS target FROM l LEFT JOIN m ON true),
    f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS f FROM p),
    c AS (SELECT s.*, coalesce(sum(size) OVER (PARTITION BY sk ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM s)
    SELECT doc_id, size, source_size, target,
      (f * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - f * source_size - ahead)))::BIGINT AS taken
    FROM c JOIN f USING (sk)"""
