"""SimHash near-duplicates with bit-sliced comparison.

Candidates: of ``radius + m`` blocks of the fingerprint's bits, two fingerprints that differ in ``radius`` bits or fewer
agree in m; the more fingerprints there are, the more blocks make a key. Distinct fingerprints are dealt by their keys.
A second fingerprint, of longer shingles, may have to be near as well. A task holds its fingerprints as vertical bit planes, 64 lanes to a word; one fingerprint is compared with
64 at once by adding its difference from each plane to carry-save counters, and a block is left as soon as all
its lanes are over the radius, or hang together with it already. A key that many share is split into chunks, and every pair of chunks
meets in a task of its own, so no comparison is lost and none is too large. Tasks return a spanning forest of the
links they find; components() joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_counted, trim
from .components import components

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    start = stop - size + 1
    stop = stop[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(start[:n].tolist(), stop.tolist())], np.uint64)
    set_in = np.zeros(64, np.int64)
    for lo in range(0, n, 8192):
        part = hashes[lo : lo + 8192]
        set_in += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", beside: tuple[str, ...] = (), shingle: int = 3, second: int | None = None) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; ``fp2`` of shingles of ``second`` words, if asked for; and the long
    columns ``beside``, as they are."""
    made = {"fp": shingle} | ({"fp2": second} if second else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(1).to_pylist()
                fps = [pa.array(np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64)) for n in made.values()]
                yield pa.record_batch([part.column(0), *fps, *part.columns[2:]], names=["doc_id", *made, *beside])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in (*made, *beside))])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *beside).mapInArrow(run, schema)


def find_roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each an index of a lower or the same item) after joining the items a and b pairwise."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def links(group: np.ndarray, fp: np.ndarray, radius: int = 3, step: int = 1 << 16, other: np.ndarray | None = None, other_radius: int = 64) -> np.ndarray:
    """Labels by which items of a group within ``radius`` bits hang together, if their ``other`` fingerprints are within
    ``other_radius`` too; ``group`` ascends."""
    n = len(fp)
    labels = np.arange(n)
    if n < 2:
        return labels
    blocks = -(-n // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[:n] = fp
    planes = np.stack([np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(bool), bitorder="little").view(np.uint64) for b in range(64)])
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    last = np.repeat(np.append(edge[1:], n), np.diff(np.append(edge, n)))  # where an item's group ends
    item = np.flatnonzero(last > np.arange(n) + 1)
    first_block, blocks_of = (item + 1) >> 6, ((last[item] - 1) >> 6) - ((item + 1) >> 6) + 1
    # Counters start so that they overflow at radius + 1.
    width = max(1, int(radius).bit_length())
    bias = (1 << width) - 1 - radius
    done = np.append(0, np.cumsum(blocks_of))
    lo = 0
    while lo < len(item):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + step, "right")) - 1)
        own = item[lo:hi]
        count = blocks_of[lo:hi]
        q = np.repeat(own, count)
        block = np.repeat(first_block[lo:hi], count) + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        lo = hi
        ends = np.arange(0, n, 64)
        least, most = np.minimum.reduceat(labels, ends), np.maximum.reduceat(labels, ends)
        on = np.flatnonzero((least[block] != labels[q]) | (most[block] != labels[q]))  # else all hang together already
        q, block = q[on], block[on]
        base = block << 6
        begin, stop = np.clip(q + 1 - base, 0, 64), np.clip(last[q] - base, 0, 64)
        lanes = np.where(stop >= 64, ONES, (np.uint64(1) << (stop & 63).astype(np.uint64)) - np.uint64(1))
        lanes &= np.where(begin >= 64, np.uint64(0), ONES << (begin & 63).astype(np.uint64))
        counters = [np.full(len(q), ONES if bias >> i & 1 else 0, np.uint64) for i in range(width)]
        for b in range(64):
            carry = planes[b][block] ^ (np.uint64(0) - (fp[q] >> np.uint64(b) & np.uint64(1)))
            for i in range(width):
                carry, counters[i] = counters[i] & carry, counters[i] ^ carry
            lanes &= ~carry
            if b % 6 == 5:
                on = np.flatnonzero(lanes)
                if len(on) < 0.8 * len(lanes):
                    q, block, lanes = q[on], block[on], lanes[on]
                    counters = [c[on] for c in counters]
                    if not len(on):
                        break
        if len(q):
            pair, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = q[pair], (block[pair] << 6) + lane
            if other is not None:
                near = np.bitwise_count(other[a] ^ other[b]) <= other_radius
                a, b = a[near], b[near]
            labels = find_roots(labels, a, b)
    return labels


#: A key's bits at least, and fingerprints that share it, if all are as likely, at most: beyond, keys are of more blocks.
#: Links are the same.
LEAST_BITS, PER_KEY = 12, 1024


def _keys(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each table, the (shift, width) parts of its key."""
    m = next(m for m in range(1, 5) if m == 4 or 64 * m // (radius + m) >= LEAST_BITS and n >> (64 * m // (radius + m)) <= PER_KEY)
    k = radius + m
    blocks = [(64 * i // k, 64 * (i + 1) // k - 64 * i // k) for i in range(k)]
    return [list(parts) for parts in combinations(blocks, m)]


def near_links(distinct: DataFrame, radius: int = 3, chunk: int = 2048, other_radius: int | None = None) -> DataFrame:
    """Edges ``a, b`` between nodes of distinct fingerprints (columns ``node, fp``; and ``fp2`` if ``other_radius`` is given)
    such that exactly those hang together that links of ``radius`` bits or fewer join."""
    n = distinct.count()
    own_columns = ["node", "fp", *(["fp2"] if other_radius is not None else [])]
    tables = []
    for t, parts in enumerate(_keys(n, radius)):
        key = F.lit(t).cast("long")
        for shift, width in parts:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1)))
        tables.append(key)
    keyed = distinct.select(*own_columns, F.explode(F.array(*tables)).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    keyed = keyed.join(large, "key", "left")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keyed = keyed.select("key", *own_columns, own.alias("own"), other.alias("other"))
    pair = F.when(F.col("own").isNull(), F.lit(0).cast("long")).otherwise(F.least("own", "other").cast("long") * 1_000_000 + F.greatest("own", "other"))
    keyed = keyed.select(F.xxhash64("key", pair).alias("g"), *own_columns)
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(tables) // 2_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if held:
            group, node, fp, *more = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((node, group))
            group, node, fp, more = group[order], node[order], fp[order].view(np.uint64), [x[order].view(np.uint64) for x in more]
            labels = links(group, fp, radius, other=more[0] if more else None, other_radius=other_radius or 0)
            on = np.flatnonzero(labels != np.arange(len(fp)))
            yield pa.record_batch([pa.array(node[on]), pa.array(node[labels[on]])], names=["a", "b"])
        trim()

    # A task's groups may share a hash only by accident; a link between two of them would still be true.
    return keyed.repartition(tasks, "g").mapInArrow(run, "a long, b long")


def _hung(rows: DataFrame, radius: int, other_radius: int | None = None) -> DataFrame:
    """``node, least, rows, root`` of each distinct node of ``rows``: its least id, how many rows have it, and the node that
    stands for its component."""
    signs = [F.first(c).alias(c) for c in ("fp", "fp2") if c in rows.columns]
    distinct = cut(rows.groupBy("node").agg(*signs, F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-distinct")
    roots = components(near_links(distinct, radius, other_radius=other_radius))
    return distinct.select("node", "least", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of each row: component_id is the least id among all rows that links reach.

    A null or empty text has fingerprint zero and links like any other; equal texts are one fingerprint, counted
    once in all comparisons; repeated rows get equal results; a null id is never a least one unless a component
    has no other. An empty table gives an empty result; other columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col).withColumn("node", F.col("fp")), "simhash")
    hung = _hung(rows, radius)
    least = hung.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = cut(hung.select("node", "rows", "root").join(least, "root").select("node", "rows", "component_id"), "simhash-components")
    return join_counted(rows, by_node, "node", "rows", rows.count()).select("doc_id", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, radius: int = 8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, second: int | None = 5, other_radius: int = 14
) -> DataFrame:
    """One row of ``docs``, all columns, of each group of near duplicates.

    Texts link if their fingerprints of ``shingle`` words are within ``radius`` bits and those of ``second`` words (if any)
    within ``other_radius``; with the defaults these are texts that share about 0.8 or more of their shingles of five words.
    Null and empty texts are alike. The row kept is that of the least id, null ids last; of rows that share it, by a hash of
    the text, then of all columns (but maps). So rows without an id and rows that repeat an id with another text stand
    for themselves. An empty table stays empty.
    """
    hashed = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    text, row, copies = fresh(docs, "near_text", "near_row", "near_copies")
    marked = docs.withColumns({text: F.xxhash64(text_col), row: F.xxhash64(*hashed)})
    node = F.xxhash64("fp", "fp2") if second else F.col("fp")
    rows = cut(fingerprints(marked, id_col, text_col, (text, row), shingle, second).withColumn("node", node), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text, row)
    first = rows.groupBy("node").agg(F.min(first).alias("first")).join(_hung(rows, radius, other_radius if second else None).select("node", "root"), "node")
    kept = first.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first")[text].alias(text), F.col("first")[row].alias(row))
    kept = cut(rows.groupBy(text, row).agg(F.count("*").alias(copies)).join(kept, [text, row], "left_semi"), "simhash-kept")
    # Texts are shuffled once; only rows equal in all columns need a second look, and there are mostly none.
    few = marked.join(kept.filter(F.col(copies) == 1).drop(copies), [text, row])
    if not kept.filter(F.col(copies) > 1).isEmpty():
        few = few.unionByName(marked.join(kept.filter(F.col(copies) > 1).drop(copies), [text, row]).dropDuplicates([text, row]))
    return few.select(*docs.columns)
