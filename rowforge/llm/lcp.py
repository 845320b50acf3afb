"""Document fingerprints by locally consistent parsing.

A text is a string of code points. A level of the parse first folds runs of one symbol, then tosses
deterministic coins: a symbol's label is the place of the lowest bit in which it differs from the symbol before it,
and that bit; done again on the labels, so that there are few. Symbols at local maxima of the labels begin phrases,
which thus depend on a few neighbours only, and a phrase's name is a hash of its symbols. So equal substrings get
equal names, but for a few at their ends, wherever they stand. The fingerprint keeps the smallest hashes of the
names of one level.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Code points handled at once, to bound memory; a longer text is handled alone.
AT_ONCE = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _toss_table() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8)
    y = a[:, None] ^ a[None, :]
    low = np.bitwise_count((y & -y) - np.uint8(1))
    return (2 * low + (a[:, None] >> np.minimum(low, 7) & 1)).astype(np.uint8).ravel()


#: The next label of a label (row) after another (column).
TOSS = _toss_table()


def _before(x: np.ndarray, first: np.ndarray, at_first) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = at_first
    return out


#: A symbol's weight by its place in its phrase.
WEIGHT = _mix(np.arange(1, 65, dtype=U)) | U(1)


def _level(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names of strings that begin at ``starts``, and where their first phrases are."""
    new = np.empty(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[starts] = True
    at = np.flatnonzero(new)
    if len(at) < len(x):
        run = np.diff(at, append=len(x))
        x, starts = x[at].astype(U), np.searchsorted(at, starts)
        long_run = np.flatnonzero(run > 1)
        x[long_run] = _mix(x[long_run] ^ _mix(run[long_run].astype(U)))
    small = x.astype(np.uint32)  # neighbours differ; where only the high halves do, the label is that of no difference
    y = small ^ _before(small, starts, ~small[starts])
    low = np.bitwise_count((y & (~y + np.uint32(1))) - np.uint32(1))
    label = 2 * low + (small >> np.minimum(low, np.uint8(31)) & np.uint32(1)).astype(np.uint8)
    label = TOSS[label.astype(np.uint16) << np.uint16(8) | _before(label, starts, 255)]
    phrase = np.zeros(len(x), bool)
    more = label[1:] > label[:-1]
    np.greater(more[:-1], label[2:] >= label[1:-1], out=phrase[1:-1])
    phrase[starts[1:] - 1] = False  # a string's last symbol begins none
    phrase[starts] = True
    at = np.flatnonzero(phrase)
    place = np.arange(len(x), dtype=np.int32)
    place -= np.repeat(at.astype(np.int32), np.diff(at, append=len(x)))
    names = np.add.reduceat(x * WEIGHT[place & 63], at)
    return _mix(names), np.searchsorted(at, starts)


def sketches(texts: list[str], levels: int = 3, keep: int = 64) -> list[np.ndarray]:
    """For each text the ``keep`` smallest of its phrases' 32-bit hashes, ascending."""
    out: list = [np.empty(0, np.uint32)] * len(texts)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= AT_ONCE):
            size += len(texts[hi])
            hi += 1
        some = [i for i in range(lo, hi) if texts[i]]
        lo = hi
        if not some:
            continue
        x = np.frombuffer("".join([texts[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(texts[i]) for i in some])
        starts = np.cumsum(length) - length
        for _ in range(levels):
            x, starts = _level(x, starts)
        short = (x >> U(32)).astype(np.uint32)
        for i, a, b in zip(some, starts.tolist(), [*starts[1:].tolist(), len(x)]):
            part = short[a:b]
            least = np.unique(np.partition(part, 8 * keep)[: 8 * keep] if b - a > 16 * keep else part)  # mostly, only these matter
            out[i] = (least if len(least) >= keep else np.unique(part))[:keep]
    return out


def likeness(a: np.ndarray, b: np.ndarray, keep: int = 64) -> float:
    """Twice the shared over all phrases of both, as the sketches' common smallest hashes tell."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:keep]
    shared = len(np.intersect1d(np.intersect1d(both, a, True), b, True))
    return 2 * shared / (len(both) + shared)


def _written(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, levels: int = 3, keep: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint``; a null or empty text has the empty fingerprint, equal texts have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches([t or "" for t in batch.column(1).to_pylist()], levels, keep)
            yield pa.record_batch([batch.column(0), pa.array(map(_written, found), pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


#: Ranges of rows hold about so many bytes of text, and their bounds are drawn from so many rows for each.
RANGE_BYTES, PER_RANGE = 64 << 20, 20


def _place(bounds: list[tuple[bool, int, int]], none: np.ndarray, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted bounds (without an id, id, hash) are not after each key, and whether one is the key."""
    place, meets = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    for lacks in (False, True):
        on = np.flatnonzero(none == lacks)
        before = sum(x[0] < lacks for x in bounds)
        own = np.array([x[1:] for x in bounds if x[0] == lacks], np.int64).reshape(-1, 2)
        lo, hi = (np.searchsorted(own[:, 0], ids[on], side) for side in ("left", "right"))
        at, met = lo.copy(), np.zeros(len(on), bool)
        for i in np.unique(lo[lo < hi]).tolist():  # rows whose id is that of bounds
            some = np.flatnonzero((lo == i) & (lo < hi))
            hashes = own[i : hi[some[0]], 1]
            k = np.searchsorted(hashes, h[on[some]], "right")
            at[some], met[some] = i + k, (k > 0) & (hashes[np.maximum(k - 1, 0)] == h[on[some]])
        place[on], meets[on] = before + at, met
    return place, meets


def compare_edited(docs: DataFrame, levels: int = 3, keep: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each row.

    The next row is that of the next id; null ids come last, rows of one id go by a hash of their text, and the
    first row follows the last. The rows are dealt once by ranges of id and hash that begin at rows of the table, and the
    first row of a range also goes to the range before it; so rows without an id, or with one id, are spread by their texts. A
    null text counts as the empty one; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    count, size, least = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.min(key)).first()
    n = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // RANGE_BYTES)
    draw = F.pmod(F.xxhash64("doc_id", "h", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, PER_RANGE * n / max(count, 1)))
    drawn = sorted({tuple(r[0]) for r in rows.filter(draw).select(key.alias("k")).distinct().collect()})  # about PER_RANGE a range
    bounds = sorted({drawn[i * len(drawn) // n] for i in range(1, n) if drawn} - {tuple(least or ())})
    table = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("struct<p:int,begins:boolean>")
    def placed(none: pd.Series, ids: pd.Series, h: pd.Series) -> pd.DataFrame:
        place, meets = _place(table.value, none.to_numpy(), ids.to_numpy(), h.to_numpy())
        return pd.DataFrame({"p": place.astype(np.int32), "begins": meets})

    rows = rows.withColumn("at", placed(key["none"], key["id"], "h"))
    first = F.lit(False) if least is None else (key["none"] == least[0]) & (key["id"] == least[1]) & (F.col("h") == least[2])
    guest = F.when(F.col("at.begins"), F.col("at.p") - 1).when(first, F.lit(len(bounds)))
    to = F.explode(F.filter(F.array(F.struct(F.col("at.p").alias("p"), F.lit(False).alias("guest")), F.struct(guest.cast("int").alias("p"), F.lit(True).alias("guest"))), lambda x: x["p"].isNotNull()))
    dealt = rows.select("doc_id", "text", to.alias("to")).select("doc_id", "text", "to.p", "to.guest")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("p")).sortWithinPartitions("p", "guest", F.asc_nulls_last("doc_id"), F.xxhash64("text"))

    def rows_of(batches):
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())

    def pairs(batches):
        """Each row of a range with the text that follows."""
        first = held = None
        for doc, text, p, guest in rows_of(batches):
            if held is not None:
                if held[2] == p:
                    yield held[0], held[1], text
                else:
                    yield held[0], held[1], first
                held = None
            elif guest:
                continue  # one guest has been used
            if guest:
                continue
            if first is None or first_p != p:
                first, first_p = text, p
            held = (doc, text, p)
        if held is not None:
            yield held[0], held[1], first  # no id at all: the first row follows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def made(part):
            texts = [t for _, t, _ in part]
            edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for _, t, f in part]
            # a row's next text is mostly the next row's own
            other = [i for i, (_, _, f) in enumerate(part) if i + 1 == len(part) or part[i + 1][1] is not f]
            found = sketches([*texts, *edited, *[part[i][2] for i in other]], levels, keep)
            own, changed = found[: len(part)], found[len(part) : 2 * len(part)]
            following = dict(zip(other, found[2 * len(part) :]))
            next_of = [following[i] if i in following else own[i + 1] for i in range(len(part))]
            return pa.record_batch(
                [
                    pa.array([d for d, _, _ in part], pa.int64()), pa.array(list(map(len, texts)), pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array(list(map(_written, own))), pa.array(list(map(_written, changed))),
                    pa.array([likeness(a, b, keep) for a, b in zip(own, changed)], pa.float64()),
                    pa.array([likeness(a, b, keep) for a, b in zip(own, next_of)], pa.float64()),
                ],
                names=names,
            )

        part, size = [], 0
        for row in pairs(batches):
            part.append(row)
            size += len(row[1])
            if size > AT_ONCE:
                yield made(part)
                part, size = [], 0
        if part:
            yield made(part)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
