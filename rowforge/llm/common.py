"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import cut, forget, forget_at_exit, shared_dir  # noqa: F401  for the operators and the pipeline

#: White space between words: space and U+0009 to U+000D (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
WS = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` is called so (case does not tell columns apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one key beyond which they are not shuffled to be joined; and no fewer than a 10,000th of all.
HOT_ROWS = 10_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has every key once and in ``count`` how many of ``total`` rows have it.

    The few hot keys (at most 10,000) are broadcast to the rows, so no task gets all rows of one; the others are shuffled.
    """
    hot = F.col(count) > max(HOT_ROWS, total // 10_000)
    few, many = F.broadcast(table.filter(hot).drop(count)), table.filter(~hot).drop(count)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(many, key))


def remainder(column: str, n: int):
    """crc32 of a column's text form modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


_held: dict = {}


def trim() -> None:
    """Gives the memory that this Python worker has no more use for back to the system, for the stages after it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held(key, make):
    """What ``make`` made for ``key`` in this Python worker; only the last key's is kept, as workers go on to other
    operators and their caches would add up. Keys of learned models are drawn on the driver: an id() may come again."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]


def portions(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of text, or one text."""
    stop = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def n_words(column):
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
