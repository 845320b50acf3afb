"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's mergeable pairs wait in one bucket per merge rank. A three-level bitmap over the ranks finds
the lowest non-empty bucket by find-first-set; a bucket gives its leftmost position first. Positions form a
doubly linked list over the bytes; an entry whose pair has changed since it was queued is stale and skipped.
So a pre-token of n bytes takes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, portions, trim

#: Code points with the Unicode property White_Space (fixed values).
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """The rank file format: a line holds a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def _spread(shift: np.ndarray, size: np.ndarray) -> np.ndarray:
    """0, 1, 2 and so on, each run of ``size`` shifted."""
    total = int(size.sum())
    kind = np.int32 if total < 1 << 30 else np.int64
    out = np.repeat(shift.astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


class Spelled(dict):
    """Numbers strings and keeps their ids."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def numbers(self, keys: list[str], spell) -> np.ndarray:
        """The keys' numbers; ``spell`` gives the ids of those that are new."""
        row = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        if self.new:
            new, self.new = self.new, []
            ids, size = spell(new)
            self.begin = np.concatenate((self.begin, np.cumsum(size) - size + len(self.ids)))
            self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))
        return row

    def spelled(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered keys, one after another, and how many each has."""
        size = self.size[row]
        return self.ids[_spread(self.begin[row] - (np.cumsum(size) - size), size)], size


class Encoder:
    """Encodes texts to ids, and ids to bytes. ``keep`` bounds each of the two caches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 100_000):
        self.ranks, self.keep = ranks, keep
        words = (max(ranks.values()) >> 6) + 1
        self._low = [0] * words
        self._mid = [0] * ((words >> 6) + 1)
        self._pretokens = regex.compile(pattern).findall
        # What the pattern makes of a run of non-space characters and one space before it depends on nothing
        # outside, so ids are kept by such segments.
        self._cut = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        self._spaced = f"[{WHITE}] "
        self._segments, self._pieces = Spelled(), Spelled()
        self._byte_id = np.array([ranks[bytes([b])] for b in range(256)])
        # Every way to spell a token by two others, sorted.
        ways = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        key, value = np.array([*ways, (1 << 62, -1)], np.int64).T
        by_key = np.argsort(key)
        self._pair_key, self._pair_value = key[by_key], value[by_key]
        # The bytes of all tokens, one after another, by rank.
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self._bytes, self._size = np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._begin = np.cumsum(self._size) - self._size

    def forget(self) -> None:
        self._segments.forget()
        self._pieces.forget()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rank next, the leftmost among equals."""
        find = self.ranks.get
        whole = find(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        low, mid, top, buckets = self._low, self._mid, 0, {}
        pair = [find(piece[at : at + 2], -1) for at in range(n)]
        pair[-1] = -1
        fresh = [at for at in range(n) if pair[at] >= 0]
        while True:
            for at in fresh:
                rank = pair[at]
                bucket = buckets.get(rank)
                if bucket:
                    heappush(bucket, at)
                else:
                    buckets[rank] = [at]
                    word = rank >> 6
                    low[word] |= 1 << (rank & 63)
                    mid[word >> 6] |= 1 << (word & 63)
                    top |= 1 << (word >> 6)
            if not top:
                break
            m = (top & -top).bit_length() - 1
            bits = mid[m]
            word = (m << 6) + (bits & -bits).bit_length() - 1
            bits = low[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    mid[m] = bits = mid[m] & (mid[m] - 1)
                    if not bits:
                        top &= top - 1
            if pair[at] != rank:
                fresh = ()  # a stale entry
                continue
            gone = after[at]
            pair[gone] = -1
            stop = end[at] = end[gone]
            after[at] = right = after[gone]
            fresh = []
            if right < n:
                before[right] = at
                pair[at] = rank = find(piece[at : end[right]], -1)
                if rank >= 0:
                    fresh.append(at)
            else:
                pair[at] = -1
            left = before[at]
            if left >= 0:
                pair[left] = rank = find(piece[left:stop], -1)
                if rank >= 0:
                    fresh.append(left)
        ids, at = [], 0
        while at < n:
            ids.append(find(piece[at : end[at]]))
            at = after[at]
        return ids

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of short pre-tokens, all in one queue.

        Pre-tokens do not touch each other, so the lowest rank of all may take, in one step, its leftmost entry
        of every pre-token; further entries wait, as a merge may bring up a lower rank.
        """
        n = sum(map(len, pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stop = np.cumsum(size)
        owner = np.repeat(np.arange(len(pieces)), size)
        # One more position, n, stands for whatever is beyond an end; nothing merges with it.
        token = np.append(self._byte_id[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[stop - 1], before[stop - size] = n, n
        pair = np.append(self._pair_rank(token[:n], token[after[:n]]), -1)
        alive = np.ones(n, bool)
        order = np.argsort(pair[:n], kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        ranks, starts = np.unique(pair[order], return_index=True)
        buckets = {r: x.tolist() for r, x in zip(ranks.tolist(), np.split(order, starts[1:]))} if len(order) else {}
        low, mid, top = self._low, self._mid, 0
        for rank in buckets:
            low[rank >> 6] |= 1 << (rank & 63)
            mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            top |= 1 << (rank >> 12)
        while top:
            m = (top & -top).bit_length() - 1
            word = (m << 6) + (mid[m] & -mid[m]).bit_length() - 1
            rank = (word << 6) + (low[word] & -low[word]).bit_length() - 1
            low[word] &= low[word] - 1
            if not low[word]:
                mid[m] &= mid[m] - 1
                if not mid[m]:
                    top &= top - 1
            at = np.array(buckets.pop(rank))
            at = np.unique(at[pair[at] == rank])  # without stale entries
            if not len(at):
                continue
            first = np.append(True, owner[at[1:]] != owner[at[:-1]])
            later = at[~first].tolist()
            at = at[first]
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], after[at], before[right] = rank, right, at
            pair[gone], alive[gone] = -1, False
            changed = np.concatenate((at, left))
            found = self._pair_rank(token[changed], np.concatenate((token[right], token[at])))
            pair[changed] = found
            pair[n] = -1
            on = found >= 0
            for r, x in zip(found[on].tolist(), changed[on].tolist()):
                if r in buckets:
                    buckets[r].append(x)
                else:
                    buckets[r] = [x]
                    low[r >> 6] |= 1 << (r & 63)
                    mid[r >> 12] |= 1 << (r >> 6 & 63)
                    top |= 1 << (r >> 12)
            if later:
                buckets.setdefault(rank, []).extend(later)
                low[rank >> 6] |= 1 << (rank & 63)
                mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                top |= 1 << (rank >> 12)
        packed = token[:n][alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner[alive], minlength=len(pieces)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of what pairs of tokens spell, -1 where that is no token."""
        key = left << 32 | right & 0xFFFFFFFF
        at = np.searchsorted(self._pair_key, key)
        return np.where(self._pair_key[at] == key, self._pair_value[at], -1)

    def _spell_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, and how many each has."""
        packed: list = [None] * len(pieces)
        short = []
        for i, piece in enumerate(p.encode("utf-8", "surrogatepass") for p in pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                packed[i] = np.array([whole], "<u4").tobytes()
            elif len(piece) > 64 or len(pieces) < 20:
                packed[i] = np.array(self.merge(piece), "<u4").tobytes()
            else:
                short.append((i, piece))
        for lo in range(0, len(short), 32_768):
            part = short[lo : lo + 32_768]
            for (i, _), ids in zip(part, self.merge_many([p for _, p in part])):
                packed[i] = ids
        return np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4

    def _spell_segments(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments by their keys, and how many each has."""
        parts: list = [None] * len(keys)
        plain = [i for i, k in enumerate(keys) if k.split() == [k]]
        if plain:  # no white space inside: put together, each begins with the one pre-token that begins with a space
            found = self._pretokens(" " + " ".join([keys[i] for i in plain]))
            begin = [j for j, p in enumerate(found) if p[0] == " "]
            for i, lo, hi in zip(plain, begin, [*begin[1:], len(found)]):
                parts[i] = found[lo:hi]
        for i, k in enumerate(keys):
            if parts[i] is None:
                parts[i] = self._pretokens(k[1:] if k[:1] == " " else " " + k)
        row = self._pieces.numbers(list(chain.from_iterable(parts)), self._spell_pieces)
        ids, size = self._pieces.spelled(row)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        stop = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n))]
        return ids, np.diff(stop)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has."""
        if max(len(self._segments), len(self._pieces)) > self.keep or max(len(self._segments.ids), len(self._pieces.ids)) > 16 * self.keep:
            self.forget()
        texts = pc.fill_null(texts, "")
        # A key is a segment without the space it begins with, or a space and a segment that begins with none. Where no
        # white space stands before a space, each space begins a segment.
        odd = pc.match_substring_regex(texts, self._spaced)
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        found, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        first = pc.list_element(split, 0).to_pylist()
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = [[x[1:] if x[:1] == " " and " " not in x[1:] else " " + x for x in self._cut(texts[i].as_py())] for i in odd.tolist()]
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        every = self._segments.numbers([*names, *(" " + x for x in first), *chain.from_iterable(cut)], self._spell_segments)
        row = every[: len(names)][found.indices.to_numpy()]
        row[offsets[:-1]] = every[len(names) : len(names) + len(first)]
        n = np.diff(offsets)
        if len(odd):
            own = np.split(every[len(names) + len(first) :], np.cumsum([len(x) for x in cut])[:-1])
            rows = np.split(row, offsets[1:-1])
            for i, x in zip(odd.tolist(), own):
                rows[i], n[i] = x, len(x)
            row = np.concatenate(rows)
        ids, size = self._segments.spelled(row)
        stop = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n))]
        return ids, np.diff(stop)

    def decode_array(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of ids that follow one another, and how many each list has; ``n``: a list's ids."""
        size = self._size[ids]
        stop = np.cumsum(size)
        out = self._bytes[_spread(self._begin[ids] - (stop - size), size)]
        return out, np.diff(np.append(0, stop)[np.append(0, np.cumsum(n))])

    def encode(self, text: str) -> bytes:
        return self.encode_array(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4")
        return self.decode_array(found, np.array([len(found)]))[0].tobytes()


def encoder(raw: bytes, pattern: str) -> Encoder:
    """One encoder, with its caches, for each vocabulary in a Python worker."""
    return held(("bpe", hash(raw), len(raw), pattern), lambda: Encoder(parse_ranks(raw), pattern))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, decoded``: every text's ids (packed as little-endian unsigned 32-bit integers) and the
    bytes that decoding these ids gives.

    A null or empty text has no ids; repeated rows are encoded alike, null ids stay null; other columns are not
    read. The vocabulary is read from ``ranks_path`` on the driver and broadcast (a fixed file of below 1 MB).
    """
    with open(ranks_path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def packed(values: np.ndarray, n: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(raw.value, pattern)
        for batch in batches:
            for part in portions(batch, 1, 2 << 20):
                ids, n = bpe.encode_array(part.column(1))
                yield pa.record_batch([part.column(0), packed(ids.astype("<u4"), 4 * n), packed(*bpe.decode_array(ids, n))], names=["id", "ids", "decoded"])
        bpe.forget()
        trim()

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of what :func:`encode` returns."""
    return encoded.select(
        id_col,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
