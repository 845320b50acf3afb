"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy.

A public byte-level vocabulary splits words into subword ids. The model gives every next id a probability: the class of
the id by masked attention over a window, by the last id and by the one before it, times the id's share of its class
after the last id (a softmax over the whole vocabulary, factored by classes). As input, ids belong to IN classes, as
output to OUT; common ids have a class each, others share one by the company they keep. A text is scored in blocks of
targets; each block sees itself and the block before it, so windows overlap and every id is scored once.

Each text is split into words and spelled once; its ids are written, and training and scoring read them. Words, ids and
pairs of ids are counted over all training texts, and classes and shares come from these counts. The attention is begun on
the driver and goes on in the cluster over all windows of all training texts.

Beside it stands the base score: add-one unigram word counts over all training texts. The commonest words (a bounded
number) are looked up where the texts are, the others by a join; the counts are the same either way, and ``score`` does
not depend on which way a word goes.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, portions, trim

BLOCK, DIM, IN, OUT = 8, 16, 256, 64
#: How many of the most frequent ids have an input or output class of their own.
OWN_IN, OWN_OUT = 192, 24
#: The attention is begun on the driver with a window of FIT_WINDOW ids of about FIT_DOCUMENTS training texts, by a hash
#: of their id, in about FIT_STEPS steps, and goes on over all windows of one of FIT_SHARE training texts: of every one.
FIT_DOCUMENTS, FIT_WINDOW, FIT_STEPS, FIT_SHARE = 3000, 128, 375, 1
#: Blocks of a training step, its rate in the cluster, and units of a sum.
STEP_BLOCKS, STEP_RATE, UNIT = 768, 0.004, 1 << 20
#: Words looked up without a join, at most, and bytes of a word's key: a longer word's key is its digest.
COMMON_WORDS, KEY_BYTES = 1 << 18, 64
#: Words that a Python worker keeps.
KEEP = 300_000
#: Neighbours by which ids are put into classes: the most frequent ids, and any other.
NEIGHBOURS = 64

_tokenizers: dict[int, tiktoken.Encoding] = {}


def tokenizer(raw: bytes, pattern: str) -> tiktoken.Encoding:
    key = hash(raw)
    if key not in _tokenizers:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _tokenizers[key] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _tokenizers[key]


def spaced_ids(encoding: tiktoken.Encoding) -> np.ndarray:
    """Which ids begin with a space, as the first id of a word does."""
    return np.array([encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(encoding.n_vocab)])


#: White space that is no plain space.
ODD_SPACE = re.compile(r"[^\S ]")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def key_of(word: bytes) -> bytes:
    """What a word is counted and joined by."""
    return word if len(word) <= KEY_BYTES else b"\0" + hashlib.sha256(word).digest()


def as_spelled(words: list[bytes]) -> list[bytes]:
    """The words as their ids spell them: what is no UTF-8 becomes U+FFFD."""
    try:
        b" ".join(words).decode()
    except UnicodeDecodeError:
        return [w.decode("utf-8", "replace").encode() for w in words]
    return words


class Words(dict):
    """Numbers the words of texts and keeps their ids, until ``keep`` words are held."""

    def __init__(self, encoding: tiktoken.Encoding, keep: int | None = None):
        super().__init__()
        self.encoding, self.keep, self.spaced = encoding, keep or KEEP, spaced_ids(encoding)
        self.width = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)], np.int32)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.names: list[bytes] = []
        self.begin, self.size, self.ids = (np.zeros(0, np.int32) for _ in range(3))

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, one after another, and how many words each text has."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        found, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        names, empty = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), found.dictionary.index("").as_py()
        if empty >= 0:  # what is split off at the ends of texts
            del names[empty]
        new = [w for w in names if w not in self]
        self.update(zip(new, range(len(self.names), len(self.names) + len(new))))
        self.names += new
        own = np.fromiter(map(self.__getitem__, names), np.int32, len(names))
        row = (np.insert(own, empty, -1) if empty >= 0 else own)[found.indices.to_numpy()]
        if empty >= 0:
            offsets = np.append(0, np.cumsum(row >= 0))[offsets]
            row = row[row >= 0]
        n = np.diff(offsets).astype(np.int64)
        if new:
            ids, size = self._spell(new)
            self.begin = np.concatenate((self.begin, (np.cumsum(size) - size + len(self.ids)).astype(np.int32)))
            self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))
        return row, n

    def _spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each after a space, and how many each has."""
        joined = (b" " + b" ".join(words)).decode("utf-8", "replace")
        if not ODD_SPACE.search(joined):  # no piece of the pattern then goes beyond a word, and only spaces begin words
            ids = np.array(self.encoding.encode_ordinary(joined), np.int32)
            begin = np.flatnonzero(self.spaced[ids])
            if len(begin) == len(words):
                return ids, np.diff(begin, append=len(ids)).astype(np.int32)
        each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        size = np.fromiter(map(len, each), np.int32, len(each))
        ids = np.fromiter(chain.from_iterable(each), np.int32, int(size.sum()))
        if not np.array_equal(np.flatnonzero(self.spaced[ids]), np.cumsum(size) - size) or self.width[ids].sum() != len(joined.encode()):
            raise ValueError("the vocabulary and its pattern leave out parts of words, or begin a word without its space")
        return ids, size

    def spelled(self, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words ``row`` and how many ids each text has, with its end."""
        size = self.size[row]
        stop = np.cumsum(size, dtype=np.int64)
        total = int(stop[-1]) if len(row) else 0
        ids = self.ids[np.arange(total, dtype=np.int32) + np.repeat((self.begin[row] - (stop - size)).astype(np.int32), size)]
        stop = np.append(0, stop)[np.append(0, np.cumsum(n))]
        return ids, np.diff(stop) + 1


def packed_ids(ids: np.ndarray, length: np.ndarray, n_vocab: int) -> pa.Array:
    """The ids of texts, of which each has ``length``, as a binary value for each text."""
    ids = ids.astype(_kind(n_vocab))
    offsets = np.append(0, np.cumsum(length) * ids.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def unpacked_ids(packed: pa.Array, n_vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """What packed_ids() had."""
    kind, packed = _kind(n_vocab), packed.cast(pa.binary())
    if not len(packed):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0]) // kind.itemsize
    ids = np.frombuffer(packed.buffers()[2], kind, size, int(offsets[0])) if size else np.zeros(0, kind)
    return ids, np.diff(offsets) // kind.itemsize


def _kind(n_vocab: int) -> np.dtype:
    return np.dtype(np.uint16 if n_vocab <= 1 << 16 else np.int32)


#: Distance of key from query; 1 where a query may see the key.
AWAY = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
SEEN = (AWAY >= 0).astype(np.float32)
ONE = np.ones(OUT, np.float32)
#: Rows of logits that are worked on while they are in a core's cache, rows that BLAS multiplies without packing, and
#: classes whose rows are summed together.
ROWS, FEW, NEAR = 2048, 256, 8
EYE = np.eye(NEAR, dtype=np.float32)
#: What the classes of a window are multiplied by to give the pairs (query, key), IN times the query plus the key.
PAIRED = np.kron(np.eye(BLOCK), np.ones(2 * BLOCK)).reshape(BLOCK, -1) * IN
PAIRED = (np.concatenate((np.zeros_like(PAIRED), PAIRED)) + np.tile(np.eye(2 * BLOCK), BLOCK)).astype(np.float32)


def _sum_rows(key: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums of the rows of ``values`` by their key, an input class: of narrow rows one class after another, of others
    by NEAR classes at a time, as products with 0 and 1."""
    if values.shape[1] <= DIM:
        n, out = np.bincount(key, minlength=IN), np.zeros((IN, values.shape[1]), np.float32)
        on = np.flatnonzero(n)
        out[on] = np.add.reduceat(values.take(np.argsort(key, kind="stable"), 0), (np.cumsum(n) - n)[on], 0)
        return out
    group = key // NEAR
    order, stop = np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=IN // NEAR)).tolist()
    own, out = EYE.take(key.take(order) % NEAR, 0), np.zeros((IN // NEAR, NEAR, values.shape[1]), np.float32)
    work = np.empty((FEW, values.shape[1]), np.float32)
    for lo, end, sums in zip([0, *stop], stop, out):
        for lo in range(lo, end, FEW):
            hi = min(lo + FEW, end)
            sums += own[lo:hi].T @ np.take(values, order[lo:hi], 0, out=work[: hi - lo], mode="clip")
    return out.reshape(IN, -1)


class Attention:
    """Tables q, k, v (input class, DIM), r (distance), u (DIM, output class), and b and c: what the last input class and
    the one before it make of an output class."""

    NAMES = ("q", "k", "v", "r", "u", "b", "c")

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.q, self.k, self.v = (rng.normal(0, 0.3, (IN, DIM)).astype(np.float32) for _ in range(3))
        self.r = (-0.05 * np.arange(2 * BLOCK)).astype(np.float32)
        self.u = rng.normal(0, 0.1, (DIM, OUT)).astype(np.float32)
        self.b, self.c = np.zeros((IN, OUT), np.float32), np.zeros((IN, OUT), np.float32)

    def prepare(self) -> None:
        """Works out what seen() and logits() look up; to be done whenever the tables have changed."""
        pairs = (self.q * np.float32(DIM**-0.5)) @ self.k.T
        if float(np.square(self.q).sum(1).max()) * float(np.square(self.k).sum(1).max()) > 900 * DIM:  # else none is beyond
            np.clip(pairs, -30, 30, out=pairs)
        self.pairs = np.exp(pairs, out=pairs).ravel()
        self.near = SEEN * np.exp(np.clip(self.r, -30, 30))[np.maximum(AWAY, 0)]
        most = lambda x: max(float(x.max()), -float(x.min()))
        self.tame = DIM * most(self.v) * most(self.u) + most(self.b) + most(self.c) < 80  # no logit overflows

    def seen(self, x: np.ndarray, before: np.ndarray, first: np.ndarray):
        """x, before (blocks, BLOCK): input classes, those of the block before each; ``first`` marks the blocks that begin
        a text. Gives the pairs (query, key) of the windows, the attention, the values and their mean."""
        both = np.concatenate((before, x), 1)
        at = (both.astype(np.float32) @ PAIRED).astype(np.intp).reshape(-1, BLOCK, 2 * BLOCK)
        a = self.pairs.take(at)
        a *= self.near
        a[first, :, :BLOCK] = 0
        rows = a.reshape(-1, 2 * BLOCK)
        rows *= (np.float32(1) / (rows @ ONE[: 2 * BLOCK]))[:, None]
        v = self.v.take(both, 0)
        return at, a, v, (a @ v).reshape(-1, DIM)

    def logits(self, h: np.ndarray, x: np.ndarray, last: np.ndarray, z: np.ndarray, work: np.ndarray) -> None:
        """Puts into ``z`` the logits of output classes, after mean values h, classes x and those one place back."""
        np.matmul(h, self.u, out=z)
        z += np.take(self.b, x, 0, out=work, mode="clip")
        z += np.take(self.c, last, 0, out=work, mode="clip")
        if not self.tame:
            z -= z.max(1, keepdims=True)

    def log_p(self, x: np.ndarray, last: np.ndarray, y: np.ndarray, first: np.ndarray, step: int = 128) -> np.ndarray:
        """Log probability of each target class y of blocks that follow one another. All is worked out for ``step`` blocks
        at a time, the last of them too, so that a text has the same probabilities wherever it stands."""
        self.prepare()
        size, n = len(x), step * BLOCK
        out = np.empty(-(-size // step) * n, np.float32)
        z, work, start = np.empty((n, OUT), np.float32), np.empty((n, OUT), np.float32), np.arange(0, n * OUT, OUT)
        for lo in range(0, size, step):
            some = [x[lo : lo + step], x[lo - 1 : lo + step - 1] if lo else np.concatenate((x[:1], x[: step - 1])), first[lo : lo + step], last[lo : lo + step], y[lo : lo + step]]
            if lo + step > size:
                some = [np.concatenate((k[: size - lo], np.zeros((lo + step - size, *k.shape[1:]), k.dtype))) for k in some]
            self.logits(self.seen(*some[:3])[-1], some[0].ravel(), some[3].ravel(), z, work)
            at = z.ravel().take(start + some[4].ravel())
            np.exp(z, out=z)
            out[lo * BLOCK : lo * BLOCK + n] = at - np.log(z @ ONE)
        return out[: size * BLOCK]

    def begin(self) -> None:
        """Forgets what step() holds of earlier gradients."""
        self._flat = None
        self._moments = np.zeros((2, self.packed().size), np.float32)
        self.steps = 0

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The tables in a row of numbers like that of packed()."""
        sizes = [getattr(self, n).size for n in self.NAMES]
        return {n: part.reshape(getattr(self, n).shape) for n, part in zip(self.NAMES, np.split(flat, np.cumsum(sizes)[:-1]))}

    def _join(self) -> None:
        """Lays the tables into one row, so that step() changes them at once."""
        if self._flat is None or any(getattr(self, n) is not own for n, own in self._own.items()):
            self._flat = self.packed()
            self._own, self._grad = self._views(self._flat), np.empty_like(self._flat)
            self._into, self.mean, self._work = self._views(self._grad), self._views(self._moments[0]), np.empty_like(self._flat)
            for n, own in self._own.items():
                setattr(self, n, own)

    def step(self, x: np.ndarray, last: np.ndarray, before: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step by the gradient of blocks as in seen(), with the classes ``last`` one place back, target classes y and
        their weight (0: no target)."""
        self._join()
        self.prepare()
        at, a, v, h = self.seen(x, before, first)
        classes, last, weight = x.ravel(), last.ravel(), weight.ravel() / np.float32(max(1.0, float(weight.sum())))
        n = len(classes)
        if len(self._room) < n + ROWS:
            self._room = np.empty((n + ROWS, OUT), np.float32)
        d, work = self._room[ROWS : ROWS + n], self._room[:ROWS]
        dh, target = np.empty((n, DIM), np.float32), np.arange(0, n * OUT, OUT) + y.ravel()
        for lo in range(0, n, ROWS):
            s, z = slice(lo, lo + ROWS), d[lo : lo + ROWS]
            self.logits(h[s], classes[s], last[s], z, work[: len(z)])
            np.exp(z, out=z)
            z *= (weight[s] / (z @ ONE))[:, None]
            z.reshape(-1)[target[s] - lo * OUT] -= weight[s]
            np.matmul(z, self.u.T, out=dh[s])
        g, whole = self._into, n // FEW * FEW
        np.sum(h[:whole].reshape(-1, FEW, DIM).transpose(0, 2, 1) @ d[:whole].reshape(-1, FEW, OUT), 0, out=g["u"])
        g["u"] += h[whole:].T @ d[whole:]
        g["b"][:] = _sum_rows(classes, d)
        g["c"][:] = _sum_rows(last, d)
        dh = dh.reshape(len(x), BLOCK, DIM)
        da = dh @ np.ascontiguousarray(v.transpose(0, 2, 1))
        da *= a
        rows = da.reshape(-1, 2 * BLOCK)
        rows -= a.reshape(-1, 2 * BLOCK) * (rows @ ONE[: 2 * BLOCK])[:, None]
        pairs = np.zeros(IN * IN, np.float32)
        np.add.at(pairs, at.ravel(), da.ravel())
        pairs = pairs.reshape(IN, IN)
        pairs *= np.float32(DIM**-0.5)
        np.matmul(pairs, self.k, out=g["q"])
        np.matmul(pairs.T, self.q, out=g["k"])
        dv = a.transpose(0, 2, 1) @ dh
        if np.array_equal(before[1:], x[:-1]):  # blocks that follow one another: a key's two places are summed at once
            sums = np.zeros((len(x) + 1, BLOCK, DIM), np.float32)
            sums[:-1] = dv[:, :BLOCK]
            sums[1:] += dv[:, BLOCK:]
            g["v"][:] = _sum_rows(np.append(before[:1], x), sums.reshape(-1, DIM))
        else:
            g["v"][:] = _sum_rows(np.concatenate((before, x), 1).ravel(), dv.reshape(-1, DIM))
        g["r"][:] = np.bincount(np.maximum(AWAY, 0).ravel(), np.ones(len(x), np.float32) @ da.reshape(len(x), -1), 2 * BLOCK)
        self.steps += 1
        now = np.float32(rate * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        g, w, (mean, square) = self._grad, self._work, self._moments
        for moment, part in ((mean, 0.1), (square, 0.01)):
            np.subtract(g, moment, out=w)
            w *= np.float32(part)
            moment += w
            np.square(g, out=g)
        np.sqrt(square, out=g)
        g += np.float32(1e-8)
        np.divide(mean, g, out=g)
        g *= now
        self._flat -= g

    _room = np.empty((0, OUT), np.float32)

    def train(self, laid: Laid, on: np.ndarray | None, rate: float) -> int:
        """Steps over the blocks ``on`` of texts, or over all in their order; returns how many targets they have."""
        targets = 0
        for lo in range(0, len(laid.x) if on is None else len(on), STEP_BLOCKS):
            i = slice(lo, lo + STEP_BLOCKS) if on is None else on[lo : lo + STEP_BLOCKS]
            before = laid.x[i - 1] if on is not None else laid.x[lo - 1 : lo - 1 + STEP_BLOCKS] if lo else np.concatenate((laid.x[-1:], laid.x[: STEP_BLOCKS - 1]))
            weight, x = laid.real[i].astype(np.float32), laid.x[i]
            targets += int(weight.sum())
            self.step(x, laid.last[i], before[: len(x)], laid.first[i], laid.y[i], weight, rate)
        return targets

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def unpack(self, values: np.ndarray) -> None:
        for n in self.NAMES:
            own = getattr(self, n)
            setattr(self, n, values[: own.size].reshape(own.shape).astype(np.float32))
            values = values[own.size :]


class Laid:
    """Texts laid out in blocks, each text from a block of its own: input classes ``x``, those one place back ``last``,
    target classes ``y``, ids ``target`` (the vocabulary's size for an end), which places are ``real``, which blocks
    are ``first`` of a text, and where texts ``begin``. ``length`` counts a text's ids and its end."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, into: np.ndarray, out: np.ndarray):
        blocks = -(-length // BLOCK)
        self.begin = (np.cumsum(blocks) - blocks) * BLOCK
        size = int(blocks.sum()) * BLOCK
        place = np.arange(len(ids), dtype=np.int64) + np.repeat(self.begin - (np.cumsum(length - 1) - (length - 1)), length - 1)
        y, x = np.full(size, OUT - 1, np.uint8), np.full(size + 1, IN - 1, np.uint8)
        self.target, real = np.full(size, len(into) - 1, np.int32), np.zeros(size, bool)
        y[place], x[place + 1], self.target[place], real[place] = out[ids], into[ids], ids, True
        real[self.begin + length - 1] = True
        x[self.begin] = IN - 1
        last = np.append(np.uint8(IN - 1), x[: max(size - 1, 0)])[:size]
        last[self.begin] = IN - 1
        self.x, self.last, self.y, self.real = (z[:size].reshape(-1, BLOCK) for z in (x, last, y, real))
        self.first = np.zeros(len(self.x), bool)
        self.first[self.begin // BLOCK] = True


def classes_of(frequency: np.ndarray, seen: np.ndarray, spaced: np.ndarray, classes: int, own: int, seed: int = 0) -> np.ndarray:
    """The class of each id, the last of all for a text's end: the ``own`` most frequent ids have one each, others are
    clustered by the ids next to them (``seen``), those that begin a word apart from the others; ids seen too rarely for
    that share one class of either kind."""
    order = np.argsort(-frequency, kind="stable")
    out = np.where(spaced, classes - 2, classes - 3)
    out[order[:own]] = np.arange(own)
    total, rest = seen.sum(1), order[own:]
    free, begin = classes - 3 - own, own
    for part, k in ((rest[spaced[rest]], free - free // 2), (rest[~spaced[rest]], free // 2)):
        ids = part[total[part] >= 6]
        if len(ids) <= k:
            out[ids] = begin + np.arange(len(ids))
        else:
            x = np.sqrt(seen[ids] / total[ids, None])
            center = x[np.random.default_rng(seed).choice(len(ids), k, False)]
            for _ in range(12):
                near = np.argmax(x @ center.T - 0.5 * (center**2).sum(1), 1)
                center = np.stack([x[near == j].mean(0) if (near == j).any() else center[j] for j in range(k)])
            out[ids] = begin + near
        begin += k
    return np.append(out, classes - 1).astype(np.uint8)


def shares_of(counts: np.ndarray, frequency: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Log share of each id in its class after each input class, by Witten and Bell, from ``counts`` (input class, id)."""
    every = np.append(frequency, 1.0) + 0.05
    plain = every / np.bincount(out, every, OUT)[out]
    total, kinds = np.zeros((IN, OUT)), np.zeros((IN, OUT))
    for c in range(OUT):
        total[:, c], kinds[:, c] = counts[:, out == c].sum(1), np.count_nonzero(counts[:, out == c], 1)
    share = np.empty(counts.shape, np.float32)
    for i in range(IN):  # row by row: the table is large enough
        t, k = total[i][out], kinds[i][out]
        share[i] = np.log(np.where(t > 0, (counts[i] + k * plain) / np.maximum(t + k, 1), plain))
    return share


def _texts(docs: DataFrame, raw, pattern: str) -> DataFrame:
    """``doc_id, trained, ids, word, pair, n``, written: a row of each text with its ids (packed_ids()), and, with null ids,
    what _counts() adds up: counts of parts of the training texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(raw.value, pattern)
        end = encoding.n_vocab
        words, times, pairs, id_type = Words(encoding, 2 * KEEP), np.zeros(0, np.int64), [], pa.null()

        def batch_of(size: int, **given: pa.Array) -> pa.RecordBatch:
            types = {"doc_id": id_type, "trained": pa.bool_(), "ids": pa.binary(), "word": pa.binary(), "pair": pa.int64(), "n": pa.int64()}
            return pa.record_batch([given.get(k, pa.nulls(size, t)) for k, t in types.items()], names=list(types))

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([c for _, c in pairs]), len(key)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            if len(words):  # pairs within words, once for each word
                pair = words.ids[:-1].astype(np.int64) * (end + 1) + words.ids[1:]
                inner = np.ones(len(words.ids), bool)
                inner[words.begin] = False
                pairs.append((pair[inner[1:]], np.repeat(times, words.size)[1:][inner[1:]]))
            if pairs:
                key, n = merged()
                pairs.clear()
                for lo in range(0, len(words), 100_000):
                    count = times[lo : lo + 100_000]
                    names = [key_of(w) for w, c in zip(as_spelled(words.names[lo : lo + 100_000]), count.tolist()) if c]
                    yield batch_of(len(names), word=pa.array(names, pa.binary()), n=pa.array(count[count > 0]))
                yield batch_of(int((n > 0).sum()), pair=pa.array(key[n > 0]), n=pa.array(n[n > 0]))
            words.forget()

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in portions(batch, 1):
                row, n = words.rows(part.column(1))
                ids, length = words.spelled(row, n)
                yield batch_of(len(n), doc_id=part.column(0), trained=part.column(2), ids=packed_ids(ids, length - 1, end))
                on = part.column(2).to_numpy(zero_copy_only=False)
                row, n = row[np.repeat(on, n)], n[on]
                times = np.bincount(row, minlength=len(words)) + np.append(times, np.zeros(len(words) - len(times), np.int64))
                # pairs across words: the last id of each word, or a text's beginning, and the first of the next, or its end
                first, last = words.ids[words.begin[row]], words.ids[words.begin[row] + words.size[row] - 1]
                place = np.arange(len(row)) + np.repeat(np.arange(len(n)), n)
                a, b = np.full(len(row) + len(n), end, np.int64), np.full(len(row) + len(n), end, np.int64)
                a[place + 1], b[place] = last, first
                a[np.append(0, np.cumsum(n + 1)[:-1])[: len(n)]] = end
                pairs.append(np.unique(a * (end + 1) + b, return_counts=True))
                if len(pairs) >= 64:
                    pairs[:] = [merged()]
                if len(words) > words.keep:
                    yield from flush()
                    times = np.zeros(0, np.int64)
        yield from flush()
        trim()

    found = docs.select("doc_id", "text", "trained").mapInArrow(run, f"doc_id {kind}, trained boolean, ids binary, word binary, pair long, n long")
    found = cut(found, "lm-texts")
    # by name: files of one size go into tasks in the order of their listing, which is any, and training follows it
    return docs.sparkSession.read.schema(found.schema).parquet(*sorted(found.inputFiles()))


def _counts(docs: DataFrame, raw, pattern: str) -> DataFrame:
    """``word, pair, n``: over all training texts of what _texts() gave, or of all rows of a table of texts, how often each
    word (its key; pair is null) is there, and how often an id follows another, ``pair`` being the one before times the
    vocabulary's size and 1, plus the other (word is null). The vocabulary's size stands for a text's beginning and end."""
    if "ids" not in docs.columns:
        docs = _texts(docs.select("doc_id", "text", F.lit(True).alias("trained")), raw, pattern)
    return cut(docs.filter("ids is null").groupBy("word", "pair").agg(F.sum("n").alias("n")), "lm-counts")


def _cells(pairs: DataFrame, key, size: int) -> np.ndarray:
    """Sums of the pairs' counts by cell: ``key`` gives of arrays of ids before and after any number of arrays of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for cells, on in key(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                np.add.at(sums, cells, batch.column(2).to_numpy()[on])
        on = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(on), pa.array(sums[on])], names=["cell", "n"])

    found = pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # bounded by the vocabulary
    sums = np.zeros(size)
    sums[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return sums


def _neighbours(pairs: DataFrame, frequency: np.ndarray) -> np.ndarray:
    """For each id (row) how often each of the most frequent ids, or any other, is before it and after it."""
    n_vocab, width = len(frequency), 2 * (NEIGHBOURS + 1)
    near = np.full(n_vocab + 1, NEIGHBOURS)
    near[np.argsort(-frequency, kind="stable")[:NEIGHBOURS]] = np.arange(NEIGHBOURS)

    def key(a, b):
        on = (a < n_vocab) & (b < n_vocab)
        a, b = a[on], b[on]
        return (b * width + near[a], on), (a * width + NEIGHBOURS + 1 + near[b], on)

    return _cells(pairs, key, n_vocab * width).reshape(-1, width).astype(np.float32)


def _sample(docs: DataFrame, raw, pattern: str, n: int) -> list[np.ndarray]:
    """A window of each of about FIT_DOCUMENTS texts, from which the attention begins."""
    if n > FIT_DOCUMENTS:
        docs = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * FIT_DOCUMENTS / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = tokenizer(raw.value, pattern).n_vocab
        for batch in batches:
            windows = []
            ids, length = unpacked_ids(batch.column(0), end)
            for hi, size in zip(np.cumsum(length).tolist(), length.tolist()):
                own = ids[hi - size : hi]
                at = 0 if size <= FIT_WINDOW else hash(tuple(own[:64].tolist())) % (size - FIT_WINDOW + 1)
                windows.append(own[at : at + FIT_WINDOW].tolist())
            yield pa.record_batch([pa.array(windows, pa.list_(pa.int64()))], names=["window"])

    found = docs.select("ids").mapInArrow(run, "window array<long>")
    found = found.limit(2 * FIT_DOCUMENTS).collect()  # in case one id has many rows
    return [np.array(w, np.int64) for w in sorted(tuple(r["window"]) for r in found)]


def _go_on(docs: DataFrame, raw, pattern: str, attention: Attention, into: np.ndarray, out: np.ndarray) -> int:
    """Trains the attention on all blocks of all training texts and returns how many targets they have.

    Each task goes on from the same tables over its own texts, and the tasks' tables are averaged by their targets. Sums
    are of whole units, so the order of tasks does not matter.
    """
    start = attention.packed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = tokenizer(raw.value, pattern).n_vocab
        own = Attention()
        own.unpack(start)
        own.begin()
        targets = 0
        for batch in batches:
            for part in portions(batch, 0):
                ids, length = unpacked_ids(part.column(0), end)
                laid = Laid(ids, length + 1, into, out)
                targets += own.train(laid, None, STEP_RATE)
        if targets:
            values = np.rint(own.packed().astype(np.float64) * UNIT).astype(np.int64) * targets
            values = np.append(values, targets)
            yield pa.record_batch([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "v"])

    # a row for each number of the tables, whatever the number of tasks
    found = docs.select("ids").mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v")).toArrow()
    if not found.num_rows:
        return 0
    values = np.zeros(len(start) + 1)
    values[found.column("at").to_numpy()] = found.column("v").to_numpy()
    attention.unpack(values[:-1] / values[-1] / UNIT)
    return int(values[-1])


class Model:
    """The attention, each id's input and output class (a text's end last), and the log share of ids: a column for each
    id that is in the training texts, by ``column``, and one for all others of either kind."""

    def __init__(self, attention: Attention, into: np.ndarray, out: np.ndarray, column: np.ndarray, share: np.ndarray):
        self.attention, self.into, self.out, self.column, self.share = attention, into, out, column, share

    def log_p(self, laid: Laid) -> np.ndarray:
        """Natural log probability of every target, 0 where there is none."""
        p = self.attention.log_p(laid.x, laid.last, laid.y, laid.first).astype(np.float64)
        p += self.share.ravel().take(laid.x.ravel().astype(np.int64) * self.share.shape[1] + self.column[laid.target])
        p[~laid.real.ravel()] = 0
        return p


def fit(docs: DataFrame, pairs: DataFrame, raw, pattern: str, n: int) -> Model:
    """The model learned from training rows ``doc_id, ids``, of which there are n, and their counted pairs ``a, b, n``."""
    windows = _sample(docs, raw, pattern, n)
    encoding = tokenizer(raw.value, pattern)
    end = encoding.n_vocab
    spaced = spaced_ids(encoding)
    frequency = _cells(pairs, lambda a, b: ((b, slice(None)),), end + 1)[:end]
    seen = _neighbours(pairs, frequency)
    into, out = classes_of(frequency, seen, spaced, IN, OWN_IN), classes_of(frequency, seen, spaced, OUT, OWN_OUT)
    after = _cells(pairs, lambda a, b: ((into[a].astype(np.int64) * (end + 1) + b, slice(None)),), IN * (end + 1))
    share = shares_of(after.reshape(IN, end + 1), frequency, out)
    # ids that are not in the texts differ by their kind only
    met = np.append(frequency > 0, True)
    shown = np.append(np.flatnonzero(met), [int(np.flatnonzero(~met[:-1] & (spaced == kind))[0]) if (~met[:-1] & (spaced == kind)).any() else 0 for kind in (False, True)])
    column = np.where(met, np.cumsum(met) - 1, len(shown) - 2 + np.append(spaced, False)).astype(np.int64)
    attention = Attention()
    attention.b[:, np.bincount(out, minlength=OUT) == 0] = -30  # classes without an id
    attention.begin()
    if windows:
        length = np.array([len(w) + 1 for w in windows])
        laid = Laid(np.concatenate(windows), length, into, out)
        rng = np.random.default_rng(0)
        epochs = min(100, max(1, round(FIT_STEPS * STEP_BLOCKS / len(laid.x))))
        for epoch in range(epochs):
            attention.train(laid, rng.permutation(len(laid.x)), 0.02 * (1 - 0.8 * epoch / epochs))
    _go_on(docs, raw, pattern, attention, into, out)
    return Model(attention, into, out, column, np.ascontiguousarray(share[:, shown]))


class Scorer:
    """Scores texts by their ids; ``common`` has the counts of words by their keys."""

    def __init__(self, model: Model, encoding: tiktoken.Encoding, common: dict[bytes, int]):
        self.model, self.n_vocab, self.common, self.spaced = model, encoding.n_vocab, common, spaced_ids(encoding)
        self.bytes = pa.array([encoding.decode_single_token_bytes(i) for i in range(encoding.n_vocab)], pa.binary())
        self.width = pc.binary_length(self.bytes).to_numpy()

    def words(self, ids: np.ndarray, begin: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The keys of the distinct words that begin at ``begin``, and which one each word is."""
        ids = np.ascontiguousarray(ids)
        offsets = (np.append(begin, len(ids)) * ids.itemsize).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).dictionary_encode()
        each, n = found.dictionary, len(found.dictionary)  # as ids; spelled now
        own = np.frombuffer(each.buffers()[2], ids.dtype, each.buffers()[2].size // ids.itemsize)
        stop = np.frombuffer(each.buffers()[1], np.int32)[: n + 1] // ids.itemsize
        own = own[: stop[-1]]
        at = np.repeat(np.append(0, np.cumsum(self.width[own], dtype=np.int64))[stop].astype(np.int32), 2)[:-1]
        at[1::2] += 1  # the space of each word apart
        spelled = self.bytes.take(pa.array(own)).buffers()[2]
        names = pa.Array.from_buffers(pa.binary(), 2 * n, [None, pa.py_buffer(at), spelled]).take(pa.array(np.arange(1, 2 * n, 2)))
        keys = names.to_numpy(zero_copy_only=False).tolist()
        for i in np.flatnonzero(pc.binary_length(names).to_numpy() > KEY_BYTES).tolist():
            keys[i] = key_of(keys[i])
        return keys, found.indices.to_numpy()

    def score(self, packed: pa.Array) -> list[pa.Array]:
        """Of each text: words and one end, words that are common, the sum of their log10(count + 1), the model's log10
        probability, and the keys of all other words."""
        ids, length = unpacked_ids(packed, self.n_vocab)
        begin = np.flatnonzero(self.spaced[ids])
        n = np.diff(np.searchsorted(begin, np.append(0, np.cumsum(length))))
        keys, row = self.words(ids, begin) if len(begin) else ([], np.zeros(0, np.int32))
        laid = Laid(ids, length + 1, self.model.into, self.model.out)
        score = np.add.reduceat(self.model.log_p(laid), laid.begin) / math.log(10) if len(n) else np.zeros(0)
        count, text = np.fromiter(map(self.common.get, keys, repeat(0)), np.int64, len(keys)), np.repeat(np.arange(len(n)), n)
        known = (count > 0)[row]
        common = np.bincount(text, known, len(n)).astype(np.int64)
        logs = np.bincount(text, np.log10(count + 1.0)[row], len(n)).astype(np.float64)  # whole numbers if there is no word
        others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n - common)), pa.int32()), pa.array(keys, pa.binary()).take(pa.array(row[~known])))
        return [pa.array(n + 1), pa.array(common), pa.array(logs), pa.array(score), others]


def score(docs: DataFrame, ranks_path: str, pattern: str, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    ``training`` is a condition over the columns of ``docs``: the rows to learn from. A null or empty text is its end
    alone; repeated rows score alike; without training rows all counts are 0 and the model is untrained; an empty
    table gives an empty result; other columns are not read. The vocabulary (below 1 MB) is read from
    ``ranks_path`` on the driver.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("trained"))
    end = tokenizer(raw.value, pattern).n_vocab
    texts = _texts(rows, raw, pattern)
    counts = _counts(texts, raw, pattern)
    rows = texts.filter("ids is not null").select("doc_id", "ids", "trained")
    words = counts.filter("pair is null").select("word", F.col("n").alias("c"))
    pairs = counts.filter("pair is not null").select(F.expr(f"pair div {end + 1}").alias("a"), (F.col("pair") % (end + 1)).alias("b"), "n")
    n = int(pairs.filter(F.col("a") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])  # texts
    step = F.floor(F.log2("c") * 4).cast("int")  # a few hundred rows at most
    steps = sorted(words.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.sum("c").alias("c")).collect(), reverse=True)
    total, distinct = sum(r["c"] for r in steps) + n, sum(r["n"] for r in steps) + (n > 0)
    least, many = 1 << 62, 0
    for r in steps:
        many += r["n"]
        if many > COMMON_WORDS:
            break
        least = r["least"]
    found = words.filter(F.col("c") >= least).toArrow()  # at most COMMON_WORDS keys
    common = dict(zip(found.column("word").to_pylist(), found.column("c").to_pylist()))
    model = fit(rows.filter("trained"), pairs, raw, pattern, n)
    sent = spark.sparkContext.broadcast((model, common))  # bounded by the vocabulary and COMMON_WORDS
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("lm", key), lambda: Scorer(sent.value[0], tokenizer(raw.value, pattern), sent.value[1]))
        for batch in batches:
            for part in portions(batch, 1):
                yield pa.record_batch([part.column(0), part.column(2), *scorer.score(part.column(1))], names=["doc_id", "trained", "n_tokens", "n", "total", "score", "words"])
        trim()

    made = rows.mapInArrow(run, f"doc_id {kind}, trained boolean, n_tokens long, n long, total double, score double, words array<binary>")
    made = cut(made.withColumn("row", F.monotonically_increasing_id()), "lm-scored")  # written, so row is fixed
    rest = words.filter(F.col("c") < least)
    others = made.select("row", F.explode("words").alias("word")).join(rest, "word").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("more_n"))
    base = F.col("total") + F.coalesce("more", F.lit(0.0)) + F.lit(math.log10(n + 1)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return made.drop("words").join(others, "row", "left").select(
        "doc_id", "trained", "n_tokens", (F.col("n") + F.coalesce("more_n", F.lit(0)) + F.lit(int(n > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
