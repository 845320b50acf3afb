"""Language identification of mixed texts: scripts narrow the candidates, Viterbi over words labels the spans.

Training counts the letters' n-grams of words by language, hashed to a fixed number of buckets. A word scores every
language that writes its script; a switch of language between words costs a penalty, and the best path labels every
word. All texts of a batch take each step of the recursion together. A text's language is that of most of its letters.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, portions, trim

#: Where scripts begin, in code points (fixed values): letters from one entry to the next are of its script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2C80, "coptic"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x31A0, "han"),
    (0xA000, "yi"), (0xA640, "cyrillic"), (0xA720, "latin"), (0xAC00, "hangul"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x20000, "han"), (0x30000, "han"),
)
BEGINS = [b for b, _ in SCRIPTS]
BUCKETS = 1 << 15
#: The fit takes about this many documents at most, and of each language about this many if it has them.
FIT_DOCUMENTS, LEAST_DOCUMENTS = 4000, 20
NGRAMS = (1, 2, 3, 4)
#: Which code points below 2^16 are letters.
LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def script(word: str) -> str:
    """The script of a word's first letter; empty without one."""
    for c in word:
        if c.isalpha():
            return SCRIPTS[bisect_right(BEGINS, ord(c)) - 1][1]
    return ""


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all n-grams of the words, each between two spaces."""
    x = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = x == 32
    word = np.cumsum(space) - 1  # a space belongs to the word after it
    owners, buckets = [], []
    for n in NGRAMS:
        m = len(x) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for i in range(n):
            h = (h ^ x[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                inner |= space[i : i + m]
        if n == 1:
            inner = space[:m]
        on = np.flatnonzero(~inner)
        owners.append(word[on])
        buckets.append((h[on] >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    on = owner < len(words)
    return owner[on], bucket[on]


class Model:
    """Languages, log probabilities of buckets (bucket, language), and which languages write which script."""

    def __init__(self, languages: list[str], weight: np.ndarray, scripts: dict[str, np.ndarray], prior: int, penalty: float = 4.0):
        self.languages, self.weight, self.scripts, self.prior, self.penalty = languages, weight, scripts, prior, penalty
        self.forget()

    def forget(self) -> None:
        """The words met so far."""
        self._at: dict[str, int] = {}
        self._score, self._letters = np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64)

    def words(self, texts: list[list[str]]) -> np.ndarray:
        """Rows of the score table for all words of all texts."""
        if len(self._at) > 150_000:
            self.forget()
        at = self._at
        flat = [list(map(at.get, words)) for words in texts]
        new = dict.fromkeys(w for words, found in zip(texts, flat) if None in found for w, i in zip(words, found) if i is None)
        if new:
            score, letters = self._new(list(new))
            at.update(zip(new, range(len(self._score), len(self._score) + len(new))))
            self._score, self._letters = np.concatenate((self._score, score)), np.concatenate((self._letters, letters))
            flat = [list(map(at.get, words)) if None in found else found for words, found in zip(texts, flat)]
        return np.concatenate([np.array(f, np.int64) for f in flat]) if flat else np.zeros(0, np.int64)

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [w.replace(" ", "\0") for w in words]
        x = np.frombuffer((" ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.cumsum(x == 32)
        alpha = LETTER[np.minimum(x, 0xFFFF)]
        for i in np.flatnonzero(x > 0xFFFF).tolist():
            alpha[i] = chr(x[i]).isalpha()
        at = np.flatnonzero(alpha)
        letters = np.bincount(word[at], minlength=len(words))[: len(words)]
        owner, bucket = _grams(words)
        score = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            score[:, k] = np.bincount(owner, self.weight[bucket, k], len(words))
        score -= score.max(1, keepdims=True)
        score = np.maximum(score / len(NGRAMS), -6.0)
        score[letters == 0] = 0
        written, first = np.unique(word[at], return_index=True)
        place = np.searchsorted(BEGINS, x[at[first]], "right") - 1
        for i in np.unique(place).tolist():
            able, on = self.scripts.get(SCRIPTS[i][1]), written[place == i]
            if able is None:
                score[on] = 0  # no language learned writes this script
            elif not able.all():
                score[on] = np.where(able, score[on] - score[on][:, able].max(1, keepdims=True), -1e3)
        return score, letters

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list]]:
        """Of each text: language, score, spans (first word, last word, language)."""
        split = [(t or "").lower().split() for t in texts]
        n_texts, k = len(texts), len(self.languages)
        length = np.fromiter(map(len, split), np.int64, n_texts)
        order = np.argsort(-length, kind="stable")
        rank = np.empty(n_texts, np.int64)
        rank[order] = np.arange(n_texts)
        steps = int(length.max()) if n_texts else 0
        # Words by step, then by text, longest text first: a step is a slice.
        active = np.searchsorted(-length[order], -np.arange(steps), "left")
        begin = np.append(0, np.cumsum(active))
        n = int(begin[-1])
        start = np.cumsum(length) - length
        place = begin[np.arange(n) - np.repeat(start, length)] + np.repeat(rank, length)
        row = np.empty(n, np.int64)
        row[place] = self.words(split)
        score = self._score[row]
        best = np.zeros((n_texts, k), np.float32)
        # none: the state goes on; else where it comes from
        none = np.iinfo(np.uint8 if k < 255 else np.uint16).max
        come = np.full((n, k), none, np.uint8 if k < 255 else np.uint16)
        for t, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
            b = best[: hi - lo]
            if t:
                top = b.max(1)
                switched = (top - self.penalty)[:, None]
                worse = b < switched
                come[lo:hi] = np.where(worse, b.argmax(1)[:, None], none)
                np.maximum(b, switched, out=b)
                b -= top[:, None]
            b += score[lo:hi]
        path, now = np.zeros(n, np.int64), best.argmax(1)
        for lo, hi in zip(begin[-2::-1].tolist(), begin[:0:-1].tolist()):
            a = hi - lo
            path[lo:hi] = now[:a]
            source = come[lo:hi][np.arange(a), now[:a]]
            now[:a] = np.where(source == none, now[:a], source)
        path = path[place]  # by text again
        row = row[place]
        letters = self._letters[row]
        text_of = np.repeat(np.arange(n_texts), length)
        share = np.bincount(text_of * k + path, letters, n_texts * k).reshape(-1, k)
        total = share.sum(1)
        # words of a script that no language writes are labelled by their neighbours, but speak for none
        known = np.bincount(text_of, (self._score[row] != 0).any(1) * letters, n_texts)
        out: list = []
        change = np.flatnonzero((path[1:] != path[:-1]) & (text_of[1:] == text_of[:-1])) + 1
        turns = np.searchsorted(change, [start, start + length]).T.tolist()
        for i in range(n_texts):
            if not total[i]:
                out.append(("und", 0.0, []))
                continue
            o = int(start[i])
            at = [o, *change[turns[i][0] : turns[i][1]].tolist(), o + int(length[i])]
            spans = [(a - o, b - 1 - o, self.languages[path[a]]) for a, b in zip(at, at[1:])]
            j = int(share[i].argmax()) if known[i] else self.prior
            out.append((self.languages[j], float(share[i, j] / total[i] if known[i] else 1 / k), spans))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 4.0) -> Model | None:
    """The model learned from about FIT_DOCUMENTS rows at most, chosen by a hash of their id and text; None without any.

    Every language has an equal part of them (all its rows if they are fewer, and LEAST_DOCUMENTS in any case), so a rare one
    is learned however large the table is. The languages' names and counts are held on the driver.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    n = sum(sizes.values())
    if not n:
        return None
    if n > FIT_DOCUMENTS:
        quota = max(LEAST_DOCUMENTS, FIT_DOCUMENTS // len(sizes))
        rates = docs.sparkSession.createDataFrame([(lang, quota / size) for lang, size in sizes.items()], "lang string, rate double")
        draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        rows = rows.join(F.broadcast(rates), "lang").filter(draw < F.col("rate"))  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, scripts = found.setdefault(lang, (np.zeros(BUCKETS, np.int64), {}))
                words = [w for w in text.lower().split() if any(map(str.isalpha, w))]
                if words:
                    grams += np.bincount(_grams(words)[1], minlength=BUCKETS)
                    for w in words:
                        s = script(w)
                        scripts[s] = scripts.get(s, 0) + 1
        for lang, (grams, scripts) in found.items():
            on = np.flatnonzero(grams)
            yield pa.record_batch([pa.array([lang] * len(on)), pa.array([""] * len(on)), pa.array(on), pa.array(grams[on])], names=["lang", "script", "bucket", "n"])
            yield pa.record_batch([pa.array([lang] * len(scripts)), pa.array(list(scripts)), pa.array([-1] * len(scripts), pa.int64()), pa.array(list(scripts.values()), pa.int64())], names=["lang", "script", "bucket", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, script string, bucket long, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n"))
    counted = counted.collect()  # at most a row for each language and bucket or script
    languages = sorted({r["lang"] for r in counted}) or sorted(sizes)
    grams, scripts = np.zeros((BUCKETS, len(languages))), {}
    for r in counted:
        k = languages.index(r["lang"])
        if r["bucket"] >= 0:
            grams[r["bucket"], k] += r["n"]
        else:
            scripts.setdefault(r["script"], np.zeros(len(languages)))[k] += r["n"]
    weight = np.log((grams + 0.5) / (grams + 0.5).sum(0))
    words = sum(scripts.values()) if scripts else np.ones(len(languages))
    able = {s: c >= 0.005 * words for s, c in scripts.items()}
    prior = max(range(len(languages)), key=lambda k: (sizes.get(languages[k], 0), -k))
    return Model(languages, weight, {s: a for s, a in able.items() if a.any()}, prior, penalty)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of each row, from its text alone.

    A null text or one without a letter is ``und`` with score 0; a text in scripts that no learned language writes
    gets the commonest language and an even score; without a model all are ``und``. Repeated rows are labelled alike; an
    empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    # fixed size: buckets times languages
    sent = spark.sparkContext.broadcast(None if model is None else (model.languages, model.weight.astype(np.float32), model.scripts, model.prior, model.penalty))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):  # about 2 million characters at once
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 2_000_000):
                    size += len(texts[hi] or "")
                    hi += 1
                found = [("und", 0.0, [])] * (hi - lo) if parts is None else held(("langid", key), lambda: Model(*parts)).label(texts[lo:hi])
                spans = [[{"first": a, "last": b, "lang": s} for a, b, s in x[2]] for x in found]
                kinds = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array([x[0] for x in found]), pa.array([x[1] for x in found]), pa.array(spans, kinds)],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )
                lo = hi
        if parts is not None:
            held(("langid", key), lambda: Model(*parts)).forget()
        trim()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<first:long,last:long,lang:string>>")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that have a language; where ``lang_col`` is null it gets the predicted one.

    A row goes if its text is null, empty or without a letter, whatever the model. The prediction runs beside the row, so
    texts are not joined with it again, and repeated rows and clashing names do no harm. Without a model (no row has both a
    text and a language) rows with a letter stay as they are. An empty table stays empty.
    """
    if model is None:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.weight.astype(np.float32), model.scripts, model.prior, model.penalty))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = held(("langid", key), lambda: Model(*sent.value))
        for batch in batches:
            for part in portions(batch, names.index(text_col), 2 << 20):
                found = pa.array([x[0] for x in labeller.label(part.column(names.index(text_col)).to_pylist())], pa.string())
                if lang_col in names:
                    i = names.index(lang_col)
                    part = part.set_column(i, lang_col, pc.coalesce(part.column(i).cast(pa.string()), found).cast(part.schema.field(i).type))
                yield part.filter(pc.not_equal(found, "und"))
        labeller.forget()
        trim()

    return docs.mapInArrow(run, docs.schema)
