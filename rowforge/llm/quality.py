"""Quality rules: a decision list learned by sequential covering over text statistics.

Rules for poor texts are conjunctions of thresholds. Each grows on two thirds of the labelled rows by the
condition of the most information gain, is pruned on the last third, and joins the list if it is precise enough (if not,
one that begins with another feature is tried); the rows that it covers then leave. The list is emitted as ordered Spark conditional expressions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The symbols that count (fixed by the contract).
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_digits")
#: Of labelled rows, the fit takes at most about this many, by a hash of their id.
FIT_ROWS = 20_000
UPPER, DIGITS, WHITE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", " \t\n\x0b\x0c\r"


def repeated(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        window ^= window >> np.uint64(29)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    at = np.sort(order[np.append(False, same) | np.append(same, False)])
    # exact: equal hashes count only if the words are equal
    count = Counter(tuple(words[i : i + WINDOW]) for i in at.tolist())
    at = np.array([i for i in at.tolist() if count[tuple(words[i : i + WINDOW])] > 1], np.int64)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The statistics COUNTS of one text; all 0 for a null or empty one."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        len(set(words)),
        len(raw) - len(raw.translate(None, UPPER)),
        raw.count(b"!") + raw.count(b"?"),
        len(raw) - len(raw.translate(None, DIGITS)),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and COUNTS of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([counts(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.record_batch([batch.column(0), *[pa.array(table[:, i]) for i in range(len(COUNTS))]], names=["doc_id", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


#: What the rules see: ratios, over 1 at least.
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "words_a_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def _holds(rule, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for f, over, t in rule:
        on &= (x[:, f] > t) if over else (x[:, f] <= t)
    return on


def _grown(x: np.ndarray, poor: np.ndarray, on: np.ndarray, banned: set[int], most_conditions: int, thresholds: int) -> list:
    """Conditions (feature, over, threshold), each the one of the most information gain on the rows that are left."""
    rule: list = []
    while len(rule) < most_conditions and (on & ~poor).any() and (on & poor).any():
        best = (1e-9, None)
        p0, n0 = (on & poor).sum(), (on & ~poor).sum()
        for f in range(x.shape[1]):
            if not rule and f in banned:
                continue
            steps = np.linspace(0, 1, thresholds)  # of all values and of those of poor rows, which may be few
            cuts = np.unique(np.concatenate((np.quantile(x[on, f], steps), np.quantile(x[on & poor, f], steps))))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if not len(cuts):
                continue
            own = np.sort(x[on & poor, f]), np.sort(x[on & ~poor, f])
            p_over, n_over = (len(o) - np.searchsorted(o, cuts, "right") for o in own)
            for over, p, n in ((True, p_over, n_over), (False, p0 - p_over, n0 - n_over)):
                gain = _gain(p.astype(float), n.astype(float), p0, n0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (f, over, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        on = on & _holds([best[1]], x)
    return rule


def learn(x: np.ndarray, poor: np.ndarray, most_rules: int = 24, most_conditions: int = 6, precision: float = 0.97, least: int = 3, thresholds: int = 64) -> list:
    """The rules for poor rows, each a list of (feature, over, threshold).

    A grown rule is pruned to the beginning that does best on the rows set aside, among those precise enough on all rows
    left. If none is, another is grown that begins with another feature; if no feature begins one, the list ends.
    """
    grow = np.arange(len(x)) % 3 != 2
    left, rules, banned = np.ones(len(x), bool), [], set()
    while len(rules) < most_rules and len(banned) < x.shape[1]:
        rule = _grown(x, poor, left & grow, banned, most_conditions, thresholds)
        if not rule:
            break
        best = (-2.0, None)
        for k in range(1, len(rule) + 1):
            on = _holds(rule[:k], x) & left
            held = on & ~grow
            worth = ((held & poor).sum() - (held & ~poor).sum()) / max(1, held.sum())
            if (on & poor).sum() >= max(least, precision * on.sum()) and worth > best[0]:
                best = (worth, rule[:k])
        if best[1] is None:
            banned.add(rule[0][0])
            continue
        rules.append(best[1])
        left &= ~_holds(best[1], x)
    return rules


def fit(stats: DataFrame, labels: DataFrame) -> list:
    """The rules learned from statistics (``doc_id``, COUNTS) of labelled rows (``doc_id``, ``quality`` 0 for poor);
    of rows that repeat an id, the least."""
    n = labels.count()
    some = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    if n > FIT_ROWS:
        some = some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * FIT_ROWS / n))
    some = some.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*[feature(f).alias(f) for f in FEATURES])).alias("x"))
    rows = rows.select("doc_id", "quality", "x.*").collect()  # one row for each id
    rows = sorted(rows, key=lambda r: (r[0] * 2654435761 % (1 << 32), *r[1:]))
    if not rows:
        return []
    return learn(np.array([r[2:] for r in rows], float), np.array([r[1] == 0 for r in rows]))


def verdict(rules: list) -> Column:
    """False where a rule holds, as ordered conditional expressions; true where none does."""
    names, out = list(FEATURES), None
    for rule in rules:
        on = F.lit(True)
        for f, over, t in rule:
            on = on & (feature(names[f]) > t if over else feature(names[f]) <= t)
        out = (F if out is None else out).when(on, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, COUNTS, ``base_failed`` and ``kept`` of each row.

    A null or empty text has no words, so the base rules reject it. Labels of ids that are not there, null labels and
    repeated labels (the least counts) do no harm; without labels only the base rules decide. Repeated rows are
    judged alike; an empty table gives an empty result; other columns are not read.
    """
    n = labels.count()
    wanted = labels.select("doc_id").filter("doc_id is not null")
    if n > FIT_ROWS:
        wanted = wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * FIT_ROWS / n))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rules = fit(statistics(own.join(F.broadcast(wanted.distinct()), "doc_id", "left_semi")), labels)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return statistics(own).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
