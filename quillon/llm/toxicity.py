"""Toxicity by a classifier chain.

Categories are predicted one after another: each has a linear model over words and their
beginnings, which stems share in languages that inflect, and the probabilities of all earlier categories are further features of it. In training those are out-of-fold
predictions, so that a later model learns how far the earlier ones can be trusted on texts they have
not seen; then each model is fitted to all training rows for use.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blobs import bounded
from quillon.llm.spool import Spool
from quillon.llm.wordhash import TOKEN, Words, hash_words, mix

#: The labelled rows that train the chain: at most so many, those whose ids hash lowest.
TRAINING_ROWS = 20_000
#: Bytes of the beginnings that are features of longer words.
BEGINNINGS = (5, 6)
#: Words and beginnings that are features: at most so many, by their chi-squared statistic with a category, in at
#: least so many training texts and with at least that statistic (p about 1e-6).
FEATURES, LEAST_TEXTS, LEAST_CHI2 = 2000, 4, 24.0
FOLDS, PENALTY, STEPS, CLOSE = 5, 0.05, 300, 1e-5
#: A document is flagged from the lowest probability on at which out-of-fold flags are right with this precision.
PRECISION, LOWEST = 0.98, 0.1
#: The chain over the synthetic labels, as SQL over their columns. They label one toxicity category, so the chain's first link is
#: low quality, which toxic texts share; tables that label several categories give theirs in the order of the chain.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
U = np.uint64


@dataclass
class Rows:
    """Sparse rows: the feature numbers of row i are index[start[i]:start[i + 1]]; dense: further columns."""

    index: np.ndarray
    start: np.ndarray
    width: int
    dense: np.ndarray

    @functools.cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    @functools.cached_property
    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have each feature, in a row, and where each feature's begin."""
        order = np.argsort(self.index, kind="stable")
        return self.row[order], np.r_[0, np.cumsum(np.bincount(self.index, minlength=self.width))]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return run_sums(w[: self.width][self.index], self.start) + self.dense @ w[self.width :]

    def back(self, e: np.ndarray) -> np.ndarray:
        row, start = self.columns
        return np.r_[run_sums(e[row], start), self.dense.T @ e]

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.start)[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[:-1][rows] - (ends - sizes), sizes) + np.arange(total)
        return Rows(self.index[at], np.r_[0, ends].astype(int), self.width, self.dense[rows])

    def beside(self, column: np.ndarray) -> Rows:
        return Rows(self.index, self.start, self.width, np.column_stack([self.dense, column]))


def run_sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of values[start[i]:start[i + 1]] for each i."""
    out, full = np.zeros(len(start) - 1), np.flatnonzero(start[1:] > start[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, start[full])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_logistic(x: Rows, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS, close: float = CLOSE) -> np.ndarray:
    """Weights, the last dense column being the intercept; accelerated gradient descent, deterministic."""
    n, w = max(len(y), 1), np.zeros(x.width + x.dense.shape[1])
    per_row = np.diff(x.start) + (x.dense**2).sum(1) if len(y) else np.ones(1)
    rate = 1 / (0.25 * max(float(np.quantile(per_row, 0.99)) if len(y) else 1.0, 1.0) + penalty / n)
    shrink = np.full(len(w), penalty / n)
    shrink[x.width] = 0
    v, t = w.copy(), 1.0
    loss = np.inf
    for _ in range(steps):
        s = x.dot(v)
        now = float(np.logaddexp(0, np.where(y > 0, -s, s)).mean() + 0.5 * (shrink * v * v).sum()) if len(y) else 0.0
        if now > loss:  # the step was too long for these rows
            rate, v, t = rate / 2, w.copy(), 1.0
            loss = np.inf
            continue
        if loss - now < close * loss and np.isfinite(loss):
            break
        loss = now
        following = v - rate * (x.back(sigmoid(s) - y) / n + shrink * v)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = following + (t - 1) / t_next * (following - w), following, t_next
    return w


@dataclass
class Chain:
    """Categories in order, with one model each. words: sorted hashes of feature words."""

    categories: list[str]
    words: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def predict(self, x: Rows) -> np.ndarray:
        """One column of probabilities a category."""
        out = []
        for w in self.weights:
            p = sigmoid(x.dot(w))
            out.append(p)
            x = x.beside(logit(p))
        return np.column_stack(out) if out else np.zeros((len(x.start) - 1, 0))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def fit_chain(x: Rows, labels: dict[str, np.ndarray], fold: np.ndarray, words: np.ndarray) -> Chain:
    """Fit each category in turn; later ones see out-of-fold probabilities of those before them."""
    chain = Chain(list(labels), words)
    for name, y in labels.items():
        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            held = fold == k
            if held.any():
                w = fit_logistic(x.take(np.flatnonzero(~held)), y[~held])
                unseen[held] = sigmoid(x.take(np.flatnonzero(held)).dot(w))
        chain.weights.append(fit_logistic(x, y))
        chain.thresholds[name] = threshold_for(unseen, y)
        x = x.beside(logit(unseen))
    return chain


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest probability, LOWEST at least, from which on the wanted share is right; a half if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[p[order][1:] != p[order][:-1], True] if len(y) else np.zeros(0, bool)
    fine = np.flatnonzero(last & (right >= precision) & (p[order] >= LOWEST))
    return float(p[order][fine[-1]]) if len(fine) else 0.5


def _feature_hashes(found: Words) -> list[np.ndarray]:
    """For each word: its hash, and that of each of its beginnings, 0 where the word is no longer than that."""
    out, length = [found.hash], found.end - found.start
    data = np.where((found.data >= 65) & (found.data <= 90), found.data + 32, found.data).astype(U)
    for n in BEGINNINGS:
        h = np.full(len(length), n, U)
        for i in range(n):
            h = h * U(0x100000001B3) + data[np.minimum(found.start + i, len(data) - 1)] if len(data) else h
        out.append(np.where(length > n, mix(h), U(0)))
    return out


def word_rows(column: pa.Array, words: np.ndarray) -> Rows:
    """Which feature words each text has."""
    found = hash_words(column, True, TOKEN)
    pairs = [np.zeros(0, int)]
    for h in _feature_hashes(found) if len(words) else []:
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = np.flatnonzero(words[at] == h)
        pairs.append((np.searchsorted(found.first, hit, "right") - 1) * len(words) + at[hit])
    pairs = np.unique(np.concatenate(pairs))
    text, index = pairs // max(len(words), 1), pairs % max(len(words), 1)
    n = len(found.first) - 1
    return Rows(index, np.searchsorted(text, np.arange(n + 1)), len(words), np.ones((n, 1)))


def _present(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct feature hashes of each training text."""
    for b in bounded(source):
        found = hash_words(b.column("text"), True, TOKEN)
        every = _feature_hashes(found)
        per = [np.unique(np.concatenate([h[a:z] for h in every])) for a, z in zip(found.first[:-1], found.first[1:], strict=True)]
        per = [p[p != 0] for p in per]
        flat = np.concatenate([np.zeros(0, U), *per])
        ends = np.r_[0, np.cumsum([len(p) for p in per], dtype=int)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("marks"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["doc_id", "marks", "words"])


def _packed(words: np.ndarray):
    """Map training texts to the numbers of the feature words that each has, two bytes a number."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(source):
            lists, marks = b.column("words"), b.column("marks")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(U)
            at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
            hit = words[at] == flat if len(words) else np.zeros(len(flat), bool)
            ends = np.r_[0, np.cumsum(hit)][np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist() if len(b) else [0]
            found = at[hit].astype("<u2")
            packed = [found[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
            flags = [np.array(m, np.int8).tobytes() for m in marks.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(flags, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "marks", "words"])

    return run


def train(docs: DataFrame, labels: DataFrame, spool: Spool, categories: dict[str, str], most_rows: int = TRAINING_ROWS) -> Chain:
    """The chain over labels (doc_id and what ``categories`` read: SQL expressions that are 0 or 1, in the chain's order).

    Trained on at most ``most_rows`` labelled documents, those whose ids hash lowest. Labels without a document, or with a null in any
    category, train nothing; of labels that repeat a doc_id one counts; without labels every probability is a half or lower.
    """
    names = list(categories)
    marks = F.array(*[F.expr(categories[c]).cast("int") for c in names])
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), marks.alias("marks")).where("doc_id IS NOT NULL AND NOT exists(marks, x -> x IS NULL)")
    chosen = chosen.groupBy("doc_id").agg(F.max("marks").alias("marks")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "marks")
    rows = spool.table("training", rows.mapInArrow(_present, "doc_id long, marks array<int>, words array<long>"))
    size = rows.agg(F.count("*"), *[F.coalesce(F.sum(F.col("marks")[i]), F.lit(0)) for i in range(len(names))]).first()
    n, *totals = (float(v) for v in size)
    each = rows.select("marks", F.explode("words").alias("word")).groupBy("word")
    each = each.agg(F.count("*").alias("n"), *[F.sum(F.col("marks")[i]).alias(f"n_{i}") for i in range(len(names))])

    def chi2(hits: str, total: float):
        a, b = F.col(hits), F.col("n")
        c, d = F.lit(total) - a, F.lit(n) - b
        below = b * d * F.lit(max(total, 1.0)) * F.lit(max(n - total, 1.0))
        return F.when(below > 0, F.lit(n) * F.pow(a * (d - c) - c * (b - a), 2) / below).otherwise(0.0)

    tells = functools.reduce(F.greatest, [chi2(f"n_{i}", t) for i, t in enumerate(totals)]) if len(names) > 1 else chi2("n_0", totals[0])
    best = each.where(f"n >= {LEAST_TEXTS}").select("word", tells.alias("x")).where(F.col("x") >= LEAST_CHI2).orderBy(F.desc("x"), "word").limit(FEATURES).toPandas()
    words = np.sort(best["word"].to_numpy(np.int64).view(U))
    held = rows.mapInArrow(_packed(words), "doc_id long, marks binary, words binary").orderBy("doc_id").collect()  # bounded by TRAINING_ROWS and FEATURES
    sizes = [len(r.words) // 2 for r in held]
    x = Rows(np.frombuffer(b"".join(r.words for r in held), "<u2").astype(np.int32), np.r_[0, np.cumsum(sizes, dtype=int)].astype(int), len(words), np.ones((len(held), 1)))
    y = np.frombuffer(b"".join(r.marks for r in held), np.int8).astype(float).reshape(len(held), len(names))
    return fit_chain(x, {c: y[:, i] for i, c in enumerate(names)}, folds(len(held)), words)


def folds(n: int) -> np.ndarray:
    """The fold of each training row, in the order of their ids."""
    return (np.arange(n) * 2654435761 >> 7) % FOLDS


def _score(chain: Chain, flag: str, threshold: float | None):
    at = chain.categories.index(flag)
    threshold = chain.thresholds[flag] if threshold is None else threshold

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(source):
            p = chain.predict(word_rows(b.column("text"), chain.words))
            columns = [b.column("doc_id"), *(pa.array(np.round(c, 6)) for c in p.T), pa.array(p[:, at] >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"p_{c}" for c in chain.categories), "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None, text: str = "text", doc_id: str = "doc_id", categories: dict[str, str] | None = None, flag: str = "toxic") -> DataFrame:
    """One row a document: doc_id, p_<category> for each of ``categories`` (CATEGORIES by default), and toxic: the probability of the
    category ``flag`` reaches the threshold, by default the one that out-of-fold predictions give.

    Null and empty texts have no words and get the models' intercepts. Rows that repeat a doc_id, and rows with a null one,
    each give a row. Further columns are ignored; empty tables give no rows, or an untrained chain's.
    """
    categories = categories or CATEGORIES
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chain = train(docs, labels, Spool(docs.sparkSession, "toxicity"), categories)
    return docs.mapInArrow(_score(chain, flag, threshold), "doc_id long, " + "".join(f"p_{c} double, " for c in categories) + "toxic boolean")
