"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. Expectation-maximisation over
the counts of vote patterns estimates, without labels, how often each rule's votes say good on good
and on bad documents, under independence given the truth; abstaining says nothing. A document is kept by
its posterior probability of being good, not by passing every rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blobs import bounded
from quillon.llm.spool import Spool
from quillon.llm.wordhash import grams, hash_words

SYMBOLS = "#*$%&|<>"
RULES = ["length", "word_length", "symbols", "symbol_words", "letters", "repeats", "lines", "shouting", "stops", "digits"]
#: Least posterior probability of being good with which a document is kept.
KEEP_FROM = 0.5
#: EM starts from these shares: good documents, and correct votes of each rule.
PRIOR_GOOD, FIRST_ACCURACY, ROUNDS = 0.8, 0.8, 200
_SPACE = b" \t\n\x0b\x0c\r"
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_ALPHABETIC = _LETTER.copy()  # code points that are an ASCII letter or beyond ASCII
_ALPHABETIC[0xC0:] = True
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_letters", "n_upper", "n_marks", "n_symbol_words", "n_alphabetic"]


def _sum(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many are set in each text."""
    return np.diff(np.r_[0, np.cumsum(flags)][offsets])


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts in FEATURES for each text of a batch."""
    words = hash_words(column)
    data, offsets, first = words.data, words.offsets, words.first
    n = len(words.hash)
    begins = np.r_[0, np.cumsum(_HEAD[data])]
    out = {
        "n_words": np.diff(first),
        "n_symbols": _sum(_SYMBOL[data], offsets),
        "n_digits": _sum(_DIGIT[data], offsets),
        "n_letters": _sum(_LETTER[data], offsets),
        "n_upper": _sum(_UPPER[data], offsets),
        "n_alphabetic": _sum(_ALPHABETIC[data], offsets),
    }
    chars = begins[words.end] - begins[words.start]
    total = np.r_[0, np.cumsum(chars)]
    out["word_chars"] = np.diff(total[first])
    last = data[words.end - 1] if n else data[:0]
    out["n_marks"] = np.diff(np.r_[0, np.cumsum(np.isin(last, np.frombuffer(b".!?", np.uint8)))][first])
    symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
    out["n_symbol_words"] = np.diff(np.r_[0, np.cumsum(symbols[words.end] > symbols[words.start])][first])
    triple, repeat = grams(words.hash, 3), np.zeros(len(first) - 1, np.int64)
    lines, copies = np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64)
    texts = column.cast(pa.binary()).to_pylist()
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= 4:
            g = triple[a : b - 2]
            order = np.argsort(g, kind="stable")
            s = g[order]
            same = s[1:] == s[:-1]
            if same.any():
                twice = np.zeros(len(g) + 2, bool)
                hit = np.r_[False, same]
                hit[:-1] |= same
                at = order[hit]
                twice[at] = twice[at + 1] = twice[at + 2] = True
                repeat[i] = twice.sum()
        t = texts[i] or b""
        if b"\n" in t:
            seen = [x for x in t.split(b"\n") if x.strip(_SPACE)]
            lines[i], copies[i] = len(seen), len(seen) - len(set(seen))
        elif b > a:
            lines[i] = 1
    return out | {"n_repeat_words": repeat, "n_lines": lines, "n_dup_lines": copies}


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """One column a rule, in the order of RULES: 1 good, -1 bad, 0 abstains."""
    n, letters = np.maximum(f["n_words"], 1), np.maximum(f["n_letters"], 1)

    def between(x, good, bad, few=0):
        """Good up to ``good``, bad from ``bad``; abstains between, and on texts of under ``few`` words."""
        return np.where(f["n_words"] < few, 0, np.where(x <= good, 1, np.where(x >= bad, -1, 0)))

    length = np.where(f["n_words"] < 50, -1, np.where(f["n_words"] >= 80, 1, 0))
    mean = f["word_chars"] / n
    word_length = np.where((mean >= 3) & (mean <= 9), 1, np.where((mean < 2) | (mean > 12), -1, 0))
    return np.stack([
        length,
        word_length,
        between(f["n_symbols"] / n, 0.05, 0.15),
        between(f["n_symbol_words"] / n, 0.05, 0.15),
        between(-f["n_alphabetic"] / np.maximum(f["word_chars"], 1), -0.88, -0.82),
        between(f["n_repeat_words"] / n, 0.2, 0.4, 20),
        between(f["n_dup_lines"] / np.maximum(f["n_lines"], 1), 0.1, 0.3),
        between(f["n_upper"] / letters, 0.12, 0.4),
        between(-f["n_marks"] / n, -0.03, -0.005, 20),
        between(f["n_digits"] / np.maximum(f["word_chars"], 1), 0.08, 0.25),
    ], axis=1).astype(np.int8)


def encode(v: np.ndarray) -> np.ndarray:
    """A vote pattern as one number, base 3."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def decode(code: np.ndarray, rules: int) -> np.ndarray:
    return (np.asarray(code)[:, None] // 3 ** np.arange(rules, dtype=np.int64) % 3 - 1).astype(np.int8)


@dataclass
class LabelModel:
    """prior: share of good documents; table[r, v, y]: how likely a vote that rule r casts is v (bad, abstain, good)
    on class y (bad, good); 1 for abstaining."""

    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        log = np.log([1 - self.prior, self.prior])[None, :] + sum(np.log(self.table[r, v[:, r] + 1]) for r in range(v.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Of each rule: the probability that a vote it casts is right."""
        return self.table[:, 2, 1] * self.prior + self.table[:, 0, 0] * (1 - self.prior)


def fit_label_model(v: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """EM over distinct vote patterns and their counts; a pseudo-count a vote and class keeps estimates off 0 and 1."""
    rules, weight = v.shape[1], counts.astype(float)
    table = np.ones((rules, 3, 2))
    table[:, 0], table[:, 2] = (FIRST_ACCURACY, 1 - FIRST_ACCURACY), (1 - FIRST_ACCURACY, FIRST_ACCURACY)
    model, last = LabelModel(PRIOR_GOOD, table), None
    for _ in range(rounds):
        good = model.posterior(v)
        share = np.stack([weight * (1 - good), weight * good], axis=1)
        prior = float(np.clip((share[:, 1].sum() + PRIOR_GOOD) / (weight.sum() + 1), 0.01, 0.99))
        bad, good = (np.stack([share[v[:, r] == s].sum(0) + 1.0 for r in range(rules)]) for s in (-1, 1))
        table = np.stack([bad / (bad + good), np.ones_like(bad), good / (bad + good)], axis=1)
        model = LabelModel(prior, table)
        now = np.r_[prior, model.table.ravel()]
        if last is not None and np.abs(now - last).max() < 1e-9:
            break
        last = now
    return model


def _measure(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded(source):
        f = features(b.column(1))
        columns = [b.column(0), *(pa.array(f[k].astype(np.int64)) for k in FEATURES), pa.array(encode(votes(f)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *FEATURES, "pattern"])


def quality(docs: DataFrame, keep_from: float = KEEP_FROM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, p_good, votes (one of -1, 0, 1 for each of RULES).

    Null and empty texts have no words, fail the base rules and go. Rows that repeat a doc_id, and
    rows with a null one, each give a row. The model is fitted to the vote patterns of all rows of the table; there are
    at most 3 ** 10 patterns, so they alone reach the driver. Further columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    spool = Spool(spark, "quality")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    measured = spool.table("measured", docs.mapInArrow(_measure, "doc_id long, " + "".join(f"{k} long, " for k in FEATURES) + "pattern long"))
    seen = measured.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    v = decode(seen["pattern"].to_numpy(np.int64), len(RULES))
    p = fit_label_model(v, seen["n"].to_numpy()).posterior(v) if len(seen) else np.zeros(0)
    rows = [(int(c), float(x), [int(y) for y in z]) for c, x, z in zip(seen["pattern"], p, v, strict=True)]
    judged = spark.createDataFrame(rows, "pattern long, p_good double, votes array<int>")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.join(F.broadcast(judged), "pattern").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("p_good") >= keep_from)).alias("kept"), "p_good", "votes",
    )
