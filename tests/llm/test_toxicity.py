import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillon.llm.toxicity import BEGINNINGS, FOLDS, LEAST_CHI2, LEAST_TEXTS, PENALTY, Rows, fit_chain, fit_logistic, folds, logit, sigmoid, toxicity


def rows_of(dense_bits):
    index = [np.flatnonzero(b) for b in dense_bits]
    return Rows(np.concatenate(index), np.r_[0, np.cumsum([len(i) for i in index])], dense_bits.shape[1], np.ones((len(dense_bits), 1)))


def test_logistic_reaches_the_optimum():
    r = np.random.default_rng(3)
    bits = r.random((500, 6)) < 0.4
    y = (r.random(500) < sigmoid(bits @ np.array([2, -1, 0, 1, 0.5, -2.0]) - 0.3)).astype(float)
    x = rows_of(bits)
    w = fit_logistic(x, y, steps=3000, close=-1.0)
    gradient = x.back(sigmoid(x.dot(w)) - y) / 500 + 0.05 * np.r_[w[:6], 0] / 500
    assert np.abs(gradient).max() < 1e-5


def test_later_models_use_earlier_probabilities():
    r = np.random.default_rng(4)
    bits = r.random((2000, 5)) < 0.3
    first = bits[:, 0].astype(float)
    chain = fit_chain(rows_of(bits), {"a": first, "b": first, "c": 1 - first}, np.arange(2000) % 5, np.arange(5, dtype=np.uint64))
    assert [len(w) for w in chain.weights] == [6, 7, 8]
    assert chain.weights[1][6] > 0 and chain.weights[2][6] < 0
    p = chain.predict(rows_of(bits))
    assert ((p > 0.5) == np.column_stack([first, first, 1 - first])).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where(F.col("doc_id") % 2 == 0)
    held = toxicity(docs, known).join(labels.where(F.col("doc_id") % 2 == 1).withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    hit = held.toxic & (held.truth == 1)
    assert hit.sum() / held.toxic.sum() > 0.9 and hit.sum() / (held.truth == 1).sum() > 0.8


@pytest.mark.parametrize("labels", [[], [(1, None, 1), (7, 1, 0), (3, 0, 1), (None, 1, 1)]])
def test_nulls_repeats_and_empty_tables(spark, labels):
    rows = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "z"), (4, "w " * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, toxic int, words string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.p_toxic <= 1 for r in got)
    assert toxicity(docs.limit(0), marks).count() == 0


def test_half_the_labels_toxic(spark):
    r = np.random.default_rng(5)
    plain, attack = [f"word{i}" for i in range(60)], [f"vile{i}" for i in range(12)]
    rows = [(i, " ".join([*r.choice(plain, 20), *(r.choice(attack, 8, replace=False) if i % 2 else ())])) for i in range(400)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()}
    assert all(got[i].toxic == (i % 2 == 1) for i in range(300, 400))


def brute_chain(texts, labels, categories):
    """The chain by sets of words, dense matrices and Newton's method: probabilities of each text and category, by id."""
    def present(t):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())
        words = [w.lower() for w in words]
        return {("w", w) for w in words} | {(k, w[:k]) for w in words for k in BEGINNINGS if len(w) > k}

    def newton(x, y):
        w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], PENALTY / len(y))
        shrink[marks] = 0
        for _ in range(60):
            p = sigmoid(x @ w)
            h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(shrink) + 1e-9 * np.eye(len(w))
            w = w - np.linalg.solve(h, x.T @ (p - y) / len(y) + shrink * w)
        return w

    sets = {d: present(t) for d, t in texts.items()}
    rows = sorted(labels)
    n, y = len(rows), np.array([labels[d] for d in rows], float)
    chosen = []
    for f in sorted(set().union(*(sets[d] for d in rows)), key=str):
        has = np.array([f in sets[d] for d in rows])
        best = 0
        for k in range(len(categories)):
            a, b, c, e = (np.sum(has & (y[:, k] == 1)), np.sum(has & (y[:, k] == 0)), np.sum(~has & (y[:, k] == 1)), np.sum(~has & (y[:, k] == 0)))
            under = (a + b) * (c + e) * max(a + c, 1) * max(b + e, 1)
            best = max(best, n * (a * e - b * c) ** 2 / under if under else 0)
        if has.sum() >= LEAST_TEXTS and best >= LEAST_CHI2:
            chosen.append(f)
    marks = len(chosen)
    matrix = lambda ids: np.array([[f in sets[d] for f in chosen] + [1] for d in ids], float)
    x, every, out = matrix(rows), matrix(list(texts)), []
    at = folds(n)
    for k in range(len(categories)):
        unseen = np.zeros(n)
        for j in range(FOLDS):
            unseen[at == j] = sigmoid(x[at == j] @ newton(x[at != j], y[at != j, k]))
        p = sigmoid(every @ newton(x, y[:, k]))
        out.append(p)
        every, x = np.column_stack([every, logit(p)]), np.column_stack([x, logit(unseen)])
    return {d: [p[i] for p in out] for i, d in enumerate(texts)}


def test_a_chain_of_three_categories_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fit_logistic, "__defaults__", (PENALTY, 4000, -1.0))  # to the optimum
    r = np.random.default_rng(7)
    plain, insult, threat = [f"wörd{i}" for i in range(40)], ["Idiot", "moronic", "morons", "stupidest"], ["killing", "hurting", "destroyed"]
    texts, labels = {}, {}
    for d in range(260):
        a = r.random() < 0.4
        b = a and r.random() < 0.6
        words = [*r.choice(plain, 12), *(r.choice(insult, 2) if a else ()), *(r.choice(threat, 1) if b else ())]
        if r.random() < 0.1:
            words += [str(r.choice(insult))]
        texts[d] = ", ".join(map(str, r.permutation(words)))
        if d < 200:
            labels[d] = (int(a), int(b), int(a and b))
    texts |= {900: None, 901: "", 902: "idiot " * 3000}
    names = {"insult": "i", "threat": "t", "attack": "x"}
    want = brute_chain(texts, labels, names)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = toxicity(docs, spark.createDataFrame([(d, *v) for d, v in labels.items()], "doc_id long, i int, t int, x int"), categories=names, flag="attack").collect()
    assert len(got) == len(texts)
    for row in got:
        assert [row.p_insult, row.p_threat, row.p_attack] == pytest.approx(want[row.doc_id], abs=2e-3)


def test_default_stop_is_near_the_optimum():
    r = np.random.default_rng(6)
    bits = r.random((2000, 40)) < 0.2
    y = (r.random(2000) < sigmoid(bits @ r.normal(0, 1.5, 40) - 1)).astype(float)
    x = rows_of(bits)

    def loss(w):
        s = x.dot(w)
        return np.logaddexp(0, np.where(y > 0, -s, s)).mean() + 0.5 * 0.05 / 2000 * (w[:40] ** 2).sum()

    assert loss(fit_logistic(x, y)) <= 1.005 * loss(fit_logistic(x, y, steps=5000, close=-1.0))
