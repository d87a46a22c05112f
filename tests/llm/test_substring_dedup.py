import hashlib
import random

import pytest
from quillon.llm import substring_dedup
from quillon.llm.substring_dedup import remove_repeats


def brute(rows, window=20):
    texts = {}
    for d, t in rows:
        if d is not None:
            texts[d] = (t or "").encode().split()
    seen, out = set(), {}
    for d in sorted(texts):
        w = texts[d]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    none = [(None, len((t or "").encode().split()), 0, hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()) for d, t in rows if d is None]
    return sorted([(d, *out[d]) for d, _ in rows if d is not None]) + sorted(none)


def answer(df):
    rows = [tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    return sorted(r for r in rows if r[0] is not None) + sorted(r for r in rows if r[0] is None)


def corpus(seed, n=80):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30 if seed % 2 else 500)]
    draw = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passages = [draw(r.choice([19, 20, 21, 35, 60])) for _ in range(8)]
    rows = []
    for d in r.sample(range(-50, 1000), n):
        words = draw(r.choice([0, 3, 19, 20, 40, 100]))
        for _ in range(r.choice([0, 1, 2])):
            p = list(r.choice(passages))
            if r.random() < 0.5:
                a = r.randrange(len(p))
                p = p[a : a + r.choice([15, 25, 50])]
            if p and r.random() < 0.3:
                p[r.randrange(len(p))] = r.choice(vocabulary)
            words += p + draw(r.choice([0, 1, 5]))
        if rows and r.random() < 0.15:
            words = r.choice(rows)[1].split()
        rows.append((d, r.choice([" ", "  ", "\n"]).join(words)))
    return rows


EDGE = [(2000, None), (2001, ""), (2002, "\t\n "), (None, "a b"), (2003, "z " * 500), (2004, "y " * 20), (2005, "y " * 21), (2006, "ab " * 3 + "cd " * 90)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_windows(spark, seed, monkeypatch):
    if seed == 3:  # tiny blocks, and nearly every shared anchor is hot
        monkeypatch.setattr(substring_dedup, "BLOCK", 50)
        monkeypatch.setattr(substring_dedup, "HOT", 2)
    rows = corpus(seed) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(remove_repeats(df)) == brute(rows)


def test_repeated_row_and_extra_columns(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 5), (1, text, None), (2, text, 6)], "doc_id long, text string, marks int")
    got = {(r.doc_id, r.n_removed) for r in remove_repeats(df).collect()}
    assert got == {(1, 0), (2, 30)}
    spans = remove_repeats(df).where("doc_id = 2").first()
    assert [tuple(x) for x in spans.repeats] == [(0, 30)] and spans.kept_text == ""


def test_other_texts_under_one_id_are_documents_of_their_own(spark):
    run = lambda c, a, z: " ".join(f"{c}{i}" for i in range(a, z))
    rows = [(1, run("a", 0, 40)), (2, run("a", 0, 30) + " " + run("b", 0, 30)), (2, run("c", 0, 80)), (3, run("c", 10, 50)), (3, run("c", 10, 50)), (None, run("a", 0, 30)), (4, None), (4, "")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), texts=False)
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got.collect()) == [(0, 30, 0), (1, 40, 0), (2, 60, 30), (2, 80, 0), (3, 40, 40), (3, 40, 40), (4, 0, 0), (4, 0, 0)]
    both = [(5, run("d", 0, 30)), (5, run("d", 0, 30) + " x")]  # the same passage in both: it stays in one
    got = [(r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(both, "doc_id long, text string"), texts=False).collect()]
    assert sorted(got) in ([(30, 0), (31, 30)], [(30, 30), (31, 0)])


def test_very_long_text_and_empty_table(spark):
    rows = [(1, "q " * 200_000 + "end"), (2, "q " * 25)]
    assert answer(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=False)) == brute(rows)


def test_empty_table(spark):
    assert answer(remove_repeats(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_synthetic_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert answer(remove_repeats(docs, texts=False)) == brute([(r.doc_id, r.text) for r in docs.collect()])
