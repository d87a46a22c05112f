import itertools
import random

import numpy as np
import pytest
from quillon.llm import ngram_join
from quillon.llm.ngram_join import Trie, ngram_jaccard_join


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            links[i] += 1
            links[j] += 1
            i, j = find(i), find(j)
            if i != j:
                i, j = (i, j) if sets[i][0] < sets[j][0] else (j, i)
                root[j] = i
    return sorted((d, len(s), sets[find(i)][0] if s else d, links[i]) for i, (d, s) in enumerate(sets))


def families(seed, families=12, each=8, words=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 20, words]))]
        for _ in range(each):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append((n, " ".join(passage + t if r.random() < 0.3 else t)))
            n += 1
    return rows


EDGE = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "A b"), (1004, "a  B"), (1005, "one two three four five"), (1006, "ONE two three four five"), (None, "one two three four five"), (1007, "x " * 3000), (1005, "one two three four five"), (1008, "é è a b c d"), (1009, "É è a b c d")]


def answer(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = families(seed) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(ngram_jaccard_join(df)) == brute(rows)


def test_blocks_larger_than_a_trie(spark, monkeypatch):
    rows = families(3, families=4, each=14)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "TRIE_SETS", 4)
    assert answer(ngram_jaccard_join(df)) == brute(rows)
    monkeypatch.setattr(ngram_join, "TRIE_SETS", 1000)
    monkeypatch.setattr(ngram_join, "TRIE_GRAMS", 300)
    assert answer(ngram_jaccard_join(df)) == brute(rows)


@pytest.mark.parametrize("most", [4096, 2])
def test_repeated_ids_with_near_copies(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "TRIE_SETS", most)
    a, b = ([f"{k}{i}" for i in range(60)] for k in "ab")
    near = lambda t, i: " ".join([*t[:i], "changed", *t[i + 1 :]])
    rows = [(5, " ".join(a)), (5, " ".join(a)), (6, near(a, 0)), (5, " ".join(b)), (4, near(b, 59)), (8, near(a, 59)), (8, near(b, 0)), (8, "other text"), (6, near(a, 0))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(ngram_jaccard_join(df)) == brute(rows)


def test_shuffle_instead_of_broadcast_and_large_keys(spark, monkeypatch):
    from quillon.llm import components

    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "LARGE", 3)
    monkeypatch.setattr(ngram_join, "TRIE_SETS", 5)
    rows = families(5, families=5, each=14) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(ngram_jaccard_join(df)) == brute(rows)


@pytest.mark.parametrize("large", [1, 256])
def test_components(spark, monkeypatch, large):
    from quillon.llm import components
    from quillon.llm.spool import Spool

    monkeypatch.setattr(components, "LARGE", large)
    r = random.Random(large)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(120)] + [(500, 500 + i) for i in range(60)] + [(700 + i, 701 + i) for i in range(40)] + [(7, 7), (900, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Spool(spark, "test"), "c")
    assert {x.node: x.root for x in got.collect()} == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long"), Spool(spark, "test"), "c").count() == 0


def test_order_never_changes_the_result(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LOCAL_DF", 1)
    rows = families(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(ngram_jaccard_join(df)) == brute(rows)


def written(monkeypatch):
    """The tables that a run writes, by name."""
    tables, table = {}, ngram_join.Spool.table
    monkeypatch.setattr(ngram_join.Spool, "table", lambda spool, name, df: tables.setdefault(name, table(spool, name, df)))
    return tables


@pytest.mark.parametrize("each", [2, 20])
def test_passages_join_no_blocks(spark, monkeypatch, each):
    r = random.Random(each)
    rows, n = [], 0
    passages = [[f"p{k}-{i}" for i in range(12)] for k in range(7)]
    for k in range(6):  # each family shares a passage with the next one
        base = [f"{k}-{i}" for i in range(400)]
        for _ in range(each):
            t = list(base)
            t[r.randrange(400)] = "changed"
            rows.append((n, " ".join(passages[k] + t + passages[k + 1])))
            n += 1
    tables = written(monkeypatch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(ngram_jaccard_join(df)) == brute(rows)
    assert max(x["count"] for x in tables["members"].groupBy("root").count().collect()) <= each


@pytest.mark.parametrize("paired", [1, 3])
def test_pairs_or_hubs(spark, monkeypatch, paired):
    monkeypatch.setattr(ngram_join, "PAIRED_DF", paired)
    rows = families(6 + paired) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(ngram_jaccard_join(df)) == brute(rows)


@pytest.mark.parametrize("kinds", [64, 4096])
def test_ngrams_that_look_alike(spark, monkeypatch, kinds):
    monkeypatch.setattr(ngram_join, "mix", lambda x: x % np.uint64(kinds))
    rows = families(9) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(ngram_jaccard_join(df)) == brute(rows)


def test_fewer_pairs_than_postings(spark, monkeypatch):
    shared = spark.createDataFrame([(df,) for df in (2, 3, 3, 9) for _ in range(df)], "df long")
    assert ngram_join._paired_df(shared) == 8  # 1 + 3 + 3 pairs, and 36 more with 9, of 17 postings
    monkeypatch.setattr(ngram_join, "PAIRS", 3)
    assert ngram_join._paired_df(shared) == ngram_join.PAIRED_DF


def test_sets_go_to_tries_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TRIE_SETS", 4)
    monkeypatch.setattr(ngram_join, "SENT_BYTES", 10_000)
    monkeypatch.setattr(ngram_join, "input_bytes", lambda df: 0)
    tables = written(monkeypatch)
    rows = families(3, families=4, each=14) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(ngram_jaccard_join(df)) == brute(rows)
    rounds = [t.count() for name, t in tables.items() if name.startswith("linked-")]
    assert len(rounds) > 3 and max(rounds) < sum(rounds) / 2


def test_trie_equals_pairs():
    r = np.random.default_rng(6)
    base = [np.unique(r.integers(0, 1 << 40, 300).astype(np.uint64)) for _ in range(3)]
    sets = []
    for _ in range(60):
        b = base[r.integers(3)]
        kept = b[r.random(len(b)) > r.choice([0, 0.05, 0.1, 0.5])]
        sets.append(np.unique(np.r_[kept, r.integers(0, 1 << 40, r.choice([0, 5, 40])).astype(np.uint64)]))
    names = np.unique(np.concatenate(sets))[::7]
    for trie, (i, x) in ((t, e) for t in (Trie(sets), Trie(sets, (names, np.arange(len(names)) % 5))) for e in enumerate(sets)):
        want = [j for j, y in enumerate(sets) if j != i and 100 * (n := len(np.intersect1d(x, y))) >= 75 * (len(x) + len(y) - n)]
        assert trie.linked(i, 75).tolist() == want


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, component_id int, block string")
    assert answer(ngram_jaccard_join(df)) == []
    df = spark.createDataFrame([(1, "a b c d e f", 9, "q"), (2, "a b c d e f", None, None)], "doc_id long, text string, component_id int, block string")
    assert answer(ngram_jaccard_join(df)) == [(1, 2, 1, 1), (2, 2, 1, 1)]


def test_synthetic_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert answer(ngram_jaccard_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
