import hashlib
import random
import re

from pyspark.sql import functions as F
from quillon.llm.decontaminate import PositionalIndex, contamination
from quillon.llm.spool import Spool


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes, out = {len(w) for w in windows}, []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[x]
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def answer(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def case(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["the", "a", "of", *(f"w{i}" for i in range(60)), "été", "Ünd", "x1"]
    draw = lambda k: [r.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(draw(r.choice([1, 2, 3, 4, 9, 10, 11, 30])))) for i in range(3, 15)]
    items += [(20, items[0][1]), (21, None), (22, "!!"), (23, "z z z z z z z z z z z z"), (None, "the of a")]
    docs = []
    for d in range(n):
        w = draw(r.choice([0, 5, 40]))
        for _ in range(r.choice([0, 1, 2])):
            x = r.choice(items)[1] or ""
            w += x.upper().split()[: r.choice([5, 10, 99])] + draw(2)
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w)))
    return docs + [(900, None), (901, ""), (902, "?? "), (903, "Z-z " * 40), (904, "z " * 9)], items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_equals_a_scan_of_all_windows(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        assert answer(contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_other_texts_under_one_id_are_documents_of_their_own(spark):
    p = [f"p{i}" for i in range(10)]
    docs = [(2, " ".join(p[:5])), (2, "r r r r r " + " ".join(p[5:])), (3, " ".join(p)), (3, " ".join(p)), (3, "else"), (4, None), (4, "")]
    items = [(1, " ".join(p)), (1, "else"), (9, None)]
    got = answer(contamination(*frames(spark, docs, items)))
    assert got == sorted({x for d, t in docs for x in brute([(d, t)], items)})


def test_very_long_texts(spark):
    rows = [(1, "x y " * 60_000 + " ".join(f"k{i}" for i in range(12))), (2, "x " * 5)]
    items = [(1, " ".join(f"k{i}" for i in range(4000))), (2, "y x " * 8)]
    assert answer(contamination(*frames(spark, rows, items))) == brute(rows, items)


def test_shuffle_instead_of_broadcast(spark, monkeypatch):
    from quillon.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = case(3)
    assert answer(contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_empty_tables_and_other_columns(spark):
    docs, items = case(4, 5)
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    d, i = frames(spark, docs, items)
    assert answer(contamination(none, i)) == []
    assert answer(contamination(d, no_items)) == brute(docs, [])
    clash = d.withColumn("words", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("phrase_id", F.lit(2))
    assert answer(contamination(clash, i.withColumn("doc_id", F.lit(5)))) == brute(docs, items)


def test_no_python_in_the_plan(spark, capsys):
    docs, items = case(5, 5)
    contamination(*frames(spark, docs, items)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out.replace("PythonRDD", ""))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma alpha z z z z z beta"), (3, "alpha beta")], "doc_id long, text string")
    groups = spark.createDataFrame([("g", ["beta", "alpha", "gamma"])], "phrase_id string, words array<string>")
    index = PositionalIndex.build(docs, Spool(spark, "test"))
    assert {(r.doc_id, r.start) for r in index.near(groups, 2).collect()} == {(1, 0)}
    again = PositionalIndex.open(spark, index.spool.path("postings"), Spool(spark, "test"))
    assert again.near(groups, 1).count() == 0
    nowhere = spark.createDataFrame([("g", ["beta", "delta"]), ("h", [])], "phrase_id string, words array<string>")
    assert PositionalIndex.open(spark, index.spool.path("postings"), Spool(spark, "test")).near(nowhere, 5).count() == 0


def test_an_index_of_all_tokens_serves_any_benchmark(spark):
    docs, items = case(6)
    built = PositionalIndex.build(frames(spark, docs, items)[0], Spool(spark, "test"))
    assert built.postings.count() == sum(len(words(t)) + 1 for _, t in docs)
    path = built.spool.path("postings")
    for chosen in (items, items[:3], [(1, "w1 w2")]):
        index = PositionalIndex.open(spark, path, Spool(spark, "test"))
        d, i = frames(spark, docs, chosen)
        assert answer(contamination(d, i, index=index)) == brute(docs, chosen)


def test_synthetic_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = answer(contamination(docs, items))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[-1] for r in got)
