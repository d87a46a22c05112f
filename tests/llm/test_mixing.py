import duckdb
import pytest
from quillon.llm import mixing
from quillon.llm.mixing import DIMENSIONS, mix, oracle_sql


def answer(df):
    return sorted(((r.doc_id, r.source, r.lang, r.topic, r.n_tokens, r.p_keep, r.kept) for r in df.collect()), key=str)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, source, lang, topic, n_tokens, p_keep, kept FROM ({oracle_sql()})").fetchall()
    assert answer(mix(spark.read.parquet(f"{sf}/documents.parquet"))) == sorted(want, key=str)


def made(spark):
    rows = [(i, ["big", "small"][i % 5 == 0], ["en", "de", None][i % 3], ["a", "b"][i % 7 == 0], "w " * (1 + i % 11)) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, text string")


TARGETS = {"source": {"big": 0.5, "small": 0.5}, "lang": {"en": 0.4, "de": 0.4, "": 0.2}, "topic": {"a": 0.7, "b": 0.3}}


def test_expected_tokens_have_the_target_marginals(spark):
    rows = mix(made(spark), TARGETS).toPandas()
    expected = rows.n_tokens * rows.p_keep
    assert rows.p_keep.max() == 1
    for d in DIMENSIONS:
        share = expected.groupby(rows[d]).sum() / expected.sum()
        assert all(abs(share[v] - s) < 1e-4 for v, s in TARGETS[d].items())
    drawn = rows[rows.kept]
    share = drawn.n_tokens.groupby(drawn.source).sum() / drawn.n_tokens.sum()
    assert abs(share["big"] - 0.5) < 0.06


def test_tables_instead_of_the_driver(spark, monkeypatch):
    want = answer(mix(made(spark), TARGETS, steps=4))
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    assert answer(mix(made(spark), TARGETS, steps=4)) == want


def test_topics_repeats_and_long_texts(spark):
    rows = [(i % 400, "s", "en", [None, "a", "b"][i % 400 % 3], "w " * (1 + i % 400 % 5)) for i in range(800)] + [(1000, "s", "en", "a", "long " * 300_000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, text string").repartition(3)).collect()
    assert len(got) == 801 and {r.topic for r in got} == {"", "a", "b"} and max(r.n_tokens for r in got) == 300_000
    draws = {}
    for r in got:
        draws.setdefault(r.doc_id, set()).add((r.topic, r.n_tokens, r.p_keep, r.kept))
    assert all(len(x) == 1 for x in draws.values())  # rows that repeat a document share its draw
    assert {r.kept for r in got if r.doc_id < 400} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (1, "", "x", "y"), (None, "a b", "x", "y")]])
def test_nulls_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mix(df.withColumn("tokens", df.doc_id).withColumn("weight", df.doc_id))
    assert got.count() == len(rows) and all(r.kept is not None for r in got.collect())
