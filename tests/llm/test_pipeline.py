import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from quillon.llm.mixing import mix
from quillon.llm.quality import quality
from tokenizers import Tokenizer

from tests.llm import test_decontaminate, test_ngram_join, test_token_orc


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in quality(docs).where("kept").collect()}
    assert left and left < set(rows)
    of = lambda ids: [(d, rows[d].text) for d in ids]
    left = {d for d, _, c, _ in test_ngram_join.brute(of(sorted(left))) if d == c}
    left = {x[0] for x in test_decontaminate.brute(of(left), items) if not x[-1]}
    left = {r.doc_id for r in mix(docs.where(F.col("doc_id").isin(sorted(left)))).where("kept").collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = test_token_orc.brute(plain, of(left))
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1]) == want and len(want) > 20


GOOD = "The committee met on {} and agreed that the harbour wall would be repaired before winter. {} Every member spoke in turn, and the minutes record their names, the sums they asked for, and the day on which work begins. Nobody objected to the plan, though several people asked how the cost would be shared between the town and the county. The chair replied that a letter had been sent, and that an answer was expected within the month."


def edge_documents():
    r = random.Random(4)
    own = lambda k: " ".join(f"{r.choice('bcdfgst')}{r.choice('aeiou')}{r.choice('lmnr')}{r.choice(['ing', 'ed', 'er', 'y'])}{k}" for _ in range(60)) + "."
    a, b, c = GOOD.format("Monday", own("a")), GOOD.format("Friday", own("b")), GOOD.format("Sunday", own("c"))
    return [
        (1, a, "en", "x"), (1, a, "en", "x"),  # a row stored twice
        (2, a.replace("Monday", "Tuesday"), "en", "y"),  # a near copy
        (3, b, None, None), (3, c, "en", "x"),  # one id, two texts
        (4, c, "en", "x"),  # a copy of one of them
        (5, None, None, None), (6, "", "en", "x"), (7, "word " * 30_000, "en", "x"), (8, "short", "en", "x"), (None, b, "en", "x"),
    ]


@pytest.fixture
def edge(spark):
    rows = [(*x, 1, "r", 0, 9, "g", 5) for x in edge_documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, component_id int, kept string, _mark int, pos int, _given string, _nth int").repartition(3)


def names(df):
    return sorted(((r.doc_id, (r.text or "")[:22]) for r in df.collect()), key=str)


def test_quality_stage_by_row(spark, sf, edge):
    got = corpus_pipeline.keep_good(spark, edge, sf)
    assert got.columns == edge.columns
    assert {d for d, _ in names(got)} == {1, 2, 3, 4} and len(names(got)) == 6


def test_near_duplicate_stage_keeps_one_row_a_group(spark, sf, edge):
    got = corpus_pipeline.drop_near_duplicates(spark, edge, sf)
    rows = edge_documents()
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == edge.columns and len(left) == len(set(left))
    assert left.count((1, rows[0][1])) == 1 and not any(d in (2, 4) for d, _ in left)  # 4 is a copy of a text of 3
    assert {t for d, t in left if d == 3} == {rows[3][1], rows[4][1]} and {5, 6, 7, 8} <= {d for d, _ in left}


def test_decontamination_stage_by_row(spark, tmp_path, edge):
    rows = edge_documents()
    passage = " ".join(rows[3][1].split()[20:45])
    spark.createDataFrame([(1, passage), (2, None), (None, "short"), (3, "?!")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, edge, str(tmp_path)).collect()]
    assert (3, rows[4][1]) in left and (3, rows[3][1]) not in left and (5, None) in left and left.count((1, rows[0][1])) == 2


def test_mixing_stage_draws_once_a_document(spark, sf, edge):
    got = corpus_pipeline.sample_to_targets(spark, edge, sf)
    assert got.columns == edge.columns
    assert names(got).count((1, edge_documents()[0][1][:22])) in (0, 2)


def test_token_stage_writes_every_row(spark, sf, edge):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((tuple(r) for r in corpus_pipeline.write_token_ids(spark, edge, sf).collect()), key=lambda r: r[1])
    assert got == test_token_orc.brute(plain, [x[:2] for x in edge_documents()])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, sf, edge, stage):
    assert stage(spark, edge.limit(0), sf).count() == 0


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    assert corpus_pipeline.keep_good(spark, docs, sf).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "decontamination", "mixing", "token_output"]
