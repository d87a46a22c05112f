"""A corpus from raw documents: each stage's decisions take effect before the next one runs.

Documents are told apart by doc_id and text: rows that repeat both are one document, and rows that share an id with
other texts are judged each on its own. A row without a doc_id goes at any stage, since no decision can name it.
Further columns are carried along, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.decontaminate import contamination
from quillon.llm.identity import identified
from quillon.llm.mixing import mix
from quillon.llm.ngram_join import ngram_jaccard_join
from quillon.llm.quality import quality
from quillon.llm.spool import Spool
from quillon.llm.token_orc import read_tokens, token_digests, write_tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: No SQL: expectation-maximisation and tokens are beyond it; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def _keep(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], once: bool = False) -> DataFrame:
    """Rows of docs that decide keeps: from documents with ids of their own it gives the ids (doc_id) to keep. once: of rows
    that repeat a document one stays, the least by its other columns."""
    given = identified(docs, Spool(docs.sparkSession, "pipeline-ids"))
    kept = decide(given.docs).select(F.col("doc_id").alias("_quillon_kept")).distinct().hint("shuffle_hash")
    rows = given.docs.join(kept, F.col("doc_id").cast("long") == F.col("_quillon_kept"), "left_semi")
    if once and given.repeated:
        others = [x for x in docs.columns if x not in ("doc_id", "text")]
        rows = rows.withColumn("_quillon_nth", F.row_number().over(W.partitionBy("doc_id").orderBy(*others or ["doc_id"]))).where("_quillon_nth = 1").drop("_quillon_nth")
    return given.restored(rows).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts are rejected; all rows of a document that
    several rows hold stay or go together; ties in the posterior at the threshold stay."""
    return _keep(docs, lambda d: quality(d).where("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group that n-gram Jaccard links join, and of rows that repeat a document: that with the
    smallest id, of equal ids the one whose text's hash is least. Null and empty texts are in no group, so each id that has one stays."""
    return _keep(docs, lambda d: ngram_jaccard_join(d).where("doc_id = component_id"), once=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with all rows that repeat them. Null and empty texts hold
    none and stay; items without words, or without an id, match nothing."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _keep(docs, lambda d: contamination(d, items).where("not contaminated"))


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with the probabilities that raking to source, language and topic marginals gives. A null
    source or language is a value of its own; rows that repeat a document share its draw; a document without words weighs nothing."""
    return _keep(docs, lambda d: mix(d).where("kept"))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids go to ORC files; the rows are what is read back: doc_id, start, n_tokens, ids_crc32.
    A row for every row of docs, ids ascending, nulls first, equal ids by text; a null or empty text has its end id alone."""
    spool = Spool(spark, "pipeline-tokens")
    path = spool.path("tokens")
    write_tokens(docs, path, TOKENIZER)
    spool.keep_until_end()
    return token_digests(read_tokens(spark, path))


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", sample_to_targets),
    ("token_output", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs, spool = spark.read.parquet(f"{sf_dir}/documents.parquet"), Spool(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = spool.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
