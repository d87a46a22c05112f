"""Ids for operators that keep what they know of a text under its document's id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spool import Spool, parts_for


@dataclass
class Identified:
    """docs, where rows share an id only if their texts are equal; names (doc_id, _quillon_given) gives the ids as they
    were, None if they are unchanged. repeated: some rows share id and text."""

    docs: DataFrame
    names: DataFrame | None
    repeated: bool

    def restored(self, rows: DataFrame) -> DataFrame:
        """rows with the ids as they were; a null id stays null."""
        if self.names is None:
            return rows
        columns = [F.col("_quillon_given").alias(x) if x == "doc_id" else F.col(x) for x in rows.columns]
        return rows.join(self.names, "doc_id", "left").select(*columns)


def _mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def identified(docs: DataFrame, spool: Spool) -> Identified:
    """docs (doc_id, text and any others) as they are, unless rows with other texts share an id: then documents are
    numbered in the order of their ids, and of their texts' hashes within one."""
    marked = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_quillon_given"), _mark().alias("_quillon_mark"))
    each = marked.groupBy("_quillon_given").agg(F.min("_quillon_mark").alias("low"), F.max("_quillon_mark").alias("high"), F.count("*").alias("n"))
    clash, repeated = each.agg(F.coalesce(F.max(F.expr("low < high")), F.lit(False)), F.coalesce(F.max(F.expr("n > 1")), F.lit(False))).first()
    if not clash:
        return Identified(docs, None, repeated)
    ranged = marked.distinct().repartitionByRange(parts_for(docs), "_quillon_given", "_quillon_mark").withColumn("part", F.spark_partition_id())
    ranged = spool.table("documents-by-id", ranged)
    bases = ranged.groupBy("part").agg(F.count("*").alias("n")).selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS base")  # a row a partition
    numbered = ranged.join(F.broadcast(bases), "part")
    numbered = numbered.selectExpr("_quillon_given", "_quillon_mark", "base + row_number() OVER (PARTITION BY part ORDER BY _quillon_given, _quillon_mark) AS _quillon_number")
    numbered = spool.table("documents-numbered", numbered)
    columns = [F.col("_quillon_number").alias(x) if x == "doc_id" else F.col(x) for x in docs.columns]
    given = docs.withColumn("_quillon_given", F.col("doc_id").cast("long")).withColumn("_quillon_mark", _mark())
    return Identified(given.join(numbered, ["_quillon_given", "_quillon_mark"], "left").select(*columns), numbered.select(F.col("_quillon_number").alias("doc_id"), "_quillon_given"), repeated)
