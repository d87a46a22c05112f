"""Search: filter, score, facets, totals and global paging as DataFrames.

A request becomes one plan: shards that the filter cannot match are pruned before the scan,
hits are ordered by (score descending, primary key ascending as text), a total order, and
offset and limit become one top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.columns import cosine
from quillon.functions.hashing import SHARDS
from quillon.operators.text import bm25
from quillon.plans.planner import QueryPlan, plan

RESERVED = ("_shard", "_updated_at", "_expires_at", "_origin")


@dataclass
class SearchRequest:
    q: str = ""
    filter: Any = None
    facets: list[str] = field(default_factory=list)
    sort: list[str] = field(default_factory=list)
    attributes: list[str] | None = None
    offset: int = 0
    limit: int = 20
    threshold: float | None = None
    show_score: bool = False


#: A leading underscore is reserved, but for this usual name of a key: hits have no such field, and a document may not bring one.
NOT_RESERVED = ("_id",)


def is_reserved(name: str) -> bool:
    return name.startswith("_") and name not in NOT_RESERVED


def strip_reserved(df: DataFrame) -> DataFrame:
    """df without reserved fields, however they came in."""
    return df.drop(*[x for x in df.columns if is_reserved(x)])


def matches(index: DataFrame, r: SearchRequest, pk: str, text: str, by: str | None = None, shards: int = SHARDS, mode: str = "md5") -> DataFrame:
    """All matching documents with score. Statistics of terms are the whole index's, or each ``by`` value's."""
    p: QueryPlan = plan(r.filter, pk, shards, mode, key_type=dict(index.dtypes).get(pk, ""))
    condition = p.condition() if "_shard" in index.columns else p.predicate
    if not r.q.strip():
        out = index.where(condition).withColumn("score", F.lit(1.0))
    else:
        # statistics of all documents, then the filter: scores don't depend on what is asked for
        out = bm25(index.withColumn("_matched", F.coalesce(condition, F.lit(False))).withColumn("_scored", F.col(text)), pk, "_scored", r.q, by).where("_matched").drop("_matched")
    return out if r.threshold is None else out.where(F.col("score") >= r.threshold)


def page(found: DataFrame, r: SearchRequest, pk: str) -> DataFrame:
    order = []
    for s in r.sort:
        name, _, way = s.partition(":")
        order.append(F.desc(name) if way == "desc" else F.asc(name))
    out = found.orderBy(*order, F.desc("score"), F.col(pk).cast("string")).offset(r.offset).limit(r.limit)
    keep = r.attributes if r.attributes is not None else [x for x in found.columns if x != "score"]
    out = out.select(*[x for x in keep if x in out.columns], *(["score"] if r.show_score else []))
    return strip_reserved(out)


def search(index: DataFrame, r: SearchRequest, pk: str = "doc_id", text: str = "text") -> DataFrame:
    return page(matches(index, r, pk, text), r, pk)


def facet_counts(found: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n): one pass for all facets, partial sums first."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])).alias("f")
    return found.select(rows).where("f.value IS NOT NULL").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def facet_rollup(found: DataFrame, a: str, b: str) -> DataFrame:
    return found.rollup(a, b).agg(F.count("*").alias("n"))


def facet_map(counts: DataFrame) -> DataFrame:
    """(facet, distribution): a map with sorted keys."""
    return counts.groupBy("facet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("distribution"))


def merge_pages(pages: DataFrame, offset: int, limit: int) -> DataFrame:
    """Hits of successful shard pages (success, hits array<struct<pk, score>>), in one global order; a key once."""
    hits = pages.where("success").select(F.explode("hits").alias("h")).select("h.pk", "h.score")
    return hits.groupBy("pk").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "pk").offset(offset).limit(limit)


def merge_summary(pages: DataFrame) -> DataFrame:
    """One row: total (sum of estimates), millis (maximum), degraded (a page failed)."""
    good = F.col("success")
    return pages.agg(
        F.coalesce(F.sum(F.when(good, F.col("total"))), F.lit(0)).alias("total"),
        F.coalesce(F.max(F.when(good, F.col("millis"))), F.lit(0)).alias("millis"),
        F.coalesce(F.bool_or(~good), F.lit(False)).alias("degraded"),
    )


def apply_policy(pages: DataFrame, policy: str = "partial") -> DataFrame:
    """The pages that an answer is made of when shards have failed: those that succeeded (partial), or an error that names the failed ones."""
    if policy == "error":
        lost = [r[0] for r in pages.where("NOT success").select("shard").orderBy("shard").collect()]  # at most all shards
        if lost:
            raise RuntimeError(f"shards unavailable: {', '.join(map(str, lost))}")
    elif policy != "partial":
        raise ValueError(f"no such policy: {policy}")
    return pages.where("success")


def with_fallback(assigned: DataFrame, failed: DataFrame, groups: int = 3) -> DataFrame:
    """(shard, node_id): the first replica, by group and rank, that has not failed; null where none is left."""
    up = assigned.where(F.col("replica_group") < groups).join(F.broadcast(failed.select("node_id", F.lit(1).alias("bad"))), "node_id", "left")
    return up.groupBy("shard").agg(F.min_by("node_id", F.when(F.col("bad").isNull(), F.struct("replica_group", "rank"))).alias("node_id"))


def normalise(scored: DataFrame, by: str) -> DataFrame:
    """Minimum 0 and maximum 1 within each list; 1 where all scores are equal."""
    w = W.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def rrf(lists: list[DataFrame], pk: str, k: int = 60, first_rank: int = 1) -> DataFrame:
    """(pk, score): sum over lists of 1 / (k + rank). Each list: (pk, score), already cut to its top."""
    ranked = [d.select(pk, F.row_number().over(W.orderBy(F.desc("score"), F.col(pk).cast("string"))).alias("r")) for d in lists]
    return reduce(DataFrame.union, ranked).groupBy(pk).agg(F.sum(1 / (F.lit(k - 1 + first_rank) + F.col("r"))).alias("score"))


def convex(a: DataFrame, b: DataFrame, pk: str, alpha: float) -> DataFrame:
    """(pk, score): (1 - alpha) * a + alpha * b; a list that lacks a key gives 0."""
    joined = a.select(pk, F.col("score").alias("x")).join(b.select(pk, F.col("score").alias("y")), pk, "full_outer")
    return joined.select(pk, ((1 - alpha) * F.coalesce("x", F.lit(0.0)) + alpha * F.coalesce("y", F.lit(0.0))).alias("score"))


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """The k vectors most similar to the query by cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(column), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


#: Strategies by which ranked lists of several shards or indexes are merged.
MERGES = {
    "score": lambda lists, pk: reduce(DataFrame.union, [d.select(pk, "score") for d in lists]),
    "minmax": lambda lists, pk: normalise(reduce(DataFrame.union, [d.select(pk, "score", F.lit(i).alias("_list")) for i, d in enumerate(lists)]), "_list").select(pk, "score"),
    "rrf": rrf,
    "convex": lambda lists, pk: convex(lists[0], lists[1], pk, 0.5),
}


def merge(lists: list[DataFrame], pk: str, strategy: str = "score") -> DataFrame:
    """(pk, score): a key once, with its best merged score."""
    if strategy not in MERGES:
        raise ValueError(f"no such merge: {strategy}")
    return MERGES[strategy](lists, pk).groupBy(pk).agg(F.max("score").alias("score"))


def multi_search(found: dict[str, DataFrame], pk: dict[str, str], limit: int) -> DataFrame:
    """(index_uid, pk, score): hits of several indexes in one order."""
    parts = [d.select(F.lit(u).alias("index_uid"), F.col(pk[u]).cast("string").alias("pk"), "score") for u, d in found.items()]
    return reduce(DataFrame.union, parts).orderBy(F.desc("score"), "index_uid", "pk").limit(limit)


def field_distribution(index: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n): documents that have the field."""
    counts = index.agg(*[F.count(f).alias(f) for f in fields])
    return counts.unpivot([], fields, "field", "n")


def index_stats(index: DataFrame, pk: str, tasks: DataFrame | None = None) -> DataFrame:
    """One row: documents, and with the index's tasks (status) whether one of them is still to be done."""
    counted = index.agg(F.count_distinct(pk).alias("documents"))
    if tasks is None:
        return counted
    busy = tasks.agg(F.coalesce(F.bool_or(F.col("status").isin("enqueued", "processing")), F.lit(False)).alias("is_indexing"))
    return counted.join(F.broadcast(busy))


def cluster_stats(indexes: DataFrame) -> DataFrame:
    """One row over (index_uid, shard, node_id, documents, bytes): indexes, documents (a shard's replicas count once), and bytes of all replicas."""
    shard = indexes.groupBy("index_uid", "shard").agg(F.max("documents").alias("documents"), F.sum("bytes").alias("bytes"))
    return shard.agg(F.count_distinct("index_uid").alias("indexes"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def answer_headers(answers: DataFrame) -> DataFrame:
    """(request_id, degraded, settings_version, inconsistent, group) of shard answers (request_id, shard, ok, settings_version, pending,
    replica_group): shards without an answer, comma-joined, null for none; the least committed version; is a settings change under way?"""
    lost = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("shard")))), ",")  # at most all shards
    return answers.groupBy("request_id").agg(F.nullif(lost, F.lit("")).alias("degraded"), F.min(F.when(F.col("ok"), F.col("settings_version"))).alias("settings_version"), F.bool_or("pending").alias("inconsistent"), F.min("replica_group").alias("group"))


def facet_cube(found: DataFrame, columns: list[str]) -> DataFrame:
    """Counts for every combination of values and of 'any value' (null, level tells which)."""
    return found.cube(*columns).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def facet_cardinality(found: DataFrame, columns: list[str], error: float = 0.01) -> DataFrame:
    """(facet, n): about how many values each column has; sketches, so no value is shuffled."""
    return found.agg(*[F.approx_count_distinct(x, error).alias(x) for x in columns]).unpivot([], columns, "facet", "n")


def explain(index: DataFrame, r: SearchRequest, pk: str, assigned: DataFrame | None = None) -> DataFrame:
    """One row: narrowed, reason, shards, and the nodes that hold them."""
    p = plan(r.filter, pk, key_type=dict(index.dtypes).get(pk, ""))
    shards: Column = F.array(*[F.lit(s) for s in p.shards]) if p.shards is not None else F.lit(None).cast("array<int>")
    row = index.sparkSession.range(1).select(F.lit(p.narrowed).alias("narrowed"), F.lit(p.reason).alias("reason"), shards.alias("shards"))
    if assigned is None:
        return row
    chosen = assigned if p.shards is None else assigned.where(F.col("shard").isin(*p.shards))
    return row.join(F.broadcast(chosen.agg(F.sort_array(F.collect_set("node_id")).alias("nodes"))))
