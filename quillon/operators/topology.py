"""Placement of shards on replicated nodes by rendezvous hashing.

nodes: (node_id, replica_group, status). An assignment has a row for each shard, replica group and rank below the
replication factor. It is as large as the cluster, never as the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.hashing import SHARDS, placement_md5, placement_xxh64

STATUSES = ("healthy", "active", "joining", "draining", "degraded", "failed", "removed")
#: The allowed changes of a node's status, besides staying.
TRANSITIONS = [
    ("joining", "active"),
    ("active", "draining"), ("draining", "removed"),
    ("active", "failed"), ("draining", "failed"), ("failed", "active"),
    ("active", "degraded"), ("failed", "degraded"), ("degraded", "active"),
    ("healthy", "active"), ("active", "healthy"),
]


def nodes_frame(spark: SparkSession, rows: list[tuple[str, int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "node_id string, replica_group int, status string")


def serving(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("status").isin("healthy", "active"))


def write_eligible(nodes: DataFrame, drained_shards: DataFrame) -> DataFrame:
    """(node_id, shard, eligible): joining, failed and removed nodes take no writes; a draining one refuses only
    the shards that are being drained from it. An unknown status takes none."""
    joined = nodes.join(drained_shards.select("node_id", "shard", F.lit(True).alias("drained")), "node_id", "left")
    drained = (F.col("status") == "draining") & F.coalesce("drained", F.lit(False))
    refused = ~F.coalesce(F.col("status").isin("healthy", "active", "degraded", "draining"), F.lit(False)) | drained
    return joined.select("node_id", "shard", (~refused).alias("eligible"))


def valid_transitions(changes: DataFrame) -> DataFrame:
    """Changes (node_id, old, new) with valid: allowed, or no change."""
    allowed = changes.sparkSession.createDataFrame(TRANSITIONS, "old string, new string").withColumn("ok", F.lit(True))
    return changes.join(F.broadcast(allowed), ["old", "new"], "left").select("node_id", "old", "new", (F.coalesce("ok", F.lit(False)) | (F.col("old") == F.col("new"))).alias("valid"))


def assignment(nodes: DataFrame, shards: int = SHARDS, rf: int = 2, mode: str = "md5") -> DataFrame:
    """(replica_group, shard, rank, node_id): the rf nodes of each group with the highest scores; ties by node id."""
    every = nodes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(nodes.select("node_id", "replica_group")))
    score = placement_md5(F.col("shard"), F.col("node_id")) if mode == "md5" else placement_xxh64(F.col("shard"), F.col("node_id"), every)
    best = W.partitionBy("replica_group", "shard").orderBy(F.desc("score"), "node_id")
    ranked = every.withColumn("score", score).withColumn("rank", F.row_number().over(best) - 1)
    return ranked.where(F.col("rank") < rf).select("replica_group", "shard", "rank", "node_id")


def covering_set(assigned: DataFrame, query_seq: int) -> DataFrame:
    """(shard, node_id): one replica of each shard, rotated by the query's number, from the group it picks."""
    groups = assigned.select("replica_group").distinct().withColumn("nth", F.dense_rank().over(W.orderBy("replica_group")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    chosen = groups.where(F.col("nth") == F.lit(query_seq) % F.col("n")).select("replica_group")
    inside = assigned.join(F.broadcast(chosen), "replica_group").withColumn("rf", F.count("*").over(W.partitionBy("shard")))
    return inside.where(F.col("rank") == F.lit(query_seq) % F.col("rf")).select("shard", "node_id")


def add_group(nodes: DataFrame, assigned: DataFrame, group: int, shards: int = SHARDS, rf: int = 2, mode: str = "md5") -> DataFrame:
    """(shard, source, target): what a new group copies before it serves queries, each of its replicas from a serving node of
    another group that holds the shard, the one of the smallest group and rank. nodes has the new group's nodes too."""
    target = assignment(nodes.where(F.col("replica_group") == group), shards, rf, mode).select("shard", F.col("node_id").alias("target"))
    up = serving(nodes.where(F.col("replica_group") != group)).select("node_id")
    source = assigned.where(F.col("replica_group") != group).join(F.broadcast(up), "node_id").groupBy("shard")
    return target.join(source.agg(F.min_by("node_id", F.struct("replica_group", "rank")).alias("source")), "shard", "left").select("shard", "source", "target")


def group_states(copies: DataFrame) -> DataFrame:
    """(replica_group, state) of copies (replica_group, shard, done): active when all its shards are there, initializing before."""
    return copies.groupBy("replica_group").agg(F.when(F.bool_and("done"), "active").otherwise("initializing").alias("state"))


def without_group(assigned: DataFrame, group: int) -> DataFrame:
    """The placement that queries see once a group is draining: nothing moves, since other groups hold its documents."""
    return assigned.where(F.col("replica_group") != group)


def topology_report(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """(node_id, replica_group, status, shards, primaries, serving) of every node."""
    held = assigned.groupBy("node_id").agg(F.count("*").alias("shards"), F.count_if(F.col("rank") == 0).alias("primaries"))
    j = nodes.join(held, "node_id", "left")
    return j.select("node_id", "replica_group", "status", F.coalesce("shards", F.lit(0)).alias("shards"), F.coalesce("primaries", F.lit(0)).alias("primaries"), F.col("status").isin("healthy", "active").alias("serving"))


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(replica_group, shard, node_id, change): replicas that a new placement adds or removes."""
    keys = ["replica_group", "shard", "node_id"]
    a, b = old.select(*keys, F.lit(1).alias("was")), new.select(*keys, F.lit(1).alias("will"))
    return a.join(b, keys, "full_outer").where("was IS NULL OR will IS NULL").select(*keys, F.when(F.col("was").isNull(), "add").otherwise("remove").alias("change"))


def under_replicated(assigned: DataFrame, nodes: DataFrame, rf: int) -> DataFrame:
    """(replica_group, shard, live) of shards with fewer than rf serving replicas."""
    live = assigned.join(F.broadcast(serving(nodes).select("node_id", F.lit(1).alias("up"))), "node_id", "left")
    return live.groupBy("replica_group", "shard").agg(F.count("up").alias("live")).where(F.col("live") < rf)


def route(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Each document, which has _shard, for each node that holds its shard."""
    return docs.join(F.broadcast(assigned.select(F.col("shard").alias("_shard"), "replica_group", "rank", "node_id")), "_shard")


def node_batches(docs: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """(node_id, n_docs, n_shards): what a write sends to each node."""
    return route(docs, assigned).groupBy("node_id").agg(F.count(key).alias("n_docs"), F.count_distinct("_shard").alias("n_shards"))


def owner(names: DataFrame, workers: DataFrame) -> DataFrame:
    """(name, worker): each background job's owner, the worker with the highest score."""
    pairs = names.join(F.broadcast(workers)).withColumn("score", F.md5(F.concat("name", F.lit(":"), "worker").cast("binary")))
    return pairs.groupBy("name").agg(F.max_by("worker", F.struct("score", "worker")).alias("worker"))
