"""Replica reconciliation: fingerprints, differences, repair.

A copy row: (replica, shard, pk, content_hash, updated_at, expires_at, node_task_uid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


def content_hash(*columns: Column) -> Column:
    """Of the values with their lengths in bytes before them, so that no two rows read alike; null differs from an empty text."""
    part = lambda x: F.coalesce(F.concat(F.octet_length(x), F.lit(":"), x), F.lit("-"))
    return F.md5(F.concat(*[part(x.cast("string")) for x in columns]).cast("binary"))


def bucket_of(pk: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(pk.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def fingerprints(copies: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(replica, shard, bucket, n, fingerprint, total): order-free sums, so partial results combine before any shuffle.
    The sum sees what the exclusive or loses, a row that is held twice.

    Two replicas of a shard hold the same rows if their fingerprints agree; only buckets that differ need a row by row diff.
    """
    half = F.conv(F.substring(F.md5(F.concat("pk", F.lit(":"), "content_hash").cast("binary")), 1, 12), 16, 10).cast("long")
    return copies.groupBy("replica", "shard", bucket_of(F.col("pk"), buckets).alias("bucket")).agg(F.count("*").alias("n"), F.bit_xor(half).alias("fingerprint"), F.sum(half.bitwiseAND(0x7FFFFFFF)).alias("total"))


def differing(prints: DataFrame) -> DataFrame:
    """(shard, bucket) on which the replicas disagree, or that one of them lacks."""
    replicas = prints.agg(F.count_distinct("replica").alias("replicas"))
    per = prints.groupBy("shard", "bucket").agg(F.count("*").alias("have"), F.count_distinct("n", "fingerprint", "total").alias("kinds"))
    return per.join(F.broadcast(replicas)).where("kinds > 1 OR have < replicas").select("shard", "bucket")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pk, kind): missing in b, extra in b, or changed; keys that agree are left out."""
    j = a.select("pk", F.col("content_hash").alias("x")).join(b.select("pk", F.col("content_hash").alias("y")), "pk", "full_outer")
    kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed")
    return j.where(~F.col("x").eqNullSafe(F.col("y"))).select("pk", kind.alias("kind"))


def winners(copies: DataFrame, now: int) -> DataFrame:
    """(pk, content_hash, action): the latest version, later node task first on ties; expired keys are deleted everywhere."""
    best = copies.groupBy("pk").agg(F.max_by(F.struct("content_hash", "expires_at"), F.struct("updated_at", "node_task_uid")).alias("v"))
    expired = F.coalesce(F.col("v.expires_at") <= now, F.lit(False))
    return best.select("pk", "v.content_hash", F.when(expired, "delete").otherwise("keep").alias("action"))


def repairs(copies: DataFrame, now: int) -> DataFrame:
    """(replica, pk, action): what brings each replica to the winners. Repairing twice changes nothing."""
    best = winners(copies, now)
    replicas = copies.select("replica").distinct()
    wanted = best.join(F.broadcast(replicas)).select("replica", "pk", F.col("content_hash").alias("want"), "action")
    held = copies.select("replica", "pk", F.col("content_hash").alias("have"))
    j = wanted.join(held, ["replica", "pk"], "left")
    write = (F.col("action") == "keep") & ~F.col("want").eqNullSafe(F.col("have"))
    drop = (F.col("action") == "delete") & F.col("have").isNotNull()
    return j.where(write | drop).select("replica", "pk", F.when(write, "write").otherwise("delete").alias("action"))


def sweep(rows: DataFrame, now: int, most: int) -> DataFrame:
    """The expired rows to delete in one sweep, oldest first; a limit of the feature."""
    return rows.where(F.col("expires_at") <= now).orderBy("expires_at", "pk").limit(most)
