"""Settings of an index on all its nodes: applied in turn with rollback, or proposed, verified and committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.control import settings_fingerprint


def apply_in_turn(nodes: DataFrame, value: str) -> DataFrame:
    """(node_id, outcome, value) after a setting was sent to nodes (node_id, pos, held, ok) of one index in the order of pos.

    held: the value before, null where the setting did not exist; ok: does the node take it? The first node
    that doesn't ends the round: those before it get back what they had, those after it are never asked.
    """
    stop = F.min(F.when(~F.coalesce("ok", F.lit(False)), F.struct("pos", "node_id"))).over(W.partitionBy())  # a row a node
    here = F.struct("pos", "node_id")
    outcome = F.when(stop.isNull(), "applied").when(here < stop, "rolled back").when(here == stop, "failed").otherwise("not asked")
    out = nodes.select("node_id", "held", outcome.alias("outcome"))
    return out.select("node_id", "outcome", F.when(F.col("outcome") == "applied", F.lit(value)).otherwise(F.col("held")).alias("value"))


def verify(actual: DataFrame, proposed: DataFrame, retries: int = 3) -> DataFrame:
    """(index_uid, verdict, version, differing) after a proposal (index_uid, settings, version, attempts) was read back
    from nodes (index_uid, node_id, settings).

    commit: every node has what was proposed, and the version rises by one. repair: some differ, send it again. freeze: they
    still differ after ``retries`` attempts, so the index takes no writes. Settings are equal if their canonical JSON is.
    """
    wanted = proposed.select("index_uid", settings_fingerprint(F.col("settings")).alias("want"), "version", "attempts")
    read = wanted.join(actual.select("index_uid", "node_id", settings_fingerprint(F.col("settings")).alias("have")), "index_uid", "left")
    differs = F.collect_set(F.when(~F.col("want").eqNullSafe(F.col("have")), F.col("node_id")))  # at most the nodes of a cluster
    each = read.groupBy("index_uid", "version", "attempts").agg(F.sort_array(differs).alias("differing"), F.count("node_id").alias("n"))
    same = (F.size("differing") == 0) & (F.col("n") > 0)
    verdict = F.when(same, "commit").when(F.col("attempts") < retries, "repair").otherwise("freeze")
    return each.select("index_uid", verdict.alias("verdict"), F.when(same, F.col("version") + 1).otherwise(F.col("version")).alias("version"), "differing")


def cover(assigned: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: covered, and the shards that no node of fresh (node_id) holds; a request that needs them is refused as stale."""
    held = assigned.join(fresh.select("node_id", F.lit(1).alias("fresh")), "node_id", "left").groupBy("shard").agg(F.count("fresh").alias("n"))
    missing = F.sort_array(F.collect_list(F.when(F.col("n") == 0, F.col("shard"))))  # at most all shards
    return held.agg(missing.alias("missing")).select((F.size("missing") == 0).alias("covered"), "missing")
