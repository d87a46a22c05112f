"""Moving shards: legality of steps, what a cutover still has to copy, what was lost, and load models."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.hashing import shard_md5

# The names by which clients see phases and shard states, in order; "failed" ends either from anywhere but its end.
PHASES = ["computing_assignments", "dual_write_migrating", "cutover_begin", "cutover_draining", "cutover_delta_pass", "cutover_activate", "cutover_cleanup", "complete"]
SHARD_STATES = ["pending", "migrating", "migration_complete", "draining", "delta_pass", "active"]
FAILED = "failed"
RESHARD_PHASES = ["idle", "shadow", "dual_write", "backfill", "verify", "swap", "cleanup", "complete"]


class IllegalStep(ValueError):
    pass


@dataclass(frozen=True)
class Migration:
    """Immutable: each step gives the next state or refuses."""

    phase: str = "computing_assignments"
    shards: tuple[tuple[int, str], ...] = ()
    skip_delta: bool = False
    anti_entropy: bool = True
    reason: str | None = None

    def step(self, to: str) -> Migration:
        if self.phase == PHASES[0] and self.skip_delta and not self.anti_entropy:
            raise IllegalStep("without a delta pass and without anti-entropy writes can be lost")
        if self.phase == FAILED or PHASES.index(to) != PHASES.index(self.phase) + 1 and not (self.phase == "cutover_draining" and to == "cutover_activate" and self.skip_delta):
            raise IllegalStep(f"{self.phase} -> {to}")
        if to == "cutover_begin" and any(s != "migration_complete" for _, s in self.shards):
            raise IllegalStep("shards are still being copied")
        return replace(self, phase=to)

    def fail(self, reason: str) -> Migration:
        """A migration that isn't complete can fail; nothing follows."""
        if self.phase in (FAILED, "complete"):
            raise IllegalStep(f"{self.phase} -> {FAILED}")
        return replace(self, phase=FAILED, reason=reason)

    def shard(self, number: int, state: str) -> Migration:
        """The migration after a shard's state changed: forward, or from a state but active to failed."""
        held = dict(self.shards)
        now = held.get(number, SHARD_STATES[0])
        if now == FAILED or (now == "active" if state == FAILED else SHARD_STATES.index(state) < SHARD_STATES.index(now)):
            raise IllegalStep(f"shard {number}: {now} -> {state}")
        return replace(self, shards=tuple(sorted((held | {number: state}).items())))


def reshard_step(phase: str, to: str) -> str:
    """Phases follow one another; before the swap a reshard can go back to idle."""
    now, then = RESHARD_PHASES.index(phase), RESHARD_PHASES.index(to)
    if then == now + 1 or (to == "idle" and now < RESHARD_PHASES.index("swap")):
        return to
    raise IllegalStep(f"{phase} -> {to}")


def delta(writes: DataFrame) -> DataFrame:
    """(doc_id, shard) acknowledged on the old nodes and not on the new ones. writes: (doc_id, shard, side, ok)."""
    done = writes.where("ok").select("doc_id", "shard", "side").distinct()
    return done.where("side = 'old'").drop("side").join(done.where("side = 'new'").drop("side"), ["doc_id", "shard"], "left_anti")


def loss(writes: DataFrame) -> DataFrame:
    """One row: written, lost and rate if the delta is never copied."""
    written = writes.where("ok").agg(F.count_distinct("doc_id", "shard").alias("written"))
    lost = delta(writes).agg(F.count("*").alias("lost"))
    return written.join(lost).select("written", "lost", (F.col("lost") / F.col("written")).alias("rate"))


def quorum(acks: DataFrame, expected: DataFrame, rf: int) -> DataFrame:
    """(shard, ok, degraded): a group needs floor(rf / 2) + 1 acknowledgements; one such group makes the
    write good, and a group without enough degrades it, a silent one too. acks: (shard, replica_group, ok)."""
    got = acks.where("ok").groupBy("shard", "replica_group").agg(F.count("*").alias("n"))
    reached = expected.join(got, ["shard", "replica_group"], "left").select("shard", (F.coalesce("n", F.lit(0)) >= rf // 2 + 1).alias("reached"))
    return reached.groupBy("shard").agg(F.bool_or("reached").alias("ok"), F.bool_or(~F.col("reached")).alias("degraded"))


def dual_write(docs: DataFrame, old, new) -> DataFrame:
    """Each document for its shard in both layouts: old and new are shard columns."""
    return docs.withColumn("shard", old).withColumn("_origin", F.lit("old")).unionByName(docs.withColumn("shard", new).withColumn("_origin", F.lit("new")))


def shadow_name(index_uid: str, shards: int) -> str:
    return f"{index_uid}__reshard_{shards}"


def cost(docs: DataFrame, key: str, old: tuple[DataFrame, int], new: tuple[DataFrame, int], groups: int, rf: int, doc_bytes: int, writes_s: float, throttle: float) -> DataFrame:
    """One row of what a reshard of these documents costs, counted, not modelled: variation of documents over the old and the new shards,
    the fullest node's bytes before and at the peak, and all bytes written. old and new: a placement (assignment) and its shards."""
    def laid(placed: tuple[DataFrame, int]) -> tuple[DataFrame, DataFrame]:
        assigned, shards = placed
        per = docs.groupBy(shard_md5(key, shards).alias("shard")).agg(F.count("*").alias("n"))
        every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(per, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n"))
        return every.agg((F.stddev_pop("n") / F.avg("n")).alias("cv"), F.sum("n").alias("docs")), assigned.join(every, "shard").groupBy("node_id").agg(F.sum("n").alias("n"))

    (a, a_nodes), (b, b_nodes) = laid(old), laid(new)
    fullest = lambda x, name: x.agg((F.max("n") * doc_bytes).alias(name))
    row = a.select(F.col("cv").alias("cv_old"), "docs").join(b.select(F.col("cv").alias("cv_new"))).join(fullest(a_nodes, "node_bytes")).join(fullest(b_nodes, "_more"))
    written = F.col("docs") / throttle * 2 * writes_s * groups * rf * doc_bytes + F.col("docs") * groups * rf * doc_bytes
    return row.select("docs", "cv_old", "cv_new", "node_bytes", (F.col("node_bytes") + F.col("_more")).alias("node_peak_bytes"), written.cast("long").alias("bytes_written"))


def load_model(doc_kb: float, corpus_gb: float, writes_s: float, groups: int, rf: int, old_shards: int, new_shards: int, nodes: int, throttle: float) -> dict[str, float]:
    """Storage, write rates and duration of a reshard, in closed form."""
    docs = int(corpus_gb * 1024 * 1024 / doc_kb)
    normal = writes_s * groups * rf
    backfill = docs / throttle
    return {
        "documents": docs, "normal_gb": corpus_gb * groups, "peak_gb": 2 * corpus_gb * groups, "amplification": 2.0, "with_rf_gb": corpus_gb * groups * rf,
        "normal_writes": normal, "dual_writes": 2 * normal, "peak_writes": 2 * normal + throttle * groups, "backfill_s": backfill,
        "old_per_shard": docs / old_shards, "new_per_shard": docs / new_shards, "docs_per_node": docs * rf / nodes,
    }


def backfill_progress(counts: DataFrame) -> DataFrame:
    """(shard, done_before, share): documents copied before a shard starts, and the share after it, shards in order."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a shard
    total = F.sum("n").over(W.partitionBy())
    return counts.select("shard", before.cast("long").alias("done_before"), ((before + F.col("n")) / total).alias("share"))
