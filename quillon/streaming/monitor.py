"""Latency, health and lifecycle analytics over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram, in seconds.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
#: Logs are looked at in spans of so many seconds, so that no task needs a node's whole log in order.
SPAN_S = 60


def ewma(log: DataFrame, node: str, ts: str, value: str, half_life_s: float) -> DataFrame:
    """(node, ewma): a sample Δt seconds after the last one weighs 1 - 0.5 ** (Δt / half-life); the first one counts whole.

    Unrolled, a sample counts its weight times 0.5 ** (its age at the node's last sample / half-life), so the result is a sum
    that needs each sample's Δt only: within a minute from the minute's rows, for a minute's first sample from
    the last one before it. All samples count, whatever the half-life; of equal times the least value comes first.
    """
    at = F.col(ts).cast("timestamp").cast("double")
    rows = log.select(node, at.alias("_at"), F.col(value).cast("double").alias("_v")).where("_at IS NOT NULL AND _v IS NOT NULL").withColumn("_span", F.floor(F.col("_at") / SPAN_S))
    spans = rows.groupBy(node, "_span").agg(F.max("_at").alias("_last"))
    before = F.lag("_last").over(W.partitionBy(node).orderBy("_span"))  # a row a node and minute
    spans = spans.select(node, "_span", before.alias("_before"))
    ends = rows.groupBy(node).agg(F.max("_at").alias("_end"))
    previous = F.coalesce(F.lag("_at").over(W.partitionBy(node, "_span").orderBy("_at", "_v")), F.col("_before"))
    rows = rows.join(spans, [node, "_span"]).withColumn("_dt", F.col("_at") - previous).join(ends, node)
    weight = F.coalesce(1 - F.pow(F.lit(0.5), F.col("_dt") / half_life_s), F.lit(1.0)) * F.pow(F.lit(0.5), (F.col("_end") - F.col("_at")) / half_life_s)
    return rows.groupBy(node).agg(F.sum(weight * F.col("_v")).alias("ewma"))


def replica_score(latency: Column, inflight: Column, errors: Column) -> Column:
    return latency + 2 * inflight + 10 * errors * 1000


def best_replica(scores: DataFrame, shard: str, node: str, explore: float = 0.0, seed: int = 7) -> DataFrame:
    """(shard, node): the lowest score; with probability ``explore`` any, by a hash that retries repeat. Unknown scores are 0."""
    s = F.coalesce("score", F.lit(0.0))
    draw = lambda *x: F.pmod(F.xxhash64(*x, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    key = F.when(draw(F.col(shard)) < explore, draw(F.col(shard), F.col(node))).otherwise(s)
    return scores.groupBy(shard).agg(F.min_by(node, F.struct(key, F.col(node))).alias(node))


def hedge_deadline(p95_ms: Column, factor: float = 1.2, least_ms: float = 15.0) -> Column:
    return F.greatest(F.coalesce(p95_ms * factor, F.lit(least_ms)), F.lit(least_ms))


def p95(log: DataFrame, node: str, value: str) -> DataFrame:
    return log.groupBy(node).agg(F.percentile(value, F.lit(0.95)).alias("p95"))


def latency_histogram(log: DataFrame, seconds: Column, buckets: list[float] = BUCKETS) -> DataFrame:
    """(le, n): cumulative counts."""
    counts = log.agg(*[F.count_if(seconds <= b).alias(str(i)) for i, b in enumerate(buckets)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(buckets)]))
    return counts.select(rows.alias("r")).select("r.le", "r.n")


def health(log: DataFrame, node: str, order: list[str], ok: Column, fails: int = 3, passes: int = 2) -> DataFrame:
    """(node, *order, state) where a node's state changes: ``fails`` failures in a row make it unhealthy, ``passes``
    successes in a row recover it; nodes begin healthy. order begins with a timestamp.

    Whether a row ends a run of the wanted length shows in a few rows before it. A minute's rows find them among themselves and in
    the last rows of earlier minutes, so no task needs a node's whole log in order: across minutes a window has a row a node and minute.
    """
    k = max(fails, passes)
    span = F.floor(F.col(order[0]).cast("timestamp").cast("double") / SPAN_S)
    rows = log.select(node, *order, ok.alias("_ok"), span.alias("_span"))
    inside = W.partitionBy(node, "_span").orderBy(*order)
    spans_before = W.partitionBy(node).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("_nth", F.row_number().over(inside)).withColumn("_left", F.row_number().over(W.partitionBy(node, "_span").orderBy(*map(F.desc, order))))
    tails = numbered.where(F.col("_left") <= k).groupBy(node, "_span").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_ok"))), lambda x: x["_ok"]).alias("_tail"))
    # k minutes that have rows have k rows at least
    held = F.flatten(F.collect_list("_tail").over(W.partitionBy(node).orderBy("_span").rowsBetween(-k, -1)))
    before = tails.select(node, "_span", F.slice(held, F.greatest(F.size(held) - k + 1, F.lit(1)), k).alias("_before"))
    seen = numbered.join(before, [node, "_span"])

    def earlier(j: int) -> Column:
        at = F.size("_before") - j + F.col("_nth")  # where the j-th row before this one is, if not in its minute
        return F.when(F.col("_nth") > j, F.lag("_ok", j).over(inside)).otherwise(F.when(at >= 1, F.get("_before", (at - 1).cast("int"))))

    def ends(n: int, value: bool) -> Column:
        """Is this the n-th row in a row with the value, and not one after it?"""
        like = lambda x: F.coalesce(x == F.lit(value), F.lit(False))
        out = like(F.col("_ok")) & ~like(earlier(n))
        for j in range(1, n):
            out = out & like(earlier(j))
        return out

    says = F.when(ends(fails, False), "unhealthy").when(ends(passes, True), "healthy")
    said = seen.select(node, *order, "_span", says.alias("state")).where("state IS NOT NULL")
    last = said.groupBy(node, "_span").agg(F.max_by("state", F.struct(*order)).alias("_last"))
    last = last.select(node, "_span", F.last("_last").over(spans_before).alias("_earlier"))
    then = F.coalesce(F.lag("state").over(inside), F.col("_earlier"), F.lit("healthy"))
    return said.join(last, [node, "_span"]).withColumn("_then", then).where("state != _then").select(node, *order, "state")


def counters(requests: DataFrame, status: Column, degraded: Column) -> DataFrame:
    """One row: requests, degraded ones, and those without a quorum (503)."""
    return requests.agg(F.count("*").alias("requests"), F.count_if(degraded).alias("degraded"), F.count_if(status == 503).alias("no_quorum"))


def rolls(indexes: DataFrame, policy: dict, now: Column, most: int = 10) -> DataFrame:
    """(index_uid, reason) of write indexes (index_uid, docs, bytes, created) to be rolled over in one check: by documents, size or
    age in seconds; at most ``most`` of them, the oldest first. A limit of the feature; the next check takes the rest."""
    age = now.cast("timestamp").cast("double") - F.col("created").cast("timestamp").cast("double")
    reason = F.when(F.col("docs") >= policy["max_docs"], "docs").when(F.col("bytes") >= policy["max_bytes"], "size").when(age >= policy["max_age_s"], "age")
    return indexes.select("index_uid", "created", reason.alias("reason")).where("reason IS NOT NULL").orderBy("created", "index_uid").limit(most).select("index_uid", "reason")


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Scheduled jobs (name, every_s, last_run) with due and next_run; one that never ran is due."""
    at = lambda x: x.cast("timestamp").cast("double")
    following = at(F.col("last_run")) + F.col("every_s")
    return jobs.select("name", F.coalesce(following <= at(now), F.lit(True)).alias("due"), F.timestamp_seconds(F.coalesce(following, at(now))).alias("next_run"))


def shadowed(requests: DataFrame, key: str, rate: float = 0.05) -> DataFrame:
    """The requests that also go to a shadow: those whose key's hash falls below the rate, so a retry decides alike."""
    return requests.where(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") < rate * float(1 << 32))


def ring(diffs: DataFrame, order: str, size: int = 10_000) -> DataFrame:
    """The last ``size`` differences; a limit of the feature."""
    return diffs.orderBy(F.desc(order)).limit(size)


def capture(log: DataFrame, ts: str, start: Column, n: int, prefix: str) -> DataFrame:
    """(name, query, expected_ids): golden pairs from the first n queries (query, ids) at or after a time."""
    first = log.where(F.col(ts) >= start).orderBy(ts, "query").limit(n)
    nth = F.row_number().over(W.orderBy(ts, "query"))  # n rows, the feature's limit
    return first.select(F.concat(F.lit(f"{prefix}-"), nth).alias("name"), "query", F.col("ids").alias("expected_ids"))


def rollover(rows: DataFrame, ts: str, size: Column, policy: dict) -> DataFrame:
    """(day, docs, bytes, rolls): days of a series, and those whose size calls for a rollover."""
    days = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("docs"), F.sum(size).alias("bytes"))
    return days.withColumn("rolls", (F.col("docs") >= policy["max_docs"]) | (F.col("bytes") >= policy["max_bytes"]))


def retention(days: DataFrame, keep: int, lock_days: int = 7) -> DataFrame:
    """(day, index_uid, keep): the last ``keep`` days stay, and any day younger than the safety lock."""
    newest = F.max("day").over(W.partitionBy())  # a row a day
    nth = F.dense_rank().over(W.orderBy(F.desc("day")))
    name = F.concat(F.lit("logs-"), F.date_format("day", "yyyy-MM-dd"))
    return days.select("day", name.alias("index_uid"), ((nth <= keep) | (F.datediff(newest, F.col("day")) < lock_days)).alias("keep"))


def clickthrough(events: DataFrame, event_id: str, kind: str, by: str) -> DataFrame:
    """(by, views, clicks, ctr); a beacon that repeats counts once."""
    once = events.select(event_id, kind, by).dropDuplicates([event_id]).where(F.col(kind).isin("view", "click"))
    counted = once.groupBy(by).agg(F.count_if(F.col(kind) == "view").alias("views"), F.count_if(F.col(kind) == "click").alias("clicks"))
    return counted.withColumn("ctr", F.when(F.col("views") > 0, F.col("clicks") / F.col("views")))


def zero_hits(beacons: DataFrame, event_id: str, index_uid: str, hits: Column, duration: Column) -> DataFrame:
    """(index_uid, queries, zero_hits, p95) of query beacons; one that repeats counts once."""
    once = beacons.select(event_id, index_uid, hits.alias("_hits"), duration.alias("_ms")).dropDuplicates([event_id])
    return once.groupBy(index_uid).agg(F.count("*").alias("queries"), F.count_if(F.col("_hits") == 0).alias("zero_hits"), F.percentile("_ms", F.lit(0.95)).alias("p95"))


def shadow_diff(primary: DataFrame, shadow: DataFrame, keys: list[str]) -> DataFrame:
    """One row: hits in both, in one only, and those at other positions."""
    j = primary.select(*keys, F.col("pos").alias("x")).join(shadow.select(*keys, F.col("pos").alias("y")), keys, "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return j.agg(F.count_if(both).alias("both"), F.count_if(F.col("y").isNull()).alias("only_primary"), F.count_if(F.col("x").isNull()).alias("only_shadow"), F.count_if(both & (F.col("x") != F.col("y"))).alias("moved"))


def canary(results: DataFrame, assertions: DataFrame) -> DataFrame:
    """(name, kind, passed). results: (name, hits, first_id, millis, top array<string>); assertions: (name, kind, value,
    ids). Kinds: min_hits, max_hits, top_hit_id, top_k_contains, max_latency_ms, not_empty, and, where results
    have p95_ms and settings_version, max_p95_ms and settings_version_at_least; must_not_contain_id."""
    j = assertions.join(results, "name", "left")
    v = F.col("value").try_cast("double")
    optional = lambda x: F.col(x) if x in results.columns else F.lit(None)
    passed = (
        F.when(F.col("kind") == "max_p95_ms", optional("p95_ms") <= v).when(F.col("kind") == "settings_version_at_least", optional("settings_version") >= v)
        .when(F.col("kind") == "must_not_contain_id", ~F.arrays_overlap("ids", "top")).when(F.col("kind") == "min_hits", F.col("hits") >= v).when(F.col("kind") == "max_hits", F.col("hits") <= v).when(F.col("kind") == "top_hit_id", F.col("first_id") == F.col("value"))
        .when(F.col("kind") == "top_k_contains", F.size(F.array_except("ids", "top")) == 0).when(F.col("kind") == "max_latency_ms", F.col("millis") <= v).when(F.col("kind") == "not_empty", F.col("hits") > 0)
    )
    return j.select("name", "kind", F.coalesce(passed, F.lit(False)).alias("passed"))
