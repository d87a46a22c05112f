"""The control tables: tasks, settings versions, aliases, sessions, idempotency, jobs, leases, canaries and their runs,
change cursors, tenants, rollover policies, search settings and admin sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: name: (keys, schema)
TABLES: dict[str, tuple[list[str], str]] = {
    "tasks": (["task_id"], "task_id string, created_at long, status string, node_tasks map<string, long>, error string"),
    "node_settings_version": (["index_uid", "node_id"], "index_uid string, node_id string, version long, updated_at long"),
    "aliases": (["name"], "name string, kind string, current_uid string, target_uids array<string>, version long, created_at long, history array<struct<uid: string, flipped_at: long>>"),
    "sessions": (["session_id"], "session_id string, last_write_task string, last_write_at long, pinned_group int, min_settings_version long, ttl long"),
    "idempotency": (["key"], "key string, body_sha256 string, task_id string, expires_at long"),
    "jobs": (["id"], "id string, type string, params string, state string, claimed_by string, claim_expires_at long, progress string"),
    "leader_lease": (["scope"], "scope string, holder string, expires_at long"),
    "canaries": (["id"], "id string, name string, index_uid string, interval_s long, query string, assertions string, enabled boolean, created_at long"),
    "canary_runs": (["canary_id", "ran_at"], "canary_id string, ran_at long, status string, latency_ms long, failures string"),
    "cdc_cursors": (["sink", "index_uid"], "sink string, index_uid string, last_event_seq long, updated_at long"),
    "tenants": (["api_key_sha256"], "api_key_sha256 binary, tenant_id string, group_id int"),
    "rollover_policies": (["name"], "name string, write_alias string, read_alias string, pattern string, max_docs long, max_age_s long, max_size_gb double, keep_indexes int, enabled boolean"),
    "search_settings": (["index_uid"], "index_uid string, config string, updated_at long"),
    "admin_sessions": (["session_id"], "session_id string, csrf string, admin_key_sha256 string, created_at long, expires_at long, revoked boolean"),
}
STATES = {"failed": 4, "processing": 3, "enqueued": 2, "canceled": 1, "succeeded": 0}


def put(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def put_cursor(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Cursors never go back."""
    return table.unionByName(rows).groupBy("sink", "index_uid").agg(F.max("last_event_seq").alias("last_event_seq"), F.max("updated_at").alias("updated_at"))


def task_rank(status: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for s, n in STATES.items():
        out = out.when(status == s, n)
    return out.otherwise(2)


def task_status(node_states: DataFrame) -> DataFrame:
    """(task_id, status, n_nodes): failed before processing, enqueued, canceled and succeeded."""
    names = F.create_map(*[x for s, n in STATES.items() for x in (F.lit(n), F.lit(s))])
    return node_states.groupBy("task_id").agg(F.max(task_rank(F.col("status"))).alias("r"), F.count("*").alias("n_nodes")).select("task_id", F.element_at(names, F.col("r")).alias("status"), "n_nodes")


def reconcile(tasks: DataFrame, node_states: DataFrame) -> DataFrame:
    """Tasks' node tasks with the states that nodes report; what a node doesn't know is enqueued."""
    each = tasks.select("task_id", F.explode("node_tasks").alias("node_id", "uid"))
    return task_status(each.join(node_states, ["node_id", "uid"], "left").select("task_id", F.coalesce("status", F.lit("enqueued")).alias("status")))


def task_page(tasks: DataFrame, statuses: list[str] | None = None, start: int | None = None, limit: int = 20, index_uids: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """A page of tasks, newest first, from the one numbered ``start`` on; an empty list filters nothing."""
    for name, wanted in (("status", statuses), ("index_uid", index_uids), ("type", types)):
        if wanted:
            tasks = tasks.where(F.col(name).isin(wanted))
    return (tasks if start is None else tasks.where(F.col("uid") <= start)).orderBy(F.desc("uid")).limit(limit)


def stored_tasks(tasks: DataFrame, status: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of the tasks table, latest first; of equal times the greatest task_id first."""
    out = (tasks if status is None else tasks.where(F.col("status") == status)).orderBy(F.desc("created_at"), F.desc("task_id"))
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def canary_history(runs: DataFrame, n: int) -> DataFrame:
    """(canary_id, runs, passed, rate, last_failure) over the last n runs of each canary."""
    last = last_per_key(runs, ["canary_id"], "ran_at", n)
    good = F.col("status") == "pass"
    return last.groupBy("canary_id").agg(F.count("*").alias("runs"), F.count_if(good).alias("passed"), F.avg(good.cast("double")).alias("rate"), F.max(F.when(~good, F.col("ran_at"))).alias("last_failure"))


def retry_key(body: Column, node: Column, idempotency_key: Column) -> Column:
    """SHA-256 of body, node and key, if there is one, in a row."""
    return F.sha2(F.concat(body.cast("binary"), node.cast("binary"), F.coalesce(idempotency_key.cast("binary"), F.lit(b""))), 256)


def retry_cache(requests: DataFrame, ttl_s: int = 60) -> DataFrame:
    """requests (key, ts, status) with cached: an earlier request with the key succeeded (2xx) at most ttl_s ago, so its
    response is given again. Only a request that was really sent fills the cache, so a response lives ttl_s, not longer."""
    at = F.col("ts").cast("timestamp").cast("double")
    sent = requests.withColumn("_at", at).where(F.col("status").between(200, 299))
    # good responses in fixed steps from a key's first one: within ttl_s of a kept one none is kept
    kept = sent.groupBy("key").agg(F.array_sort(F.collect_set("_at")).alias("all"))  # a key's good responses: retries of one request
    fold = F.aggregate("all", F.array().cast("array<double>"), lambda s, x: F.when((F.size(s) == 0) | (x >= F.element_at(F.when(F.size(s) > 0, s), -1) + ttl_s), F.concat(s, F.array(x))).otherwise(s))
    kept = kept.select("key", fold.alias("filled"))
    return requests.join(kept, "key", "left").select(*requests.columns, F.coalesce(F.exists("filled", lambda x: (x < at) & (at < x + ttl_s)), F.lit(False)).alias("cached"))


def tenant_key(api_key: Column) -> Column:
    return F.unhex(F.sha2(api_key.cast("binary"), 256))


def ttl_policies(indexes: DataFrame, overrides: DataFrame, interval_s: int = 300, most: int = 10_000, enabled: bool = True) -> DataFrame:
    """(index_uid, sweep_interval_s, max_deletes, enabled): an index's override where it has one, field by field, else the global policy."""
    o = overrides.select("index_uid", *[F.col(x).alias(f"_{x}") for x in ("sweep_interval_s", "max_deletes", "enabled")])
    j = indexes.join(o, "index_uid", "left")
    return j.select("index_uid", F.coalesce("_sweep_interval_s", F.lit(interval_s)).alias("sweep_interval_s"), F.coalesce("_max_deletes", F.lit(most)).alias("max_deletes"), F.coalesce("_enabled", F.lit(enabled)).alias("enabled"))


def prune(table: DataFrame, column: str, cutoff: int) -> DataFrame:
    return table.where(F.col(column) >= cutoff)


def claim(jobs: DataFrame, now: int) -> DataFrame:
    """The job with the smallest id that is queued, or whose claim has run out."""
    return jobs.where((F.col("state") == "queued") | ((F.col("state") == "claimed") & (F.col("claim_expires_at") <= now))).orderBy("id").limit(1)


def acquire(leases: DataFrame, scope: str, holder: str, now: int, ttl: int) -> DataFrame:
    """The lease table after a request: granted if free, run out, or held by the same holder."""
    taken = leases.where((F.col("scope") == scope) & (F.col("holder") != holder) & (F.col("expires_at") > now)).limit(1)
    wanted = leases.sparkSession.createDataFrame([(scope, holder, now + ttl)], TABLES["leader_lease"][1])
    granted = wanted.join(taken.select("scope"), "scope", "left_anti")
    return put(leases, granted, ["scope"])


def holders(leases: DataFrame, now: int) -> DataFrame:
    return leases.where(F.col("expires_at") > now).groupBy("scope").agg(F.max_by("holder", F.struct("expires_at", "holder")).alias("holder"))


def resolve(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, index_uid): an alias's targets; a name that is no alias is an index."""
    targets = F.when(F.col("kind") == "multi", F.col("target_uids")).otherwise(F.array("current_uid"))
    joined = names.join(aliases.select("name", targets.alias("targets")), "name", "left")
    return joined.select("name", F.explode(F.coalesce("targets", F.array("name"))).alias("index_uid"))


def flip(aliases: DataFrame, name: str, uid: str, now: int, keep: int = 10) -> DataFrame:
    """The row of an alias of one index after it was pointed to another: the version rises, and the last ``keep`` indexes it pointed
    to are remembered, latest first. An alias of several indexes can't be flipped."""
    if aliases.where((F.col("name") == name) & (F.col("kind") == "multi")).head(1):
        raise ValueError(f"{name} stands for several indexes")
    row = aliases.where(F.col("name") == name)
    was = F.array(F.struct(F.col("current_uid").alias("uid"), F.lit(now).cast("long").alias("flipped_at")))
    return row.withColumn("history", F.slice(F.concat(was, F.coalesce("history", F.array().cast("array<struct<uid:string,flipped_at:bigint>>"))), 1, keep)).withColumn("current_uid", F.lit(uid)).withColumn("version", F.col("version") + 1)


def last_per_key(rows: DataFrame, key: list[str], at: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(at)))).where(F.col("_n") <= n).drop("_n")


def tenant_groups(requests: DataFrame, tenants: DataFrame, groups: int) -> DataFrame:
    """(tenant_id, group_id): the mapped group, else one by hash."""
    joined = requests.join(tenants.select("tenant_id", "group_id"), "tenant_id", "left")
    fallback = (F.conv(F.substring(F.md5(F.col("tenant_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % groups).cast("int")
    return joined.select("tenant_id", F.coalesce("group_id", fallback).alias("group_id"))


def idempotency(requests: DataFrame, cache: DataFrame, now: int) -> DataFrame:
    """(key, outcome, task_id): hit, conflict (same key, other body), or miss."""
    known = cache.where(F.col("expires_at") > now).select("key", F.col("body_sha256").alias("held"), "task_id")
    outcome = F.when(F.col("held").isNull(), "miss").when(F.col("held") == F.col("body_sha256"), "hit").otherwise("conflict")
    return requests.join(known, "key", "left").select("key", outcome.alias("outcome"), F.when(F.col("held") == F.col("body_sha256"), F.col("task_id")).alias("task_id"))


def settings_floor(nodes: DataFrame, versions: DataFrame, index_uid: str, floor: int) -> DataFrame:
    """Nodes whose settings of the index are at least at the version."""
    fresh = versions.where((F.col("index_uid") == index_uid) & (F.col("version") >= floor)).select("node_id")
    return nodes.join(F.broadcast(fresh), "node_id", "left_semi")


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and without white space, so that equal settings have equal texts; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def settings_fingerprint(settings: Column) -> Column:
    """SHA-256 of canonical JSON; of the text itself if it is no JSON."""
    return F.sha2(F.coalesce(canonical_json(settings), settings), 256)


def settings_drift(settings: DataFrame) -> DataFrame:
    """(index_uid, n_hashes, drifted) of (index_uid, node_id, settings): do nodes' settings differ by more than the order of keys?"""
    return settings.groupBy("index_uid").agg(F.count_distinct(settings_fingerprint(F.col("settings"))).alias("n_hashes")).withColumn("drifted", F.col("n_hashes") > 1)


def live_sessions(sessions: DataFrame, now: int) -> DataFrame:
    return sessions.where((~F.col("revoked")) & (F.col("expires_at") > now))
