"""Registered queries of cluster upkeep: settings, groups, tasks, sessions, caches, lifecycle, text matching and stored tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import columns
from quillon.functions.hashing import shard_md5
from quillon.operators import migration, ranking, search, settings, text, topology
from quillon.plans.planner import plan
from quillon.queries import DOC_SHARD, NODES, NODES_SQL, RF, SHARD, TOKENS, assigned, assigned_sql, docs, nodes, query, scored_sql, sharded, table
from quillon.sources import control, reshard
from quillon.sources.index import Index
from quillon.sources.store import ControlStore
from quillon.streaming import cdc, monitor


@functools.cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="quillon-queries-")


def scratch(s) -> str:
    """A new folder in spark.checkpoint.dir for a query that writes and reads; local where that is unset, as in tests. Deleted when the application ends."""
    root = f"{s.conf.get('spark.checkpoint.dir', None) or 'file://' + _local()}/quillon/query-{uuid.uuid4().hex}"
    path = s._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(s._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


# Stored tables --------------------------------------------------------------------------------------------------------


@query("index_upsert_read", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x-' || lang ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_id + 1000000000, source, n_chars FROM documents WHERE doc_id % 50 = 0")
def index_upsert_read(s, d):
    """Two writes and a deletion, read back."""
    ix, x = Index(s, scratch(s), "documents", "doc_id", 8), docs(s, d).select("doc_id", "lang", "n_chars")
    ix.upsert(x)
    new = docs(s, d).where("doc_id % 50 = 0").selectExpr("doc_id + 1000000000 AS doc_id", "source AS lang", "n_chars")
    ix.upsert(x.where("doc_id % 5 = 0").withColumn("lang", F.concat(F.lit("x-"), "lang")).unionByName(new))
    ix.delete_where(plan("doc_id < 1000000000", "doc_id").predicate & (F.col("doc_id") % 7 == 3))
    return ix.read().select("doc_id", "lang", "n_chars")


@query("index_duplicate_keys", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def index_duplicate_keys(s, d):
    """Of documents with one key in a batch the greatest stays."""
    ix = Index(s, scratch(s), "events", "user_id", 4)
    ix.upsert(table(s, d, "events").select("user_id", "event_id", "event_type"))
    return ix.read().select("user_id", "event_id")


@query("dump_round_trip", "SELECT doc_id, lang, source, n_chars FROM documents")
def dump_round_trip(s, d):
    """Documents through newline-delimited JSON into another index."""
    root = scratch(s)
    a, b = Index(s, root, "a", "doc_id", 4), Index(s, root, "b", "doc_id", 4)
    a.upsert(docs(s, d).select("doc_id", "lang", "source", "n_chars"))
    a.dump(f"{root}/dump")
    b.load_dump(f"{root}/dump")
    return b.read().select("doc_id", "lang", "source", "n_chars")


@query("dump_analysis", "SELECT count(*) AS documents, count(*) FILTER (doc_id % 10 = 0) AS without_key, count(*) FILTER (doc_id % 4 = 0) AS reserved FROM documents")
def dump_analysis(s, d):
    from quillon.sources.index import analyse_dump

    root = scratch(s)
    x = docs(s, d).select(F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("id"), F.when(F.col("doc_id") % 4 == 0, 1).alias("_origin"), "lang")
    x.write.json(f"{root}/dump")
    return analyse_dump(s, f"{root}/dump", "id")


@query("control_store_tasks", "SELECT CAST(event_id AS VARCHAR) AS task_id, CASE WHEN event_id % 3 = 0 THEN 'succeeded' ELSE 'enqueued' END AS status, event_id AS created_at FROM events WHERE event_id % 11 <> 0")
def control_store_tasks(s, d):
    """Tasks put, replaced by key and pruned in the stored control tables."""
    store, e = ControlStore(s, scratch(s), 2), table(s, d, "events").select(F.col("event_id").cast("string").alias("task_id"), F.col("event_id").alias("created_at"))
    store.put("tasks", e.withColumn("status", F.lit("enqueued")))
    store.put("tasks", e.where("created_at % 3 = 0").withColumn("status", F.lit("succeeded")))
    store.delete("tasks", F.col("created_at") % 11 == 0)
    return store.read("tasks").select("task_id", "status", "created_at")


@query("search_indexed", f"SELECT doc_id, lang, round(score, 6) AS score FROM {scored_sql(['that', 'thing'], 'n_chars > 300')} ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 20 OFFSET 5")
def search_indexed(s, d):
    """A filtered page from an index's postings, after an update that changes nothing but which files hold them."""
    ix, x = Index(s, scratch(s), "documents", "doc_id", 8, "text"), docs(s, d)
    ix.upsert(x)
    ix.upsert(x.where("doc_id % 40 = 0"))
    found = ix.search(search.SearchRequest("thing that", "n_chars > 300", attributes=["doc_id", "lang"], offset=5, limit=20, show_score=True))
    return found.withColumn("score", F.round("score", 6))


@query("reshard_run", f"SELECT doc_id, lang, {SHARD.format('doc_id', 16)} AS shard, 'documents__reshard_16' AS uid, 2 AS version FROM documents")
def reshard_run(s, d):
    """A copy with other shards, compared and pointed to by the alias."""
    root = scratch(s)
    ix, store = Index(s, root, "documents", "doc_id", 4), ControlStore(s, root, 1)
    ix.upsert(docs(s, d).select("doc_id", "lang", "n_chars"))
    store.put("aliases", s.createDataFrame([("live", "single", "documents", 1)], "name string, kind string, current_uid string, version long"))
    shadow = reshard.backfill(ix, 16)
    reshard.swap(store, "live", ix, shadow, 5)
    live = store.read("aliases").select(F.col("current_uid").alias("uid"), "version")  # one row
    return shadow.read().select("doc_id", "lang", F.col("_shard").alias("shard")).join(F.broadcast(live))


@query("facet_maps", "SELECT 'lang' AS facet, '{' || string_agg('\"' || lang || '\":' || n, ',' ORDER BY lang) || '}' AS distribution FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1)")
def facet_maps(s, d):
    """Counts of a facet's values as a map with its keys in order."""
    return search.facet_map(search.facet_counts(docs(s, d), ["lang"])).select("facet", F.to_json("distribution").alias("distribution"))


@query("change_messages", "SELECT CAST(event_id AS VARCHAR) AS key, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def change_messages(s, d):
    return cdc.messages(table(s, d, "events").select("event_id", "event_type"))


# Settings -------------------------------------------------------------------------------------------------------------


@query("settings_rollback", """WITH n AS (SELECT user_id AS node_id, min(event_id) AS pos, bool_and(user_id <> 40) AS ok FROM events GROUP BY 1), f AS (SELECT arg_min(node_id, pos) AS bad, min(pos) AS stop FROM n WHERE NOT ok)
  SELECT node_id, CASE WHEN stop IS NULL THEN 'applied' WHEN pos < stop THEN 'rolled back' WHEN node_id = bad THEN 'failed' ELSE 'not asked' END AS outcome, CASE WHEN stop IS NULL THEN 'new' WHEN node_id % 2 = 0 THEN 'old' END AS value FROM n, f""")
def settings_rollback(s, d):
    n = table(s, d, "events").groupBy(F.col("user_id").alias("node_id")).agg(F.min("event_id").alias("pos"))
    n = n.select("node_id", "pos", F.when(F.col("node_id") % 2 == 0, "old").alias("held"), (F.col("node_id") != 40).alias("ok"))
    return settings.apply_in_turn(n, "new")


@query("settings_two_phase", """WITH i AS (SELECT DISTINCT user_id AS index_uid FROM events), a AS (SELECT DISTINCT user_id AS index_uid, event_id % 4 AS node FROM events)
  SELECT i.index_uid, CASE WHEN i.index_uid % 3 <> 0 OR count(*) FILTER (node = 2) = 0 THEN 'commit' WHEN i.index_uid % 2 = 0 THEN 'repair' ELSE 'freeze' END AS verdict,
    CASE WHEN i.index_uid % 3 <> 0 OR count(*) FILTER (node = 2) = 0 THEN 8 ELSE 7 END AS version, coalesce(list(DISTINCT 'n2') FILTER (i.index_uid % 3 = 0 AND node = 2), []) AS differing FROM i JOIN a USING (index_uid) GROUP BY 1""")
def settings_two_phase(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("index_uid"), F.concat(F.lit("n"), F.col("event_id") % 4).alias("node_id")).distinct()
    wrong = (F.col("index_uid") % 3 == 0) & (F.col("node_id") == "n2")
    actual = e.withColumn("settings", F.when(wrong, '{"a": 1, "b": 3}').otherwise('{"b":2, "a":1}'))
    proposed = e.select("index_uid").distinct().select("index_uid", F.lit('{"a":1,"b":2}').alias("settings"), F.lit(7).alias("version"), F.when(F.col("index_uid") % 2 == 0, 1).otherwise(3).alias("attempts"))
    return settings.verify(actual, proposed)


@query("settings_cover", f"SELECT count(*) FILTER (n = 0) = 0 AS covered, coalesce(list(shard ORDER BY shard) FILTER (n = 0), []) AS missing FROM (SELECT shard, count(*) FILTER (node_id IN ('node-g0-0', 'node-g1-1')) AS n FROM {assigned_sql()} GROUP BY 1)")
def settings_cover(s, d):
    return settings.cover(assigned(s), s.createDataFrame([("node-g0-0",), ("node-g1-1",)], "node_id string"))


# Groups, nodes, placement ---------------------------------------------------------------------------------------------

_THREE = [*NODES, *[(f"node-g2-{i}", 2, "joining") for i in range(3)]]
_THREE = [(n, g, "failed" if n == "node-g0-0" else x) for n, g, x in _THREE]
_THREE_SQL = "(VALUES " + ", ".join(f"('{n}', {g}, '{x}')" for n, g, x in _THREE) + ") AS nodes(node_id, replica_group, status)"


@query("group_add", f"SELECT t.shard, arg_min(a.node_id, a.replica_group * 100 + a.rank) AS source, t.node_id AS target FROM {assigned_sql(_THREE_SQL)} t JOIN {assigned_sql(_THREE_SQL)} a ON a.shard = t.shard AND a.replica_group < 2 AND a.node_id <> 'node-g0-0' WHERE t.replica_group = 2 GROUP BY t.shard, t.node_id")
def group_add(s, d):
    return topology.add_group(nodes(s, _THREE), assigned(s, _THREE), 2)


@query("group_states", "SELECT user_id AS replica_group, CASE WHEN bool_and(event_type <> 'error') THEN 'active' ELSE 'initializing' END AS state FROM events GROUP BY 1")
def group_states(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("replica_group"), F.col("event_id").alias("shard"), (F.col("event_type") != "error").alias("done"))
    return topology.group_states(e)


@query("group_remove", f"SELECT shard, node_id FROM {assigned_sql()} WHERE replica_group = 1 AND rank = 3 % {RF}")
def group_remove(s, d):
    return topology.covering_set(topology.without_group(assigned(s), 0), 3)


@query("topology_report", f"SELECT n.node_id, n.replica_group, n.status, count(a.shard) AS shards, count(*) FILTER (a.rank = 0) AS primaries, n.status IN ('healthy', 'active') AS serving FROM {_THREE_SQL.replace('AS nodes', 'AS n')} LEFT JOIN {assigned_sql()} a ON a.node_id = n.node_id GROUP BY ALL")
def topology_report(s, d):
    return topology.topology_report(nodes(s, _THREE), assigned(s))


@query("reshard_cost", f"""WITH c AS (SELECT range AS shard FROM range(128)), a AS (SELECT {DOC_SHARD} AS shard, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT {SHARD.format('doc_id', 128)} AS shard, count(*) AS n FROM documents GROUP BY 1),
  x AS (SELECT c.shard, coalesce(n, 0) AS n FROM c LEFT JOIN a USING (shard) WHERE c.shard < 64), y AS (SELECT c.shard, coalesce(n, 0) AS n FROM c LEFT JOIN b USING (shard)),
  p AS (SELECT max(m) AS m FROM (SELECT node_id, sum(n) AS m FROM {assigned_sql()} z JOIN x USING (shard) GROUP BY 1)),
  q AS (SELECT max(m) AS m FROM (SELECT node_id, sum(n) AS m FROM {assigned_sql().replace('range(64)', 'range(128)')} z JOIN y USING (shard) GROUP BY 1))
  SELECT CAST((SELECT sum(n) FROM x) AS BIGINT) AS docs, (SELECT round(stddev_pop(n) / avg(n), 6) FROM x) AS cv_old, (SELECT round(stddev_pop(n) / avg(n), 6) FROM y) AS cv_new, CAST(p.m * 1000 AS BIGINT) AS node_bytes, CAST((p.m + q.m) * 1000 AS BIGINT) AS node_peak_bytes,
    CAST(floor((SELECT sum(n) FROM x) / 50 * 2 * 10 * 2 * 2 * 1000 + (SELECT sum(n) FROM x) * 2 * 2 * 1000) AS BIGINT) AS bytes_written FROM p, q""")
def reshard_cost(s, d):
    new = topology.assignment(nodes(s), 128, RF)
    r = migration.cost(docs(s, d), "doc_id", (assigned(s), 64), (new, 128), 2, 2, 1000, 10.0, 50.0)
    return r.withColumn("cv_old", F.round("cv_old", 6)).withColumn("cv_new", F.round("cv_new", 6))


@query("replica_choice", "SELECT shard, arg_min(node, (coalesce(score, 0), node)) AS node FROM (SELECT user_id % 8 AS shard, user_id % 3 AS node, avg(value) FILTER (event_type <> 'error' OR user_id > 20) AS score FROM events GROUP BY 1, 2) GROUP BY 1")
def replica_choice(s, d):
    e = table(s, d, "events").groupBy((F.col("user_id") % 8).alias("shard"), (F.col("user_id") % 3).alias("node"))
    return monitor.best_replica(e.agg(F.avg(F.when((F.col("event_type") != "error") | (F.col("user_id") > 20), F.col("value"))).alias("score")), "shard", "node")


@query("replicas_divergent", "WITH s AS (SELECT user_id AS node_id, avg(value) * CASE WHEN user_id % 9 = 0 THEN 9 ELSE 1 END AS score FROM events GROUP BY 1) SELECT node_id, round(score, 5) AS score FROM s WHERE score > 5 * (SELECT median(score) FROM s)")
def replicas_divergent(s, d):
    e = table(s, d, "events").groupBy(F.col("user_id").alias("node_id")).agg((F.avg("value") * F.when(F.first("user_id") % 9 == 0, 9).otherwise(1)).alias("score"))
    return ranking.divergent_replicas(e).select("node_id", F.round("score", 5).alias("score"))


# Tasks and sessions ---------------------------------------------------------------------------------------------------


@query("task_list_filtered", "SELECT event_id AS uid, event_type AS type FROM events WHERE event_type IN ('view', 'click') AND user_id IN (3, 4, 5, 6, 7) ORDER BY uid DESC LIMIT 25")
def task_list_filtered(s, d):
    t = table(s, d, "events").select(F.col("event_id").alias("uid"), F.col("event_type").alias("type"), F.concat(F.lit("ix"), "user_id").alias("index_uid"), F.lit("succeeded").alias("status"))
    return control.task_page(t, [], None, 25, [f"ix{i}" for i in range(3, 8)], ["view", "click"]).select("uid", "type")


@query("task_stored_page", "SELECT CAST(event_id AS VARCHAR) AS task_id, user_id AS created_at FROM events WHERE event_type = 'error' ORDER BY created_at DESC, task_id DESC LIMIT 15 OFFSET 10")
def task_stored_page(s, d):
    t = table(s, d, "events").select(F.col("event_id").cast("string").alias("task_id"), F.col("user_id").alias("created_at"), F.col("event_type").alias("status"))
    return control.stored_tasks(t, "error", 10, 15).select("task_id", "created_at")


@query("task_reconcile", """WITH t AS (SELECT user_id AS task_id, unnest(['n1', 'n2', 'n3']) AS node_id FROM (SELECT DISTINCT user_id FROM events)), s AS (SELECT user_id AS task_id, 'n' || (event_id % 3 + 1) AS node_id, max(CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 0 ELSE 3 END) AS r FROM events WHERE event_id % 3 < 2 GROUP BY 1, 2)
  SELECT task_id, CASE max(coalesce(r, 2)) WHEN 4 THEN 'failed' WHEN 3 THEN 'processing' WHEN 2 THEN 'enqueued' ELSE 'succeeded' END AS status, count(*) AS n_nodes FROM t LEFT JOIN s USING (task_id, node_id) GROUP BY 1""")
def task_reconcile(s, d):
    e = table(s, d, "events")
    tasks = e.select(F.col("user_id").alias("task_id")).distinct().withColumn("node_tasks", F.map_from_arrays(F.array(*[F.lit(f"n{i}") for i in (1, 2, 3)]), F.array(*[F.col("task_id")] * 3)))
    rank = F.max(F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "view", 0).otherwise(3))
    states = e.where("event_id % 3 < 2").groupBy(F.concat(F.lit("n"), F.col("event_id") % 3 + 1).alias("node_id"), F.col("user_id").alias("uid")).agg(rank.alias("r"))
    states = states.select("node_id", "uid", F.when(F.col("r") == 4, "failed").when(F.col("r") == 3, "processing").otherwise("succeeded").alias("status"))
    return control.reconcile(tasks, states)


@query("session_groups", """WITH w AS (SELECT user_id AS session_id, max((ts, event_id)) AS v FROM (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') GROUP BY 1),
  l AS (SELECT session_id, struct_extract_at(v, 2) AS task_id, struct_extract_at(v, 1) AS at FROM w WHERE struct_extract_at(v, 1) > TIMESTAMP '2024-01-20 00:00:00'),
  a AS (SELECT task_id, g, n, min(t) AS t FROM (SELECT event_id AS task_id, x // 3 AS g, x % 3 AS n, ts + to_seconds((event_id * (x + 3)) % 7) AS t FROM events, (SELECT range AS x FROM range(6)) WHERE (event_id + x) % 4 <> 0) GROUP BY 1, 2, 3),
  q AS (SELECT task_id, g, t FROM a QUALIFY row_number() OVER (PARTITION BY task_id, g ORDER BY t, n) = 2), f AS (SELECT task_id, arg_min(g, (t, g)) AS g FROM q GROUP BY 1)
  SELECT session_id, l.task_id, CASE WHEN g <> 1 THEN g END AS pinned_group FROM l LEFT JOIN f USING (task_id)""")
def session_groups(s, d):
    """Sessions pinned to the group that first had a quorum for their last write; group 1 has failed."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    writes = e.where("event_type = 'purchase'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("task_id"), "ts")
    x = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("x")
    acks = e.select("event_id", "ts", x).where("(event_id + x) % 4 <> 0")
    acks = acks.selectExpr("event_id AS task_id", "CAST(floor(x / 3) AS int) AS replica_group", "x % 3 AS node_id", "timestamp_seconds(CAST(ts AS double) + (event_id * (x + 3)) % 7) AS ts")
    now = F.lit("2024-01-20 00:15:00").cast("timestamp")
    return cdc.session_pins(writes, acks, s.createDataFrame([(1,)], "replica_group int"), 2, now)


@query("session_live", "SELECT CAST(event_id AS VARCHAR) AS session_id FROM events WHERE event_type <> 'error' AND user_id > 30")
def session_live(s, d):
    x = table(s, d, "events").select(F.col("event_id").cast("string").alias("session_id"), (F.col("event_type") == "error").alias("revoked"), F.col("user_id").alias("expires_at"))
    return control.live_sessions(x, 30).select("session_id")


# Caches, policies, lifecycle ------------------------------------------------------------------------------------------


@query("retry_cache", """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS key, event_id, epoch(ts)::DOUBLE AS t, event_type <> 'error' AS good FROM events), r AS (SELECT key, min(t) AS t FROM e WHERE good GROUP BY 1
  UNION ALL SELECT r.key, (SELECT min(e.t) FROM e WHERE e.key = r.key AND e.good AND e.t >= r.t + 86400) FROM r WHERE r.t IS NOT NULL)
  SELECT event_id, EXISTS (SELECT 1 FROM r WHERE r.key = e.key AND r.t < e.t AND e.t < r.t + 86400) AS cached FROM e""")
def retry_cache(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("key"), "event_id", "ts", F.when(F.col("event_type") == "error", 503).otherwise(202).alias("status"))
    return control.retry_cache(e, 86400).select("event_id", "cached")


@query("cache_keys", "SELECT event_id, sha256(event_type || user_id || CASE WHEN event_id % 2 = 0 THEN 'k' ELSE '' END) AS key, upper(sha256(event_type)) AS tenant FROM events")
def cache_keys(s, d):
    e = table(s, d, "events")
    return e.select("event_id", control.retry_key(F.col("event_type"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "k")).alias("key"), F.hex(control.tenant_key(F.col("event_type"))).alias("tenant"))


@query("ttl_policies", "SELECT 'ix' || user_id AS index_uid, CASE WHEN user_id % 4 = 0 THEN 60 ELSE 300 END AS sweep_interval_s, CASE WHEN user_id % 8 = 0 THEN 5 ELSE 10000 END AS max_deletes, user_id % 4 <> 0 AS enabled FROM (SELECT DISTINCT user_id FROM events)")
def ttl_policies(s, d):
    u = table(s, d, "events").select("user_id").distinct()
    over = u.where("user_id % 4 = 0").select(F.concat(F.lit("ix"), "user_id").alias("index_uid"), F.lit(60).alias("sweep_interval_s"), F.when(F.col("user_id") % 8 == 0, 5).alias("max_deletes"), F.lit(False).alias("enabled"))
    return control.ttl_policies(u.select(F.concat(F.lit("ix"), "user_id").alias("index_uid")), over)


@query("request_counters", "SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS degraded, count(*) FILTER (event_type = 'error' AND user_id % 2 = 0) AS no_quorum FROM events")
def request_counters(s, d):
    bad = F.col("event_type") == "error"
    return monitor.counters(table(s, d, "events"), F.when(bad & (F.col("user_id") % 2 == 0), 503).otherwise(200), bad)


@query("cluster_stats", f"SELECT count(DISTINCT index_uid) AS indexes, CAST(sum(n) AS BIGINT) AS documents, CAST(sum(n * 2 * 10) AS BIGINT) AS bytes FROM (SELECT source AS index_uid, {DOC_SHARD} AS shard, count(*) AS n FROM documents GROUP BY 1, 2)")
def cluster_stats(s, d):
    per = sharded(s, d).groupBy(F.col("source").alias("index_uid"), F.col("_shard").alias("shard")).agg(F.count("*").alias("documents"))
    copies = per.withColumn("node_id", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("bytes", F.col("documents") * 10)
    return search.cluster_stats(copies)


@query("index_stats_busy", "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS documents, bool_or(event_type = 'click') AS is_indexing FROM events")
def index_stats_busy(s, d):
    tasks = table(s, d, "events").select(F.when(F.col("event_type") == "click", "processing").otherwise("succeeded").alias("status"))
    return search.index_stats(docs(s, d), "doc_id", tasks)


@query("answer_headers", "SELECT user_id AS request_id, string_agg(DISTINCT CAST(event_id % 7 AS VARCHAR), ',' ORDER BY CAST(event_id % 7 AS VARCHAR)) FILTER (event_type = 'error') AS degraded, min(event_id) FILTER (event_type <> 'error') AS settings_version, bool_or(event_type = 'signup') AS inconsistent, min(event_id % 2) AS \"group\" FROM events GROUP BY 1")
def answer_headers(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("request_id"), (F.col("event_id") % 7).alias("shard"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("settings_version"), (F.col("event_type") == "signup").alias("pending"), (F.col("event_id") % 2).alias("replica_group"))
    return search.answer_headers(e)


@query("facet_cube", "SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def facet_cube(s, d):
    return search.facet_cube(docs(s, d), ["lang", "source"])


@query("facet_cardinality", "SELECT unnest(['lang', 'source']) AS facet, unnest([count(DISTINCT lang), count(DISTINCT source)]) AS n FROM documents")
def facet_cardinality(s, d):
    return search.facet_cardinality(docs(s, d), ["lang", "source"])


@query("ilm_rolls", "SELECT 'logs-' || user_id AS index_uid, CASE WHEN count(*) >= 9 THEN 'docs' WHEN sum(length(props)) >= 80 THEN 'size' ELSE 'age' END AS reason FROM events GROUP BY user_id HAVING count(*) >= 9 OR sum(length(props)) >= 80 OR min(ts) <= TIMESTAMP '2024-01-03 00:00:00' ORDER BY min(ts), index_uid LIMIT 10")
def ilm_rolls(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("docs"), F.sum(F.length("props")).alias("bytes"), F.min("ts").alias("created"))
    x = e.select(F.concat(F.lit("logs-"), "user_id").alias("index_uid"), "docs", "bytes", "created")
    return monitor.rolls(x, {"max_docs": 9, "max_bytes": 80, "max_age_s": 7 * 86400}, F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query("jobs_due", "SELECT 'job-' || user_id AS name, coalesce(max(ts) FILTER (user_id % 5 <> 0) + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-28 00:00:00', true) AS due FROM events GROUP BY user_id")
def jobs_due(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("user_id") % 5 != 0, F.col("ts"))).alias("last_run"))
    return monitor.due(e.select(F.concat(F.lit("job-"), "user_id").alias("name"), F.lit(6 * 3600).alias("every_s"), "last_run"), F.lit("2024-01-28 00:00:00").cast("timestamp")).select("name", "due")


@query("shadow_sample", "SELECT event_id FROM events WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT < 0.05 * 4294967296 ORDER BY event_id DESC LIMIT 40")
def shadow_sample(s, d):
    return monitor.ring(monitor.shadowed(table(s, d, "events").select("event_id"), "event_id"), "event_id", 40)


@query("canary_history", "SELECT user_id AS canary_id, count(*) AS runs, count(*) FILTER (ok) AS passed, round(avg(ok::INT), 6) AS rate, max(event_id) FILTER (NOT ok) AS last_failure FROM (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20) GROUP BY 1")
def canary_history(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("canary_id"), F.col("event_id").alias("ran_at"), F.when(F.col("event_type") != "error", "pass").otherwise("fail").alias("status"))
    return control.canary_history(e, 20).withColumn("rate", F.round("rate", 6))


@query("canary_capture", "SELECT 'gold-' || row_number() OVER (ORDER BY ts, query) AS name, query, [event_id] AS expected_ids FROM (SELECT ts, event_type || event_id AS query, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts, query LIMIT 12)")
def canary_capture(s, d):
    e = table(s, d, "events").select("ts", F.concat("event_type", "event_id").alias("query"), F.array("event_id").alias("ids"))
    return monitor.capture(e, "ts", F.lit("2024-01-15 00:00:00").cast("timestamp"), 12, "gold")


@query("beacons", "SELECT event_type AS index_uid, count(*) AS queries, count(*) FILTER (user_id % 3 = 0) AS zero_hits, round(quantile_cont(value, 0.95), 5) AS p95 FROM events GROUP BY 1")
def beacons(s, d):
    e = table(s, d, "events").withColumnRenamed("event_type", "index_uid")
    return monitor.zero_hits(e.union(e.where("user_id < 20")), "event_id", "index_uid", F.col("user_id") % 3, F.col("value")).withColumn("p95", F.round("p95", 5))


# Changes --------------------------------------------------------------------------------------------------------------


@query("change_page", "SELECT event_id FROM events WHERE event_type = 'click' AND event_id > 100 ORDER BY event_id LIMIT 30")
def change_page(s, d):
    e = table(s, d, "events").select("event_id", F.col("event_id").alias("event_seq"), F.col("event_type").alias("index_uid"))
    return cdc.since(e, 100, "index_uid", "click", 30).select("event_id")


@query("version_as_of", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1")
def version_as_of(s, d):
    return cdc.as_of(table(s, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")).select("user_id", "event_id")


@query("change_batches", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(floor((rn - 1) / 10) AS BIGINT) AS batch, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2, 3")
def change_batches(s, d):
    return cdc.batches(table(s, d, "events"), "event_type", ["ts", "event_id"], "ts", 10, 86400)


@query("late_changes", "SELECT event_id, ts < TIMESTAMP '2024-01-20 00:00:00' AS late FROM events")
def late_changes(s, d):
    fine, stragglers = cdc.late(table(s, d, "events").select("event_id", "ts"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return fine.select("event_id", F.lit(False).alias("late")).union(stragglers.select("event_id", F.lit(True)))


@query("cdc_stream", "SELECT event_id, user_id FROM events WHERE event_type <> 'error'")
def cdc_stream(s, d):
    """A streaming run over everything that has arrived, twice delivered; the second run finds nothing new."""
    root, e = scratch(s), table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "repair").alias("origin"))
    e.union(e.where("event_id % 10 = 0")).repartition(3, "event_id").write.parquet(f"{root}/in")
    for _ in range(2):
        log = cdc.change_stream(s, e.schema, f"{root}/in", f"{root}/log", f"{root}/checkpoint", keep="60 days")
    return log.select("event_id", "user_id")


# Text and values ------------------------------------------------------------------------------------------------------


@query("term_matches", f"""WITH v AS (SELECT DISTINCT term FROM (SELECT unnest({TOKENS}) AS term FROM documents)) SELECT 'thinge' AS asked, term, levenshtein('thinge', term) AS edits FROM v WHERE term[1] = 't' AND levenshtein('thinge', term) <= 1
  UNION ALL SELECT 'the', term, 0 FROM v WHERE starts_with(term, 'the')""")
def term_matches(s, d):
    vocabulary = docs(s, d).select(F.explode(F.array_distinct(text.tokens("text"))).alias("term")).distinct()
    return text.matching_terms(vocabulary, ["thinge", "the"])


@query("search_expanded", f"SELECT doc_id, round(score, 6) AS score FROM {scored_sql(['ent', 'that'])} ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 20")
def search_expanded(s, d):
    """A stop word goes, a synonym comes in."""
    terms = [t for group in text.expanded(["the", "ent"], {"ent": ["that"]}, {"the"}) for t in group]
    found = search.search(docs(s, d), search.SearchRequest(" ".join(terms), attributes=["doc_id"], show_score=True))
    return found.withColumn("score", F.round("score", 6))


@query("match_positions", "SELECT doc_id, list_transform(range(1, len(p)), lambda i: {'start': CAST(list_sum(list_transform(p[:i], lambda x: length(x))) + (i - 1) * 2 AS INTEGER), 'length': 2}) AS places FROM (SELECT doc_id, string_split_regex(text, '(?i)\\bde\\b') AS p FROM documents WHERE doc_id % 10 = 0 AND regexp_full_match(text, '[\\x00-\\x7F]*'))")
def match_positions(s, d):
    x = docs(s, d).where((F.col("doc_id") % 10 == 0) & F.col("text").rlike("^[\\x00-\\x7F]*$"))
    return x.select("doc_id", text.match_positions("text", "de").alias("places"))


@query("json_values", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, coalesce(json_extract_string(props, '$.none'), '-') AS absent, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at, epoch_us(ts) // 1000 AS ms FROM events")
def json_values(s, d):
    ts = F.col("ts").cast("timestamp")
    return table(s, d, "events").select("event_id", columns.json_number(F.col("props"), "$.k").alias("k"), columns.json_text(F.col("props"), "$.none", "-").alias("absent"), columns.rfc3339(ts).alias("at"), columns.millis(ts).alias("ms"))


@query("counts_merged", "SELECT user_id % 10 AS id, count(*) AS total FROM events GROUP BY 1")
def counts_merged(s, d):
    one = lambda p: table(s, d, "events").where(p).groupBy((F.col("user_id") % 10).alias("id"), "event_type").agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    both = one("event_id % 2 = 0").withColumnRenamed("m", "a").join(one("event_id % 2 = 1").withColumnRenamed("m", "b"), "id", "full_outer")
    merged = both.select("id", F.explode(columns.merge_counts(F.col("a"), F.col("b"))))
    return merged.groupBy("id").agg(F.sum("value").alias("total"))


@query("hash_weights", "SELECT doc_id, round(0.5 + ('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT / 4294967296, 8) AS weight, 'documents__reshard_128' AS shadow FROM documents")
def hash_weights(s, d):
    return docs(s, d).select("doc_id", F.round(columns.weight(F.col("doc_id"), 42), 8).alias("weight"), F.lit(migration.shadow_name("documents", 128)).alias("shadow"))


@query("merge_strategies", f"WITH a AS MATERIALIZED (SELECT * FROM {scored_sql(['thing'])}), b AS MATERIALIZED (SELECT * FROM {scored_sql(['that'])}), n AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM a UNION ALL SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) FROM b) SELECT doc_id, round(max(x), 6) AS score FROM n GROUP BY 1")
def merge_strategies(s, d):
    m = lambda q: search.matches(docs(s, d), search.SearchRequest(q), "doc_id", "text")
    return search.merge([m("thing"), m("that")], "doc_id", "minmax").withColumn("score", F.round("score", 6))


@query("or_is_not_narrowed", "SELECT doc_id FROM documents WHERE doc_id = 5 OR lang = 'fr'")
def or_is_not_narrowed(s, d):
    p = plan('doc_id = 5 OR lang = "fr"', "doc_id")
    assert not p.narrowed
    return sharded(s, d).where(p.condition()).select("doc_id")
