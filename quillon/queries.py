"""Registered queries: each operator on the synthetic tables, with the SQL that gives the same rows.

``@query(name, sql)`` registers a query; without SQL it is checked by tests alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.columns import in_window, minute_of_day
from quillon.functions.hashing import shard_md5
from quillon.operators import migration, ranking, repair, search, topology
from quillon.operators.search import SearchRequest
from quillon.operators.text import crop, highlight, term_stats
from quillon.plans.planner import plan
from quillon.sources import control, index
from quillon.streaming import cdc, monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def sharded(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).withColumn("_shard", shard_md5("doc_id"))


SHARD = "CAST(('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8))::BIGINT % {} AS INTEGER)"
DOC_SHARD = SHARD.format("doc_id", 64)
NODES = [(f"node-g{g}-{i}", g, "active") for g in range(2) for i in range(3)]
NODES_SQL = "(VALUES " + ", ".join(f"('{n}', {g}, '{s}')" for n, g, s in NODES) + ") AS nodes(node_id, replica_group, status)"
RF = 2
ASSIGNED_SQL = f"""(SELECT replica_group, shard, CAST(rn - 1 AS INTEGER) AS rank, node_id FROM (
  SELECT replica_group, shard, node_id, row_number() OVER (PARTITION BY replica_group, shard ORDER BY md5(CAST(shard AS VARCHAR) || ':' || node_id) DESC, node_id) AS rn
  FROM {{nodes}}, (SELECT CAST(range AS INTEGER) AS shard FROM range(64))) WHERE rn <= {{rf}})"""


def assigned_sql(nodes: str = NODES_SQL, rf: int = RF) -> str:
    return ASSIGNED_SQL.format(nodes=nodes, rf=rf)


def nodes(s: SparkSession, rows=None) -> DataFrame:
    return topology.nodes_frame(s, rows or NODES)


def assigned(s: SparkSession, rows=None, rf: int = RF) -> DataFrame:
    return topology.assignment(nodes(s, rows), rf=rf)


# Sharding and placement -------------------------------------------------------------------------------------------


@query("shard_assign", f"SELECT doc_id, {DOC_SHARD} AS shard FROM documents")
def shard_assign(s, d):
    return docs(s, d).select("doc_id", shard_md5("doc_id").alias("shard"))


@query("shard_distribution", f"SELECT {DOC_SHARD} AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_distribution(s, d):
    return sharded(s, d).groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("n"))


@query("shard_skew", f"SELECT round(stddev_pop(n) / avg(n), 6) AS cv, round(median(n), 6) AS median, round(max(n) / median(n), 6) AS max_over_median FROM (SELECT {DOC_SHARD} AS shard, count(*)::DOUBLE AS n FROM documents GROUP BY 1)")
def shard_skew(s, d):
    r = ranking.skew(shard_distribution(s, d), "n")
    return r.select(*[F.round(x, 6).alias(x) for x in r.columns])


@query("rendezvous_assignment", f"SELECT * FROM {assigned_sql()}")
def rendezvous_assignment(s, d):
    return assigned(s)


@query("covering_set", f"SELECT shard, node_id FROM {assigned_sql()} WHERE replica_group = 5 % 2 AND rank = 5 % {RF}")
def covering_set(s, d):
    return topology.covering_set(assigned(s), 5)


@query("write_targets", f"SELECT doc_id, a.replica_group, a.node_id FROM documents JOIN {assigned_sql()} a ON a.shard = {DOC_SHARD}")
def write_targets(s, d):
    return topology.route(sharded(s, d).select("doc_id", "_shard"), assigned(s)).select("doc_id", "replica_group", "node_id")


@query("shards_per_node", f"SELECT node_id, count(*) AS n, count(*) FILTER (rank = 0) AS primaries FROM {assigned_sql()} GROUP BY 1")
def shards_per_node(s, d):
    return assigned(s).groupBy("node_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 0).alias("primaries"))


_MORE = [*NODES, ("node-g0-3", 0, "active")]
_LESS = NODES[1:]


def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"('{n}', {g}, '{x}')" for n, g, x in rows) + ") AS nodes(node_id, replica_group, status)"


def _moves_sql(rows) -> str:
    return f"""SELECT coalesce(a.replica_group, b.replica_group) AS replica_group, coalesce(a.shard, b.shard) AS shard, coalesce(a.node_id, b.node_id) AS node_id,
      CASE WHEN a.shard IS NULL THEN 'add' ELSE 'remove' END AS change
      FROM {assigned_sql()} a FULL JOIN {assigned_sql(_values(rows))} b ON a.replica_group = b.replica_group AND a.shard = b.shard AND a.node_id = b.node_id
      WHERE a.shard IS NULL OR b.shard IS NULL"""


@query("placement_moves_add_node", _moves_sql(_MORE))
def placement_moves_add_node(s, d):
    return topology.moves(assigned(s), assigned(s, _MORE))


@query("placement_moves_remove_node", _moves_sql(_LESS))
def placement_moves_remove_node(s, d):
    return topology.moves(assigned(s), assigned(s, _LESS))


_SICK = [(n, g, "failed" if n == "node-g0-1" else x) for n, g, x in NODES]


@query("under_replicated", f"SELECT a.replica_group, a.shard, count(*) FILTER (a.node_id <> 'node-g0-1') AS live FROM {assigned_sql()} a GROUP BY 1, 2 HAVING count(*) FILTER (a.node_id <> 'node-g0-1') < {RF}")
def under_replicated(s, d):
    return topology.under_replicated(assigned(s), nodes(s, _SICK), RF)


@query("node_batches", f"SELECT node_id, count(*) AS n_docs, count(DISTINCT a.shard) AS n_shards FROM documents JOIN {assigned_sql()} a ON a.shard = {DOC_SHARD} GROUP BY 1")
def node_batches(s, d):
    return topology.node_batches(sharded(s, d).select("doc_id", "_shard"), assigned(s), "doc_id")


@query("job_owner", "SELECT name, arg_max(worker, md5(name || ':' || worker)) AS worker FROM (SELECT DISTINCT source AS name FROM documents), (VALUES ('pod-0'), ('pod-1'), ('pod-2')) w(worker) GROUP BY 1")
def job_owner(s, d):
    return topology.owner(docs(s, d).select(F.col("source").alias("name")).distinct(), s.createDataFrame([("pod-0",), ("pod-1",), ("pod-2",)], "worker string"))


@query("status_transitions", """WITH s AS (SELECT unnest(['healthy', 'degraded', 'active', 'joining', 'draining', 'failed', 'removed']) AS status)
  SELECT a.status || '-' || b.status AS node_id, a.status AS old, b.status AS new, CASE a.status WHEN b.status THEN true
    WHEN 'joining' THEN b.status = 'active' WHEN 'active' THEN b.status IN ('draining', 'failed', 'degraded', 'healthy') WHEN 'draining' THEN b.status IN ('removed', 'failed')
    WHEN 'failed' THEN b.status IN ('active', 'degraded') WHEN 'degraded' THEN b.status = 'active' WHEN 'healthy' THEN b.status = 'active' ELSE false END AS valid FROM s a, s b""")
def status_transitions(s, d):
    pairs = [(f"{a}-{b}", a, b) for a in topology.STATUSES for b in topology.STATUSES]
    return topology.valid_transitions(s.createDataFrame(pairs, "node_id string, old string, new string"))


@query("write_eligible", """SELECT 'n-' || status AS node_id, shard, CASE WHEN status IN ('healthy', 'active', 'degraded') THEN true WHEN status = 'draining' THEN shard IS NULL ELSE false END AS eligible
  FROM (SELECT unnest(['healthy', 'degraded', 'active', 'joining', 'draining', 'failed', 'removed', 'lost']) AS status), (VALUES (3), (NULL)) x(shard) WHERE shard IS NULL AND status NOT IN ('draining', 'active', 'failed') OR shard = 3 AND status IN ('draining', 'active', 'failed')
  UNION ALL SELECT 'm-draining', NULL, true""")
def write_eligible(s, d):
    rows = [(f"n-{x}", x) for x in (*topology.STATUSES, "lost")] + [("m-draining", "draining")]
    drained = s.createDataFrame([(f"n-{x}", 3) for x in ("draining", "active", "failed")], "node_id string, shard int")
    return topology.write_eligible(s.createDataFrame(rows, "node_id string, status string"), drained)


@query("drain_node_documents", f"SELECT count(*) AS documents FROM documents WHERE {DOC_SHARD} IN (SELECT shard FROM {assigned_sql()} WHERE node_id = 'node-g0-0')")
def drain_node_documents(s, d):
    mine = assigned(s).where("node_id = 'node-g0-0'").select(F.col("shard").alias("_shard"))
    return sharded(s, d).select("_shard").join(F.broadcast(mine), "_shard", "left_semi").agg(F.count("*").alias("documents"))


# Lookups and search -----------------------------------------------------------------------------------------------

_ALL = "doc_id, lang, source, n_chars"


@query("point_lookup", f"SELECT {_ALL} FROM documents WHERE doc_id = 42")
def point_lookup(s, d):
    return sharded(s, d).where(plan("doc_id = 42", "doc_id").condition()).select("doc_id", "lang", "source", "n_chars")


@query("pk_in_pruned", f"SELECT {_ALL} FROM documents WHERE doc_id IN (1, 5, 9, 9, 777777777) AND lang = 'en'")
def pk_in_pruned(s, d):
    return sharded(s, d).where(plan('doc_id IN [1, 5, 9, 9, 777777777] AND lang = "en"', "doc_id").condition()).select("doc_id", "lang", "source", "n_chars")


_LITERALS = ["doc_id = 42.0", 'doc_id = "042"', 'doc_id = "42 "', "doc_id = -0", 'doc_id IN ["7", " 8"]', "doc_id IN [7.0, 8.5]", 'doc_id IN [42, "042"]', 'doc_id = 42 AND doc_id = "042"', "doc_id = 42.5", "doc_id = 3 AND NOT doc_id = 3.0"]


@query("pk_literal_types", """SELECT f AS filter, doc_id FROM documents, (VALUES (0, 'doc_id = 42.0', [42]), (1, 'doc_id = "042"', [42]), (2, 'doc_id = "42 "', [42]), (3, 'doc_id = -0', [0]), (4, 'doc_id IN ["7", " 8"]', [7, 8]), (5, 'doc_id IN [7.0, 8.5]', [7]),
  (6, 'doc_id IN [42, "042"]', [42]), (7, 'doc_id = 42 AND doc_id = "042"', [42])) v(i, f, ids) WHERE list_contains(ids, doc_id)""")
def pk_literal_types(s, d):
    x = sharded(s, d)
    return functools.reduce(DataFrame.union, [x.where(plan(f, "doc_id").condition()).select(F.lit(f).alias("filter"), "doc_id") for f in _LITERALS])


@query("filter_language", "SELECT doc_id FROM documents WHERE (lang = 'en' OR source IN ('src1', 'src2')) AND NOT n_chars < 500 AND n_chars BETWEEN 600 AND 4000 AND lang IS NOT NULL")
def filter_language(s, d):
    f = [['lang = "en"', 'source IN ["src1", "src2"]'], "NOT n_chars < 500", "n_chars 600 TO 4000 AND lang EXISTS"]
    return docs(s, d).where(plan(f, "doc_id").predicate).select("doc_id")


@query("shard_scan", f"SELECT doc_id FROM documents WHERE {DOC_SHARD} = 7")
def shard_scan(s, d):
    return sharded(s, d).where("_shard = 7").select("doc_id")


@query("browse_page", f"SELECT {_ALL} FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def browse_page(s, d):
    return docs(s, d).select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").offset(40).limit(20)


TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def scored_sql(terms: list[str], where: str = "true", by: str | None = None, name: str = "documents") -> str:
    """(all columns but text, score) of matching documents."""
    over = f"PARTITION BY {by}" if by else ""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(terms))
    stats = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) OVER ({over}) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / al))" for i in range(len(terms)))
    return f"""(SELECT *, {score} AS score FROM (
      SELECT *, count(*) OVER ({over}) AS n, avg(dl) OVER ({over}) AS al, {stats} FROM (
        SELECT *, len(t) AS dl, {tf} FROM (SELECT doc_id, lang, source, n_chars, {DOC_SHARD} AS _shard, {TOKENS} AS t FROM {name})))
      WHERE ({' + '.join(f'tf{i}' for i in range(len(terms)))}) > 0 AND {where})"""


_EN = "lang = 'en'"


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("search_bm25_topk", f"SELECT doc_id, round(score, 6) AS score FROM {scored_sql(['that', 'thing'])} ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 20")
def search_bm25_topk(s, d):
    return ranked(search.search(docs(s, d), SearchRequest("thing that", attributes=["doc_id"], show_score=True)))


@query("search_filtered_paged", f"SELECT doc_id, lang, round(score, 6) AS score FROM {scored_sql(['the', 'with'], _EN)} ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 10 OFFSET 30")
def search_filtered_paged(s, d):
    return ranked(search.search(docs(s, d), SearchRequest("the with", 'lang = "en"', attributes=["doc_id", "lang"], offset=30, limit=10, show_score=True)))


@query("search_threshold", f"SELECT doc_id FROM {scored_sql(['and', 'est'])} WHERE score >= 1.5 ORDER BY score DESC, CAST(doc_id AS VARCHAR) ")
def search_threshold(s, d):
    found = search.matches(docs(s, d), SearchRequest("and est", threshold=1.5), "doc_id", "text")
    return found.orderBy(F.desc("score"), F.col("doc_id").cast("string")).select("doc_id")


@query("search_sort_attr", f"SELECT doc_id, n_chars FROM {scored_sql(['que'])} ORDER BY n_chars DESC, score DESC, CAST(doc_id AS VARCHAR) LIMIT 15")
def search_sort_attr(s, d):
    return search.search(docs(s, d), SearchRequest("que", sort=["n_chars:desc"], attributes=["doc_id", "n_chars"], limit=15))


@query("search_empty_query", "SELECT doc_id FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 20")
def search_empty_query(s, d):
    return search.search(docs(s, d), SearchRequest(attributes=["doc_id"]))


@query("search_highlight_crop", "SELECT doc_id, regexp_replace(substr(text, greatest(1, instr(lower(text), 'ing') - 30), 60), '(?i)\\b(the)\\b', '<em>\\1</em>', 'g') AS shown FROM documents WHERE lang = 'en'")
def search_highlight_crop(s, d):
    return docs(s, d).where("lang = 'en'").select("doc_id", highlight(crop("text", "ing"), "the").alias("shown"))


@query("search_shard_topn", f"SELECT _shard, doc_id FROM (SELECT _shard, doc_id, row_number() OVER (PARTITION BY _shard ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rn FROM {scored_sql(['the', 'de'])}) WHERE rn <= 3")
def search_shard_topn(s, d):
    found = search.matches(sharded(s, d), SearchRequest("the de"), "doc_id", "text")
    return ranking.positions(found, "doc_id", 3, "_shard").select("_shard", "doc_id")


@query("term_statistics", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1")
def term_statistics(s, d):
    return term_stats(docs(s, d), "doc_id", "text")


@query("multi_search", f"SELECT index_uid, pk, round(score, 6) AS score FROM (SELECT 'documents' AS index_uid, CAST(doc_id AS VARCHAR) AS pk, score FROM {scored_sql(['thing'])} UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 1.0 FROM part WHERE p_size = 7) ORDER BY score DESC, index_uid, pk LIMIT 25")
def multi_search(s, d):
    a = search.matches(docs(s, d), SearchRequest("thing"), "doc_id", "text")
    b = search.matches(table(s, d, "part"), SearchRequest("", "p_size = 7"), "p_partkey", "p_name")
    return ranked(search.multi_search({"documents": a, "part": b}, {"documents": "doc_id", "part": "p_partkey"}, 25))


@query("multi_alias_union", "SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE lang = 'en' UNION ALL SELECT source FROM documents WHERE lang = 'de') GROUP BY 1")
def multi_alias_union(s, d):
    x = docs(s, d)
    return x.where("lang = 'en'").unionByName(x.where("lang = 'de'").drop("n_chars"), allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))


# Facets, totals, degraded answers -----------------------------------------------------------------------------------


@query("facet_counts", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def facet_counts(s, d):
    return search.facet_counts(docs(s, d), ["lang", "source"])


@query("facet_filtered", "SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 2")
def facet_filtered(s, d):
    return search.facet_counts(search.matches(table(s, d, "part"), SearchRequest("", "p_size > 25"), "p_partkey", "p_name"), ["p_brand"])


@query("facet_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def facet_rollup(s, d):
    return search.facet_rollup(docs(s, d), "lang", "source")


@query("total_hits", f"SELECT count(*) AS total FROM {scored_sql(['thing', 'ent'])}")
def total_hits(s, d):
    return search.matches(docs(s, d), SearchRequest("thing ent"), "doc_id", "text").agg(F.count("*").alias("total"))


@query("field_distribution", "SELECT unnest(['doc_id', 'text', 'lang', 'source']) AS field, unnest([count(doc_id), count(text), count(lang), count(source)]) AS n FROM documents")
def field_distribution(s, d):
    return search.field_distribution(docs(s, d), ["doc_id", "text", "lang", "source"])


@query("index_stats", "SELECT count(DISTINCT doc_id) AS documents FROM documents")
def index_stats(s, d):
    return search.index_stats(docs(s, d), "doc_id")


def _pages(s, d):
    """A page a shard: the first 25 hits, as a search for 20 from the 5th on asks each shard for, and the number of all."""
    x = sharded(s, d).select("_shard", F.col("doc_id").cast("string").alias("pk"), (F.col("n_chars") % 97).cast("double").alias("score"))
    first = x.withColumn("n", F.row_number().over(W.partitionBy("_shard").orderBy(F.desc("score"), "pk"))).where("n <= 25")
    first = first.groupBy("_shard").agg(F.collect_list(F.struct("pk", "score")).alias("hits"))
    p = x.groupBy("_shard").agg(F.count("*").alias("total")).join(first, "_shard")
    return p.select((F.col("_shard") % 7 != 3).alias("success"), "hits", "total", (F.col("_shard") * 3).alias("millis"))


@query("merge_pages", f"SELECT CAST(doc_id AS VARCHAR) AS pk, CAST(n_chars % 97 AS DOUBLE) AS score FROM documents WHERE {DOC_SHARD} % 7 <> 3 ORDER BY score DESC, pk LIMIT 20 OFFSET 5")
def merge_pages(s, d):
    return search.merge_pages(_pages(s, d), 5, 20)


@query("scatter_degraded", f"SELECT CAST(sum(n) FILTER (sh % 7 <> 3) AS BIGINT) AS total, max(sh * 3) FILTER (sh % 7 <> 3) AS millis, bool_or(sh % 7 = 3) AS degraded FROM (SELECT {DOC_SHARD} AS sh, count(*) AS n FROM documents GROUP BY 1)")
def scatter_degraded(s, d):
    return search.merge_summary(_pages(s, d))


@query("group_fallback", f"SELECT shard, arg_min(node_id, replica_group * 100 + rank) FILTER (node_id NOT IN ('node-g0-0', 'node-g0-2')) AS node_id FROM {assigned_sql()} GROUP BY 1")
def group_fallback(s, d):
    return search.with_fallback(assigned(s), s.createDataFrame([("node-g0-0",), ("node-g0-2",)], "node_id string"))


@query("explain_plan", f"""WITH w AS (SELECT list_sort(list_distinct([{SHARD.format(1, 64)}, {SHARD.format(2, 64)}])) AS shards)
  SELECT true AS narrowed, 'primary key' AS reason, shards, (SELECT list_sort(list(DISTINCT node_id)) FROM {assigned_sql()} a WHERE list_contains(shards, a.shard)) AS nodes FROM w""")
def explain_plan(s, d):
    return search.explain(docs(s, d), SearchRequest("a", "doc_id IN [1, 2]"), "doc_id", assigned(s))


# Writes ---------------------------------------------------------------------------------------------------------------

_EVENT_SHARD = SHARD.format("event_id", 64)


@query("quorum_verdict", f"""WITH acks AS (SELECT CAST(user_id % 64 AS INTEGER) AS shard, CAST(event_id % 2 AS INTEGER) AS replica_group, event_type <> 'error' AS ok FROM events),
  e AS (SELECT CAST(s.range AS INTEGER) AS shard, CAST(g.range AS INTEGER) AS replica_group FROM range(64) s, range(2) g),
  r AS (SELECT e.shard, count(*) FILTER (a.ok) >= 2 AS reached FROM e LEFT JOIN acks a ON a.shard = e.shard AND a.replica_group = e.replica_group GROUP BY e.shard, e.replica_group)
  SELECT shard, bool_or(reached) AS ok, bool_or(NOT reached) AS degraded FROM r GROUP BY 1""")
def quorum_verdict(s, d):
    acks = table(s, d, "events").select((F.col("user_id") % 64).cast("int").alias("shard"), (F.col("event_id") % 2).cast("int").alias("replica_group"), (F.col("event_type") != "error").alias("ok"))
    expected = s.range(64).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(s.range(2).select(F.col("id").cast("int").alias("replica_group"))))
    return migration.quorum(acks, expected, 2)


_STATE = {"error": "failed", "view": "succeeded", "click": "processing", "signup": "enqueued", "purchase": "canceled"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATE.items()) + " END"


def _states(s, d):
    names = F.create_map(*[F.lit(x) for kv in _STATE.items() for x in kv])
    return table(s, d, "events").select((F.col("event_id") % 2000).alias("task_id"), names[F.col("event_type")].alias("status"), "event_id")


@query("task_aggregate", f"""SELECT task_id, CASE max(r) WHEN 4 THEN 'failed' WHEN 3 THEN 'processing' WHEN 2 THEN 'enqueued' WHEN 1 THEN 'canceled' ELSE 'succeeded' END AS status, count(*) AS n_nodes FROM (
  SELECT event_id % 2000 AS task_id, CASE {_STATE_SQL} WHEN 'failed' THEN 4 WHEN 'processing' THEN 3 WHEN 'enqueued' THEN 2 WHEN 'canceled' THEN 1 ELSE 0 END AS r FROM events) GROUP BY 1""")
def task_aggregate(s, d):
    return control.task_status(_states(s, d))


@query("task_list_page", f"SELECT event_id AS uid, {_STATE_SQL} AS status FROM events WHERE event_type IN ('error', 'click') AND event_id <= 900 ORDER BY uid DESC LIMIT 30")
def task_list_page(s, d):
    return control.task_page(_states(s, d).select(F.col("event_id").alias("uid"), "status"), ["failed", "processing"], 900, 30)


@query("upsert_latest", "SELECT user_id, arg_max(event_id, ts::VARCHAR || '#' || lpad(event_id::VARCHAR, 20, '0')) AS event_id FROM events GROUP BY 1")
def upsert_latest(s, d):
    return index.latest(table(s, d, "events").select("user_id", "event_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("partial_update", "SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 10 = 0 THEN 'X' ELSE o.o_orderstatus END AS o_orderstatus, o.o_custkey FROM orders o")
def partial_update(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("bigint").alias("o_custkey"))
    return index.merge_fields(o, new, "o_orderkey")


@query("delete_by_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_ids(s, d):
    return docs(s, d).select("doc_id").join(table(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("delete_by_filter", "SELECT doc_id FROM documents WHERE NOT (coalesce(lang = 'en' AND n_chars < 1000, false))")
def delete_by_filter(s, d):
    return index.delete_where(docs(s, d), plan('lang = "en" AND n_chars < 1000', "doc_id").predicate).select("doc_id")


@query("dual_write", f"SELECT doc_id, {SHARD.format('doc_id', 64)} AS shard, 'old' AS _origin FROM documents UNION ALL SELECT doc_id, {SHARD.format('doc_id', 128)}, 'new' FROM documents")
def dual_write(s, d):
    return migration.dual_write(docs(s, d).select("doc_id"), shard_md5("doc_id", 64), shard_md5("doc_id", 128))


# Score comparability --------------------------------------------------------------------------------------------------


@query("idf_local_vs_global", f"""SELECT _shard, n, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS local_idf, round(ln(1 + (sum(n) OVER () - sum(df) OVER () + 0.5) / (sum(df) OVER () + 0.5)), 6) AS global_idf FROM (
  SELECT {DOC_SHARD} AS _shard, count(*) AS n, count(*) FILTER (list_contains({TOKENS}, 'thing')) AS df FROM documents GROUP BY 1)""")
def idf_local_vs_global(s, d):
    from quillon.operators.text import idf, tokens

    per = sharded(s, d).groupBy("_shard").agg(F.count("*").alias("n"), F.count_if(F.array_contains(tokens("text"), "thing")).alias("df"))
    every = W.partitionBy()
    return per.select("_shard", "n", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("local_idf"), F.round(idf(F.sum("n").over(every), F.sum("df").over(every)), 6).alias("global_idf"))


@query("score_inflation", f"SELECT shard, round(ln(1 + total) / greatest(ln(1 + n), 0.1), 6) AS inflation FROM (SELECT {DOC_SHARD} AS shard, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY 1)")
def score_inflation(s, d):
    return shard_distribution(s, d).select("shard", F.round(ranking.inflation(F.sum("n").over(W.partitionBy()), F.col("n")), 6).alias("inflation"))


_TWO = ["that", "with"]
_TOP = "(SELECT *, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) - 1 AS pos FROM {} QUALIFY pos < 50)"
_GLOBAL = _TOP.format(scored_sql(_TWO))
_LOCAL = _TOP.format(scored_sql(_TWO, by="_shard"))


def _tops(s, d):
    x = sharded(s, d)
    r = SearchRequest(" ".join(_TWO))
    a = ranking.positions(search.matches(x, r, "doc_id", "text"), "doc_id", 50)
    b = ranking.positions(search.matches(x, r, "doc_id", "text", by="_shard"), "doc_id", 50)
    return a, b


@query("shard_score_stats", f"SELECT _shard, count(*) AS hits, round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean, round(max(score) - min(score), 6) AS spread FROM {_GLOBAL} GROUP BY 1")
def shard_score_stats(s, d):
    top = search.matches(sharded(s, d), SearchRequest(" ".join(_TWO)), "doc_id", "text").orderBy(F.desc("score"), F.col("doc_id").cast("string")).limit(50)
    r = ranking.score_stats(top)
    return r.select("_shard", "hits", *[F.round(x, 6).alias(x) for x in ("low", "high", "mean", "spread")])


_BOTH = f"WITH a AS MATERIALIZED (SELECT * FROM {_GLOBAL}), b AS MATERIALIZED (SELECT * FROM {_LOCAL})"
_PAIRED = f"{_BOTH}, j AS MATERIALIZED (SELECT a.pos AS r1, b.pos AS r2 FROM a JOIN b USING (doc_id))"


@query("rank_kendall_tau", f"{_PAIRED} SELECT round(coalesce(avg(CASE WHEN p.r2 < q.r2 THEN 1.0 ELSE -1.0 END), 1.0), 6) AS tau FROM j p, j q WHERE p.r1 < q.r1")
def rank_kendall_tau(s, d):
    return ranking.kendall_tau(*_tops(s, d), "doc_id").select(F.round("tau", 6).alias("tau"))


@query("rank_jaccard", f"{_BOTH} SELECT round(count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) / count(*), 6) AS jaccard FROM a FULL JOIN b USING (doc_id)")
def rank_jaccard(s, d):
    return ranking.jaccard(*_tops(s, d), "doc_id").select(F.round("jaccard", 6).alias("jaccard"))


@query("rank_divergence", f"{_BOTH} SELECT CAST(coalesce(min(pos) FILTER (a.doc_id IS DISTINCT FROM b.doc_id), 50) AS INTEGER) AS position FROM a FULL JOIN b USING (pos)")
def rank_divergence(s, d):
    return ranking.divergence(*_tops(s, d), "doc_id", 50)


@query("tau_summary", "SELECT round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS std, round(min(t), 6) AS low, round(max(t), 6) AS high, round(avg(CASE WHEN t >= 0.95 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT avg(value) / 500 AS t FROM events GROUP BY user_id)")
def tau_summary(s, d):
    r = ranking.summary(table(s, d, "events").groupBy("user_id").agg((F.avg("value") / 500).alias("tau")))
    return r.select(*[F.round(x, 6).alias(x) for x in r.columns])


@query("merge_minmax", f"SELECT doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 5) AS score FROM (SELECT *, min(score) OVER (PARTITION BY _shard) AS lo, max(score) OVER (PARTITION BY _shard) AS hi FROM {scored_sql(['thing'])})")
def merge_minmax(s, d):
    found = search.normalise(search.matches(sharded(s, d), SearchRequest("thing"), "doc_id", "text"), "_shard")
    return found.select("doc_id", F.round("score", 5).alias("score"))


@query("merge_rrf", f"SELECT doc_id, round(sum(1.0 / (60 + pos + 1)), 6) AS score FROM (SELECT doc_id, pos FROM {_TOP.format(scored_sql(['thing']))} UNION ALL SELECT doc_id, pos FROM {_TOP.format(scored_sql(['that']))}) GROUP BY 1")
def merge_rrf(s, d):
    cut = lambda q: search.matches(docs(s, d), SearchRequest(q), "doc_id", "text").orderBy(F.desc("score"), F.col("doc_id").cast("string")).limit(50)
    return ranked(search.rrf([cut("thing"), cut("that")], "doc_id"))


@query("hybrid_convex", f"WITH a AS MATERIALIZED (SELECT * FROM {scored_sql(['thing'])}), b AS MATERIALIZED (SELECT * FROM {scored_sql(['that'])}) SELECT doc_id, round(0.5 * coalesce(a.score, 0) + 0.5 * coalesce(b.score, 0), 6) AS score FROM a FULL JOIN b USING (doc_id)")
def hybrid_convex(s, d):
    m = lambda q: search.matches(docs(s, d), SearchRequest(q), "doc_id", "text")
    return ranked(search.convex(m("thing"), m("that"), "doc_id", 0.5))


_QUERY_VECTOR = [((i * 7) % 11 - 5) / 5 for i in range(64)]


@query("vector_topk", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]) DESC, vec_id LIMIT 25")
def vector_topk(s, d):
    r = search.nearest(table(s, d, "embeddings"), "vec_id", "embedding", _QUERY_VECTOR, 25)
    return r.select("vec_id", F.round("score", 5).alias("score"))


# Reconciliation, migration --------------------------------------------------------------------------------------------


def _copies(s, d):
    x = sharded(s, d).select("doc_id", "_shard", "n_chars", "lang")
    row = lambda name, extra, keep: x.where(keep).select(F.lit(name).alias("replica"), F.col("_shard").alias("shard"), F.col("doc_id").cast("string").alias("pk"), repair.content_hash(F.col("lang"), F.col("n_chars") + extra).alias("content_hash"), (F.col("n_chars") * 10 + extra).alias("updated_at"), F.when(F.col("doc_id") % 13 == 0, 500).alias("expires_at"), F.lit(1).alias("node_task_uid"))
    return row("r1", F.lit(0), F.col("doc_id") % 17 != 3).union(row("r2", F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0), F.col("doc_id") % 19 != 5))


_CONTENT = "md5(coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST({n} AS VARCHAR)) || ':' || {n}, '-'))"
_COPIES = f"""(SELECT 'r1' AS replica, {DOC_SHARD} AS shard, CAST(doc_id AS VARCHAR) AS pk, {_CONTENT.format(n='n_chars')} AS content_hash, n_chars * 10 AS updated_at, CASE WHEN doc_id % 13 = 0 THEN 500 END AS expires_at FROM documents WHERE doc_id % 17 <> 3
  UNION ALL SELECT 'r2', {DOC_SHARD}, CAST(doc_id AS VARCHAR), {_CONTENT.format(n='(n_chars + x)')}, n_chars * 10 + x, CASE WHEN doc_id % 13 = 0 THEN 500 END FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS x FROM documents) WHERE doc_id % 19 <> 5)"""
_BUCKET = "CAST(('0x' || substr(md5(pk), 1, 8))::BIGINT % 256 AS INTEGER)"
_HALF = "('0x' || substr(md5(pk || ':' || content_hash), 1, 12))::BIGINT"
_PRINT = f"bit_xor({_HALF})"
_TOTAL = f"CAST(sum({_HALF} & 2147483647) AS BIGINT)"


@query("replica_fingerprint", f"SELECT replica, shard, {_BUCKET} AS bucket, count(*) AS n, {_PRINT} AS fingerprint, {_TOTAL} AS total FROM {_COPIES} GROUP BY 1, 2, 3")
def replica_fingerprint(s, d):
    return repair.fingerprints(_copies(s, d))


@query("replica_buckets_differing", f"SELECT shard, bucket FROM (SELECT replica, shard, {_BUCKET} AS bucket, count(*) AS n, {_PRINT} AS f, {_TOTAL} AS t FROM {_COPIES} GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(DISTINCT (n, f, t)) > 1 OR count(*) < 2")
def replica_buckets_differing(s, d):
    return repair.differing(repair.fingerprints(_copies(s, d)))


@query("replica_diff", f"SELECT pk, CASE WHEN b.content_hash IS NULL THEN 'missing' WHEN a.content_hash IS NULL THEN 'extra' ELSE 'changed' END AS kind FROM (SELECT * FROM {_COPIES} WHERE replica = 'r1') a FULL JOIN (SELECT * FROM {_COPIES} WHERE replica = 'r2') b USING (pk) WHERE a.content_hash IS DISTINCT FROM b.content_hash")
def replica_diff(s, d):
    x = _copies(s, d)
    return repair.diff(x.where("replica = 'r1'"), x.where("replica = 'r2'"))


@query("repair_lww_ttl", f"""WITH c AS {_COPIES}, w AS (SELECT pk, arg_max(content_hash, updated_at) AS want, arg_max(coalesce(expires_at, 999), updated_at) <= 500 AS gone FROM c GROUP BY 1),
  j AS (SELECT r.replica, w.pk, w.want, w.gone, c.content_hash AS have FROM w CROSS JOIN (VALUES ('r1'), ('r2')) r(replica) LEFT JOIN c ON c.replica = r.replica AND c.pk = w.pk)
  SELECT replica, pk, CASE WHEN gone THEN 'delete' ELSE 'write' END AS action FROM j WHERE (NOT gone AND want IS DISTINCT FROM have) OR (gone AND have IS NOT NULL)""")
def repair_lww_ttl(s, d):
    return repair.repairs(_copies(s, d), 500)


def _writes(s, d):
    o = table(s, d, "orders")
    old = o.select(F.col("o_orderkey").alias("doc_id"), shard_md5("o_orderkey").alias("shard"), F.lit("old").alias("side"), F.lit(True).alias("ok"))
    return old.union(o.select("o_orderkey", shard_md5("o_orderkey"), F.lit("new"), F.col("o_orderkey") % 50 != 0))


@query("migration_delta", f"SELECT o_orderkey AS doc_id, {SHARD.format('o_orderkey', 64)} AS shard FROM orders WHERE o_orderkey % 50 = 0")
def migration_delta(s, d):
    return migration.delta(_writes(s, d))


@query("migration_loss_rate", "SELECT count(*) AS written, count(*) FILTER (o_orderkey % 50 = 0) AS lost, round(count(*) FILTER (o_orderkey % 50 = 0) / count(*), 6) AS rate FROM orders")
def migration_loss_rate(s, d):
    return migration.loss(_writes(s, d)).select("written", "lost", F.round("rate", 6).alias("rate"))


@query("reshard_verify", f"SELECT count(*) AS documents, count(*) FILTER ({SHARD.format('doc_id', 128)} % 64 = {DOC_SHARD}) AS stays FROM documents")
def reshard_verify(s, d):
    x = docs(s, d).select("doc_id", shard_md5("doc_id", 64).alias("a"), shard_md5("doc_id", 128).alias("b"))
    return x.agg(F.count("*").alias("documents"), F.count_if(F.col("b") % 64 == F.col("a")).alias("stays"))


_SCENARIOS = [("S1", 1.0, 10.0, 100.0, 2, 1, 64, 128, 3, 10000.0), ("S2", 10.0, 100.0, 1000.0, 2, 2, 64, 128, 4, 10000.0), ("S3", 1024.0, 1024.0, 10.0, 2, 1, 64, 128, 4, 5000.0)]


@query("reshard_load_model", "SELECT s, CAST(gb * 1048576 / kb AS BIGINT) AS documents, gb * 2 AS normal_gb, gb * 4 AS peak_gb, w * 2 * rf AS normal_writes, w * 4 * rf AS dual_writes, w * 4 * rf + t * 2 AS peak_writes, round(floor(gb * 1048576 / kb) / t, 3) AS backfill_s FROM (VALUES ('S1', 1.0::DOUBLE, 10.0::DOUBLE, 100.0::DOUBLE, 1, 10000.0::DOUBLE), ('S2', 10.0, 100.0, 1000.0, 2, 10000.0), ('S3', 1024.0, 1024.0, 10.0, 1, 5000.0)) v(s, kb, gb, w, rf, t)")
def reshard_load_model(s, d):
    rows = []
    for name, *a in _SCENARIOS:
        m = migration.load_model(*a)
        rows.append((name, m["documents"], m["normal_gb"], m["peak_gb"], m["normal_writes"], m["dual_writes"], m["peak_writes"], round(m["backfill_s"], 3)))
    return s.createDataFrame(rows, "s string, documents long, normal_gb double, peak_gb double, normal_writes double, dual_writes double, peak_writes double, backfill_s double")


@query("backfill_progress", f"SELECT shard, CAST(sum(n) OVER (ORDER BY shard) - n AS BIGINT) AS done_before, round(sum(n) OVER (ORDER BY shard) / sum(n) OVER (), 6) AS share FROM (SELECT {DOC_SHARD} AS shard, count(*) AS n FROM documents GROUP BY 1)")
def backfill_progress(s, d):
    return migration.backfill_progress(shard_distribution(s, d)).select("shard", "done_before", F.round("share", 6).alias("share"))


# Control tables -------------------------------------------------------------------------------------------------------


@query("alias_resolve", """WITH a AS (SELECT source AS name, count(DISTINCT lang) > 2 AS several, list(DISTINCT source || '-' || lang) AS targets, min(source || '-' || lang) AS one FROM documents WHERE source <> 'src7' GROUP BY 1), n AS (SELECT DISTINCT source AS name FROM documents)
  SELECT name, unnest(CASE WHEN a.name IS NULL THEN [n.name] WHEN several THEN targets ELSE [one] END) AS index_uid FROM n LEFT JOIN a USING (name)""")
def alias_resolve(s, d):
    """Aliases of one or of several indexes, and a name that is no alias."""
    x, uid = docs(s, d), F.concat_ws("-", "source", "lang")
    a = x.where("source <> 'src7'").groupBy(F.col("source").alias("name")).agg(F.count_distinct("lang").alias("n"), F.collect_set(uid).alias("targets"), F.min(uid).alias("one"))
    several = F.col("n") > 2
    a = a.select("name", F.when(several, "multi").otherwise("single").alias("kind"), F.when(~several, F.col("one")).alias("current_uid"), F.when(several, F.col("targets")).alias("target_uids"))
    return control.resolve(x.select(F.col("source").alias("name")).distinct(), a)


@query("alias_history", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def alias_history(s, d):
    return control.last_per_key(table(s, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 10)


@query("tenant_route", f"SELECT c_custkey AS tenant_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE {SHARD.format('c_custkey', 2)} END AS group_id FROM customer")
def tenant_route(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("tenant_id"))
    return control.tenant_groups(c, c.where("tenant_id % 3 = 0").withColumn("group_id", F.lit(1)), 2)


@query("job_claim", "SELECT min(event_id) AS id FROM events WHERE event_type IN ('purchase', 'signup') AND NOT (event_type = 'signup' AND event_id > 50)")
def job_claim(s, d):
    jobs = table(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "queued").when(F.col("event_type") == "signup", "claimed").otherwise("done").alias("state"), F.col("event_id").alias("claim_expires_at"))
    return control.claim(jobs, 50).select("id")


@query("lease_holder", "SELECT event_type AS scope, arg_max(CAST(user_id AS VARCHAR), event_id) AS holder FROM events WHERE event_id > 20 GROUP BY 1")
def lease_holder(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("holder"), F.col("event_id").alias("expires_at"))
    return control.holders(e, 20)


@query("cdc_cursor", "SELECT 'kafka' AS sink, event_type AS index_uid, max(event_id) AS last_event_seq, max(user_id) AS updated_at FROM events GROUP BY 2")
def cdc_cursor(s, d):
    e = table(s, d, "events").select(F.lit("kafka").alias("sink"), F.col("event_type").alias("index_uid"), F.col("event_id").alias("last_event_seq"), F.col("user_id").alias("updated_at"))
    return control.put_cursor(e.where("last_event_seq % 2 = 0"), e.where("last_event_seq % 2 = 1"))


@query("settings_floor", "SELECT n.node_id FROM (SELECT DISTINCT user_id AS node_id FROM events) n WHERE EXISTS (SELECT 1 FROM (SELECT event_type, user_id, max(event_id) AS version FROM events GROUP BY 1, 2) v WHERE v.user_id = n.node_id AND v.event_type = 'click' AND v.version >= (SELECT CAST(0.7 * max(event_id) AS BIGINT) FROM events))")
def settings_floor(s, d):
    """Nodes whose settings of one index are at a version or later; versions of other indexes don't count."""
    e = table(s, d, "events")
    floor = round(0.7 * e.agg(F.max("event_id")).first()[0])
    v = e.groupBy(F.col("event_type").alias("index_uid"), F.col("user_id").alias("node_id")).agg(F.max("event_id").alias("version"))
    return control.settings_floor(e.select(F.col("user_id").alias("node_id")).distinct(), v, "click", floor).select("node_id")


@query("settings_drift", "SELECT user_id AS index_uid, count(DISTINCT (event_id % 2, user_id % 5 = 0)) FILTER (user_id % 5 = 0) + count(DISTINCT user_id) FILTER (user_id % 5 <> 0) AS n_hashes, count(DISTINCT (event_id % 2, user_id % 5 = 0)) FILTER (user_id % 5 = 0) > 1 AS drifted FROM events GROUP BY 1")
def settings_drift(s, d):
    # every fifth index's nodes differ in a value, all of them in the order of keys and in white space
    e, q = table(s, d, "events"), F.when(F.col("user_id") % 5 == 0, F.col("event_id") % 2).otherwise(0).cast("string")
    one = F.concat(F.lit('{"a": {"y": ['), q, F.lit('], "x": "b c"}, "b": null}'))
    other = F.concat(F.lit('{"b":null,"a":{"x":"b c","y":['), q, F.lit("]}}"))
    return control.settings_drift(e.select(F.col("user_id").alias("index_uid"), F.when(F.col("event_id") % 3 == 0, one).otherwise(other).alias("settings")))


@query("task_prune", "SELECT event_id FROM events WHERE event_id >= 400")
def task_prune(s, d):
    return control.prune(table(s, d, "events").select("event_id"), "event_id", 400)


@query("settings_put", "SELECT user_id AS index_uid, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM (SELECT DISTINCT user_id FROM events)")
def settings_put(s, d):
    u = table(s, d, "events").select(F.col("user_id").alias("index_uid")).distinct()
    return control.put(u.withColumn("version", F.lit(1)), u.where("index_uid % 2 = 0").withColumn("version", F.lit(2)), ["index_uid"])


# Streams, as batch twins ----------------------------------------------------------------------------------------------


@query("cdc_suppressed", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'signup')")
def cdc_suppressed(s, d):
    return cdc.suppress(table(s, d, "events").withColumn("origin", F.col("event_type")), ("error", "signup")).select("event_id")


@query("event_sequence", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS event_seq FROM events")
def event_sequence(s, d):
    return cdc.sequence(table(s, d, "events"), "event_type", ["ts", "event_id"]).select("event_id", "event_seq")


@query("cdc_dedupe", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def cdc_dedupe(s, d):
    return cdc.first_of_key(table(s, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("idempotency_outcome", "SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN event_id % 3 <> 0 THEN 'miss' WHEN event_id % 2 = 0 THEN 'hit' ELSE 'conflict' END AS outcome, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 't' END AS task_id FROM events")
def idempotency_outcome(s, d):
    e = table(s, d, "events").select(F.col("event_id").cast("string").alias("key"), F.lit("a").alias("body_sha256"), "event_id")
    cache = e.where("event_id % 3 = 0").select("key", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("body_sha256"), F.lit("t").alias("task_id"), F.lit(100).alias("expires_at"))
    return control.idempotency(e.select("key", "body_sha256"), cache, 50)


@query("session_pins", """SELECT user_id, min(ts) AS start, max(ts) AS finish, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts >= p + INTERVAL 15 MINUTE OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, g""")
def session_pins(s, d):
    return cdc.sessions(table(s, d, "events"), "ts", "user_id", "15 minutes")


@query("rate_limit_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY 1, 2")
def rate_limit_windows(s, d):
    return cdc.rate_windows(table(s, d, "events"), "ts", "user_id", "1 hour", 2)


@query("query_coalesce", "SELECT make_timestamp(epoch_us(ts) // 50000 * 50000) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def query_coalesce(s, d):
    return cdc.coalesce_queries(table(s, d, "events"), "ts", "event_type")


@query("ttl_sweep", "SELECT CAST(event_id AS VARCHAR) AS pk, user_id AS expires_at FROM events WHERE user_id <= 30 ORDER BY expires_at, pk LIMIT 200")
def ttl_sweep(s, d):
    return repair.sweep(table(s, d, "events").select(F.col("event_id").cast("string").alias("pk"), F.col("user_id").alias("expires_at")), 30, 200)


@query("ilm_rollover", "SELECT CAST(ts AS DATE) AS day, count(*) AS docs, CAST(sum(length(props)) AS BIGINT) AS bytes, count(*) >= 340 OR sum(length(props)) >= 5000 AS rolls FROM events GROUP BY 1")
def ilm_rollover(s, d):
    return monitor.rollover(table(s, d, "events"), "ts", F.length("props"), {"max_docs": 340, "max_bytes": 5000})


@query("ilm_retention", "SELECT day, 'logs-' || strftime(day, '%Y-%m-%d') AS index_uid, dense_rank() OVER (ORDER BY day DESC) <= 5 OR max(day) OVER () - day < 7 AS keep FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)")
def ilm_retention(s, d):
    return monitor.retention(table(s, d, "events").select(F.to_date("ts").alias("day")).distinct(), 5)


@query("latency_histogram", "SELECT le, count(*) FILTER (value / 100 <= le) AS n FROM events, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]::DOUBLE[]) AS le) GROUP BY 1")
def latency_histogram(s, d):
    return monitor.latency_histogram(table(s, d, "events"), F.col("value") / 100)


@query("replica_score", "SELECT node, round(avg(value) + 2 * count(*) FILTER (event_type = 'click') + 10 * (count(*) FILTER (event_type = 'error') / count(*)) * 1000, 4) AS score FROM (SELECT *, user_id % 6 AS node FROM events) GROUP BY 1")
def replica_score(s, d):
    e = table(s, d, "events").groupBy((F.col("user_id") % 6).alias("node"))
    r = e.agg(F.avg("value").alias("l"), F.count_if(F.col("event_type") == "click").alias("i"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("e"))
    return r.select("node", F.round(monitor.replica_score(F.col("l"), F.col("i"), F.col("e")), 4).alias("score"))


@query("hedge_deadline", "SELECT user_id % 6 AS node, round(greatest(quantile_cont(value, 0.95) * 1.2, 15), 6) AS deadline FROM events GROUP BY 1")
def hedge_deadline(s, d):
    p = monitor.p95(table(s, d, "events").withColumn("node", F.col("user_id") % 6), "node", "value")
    return p.select("node", F.round(monitor.hedge_deadline(F.col("p95")), 6).alias("deadline"))


@query("health_transitions", """WITH l AS (SELECT user_id % 6 AS node, ts, event_id, event_type NOT IN ('error', 'purchase') AS ok FROM events), m AS (SELECT *, CASE WHEN ok = lag(ok) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY node ORDER BY ts, event_id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY node ORDER BY ts, event_id) AS run FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY node, run ORDER BY ts, event_id) AS nth FROM r),
  x AS (SELECT *, CASE WHEN NOT ok AND nth = 3 THEN 'unhealthy' WHEN ok AND nth = 2 THEN 'healthy' END AS state FROM n), y AS (SELECT * FROM x WHERE state IS NOT NULL)
  SELECT node, event_id, state FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY node ORDER BY ts, event_id), 'healthy') AS last FROM y) WHERE state <> last""")
def health_transitions(s, d):
    e = table(s, d, "events").withColumn("node", F.col("user_id") % 6)
    return monitor.health(e, "node", ["ts", "event_id"], ~F.col("event_type").isin("error", "purchase")).select("node", "event_id", "state")


@query("ewma_latency", """WITH RECURSIVE l AS MATERIALIZED (SELECT user_id % 6 AS node, epoch(ts)::DOUBLE AS t, value AS v, row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts, value) AS i FROM events WHERE value IS NOT NULL),
  f AS (SELECT node, i, t, v AS e FROM l WHERE i = 1 UNION ALL SELECT l.node, l.i, l.t, f.e * pow(0.5, (l.t - f.t) / 86400) + l.v * (1 - pow(0.5, (l.t - f.t) / 86400)) FROM f JOIN l ON l.node = f.node AND l.i = f.i + 1)
  SELECT node, round(arg_max(e, i), 6) AS ewma FROM f GROUP BY 1""")
def ewma_latency(s, d):
    r = monitor.ewma(table(s, d, "events").withColumn("node", F.col("user_id") % 6), "node", "ts", "value", 86400.0)
    return r.select("node", F.round("ewma", 6).alias("ewma"))


@query("clickthrough", "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, round(CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view') END, 6) AS ctr FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def clickthrough(s, d):
    r = monitor.clickthrough(table(s, d, "events"), "event_id", "event_type", "user_id")
    return r.withColumn("ctr", F.round("ctr", 6))


@query("window_guard", "SELECT event_id FROM events WHERE hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 360")
def window_guard(s, d):
    return table(s, d, "events").where(in_window(minute_of_day(F.col("ts")), "22:00-06:00")).select("event_id")


@query("shadow_diff", f"{_BOTH} SELECT count(*) FILTER (a.pos IS NOT NULL AND b.pos IS NOT NULL) AS \"both\", count(*) FILTER (b.pos IS NULL) AS only_primary, count(*) FILTER (a.pos IS NULL) AS only_shadow, count(*) FILTER (a.pos <> b.pos) AS moved FROM a FULL JOIN b USING (doc_id)")
def shadow_diff(s, d):
    return monitor.shadow_diff(*_tops(s, d), ["doc_id"])


@query("canary_assertions", "SELECT name, kind, passed FROM (SELECT 'en' AS name, unnest(['min_hits', 'max_hits', 'not_empty', 'top_hit_id']) AS kind, unnest([count(*) >= 10, count(*) <= 5, count(*) > 0, CAST(min(doc_id) AS VARCHAR) = '0']) AS passed FROM documents WHERE lang = 'en')")
def canary_assertions(s, d):
    r = docs(s, d).where("lang = 'en'").agg(F.count("*").alias("hits"), F.min("doc_id").cast("string").alias("first_id")).select(F.lit("en").alias("name"), "hits", "first_id", F.lit(1).alias("millis"), F.array("first_id").alias("top"))
    a = s.createDataFrame([("en", "min_hits", "10", None), ("en", "max_hits", "5", None), ("en", "not_empty", None, None), ("en", "top_hit_id", "0", None)], "name string, kind string, value string, ids array<string>")
    return monitor.canary(r, a)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Shards, a filter, two-term BM25, a global order and a page."""
    return ranked(search.search(sharded(s, d), SearchRequest("thing that", 'lang = "en"', attributes=["doc_id", "lang", "source"], limit=20, show_score=True)))


from quillon import queries_cluster  # noqa: E402, F401  registers its queries
