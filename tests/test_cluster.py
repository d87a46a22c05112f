import collections
import datetime

import pytest
from pyspark.sql import functions as F
from quillon.functions import columns
from quillon.operators import search, settings, text, topology
from quillon.sources import config, control, index, reshard
from quillon.sources.index import Index, IndexError_
from quillon.sources.store import ControlStore, open_store
from quillon.streaming import cdc, monitor

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


RULES = [
    ({"shards": 0}, "shards"),
    ({"replication_factor": 0}, "replication_factor must"),
    ({"server": {"port": 0}}, "port"),
    ({"task_store": {"backend": "sqlite"}}, "no such task store"),
    ({"unavailable_shard_policy": "guess"}, "no such policy"),
    ({"task_store": {"backend": "local"}}, "replication_factor over 1"),
    ({"task_store": {"backend": "local"}, "replica_groups": 2}, "more than one replica group needs a shared"),
    ({"replica_groups": 2, "leader_election": {"enabled": False}}, "leader election"),
    ({"task_store": {"backend": "local"}, "hpa": {"enabled": True}}, "scaling out"),
    ({"task_store": {"backend": "local"}, "cdc": {"enabled": True, "overflow": "store"}}, "change buffer"),
    ({"search_ui": {"enabled": True, "max_age_days": 7}}, "scoped keys"),
    ({"task_store": {"backend": "local"}, "search_ui": {"enabled": True, "rate_limit_backend": "store"}}, "rate limits"),
    ({"nodes": [{"id": "a", "replica_group": 1}]}, "no group 1"),
    ({"nodes": [{"id": "a"}, {"id": "a"}]}, "twice"),
    ({"tenant_affinity": {"enabled": True, "dedicated_groups": [3]}}, "dedicated group 3"),
    ({"tenant_affinity": {"enabled": True, "static_map": {"t": 1}}}, "tenant t"),
    ({"shadow": {"enabled": True, "targets": [{"name": "s", "sample_rate": 0}]}}, "sample_rate"),
    ({"shard": 3}, "no such setting: shard"),
    ({"server": {"ports": 3}}, "no such setting: server.ports"),
    ({"shards": "many"}, "shards: not a int"),
]


@pytest.mark.parametrize(("given", "says"), RULES)
def test_rules_of_configurations(given, says):
    with pytest.raises(config.ConfigError, match=says):
        config.from_mapping(given, {})


def test_layers_of_configurations(tmp_path):
    assert config.load(environment={}) == config.Config()
    (tmp_path / "c.json").write_text('{"shards": 16, "nodes": [{"id": "n1"}], "task_store": {"path": "/x"}}')
    c = config.load(str(tmp_path / "c.json"), {"QUILLON_SHARDS": "32", "QUILLON_TASK_STORE__BACKEND": "local", "QUILLON_REPLICATION_FACTOR": "1", "OTHER": "9"})
    assert (c.shards, c.task_store, c.nodes) == (32, config.Store("local", "/x"), [config.Node("n1")])
    assert config.from_mapping(config.to_mapping(c), {}) == c
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("shards: 8\nshadow:\n  targets:\n    - name: s\n")
    assert config.load(str(tmp_path / "c.yaml"), {}).shadow.targets == [config.ShadowTarget("s")]


def test_control_store(spark, tmp_path):
    store = open_store(spark, config.from_mapping({"task_store": {"path": str(tmp_path)}}, {}))
    assert isinstance(store, ControlStore) and store.read("aliases").count() == 0 and store.delete("aliases", F.lit(True)) == 0
    rows = spark.createDataFrame([("node-1", "a", 1), ("node-2", "a", 1)], "node_id string, index_uid string, version long")
    store.put("node_settings_version", rows)
    store.put("node_settings_version", rows.where("node_id = 'node-1'").withColumn("version", F.lit(2)))
    now = {(r.index_uid, r.node_id): (r.version, r.updated_at) for r in store.read("node_settings_version").collect()}
    assert now == {("a", "node-1"): (2, None), ("a", "node-2"): (1, None)}
    first = store.generations("node_settings_version")[0]
    assert {r.version for r in store.read("node_settings_version", first).collect()} == {1}
    store.put("canary_runs", spark.createDataFrame([("c", 1, "pass"), ("c", 2, "fail")], "canary_id string, ran_at long, status string"))
    assert control.canary_history(store.read("canary_runs"), 5).first().rate == 0.5
    for name, (_, schema) in control.TABLES.items():
        store.put(name, spark.createDataFrame([], schema))
    with pytest.raises(KeyError):
        store.read("nothing")


def test_index_life_cycle(spark, tmp_path):
    ix = Index(spark, str(tmp_path), "a", "id", 4).create("key", {"stopWords": ["the"]})
    with pytest.raises(IndexError_):
        Index(spark, str(tmp_path), "a").create()
    assert ix.read() is None and ix.settings() == {"stopWords": ["the"]}
    ix.upsert(spark.createDataFrame([(1, "x")], "key long, _id string"))
    g = ix.update_settings(stopWords=None, synonyms={"a": ["b"]})
    assert ix.settings() == {"synonyms": {"a": ["b"]}} and ix.settings(g - 1) == {"stopWords": ["the"]} and ix.get("1 ").first()._id == "x"
    for bad in ("_new", "_shard"):
        with pytest.raises(IndexError_):
            ix.upsert(spark.createDataFrame([(1, "x")], f"key long, {bad} string"))
    assert ix.delete_index() and not ix.delete_index() and ix.generations() == []


def test_search_from_postings_equals_a_scan(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "thing thing", None, None, 11)], docs.schema))
    ix = Index(spark, str(tmp_path), "docs", "doc_id", 4, "text")
    ix.upsert(docs)
    ix.upsert(docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" thing"))))
    ix.delete([5, -2])
    R = search.SearchRequest
    for r in (R("thing", attributes=["doc_id"], limit=500, show_score=True), R("the que", "n_chars > 400 AND lang = 'fr'", limit=30, show_score=True), R("that thing", sort=["n_chars:asc"], attributes=["doc_id", "n_chars"]), R("thing", 'doc_id IN [-3, 3, "9"]', attributes=["doc_id"]), R("thing", threshold=0.5, attributes=["doc_id"], limit=500), R("", limit=3, attributes=["doc_id"]), R("nowhereatall", attributes=["doc_id"])):
        got, want = (sorted([(*[round(v, 9) if isinstance(v, float) else v for v in x],) for x in df.collect()], key=str) for df in (ix.search(r).select(*sorted(ix.search(r).columns)), search.search(ix.read(), r).select(*sorted(ix.search(r).columns))))
        assert got == want, r
    plan = ix.search(R("thing", attributes=["doc_id"]))._jdf.queryExecution().toString()
    assert "EqualTo(term,thing)" in plan and "text" not in plan.split("Physical")[1]


def test_terms_are_counted_where_a_document_is_read(spark, monkeypatch):
    monkeypatch.setattr(text, "COUNTED_TOKENS", 4)  # batches are cut
    texts = [None, "", " .,-", "a", "--b a b--", "Été ÉTÉ x1 1x １２ ß", "z " * 50, "tab\tnew\nline\u00a0a", "漢字 и и 😀 a😀a", "İ i̇ a"]
    docs = spark.createDataFrame([(str(i), t, i % 3) for i, t in enumerate(texts)], "k string, t string, s int").coalesce(1)
    found = text.postings(docs, "k", "t")
    assert "Exchange" not in found._jdf.queryExecution().toString() and found.columns == ["k", "s", "term", "tf", "dl"]
    cut = docs.select("k", "s", text.tokens("t").alias("w")).collect()
    want = sorted((r.k, r.s, t, n, len(r.w)) for r in cut for t, n in collections.Counter(r.w).items())
    assert sorted(map(tuple, found.collect())) == want and len(want) == 18


def test_an_update_counts_the_terms_of_its_own_documents_only(spark, tmp_path, monkeypatch):
    counted, schema = [], "id long, t string, u string"
    monkeypatch.setattr(index, "postings", lambda d, *a: (counted.append(d.count()), text.postings(d, *a))[1])
    ix, R = Index(spark, str(tmp_path), "a", "id", 2, "t"), search.SearchRequest
    rows = lambda *r: spark.createDataFrame([*r], schema)

    def same(q, ix=ix):
        r = R(q, attributes=["id"], limit=99, show_score=True)
        got, want = ([(x.id, round(x.score, 9)) for x in df.collect()] for df in (ix.search(r), search.search(ix.read(), r, "id", ix.text)))
        assert got == want
        return len(got)

    ix.upsert(rows(*[(i, " ", "y") for i in range(40)]))  # no words at all
    assert same("x") == 0
    ix.upsert(rows(*[(i, "x y", "y") for i in range(40)]))
    ix.upsert(rows((1, "z", "y"), (2, "x x", "y"), (50, "x", "y"), (50, "x", None), (3, None, "y")))
    assert counted == [40, 40, 4] and same("x") == 39 and same("z y") == 38
    ix.upsert(rows((4, None, "y z")), partial=True)
    assert counted[-1] == 1 and same("x") == 39
    ix.update_settings(a=1)
    ix.delete([5])
    ix.upsert(rows((6, "w", "y")))
    assert counted[-2] > 9 and counted[-1] == 1 and same("x") == 37 and same("w") == 1 and ix.settings() == {"a": 1}
    monkeypatch.setattr(index, "BROADCAST_KEYS", 1)
    ix.upsert(rows((7, "w", "y"), (8, "w", "y")))
    assert counted[-1] > 9 and same("w x") == 38
    other = Index(spark, str(tmp_path), "a", "id", 2, "u")  # another field: what is kept is not of it
    other.upsert(rows(*[(i, "x", "v") for i in range(9)]))
    monkeypatch.setattr(index, "BROADCAST_KEYS", 99)
    other.upsert(rows((1, "x", "v v")))
    assert counted[-2:] == [41, 1] and same("v", other) == 9 and same("y", other) == 32


def test_whole_rows_are_dealt_by_key_only_where_keys_repeat(spark, tmp_path, monkeypatch):
    dealt, latest = [], index.latest
    monkeypatch.setattr(index, "latest", lambda *a: (dealt.append(1), latest(*a))[1])
    ix = Index(spark, str(tmp_path), "a", "id", 2)
    ix.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    assert not dealt
    ix.upsert(spark.createDataFrame([(1, "c"), (1, "d"), (3, "e")], "id long, v string"))
    assert dealt and sorted((r.id, r.v) for r in ix.read().collect()) == [(1, "d"), (2, "b"), (3, "e")]


def test_reshard_compares_before_it_swaps(spark, tmp_path):
    ix, store = Index(spark, str(tmp_path), "docs", "id", 2), ControlStore(spark, str(tmp_path / "control"), 1)
    ix.upsert(spark.createDataFrame([(i, f"t{i}", {"k": i}) for i in range(30)], "id long, t string, m map<string,int>"))
    store.put("aliases", spark.createDataFrame([("live", "single", "docs", 1, None), ("all", "multi", None, 1, ["docs"])], "name string, kind string, current_uid string, version long, target_uids array<string>"))
    shadow = reshard.backfill(ix, 8)
    ix.upsert(spark.createDataFrame([(3, "new", {"k": 9})], "id long, t string, m map<string,int>"))
    ix.delete([4])
    assert sorted((r.pk, r.kind) for r in reshard.differences(ix, shadow).collect()) == [("3", "changed"), ("4", "extra")]
    with pytest.raises(IndexError_):
        reshard.swap(store, "live", ix, shadow, 7)
    shadow = reshard.backfill(ix, 8)
    reshard.swap(store, "live", ix, shadow, 7)
    row = store.read("aliases").where("name = 'live'").first()
    assert (row.current_uid, row.version, [tuple(h) for h in row.history]) == ("docs__reshard_8", 2, [("docs", 7)]) and shadow.read().count() == 29
    with pytest.raises(ValueError, match="several"):
        control.flip(store.read("aliases"), "all", "x", 1)


def test_a_failing_node_rolls_settings_back(spark):
    rows = [("a", 1, "old", True), ("b", 2, None, True), ("c", 3, "old", None), ("d", 4, "old", True)]
    df = lambda r: spark.createDataFrame(r, "node_id string, pos int, held string, ok boolean")
    assert sorted(map(tuple, settings.apply_in_turn(df(rows), "new").collect())) == [("a", "rolled back", "old"), ("b", "rolled back", None), ("c", "failed", "old"), ("d", "not asked", "old")]
    assert {tuple(r)[1:] for r in settings.apply_in_turn(df(rows).where("ok"), "new").collect()} == {("applied", "new")}
    assert settings.apply_in_turn(df([]), "new").count() == 0


def test_verdicts_on_proposals(spark):
    proposed = spark.createDataFrame([("same", "{}", 1, 0), ("differs", '{"a":1}', 1, 0), ("tired", '{"a":1}', 1, 3), ("silent", "{}", 1, 0)], "index_uid string, settings string, version int, attempts int")
    actual = spark.createDataFrame([("same", "n", "{ }"), ("differs", "n", '{"a":1}'), ("differs", "m", None), ("tired", "n", '{"a":2}')], "index_uid string, node_id string, settings string")
    got = {r.index_uid: (r.verdict, r.version, r.differing) for r in settings.verify(actual, proposed).collect()}
    assert got == {"same": ("commit", 2, []), "differs": ("repair", 1, ["m"]), "tired": ("freeze", 1, ["n"]), "silent": ("repair", 1, [])}


def test_groups(spark):
    rows = [(f"n{g}{i}", g, "active" if g < 2 else "joining") for g in range(3) for i in range(3)]
    nodes = topology.nodes_frame(spark, [("n00", 0, "failed"), *rows[1:]])
    a = topology.assignment(nodes, 16, 2)
    plan = topology.add_group(nodes, a, 2, 16, 2).collect()
    assert len(plan) == 32 and all(r.source not in (None, "n00") and r.target.startswith("n2") for r in plan)
    copies = spark.createDataFrame([(2, 0, True), (2, 1, False), (3, 0, True), (4, 0, None)], "replica_group int, shard int, done boolean")
    assert {r.replica_group: r.state for r in topology.group_states(copies).collect()} == {2: "initializing", 3: "active", 4: "initializing"}
    assert topology.covering_set(topology.without_group(a, 0), 0).where("node_id LIKE 'n0%'").count() == 0


def test_policies_and_merges(spark):
    pages = spark.createDataFrame([(0, True), (3, False)], "shard int, success boolean")
    assert search.apply_policy(pages).count() == 1
    with pytest.raises(RuntimeError, match="3"):
        search.apply_policy(pages, "error")
    assert search.apply_policy(pages.where("success"), "error").count() == 1
    lists = [spark.createDataFrame(r, "id string, score double") for r in ([("a", 1.0), ("b", 3.0)], [("b", 10.0), ("c", 20.0)])]
    of = lambda s: {r.id: round(r.score, 4) for r in search.merge(lists, "id", s).collect()}
    assert of("score") == {"a": 1, "b": 10, "c": 20} and of("minmax") == {"a": 0, "b": 1, "c": 1}
    assert of("rrf") == {"a": round(1 / 62, 4), "b": round(1 / 61 + 1 / 62, 4), "c": round(1 / 61, 4)} and of("convex") == {"a": 0.5, "b": 6.5, "c": 10}
    with pytest.raises(ValueError, match="no such merge"):
        search.merge(lists, "id", "best")


def test_retry_cache_equals_a_loop(spark):
    import random

    r = random.Random(3)
    rows = [(f"k{r.randrange(4)}", at(r.randrange(600)), r.choice([200, 202, 404, 503]), i) for i in range(200)]
    got = {x.i for x in control.retry_cache(spark.createDataFrame(rows, "key string, ts timestamp, status int, i int")).where("cached").collect()}
    want, filled = set(), {}
    for k, t, status, i in sorted(rows, key=lambda x: x[1]):
        if k in filled and filled[k] < t and (t - filled[k]).total_seconds() < 60:
            want.add(i)
        elif 200 <= status < 300 and filled.get(k) != t:
            filled[k] = t
    assert got == want and 0 < len(want) < 200


def test_health_equals_a_loop(spark):
    import random

    r = random.Random(5)
    rows, second = [], 0
    for i in range(600):
        second += r.choice([0, 1, 20, 59, 61, 400])
        rows.append((r.choice("ab"), at(second), i, r.choice([True, True, False, False, None])))
    for fails, passes in ((3, 2), (1, 1), (2, 4)):
        got = monitor.health(spark.createDataFrame(rows, "node string, ts timestamp, i int, ok boolean"), "node", ["ts", "i"], F.col("ok"), fails, passes)
        want = []
        for n in "ab":
            state, run, last = "healthy", 0, None
            for _, _, i, ok in (x for x in rows if x[0] == n):
                run = run + 1 if ok is not None and ok == last else 1
                last = ok
                says = "unhealthy" if ok is False and run == fails else "healthy" if ok and run == passes else None
                if says and says != state:
                    state = says
                    want.append((n, i, says))
        assert sorted((x.node, x.i, x.state) for x in got.collect()) == sorted(want)


def test_sessions_are_pinned_to_the_first_quorum(spark):
    writes = spark.createDataFrame([("s", "t0", at(0)), ("s", "t1", at(10)), ("tie", "t2", at(10)), ("down", "t3", at(10)), ("none", "t4", at(10)), ("old", "t5", at(-2000))], "session_id string, task_id string, ts timestamp")
    acks = [("t0", 0, "a", 1), ("t0", 0, "b", 2), ("t1", 0, "a", 11), ("t1", 1, "c", 12), ("t1", 1, "d", 13), ("t1", 0, "b", 14), ("t1", 0, "a", 12), *[("t2", g, n, 11) for g in (1, 0) for n in "ab"], ("t3", 2, "x", 11), ("t3", 2, "y", 11), ("t4", 0, "a", 11)]
    acks = spark.createDataFrame([(t, g, n, at(s)) for t, g, n, s in acks], "task_id string, replica_group int, node_id string, ts timestamp")
    got = cdc.session_pins(writes, acks, spark.createDataFrame([(2,)], "replica_group int"), 2, F.lit(at(100)).cast("timestamp"))
    assert {r.session_id: (r.task_id, r.pinned_group) for r in got.collect()} == {"s": ("t1", 1), "tie": ("t2", 0), "down": ("t3", None), "none": ("t4", None)}


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    schema = "event_id string, ts timestamp, origin string"
    paths = [str(tmp_path / x) for x in ("in", "log", "checkpoint")]
    put = lambda ids: spark.createDataFrame([(i, at(n), None) for n, i in enumerate(ids)], schema).coalesce(1).write.mode("append").parquet(paths[0])
    put(["a", "b"])
    with monkeypatch.context() as m:
        m.setattr(cdc, "deduplicate", lambda stream, *_: stream.where(F.assert_true(F.lit(False), F.lit("lost")).isNull()))
        with pytest.raises(Exception, match="lost"):
            cdc.change_stream(spark, schema, *paths)
    put(["b", "c"])
    assert sorted(r.event_id for r in cdc.change_stream(spark, schema, *paths[:2], str(tmp_path / "again")).collect()) == ["a", "b", "c"]
    put(["c", "d", "a"])
    assert sorted(r.event_id for r in cdc.change_stream(spark, schema, *paths[:2], str(tmp_path / "again")).collect()) == ["a", "b", "c", "d"]


def test_stragglers_and_schedules(spark):
    rows = spark.createDataFrame([(1, at(0)), (2, at(10)), (3, None)], "id int, ts timestamp")
    fine, late = cdc.late(rows, "ts", F.lit(at(5)).cast("timestamp"))
    assert [r.id for r in fine.collect()] == [2] and sorted(r.id for r in late.collect()) == [1, 3]
    jobs = spark.createDataFrame([("a", 60, at(0)), ("b", 60, at(50)), ("c", 60, None)], "name string, every_s int, last_run timestamp")
    got = {r.name: (r.due, r.next_run) for r in monitor.due(jobs, F.lit(at(60)).cast("timestamp")).collect()}
    assert got == {"a": (True, at(60)), "b": (False, at(110)), "c": (True, at(60))}


def test_terms(spark):
    assert text.expanded(["the"], {"the": ["le"]}, {"the"}) == [["the", "le"]] and text.expanded(["the", "cat"], None, {"the"}) == [["cat"]]
    assert text.query_terms("Ünder_the 2 ¿Çà?") == ["2", "the", "çà", "ünder"]
    v = spark.createDataFrame([(t,) for t in ("under", "unter", "undr", "wonder", "understanding", "und", "misunderstood", "cat", "cut")], "term string")
    got = {(r.asked, r.term, r.edits) for r in text.matching_terms(v, ["cat", "under"]).collect()}
    assert got == {("cat", "cat", 0), ("under", "under", 0), ("under", "unter", 1), ("under", "undr", 1), ("under", "understanding", 0)}
    assert {r.term for r in text.matching_terms(v, ["under"], prefix_last=False).collect()} == {"under", "unter", "undr"}


def test_small_values(spark):
    df = spark.createDataFrame([('{"a": {"b": 2}}', {"x": 1}), ("no json", None)], "j string, m map<string,bigint>")
    got = df.select(columns.json_number(F.col("j"), "$.a.b", -1).alias("n"), columns.json_text(F.col("j"), "$.a").alias("t"), columns.merge_counts(F.col("m"), F.create_map(F.lit("x"), F.lit(2).cast("bigint"), F.lit("y"), F.lit(3).cast("bigint"))).alias("m")).collect()
    assert [(r.n, r.t, r.m) for r in got] == [(2.0, '{"b":2}', {"x": 3, "y": 3}), (-1.0, "", {"x": 2, "y": 3})]
    r = spark.createDataFrame([("c", 3, "a", 9, ["a", "b"], 120.0, 5)], "name string, hits long, first_id string, millis long, top array<string>, p95_ms double, settings_version long")
    a = spark.createDataFrame([("c", "max_p95_ms", "100", None), ("c", "settings_version_at_least", "5", None), ("c", "must_not_contain_id", None, ["b"])], "name string, kind string, value string, ids array<string>")
    assert {x.kind: x.passed for x in monitor.canary(r, a).collect()} == {"max_p95_ms": False, "settings_version_at_least": True, "must_not_contain_id": False}
