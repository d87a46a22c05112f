import datetime
import random

import pytest
from pyspark.sql import functions as F
from quillon.functions.columns import parse_window, seconds_of
from quillon.functions.hashing import _xxh64_arrow, shard_md5, shard_xxh64, xxh64
from quillon.operators import migration, ranking, repair, search, topology
from quillon.operators.search import SearchRequest
from quillon.operators.text import highlight, match_positions
from quillon.plans.filters import FilterError, keys_of, parse
from quillon.plans.planner import plan, shard_of
from quillon.sources import control
from quillon.sources.index import Index, IndexError_, analyse_dump
from quillon.streaming import cdc, monitor


def test_hash_fixtures(spark):
    rows = [("user:12345", 64, 15), ("product:abc", 64, 24), ("order:99999", 64, 4), ("test", 16, 10), ("hello", 32, 6)]
    df = spark.createDataFrame(rows, "key string, n int, want int")
    for n in (64, 16, 32):
        part = df.where(f"n = {n}")
        assert [r.got for r in part.select(shard_xxh64("key", part, n).alias("got")).collect()] == [w for _, m, w in rows if m == n]
    assert all(shard_of(k, n, "xxh64") == w for k, n, w in rows)
    binary = F.col("key").cast("binary")
    assert [tuple(r) for r in df.select(xxh64(binary, df)).collect()] == [tuple(r) for r in df.select(_xxh64_arrow(binary)).collect()]
    assert [r[0] for r in df.select(shard_md5("key")).collect()] == [shard_of(k) for k, *_ in rows]


def test_fidelity_placement(spark):
    nodes = topology.nodes_frame(spark, [(f"node{i}", 0, "active") for i in (1, 2, 3)])
    a = topology.assignment(nodes, 64, 1, "xxh64")
    counts = {r.node_id: r["count"] for r in a.groupBy("node_id").count().collect()}
    assert sorted(counts.values()) == [15, 22, 27]
    four = topology.nodes_frame(spark, [(f"node{i}", 0, "active") for i in (1, 2, 3, 4)])
    assert topology.moves(a, topology.assignment(four, 64, 1, "xxh64")).count() == 30


def test_every_shard_is_covered_once(spark):
    nodes = topology.nodes_frame(spark, [(f"n{g}{i}", g, "active") for g in range(3) for i in range(4)])
    a = topology.assignment(nodes, 64, 3).cache()
    assert a.count() == 64 * 3 * 3
    for seq in range(5):
        c = topology.covering_set(a, seq)
        assert c.count() == c.select("shard").distinct().count() == 64


@pytest.mark.parametrize(
    ("text", "keys"),
    [('id = "x"', ["x"]), ('id IN ["a", "b", "a"]', ["a", "b"]), ('id = "x" AND c = "books"', ["x"]), ('id = "x" OR c = 1', None), ('NOT id = "x"', None), ('user_id = "x"', None), ('id = "a OR b"', ["a OR b"]), ("", None), ('id IN ["a", "b"] AND id = "b"', ["b"]), ('id NOT IN ["a"]', None)],
)
def test_keys_of_filters(text, keys):
    assert keys_of(parse(text), "id") == keys


@pytest.mark.parametrize("text", ["id =", "AND", "(a = 1", "a ! 2", "a IN [1", "a = 1 b", "a 1 TO"])
def test_bad_filters(text):
    with pytest.raises(FilterError):
        parse(text)


def test_narrowed_is_the_same_as_full(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_shard", shard_md5("doc_id"))
    p = plan("doc_id IN [1, 2, 3, 150] AND n_chars > 10", "doc_id")
    assert p.narrowed and not plan("doc_id IN [1, 2]", "doc_id", most_keys=1).narrowed
    ids = lambda c: {r.doc_id for r in docs.where(c).collect()}
    assert ids(p.condition()) == ids(p.predicate)


KEYS = [0, 1, -1, 7, 42, 43, 1 << 31, -(1 << 31), (1 << 53) + 1, (1 << 63) - 1, -(1 << 63)]


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "double"])
def test_narrowed_is_the_same_as_full_for_any_literal(spark, kind):
    r = random.Random(kind)
    keys = [f"{k}" for k in KEYS] + ["042", "42 ", " 42", "+42", "42.0", "x", "", "é"] if kind == "string" else [k for k in KEYS if kind != "int" or -(1 << 31) <= k < 1 << 31]
    rows = spark.createDataFrame([(k if kind != "double" else float(k),) for k in keys], f"id {kind}").withColumn("_shard", shard_md5("id")).cache()
    texts = ["042", "42 ", " 42", "+42", "42", "-1", "007", "\t7", "9223372036854775807", "-0"] + (["x", "", "é", "42.0"] if kind == "string" else [])
    numbers = ["42", "42.0", "42.5", "-0", "0.0", "1e0", "4.2e1", "2147483648", "9007199254740993", "9007199254740992.0", "9223372036854775807", "-1.0"]
    number = lambda: r.choice(numbers if kind != "string" else ["42", "7"])
    literal = lambda: f'"{r.choice(texts)}"' if r.random() < 0.5 or kind == "string" else number()
    one = lambda: f"id = {literal()}"
    several = lambda: "id IN [" + ", ".join(f'"{r.choice(texts)}"' if kind == "string" or k else number() for k in [r.random() < 0.5] * r.randrange(1, 4)) + "]"
    narrowed = 0
    for _ in range(60):
        f = r.choice([one, several, lambda: f"{one()} AND {several()}", lambda: f"{one()} OR {one()}", lambda: f"NOT {one()}", lambda: f"({one()} OR {one()}) AND {several()}"])()
        p = plan(f, "id", key_type=kind)
        narrowed += p.narrowed
        assert sorted(x.id for x in rows.where(p.condition()).collect()) == sorted(x.id for x in rows.where(p.predicate).collect()), f
    assert narrowed > 10 or kind == "double"


def test_pages_join_to_the_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = [r.doc_id for r in search.search(docs, SearchRequest("the de", limit=60, attributes=["doc_id"])).collect()]
    parts = [r.doc_id for o in range(0, 60, 13) for r in search.search(docs, SearchRequest("the de", offset=o, limit=13, attributes=["doc_id"])).collect()]
    assert parts[:60] == whole and len(set(whole)) == len(whole)


def test_plan_shapes(spark, sf, tmp_path):
    index = Index(spark, str(tmp_path), "docs", "doc_id")
    index.upsert(spark.read.parquet(f"{sf}/documents.parquet"))
    df = search.search(index.read(), SearchRequest("", 'doc_id = 7 AND lang = "en"', attributes=["doc_id"]), "doc_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "PartitionFilters: [" in text and "EqualTo(lang,en)" in text
    assert "text" not in text.split("ReadSchema")[1]


def test_merge_ties_and_sums(spark):
    page = spark.createDataFrame([(True, [("zebra", 0.5), ("apple", 0.5)], 2, 5), (True, [("banana", 0.5), ("apple", 0.5)], 2, 9), (False, [("lost", 1.0)], 9, 99)], "success boolean, hits array<struct<pk: string, score: double>>, total long, millis long")
    assert [r.pk for r in search.merge_pages(page, 0, 10).collect()] == ["apple", "banana", "zebra"]
    assert tuple(search.merge_summary(page).first()) == (4, 9, True)
    counts = spark.createDataFrame([("color", "red", 17), ("color", "blue", 5)], "facet string, value string, n long")
    assert search.facet_map(counts).first().distribution == {"blue": 5, "red": 17}


def test_rank_statistics(spark):
    order = lambda xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "id int, pos int")
    tau = lambda a, b: ranking.kendall_tau(order(a), order(b), "id").first().tau
    assert tau([1, 2, 3, 4, 5], [1, 2, 3, 4, 5]) == 1 and tau([1, 2, 3, 4, 5], [5, 4, 3, 2, 1]) == -1 and tau([1, 2, 3, 4, 5], [1, 3, 2, 4, 5]) == pytest.approx(0.8)
    assert ranking.jaccard(order([1, 2, 3, 4]), order([3, 4, 5, 6]), "id").first().jaccard == pytest.approx(1 / 3)
    assert ranking.divergence(order([1, 2, 3]), order([1, 3, 2]), "id", 3).first().position == 1


def test_index_life(spark, tmp_path):
    ix = Index(spark, str(tmp_path), "a", "id", 8)
    rows = [(f"doc-{i:05d}", f"t{i}", i) for i in range(200)]
    ix.upsert(spark.createDataFrame(rows, "id string, title string, value int"))
    assert ix.read().count() == 200 and ix.get("doc-00042").first().value == 42
    ix.upsert(spark.createDataFrame([("doc-00042", "new", -1), ("x", "y", 3)], "id string, title string, value int"))
    assert ix.read().count() == 201 and ix.get("doc-00042").first().title == "new"
    ix.upsert(spark.createDataFrame([("doc-00042", 7)], "id string, value int"), partial=True)
    assert tuple(ix.get("doc-00042").select("title", "value").first()) == ("new", 7)
    ix.delete(["x", "doc-00000"])
    ix.delete_where(F.col("value") >= 100)
    assert ix.read().count() == 99 and ix.read(1).count() == 200  # an old generation can still be read
    assert [r.id for r in ix.browse(1, 2).collect()] == ["doc-00002", "doc-00003"]
    ix.dump(str(tmp_path / "dump"))
    other = Index(spark, str(tmp_path), "b", "id", 8)
    other.load_dump(str(tmp_path / "dump"))
    assert other.read().count() == 99
    assert tuple(analyse_dump(spark, str(tmp_path / "dump"), "id").first()) == (99, 0, 0)
    with pytest.raises(IndexError_):
        ix.upsert(spark.createDataFrame([("a", 1)], "id string, _shard int"))
    with pytest.raises(IndexError_):
        ix.upsert(spark.createDataFrame([(None, 1)], "id string, value int"))


def test_index_writes_survive_a_crash(spark, tmp_path, monkeypatch):
    ix, schema = Index(spark, str(tmp_path), "a", "id", 4), "id string, v string, n int, m map<string,int>"
    ix.upsert(spark.createDataFrame([("x", "a", 1, None)], schema))
    with monkeypatch.context() as m:
        m.setattr(Index, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            ix.upsert(spark.createDataFrame([("x", "b", 1, None)], schema))
    assert ix.get("x").first().v == "a"
    assert ix.upsert(spark.createDataFrame([("x", "m", 3, None), ("x", "z", 1, {"k": 1}), ("x", "z", 2, None), ("x", "a", 9, None)], schema)) == 3
    assert tuple(ix.get("x").select("v", "n").first()) == ("z", 2)
    assert ix.vacuum() == [2] and ix.read().count() == 1 and ix.read(1).first().v == "a"
    assert ix.vacuum(keep=1) == [1] and ix.generations() == [3] and ix.read().count() == 1
    with pytest.raises(IndexError_):
        ix._publish(3, {})
    ix.delete(["x"])
    assert ix.read() is None
    assert ix.upsert(spark.createDataFrame([("y", "a", 1, None)], schema)) == 5 and ix.read().count() == 1


def test_highlights_and_positions(spark):
    df = spark.createDataFrame([("C++ and c++, not xc++ $1",), ("the cat, The",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(highlight("text", "c++", "<$>", "</$>")).collect()] == ["<$>C++</$> and <$>c++</$>, not xc++ $1", "the cat, The", "", None]
    got = [r[0] for r in df.select(match_positions("text", "the")).collect()]
    assert got[:3] == [[], [(0, 3), (9, 3)], []] and not got[3]
    assert [tuple(x) for x in df.select(match_positions("text", "c++")).first()[0]] == [(0, 3), (8, 3)]


def test_content_hashes_differ(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "a"), ("", "a"), ("a", None)], "x string, y string")
    assert len({r[0] for r in df.select(repair.content_hash(F.col("x"), F.col("y"))).collect()}) == 5


def test_drift_sees_values_only(spark):
    rows = [("same", '{"a":1,"b":{"d":[1,2],"c":null}}'), ("same", ' {"b": {"c": null, "d": [1, 2]}, "a": 1}'), ("order", '{"a":[1,2]}'), ("order", '{"a":[2,1]}'), ("bad", "{"), ("bad", "{")]
    got = {r.index_uid: r.drifted for r in control.settings_drift(spark.createDataFrame(rows, "index_uid string, settings string")).collect()}
    assert got == {"same": False, "order": True, "bad": False}


def test_repair_is_idempotent(spark):
    r = random.Random(1)
    rows = [(f"r{k}", i % 4, str(i), str(r.randrange(3)), r.randrange(5), r.choice([None, 1, 99]), k) for i in range(60) for k in range(3) if r.random() < 0.8]
    copies = spark.createDataFrame(rows, "replica string, shard int, pk string, content_hash string, updated_at long, expires_at long, node_task_uid long")
    best = {x.pk: x for x in repair.winners(copies, 50).collect()}
    after = [(f"r{k}", int(p) % 4, p, x.content_hash, 9, None, k) for p, x in best.items() if x.action == "keep" for k in range(3)]
    fixed = spark.createDataFrame(after, copies.schema)
    assert repair.repairs(fixed, 50).count() == 0 and repair.differing(repair.fingerprints(fixed)).count() == 0
    assert repair.differing(repair.fingerprints(copies)).count() > 0


def test_cutover(spark):
    rows = [(i, i % 3, "old", True) for i in range(2100)] + [(i, i % 3, "new", i < 1000 or i % 50 != 0) for i in range(2100)]
    writes = spark.createDataFrame(rows, "doc_id long, shard int, side string, ok boolean")
    lost = migration.delta(writes)
    assert lost.count() == 22
    copied = writes.union(lost.select("doc_id", "shard", F.lit("new"), F.lit(True)))
    assert migration.loss(copied).first().lost == 0
    with pytest.raises(migration.IllegalStep):
        migration.Migration(skip_delta=True, anti_entropy=False).step("dual_write_migrating")
    m = migration.Migration().step("dual_write_migrating").shard(1, "migrating")
    with pytest.raises(migration.IllegalStep):
        m.step("cutover_begin")
    done = m.shard(1, "migration_complete").step("cutover_begin")
    assert done.phase == "cutover_begin" and done.fail("lost").phase == "failed" and done.fail("lost").reason == "lost"
    for illegal in (lambda: done.fail("x").step("cutover_draining"), lambda: done.fail("x").fail("y"), lambda: m.shard(1, "failed").shard(1, "active"), lambda: done.shard(1, "active").shard(1, "failed")):
        with pytest.raises(migration.IllegalStep):
            illegal()
    for skip in (False, True):
        m = migration.Migration(skip_delta=skip)
        for p in migration.PHASES[1:]:
            if not (skip and p == "cutover_delta_pass"):
                m = m.step(p)
        assert m.phase == "complete"
        with pytest.raises(migration.IllegalStep):
            m.fail("late")
    with pytest.raises(migration.IllegalStep):
        migration.reshard_step("swap", "idle")


def test_leases_and_reconciliation(spark):
    leases = spark.createDataFrame([("a", "me", 100)], control.TABLES["leader_lease"][1])
    held = lambda df: {r.scope: r.holder for r in df.collect()}
    assert held(control.acquire(leases, "a", "you", 50, 10)) == {"a": "me"}
    assert held(control.acquire(leases, "a", "you", 150, 10)) == {"a": "you"}
    assert control.acquire(leases, "a", "me", 50, 99).first().expires_at == 149
    tasks = spark.createDataFrame([("t", {"n1": 1, "n2": 2})], "task_id string, node_tasks map<string, long>")
    states = spark.createDataFrame([("n1", 1, "succeeded")], "node_id string, uid long, status string")
    assert control.reconcile(tasks, states).first().status == "enqueued"
    assert len(control.TABLES) == 14


def test_windows_and_durations():
    assert parse_window("22:00-06:00") == (1320, 360) and seconds_of("7d") == 604800 and seconds_of("48h") == 172800
    for bad in ("24:00-01:00", "1-2", "01:60-02:00", "x"):
        with pytest.raises(ValueError):
            parse_window(bad)


def test_ewma_equals_a_loop(spark):
    r = random.Random(2)
    at, rows = datetime.datetime(2024, 1, 1), []
    for _ in range(300):
        at += datetime.timedelta(seconds=r.choice([1, 30, 200, 4000]))
        rows.append((r.choice("ab"), at, r.random() * 100))
    got = {x.node: x.ewma for x in monitor.ewma(spark.createDataFrame(rows, "node string, ts timestamp, value double"), "node", "ts", "value", 60.0).collect()}
    for n in "ab":
        s, last = None, None
        for _, t, v in (x for x in rows if x[0] == n):
            a = 1 if s is None else 1 - 0.5 ** ((t - last).total_seconds() / 60)
            s, last = (v if s is None else s * (1 - a) + v * a), t
        assert got[n] == pytest.approx(s)


def test_stream_of_changes(spark, tmp_path):
    rows = [(f"e{i % 40}", i, datetime.datetime(2024, 1, 1, 0, 0, i % 60), "reshard" if i % 4 == 0 else None) for i in range(50)]
    spark.createDataFrame(rows, "event_id string, seq long, ts timestamp, origin string").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id string, seq long, ts timestamp, origin string").parquet(str(tmp_path / "in"))
    q = cdc.to_log(cdc.deduplicate(cdc.suppress(stream), "event_id", "ts", "1 hour"), str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    got = [r.event_id for r in spark.read.parquet(str(tmp_path / "log")).collect()]
    assert sorted(got) == sorted({e for e, _, _, o in rows if o is None})
    windows = cdc.rate_windows(spark.readStream.schema("event_id string, seq long, ts timestamp, origin string").parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute"), "ts", "event_id", "1 minute", 1)
    q = windows.writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rates").where("limited").count() == 10


def test_canaries(spark):
    r = spark.createDataFrame([("c", 3, "a", 9, ["a", "b"])], "name string, hits long, first_id string, millis long, top array<string>")
    a = spark.createDataFrame([("c", "min_hits", "2", None), ("c", "top_hit_id", "b", None), ("c", "top_k_contains", None, ["b"]), ("c", "max_latency_ms", "5", None), ("lost", "not_empty", None, None)], "name string, kind string, value string, ids array<string>")
    assert {x.kind: x.passed for x in monitor.canary(r, a).collect()} == {"min_hits": True, "top_hit_id": False, "top_k_contains": True, "max_latency_ms": False, "not_empty": False}


def test_ewma_keeps_all_for_long_half_lives(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [("a", day + datetime.timedelta(hours=i), float(i % 7) if i > 100 else 1000.0) for i in range(500)]
    half, want = 30 * 86400.0, rows[0][2]
    for (_, before, _), (_, ts, v) in zip(rows, rows[1:], strict=False):
        d = 0.5 ** ((ts - before).total_seconds() / half)
        want = d * want + (1 - d) * v
    got = monitor.ewma(spark.createDataFrame(rows, "node string, ts timestamp, value double"), "node", "ts", "value", half).first().ewma
    assert got == pytest.approx(want)
