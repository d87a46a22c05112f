"""Indexes as generation-versioned Parquet, partitioned by shard.

Layout: ``<root>/<uid>/gen=<n>/_shard=<k>/*.parquet`` and ``<root>/<uid>/manifest/gen=<n>.json``, which says for each shard in which
generation its files are. A write rewrites only the shards it touches, into a new generation; the manifest makes
it visible at once, and an older manifest is a rollback. One writer at a time: of two, the one whose manifest
is there first wins and the other fails. A write that dies before its manifest leaves a folder that nothing reads; later
writes pass over its number, and ``vacuum`` removes it.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.hashing import SHARDS, shard_md5
from quillon.operators.search import SearchRequest, is_reserved, page, search, strip_reserved
from quillon.operators.text import B, K1, idf, postings, query_terms
from quillon.plans.planner import key_texts, plan, shard_of

#: Up to so many keys of a write are broadcast to the documents they replace; more go by shuffle.
BROADCAST_KEYS = 1_000_000
PK_GUESSES = ("id", "Id", "ID", "_id", "key", "Key", "pk", "doc_id")


class IndexError_(ValueError):
    """A write that an index refuses."""


def guess_pk(columns: list[str]) -> str:
    return next((x for x in PK_GUESSES if x in columns), "id")


def check_document_columns(df: DataFrame, pk: str) -> None:
    bad = [x for x in df.columns if is_reserved(x)]
    if bad:
        raise IndexError_(f"reserved fields: {', '.join(bad)}")
    if pk not in df.columns:
        raise IndexError_(f"no primary key: {pk}")


def latest(rows: DataFrame, pk: str, version: list[Column]) -> DataFrame:
    """One row a key: the greatest version."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(pk).orderBy(*[F.desc(v) for v in version]))).where("_n = 1").drop("_n")


def version_order(df: DataFrame, pk: str) -> list[Column]:
    """Every column but the key, as an order in which the last row of a key wins; columns without an order by their hash."""
    plain = lambda t: not any(w in t for w in ("map<", "variant", "interval"))
    return [F.col(x) if plain(t) else F.xxhash64(F.to_json(x)) for x, t in df.dtypes if x != pk]


def merge_fields(old: DataFrame, new: DataFrame, pk: str) -> DataFrame:
    """Partial update: fields that new has, and that are not null there, replace old ones; new keys are added."""
    o, n = old.alias("o"), new.alias("n")
    columns = [F.coalesce(F.col(f"n.{x}"), F.col(f"o.{x}")).alias(x) if x in old.columns and x in new.columns else F.col(f"{'n' if x in new.columns else 'o'}.{x}") for x in dict.fromkeys([*old.columns, *new.columns])]
    return o.join(n, F.col(f"o.{pk}") == F.col(f"n.{pk}"), "full_outer").select(*columns)


def delete_where(index: DataFrame, predicate: Column) -> DataFrame:
    """What is left; rows on which the predicate is unknown stay."""
    return index.where(~F.coalesce(predicate, F.lit(False)))


def _by_generation(held: dict[int, int]) -> dict[int, list[int]]:
    by: dict[int, list[int]] = {}
    for shard, g in held.items():
        by.setdefault(g, []).append(shard)
    return by


@dataclass
class Index:
    spark: SparkSession
    root: str
    uid: str
    pk: str = "id"
    shards: int = SHARDS
    #: The field that is searched: writes add its postings, in runs sorted by term, and sizes of the shards they touch.
    text: str | None = None

    def _path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), self.uid, *parts])

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path())
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        return sorted(int(n[4:-5]) for n in self._names("manifest") if n.endswith(".json"))

    def _names(self, *parts: str) -> list[str]:
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(*parts)), self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _folders(self) -> set[int]:
        return {int(n[4:]) for n in self._names() if n.startswith("gen=")}

    def vacuum(self, keep: int = 0) -> list[int]:
        """Remove folders that no manifest names, and with ``keep`` all but the last so many manifests. Returns the generations removed."""
        known, jvm, fs = self.generations(), self.spark._jvm, self._fs()
        for g in known[:-keep] if keep else []:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self._path("manifest", f"gen={g}.json")), False)
        used = {g for n in (known[-keep:] if keep else known) for g in self._manifest(n).values()}
        gone = sorted(self._folders() - used)
        for g in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self._path(f"gen={g}")), True)
        return gone

    def _manifest(self, generation: int | None = None) -> dict[int, int]:
        known = self.generations()
        if not known:
            return {}
        return {int(k): v for k, v in self._told(known[-1] if generation is None else generation)["shards"].items()}

    def _told(self, generation: int) -> dict:
        return json.loads(self.spark.read.text(self._path("manifest", f"gen={generation}.json"), wholetext=True).first()[0])

    def read(self, generation: int | None = None) -> DataFrame | None:
        """The index with _shard, a partition column; None before the first write."""
        held = self._manifest(generation)
        if not held:
            return None
        paths = [self._path(f"gen={g}", f"_shard={s}") for s, g in sorted(held.items())]
        # the base path of each generation, so that _shard comes from the directory
        by: dict[int, list[str]] = {}
        for p, (_, g) in zip(paths, sorted(held.items()), strict=True):
            by.setdefault(g, []).append(p)
        out = None
        for g, ps in sorted(by.items()):
            part = self.spark.read.option("basePath", self._path(f"gen={g}")).parquet(*ps)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out.withColumn("_shard", F.col("_shard").cast("int"))

    def _commit(self, rows: DataFrame, touched: list[int], written: DataFrame | None = None) -> int:
        """A generation with rows in the touched shards. written: keys, few enough to broadcast, outside of which no document of
        theirs differs from what the index holds, so that its postings are still right."""
        known = self.generations()
        told = self._told(known[-1]) if known else {"shards": {}}
        g = max([0, *self.generations(), *self._folders()]) + 1
        # rows by shard, large shards over several tasks and small ones together, as adaptive execution finds their sizes
        rows.hint("rebalance", "_shard").write.partitionBy("_shard").parquet(self._path(f"gen={g}"))
        left = {int(n[7:]) for n in self._names(f"gen={g}") if n.startswith("_shard=")}
        before = {int(s): old for s, old in told["shards"].items()}
        others, same = {s: old for s, old in before.items() if s not in touched}, told.get("text") == self.text
        if self.text and left:
            self._write_postings(g, {s: old for s, old in before.items() if s in touched} if same else {}, written)
        # the field whose postings all shards have
        text = self.text if same or not others else None
        self._publish(g, {"shards": others | {s: g for s in touched if s in left}, "pk": self.pk, "settings": told.get("settings", {}), "text": text})
        return g

    def _write_postings(self, g: int, held: dict[int, int], written: DataFrame | None) -> None:
        """Postings and sizes of a generation. Only the keys written get new postings, the rest keep those of the generations
        held; without keys, or where a key's type changes, all are new."""
        rows = self.spark.read.parquet(self._path(f"gen={g}")).select(F.col("_shard").cast("int").alias("_shard"), F.col(self.pk).alias("_key"), F.col(self.text).alias("_text"))
        kept = [self._postings_of(old, shards) for old, shards in _by_generation(held).items()] if written is not None else []
        if kept and len({t for x in (written.toDF("_key"), rows, *kept) for c, t in x.dtypes if c == "_key"}) == 1:
            keys = F.broadcast(written.toDF("_key"))
            old = functools.reduce(DataFrame.unionByName, kept).join(keys, "_key", "left_anti")
            listed = postings(rows.join(keys, "_key", "left_semi"), "_key", "_text").unionByName(old)
        else:
            listed = postings(rows, "_key", "_text")
        # neither shuffled nor sorted as a whole: in runs sorted by term, of whose pages a search reads those with its terms
        path = self._path(f"gen={g}", "_postings")
        listed.select("term", "_shard", "_key", "tf", "dl").write.parquet(path)
        words = self.spark.read.parquet(path).groupBy("_shard").agg(F.sum("tf").alias("words"))
        sizes = rows.groupBy("_shard").agg(F.count("*").alias("n")).join(F.broadcast(words), "_shard", "left")  # a row a shard
        sizes.select("_shard", "n", F.coalesce("words", F.lit(0)).cast("long").alias("words")).coalesce(1).write.parquet(self._path(f"gen={g}", "_sizes"))

    def search(self, r: SearchRequest) -> DataFrame:
        """A page of hits, as ``operators.search.search`` gives it over ``read()``, from postings: only those of the query's
        terms are read, and documents only for the filter, the order asked for and the attributes shown."""
        terms, held = query_terms(r.q), self._manifest()
        if not terms or not held or not self.text:
            return search(self.read(), r, self.pk, self.text or "text")
        by = _by_generation(held)
        found = [self._postings_of(g, shards) for g, shards in by.items()]
        sizes = [self.spark.read.parquet(self._path(f"gen={g}", "_sizes")).where(F.col("_shard").isin(shards)) for g, shards in by.items()]
        listed = functools.reduce(DataFrame.unionByName, found).where(F.col("term").isin(terms)).select("_key", "_shard", "term", "tf", "dl")
        all_sizes = functools.reduce(DataFrame.unionByName, sizes).agg(F.sum("n").alias("_n"), (F.sum("words") / F.sum("n")).alias("_avg"))
        df = listed.groupBy("term").agg(F.count("*").alias("_df"))
        tf = F.col("tf").cast("double")
        part = idf(F.col("_n"), F.col("_df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
        scored = listed.join(F.broadcast(df), "term").join(F.broadcast(all_sizes)).groupBy("_key", "_shard").agg(F.sum(part).alias("score"))
        if r.threshold is not None:
            scored = scored.where(F.col("score") >= r.threshold)
        shown = r.attributes if r.attributes is not None else None
        if not r.filter and not r.sort and shown is not None and set(shown) <= {self.pk}:
            return page(scored.select(F.col("_key").alias(self.pk), "score"), r, self.pk)
        docs = self.read()
        p = plan(r.filter, self.pk, self.shards, key_type=dict(docs.dtypes)[self.pk])
        if p.narrowed:
            scored = scored.where(F.col("_shard").isin(*p.shards))
        hits = docs.where(p.condition()).join(scored.select(F.col("_key").alias(self.pk), "_shard", "score"), [self.pk, "_shard"])
        return page(hits, r, self.pk)

    def _postings_of(self, g: int, shards: list[int]) -> DataFrame:
        """A generation's postings of these shards."""
        return self.spark.read.parquet(self._path(f"gen={g}", "_postings")).where(F.col("_shard").isin(shards))

    def _publish(self, g: int, manifest: dict) -> None:
        """All of the manifest or nothing of it: written beside its place, then renamed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs, beside = self._fs(), path(self._path("manifest", f"_gen={g}-{uuid.uuid4().hex}"))
        stream = fs.create(beside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not fs.rename(beside, path(self._path("manifest", f"gen={g}.json"))):
            raise IndexError_(f"generation {g} of {self.uid} was written by another writer")

    def upsert(self, df: DataFrame, partial: bool = False) -> int:
        """Add or replace documents; of several with one key in df, the greatest in the order of its other columns wins,
        from left to right, null least. Returns the generation."""
        check_document_columns(df, self.pk)
        new = df.withColumn("_shard", shard_md5(self.pk, self.shards))
        each = new.groupBy(F.col(self.pk).alias("_key"), "_shard").agg(F.count("*").alias("_n"))
        first = each.agg(F.count_if(F.col("_key").isNull()), F.collect_set("_shard"), F.count("*"), F.sum("_n")).first()  # at most as many as shards
        if first[0]:
            raise IndexError_("a document has no primary key")
        touched, keys = sorted(first[1]), df.select(self.pk)
        if first[2] < (first[3] or 0):  # whole rows are dealt by key only where keys repeat
            new, keys = latest(new, self.pk, version_order(df, self.pk) or [F.lit(0)]), keys.distinct()
        now = self.read()
        if now is not None:
            old, keys = now.where(F.col("_shard").isin(touched)), F.broadcast(keys) if first[2] <= BROADCAST_KEYS else keys
            rest = old.join(keys, self.pk, "left_anti")
            changed = merge_fields(old.join(keys, self.pk, "left_semi"), new, self.pk) if partial else new
            new = rest.unionByName(changed, allowMissingColumns=True)
        return self._commit(new, touched, keys if first[2] <= BROADCAST_KEYS else None)

    def delete(self, keys: list) -> int:
        return self._remove(F.col(self.pk).isin(keys))

    def delete_where(self, predicate: Column) -> int:
        return self._remove(predicate)

    def _remove(self, predicate: Column) -> int:
        now = self.read()
        if now is None:
            raise IndexError_("no such index")
        touched = [r[0] for r in now.where(F.coalesce(predicate, F.lit(False))).select("_shard").distinct().collect()]
        return self._commit(delete_where(now.where(F.col("_shard").isin(touched)), predicate), touched)

    def delete_index(self) -> bool:
        """Remove the index with all its generations; false if there was none."""
        return self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path()), True)

    def create(self, pk: str | None = None, settings: dict | None = None) -> Index:
        """Record the primary key and settings before any document; an index that exists is refused."""
        if self.generations():
            raise IndexError_(f"index {self.uid} exists")
        self.pk = pk or self.pk
        self._publish(1, {"shards": {}, "pk": self.pk, "settings": settings or {}})
        return self

    def settings(self, generation: int | None = None) -> dict:
        known = self.generations()
        return self._told(known[-1] if generation is None else generation).get("settings", {}) if known else {}

    def update_settings(self, **changes) -> int:
        """A generation with the same documents and other settings; None removes one. An older generation is the way back."""
        now = {k: v for k, v in (self.settings() | changes).items() if v is not None}
        g = max([0, *self.generations(), *self._folders()]) + 1
        told = self._told(self.generations()[-1]) if self.generations() else {}
        self._publish(g, {"shards": self._manifest(), "pk": self.pk, "settings": now, "text": told.get("text")})
        return g

    def get(self, key) -> DataFrame:
        """The document of one key, from its shard alone."""
        rows = self.read()
        texts = key_texts((key,), dict(rows.dtypes)[self.pk])
        there = F.lit(True) if texts is None else F.col("_shard").isin([shard_of(t, self.shards) for t in texts])
        return rows.where(there & (F.col(self.pk) == F.lit(key))).transform(strip_reserved)

    def browse(self, offset: int = 0, limit: int = 20) -> DataFrame:
        return self.read().orderBy(self.pk).offset(offset).limit(limit).transform(strip_reserved)

    def dump(self, path: str) -> None:
        """All documents as newline-delimited JSON."""
        self.read().transform(strip_reserved).write.json(path)

    def load_dump(self, path: str) -> int:
        df = self.spark.read.json(path)
        return self.upsert(strip_reserved(df))


def analyse_dump(spark: SparkSession, path: str, pk: str) -> DataFrame:
    """One row: documents, documents without a key, and those with a reserved field."""
    df = spark.read.json(path)
    reserved = [F.col(x).isNotNull() for x in df.columns if is_reserved(x)]
    clash = F.greatest(*[r.cast("int") for r in reserved], F.lit(0)) if reserved else F.lit(0)
    key = F.col(pk) if pk in df.columns else F.lit(None)
    return df.agg(F.count("*").alias("documents"), F.count_if(key.isNull()).alias("without_key"), F.coalesce(F.sum(clash), F.lit(0)).cast("long").alias("reserved"))
