"""An index with another number of shards: copied beside the old one, compared, then pointed to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.migration import shadow_name
from quillon.operators.repair import content_hash, diff
from quillon.operators.search import strip_reserved
from quillon.sources.control import flip
from quillon.sources.index import Index, IndexError_
from quillon.sources.store import ControlStore


def shadow_of(index: Index, shards: int) -> Index:
    return Index(index.spark, index.root, shadow_name(index.uid, shards), index.pk, shards, index.text)


def backfill(index: Index, shards: int) -> Index:
    """The shadow with all documents of the index. Run again after a crash it replaces what is there; keys that the
    shadow has and the index lost are removed."""
    shadow, rows = shadow_of(index, shards), strip_reserved(index.read())
    shadow.upsert(rows)
    held = shadow.read()
    gone = held.join(rows.select(index.pk), index.pk, "left_anti")
    if gone.head(1):
        stale = gone.select(index.pk)
        shadow._commit(held.join(stale, index.pk, "left_anti"), [r[0] for r in gone.select("_shard").distinct().collect()])
    return shadow


def differences(index: Index, shadow: Index) -> DataFrame:
    """(pk, kind): documents that the two don't hold alike."""
    columns = [x for x in strip_reserved(index.read()).columns if x != index.pk]
    side = lambda x: x.read().select(F.col(index.pk).cast("string").alias("pk"), content_hash(*[F.col(c) if t in ("string",) else F.to_json(F.struct(c)) for c, t in index.read().select(*columns).dtypes]).alias("content_hash"))
    return diff(side(index), side(shadow))


def swap(store: ControlStore, alias: str, index: Index, shadow: Index, now: int) -> int:
    """Point the alias to the shadow if it holds what the index does; refuse otherwise. Returns the aliases' generation."""
    if differences(index, shadow).head(1):
        raise IndexError_(f"{shadow.uid} differs from {index.uid}")
    return store.put("aliases", flip(store.read("aliases"), alias, shadow.uid, now))
