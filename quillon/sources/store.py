"""The control tables, stored: each table is an index of its own whose key is the row's key, so writes
are generations that a manifest makes visible at once and that a crash leaves as they were."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.config import Config
from quillon.sources.control import TABLES
from quillon.sources.index import Index

_KEY = "row_key"


@dataclass
class ControlStore:
    spark: SparkSession
    root: str
    shards: int = 8

    def _index(self, table: str) -> Index:
        if table not in TABLES:
            raise KeyError(f"no such control table: {table}")
        return Index(self.spark, self.root, table, _KEY, self.shards)

    def _keyed(self, table: str, rows: DataFrame) -> DataFrame:
        keys, schema = TABLES[table]
        empty = self.spark.createDataFrame([], schema)
        typed = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])
        return typed.withColumn(_KEY, F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """The table's rows now, or as of an earlier generation."""
        held = self._index(table).read(generation)
        schema = TABLES[table][1]
        return self.spark.createDataFrame([], schema) if held is None else held.select(*self.spark.createDataFrame([], schema).columns)

    def put(self, table: str, rows: DataFrame) -> int:
        """Insert or replace by key; of rows with one key the greatest stays. Returns the generation."""
        return self._index(table).upsert(self._keyed(table, rows))

    def delete(self, table: str, predicate: Column) -> int:
        """Delete rows on which the predicate is true; a table that was never written stays so (generation 0)."""
        index = self._index(table)
        return index.delete_where(predicate) if index.read() is not None else 0

    def generations(self, table: str) -> list[int]:
        return self._index(table).generations()


def open_store(spark: SparkSession, config: Config) -> ControlStore:
    """The store that a configuration names. A local one has few shards and one writer, a shared one more."""
    return ControlStore(spark, config.task_store.path, 1 if config.task_store.backend == "local" else 8)
