"""Change capture and write-path streams. Each transformation works on batch and streaming frames alike, unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id string, event_seq long, task_id string, index_uid string, operation string, primary_keys array<string>, shard_ids array<int>, settings_version long, timestamp long, origin string, document string"


def suppress(events: DataFrame, internal: tuple[str, ...] = ("reshard", "repair", "ttl"), emit_internal: bool = False) -> DataFrame:
    """Changes that users made; those of internal origin only on demand."""
    return events if emit_internal else events.where(F.col("origin").isNull() | ~F.col("origin").isin(*internal))


def sequence(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Batch: a number without gaps for each index, from 1."""
    return events.withColumn("event_seq", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long"))


def since(events: DataFrame, seq: int, by: str | None = None, index_uid: str | None = None, limit: int | None = None) -> DataFrame:
    """Changes after a cursor, in order: of one index where ``by`` and ``index_uid`` are given; at most ``limit`` a page."""
    out = events.where(F.col("event_seq") > seq)
    out = out if by is None else out.where(F.col(by) == index_uid)
    out = out.orderBy("event_seq")
    return out if limit is None else out.limit(limit)


def as_of(versions: DataFrame, key: str, ts: str, at: Column) -> DataFrame:
    """Of each key the version that was current at a time: the last at or before it."""
    values = [x for x in versions.columns if x != key]
    last = versions.where(F.col(ts) <= at).groupBy(key).agg(F.max_by(F.struct(*values), F.struct(ts, *[x for x in values if x != ts])).alias("_v"))
    return last.select(key, *[F.col(f"_v.{x}").alias(x) for x in values])


def batches(events: DataFrame, by: str, order: list[str], ts: str, most: int = 100, seconds: int = 1) -> DataFrame:
    """(by, start, batch, n, first_id, last_id): changes as they are sent on, at most ``most`` of an index and of ``seconds`` at once."""
    start = F.window(ts, f"{seconds} seconds")["start"]
    w = W.partitionBy(by, "start").orderBy(*order)
    nth = events.withColumn("start", start).withColumn("batch", F.floor((F.row_number().over(w) - 1) / most))
    first = F.struct(*order)
    return nth.groupBy(by, "start", "batch").agg(F.count("*").alias("n"), F.min(first)[order[-1]].alias("first_id"), F.max(first)[order[-1]].alias("last_id"))


def session_pins(writes: DataFrame, acks: DataFrame, failed_groups: DataFrame, rf: int, now: Column, ttl_s: int = 900) -> DataFrame:
    """(session_id, task_id, pinned_group) of sessions that wrote in the last ttl_s seconds.

    writes: (session_id, task_id, ts); acks: (task_id, replica_group, node_id, ts). A session is pinned to the group that first
    had floor(rf / 2) + 1 nodes acknowledge its last write, of equal times the one with the smallest number. The pin is null
    before any group got there, and when the group has failed.
    """
    last = writes.groupBy("session_id").agg(F.max_by("task_id", F.struct("ts", "task_id")).alias("task_id"), F.max("ts").alias("at"))
    last = last.where(F.col("at").cast("timestamp").cast("double") > now.cast("timestamp").cast("double") - ttl_s)
    once = acks.groupBy("task_id", "replica_group", "node_id").agg(F.min("ts").alias("ts"))
    nth = once.withColumn("nth", F.row_number().over(W.partitionBy("task_id", "replica_group").orderBy("ts", "node_id")))
    first = nth.where(F.col("nth") == rf // 2 + 1).groupBy("task_id").agg(F.min(F.struct("ts", "replica_group"))["replica_group"].alias("pinned_group"))
    pinned = last.join(first, "task_id", "left").join(failed_groups.select(F.col("replica_group").alias("pinned_group"), F.lit(True).alias("down")), "pinned_group", "left")
    return pinned.select("session_id", "task_id", F.when(F.col("down").isNull(), F.col("pinned_group")).alias("pinned_group"))


def deduplicate(stream: DataFrame, key: str, ts: str, keep: str) -> DataFrame:
    """Streaming: at-least-once delivery to once within the time kept."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def first_of_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Batch twin of deduplicate."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def coalesce_queries(queries: DataFrame, ts: str, fingerprint: str, width: str = "50 milliseconds") -> DataFrame:
    """(start, fingerprint, n): equal queries in one tumbling window become one."""
    return queries.groupBy(F.window(ts, width).alias("w"), fingerprint).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), fingerprint, "n")


def rate_windows(requests: DataFrame, ts: str, key: str, width: str, most: int) -> DataFrame:
    """(start, key, n, limited) for fixed windows."""
    counted = requests.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n", (F.col("n") > most).alias("limited"))


def sessions(events: DataFrame, ts: str, user: str, gap: str) -> DataFrame:
    """(user, start, finish, n) of sessions that end after a gap; state is one open window a user."""
    s = events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("finish"))
    return s.select(user, F.col("w.start").alias("start"), "finish", "n")


def to_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Run ``write(batch, batch_id)``; the id names the output, so a retried batch replaces itself."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def to_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The internal sink: a Parquet log that readers resume from by sequence number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return to_sink(stream, write, checkpoint)


def messages(events: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, value): each change as a message, its columns as JSON; what message queues and webhooks are sent."""
    return events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def to_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Changes to a Kafka topic, at least once; needs Spark's Kafka package."""
    out = messages(stream, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.option("checkpointLocation", checkpoint).start()


def late(rows: DataFrame, ts: str, watermark) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and stragglers for a side table; a row without a time is a straggler."""
    in_time = F.coalesce(F.col(ts) >= watermark, F.lit(False))
    return rows.where(in_time), rows.where(~in_time)


def change_stream(spark: SparkSession, schema: str, source: str, log: str, checkpoint: str, key: str = "event_id", ts: str = "ts", keep: str = "1 day", files: int = 100) -> DataFrame:
    """Run what has arrived at ``source`` (Parquet) through suppression and deduplication into the log, and give the log.
    A run that dies is taken up from its checkpoint by the next one, which rewrites the batch that was under way."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    done = deduplicate(suppress(stream), key, ts, keep)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    q = done.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(log).drop("batch")
