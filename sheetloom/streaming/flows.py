"""Streaming twins: ingestion, latest status and completion messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def ingest_stream(
    spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 1000
) -> None:
    """Run a stateless batch pipeline over arriving Parquet files and append the results.

    ``availableNow`` drains what is there in bounded batches and stops; the
    checkpoint makes a restart continue where it stopped, without duplicates.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    q = (
        transform(arriving).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()


STATUS = ["status", "type", "filename"]


def _latest(df: DataFrame) -> DataFrame:
    body = F.struct(F.coalesce("status", F.lit("completed")).alias("status"), "type", "filename", "ts", "seq")
    return df.groupBy("processing_id").agg(F.max_by(body, F.struct("ts", "seq")).alias("last"))


def latest_status(events: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Last record per id; with ``ids``, unknown ones are reported as not found.

    The aggregate keeps one record per id on the map side, so a busy id does not
    travel event by event.
    """
    d = _latest(events).select("processing_id", "last.*")
    if ids is None:
        return d
    return ids.join(d, "processing_id", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


#: Event time in the state is a number of microseconds, so that no time zone comes in between.
LAST = "processing_id BIGINT, status STRING, type STRING, filename STRING, micros BIGINT, seq BIGINT"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestRecord(StatefulProcessor):
    """Keeps the last record of an id until ``keep_ms`` of event time have passed without a newer one."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST.split(", ", 1)[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = tuple(self.last.get()) if self.last.exists() else None
        best = max(((r.status or "completed", r.type, r.filename, r.micros, r.seq) for r in rows), key=lambda r: r[3:])
        if known is not None and known[3:] >= best[3:]:
            return
        self.last.update(best)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(best[3] // 1000 + self.keep_ms)
        yield Row(processing_id=key[0], status=best[0], type=best[1], filename=best[2], micros=best[3], seq=best[4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_status_stream(
    spark: SparkSession, source: str, schema, target: str, checkpoint: str, keep: str = "30 days", delay: str = "1 day", files_per_batch: int | None = None
) -> None:
    """Keep the last record per id as events arrive and append each change to ``target``.

    An id leaves the state once the watermark has passed its last event by ``keep``; an
    event that comes after that starts the id anew.  Events more than ``delay`` older
    than the newest of earlier batches are dropped.  So the state holds the ids of the last ``keep``
    plus ``delay`` of event time, however many there have been before.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keep_ms = int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {keep})").first()[0])
    arriving = spark.readStream.schema(schema)
    if files_per_batch:
        arriving = arriving.option("maxFilesPerTrigger", files_per_batch)
    records = arriving.parquet(source).select("processing_id", "status", "type", "filename", F.unix_micros("ts").alias("micros"), "seq", "ts").withWatermark("ts", delay)
    changes = lambda batch: batch.withColumn("ts", F.timestamp_micros("micros")).drop("micros")
    try:
        q = (
            records.groupBy("processing_id").transformWithState(statefulProcessor=LatestRecord(keep_ms), outputStructType=LAST, outputMode="Update", timeMode="EventTime")
            .writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, n: changes(batch).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{target}/batch_id={n}"))
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def status_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Ids and records that the stream behind ``checkpoint`` holds at present."""
    return spark.read.format("statestore").option("stateVarName", "last").load(checkpoint).select("key.processing_id", "value.*")


def completion_messages(records: DataFrame) -> DataFrame:
    """Kafka-shaped (key, value) rows for finished records; absent parts are left out of the JSON."""
    pid = F.col("processing_id").cast("string")
    url = lambda tail: F.concat(F.lit("/api/results/"), pid, F.lit(tail))
    ends = F.struct(
        url("/full").alias("full"), url("/table").alias("table"), url("/meta").alias("meta"), F.concat(F.lit("/api/status/"), pid, F.lit("/")).alias("status")
    )
    has_keys = F.coalesce("processed_key", "table_key").isNotNull()
    ref = lambda c, kind: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("key"), F.lit(kind).alias("storage_type")))
    message = F.struct(
        "type", "filename", pid.alias("processing_id"), F.coalesce("status", F.lit("completed")).alias("status"), ends.alias("results_endpoints"),
        F.when(has_keys, F.struct(ref("processed_key", "processed_json").alias("processed_json"), ref("table_key", "table_data").alias("table_data"))).alias("storage_keys"),
        F.when(F.col("file_id").isNotNull(), F.struct("file_id")).alias("cache_handle"),
    )
    done = records.filter(F.coalesce("status", F.lit("completed")).isin("completed", "failed"))
    return done.select(pid.alias("key"), F.to_json(message).alias("value"))
