"""Streams of change envelopes and landed files. Every stream takes the batch operators' expressions unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import cdc
from rosterlake.sources.sinks import KeyedTable, split_dead_letters

#: Files that one micro-batch takes at most.
FILES_AT_ONCE = 1000


def read_envelopes(spark: SparkSession, folder: str, files_at_once: int = FILES_AT_ONCE) -> DataFrame:
    """A stream of JSON envelopes from a folder; lines that are no envelope come with op null."""
    return spark.readStream.schema(cdc.ENVELOPE).option("maxFilesPerTrigger", files_at_once).json(folder)


def read_landed(spark: SparkSession, folder: str, schema: str, form: str = "csv", files_at_once: int = FILES_AT_ONCE) -> DataFrame:
    """A stream of landed files with their path; new files start the next micro-batch."""
    got = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_at_once).format(form).load(folder)
    return got.withColumn("_source_file", F.col("_metadata.file_path"))


def cdc_events(envelopes: DataFrame, mapping: dict[str, str], secret: bytes) -> DataFrame:
    return cdc.process(envelopes, mapping, secret)


def without_replays(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Events seen once, within a watermark: the state holds no more than its window."""
    return events.withWatermark("occurred_at", window).dropDuplicatesWithinWatermark(["partner_id", "partner_member_id", "operation", "source_lsn", "ts_ms"])


def _start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool, every: str):
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def write_events(events: DataFrame, good: str, dead: str, checkpoint: str, once: bool = True, every: str = "10 seconds"):
    """Append usable events and dead letters to their own tables, each batch under its number, so that a replay overwrites itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        fine, bad = split_dead_letters(batch, F.col("problem"))
        fine.write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    return _start(events, checkpoint, each, once, every)


def keep_latest_state(events: DataFrame, table: KeyedTable, checkpoint: str, once: bool = True, every: str = "10 seconds"):
    """Fold each micro-batch into a keyed table by last-write-wins; a replayed batch changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        fine = batch.where("problem IS NULL").drop("problem")
        old = table.read()
        rows = fine if old is None else fine.unionByName(old)
        table.upsert(cdc.latest(rows), cdc.order_of(rows))

    return _start(events, checkpoint, each, once, every)
