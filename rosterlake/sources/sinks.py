"""Layer tables and sinks. Writers are safe to retry: a batch overwrites its own partitions or replaces rows by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators.gold import keep_latest, merge_upsert


def write_layer(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str], mode: str = "overwrite") -> None:
    """A partitioned, sorted, ZSTD-compressed Parquet table; overwriting replaces the partitions that df holds."""
    shuffled = df.repartition(*partition_by, *sort_by[:1]) if partition_by else df
    writer = shuffled.sortWithinPartitions(*partition_by, *sort_by).write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def bronze_copy(rows: DataFrame, path: str, partner: Column, day: str, ingest_id: str) -> None:
    """Raw rows with provenance under partner_id and dt: JSON payload, row hash, ingest id; a retried batch overwrites itself."""
    raw = [c for c in rows.columns if not c.startswith("_")]
    out = rows.select(
        F.lit(ingest_id).alias("_ingest_id"), F.sha2(F.to_json(F.struct(*raw)), 256).alias("_row_hash"), F.lit(day).cast("timestamp").alias("_ingested_at"),
        F.to_json(F.struct(*raw), {"ignoreNullFields": "false"}).alias("raw_payload"), F.array(*map(F.lit, raw)).alias("raw_columns"), partner.alias("partner_id"), F.lit(day).alias("dt"),
    )
    write_layer(out, path, ["partner_id", "dt"], ["_row_hash"])


def dedupe_row_hash(bronze: DataFrame) -> DataFrame:
    """One row per partner and row hash."""
    return bronze.dropDuplicates(["partner_id", "_row_hash"])


def _current(spark: SparkSession, path: str) -> str | None:
    """The newest complete version below path: the one that its marker names last."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    done = sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory() and fs.exists(s.getPath().suffix("/_SUCCESS")))
    return f"{path}/{done[-1]}" if done else None


class KeyedTable:
    """A table of one row per key, in versions: a batch writes a whole new version, which readers see once it is complete."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def read(self) -> DataFrame | None:
        now = _current(self.spark, self.path)
        return self.spark.read.parquet(now) if now else None

    def upsert(self, changes: DataFrame, order: list[Column]) -> None:
        """The last change of each key, by order, replaces its row."""
        old = self.read()
        new = keep_latest(changes, self.keys, order) if old is None else merge_upsert(old, changes, self.keys, order)
        last = _current(self.spark, self.path)
        number = int(last.rsplit("/", 1)[1].split("-")[0]) + 1 if last else 0
        new.write.parquet(f"{self.path}/{number:012d}-{uuid.uuid4().hex[:8]}")


def event_sink(events: DataFrame, path: str, form: str = "parquet") -> None:
    """Events in the published schema; form "avro" needs the Avro package on the session's class path."""
    events.write.mode("append").format(form).save(path)


def split_dead_letters(events: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their problem): a bad row goes to the dead letters, it never fails the batch."""
    marked = events.withColumn("problem", problem)
    return marked.where("problem IS NULL").drop("problem"), marked.where("problem IS NOT NULL")


def relay(outbox: DataFrame, delivered: DataFrame | None, at: str) -> tuple[DataFrame, DataFrame]:
    """(rows to send, offsets after): undelivered outbox rows in order, and their ids with the time of delivery."""
    rest = outbox if delivered is None else outbox.join(delivered.select("outbox_id"), "outbox_id", "left_anti")
    sent = rest.select("outbox_id", F.lit(at).cast("timestamp").alias("delivered_at"))
    return rest.orderBy("enqueued_at", "outbox_id"), sent if delivered is None else delivered.unionByName(sent)
