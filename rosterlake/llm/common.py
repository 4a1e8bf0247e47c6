"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows that one task is asked to hold when an operator sizes its own groups.
GROUP_ROWS = 200_000

#: A side is broadcast only when its counted rows times the row bytes stay below this.
BROADCAST_BYTES = 32 << 20

#: Bytes of rows that an Arrow batch of whole texts holds, several times over on both sides of the pipe.
BATCH_BYTES = 4 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters keep their case. Pure ASCII takes the fast path: there lower() says the same."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only on a local master, whose executors share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="rosterlake-ck-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast when the (settled) frame's counted size is under the bound; else leave it to a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until no column (in any case) is called so."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def byte_slices(sizes: list[int], limit: int):
    """Cut rows 0..n into (start, stop) runs of at most limit bytes; a longer row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs; whole texts then reach Python in batches of about BATCH_BYTES (a longer text stands alone), unless the session sets a limit of its own."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":  # Spark's default
        conf.set(key, str(BATCH_BYTES))
    return docs


def releasing(run):
    """run(batches) of a mapInArrow; unused memory goes back, from Arrow's pool after each batch and from malloc at the end; idle workers would else keep it."""

    def go(batches):
        def freed():
            for b in batches:
                yield b
                del b
                pa.default_memory_pool().release_unused()

        yield from run(freed())
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return go


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit columns naming a row by id and text, so rows that repeat an id don't mix."""
    a, b = F.col(id_col), F.col(text_col)
    return [F.xxhash64(a, b, F.lit(1)).alias("_rk1"), F.xxhash64(F.lit(2), b, a).alias("_rk2")]
