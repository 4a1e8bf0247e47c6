"""Best-fit packing by large-item matching.

Lengths are whole numbers up to the capacity, so the histogram of lengths (at most `capacity` rows) holds all
that a packing depends on. The plan is made on that histogram, whole runs of equal bins at a time: items over
a third of the capacity are matched in pairs greedily (at most two fit a bin), smaller ones go, longest first,
to the tightest gap. Items are numbered within their length in parallel, and the plan maps (length, number) to
a sequence and an offset.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SLICE_BYTES, read_vocabulary, vocabulary
from .common import byte_slices, in_small_batches, releasing, settle

CAPACITY = 2048


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, how many, first sequence, offset) runs that place every item of the histogram."""
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = {}
    sizes: list[int] = []
    bins = 0

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(sizes, gap)
            gaps.setdefault(gap, []).append([first, n])

    def place(n: int, k: int, first: int, offset: int) -> None:
        plan.append((n, taken[n], k, first, offset))
        taken[n] += k
        left[n] -= k

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            i = bisect.bisect_right(large, min(capacity - n, n)) - 1
            while i >= 0 and not left[large[i]]:
                i -= 1
            mate = large[i] if i >= 0 else None
            k = left[n] if mate is None else (left[n] // 2 if mate == n else min(left[n], left[mate]))
            if mate == n and not k:  # one is left of its own length: look for a shorter mate
                i -= 1
                while i >= 0 and not left[large[i]]:
                    i -= 1
                mate, k = (large[i] if i >= 0 else None), 1
            place(n, k, bins, 0)
            if mate is not None:
                place(mate, k, bins, n)
            open_gap(capacity - n - (mate or 0), bins, k)
            bins += k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect.bisect_left(sizes, n)
            if i == len(sizes):
                new = -(-left[n] // (capacity // n))
                open_gap(capacity, bins, new)
                bins += new
                continue
            gap = sizes[i]
            run = gaps[gap][-1]
            k = min(left[n], run[1])
            place(n, k, run[0], capacity - gap)
            gaps[gap].pop()
            if run[1] > k:
                gaps[gap].append([run[0] + k, run[1] - k])
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(i)
            open_gap(gap - n, run[0], k)
    return plan


def pieces_of(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length): one piece, or capacity-long ones of which the first may be shorter."""
    first = total % capacity or capacity
    return [(0, min(total, first)), *((s, capacity) for s in range(first, total, capacity))]


def _pieces(content, capacity: int, end_id: int):
    def run(batches):
        vocab = vocabulary(content.value)
        tail = end_id.to_bytes(4, "little")
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for start, stop in byte_slices([len(t) for t in texts], SLICE_BYTES):
                rows = []
                for i, packed in enumerate(vocab.encode(texts[start:stop]), start):
                    packed += tail
                    for k, (s, n) in enumerate(pieces_of(len(packed) // 4, capacity)):
                        rows.append((i, k, s, n, zlib.crc32(packed[4 * s : 4 * (s + n)])))
                at, *cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["_id", "piece", "start", "length", "ids_crc32"])

    return run


def _assign(plan):
    def run(batches):
        table = plan.value
        key = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            n = b.schema.get_field_index("length")
            length, number = b.column(n).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            row = table[np.searchsorted(key, length << 44 | number, side="right") - 1]
            out = [*b.columns[:-1], pa.array(row[:, 3] + number - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids followed by end_id; null text counts as empty (the end id alone). Only documents longer
    than the capacity are cut, into capacity-long pieces, the first of which may be shorter. Rows are packed
    independently: null or repeated ids are allowed. Sequences are filled without gaps from offset 0. The plan on
    the driver holds at most `capacity` lengths and their runs; it never grows with the number of documents.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_vocabulary(vocab_path))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = in_small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(releasing(_pieces(content, capacity, end_id)), schema)
    # the written pieces fix each row's place: their partition and order are the same at every later read
    pieces = settle(pieces).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    counts = settle(pieces.groupBy("length", "_p").agg(F.count(F.lit(1)).alias("_c")))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_c").alias("n")).collect()}
    plan = np.array(sorted(plan_bins(lengths, capacity)), np.int64).reshape(-1, 5)
    before = counts.withColumn("_base", F.sum("_c").over(Window.partitionBy("length").orderBy("_p")) - F.col("_c")).drop("_c")
    numbered = pieces.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_p").orderBy("_m")) - 1)
    numbered = numbered.join(before, ["length", "_p"]).select("_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_r")).cast("long").alias("_number"))
    out = numbered.mapInArrow(releasing(_assign(spark.sparkContext.broadcast(plan))), f"{schema}, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)
