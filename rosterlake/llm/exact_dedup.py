"""Exact dedup through mergeable counting quotient filters.

Each partition builds a counting quotient filter over the 64-bit fingerprints of its texts: the high
bits (the quotient) name a slot, the rest (the remainder) is stored sorted within the slot's run with a
count. Filters cut into regions of the quotient space merge losslessly by merging sorted remainders.
Fingerprints counted more than once go to byte verification: their texts are grouped by the text itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_ROWS, ascii_lower, broadcast_if_small, releasing, settle, text_or_empty

#: High bits of a fingerprint that name its slot in a partition's filter; the rest is the remainder.
QUOTIENT_BITS = 20
#: Of these, so many name the region that is merged in one task: at least this many, more as rows are counted.
REGION_BITS = 4
#: Fingerprints that a partition holds before it emits its filter.
FLUSH = 2_000_000


class CountingQuotientFilter:
    """A lossless counting quotient filter: runs of (remainder, count), ordered by quotient then remainder.

    keys hold quotient and remainder side by side, ascending and distinct; region_bits of the quotient name a region.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, region_bits: int = REGION_BITS):
        self.keys, self.counts, self.region_bits = keys, counts, region_bits
        self.run_bits = max(0, QUOTIENT_BITS - region_bits)
        self.remainder_bits = 64 - region_bits - self.run_bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, region_bits: int = REGION_BITS) -> CountingQuotientFilter:
        keys, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls(keys, counts.astype(np.uint64), region_bits)

    def regions(self):
        """(region, occupied bits, run lengths, remainders, counts) for each region with entries."""
        region = (self.keys >> np.uint64(64 - self.region_bits)).astype(np.int64)
        slot = ((self.keys >> np.uint64(self.remainder_bits)) & np.uint64((1 << self.run_bits) - 1)).astype(np.int64)
        rest = self.keys & np.uint64((1 << self.remainder_bits) - 1)
        cuts = np.flatnonzero(np.diff(region, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(region)], strict=True):
            runs = np.bincount(slot[a:b], minlength=1 << self.run_bits)
            yield (int(region[a]), np.packbits(runs > 0).tobytes(), runs[runs > 0].astype("<u4").tobytes(), rest[a:b].astype("<u8").tobytes(), self.counts[a:b].astype("<u8").tobytes())

    @classmethod
    def of_region(cls, region: int, occupied: bytes, runs: bytes, rest: bytes, counts: bytes, region_bits: int = REGION_BITS) -> CountingQuotientFilter:
        empty = cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64), region_bits)
        slots = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8))).astype(np.uint64)
        slot = np.repeat(slots, np.frombuffer(runs, "<u4"))
        key = (np.uint64(region) << np.uint64(64 - region_bits)) | (slot << np.uint64(empty.remainder_bits)) | np.frombuffer(rest, "<u8")
        return cls(key, np.frombuffer(counts, "<u8").astype(np.uint64), region_bits)

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Merge the sorted remainders of two filters, without sorting: each entry's place follows from a search in the other.

        Equal remainders of one quotient add their counts, nothing is lost.
        """
        at = np.searchsorted(self.keys, other.keys)
        both = np.zeros(len(other.keys), bool)
        inside = at < len(self.keys)
        both[inside] = self.keys[at[inside]] == other.keys[inside]
        counts = self.counts.copy()
        counts[at[both]] += other.counts[both]
        new = ~both
        return CountingQuotientFilter(np.insert(self.keys, at[new], other.keys[new]), np.insert(counts, at[new], other.counts[new]), self.region_bits)

    @classmethod
    def merge(cls, parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Merge filters two by two, so that every entry moves only log(parts) times."""
        while len(parts) > 1:
            parts = [parts[i].merged(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


_BLOCK = "region int, occupied binary, runs binary, rest binary, counts binary"


def _build(region_bits: int):
    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def emit():
            rows = list(CountingQuotientFilter.build(np.concatenate(held), region_bits).regions())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["region", "occupied", "runs", "rest", "counts"])

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= FLUSH:
                yield emit()
                held, size = [], 0
        if size:
            yield emit()

    return run


def _merge(region_bits: int):
    def run(table: pa.Table) -> pa.Table:
        cols = [table.column(i).to_pylist() for i in range(5)]
        out = CountingQuotientFilter.merge([CountingQuotientFilter.of_region(*row, region_bits) for row in zip(*cols, strict=True)])
        many = out.counts > 1
        return pa.table({"fp": pa.array(out.keys[many].view(np.int64)), "n": pa.array(out.counts[many].astype(np.int64))})

    return run


def region_bits_for(rows: int, least: int = REGION_BITS) -> int:
    """So many bits that a region holds about GROUP_ROWS fingerprints at most, whatever the number of rows."""
    return min(30, max(least, (-(-rows // GROUP_ROWS) - 1).bit_length()))


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """fps: one long column of so many rows. The fingerprints that occur more than once, with their exact counts."""
    bits = region_bits_for(rows)
    blocks = fps.mapInArrow(releasing(_build(bits)), _BLOCK)
    return blocks.groupBy("region").applyInArrow(_merge(bits), "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the largest id stays. A null text
    counts as empty. Rows with a null id belong to their group but can't be its keep_id unless all its ids
    are null, when keep_id is null and each of them stays. Rows that repeat both id and text get the same
    verdict. Ids may be of any orderable type. Texts are hashed and compared as a whole, however long. Other
    columns of docs are ignored, whatever their names; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_or_empty(text_col)).alias("_t")).withColumn("_fp", F.xxhash64("_t"))
    repeated = settle(repeated_fingerprints(base.select("_fp"), docs.count()))
    suspects = base.join(broadcast_if_small(repeated.select(F.col("fp").alias("_fp")), 64), "_fp", "left_semi")
    # byte verification: the hash aggregate compares the texts themselves; each partition sends a text once
    classes = suspects.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"))
    classes = settle(classes.where("_n > 1").select(F.sha2("_t", 256).alias("_sha"), "_n", "_keep"))
    rows = base.select("_id", F.sha2("_t", 256).alias("_sha"))
    out = rows.join(broadcast_if_small(classes, 160), "_sha", "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
