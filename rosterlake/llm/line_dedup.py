"""Line dedup: explode lines, hash their keys, count distinct documents per hash, drop, reassemble."""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, releasing, row_key, settle, text_or_empty

WHITE = b" \t\n\x0b\f\r"

#: UTF-8 bytes that begin no code point.
INNER = bytes(range(0x80, 0xC0))

#: Bytes of a text whose lines are held at once.
SLICE = 1 << 20

#: Rows of an Arrow batch of hashes.
ROWS = 1 << 17

#: Texts that Parquet's reader holds at once, in arrays that grow by doubling.
READ_ROWS = 256

#: So many common keys (16 bytes each) are gathered and broadcast; more meet their lines in a join.
KEYS_AT_ONCE = 262_144


def line_slices(text: bytes, size: int | None = None):
    """The lines of text, in lists of about size bytes."""
    start, size = 0, size or SLICE
    while (end := text.find(b"\n", start + size)) >= 0:
        yield text[start:end].split(b"\n")
        start = end + 1
    yield text[start:].split(b"\n")


def line_hashes(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """A 128-bit hash of each line's key: [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased. None where the key doesn't count."""
    keys = [x.strip(WHITE).lower() for x in lines]
    if min_chars > 1:
        keys = [k if len(k.translate(None, INNER)) >= min_chars else b"" for k in keys]
    return [blake2b(k, digest_size=16).digest() if k else None for k in keys]


def text_hashes(text: bytes, min_chars: int) -> bytes:
    """The distinct hashes of a text's lines, end to end."""
    each = [b"".join({*line_hashes(lines, min_chars)} - {None}) for lines in line_slices(text)]
    return each[0] if len(each) == 1 else np.unique(np.frombuffer(b"".join(each), "V16")).tobytes()


def without(text: bytes, gone) -> tuple[int, int, bytes]:
    """Number of lines, of lines dropped, and the others' text; gone(lines, position of the first) tells which go."""
    n, kept, parts = 0, 0, []
    for lines in line_slices(text):
        stay = [x for x, g in zip(lines, gone(lines, n), strict=True) if not g]
        n, kept = n + len(lines), kept + len(stay)
        if stay:
            parts.append(b"\n".join(stay))
    return n, n - kept, text if kept == n else b"\n".join(parts)


def _halves(hashes: bytes) -> list[pa.Array]:
    return [pa.array(x) for x in np.frombuffer(hashes, "<i8").reshape(-1, 2).T]


def _distinct(min_chars: int):
    def run(batches):
        for b in batches:
            held = b"".join(text_hashes(t.as_py(), min_chars) for t in b.column("_t"))
            for i in range(0, len(held), 16 * ROWS):
                yield pa.RecordBatch.from_arrays(_halves(held[i : i + 16 * ROWS]), names=["_h1", "_h2"])

    return run


def _positions(min_chars: int):
    """A row for each line that counts: its row's key, its position and its hash."""

    def made(keys, counts, pos, hashes):
        columns = [pa.array(np.repeat(np.array(k, np.int64), counts)) for k in zip(*keys, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(pos, pa.int32()), *_halves(b"".join(hashes))], names=["_rk1", "_rk2", "_pos", "_h1", "_h2"])

    def run(batches):
        for b in batches:
            keys, counts, pos, hashes = [], [], [], []
            for t, *key in zip(*(b.column(n) for n in ("_t", "_rk1", "_rk2")), strict=True):
                at = 0
                for lines in line_slices(t.as_py()):
                    found = [(i, h) for i, h in enumerate(line_hashes(lines, min_chars), at) if h]
                    keys.append([k.as_py() for k in key])
                    counts.append(len(found))
                    pos += [i for i, _ in found]
                    hashes += [h for _, h in found]
                    at += len(lines)
                    if len(pos) >= ROWS:
                        yield made(keys, counts, pos, hashes)
                        keys, counts, pos, hashes = [], [], [], []
            if pos:
                yield made(keys, counts, pos, hashes)

    return run


def _reassemble(min_chars: int, common, digest: bool):
    """common: a broadcast of the hashes that go, end to end; without it each row has the positions that go."""

    def run(batches):
        joined = common.value if common else b""
        drop = {joined[i : i + 16] for i in range(0, len(joined), 16)}
        by_hash = lambda lines, _: [h in drop for h in line_hashes(lines, min_chars)]
        for b in batches:
            texts = (t.as_py() for t in b.column("_t"))
            if common:
                rows = [without(t, by_hash) for t in texts]
            else:
                sets = (set(g.as_py() or ()) for g in b.column("_gone"))
                rows = [without(t, lambda lines, at, s=s: [i in s for i in range(at, at + len(lines))]) for t, s in zip(texts, sets, strict=True)]
            n, dropped, kept = zip(*rows, strict=True) if rows else ((), (), ())
            if digest:
                kept = [sha256(k).hexdigest().encode() for k in kept]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], names=["_id", "n_lines", "n_dropped", "_kept"])

    return run


def _few_texts_read(docs: DataFrame) -> DataFrame:
    """docs; Parquet's reader then takes READ_ROWS rows at a time, unless the session sets a number of its own."""
    conf, key = docs.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize"
    if conf.get(key) == "4096":  # Spark's default
        conf.set(key, str(READ_ROWS))
    return docs


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, digest: bool = False) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_text, or if digest its SHA-256 kept_sha256.

    A line whose key has at least min_chars code points and occurs in at least min_docs documents goes from
    every document. Each row counts as one document, so a line repeated within it counts once. Null or empty
    text is one empty line, and an empty key never drops. Rows with null or repeated ids are kept apart; rows equal
    in both id and text come out once each. Keys are compared by a 128-bit hash. Texts and
    lines of any length are read as a whole. An empty table gives an empty result; other columns of docs are
    ignored, whatever their names.

    Texts stay where they are read while the common keys fit a broadcast. Beyond that they are counted again and
    joined with the lines' hashes, and each text crosses one shuffle to meet the positions that go.
    """
    base = in_small_batches(_few_texts_read(docs)).select(F.col(id_col).alias("_id"), text_or_empty(text_col).cast("binary").alias("_t"))
    hashes = base.select("_t").mapInArrow(releasing(_distinct(min_chars)), "_h1 long, _h2 long")
    common = hashes.groupBy("_h1", "_h2").count().where(F.col("count") >= min_docs).select("_h1", "_h2")
    few = common.limit(KEYS_AT_ONCE + 1).toArrow()
    schema = base.select("_id").schema.add("n_lines", "long").add("n_dropped", "long").add("_kept", "binary")
    if few.num_rows <= KEYS_AT_ONCE:
        joined = np.column_stack([few[c].to_numpy() for c in ("_h1", "_h2")]).astype("<i8").tobytes()
        out = base.mapInArrow(releasing(_reassemble(min_chars, docs.sparkSession.sparkContext.broadcast(joined), digest)), schema)
    else:
        keyed = base.select("_id", "_t", *row_key("_id", "_t"))
        lines = keyed.mapInArrow(releasing(_positions(min_chars)), "_rk1 long, _rk2 long, _pos int, _h1 long, _h2 long")
        # settled, as adaptive execution splits a hot line's rows only where the join's sides are plain shuffles;
        # rows equal in id and text have equal positions, so one set serves them all
        gone = lines.join(settle(common), ["_h1", "_h2"], "left_semi").groupBy("_rk1", "_rk2").agg(F.collect_set("_pos").alias("_gone"))
        out = keyed.join(gone, ["_rk1", "_rk2"], "left").select("_id", "_t", "_gone").mapInArrow(releasing(_reassemble(min_chars, None, digest)), schema)
    return out.select(F.col("_id").alias(id_col), "n_lines", "n_dropped", F.col("_kept").cast("string").alias("kept_sha256" if digest else "kept_text"))


SQL = r"""
WITH l AS (
  SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY rid, doc_id
"""
