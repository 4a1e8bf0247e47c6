"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Windows of `length` bytes are assigned to content-defined anchors: the leftmost k-gram of smallest hash within
the window. Equal windows have equal anchors, so a window that repeats lies in two fragments (runs of windows
with one anchor) that share the anchor's hash. Fragments that are equal as a whole meet first and count once.
The distinct fragments of an anchor are the texts whose repeats are still open: each task cuts its fragments
into shards, builds each shard's Burrows-Wheeler transform, and merges them by iterative interleave refinement:
every round orders the interleave by a few more characters and carries the boundaries of common prefixes along,
so after `length` characters the blocks without a boundary are the repeated intervals. No suffix is sorted again.

One key never decides the size of a task. Anchors that a sample finds in very many fragments meet by anchor and
fragment; anchors with many open fragments are dealt window by window, by the hash of the window: equal windows
still meet, and only windows whose hash repeats are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, settle, text_or_empty

LENGTH = 100
GRAM = 32
SHARD_BYTES = 1 << 16
#: Suffixes that one merge task is asked to hold.
TASK_BYTES = 1 << 18
#: Bytes of open fragments beyond which an anchor is dealt window by window, and the windows of one such task.
SPLIT_BYTES, TASK_WINDOWS = 4 * TASK_BYTES, 100_000
#: One document in so many is looked at for anchors that would crowd a meeting task.
SURVEY = 64
#: Records of one meeting task, text of one bucket of documents, and bytes hashed at once.
MEET_RECORDS, BUCKET_BYTES = 400_000, 1 << 22
SLICE_BYTES, CACHE_BYTES = 1 << 22, 1 << 17
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
LAST = (1 << 63) - 1


def _window_min(a: np.ndarray, width: int) -> np.ndarray:
    s = 1
    while 2 * s <= width:
        a = np.minimum(a[:-s], a[s:])
        s *= 2
    return np.minimum(a[: len(a) - (width - s)], a[width - s :]) if s < width else a


class _Hasher:
    """Hashes of byte ranges by prefix sums modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            make = lambda p: np.cumprod(np.r_[np.uint64(1), np.full(2 * n, p, np.uint64)], dtype=np.uint64)
            self.up, self.down = make(_P), make(_P_INVERSE)
        return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], dtype=np.uint64)]

    def ranges(self, sums: np.ndarray, start, stop) -> np.ndarray:
        h = (sums[stop] - sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))


_hasher = _Hasher()


def fragments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, fragment hash, first window, last window) of joined texts that end at `ends`; every window of a text is in one fragment."""
    none = np.zeros(0, np.uint64)
    if len(data) < length:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    sums = _hasher.sums(data)
    h = _grams(sums, gram)
    low = _window_min(h, length - gram + 1)
    starts = np.r_[0, ends[:-1]]
    long = ends - starts >= length
    starts, lasts = starts[long], ends[long] - length
    edge = np.zeros(len(low) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, lasts + 1, -1)
    valid = np.cumsum(edge)[: len(low)] > 0
    new = np.r_[True, low[1:] != low[:-1]]
    new[starts] = True
    first = np.flatnonzero(valid & new)
    text_end = lasts[np.searchsorted(starts, first, side="right") - 1] if len(first) else first
    last = np.minimum(text_end, np.r_[first[1:], len(low)][: len(first)] - 1)
    firsts, stops, anchors = [], [], []
    # within a run of windows of one minimum, the leftmost place of that hash owns the windows up to itself
    place, rounds = first.copy(), 0
    while len(first):
        rounds += 1
        if rounds > 32:  # the same hash comes again and again: all its places at once
            rest = _crowded_runs(h, low, first, last, place, length - gram)
            for held, x in zip((firsts, stops, anchors), rest, strict=True):
                held.append(x)
            break
        value = low[first]
        todo = np.flatnonzero(h[place] != value)
        while len(todo):
            place[todo] += 1
            todo = todo[h[place[todo]] != value[todo]]
        stop = np.minimum(last, place)
        firsts.append(first)
        stops.append(stop)
        anchors.append(place.copy())
        more = stop < last
        first, last, place = stop[more] + 1, last[more], place[more] + 1
    if not firsts:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    first, last, place = map(np.concatenate, (firsts, stops, anchors))
    whole = _hasher.ranges(sums, first, last + length) ^ ((place - first).astype(np.uint64) * _MIX)
    return h[place], whole, first, last


def _crowded_runs(h: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor) of the fragments of runs of windows of one minimum: each place of its hash ends one."""
    sizes = last + reach - place + 1
    run = np.repeat(np.arange(len(first)), sizes)
    at = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + place[run]
    hit = h[at] == low[first][run]
    run, at = run[hit], at[hit]
    start = np.where(np.r_[True, run[1:] != run[:-1]], first[run], np.r_[0, at[:-1]] + 1)
    own = start <= last[run]
    return start[own], np.minimum(at, last[run])[own], at[own]


def _grams(sums: np.ndarray, gram: int) -> np.ndarray:
    h = (sums[gram:] - sums[:-gram]) * _hasher.down[: len(sums) - gram]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


#: One packed record: anchor and fragment hash, document (order id, text hash), byte range.
RECORD = np.dtype([("h", "<u8"), ("c", "<u8"), ("o", "<i8"), ("r", "<i8"), ("s", "<i4"), ("e", "<i4")])
OPEN, GONE, COUNT = 0, 1, 2
_BLOBS = "_kind int, _g int, _n long, _blob binary"


def _pack(rec: np.ndarray, fields: tuple[str, ...]) -> bytes:
    """Columns one after the other: ids and places of one document compress well that way."""
    return b"".join(np.ascontiguousarray(rec[f]).tobytes() for f in fields)


def _unpack(blobs: list[bytes], counts: list[int], fields: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(sum(counts), RECORD)
    at = 0
    for blob, n in zip(blobs, counts, strict=True):
        offset = 0
        for f in fields:
            out[f][at : at + n] = np.frombuffer(blob, RECORD[f], n, offset)
            offset += n * RECORD[f].itemsize
        at += n
    return out


LIVE_FIELDS, OPEN_FIELDS, GONE_FIELDS = ("o", "r", "s", "e", "h", "c"), ("o", "r", "s", "e", "h"), ("o", "r", "s", "e")


def bucket_of(o: np.ndarray, r: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of documents, the same as bucket_column gives."""
    return ((o ^ (o >> 7) ^ r) & 0x7FFFFFFF) % buckets


def bucket_column(o, r, buckets: int):
    return (o.bitwiseXOR(F.shiftright(o, 7)).bitwiseXOR(r).bitwiseAND(F.lit(0x7FFFFFFF)) % buckets).cast("int")


def _dealt(rec: np.ndarray, to: np.ndarray, kind: int, fields: tuple[str, ...]):
    """(kind, group, rows, blob) of each group; the records keep their order within one."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False):
        part = rec[order[a:z]]
        yield kind, int(to[order[a]]), len(part), _pack(part, fields)


def _blob_table(rows) -> pa.Table:
    kind, g, n, blob = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), (), ())
    return pa.table({"_kind": pa.array(kind, pa.int32()), "_g": pa.array(g, pa.int32()), "_n": pa.array(n, pa.int64()), "_blob": pa.array(blob, pa.binary())})


def _first_of_equals(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records by (anchor, fragment, document, place), repeated rows of one document dropped; True where an equal fragment comes before."""
    rec = rec[np.lexsort((rec["s"], rec["r"], rec["o"], rec["c"], rec["h"]))]
    same = np.ones(max(0, len(rec) - 1), bool)
    for f in ("h", "c", "o", "r", "s"):
        same &= rec[f][1:] == rec[f][:-1]
    rec = rec[np.r_[True, ~same][: len(rec)]]
    return rec, np.r_[False, (rec["h"][1:] == rec["h"][:-1]) & (rec["c"][1:] == rec["c"][:-1])][: len(rec)]


def _joined(rec: np.ndarray) -> np.ndarray:
    """Byte ranges that are gone, in order of document and place, those that overlap or touch made one."""
    rec = rec[np.lexsort((rec["s"], rec["r"], rec["o"]))]
    if len(rec) < 2:
        return rec
    doc = np.cumsum(np.r_[0, (rec["o"][1:] != rec["o"][:-1]) | (rec["r"][1:] != rec["r"][:-1])]).astype(np.int64)
    reach = np.maximum.accumulate((doc << 32) + rec["e"])
    new = np.r_[True, (doc[1:] << 32) + rec["s"][1:] > reach[:-1]]
    at = np.flatnonzero(new)
    out = rec[at]
    out["e"] = reach[np.r_[at[1:], len(rec)] - 1] & 0xFFFFFFFF
    return out


def _is_in(h: np.ndarray, some: np.ndarray) -> np.ndarray:
    """some: sorted and distinct."""
    if not len(some):
        return np.zeros(len(h), bool)
    return some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h


def meeting_group(h: np.ndarray, c: np.ndarray, crowded: np.ndarray, groups: int) -> np.ndarray:
    """The meeting group of each fragment: by anchor, or by anchor and fragment where the anchor is crowded."""
    mixed = (h ^ (c * _MIX)) * np.uint64(_P)
    key = np.where(_is_in(h, crowded), mixed ^ (mixed >> np.uint64(32)), h)
    return (key % np.uint64(groups)).astype(np.int64)


def _text_slices(raw: list[bytes], length: int, size: int):
    """(number of the first text, its start in it, texts) of about `size` bytes; a longer text comes in slices that share length - 1 bytes, so each window is in one."""
    for lo, hi in byte_slices([len(t) for t in raw], size):
        if len(raw[lo]) <= size:
            yield lo, 0, raw[lo:hi]
        else:
            for a in range(0, max(1, len(raw[lo]) - length + 1), size):
                yield lo, a, [raw[lo][a : a + size + length - 1]]


def _surveyed(length: int, gram: int):
    def run(batches):
        """Distinct (anchor, fragment) hashes of each slice."""
        for b in batches:
            raw = [t.encode() for t in b.column(0).to_pylist()]
            for _, _, part in _text_slices(raw, length, CACHE_BYTES):
                h, c, *_ = fragments(np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(t) for t in part]), length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.unique(np.stack([h, c]), axis=1)], ["_h", "_c"])

    return run


def crowded_anchors(rows: DataFrame, length: int, gram: int, limit: int) -> np.ndarray:
    """Anchors with over `limit` distinct fragments, as estimated from one document in SURVEY."""
    some = rows.where(F.pmod(F.xxhash64("_o", "_r"), F.lit(SURVEY)) == 0).select("_t")
    found = some.mapInArrow(_surveyed(length, gram), "_h long, _c long").distinct().groupBy("_h").count().where(F.col("count") * SURVEY > limit)
    return np.sort(np.array([r["_h"] for r in found.select("_h").collect()], np.int64).view(np.uint64))


def _records(length: int, gram: int, groups: int, buckets: int, crowded: np.ndarray):
    def run(batches):
        """Packed fragments by a group of their anchor hash; those equal to an earlier one of the slice are gone already."""
        for b in batches:
            ids, rks, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            raw = [t.encode() for t in texts]
            for lo, hi in byte_slices([len(t) for t in raw], SLICE_BYTES):
                held, gone = [], []
                for x, at, part in _text_slices(raw[lo:hi], length, CACHE_BYTES):
                    ends = np.cumsum([len(t) for t in part])
                    h, c, first, last = fragments(np.frombuffer(b"".join(part), np.uint8), ends, length, gram)
                    doc = np.searchsorted(ends, first, side="right")
                    start = np.r_[0, ends[:-1]][doc] - at
                    rec = np.empty(len(h), RECORD)
                    rec["h"], rec["c"], rec["o"], rec["r"] = h, c, ids[lo + x + doc], rks[lo + x + doc]
                    rec["s"], rec["e"] = first - start, last + length - start
                    rec, again = _first_of_equals(rec)
                    held.append(rec[~again])
                    gone.append(_joined(rec[again]))
                rec, again = _first_of_equals(np.concatenate(held))
                live, gone = rec[~again], _joined(np.concatenate([*gone, rec[again]]))
                live = live[np.lexsort((live["s"], live["r"], live["o"]))]
                rows = [*_dealt(live, meeting_group(live["h"], live["c"], crowded, groups), OPEN, LIVE_FIELDS), *_dealt(gone, bucket_of(gone["o"], gone["r"], buckets), GONE, GONE_FIELDS)]
                yield from _blob_table(rows).to_batches()

    return run


def _meet(buckets: int, crowded: np.ndarray, many: int):
    def run(table: pa.Table) -> pa.Table:
        """Of equal fragments all but the first are gone; firsts of anchors with several fragments stay open.

        Anchors with over `many` open fragments are counted, crowded ones by the part that is in this group.
        """
        kinds = table.column("_kind").to_numpy()
        passed = table.filter(pa.array(kinds == GONE))
        live = table.filter(pa.array(kinds == OPEN))
        if not live.num_rows:
            return passed
        rec, again = _first_of_equals(_unpack(live.column("_blob").to_pylist(), live.column("_n").to_pylist(), LIVE_FIELDS))
        group = np.cumsum(np.r_[True, rec["h"][1:] != rec["h"][:-1]]) - 1
        n = np.bincount(group[~again], minlength=int(group[-1]) + 1)
        heads = rec["h"][np.flatnonzero(np.diff(group, prepend=-1))]
        split = _is_in(heads, crowded)  # others of the anchor are in other groups
        gone, open_ = rec[again], rec[~again & ((n > 1) | split)[group]]
        rows = [(COUNT, 0, int(n[i]), heads[i].tobytes()) for i in np.flatnonzero(split | (n > many)).tolist()]
        rows += [*_dealt(gone, bucket_of(gone["o"], gone["r"], buckets), GONE, GONE_FIELDS), *_dealt(open_, bucket_of(open_["o"], open_["r"], buckets), OPEN, OPEN_FIELDS)]
        return pa.concat_tables([passed.cast(_blob_table([]).schema), _blob_table(rows)])

    return run


def _by_document(rec: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], slice]]:
    """Records in order of document and place, and where each document's are."""
    rec = rec[np.lexsort((rec["s"], rec["r"], rec["o"]))]
    cuts = np.flatnonzero(np.r_[True, (rec["o"][1:] != rec["o"][:-1]) | (rec["r"][1:] != rec["r"][:-1])][: len(rec)])
    return rec, {(int(rec["o"][a]), int(rec["r"][a])): slice(a, z) for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rec)], strict=False)}


def _windows(rec: np.ndarray, cut: list[bytes], length: int):
    """Fragments dealt as windows: (hash, o, r, s, bytes) of the first of equal windows, (_, o, r, s, e) of runs of the later ones.

    rec: in order of document and place, as documents are ordered.
    """
    sizes = np.array([len(f) for f in cut], np.int64)
    base = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    of = np.repeat(np.arange(len(cut)), n)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = base[of] + inner
    text = np.frombuffer(b"".join(cut), np.uint8)
    h = _hasher.ranges(_hasher.sums(text), at, at + length)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)  # the first of each hash is the earliest
    first = first[inverse]
    later = np.flatnonzero(first != np.arange(len(h)))
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    again = np.zeros(len(h), bool)
    for a in range(0, len(later), 1 << 16):
        part = later[a : a + (1 << 16)]
        again[part] = (view[at[part]] == view[at[first[part]]]).all(axis=1)
    live = np.flatnonzero(~again)
    o, r, s = rec["o"][of], rec["r"][of], rec["s"][of] + inner
    new = again & np.r_[True, ~again[:-1] | (of[1:] != of[:-1])]
    a = np.flatnonzero(new)
    z = np.flatnonzero(again & np.r_[(~again[1:]) | (of[1:] != of[:-1]), True])
    raw = text.tobytes()
    pieces = [raw[x : x + length] for x in at[live].tolist()]
    return (h[live], o[live], r[live], s[live], pieces), (o[a], r[a], s[a], s[z] + length)


_CUT = "_h long, _w boolean, _o long, _r long, _s int, _e int, _f binary"


def _cut(length: int, hot: np.ndarray):
    def run(key, docs: pa.Table, opened: pa.Table) -> pa.Table:
        return _cut_bucket(docs, opened, length, hot)

    return run


def _cut_bucket(docs: pa.Table, opened: pa.Table, length: int, hot: np.ndarray) -> pa.Table:
    """Open fragments of a bucket of documents, with their bytes; those of hot anchors window by window.

    _w: a single window, its hash in _h. Without bytes: windows known to be gone, from _s to _e.
    """
    rec, of = _by_document(_unpack(opened.column("_blob").to_pylist(), opened.column("_n").to_pylist(), OPEN_FIELDS))
    texts, rows, cut = docs.column("_t"), [], []
    for i, d in enumerate(zip(docs.column("_o").to_pylist(), docs.column("_r").to_pylist(), strict=True)):
        if (at := of.pop(d, None)) is not None:  # rows equal in id and text are one document
            raw = texts[i].as_py().encode()
            rows.append(rec[at])
            cut += [raw[x:y] for x, y in zip(rec["s"][at].tolist(), rec["e"][at].tolist(), strict=True)]
    out = np.concatenate(rows) if rows else rec[:0]
    is_hot = _is_in(out["h"], hot)
    whole = out[~is_hot]
    parts = [(whole["h"], False, whole["o"], whole["r"], whole["s"], whole["e"], [f for f, w in zip(cut, is_hot.tolist(), strict=True) if not w])]
    if is_hot.any():
        order = np.flatnonzero(is_hot)
        order = order[np.lexsort((out["s"][order], out["r"][order], out["o"][order]))]
        (h, o, r, s, pieces), (go, gr, gs, ge) = _windows(out[order], [cut[i] for i in order.tolist()], length)
        parts += [(h, True, o, r, s, s + length, pieces), (go.view(np.uint64) * np.uint64(_P) ^ gs.astype(np.uint64), True, go, gr, gs, ge, [None] * len(go))]
    made = [pa.table({"_h": pa.array(np.ascontiguousarray(h).view(np.int64)), "_w": pa.array(np.full(len(o), w)), "_o": pa.array(o), "_r": pa.array(r, pa.int64()), "_s": pa.array(s.astype(np.int32)), "_e": pa.array(e.astype(np.int32)), "_f": pa.array(f, pa.binary())}) for h, w, o, r, s, e, f in parts]
    return pa.concat_tables(made)


def shard_order(text: np.ndarray, after: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of a shard's texts in order of their first `depth` characters, by prefix doubling from seven of them."""
    key = np.zeros(len(text), np.int64)
    at = np.arange(len(text))
    for _ in range(7):
        key = key << 8 | text[at]
        at = after[at]
    known = 7
    while True:
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        key = rank << 32 | rank[at]
        at = at[at]  # `known` places on, doubled
        known *= 2


def merge_transforms(text: np.ndarray, before: np.ndarray, shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards' transforms until `depth` characters are ordered.

    shards: each one's suffix positions in sorted order. Returns positions in merged order and the number of the
    block of equal `depth`-character prefixes that each is in.
    """
    cat = np.concatenate(shards).astype(np.int32)
    row = np.empty(len(text), np.int32)
    row[cat] = np.arange(len(cat), dtype=np.int32)
    # the transform of each row, as many characters wide as 16-bit ranks can tell apart, and where the longer suffix stands
    for width in (5, 4, 2, 1):
        if depth % width == 0:
            at, packed = cat, np.zeros(len(cat), np.int64)
            for k in range(width):
                at = before[at]
                packed |= text[at].astype(np.int64) << (8 * k)
            if width <= 2:
                transform = packed.astype(np.uint16)
                break
            values, transform = np.unique(packed, return_inverse=True)
            if len(values) <= 1 << 16:
                transform = transform.astype(np.uint16)
                break
    longer = row[at]
    interleave = np.arange(len(cat), dtype=np.int32)
    block = np.zeros(len(cat), np.int32)
    for _ in range(depth // width):
        key = transform[interleave]
        order = np.argsort(key, kind="stable")  # a radix pass
        key, block = key[order], block[order]
        new = np.r_[False, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]  # a boundary: the common prefix ends here
        interleave = longer[interleave[order]]
        block = np.cumsum(new, dtype=np.int32)
    return cat[interleave], block


def repeated_windows(frs: list[bytes], rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Per place of the joined fragments (each followed by one terminator): does its window stand in an earlier fragment or place?

    rank orders the fragments; places are ordered by (rank, offset).
    """
    sizes = np.array([len(f) + 1 for f in frs])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.zeros(ends[-1], np.uint8)
    blob = np.frombuffer(b"\0".join(frs) + b"\0", np.uint8)
    text[:] = blob + np.uint8(1)  # UTF-8 has no byte 0xFF
    text[ends - 1] = 0
    before, after = np.arange(len(text)) - 1, np.arange(len(text)) + 1
    before[starts], after[ends - 1] = ends - 1, starts
    shards = []
    for a, z in byte_slices(sizes.tolist(), SHARD_BYTES):
        base, stop = starts[a], ends[z - 1]
        shards.append(base + shard_order(text[base:stop], after[base:stop] - base, length))
    places, block = merge_transforms(text, before, shards, length)
    fragment = np.repeat(np.arange(len(frs)), sizes)
    room = ends[fragment] - 1 - np.arange(len(text)) >= length
    keep = room[places]
    places, block = places[keep], block[keep]
    order = np.lexsort((places - starts[fragment[places]], rank[fragment[places]], block))
    places, block = places[order], block[order]
    again = np.r_[False, block[1:] == block[:-1]][: len(block)]
    out = np.zeros(len(text), bool)
    out[places[again]] = True
    return out


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def _merge(length: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Windows of the open fragments that stand in an earlier fragment, as gone byte ranges by bucket of documents."""
        table, known = _still_open(table)
        passed = _dealt(known, bucket_of(known["o"], known["r"], buckets), GONE, GONE_FIELDS)
        who, rk, s = (table.column(k).to_numpy() for k in ("_o", "_r", "_s"))
        order = np.lexsort((s, rk, who))
        if not len(order):
            return _blob_table(passed)
        who, rk, s = who[order], rk[order], s[order]
        distinct = np.r_[True, (who[1:] != who[:-1]) | (rk[1:] != rk[:-1]) | (s[1:] != s[:-1])]  # rows equal in id and text
        who, rk, s = who[distinct], rk[distinct], s[distinct]
        frs = table.column("_f").take(pa.array(order[distinct])).to_pylist()
        # anchors share nothing, but one merge serves the whole group: windows of different anchors differ
        hit = repeated_windows(frs, np.arange(len(frs)), length)
        first, last = _runs(hit)  # a run ends before the terminator of its fragment at the latest
        starts = np.cumsum([0, *(len(f) + 1 for f in frs)])
        of = np.searchsorted(starts, first, side="right") - 1
        rec = np.zeros(len(first), RECORD)
        rec["o"], rec["r"] = who[of], rk[of]
        rec["s"], rec["e"] = s[of] + first - starts[of], s[of] + last - 1 - starts[of] + length
        return _blob_table([*passed, *_dealt(rec, bucket_of(rec["o"], rec["r"], buckets), GONE, GONE_FIELDS)])

    return run


def _still_open(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows to compare (single windows only if their hash comes more than once), and the byte ranges that are gone already."""
    bytes_, window = table.column("_f").is_valid().to_numpy(), table.column("_w").to_numpy()
    gone = table.filter(pa.array(~bytes_))
    known = np.zeros(gone.num_rows, RECORD)
    for f in GONE_FIELDS:
        known[f] = gone.column(f"_{f}").to_numpy()
    single = np.flatnonzero(bytes_ & window)
    _, inverse, n = np.unique(table.column("_h").to_numpy()[single], return_inverse=True, return_counts=True)
    keep = bytes_.copy()
    keep[single[n[inverse] == 1]] = False
    return table.filter(pa.array(keep)), known


def _finish(digest: bool):
    def run(key, docs: pa.Table, spans: pa.Table) -> pa.Table:
        """Documents of a bucket with the gone byte ranges of the bucket."""
        rec, of = _by_document(_unpack(spans.column("_blob").to_pylist(), spans.column("_n").to_pylist(), GONE_FIELDS))
        rows = []
        for o, r, t in zip(docs.column("_o").to_pylist(), docs.column("_r").to_pylist(), docs.column("_t").to_pylist(), strict=True):
            raw = t.encode()
            n_gone = n_runs = 0
            if (at := of.get((o, r))) is not None:
                spans_of = _joined(rec[at])
                n_gone, n_runs = int((spans_of["e"] - spans_of["s"]).sum(dtype=np.int64)), len(spans_of)
                kept = b"".join(raw[x:y] for x, y in zip([0, *spans_of["e"].tolist()], [*spans_of["s"].tolist(), len(raw)], strict=True))
            else:
                kept = raw
            rows.append((len(raw), n_gone, n_runs, hashlib.sha256(kept).hexdigest() if digest else kept))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({"_id": docs.column("_id"), **{k: pa.array(c, pa.int64()) for k, c in zip(("n_bytes", "n_removed", "n_spans"), cols, strict=False)}, ("kept_sha256" if digest else "kept"): pa.array(cols[3], pa.string() if digest else pa.binary())})

    return run


def text_number(text, seed: int):
    """Tells the texts of one id apart."""
    return F.xxhash64(F.lit(seed), text)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans and the kept bytes (binary), or kept_sha256 if digest.

    A byte goes when a string of `length` bytes (even, over GRAM) covers it that also starts earlier: in a document of
    smaller id, or in the same one further left; overlaps count, and strings are judged on the input. Matches never
    cross documents. Null text counts as empty; null ids come after all others. Rows with one id are ordered by
    a 64-bit hash of their text (another one is taken if two texts of an id share it), and rows equal in id and text
    are one document that comes out for each of them. Texts of any length are read as a whole, in overlapping
    slices. An empty table gives an empty result; other columns of docs are ignored, whatever their names. Ids are
    whole numbers. Equal fragments are told by two 64-bit hashes, 128 bits together; windows are compared bytewise.
    """
    if length % 2 or length <= GRAM:
        raise ValueError("length must be even and over the anchor's length")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_o")
    base = docs.select(F.col(id_col).alias("_id"), order, text_or_empty(text_col).alias("_t"))
    for seed in range(5):
        numbered = base.withColumn("_r", text_number(F.col("_t"), seed))
        rows = numbered.select("_o", "_r", "_t")
        # one pass measures the table and looks for texts of one id that share a number
        looked = rows.select("_o", "_r", F.octet_length("_t").cast("long").alias("_n"), F.xxhash64(F.lit("other"), "_t").alias("_x"))
        looked = looked.groupBy("_o", "_r").agg(F.sum("_n").alias("_n"), (F.min("_x") != F.max("_x")).alias("_two"))
        total, two = looked.agg(F.sum("_n"), F.bool_or("_two")).first()
        if not two:
            break
    else:
        raise RuntimeError("texts of one id share their numbers")
    base, total = numbered, total or 0
    groups = max(12, -(-2 * total // (length - GRAM) // MEET_RECORDS))
    buckets = max(12, -(-total // BUCKET_BYTES))
    limit = MEET_RECORDS // 8
    crowded = crowded_anchors(rows, length, GRAM, limit) if 2 * total // (length - GRAM) > limit else np.zeros(0, np.uint64)
    width = length + (length - GRAM) // 2
    many = SPLIT_BYTES // width
    records = rows.mapInArrow(_records(length, GRAM, groups, buckets, crowded), _BLOBS)
    # blobs of live fragments meet by anchor; those gone already travel along in groups of their own
    met = settle(records.groupBy("_kind", "_g").applyInArrow(_meet(buckets, crowded, many), _BLOBS))
    counted = met.where(F.col("_kind") == COUNT).groupBy("_blob").agg(F.sum("_n").alias("n")).where(F.col("n") > many).collect()
    hot = np.sort(np.frombuffer(b"".join(bytes(r["_blob"]) for r in counted), np.uint64))
    n_hot = sum(r["n"] for r in counted)
    opened = met.where(F.col("_kind") == OPEN)
    n_open = opened.agg(F.sum("_n")).first()[0] or 0
    # both cogroups deal the documents alike, so their one exchange serves both
    keyed = base.withColumn("_b", bucket_column(F.col("_o"), F.col("_r"), buckets))
    opened = opened.select(F.col("_g").alias("_b"), "_n", "_blob")
    frs = keyed.groupBy("_b").cogroup(opened.groupBy("_b")).applyInArrow(_cut(length, hot), _CUT)
    tasks = max(12, -(-(n_open - n_hot) * width // TASK_BYTES) - (-n_hot * (length - GRAM) // 2 // TASK_WINDOWS))
    merged = frs.groupBy(F.pmod(F.xxhash64("_h"), F.lit(tasks)).alias("_g")).applyInArrow(_merge(length, buckets), _BLOBS)
    spans = met.where(F.col("_kind") == GONE).unionByName(merged).select(F.col("_g").alias("_b"), "_n", "_blob")
    kind = docs.schema[id_col].dataType.simpleString()
    tail = "kept_sha256 string" if digest else "kept binary"
    out = keyed.groupBy("_b").cogroup(spans.groupBy("_b")).applyInArrow(_finish(digest), f"_id {kind}, n_bytes long, n_removed long, n_spans long, {tail}")
    return out.withColumnRenamed("_id", id_col)
