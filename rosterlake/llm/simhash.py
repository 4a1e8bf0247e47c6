"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64 majority bits over the XXH64 of word shingles. Distinct fingerprints are compared where
two of five bit blocks agree: a pair that differs in at most three bits leaves at least two blocks untouched,
so no link is lost. Within such a group the bits are stored vertically (one bit plane per position, one bit
per fingerprint); distances of many fingerprints are summed at once by carry-save counters over the XORed
planes, and a block of them is abandoned as soon as all its distances exceed the radius.

near_duplicates takes a wide radius for candidates, found by tables of sampled bits, and verifies each candidate by
the similarity of its word shingles.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_ROWS, broadcast_if_small, in_small_batches, releasing, row_key, settle
from .components import connected_components, forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Characters of a long text that are looked at at once.
SLICE_CHARS = 1 << 20
_GAP = re.compile(r"[\x20\x09-\x0D]")
#: Bit blocks (start, width); two of them agree when at most three bits differ.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints with one key beyond which the group is split into chunks, compared chunk by chunk.
CHUNK = 4096
PLANES_AT_ONCE = 8
#: Links up to which the driver finds the classes by itself (16 bytes each); more take rounds of joins.
LINKS_AT_ONCE = 1 << 18
#: Fingerprints that a key of a sampled table holds on average.
TABLE_ROWS = 16
#: Spanning forests without common links that are verified of each key first. All links that still span two classes follow, so the number changes the work alone.
FORESTS = 1
#: Bits of the parity sketch of a shingle set: bit i is set if an odd number of hashes fall on it.
ODD_BITS = 256
#: Words of a text's record when it is dealt: number, class, size, cell, fingerprint and the sketch.
RECORD = 5 + ODD_BITS // 64
#: Records that are made at once.
DEAL_ROWS = 1 << 16
#: Bits of a segment of a key filter, and the bytes that a filter may take.
SEGMENT_BITS, FILTER_BYTES = 4096, 32 << 20
#: Bits in which the fingerprints of near duplicates may differ, and how surely a pair at a somewhat smaller distance meets.
WIDE_RADIUS, SURE_RADIUS, RECALL = 12, 10, 0.99


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half the shingle hashes; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for words in word_slices(text, shingle):
        found, m = _bit_counts(words, shingle)
        ones += found
        n += m
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def word_slices(text: str, shingle: int, size: int = SLICE_CHARS):
    """Words of a text, slice by slice; a slice opens with the last words of the one before, so each shingle is in one."""
    at, carry, some = 0, [], False
    while at < len(text):
        gap = _GAP.search(text, at + size) if len(text) > at + size else None
        stop = gap.start() if gap else len(text)
        words = carry + WORD.findall(text[at:stop].translate(_LOWER))
        at = stop
        if len(words) >= shingle:
            yield words
            some, words = True, words[len(words) - shingle + 1 :]
        carry = words
    if carry and not some:
        yield carry


def _bit_counts(words: list[str], shingle: int) -> tuple[np.ndarray, int]:
    """How many of the shingles' hashes have each bit, and how many shingles there are."""
    ones, hashes = np.zeros(64, np.int64), _hashes(words, shingle)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones, len(hashes)


def _hashes(words: list[str], shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, joined by a space; of fewer words one hash."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    blob = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(blob == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    k = min(shingle, len(words))
    h, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((h(view[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, len(words) - k + 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            texts = b.column(1)
            fps = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), _signed(fps), *b.columns[2:]], ["_id", "_fp", *b.schema.names[2:]])

    return run


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) planes: bit j of plane i is bit i of fingerprint j."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(fps) % 64
    return np.packbits(np.pad(bits, ((0, pad), (0, 0))).T.copy(), axis=1, bitorder="little").view("<u8")


def within(diff, n_words: int, radius: int) -> np.ndarray:
    """Bitmask of the places with at most `radius` set planes. diff(planes, words) gives XORed planes of some words."""
    live = np.arange(n_words)
    over = np.zeros(n_words, np.uint64)
    count = [over.copy() for _ in range(max(1, radius.bit_length()))]
    for first in range(0, 64, PLANES_AT_ONCE):
        x = diff(slice(first, first + PLANES_AT_ONCE), live)
        for carry in x:  # carry-save: a counter of a few bit planes and a sticky overflow
            for b in range(len(count)):
                carry, count[b] = count[b] & carry, count[b] ^ carry
            over |= carry
        done = over == ~np.uint64(0)
        if done.any():
            keep = ~done
            live, over, count = live[keep], over[keep], [c[keep] for c in count]
            if not len(live):
                break
    out = np.zeros(n_words, np.uint64)
    less, equal = np.zeros(len(live), np.uint64), ~over
    for b in reversed(range(len(count))):  # compare the counters with the radius, highest bit first
        if radius >> b & 1:
            less |= equal & ~count[b]
            equal &= count[b]
        else:
            equal &= ~count[b]
    out[live] = less | equal
    return out


def _unpack(mask: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(mask.astype("<u8").view(np.uint8), bitorder="little")[:n].astype(bool)


def links_in_runs(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs for sorted runs of up to 64 fingerprints: the planes against themselves, shifted by 1, 2, ..."""
    left, right = [], []
    n, shift = len(fps), 1
    index = np.arange(n)
    while True:
        near = np.flatnonzero(run[shift:] == run[: n - shift]) if n > shift else index[:0]
        if not len(near):
            break
        a, b = bit_planes(fps[near]), bit_planes(fps[near + shift])
        hit = near[_unpack(within(lambda p, w, a=a, b=b: a[p][:, w] ^ b[p][:, w], a.shape[1], radius), len(near))]
        left.append(index[hit])
        right.append(index[hit + shift])
        shift += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (index[:0], index[:0])


def links_in_group(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large group: breadth-first, each fingerprint against the planes of those not yet reached."""
    planes, n = bit_planes(fps), len(fps)
    ones = ~np.uint64(0)
    open_ = np.ones(n, bool)
    left, right = [], []
    bits = ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool)
    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            flip = np.where(bits[i], ones, np.uint64(0))[:, None]
            hit = np.flatnonzero(_unpack(within(lambda p, w, f=flip: planes[p][:, w] ^ f[p], planes.shape[1], radius), n) & open_)
            if len(hit):
                open_[hit] = False
                left.append(np.full(len(hit), i))
                right.append(hit)
                todo += hit.tolist()
    none = np.array([], int)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _linked_groups(fps: np.ndarray, keys: np.ndarray, radius: int):
    """(left, right) index arrays of linked fingerprints of each key: all links of keys of up to 64, spanning ones of larger keys, one pair of arrays per such key."""
    run_of = np.cumsum(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if len(fps) else np.array([], int)
    cuts = np.flatnonzero(np.diff(run_of, prepend=0))
    lengths = np.diff(np.r_[cuts, len(fps)])
    small = np.repeat(lengths <= 64, lengths) if len(fps) else np.array([], bool)
    at = np.flatnonzero(small)
    a, b = links_in_runs(fps[at], run_of[at], radius)
    yield at[a], at[b]
    for c, m in zip(cuts[lengths > 64], lengths[lengths > 64], strict=True):
        a, b = links_in_group(fps[c : c + m], radius)
        yield c + a, c + b


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        """Rows of many keys: spanning links of each key's fingerprints."""
        fps = table.column("_fp").to_numpy().view(np.uint64)
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("_table", "_key", "_cell")])
        order = np.lexsort((fps, *keys[::-1]))
        fps, keys = fps[order], keys[:, order]
        u, v = zip(*((fps[a], fps[b]) for a, b in _linked_groups(fps, keys, radius)), strict=True)
        x, y = forest(np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64))
        return pa.table({"u": pa.array(x, pa.int64()), "v": pa.array(y, pa.int64())})

    return run


def nearest_forest(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the links of a minimum spanning forest over nodes 0..n-1: every tree takes its shortest link out, until none is left."""
    number = np.argsort(d, kind="stable")
    u, v, label, kept = u[number], v[number], np.arange(n), []
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return np.concatenate(kept) if kept else np.zeros(0, np.int64)
        u, v, a, b, number = u[open_], v[open_], a[open_], b[open_], number[open_]
        first = np.full(n, len(u))
        at = np.arange(len(u))
        np.minimum.at(first, a, at)
        np.minimum.at(first, b, at)
        chosen = np.unique(first[first < len(u)])
        kept.append(number[chosen])
        nodes, low = forest(a[chosen], b[chosen])
        root = np.arange(n)
        root[nodes] = low
        label = root[label]


def _near_links(fps: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v) of the shortest links that hold each key's fingerprints together at the radius, FORESTS times over, and a row of each key that may have further links. Rows in order of their keys."""
    parts = [p for r in sorted({radius // 4, radius // 2, 3 * radius // 4, radius}) for p in _linked_groups(fps, keys, r)]
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    d, rest, picked = np.bitwise_count(fps[a] ^ fps[b]), np.arange(len(a)), []
    for _ in range(FORESTS):
        pick = rest[nearest_forest(a[rest], b[rest], d[rest], len(fps))]
        picked.append(pick)
        low, high = np.minimum(a, b), np.maximum(a, b)
        rest = rest[~np.isin(low[rest] * len(fps) + high[rest], low[pick] * len(fps) + high[pick])]
    pick = np.concatenate(picked)
    u, v = fps[a[pick]].view(np.int64), fps[b[pick]].view(np.int64)
    first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if len(fps) else np.zeros(0, np.int64)
    run = np.searchsorted(first, a, side="right") - 1
    large = np.diff(np.r_[first, len(fps)]) > 64  # of these _linked_groups gives spanning links only
    more = np.zeros(len(first), bool)
    more[run[rest]] = True
    more[run[large[run]]] = True
    return np.maximum(u, v), np.minimum(u, v), first[more]


def groups_of(rows: int) -> int:
    """Groups of about GROUP_ROWS, 12 at least."""
    return max(12, -(-rows // GROUP_ROWS))


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps: distinct, settled (_fp long). Spanning links (u, v) of the graph of all pairs at `radius` or fewer differing bits."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    agree = len(BLOCKS) - radius
    tables = list(combinations(range(len(BLOCKS)), agree))
    piece = lambda start, width: F.shiftrightunsigned("_fp", start).bitwiseAND(F.lit((1 << width) - 1))
    keys = []
    for blocks in tables:
        key, shift = F.lit(0).cast("long"), 0
        for k in blocks:
            if shift + BLOCKS[k][1] > 63:  # the key need not hold every block: fewer bits only widen the group
                break
            key = key.bitwiseOR(F.shiftleft(piece(*BLOCKS[k]), shift))
            shift += BLOCKS[k][1]
        keys.append(key)
    groups = groups_of(fps.count() * len(tables))
    placed = fps.select("_fp", F.posexplode(F.array(*keys)).alias("_table", "_key"))
    hot = placed.groupBy("_table", "_key").count().where(F.col("count") > CHUNK).select("_table", "_key", F.ceil(F.col("count") / CHUNK).cast("int").alias("_c"))
    hot = settle(hot.coalesce(groups))
    # a hot key is cut into chunks; each pair of chunks is a cell of its own
    placed = placed.join(hot, ["_table", "_key"], "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
    return _in_cells(placed, F.lit(groups)).applyInArrow(_compare(radius), "u long, v long").coalesce(4 * groups)  # most partitions have no group; a few more than groups, so that few tasks get two


def sampled_tables(n: int, radius: int, recall: float, seed: int = 11) -> list[int]:
    """Masks of so many sampled bits that a key holds about TABLE_ROWS of n fingerprints, and so many of them that a pair at the radius agrees in one with that probability."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / TABLE_ROWS)), 6, 48))
    agree = np.prod([(64 - radius - i) / (64 - i) for i in range(bits)])
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]


def _deal(masks: list[int], groups: int):
    def run(batches):
        """Fingerprints with their tables, packed by a group of their keys."""
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            table = np.repeat(np.arange(len(masks), dtype=np.uint16), len(fps))
            every = np.tile(fps, len(masks))
            h = (every & np.repeat(np.array(masks, np.uint64), len(fps))) + table * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            g = ((h ^ (h >> np.uint64(32))) % np.uint64(groups)).astype(np.int32)
            order = np.lexsort((table, g))
            g, table, every = g[order], table[order], every[order]
            cuts = np.flatnonzero(np.diff(g, prepend=-1)).tolist()
            ends = [*cuts[1:], len(g)]
            yield pa.RecordBatch.from_arrays([pa.array(g[cuts]), *(pa.array([x[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary()) for x in (table, every))], ["_g", "_tables", "_fps"])

    return run


def _compare_dealt(masks: list[int], radius: int, chunk: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of a group's keys. Keys with further links come out as table, key and number of chunks; of those of over `chunk` fingerprints nothing else does."""
        of = np.frombuffer(b"".join(table.column("_tables").to_pylist()), np.uint16)
        fps = np.frombuffer(b"".join(table.column("_fps").to_pylist()), np.uint64)
        key = fps & np.array(masks, np.uint64)[of]
        order = np.lexsort((fps, key, of))
        of, fps, key = of[order], fps[order], key[order]
        start = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[start, len(fps)])
        hot = size > chunk
        mine = np.repeat(~hot, size)
        u, v, more = _near_links(fps[mine], np.stack([of[mine].astype(np.int64), key[mine].view(np.int64)]), radius)
        none = lambda kind: pa.nulls(len(u), kind)
        links = pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "_table": none(pa.int32()), "_key": none(pa.int64()), "_c": none(pa.int32())})
        at = np.r_[start[hot], np.flatnonzero(mine)[more]]
        chunks = np.r_[-(-size[hot] // chunk), np.ones(len(more), np.int64)]
        rest = pa.table({"u": pa.nulls(len(at), pa.int64()), "v": pa.nulls(len(at), pa.int64()), "_table": pa.array(of[at].astype(np.int32)), "_key": pa.array(key[at].view(np.int64)), "_c": pa.array(chunks, pa.int32())})
        return pa.concat_tables([links, rest])

    return run


def _compare_cells(radius: int):
    def run(table: pa.Table) -> pa.Table:
        fps = table.column("_fp").to_numpy().view(np.uint64)
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("_table", "_key", "_cell")])
        order = np.lexsort((fps, *keys[::-1]))
        u, v, _ = _near_links(fps[order], keys[:, order], radius)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _key_hashes(table, key: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each table and key (uint64)."""
    h = key + np.uint64(0x9E3779B97F4A7C15) * np.atleast_1d(np.asarray(table, np.uint64))
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment of a key filter that a hash belongs to, and its two bits there."""
    bits = np.uint64(SEGMENT_BITS)
    return ((h >> np.uint64(32)) % np.uint64(segments)).astype(np.int64), (h % bits).astype(np.int64), (h // bits % bits).astype(np.int64)


def _segment_of(segments: int):
    def run(batches):
        for b in batches:
            h = _key_hashes(b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(_places(h, segments)[0], pa.int64()), _signed(h)], ["_segment", "_h"])

    return run


def _fill_segment(segments: int):
    def run(table: pa.Table) -> pa.Table:
        _, x, y = _places(table.column("_h").to_numpy().view(np.uint64), segments)
        bits = np.zeros(SEGMENT_BITS, np.uint8)
        bits[x] = bits[y] = 1
        return pa.table({"_segment": table.column("_segment")[:1], "_bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


def key_filter(keys: DataFrame) -> np.ndarray:
    """keys: settled (_table int, _key long). Bits by segment that say of each of the keys that it is there, and of few others.

    A key takes 16 bits; from FILTER_BYTES on there are no more, and others pass more often.
    """
    segments = int(np.clip(-(-keys.count() * 16 // SEGMENT_BITS), 1, FILTER_BYTES * 8 // SEGMENT_BITS))
    dealt = keys.select("_table", "_key").mapInArrow(_segment_of(segments), "_segment long, _h long")
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    got = dealt.groupBy("_segment").applyInArrow(_fill_segment(segments), "_segment long, _bits binary").toArrow()
    for k, bits in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        out[k] = np.frombuffer(bits, np.uint8)
    return out


def _passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    k, x, y = _places(h, len(filter_))
    return (filter_[k, x >> 3] >> (x & 7) & filter_[k, y >> 3] >> (y & 7) & 1).astype(bool)


def _deal_texts(masks: list[int], groups: int, filter_: np.ndarray | None, hot: tuple[np.ndarray, np.ndarray] | None):
    """filter_: of the keys whose texts are dealt. hot instead: sorted hashes of keys and their numbers of chunks; each pair of chunks is a cell of its own."""

    def run(batches):
        """Records of RECORD words (number, class, size, cell, fingerprint, sketch) of the texts of those keys, packed by a group of keys."""
        at_once = max(1, DEAL_ROWS // len(masks))
        for b in (b.slice(k, at_once) for b in batches for k in range(0, b.num_rows, at_once)):
            n, fps, label, size = (b.column(k).to_numpy().view(np.uint64) for k in range(4))
            odd = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(len(n), -1)
            rows, tables, cells, at = [], [], [], []
            for t, m in enumerate(masks):
                h = _key_hashes(t, fps & np.uint64(m))
                if hot is None:
                    i = np.flatnonzero(_passes(filter_, h))
                    cell = np.zeros(len(i), np.uint64)
                else:
                    k = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
                    i = np.flatnonzero(hot[0][k] == h)
                    c = hot[1][k[i]]
                    other = (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64)
                    i, c = np.repeat(i, c), np.repeat(c, c).astype(np.uint64)
                    mine = _key_hashes(0, n[i]) % c
                    cell = np.minimum(mine, other) * c + np.maximum(mine, other)
                rows.append(i)
                tables.append(np.full(len(i), t, np.uint16))
                cells.append(cell)
                at.append((_key_hashes(cell, h[i]) % np.uint64(groups)).astype(np.int32))
            i, table, cell, g = (np.concatenate(x) for x in (rows, tables, cells, at))
            if not len(i):
                continue
            order = np.argsort(g, kind="stable")
            i, table, cell, g = i[order], table[order], cell[order], g[order]
            records = np.column_stack([n[i], label[i], size[i], cell, fps[i], odd[i]])
            cuts = np.flatnonzero(np.diff(g, prepend=-1)).tolist()
            ends = [*cuts[1:], len(g)]
            yield pa.RecordBatch.from_arrays([pa.array(g[cuts]), *(pa.array([x[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary()) for x in (table, records))], ["_g", "_tables", "_records"])

    return run


def _compare_classes(masks: list[int], radius: int, least: float, chunk: int | None):
    def run(table: pa.Table) -> pa.Table:
        """All pairs of a key's texts of different classes within the radius whose sketches allow the similarity. Keys of over `chunk` texts come out as table, key and number of chunks instead.

        Of two sets at the similarity at most (1 - least) / (1 + least) of their sizes' sum lies in one alone, and each
        bit in which the parity sketches differ stands for one such hash or more: no pair at it is left out.
        """
        of = np.frombuffer(b"".join(table.column("_tables").to_pylist()), np.uint16)
        records = np.frombuffer(b"".join(table.column("_records").to_pylist()), np.uint64).reshape(len(of), RECORD)
        key = records[:, 4] & np.array(masks, np.uint64)[of]
        order = np.lexsort((records[:, 4], records[:, 3], key, of))
        of, key, records = of[order], key[order], records[order]
        ids, label, size = (records[:, k].view(np.int64) for k in range(3))
        cell, fps, odd = records[:, 3], np.ascontiguousarray(records[:, 4]), records[:, 5:]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        lengths = np.diff(np.r_[first, len(fps)])
        run_of = np.repeat(np.arange(len(first)), lengths)
        hot = lengths > (chunk or len(fps))
        found = []

        def keep(a, b):
            a, b = a[label[a] != label[b]], b[label[a] != label[b]]
            both = size[a] + size[b]
            apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
            fits = (apart <= both * (1 - least) / (1 + least) + 1e-6) & (np.minimum(size[a], size[b]) >= np.maximum(size[a], size[b]) * least - 1e-6)
            found.append((np.maximum(ids[a[fits]], ids[b[fits]]), np.minimum(ids[a[fits]], ids[b[fits]])))

        at = np.flatnonzero(np.repeat((lengths <= 64) & ~hot, lengths))
        a, b = links_in_runs(fps[at], run_of[at], radius)
        keep(at[a], at[b])
        ones = ~np.uint64(0)
        large = (lengths > 64) & ~hot
        for c, m in zip(first[large], lengths[large], strict=True):
            planes = bit_planes(fps[c : c + m])
            bits = ((fps[c : c + m, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool)
            for i in range(m - 1):
                flip = np.where(bits[i], ones, np.uint64(0))[:, None]
                hit = np.flatnonzero(_unpack(within(lambda p, w, f=flip, all_=planes: all_[p][:, w] ^ f[p], planes.shape[1], radius), m)[i + 1 :]) + c + i + 1
                keep(np.full(len(hit), c + i), hit)
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        none = lambda n, kind: pa.nulls(n, kind)
        pairs = pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}).group_by(["u", "v"]).aggregate([])
        pairs = pairs.append_column("_table", none(len(pairs), pa.int32())).append_column("_key", none(len(pairs), pa.int64())).append_column("_c", none(len(pairs), pa.int32()))
        again = first[hot]
        rest = pa.table({"u": none(len(again), pa.int64()), "v": none(len(again), pa.int64()), "_table": pa.array(of[again].astype(np.int32)), "_key": pa.array(key[again].view(np.int64)), "_c": pa.array((-(-lengths[hot] // chunk) if len(again) else again).astype(np.int32))})
        return pa.concat_tables([pairs, rest])

    return run


def _keys_of(fp: str, masks: list[int]):
    return F.array(*(F.col(fp).bitwiseAND(_as_long(m)) for m in masks))


def _as_long(m: int):
    return F.lit(m - (1 << 64) if m >> 63 else m).cast("long")


def candidate_links(fps: DataFrame, radius: int, sure: int, recall: float) -> tuple[DataFrame, DataFrame, list[int]]:
    """fps: distinct, settled (_fp long). Distinct links (u, v), u > v, at `radius` or fewer differing bits: of each key of sampled bits those of FORESTS spanning forests, the shortest first.

    A pair at `sure` bits shares a key with probability `recall`. Fingerprints are dealt packed, tens of tables in one
    pass; only keys of over CHUNK of them are dealt again, chunk by chunk. Also the keys that may have further links
    (_table, _key and _c, their number of chunks), and the masks of the tables.
    """
    n = fps.count()
    masks = sampled_tables(n, sure, recall)
    groups = max(12, -(-n * len(masks) // GROUP_ROWS))
    dealt = fps.select("_fp").mapInArrow(releasing(_deal(masks, groups)), "_g int, _tables binary, _fps binary")
    found = dealt.groupBy("_g").applyInArrow(_compare_dealt(masks, radius, CHUNK), "u long, v long, _table int, _key long, _c int")
    found = settle(found.coalesce(4 * groups))  # as in fingerprint_links
    links, more = found.where("u IS NOT NULL").select("u", "v"), found.where("u IS NULL").select("_table", "_key", "_c")
    hot = more.where("_c > 1")
    if not hot.isEmpty():
        placed = fps.select("_fp", F.posexplode(_keys_of("_fp", masks)).alias("_table", "_key")).join(broadcast_if_small(hot, 32), ["_table", "_key"])
        links = links.unionByName(_in_cells(placed, F.lit(groups)).applyInArrow(_compare_cells(radius), "u long, v long"))
    return links.distinct(), more, masks


def remaining_links(links: DataFrame, more: DataFrame, masks: list[int], texts: DataFrame, radius: int, least: float) -> DataFrame:
    """Pairs (u, v) of texts of different classes that meet in a table within the radius, less those that can't be at `least`.

    links: verified links (a, b) of texts by number. more: keys that may have further ones. texts: settled (_n, _fp,
    _many: the fingerprint has several texts, _label: class by the verified links, _size, _odd). A key whose links all
    lie within classes has nothing left to find: its forests span it. So only keys with a link between two classes are
    dealt again; a filter that reaches every task tells them, and what passes it by chance finds nothing. Texts are
    dealt packed with what is compared, so no join makes a row of each text and table.
    """
    side = lambda c: texts.select(F.col("_n").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("_fp", "_many", "_label")))
    cross = links.join(side("a"), "a").join(side("b"), "b").where("_label_a <> _label_b")
    cross = cross.select(F.col("_fp_a").alias("_fp"), F.col("_fp_a").bitwiseXOR(F.col("_fp_b")).alias("_diff"), (F.col("_many_a") | F.col("_many_b")).alias("_many"))
    tables = F.array(*(F.struct(F.lit(t).alias("t"), _as_long(m).alias("m")) for t, m in enumerate(masks)))
    met = cross.select("_fp", "_many", F.explode(F.filter(tables, lambda tm: F.col("_diff").bitwiseAND(tm["m"]) == 0)).alias("_tm"))
    met = met.select(F.col("_tm.t").alias("_table"), F.col("_fp").bitwiseAND(F.col("_tm.m")).alias("_key"), "_many").groupBy("_table", "_key").agg(F.max("_many").alias("_many"))
    groups = max(12, -(-texts.count() * len(masks) // GROUP_ROWS))
    keys = met.join(more.withColumnRenamed("_c", "_chunks"), ["_table", "_key"], "left").where("_many OR _chunks IS NOT NULL").select("_table", "_key")
    keys = settle(keys.coalesce(groups))
    if keys.isEmpty():
        return links.sparkSession.createDataFrame([], "u long, v long")

    def compared(filter_, hot, chunk):
        dealt = texts.select("_n", "_fp", "_label", "_size", "_odd").mapInArrow(releasing(_deal_texts(masks, groups, filter_, hot)), "_g int, _tables binary, _records binary")
        return settle(dealt.groupBy("_g").applyInArrow(_compare_classes(masks, radius, least, chunk), "u long, v long, _table int, _key long, _c int").coalesce(4 * groups))

    found = compared(key_filter(keys), None, CHUNK)
    pairs = found.where("u IS NOT NULL").select("u", "v")
    hot = found.where("u IS NULL").select("_table", "_key", "_c").toArrow()  # each stands for over CHUNK texts
    if hot.num_rows:
        h = _key_hashes(hot.column(0).to_numpy().astype(np.uint64), hot.column(1).to_numpy().view(np.uint64))
        order = np.argsort(h)
        pairs = pairs.unionByName(compared(None, (h[order], hot.column(2).to_numpy().astype(np.int64)[order]), None).select("u", "v"))
    return pairs.distinct()


def _in_cells(placed: DataFrame, groups):
    """Rows of keys of _c chunks, each pair of chunks a cell of its own, grouped for comparison."""
    placed = placed.withColumn("_a", F.pmod(F.xxhash64("_fp"), F.col("_c")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda b: F.least(F.col("_a"), b) * F.col("_c") + F.greatest(F.col("_a"), b))
    placed = placed.select("_fp", "_table", "_key", F.explode(cell).alias("_cell"))
    return placed.withColumn("_g", F.pmod(F.xxhash64("_table", "_key", "_cell"), groups)).groupBy("_g")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, kept.

    A-Z is lower-cased, words are runs of [^\\x20\\x09-\\x0D], shingles are joined by one space; a text of fewer
    words is one shingle, a text without words (empty or null) has fingerprint zero and links like any other.
    component_id is the smallest id reachable by links of at most `radius` differing bits; rows with a null id
    take the component of their fingerprint (null if no id is in it). kept marks the row that is its
    component's smallest id; rows repeating that id share the mark, and so do null ids of a component without ids. Equal fingerprints meet once, as one.
    Ids may be of any orderable type. Texts of any length are read as a whole, slice by slice. An empty table gives an
    empty result; other columns of docs are ignored, whatever their names.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = settle(in_small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(releasing(_fingerprints(shingle)), f"_id {kind}, _fp long"))
    # a settled partition is a file and each file of a local store starts processes, so no more of them than the rows need
    distinct = settle(rows.groupBy("_fp").agg(F.min("_id").alias("_low")).coalesce(groups_of(rows.count())))
    links = settle(fingerprint_links(distinct.select("_fp"), radius))  # else each task keeps two Python workers at once
    nodes = connected_components(links, at_once=LINKS_AT_ONCE)
    classes = distinct.join(nodes.select(F.col("node").alias("_fp"), F.col("component").alias("_root")), "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    lows = classes.groupBy("_root").agg(F.min("_low").alias("_comp"))
    out = rows.join(classes.join(lows, "_root").select("_fp", "_comp"), "_fp")
    return out.select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.col("_comp").alias("component_id"),
        F.col("_id").eqNullSafe(F.col("_comp")).alias("kept"),
    )


def _shingle_sets(shingle: int):
    def run(batches):
        for b in batches:
            sets = []
            for t in b.column(1).to_pylist():
                parts = [_hashes(words, shingle) for words in word_slices(t or "", shingle)]
                sets.append(np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64))
            odd = [np.packbits(np.bincount(s & (ODD_BITS - 1), minlength=ODD_BITS) & 1).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(odd, pa.binary())], ["_n", "_s", "_odd"])

    return run


def _similar(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links (a, b) whose sets have at least that Jaccard similarity, as (u, v)."""
    both = links.join(sets.select(F.col("_n").alias("a"), F.col("_s").alias("_sa")), "a").join(sets.select(F.col("_n").alias("b"), F.col("_s").alias("_sb")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("_i"), (F.size("_sa") + F.size("_sb")).alias("_z"))
    return settle(shared.where((F.col("_z") == 0) | (F.col("_i") / F.nullif(F.col("_z") - F.col("_i"), F.lit(0)) >= least)).select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = WIDE_RADIUS, sure: int = SURE_RADIUS, recall: float = RECALL) -> DataFrame:
    """One row per input row: id, component (the number of its class), kept, and _rk1, _rk2 of row_key.

    Two texts link when the Jaccard similarity of their sets of `shingle`-word shingles (A-Z lower-cased) is at least
    `least`; a text of fewer words is one shingle, texts without words are alike. Candidates are texts whose SimHash
    fingerprints (of three-word shingles) differ in at most `radius` bits; each is verified by its whole sets. The
    search is not exact: a pair at `sure` bits meets with probability `recall`, nearer ones more surely, and pairs of a
    similarity just above `least` may lie beyond the radius. Of texts that meet no link is lost: first those are
    verified that hold them together by the shortest distances, then all between texts that are still
    of different classes, less those whose sketches exclude the similarity. kept marks the rows of one (id, text) of each class, of the smallest id the one of
    smallest hash; null ids come last. Equal texts are one node, known by a 64-bit hash. Null text counts as empty.
    An empty table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = in_small_batches(docs).select(F.col(id_col).alias("_id"), text.alias("_t"), *row_key(id_col, text_col), F.xxhash64(text).alias("_n"))
    made = settle(rows.mapInArrow(releasing(_fingerprints(3)), f"_id {kind}, _fp long, _rk1 long, _rk2 long, _n long"))
    # the driver keeps a record of each task, so frames of short rows are settled in no more partitions than the rows need
    few = groups_of(made.count())
    nodes = settle(made.groupBy("_fp").agg(F.min("_n").alias("_low"), F.count_distinct("_n").alias("_k")).coalesce(few))
    far, more, masks = candidate_links(nodes.select("_fp"), radius, sure, recall)
    lows = nodes.select("_fp", "_low")
    far = far.join(lows.select(F.col("_fp").alias("u"), F.col("_low").alias("a")), "u").join(lows.select(F.col("_fp").alias("v"), F.col("_low").alias("b")), "v").select("a", "b")
    equal = made.join(nodes.where("_k > 1").select("_fp", "_low"), "_fp").where("_n <> _low").select(F.col("_low").alias("a"), F.col("_n").alias("b")).distinct()
    links = settle(far.unionByName(equal).coalesce(few))
    met = settle(links.select(F.col("a").alias("_n")).unionByName(links.select(F.col("b").alias("_n"))).distinct().coalesce(few))
    wanted = rows.join(broadcast_if_small(met, 16), "_n", "left_semi").groupBy("_n").agg(F.first("_t").alias("_t"))
    sets = settle(wanted.select("_n", "_t").mapInArrow(releasing(_shingle_sets(shingle)), "_n long, _s array<long>, _odd binary"))
    similar = _similar(links, sets, least)
    classes = settle(connected_components(similar, at_once=LINKS_AT_ONCE).coalesce(few))  # settled, as the driver would else keep its rows
    label = classes.select(F.col("node").alias("_n"), F.col("component").alias("_label"))
    texts = sets.select("_n", F.size("_s").cast("long").alias("_size"), "_odd").join(made.select("_n", "_fp").distinct(), "_n")
    texts = texts.join(nodes.select("_fp", (F.col("_k") > 1).alias("_many")), "_fp").join(label, "_n", "left").withColumn("_label", F.coalesce("_label", "_n"))
    texts = settle(texts.coalesce(few))
    left = settle(remaining_links(links, more, masks, texts, radius, least).select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(few))
    if not left.isEmpty():
        again = _similar(left, sets, least)
        classes = connected_components(classes.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(again), at_once=LINKS_AT_ONCE)
    named = made.join(classes.select(F.col("node").alias("_n"), F.col("component").alias("_c")), "_n", "left").withColumn("_c", F.coalesce("_c", "_n"))
    named = settle(named.coalesce(few))
    first = named.groupBy("_c").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_rk1", "_rk2")).alias("_one"))
    out = named.join(first, "_c")
    mine = (F.col("_rk1") == F.col("_one._rk1")) & (F.col("_rk2") == F.col("_one._rk2"))
    return out.select(F.col("_id").alias(id_col), F.col("_c").alias("component"), mine.alias("kept"), "_rk1", "_rk2")
