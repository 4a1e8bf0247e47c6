"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes by one array lookup. A small automaton over the classes follows the token kinds
of the split pattern; its per-character transition functions form a finite monoid, so the state at every
character comes from an associative scan of function ids (blocks, then block totals), without a regex.
Boundaries follow from neighbouring states. The slices between them are looked up, all of a batch at once, in a
table of pieces whose pairs were merged before; unknown ones are merged and added. Every token keeps the byte offset of its place in the text, and decoding writes each token's bytes at its offset.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import unicodedata
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, in_small_batches, releasing

#: Unicode's White_Space code points.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

END, LETTER, STMD, R, V, E, L, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER = range(12)
_LETTERS = (LETTER, STMD, R, V, E, L)
#: Automaton states: what the last character belongs to. A: an apostrophe that starts a token; AR, AL: it and r/v, l; C: a whole contraction.
START, IN_LETTERS, IN_NUMBER, IN_OTHER, AT_SPACE, AT_WHITE, A, AR, AL, C = range(10)
BLOCK = 64
SLICE_BYTES = 1 << 20
#: Merged pieces that are kept, and bytes of their ids and of those outside the table; beyond either all are forgotten.
CACHE_PIECES, CACHE_BYTES = 1_000_000, 32 << 20
#: Longest piece in bytes that the table holds as two 64-bit words.
SHORT_PIECE = 16
#: Longer pieces are merged one by one, much longer ones in rounds over arrays.
LONG_PIECE, HUGE_PIECE = 40, 1 << 14
#: Tokens decoded at once.
DECODED_AT_ONCE = 1 << 17
_BREAK = re.compile(r"(?<=[!-~])[ \n]")


def _step(state: int, cls: int) -> int:
    if cls == END:
        return START
    if cls in _LETTERS:
        if state == A and cls != LETTER and cls != E:
            return {STMD: C, R: AR, V: AR, L: AL}[cls]
        if state == AR and cls == E or state == AL and cls == L:
            return C
        return IN_LETTERS
    if cls == APOSTROPHE:
        return IN_OTHER if state in (AT_SPACE, IN_OTHER, A) else A
    return {NUMBER: IN_NUMBER, SPACE: AT_SPACE, WHITE: AT_WHITE, OTHER: IN_OTHER}[cls]


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """generator id of each class, composition table (first f, then g), value table (function id, state)."""
    maps = [tuple(_step(s, c) for s in range(10)) for c in range(12)]
    ids: dict[tuple, int] = {}
    for m in maps:
        ids.setdefault(m, len(ids))
    todo = list(ids)
    while todo:
        f = todo.pop()
        for g in maps:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    values = np.array(sorted(ids, key=ids.get), np.uint8)
    table = np.array([[ids[tuple(values[g][values[f]].tolist())] for g in range(len(ids))] for f in range(len(ids))], np.uint16)
    return np.array([ids[m] for m in maps], np.uint16), table, values


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    for ch, cls in (("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L), ("'", APOSTROPHE)):
        for x in ch:
            out[ord(x)] = cls
    out[list(WHITE_SPACE)] = WHITE
    out[32] = SPACE
    return out


def _scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of function ids, by blocks."""
    _, table, values = _monoid()
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    size = len(values)
    flat = table.ravel()
    rows = -(-n // BLOCK)
    grid = np.zeros((rows, BLOCK), np.uint16)
    grid.ravel()[:n] = functions
    grid = np.ascontiguousarray(grid.T).astype(np.int32)
    for j in range(1, BLOCK):
        grid[j] = flat[grid[j - 1] * size + grid[j]]
    before = _scan(grid[-1].astype(np.uint16)).astype(np.int32)[:-1]
    grid[:, 1:] = flat[before[None, :] * size + grid[:, 1:]]
    return grid.T.astype(np.uint16).ravel()[:n]


def boundaries(classes: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. END characters separate texts and are tokens of their own."""
    generators, _, values = _monoid()
    state = values[_scan(generators[classes]), START]
    before = np.r_[np.uint8(START), state[:-1]]
    after = np.r_[state[1:], np.uint8(START)]
    ahead = np.r_[classes[1:], np.uint8(END)]
    letter = (classes >= LETTER) & (classes <= L)
    number, other = classes == NUMBER, (classes == OTHER) | (classes == APOSTROPHE)
    blank = (classes == SPACE) | (classes == WHITE)
    was_blank = (before == AT_SPACE) | (before == AT_WHITE)
    joins = np.zeros(len(classes), bool)
    continues = (before == IN_LETTERS) | (before == AR) | (before == AL) | (before == AT_SPACE)
    contraction = (before == A) & ((state == C) | (((state == AR) | (state == AL)) & (after == C)))
    joins |= letter & (continues | contraction)
    joins |= number & ((before == IN_NUMBER) | (before == AT_SPACE))
    joins |= other & ((before == IN_OTHER) | (before == AT_SPACE) | (before == A))
    solid_ahead = (ahead != SPACE) & (ahead != WHITE) & (ahead != END)
    joins |= blank & was_blank & ~solid_ahead
    return ~joins | (before == START)


def text_slices(text: str, size: int = SLICE_BYTES):
    """Slices of a long text that begin at a blank after a visible ASCII character, where a pre-token always ends."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + size)
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


def pretokens(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts in one string of bytes, where its pre-tokens start and it ends, and per text the end of its pre-tokens among them."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    classes = _classes()[points]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    classes[ends] = END
    starts = np.flatnonzero(boundaries(classes))
    at = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)
    return joined.encode(), np.r_[0, at][np.r_[starts, len(points)]], np.searchsorted(starts, ends)


NO_PAIR = 1 << 40
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a word
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def words_of(blob: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the next 8 bytes of the pieces, zeros after their end."""
    every = np.ndarray((len(blob) + 1,), "<u8", blob + bytes(8), 0, (1,))  # a word at each byte
    return every[at] & _BYTES[np.minimum(size, 8)], every[np.minimum(at + 8, len(blob))] & _BYTES[np.clip(size - 8, 0, 8)]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """a with n rows; memory that is never written stays unused."""
    out = np.zeros((n, *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class Pieces:
    """Known pieces and their ids: short ones in an open-addressing table by their very bytes and length, longer ones by a dict."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << 12, -1, np.int32)
        self.rows = np.zeros((1 << 11, 4), np.uint64)  # two words, length, first id << 32 | number of ids
        self.n, self.n_ids, self.held = 0, 0, 0
        self.ids = np.zeros(1 << 12, np.uint32)
        self.longer: dict[bytes, int] = {}

    def _slot(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = (one * _MIX[0] ^ two) * _MIX[1] + size
        h = (h ^ h >> np.uint64(29)) * _MIX[2]
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Row of each short piece, -1 if it is unknown."""
        slot = self._slot(one, two, size)
        out = self.slots[slot].astype(np.int64)
        todo = np.flatnonzero(out >= 0)
        while len(todo):
            row = self.rows[out[todo]]
            todo = todo[(row[:, 0] != one[todo]) | (row[:, 1] != two[todo]) | (row[:, 2] != size[todo])]
            slot[todo] = slot[todo] + 1 & len(self.slots) - 1
            out[todo] = self.slots[slot[todo]]
            todo = todo[out[todo] >= 0]
        return out

    def add(self, pieces: list[bytes], ids: np.ndarray, n: int) -> None:
        """Unknown, distinct pieces of one length, with n ids each, one piece's after the other's."""
        first, k, size = self.n_ids, len(pieces), len(pieces[0])
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = _grown(self.ids, 2 * (self.n_ids + len(ids)))
        self.ids[first : first + len(ids)] = ids
        self.n_ids += len(ids)
        self.held += 4 * len(ids) + (size > SHORT_PIECE) * k * size
        if self.n + k > len(self.rows):
            self.rows = _grown(self.rows, 2 * (self.n + k))
        row = np.arange(self.n, self.n + k)
        self.n += k
        self.rows[row, 3] = first + n * np.arange(k) << 32 | n
        if size > SHORT_PIECE:
            self.longer.update(zip(pieces, row.tolist(), strict=True))
            return
        self.rows[row, 0], self.rows[row, 1] = words_of(b"".join(pieces), size * np.arange(k), np.full(k, size))
        self.rows[row, 2] = size
        if 2 * self.n > len(self.slots):
            self.slots = np.full(2 << self.n.bit_length(), -1, np.int32)
            row = np.flatnonzero(self.rows[: self.n, 2])  # the longer ones say no length here
        slot = self._slot(*self.rows[row, :3].T)
        while len(row):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = row[free]
            lost = self.slots[slot] != row
            row, slot = row[lost], slot[lost] + 1 & len(self.slots) - 1

    def ids_of(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of these rows, and where each piece's begin among them and end."""
        place = self.rows[:, 3][row].astype(np.int64)
        n = place & 0xFFFFFFFF
        at = np.r_[0, np.cumsum(n)]
        return self.ids[np.repeat((place >> 32) - at[:-1], n) + np.arange(at[-1])], at


class Vocabulary:
    """Ids of pre-tokens, which are kept as Pieces.

    pairs maps two adjacent ids to the id that they merge into; a lower id merges first, the leftmost of equals.
    """

    def __init__(self, ids: dict[bytes, int], pairs: dict[tuple[int, int], int], whole_pieces: bool, special: dict[str, int] | None = None):
        self.known = Pieces()
        self.ids, self.pairs, self.whole, self.special = ids, pairs, whole_pieces, special or {}
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for x, i in [*ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = x
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.byte_pairs = self._looked_up(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))  # by two bytes

    def merge(self, piece: bytes) -> list[int]:
        """Pair merging of one piece with a heap and linked neighbours: n log n."""
        if self.whole and piece in self.ids:
            return [self.ids[piece]]
        if len(piece) > HUGE_PIECE:
            return self.merge_in_rounds(piece)
        pairs, n = self.pairs, len(piece)
        part = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[x], i, *x) for i, x in enumerate(zip(part, part[1:], strict=False)) if x in pairs]
        heapq.heapify(heap)
        while heap:
            new, i, a, b = heapq.heappop(heap)
            if part[i] != a or (j := after[i]) >= n or part[j] != b:
                continue  # an outdated pair
            part[i], part[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := pairs.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (m, x, part[x], part[y]))
        return [x for x in part if x >= 0]

    def merge_in_rounds(self, piece: bytes) -> list[int]:
        """The same in bounded memory: each round merges all places of the lowest id, from the left without overlap.

        A merged token only enters pairs of higher ids, so no place of a later round could come first.
        """
        part = self.byte_ids[np.frombuffer(piece, np.uint8)]
        cost = self._looked_up(part[:-1], part[1:])
        while len(cost) and (new := cost.min()) != NO_PAIR:
            hit = np.flatnonzero(cost == new)
            each = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) > 1], each, 0))
            hit = hit[(each - run) % 2 == 0]
            part[hit] = new
            part, cost = np.delete(part, hit + 1), np.delete(cost, hit)
            at = hit - np.arange(len(hit))  # where the merged tokens stand now
            near = np.unique(np.r_[at - 1, at])
            near = near[(near >= 0) & (near < len(cost))]
            cost[near] = self._looked_up(part[near], part[near + 1])
        return part.tolist()

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], NO_PAIR)

    def learn(self, pieces: list[bytes]) -> None:
        """Pair merging of many pieces of one length at once: each round merges one pair of every piece."""
        if self.whole:
            whole = [x for x in pieces if x in self.ids]
            if whole:
                self.known.add(whole, np.array([self.ids[x] for x in whole], np.uint32), 1)
                pieces = [x for x in pieces if x not in self.ids]
        if not pieces:
            return
        width = len(pieces[0])
        chars = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, width)
        parts = self.byte_ids[chars]
        row = np.arange(len(pieces))
        cost = self.byte_pairs[chars[:, :-1].astype(np.int64) << 8 | chars[:, 1:]]
        while len(row):
            width = parts.shape[1]
            at = cost.argmin(axis=1) if width > 1 else np.zeros(len(row), int)
            each = np.arange(len(row))
            new = cost[each, at] if width > 1 else np.full(len(row), NO_PAIR)
            done = new == NO_PAIR
            if done.any():
                self.known.add([pieces[r] for r in row[done].tolist()], parts[done].ravel(), width)
                go = ~done
                row, parts, cost, at, new = row[go], parts[go], cost[go], at[go], new[go]
                each = np.arange(len(row))
                if not len(row):
                    break
            parts[each, at] = new
            stays = np.ones(parts.shape, bool)
            stays[each, at + 1] = False
            parts = parts[stays].reshape(len(row), width - 1)
            cost = cost[stays[:, 1:]].reshape(len(row), width - 2)
            has = np.flatnonzero(at > 0)
            cost[has, at[has] - 1] = self._looked_up(parts[has, at[has] - 1], new[has])
            has = np.flatnonzero(at < width - 2)
            cost[has, at[has]] = self._looked_up(new[has], parts[has, at[has] + 1])

    def know(self, pieces: set[bytes]) -> None:
        """Merge unknown pieces and keep them: most by length, long ones by the heap."""
        by_length: dict[int, list[bytes]] = {}
        for x in pieces:
            by_length.setdefault(len(x), []).append(x)
        for n, same in by_length.items():
            if n <= LONG_PIECE:
                self.learn(same)
                continue
            for x in same:
                ids = self.merge(x)
                self.known.add([x], np.array(ids, np.uint32), len(ids))

    def look_up(self, blob: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that start at these bytes (the last is the end of all), and where each piece's begin among them and end."""
        size = np.diff(at)
        row = np.full(len(size), -1)
        short = np.flatnonzero(size <= SHORT_PIECE)
        keys = (*words_of(blob, at[short], size[short]), size[short].astype(np.uint64))
        row[short] = found = self.known.find(*keys)
        longer = np.flatnonzero(size > SHORT_PIECE)
        texts = [blob[a:b] for a, b in zip(at[longer].tolist(), at[longer + 1].tolist(), strict=True)]
        unknown = np.flatnonzero(found < 0)
        lost = short[unknown]
        new = {blob[a:b] for a, b in zip(at[lost].tolist(), at[lost + 1].tolist(), strict=True)}
        self.know(new.union(texts) - self.known.longer.keys())
        row[lost] = self.known.find(*(k[unknown] for k in keys))
        row[longer] = [self.known.longer[x] for x in texts]
        return self.known.ids_of(row)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; a long one goes in slices, unless a special token could span them."""
        if any(len(t) > 2 * SLICE_BYTES for t in texts) and not any(" " in s or "\n" in s for s in self.special):
            return [b"".join(p for s in text_slices(t) for p in self.encode_slices([s])) if len(t) > 2 * SLICE_BYTES else self.encode_slices([t])[0] for t in texts]
        return self.encode_slices(texts)

    def encode_slices(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cuts: list[tuple[int, str | None]] = []
        plain: list[str] = []
        for t in texts:
            if self.special and any(s in t for s in self.special):
                t, parts = t, []
                while (hit := min(((t.find(s), s) for s in self.special if s in t), default=None)) is not None:
                    parts += [t[: hit[0]], hit[1]]
                    t = t[hit[0] + len(hit[1]) :]
                plain += [*parts[::2], t]
                cuts += [(1, s) for s in parts[1::2]] + [(1, None)]
            else:
                plain.append(t)
                cuts.append((1, None))
        blob, starts, ends = pretokens(plain)
        ids, at = self.look_up(blob, starts)
        # END characters are pre-tokens of their own: skip them
        out, held = [], []
        for start, end, (_, special) in zip(at[np.r_[0, ends[:-1] + 1]].tolist(), at[ends].tolist(), cuts, strict=True):
            held.append(ids[start:end].astype("<u4").tobytes())
            if special is not None:
                held.append(self.special[special].to_bytes(4, "little"))
            else:
                out.append(b"".join(held))
                held = []
        if self.known.n > CACHE_PIECES or self.known.held > CACHE_BYTES:
            self.known.clear()
        return out

    def offsets(self, packed: bytes) -> np.ndarray:
        """Byte offsets of the tokens in their text, and the text's length."""
        return np.r_[0, np.cumsum(self.sizes[np.frombuffer(packed, "<u4")])]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """(packed ids, byte offsets of the tokens and the end) of each text."""
        return [(p, self.offsets(p)) for p in self.encode(texts)]

    def decode(self, packed: bytes, offsets: np.ndarray | None = None) -> bytes:
        """Write each token's bytes at its retained offset; without offsets one after the other."""
        ids = np.frombuffer(packed, "<u4")
        offsets = self.offsets(packed) if offsets is None else np.asarray(offsets, np.int64)
        if len(offsets) != len(ids) + 1 or not np.array_equal(np.diff(offsets), self.sizes[ids]):
            raise ValueError("the offsets do not belong to these ids")
        out = np.empty(int(offsets[-1]), np.uint8)
        for a in range(0, len(ids), DECODED_AT_ONCE):
            part = ids[a : a + DECODED_AT_ONCE]
            to = offsets[a : a + len(part)]
            n = self.sizes[part]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to, n) + inner] = self.flat[np.repeat(self.at[part], n) + inner]
        return out.tobytes()


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: visible Latin-1 stays, the rest moves up from 256."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(stay)]
    return {chr(b): b for b in stay} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=4)
def vocabulary(content: bytes) -> Vocabulary:
    """From the content of a .tiktoken rank file or of a tokenizers JSON file with a byte-level BPE model."""
    if content[:1] != b"{":
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        pairs = {(ids[x[:k]], ids[x[k:]]): i for x, i in ids.items() for k in range(1, len(x)) if x[:k] in ids and x[k:] in ids}
        return Vocabulary(ids, pairs, True)
    doc = json.loads(content)
    letters = _byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    special = {t["content"]: t["id"] for t in doc["added_tokens"]}
    ids = {raw(k): v for k, v in doc["model"]["vocab"].items() if k not in special}
    merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in doc["model"]["merges"]]
    pairs = {(ids[a], ids[b]): ids[a + b] for a, b in merges}
    if list(pairs.values()) != sorted(pairs.values()):
        raise ValueError("ids must follow the order of the merges")
    return Vocabulary(ids, pairs, False, special)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _round_trip(content, with_ids: bool):
    def run(batches):
        vocab = vocabulary(content.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids, row = b.column(0), 0
            for start, stop in byte_slices([len(t) for t in texts], SLICE_BYTES):
                coded = vocab.encode_with_offsets(texts[start:stop])
                decoded = [vocab.decode(p, at) for p, at in coded]
                n = [len(p) // 4 for p, _ in coded]
                if with_ids:
                    cols = [pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p, _ in coded], pa.list_(pa.int32())), pa.array(decoded, pa.binary()), pa.array([at[:-1] for _, at in coded], pa.list_(pa.int64()))]
                else:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    cols = [pa.array((sha(p) for p, _ in coded), pa.string()), pa.array(map(sha, decoded), pa.string()), pa.array([zlib.crc32(at[:-1].astype("<i8").tobytes()) for _, at in coded], pa.int64())]
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), pa.array(n, pa.int64()), *cols], ["_id", "n", "a", "b", "c"])
                row += stop - start

    return run


def bpe_round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, then ids (array<int>), decoded (binary) and offsets (array<long>, each token's
    first byte), or if digests the SHA-256 of ids and decoded bytes and the CRC-32 of the offsets.

    Encodes each match of the split pattern separately, without special tokens for a rank file, and decodes the
    ids back to bytes at their retained offsets. Null text counts as empty: no ids. Ids of rows may be of any type, be
    null or repeat; rows are independent, and equal rows give equal rows. Texts of any length are read as a whole,
    slice by slice between blanks. An empty table gives an empty result; other columns of docs are ignored. The vocabulary file (about a megabyte) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_vocabulary(vocab_path))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string, offsets_crc32 long" if digests else "ids array<int>, decoded binary, offsets array<long>"
    rows = in_small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(releasing(_round_trip(content, not digests)), f"_id {kind}, n_tokens long, {tail}")
    return rows.withColumnRenamed("_id", id_col)
