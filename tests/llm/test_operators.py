"""Each operator against a brute-force twin on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from rosterlake.llm import bpe, embed_dedup, exact_dedup, license_scan, line_dedup, packing, pii, simhash, suffix_dedup, toxicity
from rosterlake.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, _t string, _fp long"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 5)))
    base = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(30)]
    shared = " ".join(word() for _ in range(60))
    rows = [*base, *(b.upper() for b in base[:5]), *(b[: len(b) // 2] + shared + b[len(b) // 2 :] for b in base[:12]), "", None, "x", "\n\n", "a" * 500, "a" * 400, base[0], "\n".join(["Same line", base[1], " same LINE\t"] * 3)]
    rows += [f"own {i}\nshared footer line" for i in range(12)]
    return [(i, t, "en", "clash", 1) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    norm = {i: (t or "").translate(LOWER) for i, t, *_ in texts()}
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(norm)
    for r in got:
        same = [i for i, t in norm.items() if t == norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 2000).astype(np.uint64)
    keys = np.concatenate([keys, keys[:700], keys[:50]])
    filters = [exact_dedup.CountingQuotientFilter.build(p) for p in np.array_split(rng.permutation(keys), 7)]
    parts = [exact_dedup.CountingQuotientFilter.of_region(*row) for f in filters for row in f.regions()]
    merged = exact_dedup.CountingQuotientFilter.merge(parts)
    want, n = np.unique(keys, return_counts=True)
    assert np.array_equal(merged.keys, want) and np.array_equal(merged.counts, n)


def test_line_dedup(docs, empty):
    strip = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    lines = {i: (t or "").split("\n") for i, t, *_ in texts()}
    count = {}
    for ls in lines.values():
        for k in {strip(x) for x in ls}:
            count[k] = count.get(k, 0) + 1
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert len(got) == len(lines)
    for i, ls in lines.items():
        kept = [x for x in ls if not (strip(x) and count[strip(x)] >= 10)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (len(ls), len(ls) - len(kept), "\n".join(kept))
    assert sum(r.n_dropped for r in got.values()) == 12
    assert line_dedup.line_dedup(empty).count() == 0


def test_repeated_and_null_rows_keep_their_number(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "c"), (None, "d"), (None, "d"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for f in (exact_dedup.exact_dedup, line_dedup.line_dedup, simhash.simhash_dedup, suffix_dedup.suffix_dedup, license_scan.license_scan):
        assert f(d).count() == len(rows), f
    assert {r.n_lines for r in line_dedup.line_dedup(d).where("doc_id = 1").collect()} == {1, 2}


def test_suffix_dedup(docs, empty):
    seen, want = set(), {}
    for i, t, *_ in texts():
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(raw[s : s + 100])
        want[i] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes())
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("crowd", [False, True])
def test_suffix_dedup_splits_a_hot_anchor(spark, monkeypatch, crowd):
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, long, left = own(60), own(130), own(50)
    rows = [(i, own(120) + (long if i % 7 == 0 else left + phrase if i % 5 == 0 else phrase) + own(120)) for i in range(600)]
    rows += [(i, rows[i - 600][1] + "x") for i in range(600, 620)]
    whole = suffix_dedup.repeated_windows

    def small(frs, rank, length):
        assert len(frs) < 300, "one anchor in one task"
        return whole(frs, rank, length)

    for name, value in (("repeated_windows", small), ("TASK_BYTES", 1 << 12), ("SPLIT_BYTES", 1 << 12), ("TASK_WINDOWS", 2000), *((("SURVEY", 1), ("MEET_RECORDS", 800)) if crowd else ())):
        monkeypatch.setattr(suffix_dedup, name, value, raising=False)
    seen, want = set(), {}
    for i, t in rows:
        raw, gone = t.encode(), np.zeros(len(t), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(raw[s : s + 100])
        want[i] = (int(gone.sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes())
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(d).collect()} == want


def test_crowded_anchors_meet_in_many_groups():
    h, c = np.full(4000, 12345, np.uint64), np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64)
    groups = suffix_dedup.meeting_group(h, c, h[:1], 16)
    assert np.bincount(groups, minlength=16).max() < 500 and (groups == suffix_dedup.meeting_group(h, c, h[:1], 16)).all()
    assert len(set(suffix_dedup.meeting_group(h, c, h[:0], 16))) == 1


def test_transforms_merge_to_sorted_rotations():
    rng = random.Random(2)
    frs = sorted({bytes(rng.choice(b"ab") for _ in range(130)) for _ in range(40)})
    hit = suffix_dedup.repeated_windows(frs, np.arange(len(frs)), 10)
    seen, at = set(), 0
    for f in frs:
        for s in range(len(f) + 1):
            w = f[s : s + 10]
            assert hit[at] == (len(w) == 10 and w in seen)
            seen.add(w)
            at += 1


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum((sum(x >> i & 1 for x in h) * 2 > len(h)) << i for i in range(64))


def reach(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if linked(a, b) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return low


def test_simhash(docs, empty):
    fps = {i: brute_fingerprint(t) for i, t, *_ in texts()}
    low = reach(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = simhash.simhash_dedup(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", low[i]) for i in fps}
    assert simhash.simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 12])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    flips = [sum(1 << int(b) for b in set(row.tolist())) for row in rng.integers(0, 63, (30, 2 + 2 * (radius > 3)))]
    fps = np.unique(np.concatenate([base ^ np.uint64(f) for f in flips]))
    brute = reach(range(len(fps)), lambda a, b: int(fps[a] ^ fps[b]).bit_count() <= radius)
    for links in (simhash.links_in_group(fps, radius), simhash.links_in_runs(fps, np.zeros(len(fps), int), radius)):
        pairs = set(zip(*(x.tolist() for x in links), strict=True))
        assert reach(range(len(fps)), lambda a, b, p=pairs: (a, b) in p) == brute


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    nodes = {x for e in edges for x in e}
    pairs = {p for a, b in edges for p in ((a, b), (b, a))}
    want = reach(sorted(nodes), lambda a, b: (a, b) in pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: want[n] for n in got} and all(want[n] == n for n in nodes - set(got))


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base + rng.normal(scale=0.12, size=base.shape), base[:5], base[:30] + rng.normal(scale=0.2, size=(30, 8))]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 0), (903, base[0].tolist(), None), (904, [], 0), (905, [1.0, 2.0], 1), (906, [1.0, 2.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = {i: (np.float32(v).astype(float), lab) for i, v, lab in rows if v and lab is not None and np.isfinite(v).all() and np.any(v)}

    def linked(a, b):
        if a == b or a not in ok or b not in ok or ok[a][1] != ok[b][1] or len(ok[a][0]) != len(ok[b][0]):
            return False
        u, v = ok[a][0], ok[b][0]
        return u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.98

    ids = [r[0] for r in rows]
    low = reach(ids, linked)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_dedup(d, codes=4).collect()}
    assert got == {i: (sum(linked(i, j) for j in ids), low[i], low[i] == i) for i in ids}
    assert embed_dedup.embedding_dedup(d.limit(0)).count() == 0


def test_bpe_equals_the_libraries(docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    rough = ["".join(rng.choice("' sStrvelmd19 \n\t é漢.,!\x1c\x85") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, ""]
    vocab = bpe.vocabulary(bpe.read_vocabulary(path))
    for t, p in zip(rough, vocab.encode(rough), strict=True):
        assert np.frombuffer(p, "<u4").tolist() == lib.encode_ordinary(t)
        assert vocab.decode(p) == t.encode()
    got = bpe.bpe_round_trip(docs, path).collect()
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: r.doc_id), texts(), strict=True):
        assert r.ids == lib.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode() and r.n_tokens == len(r.ids)
    assert bpe.bpe_round_trip(empty, path).count() == 0


def test_packing(docs, empty):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, capacity=64).collect()
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in texts()}
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and 0 < r.length <= 64
    for i, rows in of.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist() and sum(r.length for r in rows) == len(ids[i])
        assert all(r.length == 64 for r in rows[1:])
    bins = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert len(of) == len(ids) and max(bins.values()) <= 64
    assert len(bins) <= 1.05 * -(-sum(map(len, ids.values())) // 64) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_plan_places_every_item_once():
    rng = random.Random(4)
    for _ in range(20):
        counts = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(30)}
        items, bins = {}, {}
        for n, first, k, seq, offset in packing.plan_bins(counts, 100):
            for j in range(k):
                assert items.setdefault((n, first + j), (seq + j, offset)) == (seq + j, offset)
                bins.setdefault(seq + j, []).append((offset, n))
        assert len(items) == sum(counts.values())
        for parts in bins.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 100


def test_licences(spark, docs):
    rows = ["Licensed under the Apache License, Version 2.0.", "MIT license mit LICENSE", "cc by-nc 4.0", "gnu general\npublic license", "general public license", None, ""]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(d).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].base_labels) == (1, 3, "apache") and "apache-2.0" in got[0].labels
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (2, 0, 2, "mit")
    assert got[2].base_labels == "cc-by" and got[3].base_labels == "gpl" and got[4].base_labels == "" and got[4].n_base == 0
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].labels, got[5].score) == (0, 0, None, "", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values()) and license_scan.license_scan(d.limit(0)).count() == 0


def test_pii_round_trip(spark):
    key = b"test key"
    t = "mail a.b7@mail3.example.com ip 10.2.3.4 card 4952935900253052, 2020-02-29 12/31/1999 +1 (183) 555-1276 123-45-6789 DE89370400440532013000 no 1234567812345678"
    new, spans = pii.pseudonymise(t, key)
    assert [k for k, *_ in spans] == ["email", "ip", "card", "date", "date", "phone", "ssn", "iban"] and len(new) == len(t)
    assert "1234567812345678" in new and "4952935900253052" not in new
    assert pii.pseudonymise(new, key, True)[0] == t
    d = spark.createDataFrame([(1, t, "x"), (2, None, "y"), (3, "", None), (4, t, "z")], "doc_id int, text string, pii_spans string")
    got = {r.doc_id: r for r in pii.pseudonymise_documents(d, key).collect()}
    assert got[1].text == got[4].text == new and got[2].text is None and got[3].text == "" and got[2].pii_spans == []
    assert sorted(pii.permute(i, 1000, key, "t") for i in range(1000)) == list(range(1000))


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(0)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows = []
    for i in range(500):
        toxic = rng.random() < 0.3
        body = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        if toxic:
            body.insert(rng.randint(0, len(body)), rng.choice(["vile", "nasty"]))
        rows.append((i, " ".join(body), "en", int(toxic)))
    d = spark.createDataFrame([r[:3] for r in rows] + [(900, None, None), (901, "", "en"), (None, "vile", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, labels).collect()}
    assert len(got) == 503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows) and not got[None].held_out
    held = [(got[i].predicted, y) for i, _, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert got[900].score == got[901].score
    assert toxicity.score_toxicity(d, labels.limit(0)).count() == 503
