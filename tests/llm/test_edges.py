"""Edge cases of every operator and stage: clashing column names, empty tables, repeated ids, colliding hashes, long texts; and brute-force twins of op1, op3 and op8."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlake.llm.components import connected_components
from rosterlake.llm import bpe, components, embed_dedup, exact_dedup, license_scan, line_dedup, packing, pii, queries, simhash, suffix_dedup, toxicity

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
KEY = b"edge key"
CLASH = "_new string, _spans string, _score double, _text string, _sha string, _t string, _id long, _fp long, _rk1 long, _w string, _name string, kept boolean, _kept string"
ROWS = [
    (1, "alpha beta gamma\nalpha", "en"), (1, "alpha beta gamma\nalpha", "en"), (1, "other text of one id 2020-01-02", "de"), (None, "no id a@b.example.com", "en"),
    (None, "no id either", None), (None, None, None), (2, None, "en"), (3, "", "en"), (4, "Tie", "en"), (5, "tie", "en"), (6, "apache license", "en"),
]


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda d: pii.pseudonymise_documents(d, KEY),
    "exact": exact_dedup.exact_dedup,
    "toxicity": lambda d: toxicity.score_toxicity(d, labels(d.sparkSession)),
    "suffix": suffix_dedup.suffix_dedup,
    "packing": lambda d: packing.pack_documents(d, JSON),
    "bpe": lambda d: bpe.bpe_round_trip(d, RANKS),
    "licences": license_scan.license_scan,
    "lines": line_dedup.line_dedup,
    "simhash": simhash.simhash_dedup,
}


@pytest.fixture(scope="module")
def clashing(spark):
    extra = ("n", "s", 0.5, "t", "h", "t", 7, 8, 9, "w", "m", True, "k")
    return spark.createDataFrame([(*r, "src", 1, *extra) for r in ROWS], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_repeated_and_null_rows_and_empty_tables(clashing, name):
    run = OPERATORS[name]
    got = run(clashing)
    plain = run(clashing.select("doc_id", "text", "lang"))
    shared = [c for c in plain.columns if c in got.columns]
    rows = lambda d: sorted((str(tuple(r)) for r in d.select(*shared).collect()))
    if name == "packing":  # sequences are numbered freely
        shared = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(got) == rows(plain) and got.count() == len(ROWS)
    none = run(clashing.limit(0))
    assert none.columns == got.columns and none.count() == 0


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_with_clashing_names_and_empty_tables(spark, clashing, name, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(C.STAGES)[name]
    got = stage(spark, clashing, str(tmp_path))
    plain = stage(spark, clashing.select("doc_id", "text", "lang", "source", "n_chars"), str(tmp_path))
    assert got.count() == plain.count() > 0
    if name != C.STAGES[-1][0]:
        assert got.columns == clashing.columns and {r["_new"] for r in got.collect()} == {"n"}
        key = lambda d: sorted(str((r.doc_id, r.text)) for r in d.collect())
        assert key(got) == key(plain)
    assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0


def test_text_ids(spark):
    d = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_dedup(d).collect()} == {("a", "a"), ("b", "a"), (None, None)}
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(d).collect()} == {("a", "b"), ("b", "b"), (None, None)}
    for f in (license_scan.license_scan, line_dedup.line_dedup, lambda x: bpe.bpe_round_trip(x, RANKS)):
        assert f(d).count() == 3


def test_suffix_dedup_tells_texts_of_one_id_apart(spark, monkeypatch):
    rng = random.Random(2)
    body = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(150, 400))) for _ in range(40)]
    d = spark.createDataFrame([(None if i % 2 else 7, t + body[0]) for i, t in enumerate(body)], "doc_id long, text string")
    want = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(d).collect())
    assert [n for n, _ in want] == sorted(len(t) + len(body[0]) for t in body) and sum(g > 0 for _, g in want) == 39 or sum(g > 0 for _, g in want) == 40
    real, seeds = suffix_dedup.text_number, []

    def colliding(text, seed):
        seeds.append(seed)
        return F.lit(5).cast("long") if seed < 2 else real(text, seed)

    monkeypatch.setattr(suffix_dedup, "text_number", colliding)
    again = suffix_dedup.suffix_dedup(d).collect()
    assert seeds == [0, 1, 2] and sorted(r.n_bytes for r in again) == [n for n, _ in want]
    assert sum(r.n_removed > 0 for r in again) == sum(g > 0 for _, g in want)


def test_slices_agree_with_whole_texts():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abé'9,") for _ in range(rng.randint(1, 7))) + rng.choice(["", "\n", "  "]) for _ in range(4000))
    whole = simhash.fingerprint(text)
    for size in (1, 7, 100, 5000):
        ones, n = np.zeros(64, np.int64), 0
        for words in simhash.word_slices(text, 3, size):
            found, m = simhash._bit_counts(words, 3)
            ones, n = ones + found, n + m
        assert int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) == whole
    assert ["".join(bpe.text_slices(text, n)) for n in (5, 999)] == [text, text]
    vocab = bpe.vocabulary(bpe.read_vocabulary(RANKS))
    assert b"".join(p for s in bpe.text_slices(text, 50) for p in vocab.encode_slices([s])) == vocab.encode_slices([text])[0]
    for short in ("", "a", "a b", "  "):
        assert sum(len(w) for w in simhash.word_slices(short, 3, 1)) == len(short.split())


def test_long_pieces_merge_in_rounds():
    ranks = {bytes(k): i for k, i in bpe.vocabulary(bpe.read_vocabulary(RANKS)).ids.items()}
    lib, vocab, rng = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.vocabulary(bpe.read_vocabulary(RANKS)), random.Random(3)
    for t in ("a" * 30000, "".join(rng.choice("theandiou") for _ in range(20000)), "ab" * 12345):
        assert vocab.merge_in_rounds(t.encode()) == lib.encode_ordinary(t)
    (packed, at), = vocab.encode_with_offsets(["it's é 漢字"])
    assert vocab.decode(packed, at) == "it's é 漢字".encode()
    with pytest.raises(ValueError):
        vocab.decode(packed, at + 1 - np.arange(len(at)))


def test_pieces_are_merged_once(monkeypatch):
    """A corpus has more distinct pieces than a small cache holds; merging them again is what packing's CPU budget went to."""
    vocab, merged, learn = bpe.Vocabulary(*_model(JSON)), [], bpe.Vocabulary.learn
    monkeypatch.setattr(bpe.Vocabulary, "learn", lambda self, pieces: merged.append(len(pieces)) or learn(self, pieces))
    texts = ["".join(f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{w}" for i in range(17_576)) for w in "abcdefghijklmnopqrstuvwxyz"]
    first = [vocab.encode([t])[0] for t in texts]
    once = sum(merged)
    assert [vocab.encode([t])[0] for t in texts] == first and sum(merged) == once


def _model(path):
    v = bpe.vocabulary(bpe.read_vocabulary(path))
    return v.ids, v.pairs, v.whole, v.special


def test_pieces_that_collide_or_are_forgotten(monkeypatch):
    lib, rng = Tokenizer.from_file(JSON), random.Random(8)
    texts = ["".join(rng.choice(["ab", "é", "漢", "\0", "z" * 7, "q" * 16, " ", "'s"]) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", "\0", "\0\0", "y\0", "y", *("w" * n for n in range(6, 20)), "v" * 40, "u" * 41]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for fixed in ("none", "slot", "memory"):
        vocab = bpe.Vocabulary(*_model(JSON))
        if fixed == "slot":  # all in one
            monkeypatch.setattr(bpe.Pieces, "_slot", lambda self, one, two, size: np.full(len(one), len(self.slots) - 2))
        if fixed == "memory":
            monkeypatch.undo()
            monkeypatch.setattr(bpe, "CACHE_BYTES", 100)
        for k in (1, 7, len(texts), len(texts)):
            got = [p for i in range(0, len(texts), k) for p in vocab.encode(texts[i : i + k])]
            assert [np.frombuffer(p, "<u4").tolist() for p in got] == want
        assert vocab.encode([]) == [] and (vocab.known.n == 0) == (fixed == "memory")


def test_fragments_of_repetitive_texts_cover_every_window_once():
    rng = random.Random(4)
    for t in (b"a" * 3000, b"ab" * 1500, b"abcde " * 400 + b"a" * 700, bytes(rng.choice(b"ab") for _ in range(3000))):
        h, c, first, last = suffix_dedup.fragments(np.frombuffer(t, np.uint8), np.array([len(t)]))
        windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
        assert sorted(windows.tolist()) == list(range(len(t) - 99))
        of = {t[w : w + 100]: set() for w in windows}
        for x, a, b in zip(h, first, last, strict=True):
            for w in range(a, b + 1):
                of[t[w : w + 100]].add(int(x))
        assert all(len(x) == 1 for x in of.values())  # equal windows share their anchor


LONG = {"prose": "lorem ipsum dolor sit amet consectetur " * 80_000, "one run": "a" * 3_000_000, "blank": " \n" * 1_500_000}


@pytest.mark.parametrize("name", [n for n in OPERATORS])
def test_long_texts(spark, name):
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(LONG.values())], "doc_id long, text string, lang string").repartition(3)
    assert OPERATORS[name](d).select("doc_id").distinct().count() == 3


# ---- op1: each format's map is a permutation of its valid values


def test_pseudonyms_permute_their_formats():
    for kind, values in {
        "date": [f"19{y:02d}-{m:02d}-{d:02d}" for y in range(0, 100) for m in range(1, 13) for d in (1, 9, 28)],
        "phone": [f"({a})-555-{n:04d}" for a in (183, 415) for n in range(0, 10000, 37)],
        "ip": [f"10.0.{a}.{b}" for a in range(20) for b in range(0, 256, 5)],
        "ssn": [f"123-45-{n:04d}" for n in range(1, 2000)],
    }.items():
        new = [pii.pseudonym(kind, v, KEY) for v in values]
        assert None not in new and len(set(new)) == len(values) and all(len(a) == len(b) for a, b in zip(new, values, strict=True))
        assert [pii.pseudonym(kind, n, KEY, True) for n in new] == values
    for a, b in ((0, 3), (1, 4)):  # area and exchange codes stay (un)assignable
        for v in ("(183) 055-1234", "415-555-1234"):
            d, n = re.sub(r"\D", "", v), re.sub(r"\D", "", pii.pseudonym("phone", v, KEY))
            assert (d[0] > "1", d[3] > "1") == (n[0] > "1", n[3] > "1")
    small = {pii.walk(v, 97, KEY, "t", lambda x: x % 3 != 0, False) for v in range(97) if v % 3}
    assert small == {v for v in range(97) if v % 3}


def test_personal_data_of_any_length_and_century():
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (32, 64, 129, 500, 9000)]
    secrets = [*hexes, hexes[1].upper(), "".join(c.upper() if i % 3 else c for i, c in enumerate(hexes[2]))]
    tokens = ["ghp_" + "aB3" * 12, "AKIA" + "ABCD1234EFGH5678", "xoxb-123456789012-abcDEF", "sk-abcdefghij0123456789xyz"]
    text = " ".join([*(f'key="{s}"' for s in secrets), *tokens, "1066-10-14 0001-01-01 9999-12-31 31.12.2150 " + "x" * 9000 + "@mail.example.org"])
    new, spans = pii.pseudonymise(text, KEY)
    assert [k for k, *_ in spans] == ["secret"] * len(secrets) + ["token"] * 4 + ["date"] * 4 + ["email"]
    assert len(new) == len(text) and not any(v in new for v in [*secrets, *tokens, "x" * 9000])
    assert pii.pseudonymise(new, KEY, True)[0] == text
    began = time.time()
    pii.pseudonymise("a%" * 200_000 + "1@", KEY)
    assert time.time() - began < 20


# ---- op3: pooling against a naive convolution


def test_pooled_maxima_equal_a_naive_convolution():
    rng = np.random.default_rng(3)
    W, D, K = toxicity.WIDTHS, toxicity.DIM, toxicity.FILTERS
    model = toxicity.Model(rng.normal(size=(toxicity.PAD + 1, D)).astype(np.float32), {w: rng.normal(size=(w, D, K)).astype(np.float32) for w in W}, {w: rng.normal(size=K).astype(np.float32) for w in W}, None, 0.0)
    model.emb[toxicity.PAD] = 0
    words = [f"w{i}" for i in range(50)] + ["ÉTÉ", "Foo-bar", "x"]
    texts = ["", "one", " ".join(rng.choice(words, 700)), "a b", " ".join(rng.choice(words, 60))]
    got = toxicity.pooled_maxima(*toxicity.word_buckets(texts), model)
    for t, row in zip(texts, got, strict=True):
        ids, _ = toxicity.word_buckets([t])
        assert len(ids) == len(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) + toxicity.PADS
        x = model.emb[ids].sum(axis=1)
        want = [max(0, max(float((x[i : i + w] * model.filters[w][:, :, f]).sum()) for i in range(len(x) - w + 1)) + float(model.bias[w][f])) for w in W for f in range(K)]
        assert np.allclose(row, want, atol=1e-3)
        if t:
            for size in (1, 10, 300):
                assert np.allclose(toxicity.maxima_of_long_text(t, model, size) if size > 8 else row, want, atol=1e-3)


def test_training_rows_are_bounded(spark):
    d = spark.createDataFrame([(1, f"text {i % 7}", "en") for i in range(500)] + [(2, "b", "en")] * 300, "doc_id long, text string, lang string")
    rows = toxicity.training_rows(d, labels(spark), "doc_id", "text", "lang", "toxic", 5)
    assert len(rows) <= 5
    rows = toxicity.training_rows(d, labels(spark), "doc_id", "text", "lang", "toxic", 100)
    assert len(rows) == len({(r["_id"], r["ids"]) for r in rows}) <= 8


# ---- op8: every place by brute force, linear time


def brute_licences(texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [word.findall((t or "").translate(lower)) for t in texts]
    parts = [p for p, _ in license_scan.BASE] + [x for t in license_scan.TEMPLATES for x in (t.words, t.key_phrase)]
    idf = {w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1)) + 1 for w in {w for p in parts for w in p.split()}}

    def aligned(d, phrase):
        ws = phrase.split()
        rare = sorted(range(len(ws)), key=lambda i: (-idf[ws[i]], i))[:2]
        for s in {p - i for p, w in enumerate(d) for i in rare if w == ws[i] and p >= i}:
            same = [s + i < len(d) and d[s + i] == w for i, w in enumerate(ws)]
            yield s, sum(idf[w] for w, m in zip(ws, same, strict=True) if m) / sum(idf[w] for w in ws), all(same)

    out = []
    for d in docs:
        places = [(s, label) for p, label in license_scan.BASE for s in range(len(d)) if d[s : s + len(p.split())] == p.split()]
        scores = [x for p in [p for p, _ in license_scan.BASE] + [t.words for t in license_scan.TEMPLATES] for _, x, _ in aligned(d, p)]
        more = {t.label for t in license_scan.TEMPLATES if any(f for *_, f in aligned(d, t.key_phrase)) and max((x for _, x, _ in aligned(d, t.words)), default=0) >= 0.8}
        base = {label for _, label in places}
        at = [s for s, _ in places]
        out.append((len(d), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), round(min(1.0, max(scores, default=0.0)), 6)))
    return out


def test_licences_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = license_scan.vocabulary([p for p, _ in license_scan.BASE] + [t.words for t in license_scan.TEMPLATES])
    texts = [" ".join(rng.choice([*vocab, "x", "ünï"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"{'y ' * k}{rng.choice([t.words, t.key_phrase])} -- {p.title()}! {p}" for k in range(12) for t in license_scan.TEMPLATES for p, _ in license_scan.BASE] + [None, "", "MIT", "cc by cc by by cc"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = [tuple(r)[1:] for r in license_scan.license_scan(d).orderBy("doc_id").collect()]
    assert [(*r[:-1], round(r[-1], 6)) for r in got] == brute_licences(texts)


def test_licence_scan_takes_linear_time(spark):
    d = spark.createDataFrame([(1, "cc by " * 32_000)], "doc_id int, text string")
    license_scan.license_scan(d).collect()
    began = time.time()
    assert license_scan.license_scan(d).first().n_base == 32_000
    assert time.time() - began < 5


def test_embeddings_keep_double_precision_and_labels(spark):
    rows = [(1, [1e-60, 1.0e-60], 0.2), (2, [2e-60, 2.0e-60], 0.2), (3, [1e39, 1e39], 0.7), (4, [1e200, 1.1e200], 0.7), (5, [1e-300, -1e-300], 0.7), (6, [1.0, 1.0], 0.2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double").withColumn("_v", F.lit(1)).withColumn("_id", F.lit(2))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_dedup(d).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 6: (2, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_queries_take_the_key_of_the_session(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.example.com")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = queries.op1_pii(spark, str(tmp_path)).first().text
    spark.conf.set("spark.rosterlake.pii.key", "another")
    try:
        assert queries.op1_pii(spark, str(tmp_path)).first().text != first
    finally:
        spark.conf.unset("spark.rosterlake.pii.key")


def test_nothing_is_rejected_without_both_kinds_of_labels(spark):
    d = spark.createDataFrame([(i, f"text {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    for toxic in (0, 1):
        given = spark.createDataFrame([(i, toxic) for i in range(20)], "doc_id long, toxic int")
        assert toxicity.score_toxicity(d, given).where("rejected").count() == 0


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(120, 300))] for _ in range(25)]
    rows = []
    for ws in base:
        for edits in (0, 1, 2, 3, 6, 15, 40):
            new = list(ws)
            for _ in range(edits):
                new[rng.randrange(len(new))] = f"x{rng.randint(0, 9999)}"
            rows.append(" ".join(new))
    rows += [base[0][0] + " short text", (base[0][0] + " short text").upper(), "", None, " \n", rows[3], "a b c d e", "a b c d e f"]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(rows, 1)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, _n long, component string").repartition(3)
    sets = [shingles(t) for _, t in docs]
    similar = lambda a, b: len(a & b) / len(a | b) >= 0.8 if a | b else True
    low = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(i):
                if low[i] != low[j] and similar(sets[i], sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    got = simhash.near_duplicates(d, radius=14, sure=14, recall=0.999999).withColumn("t", F.lit(1))
    key = spark.createDataFrame([(*r, n) for r, n in zip(docs, low, strict=True)], "doc_id long, text string, want int")
    from rosterlake.llm.common import row_key

    pairs = {(r.want, r.component) for r in key.select("*", *row_key("doc_id", "text")).join(got.drop("doc_id"), ["_rk1", "_rk2"]).collect()}
    assert len(pairs) == len({w for w, _ in pairs}) == len({c for _, c in pairs}) == len(set(low))
    assert got.where("kept").count() >= len(set(low)) and got.count() == len(docs)
    assert simhash.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [4096, 40])
def test_no_link_of_texts_that_meet_is_lost(spark, monkeypatch, chunk):
    rng = random.Random(31)
    rows = []
    for length, n in ((400, 110), (60, 40), (3000, 20)):
        base = [f"w{rng.randint(0, 50_000)}" for _ in range(length)]
        for _ in range(n):
            new = list(base)
            for _ in range(rng.randint(1, 4)):
                size = rng.randint(1, max(2, length // 14))
                at = rng.randrange(length - size)
                new[at : at + size] = [f"y{rng.randint(0, 50_000)}" for _ in range(size)]
            rows.append(" ".join(new))
    rows += [" ".join(["same"] * 40 + [f"end{i}"]) for i in range(6)]  # one fingerprint, or nearly so
    sets, fps = [shingles(t) for t in rows], [simhash.fingerprint(t) for t in rows]
    masks = simhash.sampled_tables(len(set(fps)), simhash.SURE_RADIUS, simhash.RECALL)
    meet = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 12 and any(not (fps[i] ^ fps[j]) & m for m in masks)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if meet(i, j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [(i, j) for i in range(len(rows)) for j in range(i) if meet(i, j) and len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])]
    assert len(far) > 200 and len(links) > 200
    low = list(range(len(rows)))
    while any(low[i] != low[j] for i, j in links):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component for r in simhash.near_duplicates(d).collect()}
    pairs = {(low[i], got[i]) for i in range(len(rows))}
    assert len(pairs) == len(set(low)) == len(set(got.values()))


@pytest.mark.parametrize("chunk", [4096, 30])
def test_second_look_makes_no_row_of_each_text_and_table(spark, monkeypatch, chunk):
    rng = np.random.default_rng(6)
    fps = [0, *(sum(1 << int(x) for x in rng.choice(64, 4, replace=False)) for _ in range(149))]
    n, radius = len(fps), 8
    masks = simhash.sampled_tables(n, radius, 0.99)
    odd = [rng.integers(0, 2, simhash.ODD_BITS) for _ in range(3)]
    label = [i % 3 + 1000 for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(f), False, label[i], 40 + i % 20, bytearray(np.packbits(odd[i % 3 if i % 7 else 0]).tobytes())) for i, f in enumerate(fps)]
    texts = simhash.settle(spark.createDataFrame(rows, "_n long, _fp long, _many boolean, _label long, _size long, _odd binary").repartition(3))
    links = spark.createDataFrame([(i, 0) for i in range(1, n)], "a long, b long")
    keys = {(t, f & m) for f in fps for t, m in enumerate(masks) if not f & m}  # of links to 0
    more = spark.createDataFrame([(t, signed(k), 1) for t, k in keys], "_table int, _key long, _c int")

    def fits(i, j):
        apart = sum((a ^ b).bit_count() for a, b in zip(rows[i][5], rows[j][5], strict=True))
        return apart <= (rows[i][4] + rows[j][4]) / 9 and min(rows[i][4], rows[j][4]) >= 0.8 * max(rows[i][4], rows[j][4])

    want = {(i, j) for i in range(n) for j in range(i) if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= radius and any(not (fps[i] | fps[j]) & m for m in masks) and fits(i, j)}
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    got = simhash.remaining_links(links, more, masks, texts, radius, 0.8)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    found = {tuple(r) for r in got.collect()}
    assert len(want) > 100 and want <= found
    assert all(label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= radius and fits(i, j) for i, j in found)
    assert {p for p in found if any(not (fps[p[0]] | fps[p[1]]) & m for m in masks)} == want


def test_key_filter_loses_no_key(spark):
    rng = np.random.default_rng(9)
    keys = [(int(t), int(k)) for t, k in zip(rng.integers(0, 60, 3000), rng.integers(-(2**63), 2**63 - 1, 3000), strict=True)]
    got = simhash.key_filter(simhash.settle(spark.createDataFrame(keys, "_table int, _key long").repartition(3)))
    hashes = lambda ks: simhash._key_hashes(np.array([t for t, _ in ks]), np.array([k for _, k in ks]).view(np.uint64))
    assert simhash._passes(got, hashes(keys)).all()
    others = [(t, k) for t, k in zip(rng.integers(0, 60, 20_000).tolist(), rng.integers(-(2**63), 2**63 - 1, 20_000).tolist(), strict=True)]
    assert simhash._passes(got, hashes(others)).mean() < 0.04


def test_crowded_keys_link_near_fingerprints_first():
    rng = np.random.default_rng(2)
    base = np.uint64(rng.integers(0, 2**63))
    fps = np.unique(np.array([base] + [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(63, 5, replace=False))) for _ in range(300)], np.uint64))
    for keys in (np.zeros((2, len(fps)), np.int64), np.arange(len(fps))[None] // 50):
        pairs = simhash._near_links(fps, keys, 12)
        assert len(pairs[0]) <= 3 * (len(fps) - 1)
    pairs = simhash._near_links(fps, np.zeros((2, len(fps)), np.int64), 12)
    assert len(pairs[2]) == 1  # links of the key are left for the second look
    u, v = (x.view(np.uint64) for x in pairs[:2])
    close = [(int(a), int(b)) for a, b in zip(u, v, strict=True) if (int(a) ^ int(b)).bit_count() <= 6]
    low = {int(x): int(x) for x in fps}  # the links of half the radius alone hold the group together

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in close:
        low[root(a)] = root(b)
    assert len({root(int(x)) for x in fps}) == 1


def test_sampled_tables_meet_pairs_as_surely_as_promised():
    rng = np.random.default_rng(5)
    for n in (1000, 300_000):
        masks = np.array(simhash.sampled_tables(n, 12, 0.95), np.uint64)
        met = 0
        for _ in range(400):
            flip = np.uint64(sum(1 << int(b) for b in rng.choice(64, 12, replace=False)))
            met += bool(((masks & flip) == 0).any())
        assert met >= 0.9 * 400


def test_nearest_forest_is_a_minimum_spanning_forest():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = 25
        u, v = rng.integers(0, n, 60), rng.integers(0, n, 60)
        d = rng.integers(0, 9, 60)
        u, v, d = u[u != v], v[u != v], d[u != v]
        root, want = list(range(n)), 0

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in np.argsort(d, kind="stable"):  # Kruskal
            a, b = find(u[i]), find(v[i])
            if a != b:
                root[a], want = b, want + d[i]
        got = simhash.nearest_forest(u, v, d, n)
        assert d[got].sum() == want and len(got) == n - len({find(x) for x in range(n)})


def test_hot_keys_are_dealt_again(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 3).astype(np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(62, 3, replace=False)) for b in base for _ in range(60)})
    d = spark.createDataFrame([(x,) for x in fps], "_fp long").repartition(3)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    edges = [tuple(r) for r in simhash.candidate_links(d, 6, 6, 0.9999)[0].collect()]
    assert all((a ^ b).bit_count() <= 6 for a, b in edges)
    classes = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(classes) == len(fps) and len(set(classes.values())) == 3


def test_components_at_once_are_those_of_the_rounds(spark):
    rng = np.random.default_rng(9)
    edges = [tuple(int(x) for x in r) for r in rng.integers(-300, 300, (250, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(7, None), (None, 8), (5, 5)]
    for rows in (edges, [(5, 5)], []):
        d = spark.createDataFrame(rows, "u long, v long")
        one, other = ([tuple(r) for r in connected_components(d, at_once=k).collect()] for k in (1000, 0))
        assert sorted(one) == sorted(other)
    assert connected_components(spark.createDataFrame(edges, "u long, v long"), at_once=10).count() == len(set(connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))


def test_simhash_settles_few_files(spark, monkeypatch):
    """Each file of a local store starts processes (chmod), so a short table must not be settled in a file for each of many partitions, round after round."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[: 200 + i % 40])) for i in range(120)] + [(1000 + i, f"alone {i} {i * 7} {i * 11}") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = sorted(map(tuple, simhash.simhash_dedup(d).collect()))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    parts = []
    for module in (simhash, components):
        monkeypatch.setattr(module, "settle", lambda df, f=module.settle: parts.append((out := f(df)).rdd.getNumPartitions()) or out)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 97)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(map(tuple, simhash.simhash_dedup(d).collect()))
        assert sum(parts) < 97
        monkeypatch.setattr(simhash, "LINKS_AT_ONCE", 1)  # too many for the driver: rounds
        spark.conf.set("spark.sql.shuffle.partitions", 5)
        assert sorted(map(tuple, simhash.simhash_dedup(d).collect())) == got == before
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len({c for _, _, c, _ in got}) < len(got)


def test_near_duplicates_take_few_tasks(spark):
    """The driver's JVM keeps a record of every task."""
    docs = [(20 * i + k, " ".join(f"w{i * 1000 + j if j != 7 * k else k}" for j in range(300))) for i in range(12) for k in range(4)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-tasks", "near_duplicates")
        classes = {r.doc_id: r.component for r in simhash.near_duplicates(d).collect()}
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few-tasks")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({(i // 20, c) for i, c in classes.items()}) == len(set(classes.values())) == 12
    stages = [sc.statusTracker().getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
    ran = sum(s.numCompletedTasks for s in stages if s)
    assert ran < 60 * 97


def test_line_dedup_leaves_texts_in_place(spark):
    """Whole lines in two shuffles filled the executors' heap."""
    d = spark.createDataFrame([(i, f"own {i}\nshared footer\n") for i in range(30)], "doc_id int, text string").repartition(3)
    got = line_dedup.line_dedup(d.localCheckpoint())
    assert {(r.n_lines, r.n_dropped, r.kept_text == f"own {r.doc_id}\n") for r in got.collect()} == {(3, 1, True)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [262_144, 0])
@pytest.mark.parametrize("min_chars", [1, 3])
def test_line_dedup_of_odd_rows_by_broadcast_and_join(spark, monkeypatch, held, min_chars):
    rng = random.Random(4)
    line = lambda: rng.choice(["", " ", "\t\x0b", "é", "Éa", "éA", "éa ", "\xa0ab", "ABC\r", " abc", "K12", "k12", "\x00ab", "ß" * 3, f"own {rng.random()}", "x" * 50])
    rows = [(rng.choice([None, 1, i]), "\n".join(line() for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(7, "abc\nabc\nzz\n")] * 12 + [(None, None), (None, None), (8, ""), (9, "\n\n")]
    monkeypatch.setattr(line_dedup, "KEYS_AT_ONCE", held)
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    count = Counter(k for _, ls in lines for k in {key(x) for x in ls} if len(k) >= min_chars)
    want = [(i, len(ls), sum(count[key(x)] >= 10 for x in ls), "\n".join(x for x in ls if count[key(x)] < 10)) for i, ls in lines]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    got = [tuple(r) for r in line_dedup.line_dedup(d, min_chars=min_chars).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(n for _, _, n, _ in want)
    digests = [tuple(r) for r in line_dedup.line_dedup(d, min_chars=min_chars, digest=True).collect()]
    assert sorted(digests, key=str) == sorted(((*r, hashlib.sha256(t.encode()).hexdigest()) for *r, t in want), key=str)


def test_line_dedup_slices_agree_with_whole_texts(monkeypatch):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["", "a", "B ", "long line"]) for _ in range(rng.randint(1, 12))).encode() for _ in range(50)] + [b"", b"\n", b"\n\n\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), *[pa.array(range(len(texts)), pa.int64())] * 2], names=["_t", "_rk1", "_rk2"])

    def everything():
        kept = [line_dedup.without(t, lambda ls, at: [x == b"a" or (at + i) % 3 == 1 for i, x in enumerate(ls)]) for t in texts]
        hashes = [{h[i : i + 16] for i in range(0, len(h), 16)} for h in (line_dedup.text_hashes(t, 1) for t in texts)]
        runs = [[tuple(r.values()) for b in run([batch]) for r in b.to_pylist()] for run in (line_dedup._distinct(1), line_dedup._positions(1))]
        return kept, hashes, sorted(runs[0]), runs[1]

    whole = everything()
    assert [len(h) for h in whole[1]] == [len({x.strip().lower() for x in t.split(b"\n")} - {b""}) for t in texts]
    for t, (n, dropped, kept) in zip(texts, whole[0], strict=True):
        stay = [x for i, x in enumerate(t.split(b"\n")) if x != b"a" and i % 3 != 1]
        assert (n, dropped, kept) == (t.count(b"\n") + 1, t.count(b"\n") + 1 - len(stay), b"\n".join(stay))
    monkeypatch.setattr(line_dedup, "ROWS", 2)
    for size in (1, 2, 7):
        monkeypatch.setattr(line_dedup, "SLICE", size)
        assert everything() == whole
