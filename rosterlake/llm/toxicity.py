"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are hashed by prefix sums over the bytes of many texts at once. Filters of several widths slide over the
word embeddings, each keeps its maximum over the whole text, and a logistic layer reads these maxima.
Decision thresholds are calibrated by language on rows kept out of the gradient steps; the score itself never
sees language, source, id or label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, in_small_batches, releasing, settle, unused

BUCKET_BITS = 16
#: A word's embedding is the sum of three hashed rows: two hashes of the word and one of its first bytes.
#: Two hashes tell words apart that share one bucket.
HASHES, PREFIX_BYTES = 3, 4
PAD = HASHES << BUCKET_BITS
WIDTHS = (1, 2, 3)
PADS = max(WIDTHS)
DIM, FILTERS = 8, 8
#: Labelled documents that training may use at most, the smallest by a hash of their id. Texts are used whole.
SAMPLE_DOCS = 6000
#: Characters of text that training may use at most: rows are taken in that order while they fit.
SAMPLE_CHARS = 64 << 20
SLICE_BYTES = 1 << 18
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
WORDS_AT_ONCE = 1 << 17
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            make = lambda p: np.cumprod(np.r_[np.uint64(1), np.full(2 * n, p, np.uint64)], dtype=np.uint64)
            self.up, self.down = make(_P), make(_P_INVERSE)
        return self.up[:n], self.down[:n]


_powers = _Powers()
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids (words, HASHES) of all words, each text followed by PADS pads, and where each text starts."""
    blob = np.frombuffer(("\n".join(t.lower() for t in texts) + "\n").encode(), np.uint8)
    word = _IS_WORD[blob]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers.of(len(blob) + 1)
    total = np.r_[np.uint64(0), np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * up[: len(blob)], dtype=np.uint64)]
    shift, mix, top = np.uint64(29), np.uint64(0xBF58476D1CE4E5B9), np.uint64(64 - BUCKET_BITS)
    h = (total[ends] - total[starts]) * down[starts]
    h = (h ^ (h >> shift)) * mix
    again = (h ^ (h >> shift)) * mix
    prefix = (total[np.minimum(ends, starts + PREFIX_BYTES)] - total[starts]) * down[starts] + np.uint64(77)
    prefix = (prefix ^ (prefix >> shift)) * mix
    ids = np.stack([(x >> top).astype(np.int32) + (k << BUCKET_BITS) for k, x in enumerate((h, again, prefix))], axis=1)
    text_ends = np.cumsum(np.fromiter((len(t.lower().encode()) + 1 for t in texts), np.int64, len(texts)))
    before = np.searchsorted(starts, text_ends)
    sizes = np.diff(before, prepend=0) + PADS
    firsts = np.cumsum(sizes) - sizes
    out = np.full((int(sizes.sum()), HASHES), PAD, np.int32)
    doc = np.repeat(np.arange(len(texts)), sizes - PADS)
    out[np.arange(len(ids)) + PADS * doc] = ids
    return out, firsts


def long_text_buckets(text: str, size: int = SLICE_BYTES):
    """(bucket ids, words repeated) of slices of one long text; each opens with the last words of the one before, the pads end the last.

    A word of over `size` characters may be read as two.
    """
    text, at = text.lower(), 0
    carry = np.zeros((0, HASHES), np.int32)
    while at < len(text):
        gap = _GAP.search(text, at + size, at + 2 * size)
        stop = gap.end() if gap else min(len(text), at + 2 * size)
        ids, _ = word_buckets([text[at:stop]])
        ids = np.concatenate([carry, ids[:-PADS]])
        again, at = len(carry), stop
        if at >= len(text):
            ids = np.concatenate([ids, np.full((PADS, HASHES), PAD, np.int32)])
        elif not len(ids):
            continue
        yield ids, again
        carry = ids[-(PADS - 1) :]


@dataclass
class Model:
    emb: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str | None, float] | None = None


def word_vectors(emb: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = emb[ids[:, 0]]
    for k in range(1, HASHES):
        out += emb[ids[:, k]]
    return out


def pooled_maxima(ids: np.ndarray, firsts: np.ndarray, model: Model) -> np.ndarray:
    """Per text the maximum of each filter, over windows that begin within the text."""
    n_docs = len(firsts)
    ends = np.r_[firsts[1:], len(ids)]
    out = np.full((n_docs, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    doc_of_block = 0
    for a in range(0, len(ids), WORDS_AT_ONCE):
        b = min(a + WORDS_AT_ONCE, len(ids))
        first_doc = np.searchsorted(firsts, a, side="right") - 1
        last_doc = np.searchsorted(firsts, b, side="left")
        cuts = np.maximum(firsts[first_doc:last_doc], a) - a
        doc_of_block = slice(first_doc, last_doc)
        x = word_vectors(model.emb, ids[a : b + PADS - 1])
        for k, w in enumerate(WIDTHS):
            n = max(0, min(b + w - 1, len(ids)) - a - w + 1)
            conv = x[:n] @ model.filters[w][0]
            for j in range(1, w):
                conv += x[j : n + j] @ model.filters[w][j]
            if n < b - a:
                conv = np.vstack([conv, np.full((b - a - n, FILTERS), -np.inf, np.float32)])
            for back in range(1, w):  # windows that would reach into the next text
                late = ends[first_doc:last_doc] - back
                conv[late[(late >= a) & (late < b)] - a] = -np.inf
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            out[doc_of_block, cols] = np.maximum(out[doc_of_block, cols], np.maximum.reduceat(conv, cuts, axis=0))
    return np.maximum(out + np.concatenate([model.bias[w] for w in WIDTHS]), 0)


def maxima_of_long_text(text: str, model: Model, size: int = SLICE_BYTES) -> np.ndarray:
    """pooled_maxima of one text: maxima over slices are the maxima of the whole, as slices overlap by a window less one word."""
    parts = [pooled_maxima(ids, np.zeros(1, np.int64), model)[0] for ids, _ in long_text_buckets(text, size)]
    return np.max(parts, axis=0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logits(model: Model, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return pooled_maxima(ids, firsts, model) @ model.out + model.out_bias


def train(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 7, epochs: int | None = None) -> Model:
    """docs: bucket ids of each text with its pads. A fifth of the rows calibrates; the others give gradients."""
    rng = np.random.default_rng(seed)
    n = len(docs)
    y = np.asarray(labels, np.float32)
    if not n or y.min() == y.max():  # nothing to learn: the rate itself
        rate = float(np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
        zero = {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS}
        return Model(np.zeros((PAD + 1, DIM), np.float32), zero, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.zeros(len(WIDTHS) * FILTERS, np.float32), float(np.log(rate / (1 - rate))), thresholds={None: float("inf")})
    held = rng.permutation(n) % 5 == 0
    fit = np.flatnonzero(~held)
    # the first embedding coordinate starts at the bucket's log odds as far as they are significant
    seen = np.zeros((2, PAD + 1))
    for i in fit:
        seen[int(y[i]), np.unique(docs[i])] += 1
    base = float(y[fit].mean())
    count = seen.sum(0)
    z = (seen[1] - count * base) / np.sqrt(np.maximum(count, 1) * base * (1 - base))
    odds = np.log((seen[1] + base) / (seen[0] + 1 - base)) - np.log(base / (1 - base))
    emb = rng.normal(0, 0.02, (PAD + 1, DIM)).astype(np.float32)
    emb[:, 0] = np.clip(odds, -3, 3) / HASHES * np.clip((np.abs(z) - 2) / 3, 0, 1)
    emb[PAD] = 0
    filters = {w: rng.normal(0, 0.1 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    bias = {w: np.full(FILTERS, 0.1, np.float32) for w in WIDTHS}
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    for k, w in enumerate(WIDTHS):  # half of each width's filters start out reading that coordinate, past one or two hashes of three
        filters[w][:, 0, : FILTERS // 2] = 1.0 / w if w > 1 else 1.0
        bias[w][: FILTERS // 2] = np.linspace(-1.6, -0.4, FILTERS // 2) / w
        out[k * FILTERS : k * FILTERS + FILTERS // 2] = 0.5
    out_bias = np.float32(np.log(base / (1 - base)))
    params = {"emb": emb, "out": out, **{f"f{w}": filters[w] for w in WIDTHS}, **{f"b{w}": bias[w] for w in WIDTHS}}
    square = {k: np.full_like(v, 1e-2) for k, v in params.items()}
    square_bias = 1e-3
    rate_of = 0.05
    for _ in range(epochs or int(np.clip(20000 // max(1, len(fit)), 3, 25))):
        order = rng.permutation(fit)
        for s in range(0, len(order), 32):
            batch = order[s : s + 32]
            ids = np.concatenate([docs[i] for i in batch])
            sizes = np.array([len(docs[i]) for i in batch])
            firsts = np.cumsum(sizes) - sizes
            x = word_vectors(emb, ids)
            pooled, at = np.empty((len(batch), len(out)), np.float32), np.empty((len(batch), len(out)), np.int64)
            for k, w in enumerate(WIDTHS):
                conv = sum(x[j : len(x) - w + 1 + j] @ filters[w][j] for j in range(w))
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for i, (a, m) in enumerate(zip(firsts, sizes, strict=True)):
                    p = conv[a : a + m - w + 1].argmax(axis=0)
                    at[i, cols] = a + p
                    pooled[i, cols] = conv[a + p, np.arange(FILTERS)]
                pooled[:, cols] += bias[w]
            active = pooled > 0
            keep = rng.random(pooled.shape) < 0.8  # dropout
            hidden = np.where(active & keep, pooled / 0.8, 0)
            err = (_sigmoid(hidden @ out + out_bias) - y[batch]).astype(np.float32) / len(batch)
            back = np.where(active & keep, err[:, None] * out / 0.8, 0).astype(np.float32)
            grads = {"out": hidden.T @ err + 1e-4 * out}
            touched, pushes = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                d, p = back[:, cols], at[:, cols]
                grads[f"b{w}"] = d.sum(0)
                grads[f"f{w}"] = np.stack([np.einsum("bf,bfd->df", d, x[p + j]) for j in range(w)]) + 1e-4 * filters[w]
                for j in range(w):
                    push = (d[:, :, None] * filters[w][j].T[None]).reshape(-1, DIM)
                    for k_hash in range(HASHES):
                        touched.append(ids[p + j, k_hash].ravel())
                        pushes.append(push)
            rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            grad = np.zeros((len(rows), DIM), np.float32)
            np.add.at(grad, inverse, np.concatenate(pushes))
            grad[rows == PAD] = 0
            square["emb"][rows] += grad**2
            emb[rows] -= 0.2 * rate_of * grad / np.sqrt(square["emb"][rows])
            for k, g in grads.items():
                square[k] += g**2
                params[k] -= rate_of * g / np.sqrt(square[k])
            g = err.sum()
            square_bias += g * g
            out_bias -= rate_of * g / np.sqrt(square_bias)
    model = Model(emb, filters, bias, out, float(out_bias))
    _calibrate(model, [docs[i] for i in np.flatnonzero(held)], y[held], [langs[i] for i in np.flatnonzero(held)])
    return model


def _calibrate(model: Model, docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], least: int = 15) -> None:
    """Platt scaling, then per language the threshold of least error on its own rows, to which all rows together add as much as `least` rows."""
    model.thresholds = {None: 0.5}
    if not docs or y.min() == y.max():
        return
    sizes = np.array([len(d) for d in docs])
    z = _logits(model, np.concatenate(docs), np.cumsum(sizes) - sizes).astype(float)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    line = np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        t = v[0] * z + v[1]
        return float((np.logaddexp(0, t) - target * t).sum() + 0.5 * (v[0] - 1) ** 2 + 0.005 * v[1] ** 2)

    for _ in range(50):  # Newton steps, halved until the loss falls
        p = 1 / (1 + np.exp(-np.clip(line[0] * z + line[1], -40, 40)))
        w = p * (1 - p)
        grad = np.array([((p - target) * z).sum() + line[0] - 1, (p - target).sum() + 0.01 * line[1]])
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step, now = np.linalg.solve(hess, grad), loss(line)
        while np.abs(step).max() > 1e-9 and loss(line - step) > now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        line = line - step
    if line[0] > 0:
        model.slope, model.shift = float(line[0]), float(line[1])
    score = _sigmoid(model.slope * z + model.shift)

    cuts = np.unique(np.r_[0.5, (np.sort(score)[1:] + np.sort(score)[:-1]) / 2])

    def best(weight: np.ndarray) -> float:
        """Least weighted error, a wrong rejection counting double; ties go to the cut nearest 0.5."""
        cost = [round(float((weight * np.where(y == 0, 2 * (score >= c), score < c)).sum()), 9) for c in cuts]
        return float(min(zip(cost, np.abs(cuts - 0.5), cuts, strict=True))[2])

    every = np.full(len(y), least / len(y))
    model.thresholds[None] = best(every)
    for lang in sorted({x for x in langs if x is not None}):
        model.thresholds[lang] = best(every + np.array([x == lang for x in langs]))


def _bucket_rows(batches):
    for b in batches:
        packed = []
        for t in b.column(1).to_pylist():
            packed.append(b"".join(ids[again:].tobytes() for ids, again in long_text_buckets(t)) if t else np.full((PADS, HASHES), PAD, np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), *b.columns[2:]], ["_id", "ids", "lang", "toxic", "_h"])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str, sample: int) -> list:
    """At most `sample` labelled rows outside the held-out fold, as bucket ids; the collects here are bounded by it and by SAMPLE_CHARS.

    Rows equal in id and text count once, rows of one id and different texts one by one.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("toxic"))
    known = known.where(~is_held_out(F.col("_id")))
    rows = in_small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("lang"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    picked = rows.join(F.broadcast(chosen), "_id").withColumn("_h", F.xxhash64("_t", "lang"))  # at most `sample` ids
    picked = settle(picked.groupBy("_id", "_h").agg(F.first("_t").alias("_t"), F.first("lang").alias("lang"), F.first("toxic").alias("toxic")))
    order = [F.xxhash64("_id"), "_id", "_h"]
    sizes = picked.select("_id", "_h", F.coalesce(F.length("_t"), F.lit(0)).alias("n")).orderBy(*order).limit(sample).collect()
    keys, left = [], SAMPLE_CHARS
    for r in sizes:
        if r["n"] <= left:
            keys.append((r["_id"], r["_h"]))
            left -= r["n"]
    kind = docs.schema[id_col].dataType.simpleString()
    keys = docs.sparkSession.createDataFrame(keys, f"_id {kind}, _h long")
    used = picked.join(F.broadcast(keys), ["_id", "_h"]).select("_id", "_t", "lang", "toxic", "_h")
    found = used.mapInArrow(releasing(_bucket_rows), f"_id {kind}, ids binary, lang string, toxic int, _h long")
    return found.orderBy("_id", "_h").toArrow().to_pylist()  # collect() would hold each row several times in the driver


def is_held_out(id_column):
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _scores(shared, name: str):
    def run(batches):
        model = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            scores = [np.zeros(0)]
            for a, z in byte_slices([len(t) for t in texts], SLICE_BYTES):
                if len(texts[a]) > SLICE_BYTES:  # it stands alone
                    logits = (maxima_of_long_text(texts[a], model) @ model.out + model.out_bias).reshape(1)
                else:
                    logits = _logits(model, *word_buckets(texts[a:z]))
                scores.append(_sigmoid(model.slope * logits.astype(float) + model.shift))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores))], [*b.schema.names, name])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", sample: int = SAMPLE_DOCS) -> DataFrame:
    """docs with held_out, score (0 to 1), predicted (score >= 0.5), threshold (of its language) and rejected (score >= threshold).

    Trains on at most `sample` labelled rows whose crc32(id as text) mod 5 is not 0, then scores every whole text.
    Null text counts as empty and gets the score of no words; a null id is not held out; repeated rows get equal
    scores, and rows of one id are scored by their own texts. A label tie (as many 0 as 1 for an id) counts as toxic.
    Without usable labels, or with none of one kind, the score is constant and nothing is rejected. Texts of any length are read as a whole,
    in slices. An empty table gives an empty result. Columns of docs named like the new ones are replaced, all others
    are passed on, whatever their names.
    """
    new = ("held_out", "score", "predicted", "threshold", "rejected")
    text, made = unused([*docs.columns, *new], "_text", "_score")
    rest = [c for c in docs.columns if c not in new]
    rows = training_rows(docs, labels, id_col, text_col, lang_col, label_col, sample)
    model = train([np.frombuffer(r["ids"], np.int32).reshape(-1, HASHES) for r in rows], np.array([r["toxic"] for r in rows], np.float32), [r["lang"] for r in rows])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a fixed size: 3 x 2**16 rows of 8 numbers
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{text}` string", f"`{made}` double"])
    scored = in_small_batches(docs).select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`").cast("string").alias(text)).mapInArrow(releasing(_scores(shared, made)), schema)
    common = model.thresholds[None]
    threshold = F.lit(common)
    for lang, cut in model.thresholds.items():
        if lang is not None:
            threshold = F.when(F.col(f"`{lang_col}`") == lang, cut).otherwise(threshold)
    return scored.select(
        *(F.col(f"`{c}`") for c in rest),
        is_held_out(F.col(f"`{id_col}`")).alias("held_out"),
        F.col(made).alias("score"),
        (F.col(made) >= 0.5).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col(made) >= threshold).alias("rejected"),
    )
