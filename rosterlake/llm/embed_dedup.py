"""Embedding near-dedup by an inverted multi-index.

Unit vectors are cut in two halves with a codebook each; cells are pairs of codes. A vector walks the product
grid by the multi-sequence method: cells in ascending order of a lower bound on the squared way to them (the
distance to the bisecting hyperplanes), until the bound passes a quarter of the squared radius of the cosine
threshold. Of two linked vectors the one nearer to a hyperplane crosses at most half their distance to it, so
both visit a common cell: the target recall is 1. Pairs that meet are verified in double precision, in the first
of their common cells only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_ROWS, broadcast_if_small, settle
from .components import connected_components, forest

#: Codes of a half: at least and at most, and the vectors of one label that a cell of the grid is asked to be home to.
CODES, MOST_CODES, CELL_ROWS = 16, 64, 1024
#: Vectors that the codebooks are fitted on at most, the smallest by a hash of their id.
SAMPLE = 8192
#: Vectors of one cell beyond which it is cut into chunks.
CHUNK = 4096
BLOCK = 1024


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and squares neither vanish nor overflow."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """At most k distinct centres."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, float)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _squared(x, centres).argmin(axis=1)
        for i in range(k):
            if (near == i).any():
                centres[i] = x[near == i].mean(axis=0)
    return np.unique(centres, axis=0)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def half_bounds(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of each row to the hyperplane between its nearest code and each code (0 for the nearest)."""
    d = _squared(x, codes)
    home = d.argmin(axis=1)
    apart = np.sqrt(_squared(codes, codes))[home]
    gap = d - d[np.arange(len(x)), home][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(apart > 0, gap / (2 * apart), 0.0)
    return np.square(np.maximum(bound - 1e-7, 0))


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) in ascending order of a[i] + b[j], as long as that is within the limit."""
    order_a = [i for i in np.argsort(a, kind="stable").tolist() if a[i] <= limit]
    order_b = [j for j in np.argsort(b, kind="stable").tolist() if b[j] <= limit]
    out: list[tuple[int, int]] = []
    if not order_a or not order_b:
        return out
    heap = [(a[order_a[0]] + b[order_b[0]], 0, 0)]
    while heap:
        cost, p, q = heapq.heappop(heap)
        if cost > limit:
            break
        out.append((order_a[p], order_b[q]))
        if q + 1 < len(order_b):
            heapq.heappush(heap, (a[order_a[p]] + b[order_b[q + 1]], p, q + 1))
        if q == 0 and p + 1 < len(order_a):
            heapq.heappush(heap, (a[order_a[p + 1]] + b[order_b[0]], p + 1, 0))
    return out


def _matrix(column) -> np.ndarray:
    """Equal-length lists as a float matrix."""
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _place(books, limit: float):
    def run(batches):
        codebooks = books.value
        for b in batches:
            lengths = np.asarray(pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
            for dim in np.unique(lengths):
                part = b.filter(pa.array(lengths == dim))
                x = unit(_matrix(part.column(2)))
                # dimensions that the sample did not hold have the one cell (0, 0)
                one, two = codebooks.get(int(dim), (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))))
                near_a, near_b = half_bounds(x[:, : dim // 2], one), half_bounds(x[:, dim // 2 :], two)
                at, cells, lists = [], [], []
                for r in range(len(x)):
                    visits = sorted(i * len(two) + j for i, j in multi_sequence(near_a[r], near_b[r], limit))
                    at += [r] * len(visits)
                    cells += visits
                    lists += [np.array(visits, "<u2").tobytes()] * len(visits)
                for s in range(0, len(at), 8192):
                    sub = part.take(pa.array(at[s : s + 8192]))
                    yield pa.RecordBatch.from_arrays([*sub.columns, pa.array(cells[s : s + 8192], pa.int32()), pa.array(lists[s : s + 8192], pa.binary())], ["_id", "_label", "_v", "_m", "_ij", "_visits"])

    return run


def _pairs_in_cell(x, norms, before, ids, mult, left, right, threshold):
    """Link counts of all rows from the pairs left x right, and spanning links. before: the earlier cells of each row, as 0 and 1."""
    total = np.zeros(len(ids), np.int64)
    us, vs = [], []
    same = left is right
    for s in range(0, len(left), BLOCK):
        for t in range(s if same else 0, len(right), BLOCK):
            p, q = left[s : s + BLOCK], right[t : t + BLOCK]
            hit = (x[p] @ x[q].T) / (norms[p][:, None] * norms[q][None]) >= threshold
            if same and s == t:
                hit = np.triu(hit, 1)
            if not hit.any():
                continue
            hit &= before[p].astype(np.float32) @ before[q].astype(np.float32).T == 0  # pairs that met in an earlier cell were counted there
            total[p] += hit @ mult[q]
            total[q] += mult[p] @ hit
            i, j = np.nonzero(hit)
            u, v = forest(ids[p][i], ids[q][j])
            us.append(u)
            vs.append(v)
    return total, us, vs


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Counts of links per vector (v null) and spanning links (n null) of all cells in the group."""
        cell = table.column("_cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]]) if len(order) else np.zeros(0, int)
        ids, mult, chunk, place = (table.column(c).to_numpy() for c in ("_id", "_m", "_a", "_ij"))
        cross = table.column("_cross").to_numpy(zero_copy_only=False).astype(bool)
        vectors, visits = table.column("_v").combine_chunks(), table.column("_visits").to_pylist()
        who, counts, us, vs = [], [], [], []
        for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = order[a:z]
            if len(rows) < 2:
                continue
            x = scaled(_matrix(vectors.take(pa.array(rows))))
            earlier = np.frombuffer(b"".join(visits[r] for r in rows), "<u2")
            whose = np.repeat(np.arange(len(rows)), [len(visits[r]) // 2 for r in rows])
            known = earlier < place[rows[0]]
            before = np.zeros((len(rows), int(place[rows[0]])), np.uint8)
            before[whose[known], earlier[known]] = 1
            left = right = np.arange(len(rows))
            if cross[rows[0]]:
                low = chunk[rows] == chunk[rows].min()
                left, right = np.flatnonzero(low), np.flatnonzero(~low)
            total, u, v = _pairs_in_cell(x, np.linalg.norm(x, axis=1), before, ids[rows], mult[rows], left, right, threshold)
            us += u
            vs += v
            who.append(ids[rows][total > 0])
            counts.append(total[total > 0])
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        u, v, w, n = cat(us), cat(vs), cat(who), cat(counts)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"u": pa.array(np.concatenate([w, u])), "v": pa.concat_arrays([none(len(w)), pa.array(v)]), "n": pa.concat_arrays([pa.array(n), none(len(u))])})

    return run


def fit_codebooks(vectors: DataFrame, codes: int, sample: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks of both halves per dimension, from at most `sample` vectors: the one collect here is bounded by it."""
    rows = [np.array(r["_v"], float) for r in vectors.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_v").collect()]
    out = {}
    for dim in {len(r) for r in rows}:
        x = unit(np.array([r for r in rows if len(r) == dim]))
        out[dim] = kmeans(x[:, : dim // 2], codes), kmeans(x[:, dim // 2 :], codes)
    return out


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, codes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two vectors of one label (and one length) link when their cosine in double precision is at least `threshold`.
    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do rows with a
    null label or id: no links, component_id their own id. Equal vectors are indexed once with their number; each
    of them counts the others. Rows repeating an id count as separate vectors of one component. kept marks rows
    whose id is their component's smallest. Ids are whole numbers, labels of any type, vectors of any numbers:
    single-precision ones stay so in storage, others are held in double precision. The grid has as many codes as the
    square root of the largest label's vectors asks for (CODES to MOST_CODES). An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    good = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = good & F.exists(vector_col, lambda x: x != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    base = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"), F.when(F.coalesce(good, F.lit(False)), v).alias("_v"))
    base = base.withColumn("_k1", F.when(F.col("_v").isNotNull(), F.xxhash64("_label", "_v"))).withColumn("_k2", F.when(F.col("_v").isNotNull(), F.xxhash64(F.lit(1), "_v", "_label")))
    copies = base.where("_v IS NOT NULL").groupBy("_label", "_v").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_m"), F.first("_k1").alias("_k1"), F.first("_k2").alias("_k2"))
    copies = settle(copies)
    if codes is None:
        most = copies.groupBy("_label").count().agg(F.max("count")).first()[0] or 0
        codes = int(np.clip(np.ceil(np.sqrt(most / CELL_ROWS)), CODES, MOST_CODES))
    spark = vectors.sparkSession
    books = spark.sparkContext.broadcast(fit_codebooks(copies, codes, sample))
    limit = (2 - 2 * threshold) / 4 + 1e-6
    placed = settle(copies.select("_id", "_label", "_v", "_m").mapInArrow(_place(books, limit), f"_id long, _label {vectors.schema[label_col].dataType.simpleString()}, _v {kind}, _m long, _ij int, _visits binary"))
    cell = ["_label", "_size", "_ij"]
    placed = placed.withColumn("_size", F.size("_v"))
    # cells of one vector hold no pair; large cells are cut into chunks, and each pair of chunks is a cell of its own
    sizes = settle(placed.groupBy(*cell).count().where("count > 1").select(*cell, F.ceil(F.col("count") / CHUNK).cast("int").alias("_c")))
    placed = placed.join(broadcast_if_small(sizes, 64), cell).withColumn("_a", F.pmod(F.xxhash64("_id"), F.col("_c")).cast("int"))
    placed = placed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    placed = placed.withColumn("_cell", F.xxhash64(*cell, F.least("_a", "_b"), F.greatest("_a", "_b")))
    # a chunk meets itself in the cell (a, a); in (a, b) it meets the other one
    placed = placed.withColumn("_cross", F.col("_a") != F.col("_b"))
    rows = placed.count()
    placed = placed.withColumn("_g", F.pmod("_cell", F.lit(max(12, -(-rows * 16 // GROUP_ROWS)))))
    placed = placed.select("_g", "_cell", "_ij", "_id", "_v", "_m", "_visits", "_a", "_cross")
    found = settle(placed.groupBy("_g").applyInArrow(_verify(threshold), "u long, v long, n long"))
    links = found.where("v IS NULL").groupBy(F.col("u").alias("_rep")).agg(F.sum("n").alias("_n"))
    comps = connected_components(found.where("v IS NOT NULL").select("u", "v"))
    reps = copies.select("_k1", "_k2", F.col("_id").alias("_rep"), "_m")
    reps = reps.join(links, "_rep", "left").join(comps.select(F.col("node").alias("_rep"), F.col("component").alias("_c")), "_rep", "left")
    out = base.select("_id", "_k1", "_k2").join(reps, ["_k1", "_k2"], "left")
    component = F.coalesce("_c", "_rep", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        (F.coalesce("_n", F.lit(0)) + F.coalesce(F.col("_m") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(False)).alias("kept"),
    )


SQL = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
reach AS (
  WITH RECURSIVE r(u, w) AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u)
  SELECT u, min(least(u, w)) AS c FROM r GROUP BY u
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(reach.c, e.vec_id) AS component_id, coalesce(reach.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN reach ON reach.u = e.vec_id
"""
