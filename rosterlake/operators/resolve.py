"""Three-stage resolver: exact keys, blocked vector similarity, scored adjudication.

The reference point is one record against a list; here both sides are tables. Exact keys are equi-joins against the
first golden record of each key. What stays open meets golden records by blocking keys; vectors are integer counts
of signed hashed grams, made once per record and compared as arrays, so a similarity is one division.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import normalize as N
from rosterlake.functions import tokens as T

from .settle import settle

DIMENSIONS = 256
#: Scores of the exact stages and weights of the adjudication.
STAGE_SCORES = {"1a": 1.0, "1b": 0.98, "1c": 0.97}
STAGE_REASONS = {"1a": "Exact tokenized SSN match.", "1b": "Exact match on DOB + ZIP5 + SSN-last-4.", "1c": "Exact match on DOB + soundex(first+last) + ZIP5."}
WEIGHTS = {"first": 0.25, "sounds_alike": 0.10, "last": 0.25, "dob": 0.25, "zip": 0.10, "ssn4": 0.15}
AUTO_MATCH, REVIEW = 0.95, 0.80


def prepare(raw: DataFrame, id_col: str, secret: bytes, partner: Column | None = None) -> DataFrame:
    """What the resolver compares of raw roster rows: normalised and raw keys, blocks, feature string; position orders the index.

    partner: tokens are scoped by it; without one they are cross-reference tokens, equal for all partners.
    """
    c = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    ssn = T.cross_reference(secret, "ssn", c("ssn")) if partner is None else T.tokenize(secret, partner, "ssn", c("ssn"))
    fields = raw.select(
        F.col(id_col).alias("id"), "position", ssn.alias("ssn_token"), F.coalesce(N.ssn_last4(c("ssn")), F.lit("")).alias("ssn4"),
        N.normalize_dob(c("dob")).alias("dob"), N.normalize_zip(c("zip")).alias("zip"),
        N.normalize_name(c("first_name")).alias("first"), N.normalize_name(c("middle_name")).alias("middle"), N.normalize_name(c("last_name")).alias("last"),
        N.soundex_reset(c("first_name")).alias("sx_first"), N.soundex_reset(c("last_name")).alias("sx_last"),
        c("address_line_1").alias("_address"), c("city").alias("_city"), c("state").alias("_state"),
    )
    f = F.col
    blocks = N.blocking_keys_of(f("last"), f("dob"), f("zip")).alias("blocks")
    features = N.feature_string_of(f("first"), f("middle"), f("last"), f("dob"), f("_address"), f("_city"), f("_state"), f("zip"), f("ssn4")).alias("features")
    return fields.select("id", "position", "ssn_token", "ssn4", "dob", "zip", "first", "last", "sx_first", "sx_last", blocks, features)


def as_index(prepared: DataFrame) -> DataFrame:
    return prepared.withColumnRenamed("id", "golden_id")


def _grams(text: Column) -> Column:
    """Character trigrams and token bigrams of lower-case text, repeats included."""
    t = F.lower(text)
    none = F.array().cast("array<string>")
    three = F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3)))).otherwise(none)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    pairs = F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(none)
    return F.concat(three, pairs)


def embed(df: DataFrame, text_col: str = "features") -> DataFrame:
    """(text, at, n, dense, norm2) per distinct text: filled dimensions, their signed counts, all 256 counts, squared length."""
    h = F.conv(F.substring(F.sha1("g"), 1, 8), 16, 10).cast("long")
    rows = df.select(F.col(text_col).alias("text")).distinct().select("text", F.explode(_grams(F.col("text"))).alias("g"))
    rows = rows.select("text", (h % DIMENSIONS).cast("int").alias("at"), F.when(h >= 1 << 31, 1).otherwise(-1).alias("s"))
    rows = rows.groupBy("text", "at").agg(F.sum("s").cast("int").alias("n")).where("n <> 0")
    got = rows.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("_v"), F.sum(F.col("n") * F.col("n")).alias("norm2"))
    got = got.select("text", "norm2", F.transform("_v", lambda e: e["at"]).alias("at"), F.transform("_v", lambda e: e["n"]).alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.get("n", (F.array_position("at", i) - 1).cast("int")), F.lit(0)))
    return got.withColumn("dense", dense)


def cosine(a_at: Column, a_n: Column, a_norm2: Column, b_dense: Column, b_norm2: Column) -> Column:
    """Cosine of count vectors, the dot product in whole numbers; a zero vector counts as of length 1."""
    dot = F.aggregate(F.zip_with(a_at, a_n, lambda i, n: n * F.get(b_dense, i)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    one = lambda n: F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1)).otherwise(n).cast("double")
    return dot.cast("double") / F.sqrt(one(a_norm2) * one(b_norm2))


def exact_match(incoming: DataFrame, golden: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """(id, golden_id, stage): the first golden record (smallest position) with equal, non-empty keys."""
    full = lambda d: d.where(" AND ".join(f"{k} <> ''" for k in keys))
    first = full(golden).groupBy(*keys).agg(F.min_by("golden_id", "position").alias("golden_id"))
    return full(incoming).join(first, keys).select("id", "golden_id", F.lit(stage).alias("stage"))


def match_ssn(incoming: DataFrame, golden: DataFrame) -> DataFrame:
    return exact_match(incoming, golden, ["ssn_token"], "1a")


def match_ssn4_dob_zip(incoming: DataFrame, golden: DataFrame) -> DataFrame:
    return exact_match(incoming, golden, ["ssn4", "dob", "zip"], "1b")


def match_soundex(incoming: DataFrame, golden: DataFrame) -> DataFrame:
    """By the sound of the names as they came, not of the normalised ones."""
    return exact_match(incoming, golden, ["dob", "sx_last", "sx_first", "zip"], "1c")


def deterministic(incoming: DataFrame, golden: DataFrame) -> DataFrame:
    """(id, golden_id, stage): the first exact stage that finds a record."""
    parts = match_ssn(incoming, golden).unionByName(match_ssn4_dob_zip(incoming, golden)).unionByName(match_soundex(incoming, golden))
    return parts.groupBy("id").agg(F.min_by("golden_id", "stage").alias("golden_id"), F.min("stage").alias("stage"))


def block_pairs(incoming: DataFrame, golden: DataFrame) -> DataFrame:
    """(id, golden_id) that share any blocking key.

    A hot block is a hot key of one equi-join, which adaptive execution splits; blank_blocks tells how large the
    blocks of records without year, name or ZIP are, and without_blank_blocks takes them out.
    """
    a = incoming.select("id", F.explode("blocks").alias("b"))
    return a.join(golden.select("golden_id", F.explode("blocks").alias("b")), "b").select("id", "golden_id").distinct()


def is_blank_block(key: Column) -> Column:
    return key.startswith("????|") | key.endswith("|???") | key.contains("||")


def without_blank_blocks(df: DataFrame) -> DataFrame:
    """df whose records no longer meet by a key that lacks year, name or ZIP; blank_blocks counts what that excludes."""
    return df.withColumn("blocks", F.filter("blocks", lambda k: ~is_blank_block(k)))


def blank_blocks(df: DataFrame) -> DataFrame:
    """(block, n) of the blocks that lack year, name or ZIP."""
    return df.select(F.explode("blocks").alias("block")).where(is_blank_block(F.col("block"))).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


def similarities(pairs: DataFrame, incoming: DataFrame, golden: DataFrame) -> DataFrame:
    """(id, golden_id, position, sim) of the pairs; each distinct feature string is embedded once."""
    pairs = settle(pairs)
    met = incoming.join(pairs.select("id").distinct(), "id", "left_semi").select("features").unionByName(golden.join(pairs.select("golden_id").distinct(), "golden_id", "left_semi").select("features"))
    vectors = settle(embed(met))
    a = incoming.select("id", F.col("features").alias("text")).join(vectors, "text").select("id", F.col("at").alias("a_at"), F.col("n").alias("a_n"), F.col("norm2").alias("a2"))
    b = golden.select("golden_id", "position", F.col("features").alias("text")).join(vectors, "text").select("golden_id", "position", F.col("dense").alias("b_dense"), F.col("norm2").alias("b2"))
    joined = pairs.join(a, "id").join(b, "golden_id")
    return joined.select("id", "golden_id", "position", cosine(F.col("a_at"), F.col("a_n"), F.col("a2"), F.col("b_dense"), F.col("b2")).alias("sim"))


def knn_topk(sims: DataFrame, top_k: int = 10, least: float = 0.85) -> DataFrame:
    """(id, golden_id, sim, rank): the most similar candidates, ties in index order, those under `least` left out after ranking."""
    by = Window.partitionBy("id").orderBy(F.desc("sim"), "position")
    ranked = sims.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)
    return ranked.where(F.col("sim") >= least).select("id", "golden_id", "sim", "rank")


def adjudicate(a: dict[str, Column], b: dict[str, Column], similarity: Column) -> Column:
    """Local score of two records: the agreeing fields' weights plus half the similarity above .85; at most .999.

    a, b: first, last, dob, zip, ssn4, sx_first. Blank equals blank but for ssn4, which both must have.
    """
    same = _agreements(a, b)
    first = F.when(same["first"], WEIGHTS["first"]).when(same["sounds_alike"], WEIGHTS["sounds_alike"]).otherwise(0.0)
    score = first
    for k in ("last", "dob", "zip", "ssn4"):
        score = score + F.when(same[k], WEIGHTS[k]).otherwise(0.0)
    return F.least(score + (similarity - 0.85) * 0.5, F.lit(0.999))


def _agreements(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    same = {k: F.coalesce(a[k], F.lit("")) == F.coalesce(b[k], F.lit("")) for k in ("first", "last", "dob", "zip", "ssn4")}
    same["ssn4"] = same["ssn4"] & (F.coalesce(a["ssn4"], F.lit("")) != "")
    same["sounds_alike"] = a["sx_first"] == b["sx_first"]
    return same


def reasoning(a: dict[str, Column], b: dict[str, Column]) -> Column:
    same = _agreements(a, b)
    parts = [
        F.when(same["first"], "first name matches after normalization").when(same["sounds_alike"], "first names sound alike"),
        F.when(same["last"], "last name matches"), F.when(same["dob"], "DOB matches exactly"), F.when(same["zip"], "ZIP matches"), F.when(same["ssn4"], "SSN last 4 matches"),
    ]
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", "No strong signals.").otherwise(text)


def classify(score: Column, auto: float = AUTO_MATCH, review: float = REVIEW) -> Column:
    return F.when(score >= auto, "AUTO_MATCH").when(score >= review, "REVIEW").otherwise("NO_MATCH")


FIELDS = ("first", "last", "dob", "zip", "ssn4", "sx_first")
#: Takes (id, golden_id, sim and the fields of both sides, the golden ones with g_ before them), returns (id, golden_id, raw, reasoning).
Adjudicator = Callable[[DataFrame], DataFrame]


def adjudicate_local(pairs: DataFrame) -> DataFrame:
    a, b = {k: F.col(k) for k in FIELDS}, {k: F.col(f"g_{k}") for k in FIELDS}
    return pairs.select("id", "golden_id", adjudicate(a, b, F.col("sim")).alias("raw"), reasoning(a, b).alias("reasoning"))


def resolve(incoming: DataFrame, golden: DataFrame, least: float = 0.85, adjudicator: Adjudicator = adjudicate_local, fallback: bool = True) -> DataFrame:
    """(id, golden_id, decision, score, stage, reasoning, candidates_considered) for every incoming record.

    incoming: as prepare() gives it; golden: as_index of that. Only the best candidate is adjudicated. An external
    adjudicator sees the same pairs; rows that it leaves out or gives no score get the local one if `fallback`.
    """
    incoming, golden = settle(incoming), settle(golden)  # each is read by several joins
    size = golden.count()
    exact = settle(deterministic(incoming, golden))
    lookup = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("stage")]
    sure = exact.select("id", "golden_id", F.lit("AUTO_MATCH").alias("decision"), lookup(STAGE_SCORES).alias("score"), F.lit("deterministic").alias("stage"), lookup(STAGE_REASONS).alias("reasoning"), F.lit(size).cast("long").alias("candidates_considered"))
    open_ = settle(incoming.join(exact, "id", "left_anti"))
    sims = similarities(block_pairs(open_, golden), open_, golden)
    best = sims.groupBy("id").agg(F.max_by("golden_id", F.struct("sim", -F.col("position"))).alias("golden_id"), F.max("sim").alias("sim"), F.count(F.lit(1)).alias("considered"))
    best = settle(best)
    far = best.where(F.col("sim") < least)
    low = far.select("id", F.lit(None).cast("string").alias("golden_id"), F.lit("NO_MATCH").alias("decision"), F.col("sim").alias("score"), F.lit("embedding").alias("stage"), F.format_string(f"Top embedding similarity %.3f below threshold {least:.2f}.", "sim").alias("reasoning"), F.col("considered").alias("candidates_considered"))
    near = best.where(F.col("sim") >= least)
    pairs = near.join(open_.select("id", *FIELDS), "id").join(golden.select("golden_id", *(F.col(k).alias(f"g_{k}") for k in FIELDS)), "golden_id")
    verdicts = adjudicator(pairs)
    if fallback and adjudicator is not adjudicate_local:
        local = adjudicate_local(pairs).withColumnRenamed("raw", "_raw").withColumnRenamed("reasoning", "_why")
        verdicts = local.join(verdicts, ["id", "golden_id"], "left").select("id", "golden_id", F.coalesce("raw", "_raw").alias("raw"), F.when(F.col("raw").isNotNull(), F.col("reasoning")).otherwise(F.col("_why")).alias("reasoning"))
    score = F.bround("raw", 3)
    judged = verdicts.join(near.select("id", "considered"), "id").select("id", F.when(F.col("raw") >= REVIEW, F.col("golden_id")).alias("golden_id"), classify(score).alias("decision"), score.alias("score"), F.lit("embedding+adjudication").alias("stage"), "reasoning", F.col("considered").alias("candidates_considered"))
    done = sure.unionByName(low).unionByName(judged)
    out = incoming.select("id").join(done, "id", "left")
    alone = "No candidates share a blocking key (DOB year + last-name soundex + zip3)."
    return out.select("id", "golden_id", F.coalesce("decision", F.lit("NO_MATCH")).alias("decision"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("stage", F.lit("no_candidate")).alias("stage"), F.coalesce("reasoning", F.lit(alone)).alias("reasoning"), F.coalesce("candidates_considered", F.lit(0)).cast("long").alias("candidates_considered"))
