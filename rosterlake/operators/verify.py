"""Identity verification: a batch of requests against the golden records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4


def validate_requests(requests: DataFrame) -> DataFrame:
    """requests with zip settled to five digits, and problems: the fields that the API would refuse, in order."""
    size = lambda c: F.length(c)
    rules = {
        "first_name": F.col("first_name").isNull() | ~size("first_name").between(1, 100),
        "last_name": F.col("last_name").isNull() | ~size("last_name").between(1, 100),
        "dob": F.col("dob").isNull(),
        "zip": F.col("zip").isNull() | ~size("zip").between(3, 10),
        "ssn_last4": F.col("ssn_last4").isNotNull() & ~F.col("ssn_last4").rlike("^[0-9]{4}$"),
    }
    problems = F.array_compact(F.array(*(F.when(r, F.lit(k)) for k, r in rules.items())))
    zip5 = F.lpad(F.substring(F.regexp_replace("zip", "[^0-9]", ""), 1, 5), 5, "0")
    return requests.withColumn("problems", problems).withColumn("zip", zip5)


def is_ineligible(end: Column, as_of: Column) -> Column:
    """Coverage has ended before as_of; an absent or unreadable end is no end."""
    return F.coalesce(F.try_to_date(end.cast("string"), "yyyy-MM-dd") < as_of, F.lit(False))


def _key(name: Column) -> Column:
    return F.lower(F.trim(name))


def lookup(requests: DataFrame, golden: DataFrame) -> DataFrame:
    """(request_id, golden_record_id, ...): equal dob, ZIP and last name; last four SSN digits must agree where both sides have them."""
    r = requests.select("request_id", "dob", "zip", _key(F.col("last_name")).alias("_ln"), F.col("ssn_last4").alias("_s"))
    g = golden.select("golden_record_id", F.col("primary_partner_id").alias("partner_id"), "effective_end_date", "dob", "zip", _key(F.col("last_name")).alias("_ln"), F.col("ssn_last4").alias("_g"))
    agrees = (F.coalesce("_s", F.lit("")) == "") | (F.coalesce("_g", F.lit("")) == "") | (F.col("_s") == F.col("_g"))
    return r.join(g, ["dob", "zip", "_ln"]).where(agrees).select("request_id", "golden_record_id", "partner_id", "effective_end_date")


def fuzzy(requests: DataFrame, golden: DataFrame) -> DataFrame:
    """(request_id, golden_record_id, partner_id): equal year of birth and ZIP3, last name beginning with the request's first four letters.

    Golden names are spelt out by their first one to four letters, so that the prefix is a third equi-key.
    """
    ln = _key(F.col("last_name"))
    r = requests.select("request_id", F.year("dob").alias("_y"), F.left("zip", F.lit(3)).alias("_z"), F.left(ln, F.lit(PREFIX)).alias("_p")).where("_p <> ''")
    each = F.transform(F.sequence(F.lit(1), F.least(F.length(ln), F.lit(PREFIX))), lambda n: F.left(ln, n))
    g = golden.where(ln != "").select("golden_record_id", F.col("primary_partner_id").alias("partner_id"), F.year("dob").alias("_y"), F.left("zip", F.lit(3)).alias("_z"), F.explode(each).alias("_p"))
    return r.join(g, ["_y", "_z", "_p"]).select("request_id", "golden_record_id", "partner_id")


def fuzzy_top(requests: DataFrame, golden: DataFrame, limit: int = 10) -> DataFrame:
    """The first `limit` fuzzy matches of each request, in the order of golden ids."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("golden_record_id"))
    return fuzzy(requests, golden).withColumn("rank", rank).where(F.col("rank") <= limit)


def verify(requests: DataFrame, golden: DataFrame, as_of: str) -> DataFrame:
    """(request_id, status, score, golden_record_id, partner_id, decision_basis) for every valid request.

    One exact match: VERIFIED, or INELIGIBLE if its own coverage has ended; several: AMBIGUOUS; none: the fuzzy
    search, where one match is NEEDS_REVIEW and none or several are NOT_FOUND. The fuzzy join only sees requests
    without an exact match.
    """
    exact = lookup(requests, golden).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.first("golden_record_id").alias("g"), F.first("partner_id").alias("pa"), F.bool_or(is_ineligible(F.col("effective_end_date"), F.to_date(F.lit(as_of)))).alias("ended"))
    rest = requests.join(exact, "request_id", "left_anti")
    near = fuzzy(rest, golden).groupBy("request_id").agg(F.count(F.lit(1)).alias("f"), F.first("golden_record_id").alias("fg"), F.first("partner_id").alias("fp"))
    got = requests.select("request_id").join(exact, "request_id", "left").join(near, "request_id", "left")
    one, many, review = F.col("n") == 1, F.col("n") > 1, F.col("f") == 1
    status = F.when(one & F.col("ended"), "INELIGIBLE").when(one, "VERIFIED").when(many, "AMBIGUOUS").when(review, "NEEDS_REVIEW").otherwise("NOT_FOUND")
    basis = F.when(one & F.col("ended"), "Member found, coverage has ended.").when(one, "One exact match.").when(many, F.format_string("%d records match.", "n")).when(review, "One similar record.").otherwise("No record matches.")
    return got.select(
        "request_id", status.alias("status"), F.when(one, 1.0).when(many, 0.5).when(review, 0.7).otherwise(0.0).alias("score"),
        F.when(one, F.col("g")).when(review, F.col("fg")).alias("golden_record_id"), F.when(one, F.col("pa")).when(review, F.col("fp")).alias("partner_id"), basis.alias("decision_basis"),
    )


def metrics(responses: DataFrame) -> DataFrame:
    """One row of counters: requests, and by status; NEEDS_REVIEW counts as ambiguous."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return responses.agg(F.count(F.lit(1)).alias("requests_total"), n("VERIFIED").alias("verified"), n("NOT_FOUND").alias("not_found"), n("AMBIGUOUS", "NEEDS_REVIEW").alias("ambiguous"), n("INELIGIBLE").alias("ineligible"))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a text with two blanks before it and one after."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_matches(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(query, name, similarity): names that share trigrams with a query, by the Jaccard similarity of the two sets.

    queries: query; names: name, both distinct. Common trigrams make the join's hot keys, which adaptive execution splits.
    """
    q = queries.select("query", F.size(trigrams(F.col("query"))).alias("_q"), F.explode(trigrams(F.col("query"))).alias("_t"))
    n = names.select("name", F.size(trigrams(F.col("name"))).alias("_n"), F.explode(trigrams(F.col("name"))).alias("_t"))
    both = q.join(n, "_t").groupBy("query", "name", "_q", "_n").agg(F.count(F.lit(1)).alias("_b"))
    return both.select("query", "name", (F.col("_b").cast("double") / (F.col("_q") + F.col("_n") - F.col("_b"))).alias("similarity")).where(F.col("similarity") >= least)
