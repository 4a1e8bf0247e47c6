"""Licence scan by a positional rare-token index, in DataFrame functions only.

Templates are short word sequences. Document frequencies of the licence words over the whole corpus give
each word an inverse document frequency; each template is indexed by its rarest words. Occurrences of a
rare word propose template starts (position minus offset); the postings of the template's other words are
intersected there by relative position, and a label is given only where its mandatory key phrase stands
word for word.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_or_empty

#: Everything that is not part of a word (after lower-casing A-Z).
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key_phrase: str


#: Phrases whose every place counts; fixed values of the contract.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Longer templates that add labels of their own when they align well enough around their key phrase.
TEMPLATES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BREAK), lambda w: w != "")


def vocabulary(phrases) -> list[str]:
    return sorted({w for p in phrases for w in p.split()})


def licence_idf(docs: DataFrame, text_col: str, vocab: list[str]) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents; the result is as small as vocab."""
    found = docs.select(F.array_intersect(F.split(ascii_lower(text_or_empty(text_col)), BREAK), F.array(*map(F.lit, vocab))).alias("_ws"))
    rows = found.select(F.explode(F.concat(F.col("_ws"), F.array(F.lit("")))).alias("_w")).groupBy("_w").count().collect()
    df = {r["_w"]: r["count"] for r in rows}  # "" counts the documents
    return {w: log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 1.0 for w in vocab}


def _starts(hits: Column, words: list[str], code: dict[str, int], idf: dict[str, float], rare: int) -> Column:
    """Places proposed by the template's rarest words: their positions less their offsets."""
    order = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:rare]

    def propose(word: str, offset: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["c"] == code[word]), lambda h: h["p"] - offset)

    proposed = [propose(words[i], i) for i in order]
    return F.array_distinct(F.filter(F.concat(*proposed), lambda s: s >= 0))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES, rare: int = 2, min_score: float = 0.8) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place where a base phrase's words stand consecutively; first_word and last_word are
    the smallest and largest word index of these places, null without any. labels adds those of templates
    whose key phrase is present and whose IDF-weighted alignment reaches min_score; score is the best
    alignment of any phrase or template (0 without licence words, 1 for a full match). Null text counts as
    empty: no words, empty labels, score 0. Ids may be of any type, be null or repeat: every row is scanned alone,
    equal rows give equal rows. Texts of any length are scanned as a whole, in time linear in their words. An empty
    table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    phrases = [p for p, _ in base]
    vocab = vocabulary([*phrases, *(t.words for t in templates), *(t.key_phrase for t in templates)])
    code = {w: i + 1 for i, w in enumerate(vocab)}
    idf = licence_idf(docs, text_col, vocab)
    rows = docs.select(F.col(id_col).alias("_id"), words_of(text_or_empty(text_col)).alias("_w"))
    # postings: the code of the licence word at each position (0: another word), so that a position is looked up at once
    codes = F.transform("_w", lambda w: F.when(w.isin(vocab), F.array_position(F.array(*map(F.lit, vocab)), w).cast("int")).otherwise(F.lit(0)))
    rows = rows.select("_id", F.size("_w").cast("long").alias("n_words"), codes.alias("_at"))
    hits = F.filter(F.transform("_at", lambda c, i: F.struct(i.alias("p"), c.alias("c"))), lambda h: h["c"] > 0)
    rows = rows.select("_id", "n_words", "_at", hits.alias("_h"))
    empty = F.size("_h") == 0

    def matched(words: list[str]) -> Column:
        """Per proposed start: the start, the aligned IDF weight and the number of aligned words."""
        def of(s: Column) -> Column:
            same = [F.coalesce(F.get("_at", s + i) == code[w], F.lit(False)) for i, w in enumerate(words)]
            weight = sum((F.when(m, idf[w]).otherwise(0.0) for m, w in zip(same, words, strict=True)), F.lit(0.0))
            return F.struct(s.alias("s"), (weight / sum(idf[w] for w in words)).alias("x"), sum((m.cast("int") for m in same), F.lit(0)).alias("n"))

        return F.transform(_starts(F.col("_h"), words, code, idf, rare), of)

    none = F.array().cast("array<struct<s:int,x:double,n:int>>")
    for i, (p, _) in enumerate(base):
        rows = rows.withColumn(f"_b{i}", F.when(empty, none).otherwise(matched(p.split())))
    for i, t in enumerate(templates):
        rows = rows.withColumn(f"_t{i}", F.when(empty, none).otherwise(matched(t.words.split())))
        rows = rows.withColumn(f"_k{i}", F.when(empty, none).otherwise(matched(t.key_phrase.split())))

    def full_places(name: str, phrase: str) -> Column:
        n = len(phrase.split())
        return F.transform(F.filter(name, lambda x: x["n"] == n), lambda x: x["s"])

    full = [full_places(f"_b{i}", p) for i, (p, _) in enumerate(base)]
    places = F.concat(*full)
    base_names = [F.when(F.size(f) > 0, F.lit(label)) for f, (_, label) in zip(full, base, strict=True)]
    best = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: x["x"])), F.lit(0.0))
    keyed = [F.size(full_places(f"_k{i}", t.key_phrase)) > 0 for i, t in enumerate(templates)]
    more = [F.when(k & (best(f"_t{i}") >= min_score), F.lit(t.label)) for i, (t, k) in enumerate(zip(templates, keyed, strict=True))]
    names = lambda cs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cs)))), ",")
    scores = [best(f"_{a}{i}") for a, xs in (("b", base), ("t", templates)) for i in range(len(xs))]
    return rows.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        names(base_names).alias("base_labels"),
        names([*base_names, *more]).alias("labels"),
        F.least(F.lit(1.0), F.greatest(*scores)).alias("score"),
    )


def sql(base=BASE, templates=TEMPLATES, rare: int = 2, min_score: float = 0.8) -> str:
    """The same in DuckDB SQL over documents, for whole tables: postings as rows, starts as joins."""
    parts = [("b", i, p) for i, (p, _) in enumerate(base)]
    parts += [(k, i, x) for i, t in enumerate(templates) for k, x in (("t", t.words), ("k", t.key_phrase))]
    values = ", ".join(f"('{k}{i}', {o}, '{w}')" for k, i, p in parts for o, w in enumerate(p.split()))
    names = ", ".join([*(f"('b{i}', '{label}')" for i, (_, label) in enumerate(base)), *(f"('t{i}', '{t.label}')" for i, t in enumerate(templates))])
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH phrase(part, o, w) AS (VALUES {values}), named(part, label) AS (VALUES {names}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{BREAK}'), lambda w: w <> '') AS ws FROM documents),
post AS (SELECT * FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d) x WHERE w IN (SELECT w FROM phrase)),
idf AS (SELECT v.w, ln(((SELECT count(*) FROM d) + 1) / CAST(count(DISTINCT post.rid) + 1 AS DOUBLE)) + 1.0 AS idf FROM (SELECT DISTINCT w FROM phrase) v LEFT JOIN post ON post.w = v.w GROUP BY v.w),
rare AS (SELECT part, o, w FROM (SELECT part, o, w, row_number() OVER (PARTITION BY part ORDER BY idf DESC, o) AS rn FROM phrase JOIN idf USING (w)) x WHERE rn <= {rare}),
start AS (SELECT DISTINCT post.rid, rare.part, post.p - rare.o AS s FROM post JOIN rare ON rare.w = post.w WHERE post.p >= rare.o),
aligned AS (
  SELECT a.rid, a.part, a.s, sum(idf) AS x, count(*) AS n FROM start a JOIN phrase f ON f.part = a.part
  JOIN post ON post.rid = a.rid AND post.p = a.s + f.o AND post.w = f.w JOIN idf ON idf.w = f.w GROUP BY a.rid, a.part, a.s
), whole AS (SELECT part, sum(idf) AS x, count(*) AS n FROM phrase JOIN idf USING (w) GROUP BY part),
scored AS (SELECT aligned.rid, aligned.part, s, aligned.x / whole.x AS score, aligned.n = whole.n AS full_match FROM aligned JOIN whole USING (part)),
base AS (SELECT rid, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM scored JOIN named USING (part) WHERE full_match AND part LIKE 'b%' GROUP BY rid),
found AS (
  SELECT rid, label FROM scored JOIN named USING (part) WHERE full_match AND part LIKE 'b%'
  UNION SELECT t.rid, label FROM scored t JOIN named USING (part) JOIN scored k ON k.rid = t.rid AND k.part = 'k' || substr(t.part, 2) AND k.full_match WHERE t.part LIKE 't%' AND t.score >= {min_score}
), every AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM found GROUP BY rid),
best AS (SELECT rid, max(score) AS score FROM scored WHERE part NOT LIKE 'k%' GROUP BY rid)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(base.n_base, 0) AS n_base, base.first_word, base.last_word, coalesce(base.base_labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, round(least(coalesce(best.score, 0.0), 1.0), 6) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid) LEFT JOIN best USING (rid)
"""
