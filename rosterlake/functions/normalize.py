"""Column builders that turn raw roster fields into comparable ones; all stay inside code generation."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nicknames and the formal name that each stands for.
NICKNAMES = {
    "bob": "robert", "rob": "robert", "robbie": "robert", "bobby": "robert",
    "bill": "william", "billy": "william", "will": "william", "willy": "william",
    "liz": "elizabeth", "beth": "elizabeth", "betsy": "elizabeth", "lizzie": "elizabeth",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "cathy": "katherine",
    "mike": "michael", "mick": "michael", "mikey": "michael", "dave": "david", "davey": "david",
    "jim": "james", "jimmy": "james", "jamie": "james", "tom": "thomas", "tommy": "thomas",
    "rick": "richard", "ricky": "richard", "dick": "richard", "rich": "richard",
    "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "nick": "nicholas", "nicky": "nicholas",
    "tony": "anthony", "joe": "joseph", "joey": "joseph",
}
# Name suffixes that are dropped, and date formats in the order they are tried.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
DOB_FORMATS = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "d/M/yyyy", "yyyyMMdd")
ROSTER_FORMATS = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "yyyyMMdd", "d/M/yyyy")


@cache
def _fold() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition holds one ASCII character, these characters, and those that hold several."""
    pairs = [(c, unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.decomposition(c)]
    single = [(c, a) for c, a in pairs if len(a) == 1]
    return "".join(c for c, _ in single), "".join(a for _, a in single), {c: a for c, a in pairs if len(a) > 1}


def fold_ascii(c: Column) -> Column:
    """Every character to the ASCII part of its compatibility decomposition; anything else outside ASCII goes."""
    one, to, several = _fold()
    table = F.str_to_map(F.lit("\x1f".join(f"{k}\x1e{v}" for k, v in several.items())), F.lit("\x1f"), F.lit("\x1e"))
    spelt = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(table[x], x)), "")
    rare = F.when(c.rlike("[" + "".join(several) + "]"), spelt).otherwise(c)
    folded = F.regexp_replace(F.translate(rare, one, to), r"[^\x00-\x7F]", "")
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(folded)


def normalize_name(c: Column) -> Column:
    """Folded, lower case, without suffixes, nicknames made formal; '' for null or blank."""
    flat = F.regexp_replace(F.lower(fold_ascii(F.coalesce(c, F.lit("")))), r"[^a-z\-' ]", " ")
    words = F.filter(F.split(flat, " +"), lambda w: (w != "") & ~w.isin(*SUFFIXES))
    formal = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(formal[w], w)), " ")


def parse_date(c: Column, formats: tuple[str, ...] = DOB_FORMATS) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*(F.try_to_date(F.trim(c), f) for f in formats))


def normalize_dob(c: Column) -> Column:
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), F.lit(""))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def normalize_zip(c: Column) -> Column:
    """Five digits, padded on the left; '' without digits."""
    d = digits(c)
    return F.when(d == "", "").otherwise(F.lpad(F.substring(d, 1, 5), 5, "0"))


def zip_api(c: Column) -> Column:
    """As normalize_zip, but '00000' without digits."""
    return F.lpad(F.substring(digits(c), 1, 5), 5, "0")


def zip_sql(c: Column) -> Column:
    return F.lpad(F.regexp_replace(c, "[^0-9]", ""), 5, "0")


def ssn_last4(c: Column) -> Column:
    return F.when(digits(c) == "", None).otherwise(F.right(digits(c), F.lit(4)))


def soundex_reset(c: Column) -> Column:
    """Soundex in which H, W and vowels all end a run of one code; '' without letters."""
    letters = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")
    codes = F.translate(letters, "AEIOUYHWBFPVCGJKQSXZDTLMNR", "00000000111122222222334556")
    rest = F.regexp_replace(F.substring(F.regexp_replace(codes, r"(.)\1+", "$1"), 2, 1000), "0", "")
    return F.when(letters == "", "").otherwise(F.rpad(F.substring(F.concat(F.substring(letters, 1, 1), rest), 1, 4), 4, "0"))


def blocking_keys(last: Column, dob: Column, zip_code: Column) -> Column:
    """year|soundex|zip3 for the whole surname and its parts at hyphens and spaces, distinct and in order."""
    return blocking_keys_of(normalize_name(last), normalize_dob(dob), normalize_zip(zip_code))


def blocking_keys_of(name: Column, dob: Column, zip_code: Column) -> Column:
    """The same of normalised fields; columns made in an earlier select keep the plan small."""
    year, zip3 = F.substring(dob, 1, 4), F.substring(zip_code, 1, 3)
    year, zip3 = F.when(year == "", "????").otherwise(year), F.when(zip3 == "", "???").otherwise(zip3)
    parts = F.filter(F.concat(F.array(name), F.split(name, "-"), F.split(name, " ")), lambda p: p != "")
    parts = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    codes = F.array_distinct(F.transform(parts, soundex_reset))
    return F.transform(codes, lambda s: F.concat_ws("|", year, s, zip3))


def feature_string(first: Column, middle: Column, last: Column, dob: Column, address: Column, city: Column, state: Column, zip_code: Column, ssn4: Column) -> Column:
    n = normalize_name
    return feature_string_of(n(first), n(middle), n(last), normalize_dob(dob), address, city, state, normalize_zip(zip_code), ssn4)


def feature_string_of(first: Column, middle: Column, last: Column, dob: Column, address: Column, city: Column, state: Column, zip_code: Column, ssn4: Column) -> Column:
    """The same of normalised names, birth date and ZIP."""
    e = lambda c: F.coalesce(c, F.lit(""))
    place = F.concat(F.lower(F.trim(e(address))), F.lit(", "), F.lower(F.trim(e(city))), F.lit(", "), F.upper(F.trim(e(state))), F.lit(" "), zip_code)
    return F.concat(F.lit("NAME: "), F.concat_ws(" ", first, middle, last), F.lit(" | DOB: "), dob, F.lit(" | ADDR: "), place, F.lit(" | SSN4: "), e(ssn4))


def clean_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def gender(c: Column) -> Column:
    g = F.upper(F.trim(c))
    return F.when(g.isin("M", "MALE"), "M").when(g.isin("F", "FEMALE"), "F").when(g.isin("X", "NB", "NONBINARY"), "X").otherwise("U")


def state_letters(c: Column) -> Column:
    return F.upper(F.substring(F.regexp_replace(c, "[^A-Za-z]", ""), 1, 2))


def state_cdc(c: Column) -> Column:
    return F.substring(F.upper(F.trim(c)), 1, 2)


def short_golden_id(partner: Column, member: Column) -> Column:
    """First four hex digits of the name-based UUID (OID namespace) of partner|member."""
    space = F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8"))
    return F.concat(F.lit("G-"), F.upper(F.substring(F.sha1(F.concat(space, F.concat_ws("|", partner, member).cast("binary"))), 1, 4)))


def detect_format(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "edi": "x12_834", "834": "x12_834", "txt": "fixed_width"}
    out = F.lit("other")
    for k, v in known.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def partner_from_key(key: Column) -> Column:
    """inbox/<partner>/file, else partner_<slug>_..., else unknown."""
    parts = F.split(key, "/")
    name = F.element_at(parts, -1)
    return F.when((parts[0] == "inbox") & (F.size(parts) >= 3), parts[1]).when(name.startswith("partner_"), F.split(name, "_")[1]).otherwise("unknown")


def coerce_date(c: Column) -> Column:
    """The roster loader's own list of date formats, as an ISO date; null if none fits."""
    return F.date_format(parse_date(c, ROSTER_FORMATS), "yyyy-MM-dd")


def blocking_key(last: Column, dob: Column, zip_code: Column) -> Column:
    """The first blocking key."""
    return F.element_at(blocking_keys(last, dob, zip_code), 1)


def ssn_valid(c: Column) -> Column:
    """Nine digits with or without hyphens, an assigned area, group and serial not zero, no well-known dummy; null stays null."""
    d = F.regexp_replace(c, "-", "")
    area = F.substring(d, 1, 3)
    ok = c.rlike(r"^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$") & ~area.isin("000", "666") & ~area.startswith("9")
    return ok & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000") & ~d.isin(*DUMMY_SSNS)


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the row as JSON, nulls left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def surrogate_key(*parts: Column) -> Column:
    """MD5 over the parts joined by hyphens; null has a spelling of its own."""
    return F.md5(F.concat_ws("-", *(F.coalesce(p.cast("string"), F.lit(NULL_SPELLING)) for p in parts)))


def parse_verdict(c: Column) -> Column:
    """struct(match, confidence, reasoning) from an adjudicator's reply: the outermost braces, reasoning cut at 500; nulls if there is no JSON."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    got = F.from_json(body, "match boolean, confidence double, reasoning string")
    fine = F.get_json_object(body, "$").isNotNull()
    return F.when(fine, F.struct(F.coalesce(got["match"], F.lit(False)).alias("match"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"), F.substring(F.coalesce(got["reasoning"], F.lit("")), 1, 500).alias("reasoning")))


# Numbers known from advertisements and examples.
DUMMY_SSNS = ("078051120", "219099999", "123456789", "111111111", "222222222", "333333333", "444444444", "555555555", "777777777", "888888888")
NULL_SPELLING = "_null_"
