import base64
import hashlib
import hmac
import uuid

from pyspark.sql import functions as F

from rosterlake.functions import normalize as N
from rosterlake.functions import tokens as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, N.normalize_name(F.lit("  José  Müller Jr"))) == "jose muller"
    assert one(spark, N.normalize_name(F.lit("Bob O'Brien III"))) == "robert o'brien"
    assert one(spark, N.normalize_name(F.lit(None).cast("string"))) == ""


def test_dates_and_zips(spark):
    for raw in ("1962-04-12", "4/12/1962", "04-12-1962", "1962/4/12", "19620412"):
        assert one(spark, N.normalize_dob(F.lit(raw))) == "1962-04-12"
    assert one(spark, N.normalize_dob(F.lit("never"))) == ""
    assert one(spark, N.normalize_zip(F.lit("501"))) == "00501"
    assert one(spark, N.normalize_zip(F.lit("94110-1234"))) == "94110"
    assert one(spark, N.normalize_zip(F.lit("none"))) == ""
    assert one(spark, N.zip_api(F.lit("none"))) == "00000"


def test_soundex_resets_on_h(spark):
    assert one(spark, N.soundex_reset(F.lit("Ashcraft"))) == "A226"
    assert one(spark, N.soundex_reset(F.lit("Robert"))) == "R163"
    assert one(spark, N.soundex_reset(F.lit("123"))) == ""


def test_tokens_equal_the_standard_library(spark):
    for key in (b"k", b"x" * 80):
        want = base64.b32encode(hmac.new(key, b"p1|ssn|123-45-6789", hashlib.sha256).digest()[:16]).decode().rstrip("=").lower()
        assert one(spark, T.tokenize(key, F.lit("p1"), "ssn", F.lit("123-45-6789"))) == f"tok_{want}"
    assert one(spark, T.tokenize(b"k", F.lit("p1"), "ssn", F.lit(""))) is None


def test_short_golden_id(spark):
    want = "G-" + uuid.uuid5(uuid.NAMESPACE_OID, "acme|7").hex[:4].upper()
    assert one(spark, N.short_golden_id(F.lit("acme"), F.lit("7"))) == want


def test_blocking_keys(spark):
    keys = one(spark, N.blocking_keys(F.lit("Garcia-Lopez"), F.lit("1980-01-02"), F.lit("94110")))
    assert keys == ["1980|G624|941", "1980|G620|941", "1980|L120|941"] and len(set(keys)) == 3
    assert one(spark, N.blocking_keys(F.lit(""), F.lit(""), F.lit(""))) == ["????||???"]
