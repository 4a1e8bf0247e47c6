"""Readers of partner files, all columns as strings: CSV, TSV, JSON, JSON lines, fixed width and X12 834."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File formats by suffix.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".edi": "x12_834", ".834": "x12_834", ".txt": "fixed_width"}
SAMPLE_ROWS = 50


class UnsupportedFormat(ValueError):
    """A file whose suffix no reader knows."""


def format_of(path: str) -> str:
    return FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "other")


def scan_csv(spark: SparkSession, path: str, sep: str = ",", max_rows: int | None = None) -> DataFrame:
    """A CSV file with a header, every column a string; empty fields are empty strings. max_rows keeps the first rows."""
    got = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path)
    got = got.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in got.columns))
    return got if max_rows is None else got.limit(max_rows)


def scan_json(spark: SparkSession, path: str, members: str = "members", max_rows: int | None = None) -> DataFrame:
    """A JSON file: an array of objects, or one object whose `members` array is taken; values as strings."""
    got = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if members in got.columns:
        got = got.select(F.explode(members).alias("_m")).select("_m.*")
    return got if max_rows is None else got.limit(max_rows)


def scan_jsonl(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """One JSON object per line; the first max_rows lines are taken, then blank ones dropped."""
    got = spark.read.option("primitivesAsString", True).json(path)
    if max_rows is None:
        return got
    lines = spark.read.text(path).limit(max_rows).where(F.trim("value") != "")
    return lines.select(F.from_json("value", got.schema).alias("_r")).select("_r.*")


def scan_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int]]) -> DataFrame:
    """fields: (name, first character from 1, length) from the contract; values are trimmed, blank ones null."""
    cut = [F.nullif(F.trim(F.substring("value", start, n)), F.lit("")).alias(name) for name, start, n in fields]
    return spark.read.text(path).select(*cut)


def _element(segment: Column, i: int) -> Column:
    return F.nullif(F.trim(F.get(segment, F.lit(i))), F.lit(""))


def scan_834(spark: SparkSession, path: str) -> DataFrame:
    """One row per member loop of X12 834 files: the fields of the roster, source_file and member_no (from 1 in each file).

    Segments end with ~, a member's begin with INS. Each is a row of its own, so large files are split and none is held
    whole. The loop of a segment is the number of INS before it: those of earlier blocks of its file and a running count
    inside its block. The work grows with the size of the files.
    """
    rows = spark.read.option("lineSep", "~").text(path).select(F.btrim("value", F.lit(" \r\n\t")).alias("_s"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.where((F.col("_s") != "") & ~F.startswith("_s", F.lit("*")))
    opens = (F.col("_s") == "INS") | F.startswith("_s", F.lit("INS*"))
    counts = rows.groupBy("source_file", "_block").agg(F.count_if(opens).alias("_n"))
    before = counts.select("source_file", "_block", (F.sum("_n").over(Window.partitionBy("source_file").orderBy("_block")) - F.col("_n")).alias("_before"))
    here = F.sum(opens.cast("int")).over(Window.partitionBy("source_file", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_here", here).join(before, ["source_file", "_block"]).withColumn("_no", (F.col("_before") + F.col("_here")).cast("int")).where("_no > 0")
    rows = rows.groupBy("source_file", "_no").agg(F.sort_array(F.collect_list(F.struct("_block", "_at", "_s"))).alias("_loop"))
    rows = rows.select("source_file", "_no", F.transform("_loop", lambda x: F.split(x["_s"], r"\*")).alias("_loop"))

    def first(tag: str, i: int, *where: tuple[int, str]) -> Column:
        """Element i of the loop's first segment of this tag (and these elements)."""

        def fits(e: Column) -> Column:
            ok = F.get(e, F.lit(0)) == tag
            for at, value in where:
                ok = ok & (F.get(e, F.lit(at)) == value)
            return ok

        return _element(F.get(F.filter("_loop", fits), F.lit(0)), i)

    date = lambda c: F.date_format(F.try_to_date(c, "yyyyMMdd"), "yyyy-MM-dd")
    start = F.coalesce(first("DTP", 3, (1, "348")), first("DTP", 3, (1, "356")))
    return rows.select(
        "source_file", F.col("_no").alias("member_no"), first("INS", 3).alias("maintenance_type"),
        first("REF", 2, (1, "0F")).alias("partner_member_id"), first("REF", 2, (1, "1L")).alias("plan_code"),
        first("NM1", 4, (1, "IL")).alias("first_name"), first("NM1", 5, (1, "IL")).alias("middle_name"), first("NM1", 3, (1, "IL")).alias("last_name"),
        F.when(first("NM1", 8, (1, "IL")) == "34", first("NM1", 9, (1, "IL"))).alias("ssn"), first("PER", 4, (3, "HP")).alias("phone"),
        first("N3", 1).alias("address_line_1"), first("N4", 1).alias("city"), first("N4", 2).alias("state"), first("N4", 3).alias("zip"),
        date(first("DMG", 2)).alias("dob"), first("DMG", 3).alias("gender"), date(start).alias("start_date"), date(first("DTP", 3, (1, "349"))).alias("end_date"),
    )


def count_segments_834(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, segments, declared): segments from ST to SE and the number that SE declares; a difference is a warning, not an error."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.transform(F.split("value", "~"), lambda s: F.split(F.btrim(s, F.lit(" \r\n\t")), r"\*")).alias("_s"))
    tags = F.filter(F.transform("_s", lambda e: F.get(e, F.lit(0))), lambda t: t != "")
    declared = F.get(F.get(F.filter("_s", lambda e: F.get(e, F.lit(0)) == "SE"), F.lit(0)), F.lit(1)).cast("int")
    return rows.select("source_file", (F.array_position(tags, "SE") - F.array_position(tags, "ST") + 1).cast("int").alias("segments"), declared.alias("declared"))


def load_sample(spark: SparkSession, path: str, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of a CSV, TSV, JSON or JSON lines file; any other suffix is an error."""
    kind = format_of(path)
    if kind in ("csv", "tsv"):
        return scan_csv(spark, path, "\t" if kind == "tsv" else ",", max_rows)
    if kind == "json":
        return scan_json(spark, path, max_rows=max_rows)
    if kind == "jsonl":
        return scan_jsonl(spark, path, max_rows)
    raise UnsupportedFormat(f"no reader for {os.path.basename(path)!r}")


def seed_load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records, read with their types."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def sample_bands(df: DataFrame, order: str, each: int = 50, seed: int = 0) -> DataFrame:
    """df's first, last and `each` random rows, with the band they come from; each band is a bounded top-k, no row comes twice."""
    head = df.orderBy(order).limit(each).withColumn("band", F.lit("first"))
    tail = df.orderBy(F.desc(order)).limit(each).withColumn("band", F.lit("last")).join(head.select(order), order, "left_anti")
    ends = head.unionByName(tail.select(*head.columns))
    rest = df.join(F.broadcast(ends.select(order)), order, "left_anti")  # at most 2 * each rows
    middle = rest.orderBy(F.md5(F.concat_ws("|", F.lit(seed), order)), order).limit(each).withColumn("band", F.lit("random"))
    return ends.unionByName(middle)
