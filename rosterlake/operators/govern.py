"""Row access and masking as transforms: the role and the user are parameters of the read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Roles that see masked values, and roles that see every partner's rows.
UNMASKED_ROLES = ("IDV_SERVICE_ROLE", "COMPLIANCE_ROLE", "PII_ELEVATED")
ALL_ROWS_ROLES = ("IDV_SERVICE_ROLE", "COMPLIANCE_ROLE")
MASKED_TOKENS = ("ssn_token", "email_token", "phone_token")


def mask_dob(df: DataFrame, role: str, column: str = "dob") -> DataFrame:
    """The first of January of the year, but for privileged roles."""
    return df if role in UNMASKED_ROLES else df.withColumn(column, F.make_date(F.year(column), F.lit(1), F.lit(1)))


def mask_tokens(df: DataFrame, role: str) -> DataFrame:
    """SSN, e-mail and phone tokens are null but for privileged roles; address tokens stay."""
    if role in UNMASKED_ROLES:
        return df
    return df.withColumns({c: F.lit(None).cast("string") for c in MASKED_TOKENS if c in df.columns})


def row_access(df: DataFrame, grants: DataFrame, user: str, role: str, now: str, partner_col: str = "primary_partner_id") -> DataFrame:
    """Rows of partners that the user holds an unexpired grant for; all rows for privileged roles."""
    if role in ALL_ROWS_ROLES:
        return df
    held = grants.where((F.col("engineer") == user) & (F.col("granted_until") > F.lit(now).cast("timestamp"))).select(F.col("partner_id").alias(partner_col)).distinct()
    return df.join(held, partner_col, "left_semi")


def read_as(df: DataFrame, grants: DataFrame, user: str, role: str, now: str) -> DataFrame:
    return mask_tokens(mask_dob(row_access(df, grants, user, role, now), role), role)


def k_anonymous(df: DataFrame, quasi: dict, k: int) -> DataFrame:
    """Groups by generalised columns, with their size and whether they may be released."""
    return df.groupBy(*(expr.alias(n) for n, expr in quasi.items())).agg(F.count(F.lit(1)).alias("n")).withColumn("releasable", F.col("n") >= k)


def retention(df: DataFrame, key: str, end_col: str, cutoff: str) -> DataFrame:
    """df without the keys that ended before the cut-off in any of their rows."""
    gone = df.where(F.col(end_col) < F.to_date(F.lit(cutoff))).select(key).distinct()
    return df.join(gone, key, "left_anti")
