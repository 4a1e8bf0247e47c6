"""Token vault as tables: tokens, values kept apart, policy, detokenizing requests and the audit trail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import tokens as T


@dataclass(frozen=True)
class Rule:
    """actor and purpose match exactly, or by their beginning if they end with *."""

    actor: str
    purpose: str
    fields: tuple[str, ...] = ()
    requires_approval: bool = False


POLICY = (
    Rule("service:idv-api", "idv_match", ("ssn", "email", "phone")),
    Rule("service:cdc-handler", "tokenize_only"),
    Rule("service:cleansing", "tokenize_only"),
    Rule("human:*", "support_case_*", ("email", "phone", "address_line_1"), True),
    Rule("human:compliance*", "audit_*", ("*",)),
)


def tokenize(requests: DataFrame, secret: bytes) -> DataFrame:
    """requests (partner_id, field, value) with token; equal requests get equal tokens, other partners other ones."""
    return requests.withColumn("token", F.concat(F.lit("tok_"), T.base32(F.substring(T.hmac_sha256_hex(secret, F.concat_ws("|", "partner_id", "field", "value")), 1, 32), 26)))


def vault_table(tokens: DataFrame) -> DataFrame:
    """What the vault keeps: one row per token."""
    return tokens.groupBy("token").agg(F.first("partner_id").alias("partner_id"), F.first("field").alias("field"), F.first("value").alias("value"))


def _matches(pattern: str, value: Column) -> Column:
    return value.startswith(pattern[:-1]) if pattern.endswith("*") else value == pattern


def policy_rule(actor: Column, purpose: Column, policy=POLICY) -> Column:
    """The number of the first rule whose actor and purpose match; null if none does."""
    return F.coalesce(*(F.when(_matches(r.actor, actor) & _matches(r.purpose, purpose), F.lit(i)) for i, r in enumerate(policy)))


def detokenize(requests: DataFrame, vault: DataFrame, policy=POLICY, strict: bool = False, approved: str | None = None) -> DataFrame:
    """requests (token, actor, purpose, ...) with value, result (success, denied, error) and reason.

    Rules decide by actor and purpose alone, as the vault's API does. strict also honours the fields of the rule and,
    where it asks for approval, the boolean column named by `approved`. A denied request learns nothing of the token.
    """
    asked = requests.withColumn("_rule", policy_rule(F.col("actor"), F.col("purpose"), policy))
    found = asked.join(vault.select("token", F.col("value").alias("_value"), F.col("field").alias("_field"), F.col("partner_id").alias("_partner")), "token", "left")
    allowed = F.col("_rule").isNotNull()
    if strict:
        fields = F.coalesce(*(F.when(F.col("_rule") == i, F.lit("*" in r.fields) | F.col("_field").isin(*r.fields) if r.fields else F.lit(False)) for i, r in enumerate(policy)))
        approval = F.coalesce(*(F.when(F.col("_rule") == i, (F.coalesce(F.col(approved), F.lit(False)) if approved else F.lit(False)) if r.requires_approval else F.lit(True)) for i, r in enumerate(policy)))
        allowed = allowed & (F.col("_field").isNull() | fields) & approval
    allowed = F.coalesce(allowed, F.lit(False))
    known = F.col("_field").isNotNull()
    result = F.when(~allowed, "denied").when(~known, "error").otherwise("success")
    shown = lambda c: F.when(allowed, F.col(c))
    return found.select(
        *requests.columns, shown("_value").alias("value"), result.alias("result"),
        F.when(~allowed, "policy").when(~known, "token not found").otherwise("").alias("reason"), shown("_field").alias("field"), shown("_partner").alias("partner_id"),
    )


def audit_of_tokenize(tokens: DataFrame, actor: str, at: Column) -> DataFrame:
    """One event per tokenized value."""
    return tokens.select(at.alias("ts"), F.lit(actor).alias("actor"), F.lit("tokenize").alias("action"), "field", "token", F.lit("tokenize_only").alias("purpose"), "partner_id", F.lit("success").alias("result"), F.lit("").alias("reason"))


def audit_of_detokenize(answers: DataFrame, at: Column) -> DataFrame:
    """One event per request, denials without field and partner."""
    action = F.when(F.col("result") == "denied", "denied").otherwise("detokenize")
    return answers.select(at.alias("ts"), "actor", action.alias("action"), "field", "token", "purpose", "partner_id", "result", "reason")


def audit_volume(audit: DataFrame, limit: int = 500) -> DataFrame:
    """Successful or failed detokenize calls by actor and day, with an alert above the limit."""
    calls = audit.where("action = 'detokenize'").groupBy("actor", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    return calls.withColumn("alert", F.col("calls") > limit)


def swallow(emit, events: DataFrame) -> bool:
    """Hand the audit events to a sink; its errors never break the caller."""
    try:
        emit(events)
        return True
    except Exception:  # noqa: BLE001
        return False
