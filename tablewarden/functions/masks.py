"""The three masking rules as native Column expressions.

NULL stays NULL and ``''`` stays ``''``; everything else is transformed. The
expressions compile into the surrounding whole-stage-codegen projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden import vocab

# Replacement texts and the shortest numbers shown in part.
REDACTED = "***"
CARD_PREFIX = "****"
MIN_PHONE_DIGITS = 7
MIN_CARD_DIGITS = 12
VISIBLE_DIGITS = 4


def _last_digits(digits: Column) -> Column:
    return F.substring(digits, -VISIBLE_DIGITS, VISIBLE_DIGITS)


def _email_rule(value: Column) -> Column:
    at = F.instr(value, "@")
    domain = F.substring_index(value, "@", -1)
    # Exactly one '@': what follows the first is also what follows the last.
    well_formed = (
        (at > 1) & (at < F.length(value)) & (F.length(domain) == F.length(value) - at)
    )
    initial = F.substring(value, 1, 1)
    shown = F.when(F.octet_length(initial) == 1, initial).otherwise(F.lit(""))
    return F.when(well_formed, F.concat(shown, F.lit("***@"), domain)).otherwise(F.lit(REDACTED))


def _phone_rule(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(
        F.length(digits) >= MIN_PHONE_DIGITS, F.concat(F.lit(REDACTED), _last_digits(digits))
    ).otherwise(F.lit(REDACTED))


def _card_rule(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.when(
        digits.rlike(rf"\A[0-9]{{{MIN_CARD_DIGITS},}}\z"),
        F.concat(F.lit(CARD_PREFIX), _last_digits(digits)),
    ).otherwise(F.lit(REDACTED))


RULES = {
    vocab.EMAIL: _email_rule,
    vocab.PHONE: _phone_rule,
    vocab.CREDIT_CARD: _card_rule,
}


def _keep_empty(value: Column, masked: Column) -> Column:
    return F.when(value.isNull() | (value == ""), value).otherwise(masked)


def mask_email(value: Column) -> Column:
    return _keep_empty(value, _email_rule(value))


def mask_phone(value: Column) -> Column:
    return _keep_empty(value, _phone_rule(value))


def mask_credit_card(value: Column) -> Column:
    return _keep_empty(value, _card_rule(value))


def mask_as(category: str, value: Column) -> Column:
    """The rule is chosen while the plan is built; an unknown category redacts fully."""
    rule = RULES.get(category, lambda _: F.lit(REDACTED))
    return _keep_empty(value, rule(value))


def mask_by_category(category: Column, value: Column) -> Column:
    """The rule is chosen per row; a NULL category means "not PII" and keeps the value."""
    masked = F.when(category.isNull(), value)
    for name, rule in RULES.items():
        masked = masked.when(category == name, rule(value))
    return _keep_empty(value, masked.otherwise(F.lit(REDACTED)))
