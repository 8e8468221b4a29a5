"""Money in cents (BIGINT), read from and printed as Brazilian text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An amount anywhere in a text; the sign, if any, stands right before the figures.
AMOUNT = r"(?:R\$\s?)?(-?\d{1,3}(?:\.\d{3})+|-?\d+)(?:,(\d{2}))?"


def parse_money(s: Column) -> Column:
    """Cents of the first amount; null if there is none or if it does not fit."""
    whole = F.replace(F.regexp_extract(s, AMOUNT, 1), F.lit("."), F.lit(""))
    cents = F.regexp_extract(s, AMOUNT, 2)
    units = F.ltrim(whole, F.lit("-")).try_cast("bigint")
    total = F.try_add(F.try_multiply(units, F.lit(100)), F.when(cents == "", F.lit(0)).otherwise(cents.try_cast("bigint")))
    return F.when(whole != "", F.when(F.startswith(whole, F.lit("-")), -total).otherwise(total))


def has_amount(s: Column) -> Column:
    """Whether an amount stands in a text, also one whose cents do not fit a BIGINT; null for a null text."""
    return F.rlike(s, F.lit(AMOUNT))


def thousands(v: Column) -> Column:
    """A whole number with dots between thousands."""
    return F.translate(F.format_number(v, 0), ",", ".")


def format_money(cents: Column) -> Column:
    """R$ 1.234,56; the sign of a negative amount stands before R$, so it does not read back as negative."""
    v = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("R$ "), thousands(F.floor(v / 100).cast("bigint")), F.lit(","), F.lpad((v % 100).cast("string"), 2, "0"))
