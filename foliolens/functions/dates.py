"""Brazilian dates in figures or written out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months by name, without tilde and cedilla.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
_START, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: Both notations.
WRITTEN = "(?i)" + _START + r"(\d{1,2})\s+de\s+(\p{L}+)\s+de\s+(\d{4})" + _END
FIGURES = _START + r"(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})" + _END


def month_number(name: Column) -> Column:
    """1 to 12, or null for a name that is no month."""
    at = F.array_position(F.lit(list(MONTHS)), F.translate(F.lower(name), "ãç", "ac"))
    return F.when(at > 0, at)


def full_year(year: Column) -> Column:
    """Two figures from 70 on are of the 1900s, others of the 2000s."""
    y = year.cast("int")
    return F.when(F.length(year) == 2, y + F.when(y >= 70, 1900).otherwise(2000)).otherwise(y)


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """Null for a day that the calendar lacks."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(month.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def parse_date(s: Column) -> Column:
    """The first date of a text. The written form goes first, and if it matches with an unknown month there is no date."""
    written, figures = F.regexp_extract(s, WRITTEN, 3) != "", F.regexp_extract(s, FIGURES, 3)
    spelled = calendar_date(F.regexp_extract(s, WRITTEN, 3), month_number(F.regexp_extract(s, WRITTEN, 2)), F.regexp_extract(s, WRITTEN, 1))
    numeric = calendar_date(full_year(F.nullif(figures, F.lit(""))), F.nullif(F.regexp_extract(s, FIGURES, 2), F.lit("")), F.regexp_extract(s, FIGURES, 1))
    return F.when(written, spelled).when(figures != "", numeric)
