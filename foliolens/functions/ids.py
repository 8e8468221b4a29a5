"""Tax ids of companies (CNPJ, 14 digits) and persons (CPF, 11 digits): validity, format and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolens.functions.text import digits_only

#: Weights of the first and second check digit.
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
#: How ids are printed. A boundary is one between ASCII word characters and others.
_START, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
CNPJ_PATTERN = _START + r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}" + _END
CPF_PATTERN = _START + r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}" + _END


def digit(d: Column, place: int) -> Column:
    """The digit at a place (from 0) of a string of digits."""
    return F.ascii(F.substr(d, F.lit(place + 1), F.lit(1))) - 48


def weighted_sum(d: Column, weights: Sequence[int]) -> Column:
    return sum((digit(d, i) * w for i, w in enumerate(weights)), F.lit(0))


def check_digit(d: Column, weights: Sequence[int]) -> Column:
    r = weighted_sum(d, weights) % 11
    return F.when(r < 2, 0).otherwise(11 - r)


def _valid_digits(d: Column, weights: tuple[Sequence[int], Sequence[int]]) -> Column:
    n = len(weights[0])
    return (F.length(d) == n + 2) & (check_digit(d, weights[0]) == digit(d, n)) & (check_digit(d, weights[1]) == digit(d, n + 1))


def valid_cnpj(s: Column) -> Column:
    """Fourteen digits with right check digits, whatever stands between them. Fourteen zeros are valid."""
    return _valid_digits(digits_only(s), CNPJ_WEIGHTS)


def valid_cpf(s: Column) -> Column:
    """Eleven digits, not all alike, with right check digits."""
    d = digits_only(s)
    return _valid_digits(d, CPF_WEIGHTS) & (F.replace(d, F.left(d, F.lit(1)), F.lit("")) != "")


def format_cnpj(s: Column) -> Column:
    """XX.XXX.XXX/XXXX-XX without validation; null unless there are fourteen digits."""
    d = digits_only(s)
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5"))


def format_cpf(s: Column) -> Column:
    """XXX.XXX.XXX-XX without validation; null unless there are eleven digits."""
    d = digits_only(s)
    return F.when(F.length(d) == 11, F.regexp_replace(d, r"^(...)(...)(...)(..)$", "$1.$2.$3-$4"))


def find_cnpjs(s: Column) -> Column:
    """All valid company ids of a text, formatted, in order, repeats included."""
    return F.transform(F.filter(F.regexp_extract_all(s, F.lit(CNPJ_PATTERN), 0), valid_cnpj), format_cnpj)


def find_cpfs(s: Column) -> Column:
    """All valid person ids of a text, formatted, in order, repeats included."""
    return F.transform(F.filter(F.regexp_extract_all(s, F.lit(CPF_PATTERN), 0), valid_cpf), format_cpf)


def first_cnpj(s: Column) -> Column:
    return F.try_element_at(find_cnpjs(s), F.lit(1))


def first_id(s: Column) -> Column:
    """The first company id, else the first person id, else null."""
    return F.coalesce(first_cnpj(s), F.try_element_at(find_cpfs(s), F.lit(1)))
