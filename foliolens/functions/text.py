"""Text expressions: trimming, accent folding, label search and cutting. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Folded letters and what they fold to, one for one.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"
_TABLE = str.maketrans(ACCENTED, PLAIN)


def trim_space(s: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.btrim(s, F.lit(SPACES))


def fold_label(label: str) -> str:
    """What ``fold`` makes of a literal."""
    return label.replace("İ", "i").lower().translate(_TABLE)


def fold(s: Column) -> Column:
    """Lower case without accents; each character becomes one character, so positions carry over."""
    return F.translate(F.lower(F.replace(s, F.lit("İ"), F.lit("i"))), ACCENTED, PLAIN)


def folded_index(s: Column, needle: str) -> Column:
    """Position (from 0) of the first folded occurrence; -1 if absent or if the needle is empty."""
    return F.position(F.lit(fold_label(needle)), fold(s)) - 1 if needle else F.when(s.isNotNull(), F.lit(-1))


def has_label(folded: Column, label: str) -> Column:
    return F.position(F.lit(fold_label(label)), folded) > 0


def after_label(s: Column, label: str, folded: Column | None = None) -> Column:
    """What follows the first folded occurrence of the label; null if there is none. ``folded`` saves folding again."""
    at = F.position(F.lit(fold_label(label)), fold(s) if folded is None else folded)
    return F.when(at > 0, F.substr(s, at + F.lit(len(label))))


def cut_before(s: Column, marker: str) -> Column:
    """What precedes the first folded occurrence of the marker; all of s if there is none."""
    at = F.position(F.lit(fold_label(marker)), fold(s))
    return F.when(at > 0, F.substr(s, F.lit(1), at - 1)).otherwise(s)


def before_first_digit(s: Column) -> Column:
    return F.regexp_extract(s, r"^[^0-9]*", 0)


def first_phrase(s: Column) -> Column:
    """Without leading spaces and colons, up to the first double space."""
    return F.split_part(F.ltrim(s, F.lit(" :")), F.lit("  "), F.lit(1))


def without_spaces(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit(""))


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def joined_sorted(items: Column) -> Column:
    """Distinct items in order, joined by a comma and a space."""
    return F.array_join(F.array_sort(F.array_distinct(items)), ", ")
