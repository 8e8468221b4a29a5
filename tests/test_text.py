"""Scalar extraction: ids, dates, money, folding and label search."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliolens.functions import dates, ids, money, text


def values(spark, inputs, build):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r["v"] for r in rows.select("i", build(F.col("s")).alias("v")).orderBy("i").collect()]


def test_cnpj(spark):
    good = ["11.222.333/0001-81", "11222333000181", "00000000000000"]
    bad = ["11.222.333/0001-80", "11.222.333/0001-18", "1122233300018", "112223330001811", "abacate", ""]
    assert values(spark, good + bad, ids.valid_cnpj) == [True] * 3 + [False] * 6
    assert values(spark, ["11222333000181", "123"], ids.format_cnpj) == ["11.222.333/0001-81", None]
    found = values(spark, ["a 11.222.333/0001-81 b 11.222.333/0001-99", "none", "Nº45997418000153 é45997418000153", "x45997418000153"], ids.find_cnpjs)
    assert found == [["11.222.333/0001-81"], [], ["45.997.418/0001-53"] * 2, []]


def test_cpf(spark):
    assert values(spark, ["111.444.777-35", "11144477735"], ids.valid_cpf) == [True, True]
    assert not any(values(spark, ["111.444.777-36", "1114447773", "111444777350", *(str(d) * 11 for d in range(10))], ids.valid_cpf))
    assert values(spark, ["11144477735", "123"], ids.format_cpf) == ["111.444.777-35", None]
    assert values(spark, ["CPF 111.444.777-35 e 11144477736"], ids.find_cpfs) == [["111.444.777-35"]]


@pytest.mark.parametrize(
    ("written", "expected"),
    [
        ("14/09/2026", (2026, 9, 14)), ("14-09-2026", (2026, 9, 14)), ("5/1/2026", (2026, 1, 5)), ("05/01/26", (2026, 1, 5)), ("01/01/71", (1971, 1, 1)), ("29/02/2024", (2024, 2, 29)),
        ("14 de setembro de 2026", (2026, 9, 14)), ("10 de março de 2025", (2025, 3, 10)), ("10 de marco de 2025", (2025, 3, 10)), ("1 DE JANEIRO DE 2026", (2026, 1, 1)), ("14/09-2026", (2026, 9, 14)),
        ("abacate", None), ("32/13/2026", None), ("31/04/2026", None), ("29/02/2027", None), ("14 de nonexistente de 2026", None), ("", None), ("3 de foo de 2026 01/02/2026", None),
    ],
)
def test_dates(spark, written, expected):
    assert values(spark, [written], dates.parse_date) == [expected and dt.date(*expected)]


def test_money(spark):
    cases = {"R$ 1.234,56": 123456, "1234,56": 123456, "R$5": 500, "1.234": 123400, "-12,30": -1230, "R$ 0,05": 5, "1.234.567,89": 123456789, "": None, "abacate": None, "R$": None,
             "10,600": 1060, "1,000 9,80": 100, "1.2345": 123400, "-R$ 12,30": 1230, "99999999999999999999": None}
    assert values(spark, list(cases), money.parse_money) == list(cases.values())
    rows = spark.createDataFrame([(c,) for c in (0, 5, 500, 123456, 123456789, -1230)], "c long").select(money.format_money(F.col("c")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["R$ 0,00", "R$ 0,05", "R$ 5,00", "R$ 1.234,56", "R$ 1.234.567,89", "-R$ 12,30"]


def test_labels(spark):
    assert values(spark, ["Razão Social: X", "absent"], lambda s: text.folded_index(s, "Razao Social")) == [0, -1]
    assert values(spark, ["Identificacäo do"], lambda s: text.folded_index(s, "identificacao")) == [0]
    assert values(spark, ["Razão Social: Casa Verde CNPJ:123"], lambda s: text.after_label(s, "CNPJ:")) == ["123"]
    assert values(spark, ["A LTDA cnpj 1", "none"], lambda s: text.cut_before(s, "CNPJ")) == ["A LTDA ", "none"]
    assert values(spark, ["ab1c", "abc", ""], text.before_first_digit) == ["ab", "abc", ""]
    assert values(spark, [" : Venda  de", "x y"], text.first_phrase) == ["Venda", "x y"]
    assert values(spark, ["\t  a b 　\n"], text.trim_space) == ["a b"]
    assert values(spark, ["İX"], lambda s: text.folded_index(s, "x")) == [1]
