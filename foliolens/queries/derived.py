"""Fixture tables with tax ids, dates, money and documents, made from the sales tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from foliolens.functions.dates import MONTHS
from foliolens.functions.ids import CNPJ_WEIGHTS, CPF_WEIGHTS


def _check(column: str, weights: tuple[int, ...]) -> str:
    total = " + ".join(f"(ascii(substr({column}, {i + 1}, 1)) - 48) * {w}" for i, w in enumerate(weights))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


def _ids(source: str, key: str, base: str, weights: tuple, shown: str) -> str:
    return f"""
WITH b AS (SELECT {key} AS key, {base} AS b FROM {source}), c AS (SELECT key, b || CAST({_check("b", weights[0])} AS STRING) AS b FROM b),
d AS (SELECT key, b, {_check("b", weights[1])} AS d2 FROM c),
e AS (SELECT key, key % 7 <> 0 AS valid, b || CAST(CASE WHEN key % 7 = 0 THEN (d2 + 1) % 10 ELSE d2 END AS STRING) AS id FROM d),
f AS (SELECT key, valid, id, {shown} AS formatted FROM e)
SELECT key, valid, id, formatted, CASE key % 3 WHEN 0 THEN formatted WHEN 1 THEN id ELSE 'Nº' || id END AS shown FROM f"""


CNPJ = _ids("supplier", "s_suppkey", "lpad(CAST(s_suppkey AS STRING), 8, '0') || '0001'", CNPJ_WEIGHTS, "substr(id,1,2)||'.'||substr(id,3,3)||'.'||substr(id,6,3)||'/'||substr(id,9,4)||'-'||substr(id,13,2)")
CPF = _ids("customer", "c_custkey", "CAST(c_custkey + 100000000 AS STRING)", CPF_WEIGHTS, "substr(id,1,3)||'.'||substr(id,4,3)||'.'||substr(id,7,3)||'-'||substr(id,10,2)")


def brazilian(cents: str) -> str:
    """The magnitude of an expression of cents, as 1.234.567,89."""
    v = f"abs({cents})"
    u = f"CAST(floor({v} / 100.0) AS BIGINT)"
    part = lambda n: f"lpad(CAST(CAST(floor({u} / {n}.0) AS BIGINT) % 1000 AS STRING), 3, '0')"
    units = (
        f"CASE WHEN {u} >= 1000000 THEN CAST(CAST(floor({u} / 1000000.0) AS BIGINT) AS STRING)||'.'||{part(1000)}||'.'||{part(1)} "
        f"WHEN {u} >= 1000 THEN CAST(CAST(floor({u} / 1000.0) AS BIGINT) AS STRING)||'.'||{part(1)} ELSE CAST({u} AS STRING) END"
    )
    return f"({units}||','||lpad(CAST({v} % 100 AS STRING), 2, '0'))"


_MONTH = "CASE month(d) " + " ".join(f"WHEN {i + 1} THEN '{'março' if m == 'marco' else m}'" for i, m in enumerate(MONTHS)) + " END"
_DAY, _MON, _YEAR = "CAST(day(d) AS STRING)", "CAST(month(d) AS STRING)", "CAST(year(d) AS STRING)"
_SLASHED = f"lpad({_DAY},2,'0')||'/'||lpad({_MON},2,'0')||'/'||{_YEAR}"

DATES = f"""
WITH o AS (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT key, CASE WHEN key % 5 = 4 THEN NULL ELSE d END AS expected, 'Emitido em '||CASE key % 5 WHEN 0 THEN {_SLASHED} WHEN 1 THEN {_DAY}||'-'||{_MON}||'-'||{_YEAR}
WHEN 2 THEN lpad({_DAY},2,'0')||'/'||lpad({_MON},2,'0')||'/'||substr({_YEAR},3,2) WHEN 3 THEN {_DAY}||' de '||{_MONTH}||' de '||{_YEAR} ELSE '31/02/'||{_YEAR} END||' fim' AS text FROM o"""

MONEY = f"""
WITH c AS (SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)
SELECT key, cents, CASE key % 4 WHEN 0 THEN CASE WHEN cents < 0 THEN '-' ELSE '' END||'R$ '||{brazilian("cents")} WHEN 1 THEN 'valor '||{brazilian("cents")}||' fim'
WHEN 2 THEN 'R$'||CAST(CAST(floor(abs(cents) / 100.0) AS BIGINT) AS STRING) ELSE CASE WHEN cents < 0 THEN '-' ELSE '' END||{brazilian("cents")} END AS text,
CASE key % 4 WHEN 0 THEN abs(cents) WHEN 1 THEN abs(cents) WHEN 2 THEN CAST(floor(abs(cents) / 100.0) AS BIGINT) * 100 ELSE cents END AS expected FROM c"""

SALES = f"""
SELECT o_orderkey AS page_id, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, c_name, p.formatted AS cpf, p.valid AS cpf_valid, s.id AS cnpj_digits, s.formatted AS cnpj, s.valid AS cnpj_valid
FROM orders JOIN customer ON o_custkey = c_custkey JOIN ({CPF}) p ON p.key = c_custkey
JOIN ({CNPJ}) s ON s.key = o_orderkey % (SELECT count(*) FROM supplier)"""

_LINES = {
    "slip": ((0, 0, "DOCUMENTO AUXILIAR DE VENDA - PEDIDO", 0, 600), (1, 0, "Razao Social: {name} CNPJ:{cnpj_digits}", 0, 600), (2, 0, "Nome: {c_name} CPF/CNPJ: {cpf}", 0, 600), (3, 0, "N° do Documento:{number}", 0, 600),
             (4, 0, "Produto/Endereco", 0, 280), (4, 1, "Quantidade", 300, 400), (5, 0, "ITEM {number}", 0, 280), (5, 1, "1,000", 300, 400), (5, 2, "{money}", 410, 600), (6, 0, "FRETE", 0, 280), (6, 2, "0,00", 410, 600),
             (7, 0, "Total a pagar: {money}", 0, 600), (8, 0, "Dt. Emis:{date}", 0, 600)),
    "invoice": ((0, 0, "DANFE Documento Auxiliar", 10, 400), (1, 0, "CNPJ {cnpj_digits}", 10, 400), (2, 0, "NATUREZA DA OPERAÇÃO", 10, 180), (2, 1, "PROTOCOLO DE AUTORIZAÇÃO DE USO", 190, 400), (3, 0, "Venda a {c_name}", 10, 180), (3, 1, "13526{number}", 190, 400),
                (4, 0, "DESTINATÁRIO/REMETENTE", 10, 400), (5, 0, "NOME/RAZÃO SOCIAL", 10, 200), (5, 1, "DATA DA EMISSÃO", 210, 350), (6, 0, "{c_name}", 10, 200), (6, 1, "{date}", 210, 350), (6, 2, "{cpf}", 360, 470),
                (7, 0, "VALOR TOTAL DOS PRODUTOS", 10, 220), (7, 1, "VALOR TOTAL DA NOTA", 230, 400), (8, 0, "{money}", 10, 220), (8, 1, "{money}", 230, 400), (9, 0, "Nº {number} SÉRIE 001", 10, 400)),
    "service": ((0, 0, "DANFSe v2.0", 10, 400), (1, 0, "Município: FORTALEZA/CE", 10, 400), (2, 0, "NÚMERO DA NFS-E", 10, 200), (2, 1, "COMPETÊNCIA DA NFS-E", 210, 400), (3, 0, "{number}", 10, 200), (3, 1, "{date}", 210, 400), (4, 0, "CNPJ/CPF/NIF", 10, 200), (5, 0, "{cnpj}", 10, 200),
                (6, 0, "Nome/Nome Empresarial", 10, 200), (7, 0, "{name}", 10, 200), (8, 0, "TOMADOR/ADQUIRENTE", 10, 200), (9, 0, "CNPJ/CPF/NIF", 10, 200), (10, 0, "{cpf}", 10, 200), (11, 0, "Nome/Nome Empresarial", 10, 200), (12, 0, "{c_name}", 10, 200),
                (13, 0, "BC ISSQN", 10, 200), (13, 1, "Valor Líquido da NFS-e", 210, 400), (14, 0, "{money}", 10, 200), (14, 1, "{money}", 210, 400)),
}
_FIELDS = {"name": "'FORNECEDOR '||substr(cnpj_digits, 1, 8)", "cnpj_digits": "cnpj_digits", "cnpj": "cnpj", "c_name": "c_name", "cpf": "cpf", "number": "lpad(CAST(page_id AS STRING), 10, '0')", "money": brazilian("cents"), "date": _SLASHED}
NUMBER, DATE_TEXT, NAME = _FIELDS["number"], _SLASHED, _FIELDS["name"]


def _word_text(template: str) -> str:
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return "||".join(_FIELDS[p[1:-1]] if p[0] == "{" else f"'{p}'" for p in parts)


def document_words(kind: str) -> str:
    """page_id, line_no, word_no, text, x0, y0, x1, y1 of one document for each order."""
    lines = _LINES[kind]
    texts = " ".join(f"WHEN {i} THEN {_word_text(t)}" for i, (_, _, t, _, _) in enumerate(lines))
    places = ", ".join(f"({i}, {line}, {word}, {x0}, {x1})" for i, (line, word, _, x0, x1) in enumerate(lines))
    return f"""
SELECT page_id, line_no, word_no, CASE v.i {texts} END AS text, CAST(x0 AS DOUBLE) AS x0, CAST(100 + 33 * line_no AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(130 + 33 * line_no AS DOUBLE) AS y1
FROM ({SALES}) s CROSS JOIN (VALUES {places}) AS v(i, line_no, word_no, x0, x1)"""


#: Words of a grid of items, jittered by a rule; every sixth row lacks its third column. Words are numbered from right to left.
GRID = """
WITH i AS (SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS INT) AS row, l_partkey, l_suppkey, l_linenumber FROM lineitem)
SELECT page_id, row, c.col, CAST(100 * row + 9 - c.col AS INT) AS word_no, CASE c.col WHEN 0 THEN 'P'||CAST(l_partkey AS STRING) WHEN 1 THEN 'S'||CAST(l_suppkey AS STRING) WHEN 2 THEN 'N'||CAST(l_linenumber AS STRING) ELSE 'R'||CAST(row AS STRING) END AS text,
CAST(c.x + (page_id * 7 + row + c.col) % 5 AS DOUBLE) AS x0, CAST(30 * row + (page_id + c.col) % 4 AS DOUBLE) AS y0, CAST(c.x + 60 + (page_id * 7 + row + c.col) % 5 AS DOUBLE) AS x1, CAST(30 * row + 20 + (page_id + c.col) % 4 AS DOUBLE) AS y1
FROM i CROSS JOIN (VALUES (0, 0), (1, 300), (2, 400), (3, 650)) AS c(col, x) WHERE NOT (c.col = 2 AND (page_id + row) % 6 = 0)"""

TABLES = ("supplier", "customer", "orders", "lineitem", "documents", "embeddings", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of a shared statement over the tables of a folder."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)
