"""Sales slips, goods invoices and service invoices made from orders; expected fields come from the orders themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.operators import documents as D
from foliolens.operators import labels as L
from foliolens.operators.layout import lines_of
from foliolens.queries.derived import DATE_TEXT, NAME, NUMBER, SALES, derive, document_words


def _lines(kind: str):
    return lambda s, d: lines_of(derive(s, d, document_words(kind)).withColumnRenamed("word_no", "pos"))


SLIP, INVOICE, SERVICE = (_lines(k) for k in ("slip", "invoice", "service"))


def _fields(lines, extract, *columns):
    return lambda s, d: extract(lines(s, d)).select("page_id", *columns)


def _expect(columns: str) -> str:
    return f"SELECT page_id, {columns} FROM ({SALES})"


_CNPJ, _CPF = "CASE WHEN cnpj_valid THEN cnpj END", "CASE WHEN cpf_valid THEN cpf END"


def _any_type(s, d):
    return SLIP(s, d).unionByName(INVOICE(s, d).withColumn("page_id", -F.col("page_id") - 1))


def _whole(s, d):
    docs = D.extract_documents(_any_type(s, d))
    return docs.select("page_id", "tipo", F.col("dav.numero").alias("numero"), F.col("danfe.numero_nf").alias("numero_nf"), F.coalesce(F.size("dav.itens"), F.lit(0)).alias("n_itens"))


def _exploded(lines, extract, column):
    return lambda s, d: extract(lines(s, d)).select("page_id", F.explode(column).alias("label", "cents"))


QUERIES = {
    "doc_type": (lambda s, d: D.document_types(_any_type(s, d)), f"SELECT page_id, 'DAV' AS tipo FROM ({SALES}) UNION ALL SELECT -page_id - 1, 'DANFE' FROM ({SALES})"),
    "doc_dispatch": (
        _whole,
        f"SELECT page_id, 'DAV' AS tipo, {NUMBER} AS numero, CAST(NULL AS VARCHAR) AS numero_nf, 2 AS n_itens FROM ({SALES}) UNION ALL SELECT -page_id - 1, 'DANFE', NULL, {NUMBER}, 0 FROM ({SALES})",
    ),
    "campos_ids": (
        lambda s, d: D.free_fields(SLIP(s, d)).select("page_id", F.array_join("cnpjs", ",").alias("cnpjs"), F.array_join("cpfs", ",").alias("cpfs")),
        _expect("CASE WHEN cnpj_valid THEN cnpj ELSE '' END AS cnpjs, CASE WHEN cpf_valid THEN cpf ELSE '' END AS cpfs"),
    ),
    "campos_dates": (lambda s, d: D.free_fields(SLIP(s, d)).select("page_id", F.explode("datas").alias("d")), _expect("d")),
    "campos_money": (_exploded(SLIP, D.free_fields, "valores"), _expect("'Total a pagar' AS label, cents")),
    "dav_parties": (
        _fields(SLIP, D.slip_fields, "emitente_nome", "emitente_id", "destinatario_nome", "destinatario_id"),
        _expect(f"{NAME} AS emitente_nome, {_CNPJ} AS emitente_id, c_name AS destinatario_nome, {_CPF} AS destinatario_id"),
    ),
    "dav_number_date": (_fields(SLIP, D.slip_fields, "numero", "data_emissao"), _expect(f"{NUMBER} AS numero, d AS data_emissao")),
    "dav_totals": (_exploded(SLIP, D.slip_fields, "totais"), _expect("'Total a pagar' AS label, cents")),
    "dav_items": (
        lambda s, d: D.item_table(D.slip_item_lines(SLIP(s, d))),
        " UNION ALL ".join(f"SELECT page_id, {row} AS row, {col} AS col, {text} AS text FROM ({SALES})" for row, col, text in (
            (5, 0, f"'ITEM '||{NUMBER}"), (5, 1, "'1,000'"), (5, 2, "(SELECT 1)"), (6, 0, "'FRETE'"), (6, 2, "'0,00'")) if text != "(SELECT 1)")
        + f" UNION ALL SELECT page_id, 5, 2, text FROM ({document_words('slip')}) WHERE line_no = 5 AND word_no = 2",
    ),
    "danfe_parties": (
        _fields(INVOICE, D.invoice_fields, "emitente_id", "destinatario_nome", "destinatario_id"),
        _expect(f"{_CNPJ} AS emitente_id, c_name AS destinatario_nome, {_CPF} AS destinatario_id"),
    ),
    "danfe_header": (
        _fields(INVOICE, D.invoice_fields, "natureza", "numero_nf", "serie", "protocolo", "data_emissao"),
        _expect(f"'Venda a '||c_name AS natureza, {NUMBER} AS numero_nf, '001' AS serie, '13526'||{NUMBER} AS protocolo, d AS data_emissao"),
    ),
    "danfe_taxes": (_exploded(INVOICE, D.invoice_fields, "impostos"), f"{_expect(f"'{L.INVOICE_TAXES[0]}' AS label, cents")} UNION ALL {_expect(f"'{L.INVOICE_TAXES[1]}', cents")}"),
    "nfse_parties": (
        _fields(SERVICE, D.extract_service_invoices, "prestador_nome", "prestador_id", "tomador_nome", "tomador_id"),
        _expect(f"{NAME} AS prestador_nome, {_CNPJ} AS prestador_id, c_name AS tomador_nome, {_CPF} AS tomador_id"),
    ),
    "nfse_header": (_fields(SERVICE, D.extract_service_invoices, "municipio", "numero", "competencia"), _expect(f"'FORTALEZA/CE' AS municipio, {NUMBER} AS numero, d AS competencia")),
    "nfse_money": (_fields(SERVICE, D.extract_service_invoices, "valor_servico", "base_issqn", "issqn", "valor_liquido"), _expect("CAST(0 AS BIGINT) AS valor_servico, cents AS base_issqn, CAST(0 AS BIGINT) AS issqn, cents AS valor_liquido")),
    "value_below_label": (
        lambda s, d: D.prepared(INVOICE(s, d)).select("page_id", D.below_label("DATA DA EMISSÃO").alias("v")).where("v is not null"),
        _expect(f"{DATE_TEXT} AS v"),
    ),
}
