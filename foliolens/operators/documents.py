"""Typed fields from the lines of a document: free fields, sales slips, goods invoices, service invoices.

Every rule is an expression over a line and the line below it; "the first line that ..." is an aggregate over line
numbers. So a document type is one window (for the line below) and one aggregation, both by page_id.
Absent values are null. ``lines`` has page_id, line_no (from 0, gapless) and words, as in ``operators.layout``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.dates import parse_date
from foliolens.functions.ids import find_cnpjs, find_cpfs, first_cnpj, first_id
from foliolens.functions.money import parse_money
from foliolens.functions.text import after_label, before_first_digit, cut_before, first_phrase, fold, fold_label, has_label, trim_space, without_spaces
from foliolens.operators import labels as L
from foliolens.operators.layout import align_columns, line_bounds, line_text, table_rows, word_cells

NEXT_LINE_GAP = 1.0  #: fixed value: the largest gap to the next line, in heights of this one


def prepared(lines: DataFrame) -> DataFrame:
    """lines with text, low (lower case), folded, box, and words, text and box of the line below."""
    rows = lines.withColumn("text", line_text(F.col("words"))).withColumn("box", line_bounds(F.col("words")))
    rows = rows.withColumn("folded", fold(F.col("text"))).withColumn("low", F.lower("text"))
    marked = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1"), fold(w["text"]).alias("folded")))
    rows = rows.withColumn("words", marked)
    below = Window.partitionBy("page_id").orderBy("line_no")
    for c in ("words", "text", "box"):
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(below))
    return rows


def below_label(label: str) -> Column:
    """The words of the next line within the x range of this line's words that hold the label; null if there are none,
    or if the next line is further than ``NEXT_LINE_GAP`` heights away."""
    needle = fold_label(label)
    holders = F.filter("words", lambda w: F.contains(w["folded"], F.lit(needle)))
    left, right = F.array_min(F.transform(holders, lambda w: w["x0"])), F.array_max(F.transform(holders, lambda w: w["x1"]))
    picked = F.filter("next_words", lambda w: (w["x1"] >= left) & (w["x0"] <= right))
    height = F.col("box.y1") - F.col("box.y0")
    near = (height > 0) & (F.col("next_box.y0") - F.col("box.y1") <= height * NEXT_LINE_GAP)
    fits = has_label(F.col("folded"), label) & near & (F.size(picked) > 0)
    return F.when(fits, F.array_join(F.transform(picked, lambda w: w["text"]), " "))


def beside_label(label: str) -> Column:
    return after_label(F.col("text"), label, F.col("folded"))


def _first(value: Column, when: Column | None = None, line: str = "line_no") -> Column:
    """Value of the first line on which it is not null (and ``when`` holds)."""
    kept = value if when is None else F.when(when, value)
    return F.min_by(kept, F.when(kept.isNotNull(), F.col(line)))


def _not_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _any_of(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


# ---- type

def line_type(text: Column) -> Column:
    """Document type by the first marker of a line, plain spaces aside; null without one."""
    bare = without_spaces(F.lower(text))
    return reduce(lambda otherwise, m: F.when(F.contains(bare, F.lit(m[1])), m[0]).otherwise(otherwise), reversed(L.TYPE_MARKERS), F.lit(None).cast("string"))


def document_types(lines: DataFrame) -> DataFrame:
    """page_id, tipo: decided by the first line with any marker."""
    rows = lines.select("page_id", "line_no", line_type(line_text(F.col("words"))).alias("t"))
    return rows.groupBy("page_id").agg(F.coalesce(_first(F.col("t")), F.lit(L.UNKNOWN_TYPE)).alias("tipo"))


# ---- free fields

def _money_after(label: str) -> Column:
    return parse_money(beside_label(label))


def _money_map(names: Sequence[str], columns: Sequence[str]) -> Column:
    entries = F.array(*[F.struct(F.lit(n).alias("k"), F.col(c).alias("v")) for n, c in zip(names, columns, strict=True)])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def _in_order(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("line_no", column))), lambda p: p[column])


def free_fields(lines: DataFrame) -> DataFrame:
    """page_id, cnpjs, cpfs, datas (one a line at most) and valores (label -> cents) of documents of any type."""
    rows = lines.withColumn("text", line_text(F.col("words"))).withColumn("folded", fold(F.col("text")))
    rows = rows.withColumns({"cnpjs": find_cnpjs(F.col("text")), "cpfs": find_cpfs(F.col("text")), "data": parse_date(F.col("text"))})
    money = [f"v{i}" for i in range(len(L.MONEY_LABELS))]
    out = rows.groupBy("page_id").agg(
        F.flatten(_in_order("cnpjs")).alias("cnpjs"), F.flatten(_in_order("cpfs")).alias("cpfs"),
        F.filter(_in_order("data"), lambda d: d.isNotNull()).alias("datas"), *[_first(_money_after(k)).alias(c) for c, k in zip(money, L.MONEY_LABELS, strict=True)],
    )
    return out.withColumn("valores", _money_map(L.MONEY_LABELS, money)).drop(*money)


# ---- items

def _end_of_items(values: Sequence[Column], found: Sequence[Column], start: Column, other: Column | None = None) -> Column:
    """First line from the start detection on with a label whose value is still open, or with ``other``.

    A label's value is open up to and on the line where it is first read, so per page that line bounds its occurrences.
    """
    in_page = Window.partitionBy("page_id")
    hits = []
    for v, f in zip(values, found, strict=True):
        read = F.min(F.when(v.isNotNull(), F.col("line_no"))).over(in_page)
        hits.append(f & (read.isNull() | (F.col("line_no") <= read)))
    hit = reduce(lambda a, b: a | b, hits if other is None else [*hits, other])
    return F.min(F.when((F.col("line_no") >= start - 1) & hit, F.col("line_no"))).over(in_page)


def _items(rows: DataFrame) -> DataFrame:
    """The item table of rows with item_start and item_end: the lines between, or to the last if the end is not after the start."""
    inside = (F.col("line_no") >= F.col("item_start")) & (F.col("item_end").isNull() | (F.col("item_end") <= F.col("item_start")) | (F.col("line_no") < F.col("item_end")))
    return rows.where(F.col("item_start").isNotNull() & inside)


def slip_item_lines(lines: DataFrame) -> DataFrame:
    """The lines of each sales slip that make up its item table."""
    rows = lines.withColumn("text", line_text(F.col("words"))).withColumn("folded", fold(F.col("text"))).withColumn("low", F.lower("text"))
    in_page = Window.partitionBy("page_id")
    footer = F.min(F.when(_any_of(F.col("low"), L.SLIP_FOOTERS), F.col("line_no"))).over(in_page)
    rows = rows.withColumn("footer", footer)
    opens = _any_of(F.col("low"), L.SLIP_ITEM_HEADERS) & (F.col("footer").isNull() | (F.col("line_no") < F.col("footer")))
    rows = rows.withColumn("item_start", F.min(F.when(opens, F.col("line_no"))).over(in_page) + 1)
    values, found = [_money_after(k) for k in L.MONEY_LABELS], [has_label(F.col("folded"), k) for k in L.MONEY_LABELS]
    return _items(rows.withColumn("item_end", _end_of_items(values, found, F.col("item_start")))).select(*lines.columns)


def invoice_item_lines(lines: DataFrame) -> DataFrame:
    """The lines of each goods invoice that make up its item table."""
    rows = prepared(lines)
    in_page = Window.partitionBy("page_id")
    rows = rows.withColumn("item_start", F.min(F.when(F.contains("low", F.lit(L.INVOICE_ITEMS)), F.col("line_no"))).over(in_page) + 1)
    texts = [_tax_text(k) for k in L.INVOICE_TAXES]
    end = _end_of_items([parse_money(t) for t in texts], [t.isNotNull() for t in texts], F.col("item_start"), F.contains("low", F.lit(L.INVOICE_ITEMS_END)))
    kept = _items(rows.withColumn("item_end", end)).select("page_id", "line_no")
    return lines.join(kept, ["page_id", "line_no"])


def item_table(item_lines: DataFrame) -> DataFrame:
    """page_id, row, col, text of item lines, every word a cell."""
    return align_columns(word_cells(item_lines))


def _item_arrays(item_lines: DataFrame) -> DataFrame:
    rows = table_rows(item_table(item_lines))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"])
    return rows.groupBy("page_id").agg(ordered.alias("itens"))


# ---- sales slip

def slip_fields(lines: DataFrame) -> DataFrame:
    """page_id, emitente_nome, emitente_id, destinatario_nome, destinatario_id, numero, data_emissao, totais."""
    rows = lines.withColumn("text", line_text(F.col("words"))).withColumn("folded", fold(F.col("text")))
    rows = rows.withColumns({
        "e_name": trim_space(cut_before(beside_label(L.SLIP_ISSUER), "CNPJ")), "e_id": F.when(has_label(F.col("folded"), L.SLIP_ISSUER), first_cnpj(F.col("text"))),
        "d_name": trim_space(cut_before(beside_label(L.SLIP_RECIPIENT), "CPF")), "d_id": first_id(beside_label(L.SLIP_RECIPIENT)),
        "number": _not_empty(trim_space(F.coalesce(*[beside_label(k) for k in L.SLIP_NUMBERS]))), "issued": parse_date(beside_label(L.SLIP_DATE)),
    })
    in_page = Window.partitionBy("page_id")
    rows = rows.withColumns({f"{p}_line": F.min(F.when(F.col(f"{p}_id").isNotNull(), F.col("line_no"))).over(in_page) for p in ("e", "d")})

    def name(p: str) -> Column:
        """From the last label up to the line that gives the id."""
        counts = F.col(f"{p}_name").isNotNull() & (F.col(f"{p}_line").isNull() | (F.col("line_no") <= F.col(f"{p}_line")))
        return _not_empty(F.max_by(F.when(counts, F.col(f"{p}_name")), F.when(counts, F.col("line_no"))))

    money = [f"v{i}" for i in range(len(L.MONEY_LABELS))]
    out = rows.groupBy("page_id").agg(
        name("e").alias("emitente_nome"), _first(F.col("e_id")).alias("emitente_id"), name("d").alias("destinatario_nome"), _first(F.col("d_id")).alias("destinatario_id"),
        _first(F.col("number")).alias("numero"), _first(F.col("issued")).alias("data_emissao"), *[_first(_money_after(k)).alias(c) for c, k in zip(money, L.MONEY_LABELS, strict=True)],
    )
    return out.withColumn("totais", _money_map(L.MONEY_LABELS, money)).drop(*money)


def extract_slips(lines: DataFrame) -> DataFrame:
    return slip_fields(lines).join(_item_arrays(slip_item_lines(lines)), "page_id", "left")


# ---- goods invoice

def longer_sibling(folded: Column, label: str, every: Sequence[str]) -> Column:
    """Whether a longer label that begins with this one stands in the text."""
    longer = [k for k in every if len(k) > len(label) and fold_label(k).startswith(fold_label(label))]
    return reduce(lambda a, b: a | b, [has_label(folded, k) for k in longer], F.lit(False))


def _tax_text(label: str) -> Column:
    return F.when(~longer_sibling(F.col("folded"), label, L.INVOICE_TAXES), F.coalesce(below_label(label), beside_label(label)))


def _worded_date(wordings: Sequence[str]) -> Column:
    """By wording: the value below if it is a date; else, where the wording stands, what follows it decides the line."""
    out = F.lit(None).cast("date")
    for k in reversed(wordings):
        beside = beside_label(k)
        out = F.coalesce(parse_date(below_label(k)), F.when(beside.isNotNull(), parse_date(beside)).otherwise(out))
    return out


def invoice_fields(lines: DataFrame) -> DataFrame:
    """page_id, emitente_id, destinatario_nome, destinatario_id, natureza, numero_nf, serie, chave, protocolo, data_emissao, data_saida, impostos."""
    rows = prepared(lines)
    text = F.col("text")
    below = {k: below_label(k) for k in (L.INVOICE_RECIPIENT, L.INVOICE_NATURE, L.INVOICE_SERIES, L.INVOICE_PROTOCOL, *L.INVOICE_NUMBERS)}
    column, beside = below[L.INVOICE_RECIPIENT], beside_label(L.INVOICE_RECIPIENT)
    column_id = first_id(column)
    rows = rows.withColumns({
        "section": F.contains("low", F.lit(L.INVOICE_RECIPIENT_SECTION)), "issuer": first_cnpj(text), "hit": column.isNotNull() | beside.isNotNull(),
        "r_name": trim_space(F.when(column.isNotNull(), F.when(column_id.isNotNull(), before_first_digit(column)).otherwise(column)).otherwise(cut_before(beside, "CNPJ"))),
        "r_id": F.when(column.isNotNull(), F.coalesce(column_id, first_id(F.col("next_text")), first_id(beside))).otherwise(first_id(beside)),
        "nature": _not_empty(trim_space(F.coalesce(below[L.INVOICE_NATURE], first_phrase(beside_label(L.INVOICE_NATURE))))),
        "number": _not_empty(trim_space(F.coalesce(*[below[k] for k in L.INVOICE_NUMBERS], *[cut_before(beside_label(k), L.INVOICE_SERIES) for k in L.INVOICE_NUMBERS]))),
        "series": _not_empty(trim_space(F.coalesce(below[L.INVOICE_SERIES], first_phrase(beside_label(L.INVOICE_SERIES))))),
        "access": _not_empty(without_spaces(F.regexp_extract(text, L.INVOICE_KEY, 0))),
        "protocol": _not_empty(trim_space(F.coalesce(below[L.INVOICE_PROTOCOL], beside_label(L.INVOICE_PROTOCOL)))),
        "issued": _worded_date(L.INVOICE_ISSUED), "moved": _worded_date(L.INVOICE_MOVED), **{f"t{i}": parse_money(_tax_text(k)) for i, k in enumerate(L.INVOICE_TAXES)},
    })
    in_page = Window.partitionBy("page_id")
    rows = rows.withColumn("section_line", F.min(F.when(F.col("section"), F.col("line_no"))).over(in_page))
    rows = rows.withColumn("hit_line", F.min(F.when(F.col("hit"), F.col("line_no"))).over(in_page))
    taxes = [f"t{i}" for i in range(len(L.INVOICE_TAXES))]
    before = F.col("section_line").isNull() | (F.col("line_no") < F.col("section_line"))
    at_hit = F.col("line_no") == F.col("hit_line")
    out = rows.groupBy("page_id").agg(
        _first(F.col("issuer"), before).alias("emitente_id"), _first(_not_empty(F.col("r_name")), at_hit).alias("destinatario_nome"), _first(F.col("r_id"), at_hit).alias("destinatario_id"),
        *[_first(F.col(c)).alias(n) for c, n in (("nature", "natureza"), ("number", "numero_nf"), ("series", "serie"), ("access", "chave"), ("protocol", "protocolo"), ("issued", "data_emissao"), ("moved", "data_saida"))],
        *[_first(F.col(t)).alias(t) for t in taxes],
    )
    return out.withColumn("impostos", _money_map(L.INVOICE_TAXES, taxes)).drop(*taxes)


def extract_invoices(lines: DataFrame) -> DataFrame:
    return invoice_fields(lines).join(_item_arrays(invoice_item_lines(lines)), "page_id", "left")


# ---- service invoice

def extract_service_invoices(lines: DataFrame) -> DataFrame:
    """page_id, prestador_*, tomador_*, municipio, numero, chave, competencia, data_emissao, descricao and the four amounts (0 if absent)."""
    rows = prepared(lines)
    in_page = Window.partitionBy("page_id")
    rows = rows.withColumn("customer_line", F.min(F.when(F.contains("low", F.lit(L.SERVICE_CUSTOMER_SECTION)), F.col("line_no"))).over(in_page))
    rows = rows.withColumn("customer", F.coalesce(F.col("line_no") >= F.col("customer_line"), F.lit(False)))
    id_below, id_beside = below_label(L.SERVICE_ID), beside_label(L.SERVICE_ID)
    rows = rows.withColumns({
        "name": _not_empty(trim_space(F.coalesce(below_label(L.SERVICE_NAME), first_phrase(beside_label(L.SERVICE_NAME))))),
        "id": F.when(id_below.isNotNull(), first_id(id_below)).otherwise(first_id(id_beside)),
        "town": _not_empty(trim_space(first_phrase(beside_label(L.SERVICE_TOWN)))),
        "number": _not_empty(trim_space(first_phrase(F.coalesce(below_label(L.SERVICE_NUMBER), beside_label(L.SERVICE_NUMBER))))),
        "access": _not_empty(F.regexp_extract("text", L.SERVICE_KEY, 0)),
        **{n: F.coalesce(parse_date(below_label(k)), parse_date(beside_label(k))) for n, k in (("period", L.SERVICE_PERIOD), ("issued", L.SERVICE_ISSUED))},
        "about": _not_empty(trim_space(beside_label(L.SERVICE_DESCRIPTION))),
        **{n: F.nullif(parse_money(F.coalesce(below_label(k), beside_label(k))), F.lit(0)) for n, k in L.SERVICE_MONEY.items()},
    })
    customer = F.col("customer")
    return rows.groupBy("page_id").agg(
        _first(F.col("name"), ~customer).alias("prestador_nome"), _first(F.col("id"), ~customer).alias("prestador_id"), _first(F.col("name"), customer).alias("tomador_nome"), _first(F.col("id"), customer).alias("tomador_id"),
        *[_first(F.col(c)).alias(n) for c, n in (("town", "municipio"), ("number", "numero"), ("access", "chave"), ("period", "competencia"), ("issued", "data_emissao"), ("about", "descricao"))],
        *[F.coalesce(_first(F.col(n)), F.lit(0)).alias(n) for n in L.SERVICE_MONEY],
    )


# ---- dispatch

def extract_documents(lines: DataFrame) -> DataFrame:
    """page_id, tipo, dav, danfe, nfse: the struct of the page's type, the others null; none for an unknown type."""
    types = document_types(lines)
    typed = lines.join(types, "page_id")
    parts = []
    for name, column, extract in (("DAV", "dav", extract_slips), ("DANFE", "danfe", extract_invoices), ("NFSe", "nfse", extract_service_invoices)):
        out = extract(typed.where(F.col("tipo") == name).drop("tipo"))
        parts.append(out.select("page_id", F.lit(name).alias("tipo"), F.struct(*[c for c in out.columns if c != "page_id"]).alias(column)))
    parts.append(types.where(F.col("tipo") == L.UNKNOWN_TYPE))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
