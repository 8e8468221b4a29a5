"""Document extraction on invented documents of the three types. Parties, ids and amounts are made up; ids get their check digits here."""

import datetime as dt

from foliolens.operators import documents as D

WORD = "text string, x0 double, y0 double, x1 double, y1 double"


def with_check_digits(digits, first):
    """digits and their two check digits; ``first`` is the weight of the first digit for the first of them."""
    for start in (first, first + 1):
        weights, w = [], start
        for _ in digits:
            weights.append(w)
            w = 9 if w == 2 and first < 9 else w - 1
        r = sum(int(d) * w for d, w in zip(digits, weights, strict=True)) % 11
        digits += str(0 if r < 2 else 11 - r)
    return digits


def company(n):
    return with_check_digits(f"{n:08}0001", 5)


def person(n):
    return with_check_digits(f"{n:09}", 10)


def shown(d):
    return f"{d[:2]}.{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}" if len(d) == 14 else f"{d[:3]}.{d[3:6]}.{d[6:9]}-{d[9:]}"


MILL, QUARRY, BAKER = company(70112233), company(40506070), person(305060708)
KEY = "".join(f"{7 * i % 10}" for i in range(44))
SERVICE_KEY = "".join(f"{3 * i % 10}" for i in range(50))


def lines(spark, *pages):
    """Pages of lines; a line is a text (one word, zero box) or a list of (text, x0, y0, x1, y1)."""
    rows = []
    for p, page in enumerate(pages):
        for i, line in enumerate(page):
            rows.append((p, i, [(line, 0.0, 0.0, 0.0, 0.0)] if isinstance(line, str) else [(w[0], *map(float, w[1:])) for w in line]))
    return spark.createDataFrame(rows, f"page_id int, line_no int, words array<struct<{WORD}>>")


def grid(*rows, top=50):
    """Lines of words in columns 100 wide, 20 high and 25 apart; a None leaves its column empty."""
    return [[(t, 110 * c, top + 25 * i, 110 * c + 100, top + 25 * i + 20) for c, t in enumerate(row) if t is not None] for i, row in enumerate(rows)]


SLIP = [
    "Documento auxiliar de venda", f"Razão Social: Moinho do Vale CNPJ:{MILL}", f"Nome: Padaria da Esquina CPF/CNPJ: {shown(BAKER)}", "Nº do Documento: 77-A", "Produto / Quantidade",
    "FARINHA 25KG", "3,000 81,45", "Total a pagar: 244,35", "Dt. Emis: 03/11/2025",
]
INVOICE = [
    "DANFE", f"CNPJ {shown(MILL)} CHAVE {' '.join(KEY[i : i + 4] for i in range(0, 44, 4))}", "Natureza da Operação Remessa  Nº 5150", "Série 9", "Destinatário", f"Nome/Razão Social Pedreira Azul CNPJ {QUARRY}",
    "Data da Emissão 07-02-2025", "Data da Saída 9/2/2025", "Protocolo de autorização de uso 990-7", "Dados do produto", "1 BRITA", "2 AREIA", "3 PÓ", "Valor total dos produtos 1.310,07", "Valor total da nota 1.399,99",
]
SERVICE = [
    "DANFSe", "Município: Vila Nova/ZZ", *grid(["Número da NFS-e", "Competência da NFS-e", "Data e hora da emissão da NFS-e"], ["88", "01/10/2025", "21/10/2025 17:05:00"]), SERVICE_KEY,
    *grid(["CNPJ/CPF/NIF", "Nome/Nome Empresarial"], [shown(BAKER), "Oficina Sol"], top=200), "Tomador/Adquirente", *grid(["CNPJ/CPF/NIF", "Nome/Nome Empresarial"], [shown(MILL), "Moinho do Vale"], top=300),
    "Descrição do Serviço conserto de portas", *grid(["BC ISSQN", "ISSQN Apurado", "Valor Líquido da NFS-e"], ["510,00", "25,50", "484,50"], top=400), "Valor da Operação/Serviço 510,00",
]
LETTER = ["uma carta sem rótulos"]


def by_page(df):
    return {r["page_id"]: r for r in df.collect()}


def test_types(spark):
    pages = (SLIP, INVOICE, SERVICE, LETTER, ["x", "documento AUXILIAR  de  venda", "DANFE"], ["nada", "danfse e danfe"], [])
    got = by_page(D.document_types(lines(spark, *pages)))
    assert [got[i]["tipo"] for i in range(6)] == ["DAV", "DANFE", "NFSe", "desconhecido", "DAV", "NFSe"] and 6 not in got


def test_slip(spark):
    with_footer = [SLIP[1], "3,000 FARELO", "Total a pagar: 5,00", "Plano de pagamento", "Quantidade de volumes 2", "mais uma linha"]
    renamed = ["Social: um", f"Social: dois CNPJ:{QUARRY}", "Social: três"]
    got = by_page(D.extract_slips(lines(spark, SLIP, LETTER, with_footer, renamed)))
    r = got[0]
    assert (r["emitente_nome"], r["emitente_id"], r["destinatario_nome"], r["destinatario_id"]) == ("Moinho do Vale", shown(MILL), "Padaria da Esquina", shown(BAKER))
    assert (r["numero"], r["data_emissao"], r["totais"]) == ("77-A", dt.date(2025, 11, 3), {"Total a pagar": 24435})
    assert r["itens"] == [["FARINHA 25KG"], ["3,000 81,45"]]
    assert got[1]["emitente_nome"] is None and got[1]["totais"] == {} and got[1]["itens"] is None
    assert got[2]["itens"] is None  # a header after the footer opens nothing
    assert got[3]["emitente_nome"] == "dois"  # the last name up to the line that gives the id


def test_items_end_where_a_total_is_open(spark):
    """A total that was read before the items does not end them; one that is read after them does."""
    early = ["Total a pagar: 9,00", "Quantidade", "a", "Total a pagar: 9,00", "b", "Valor Produtos 1,00", "c"]
    got = by_page(D.extract_slips(lines(spark, early)))
    assert got[0]["itens"] == [["a"], ["Total a pagar: 9,00"], ["b"]]


def test_item_columns(spark):
    page = ["DAV", *grid(["Quantidade", "Produto"], ["2", "Prego", "0,10"], [None, "Cola", "7,00"]), "Total a pagar 7,20"]
    got = by_page(D.extract_slips(lines(spark, page)))
    assert got[0]["itens"] == [["2", "Prego", "0,10"], ["", "Cola", "7,00"]]


def test_invoice_beside(spark):
    r = by_page(D.extract_invoices(lines(spark, INVOICE)))[0]
    assert (r["emitente_id"], r["destinatario_nome"], r["destinatario_id"]) == (shown(MILL), "Pedreira Azul", shown(QUARRY))
    assert (r["natureza"], r["numero_nf"], r["serie"], r["chave"], r["protocolo"]) == ("Remessa", "5150", "9", KEY, "990-7")
    assert (r["data_emissao"], r["data_saida"]) == (dt.date(2025, 2, 7), dt.date(2025, 2, 9))
    assert r["impostos"] == {"VALOR TOTAL DOS PRODUTOS": 131007, "VALOR TOTAL DA NOTA": 139999} and r["itens"] == [["1 BRITA"], ["2 AREIA"], ["3 PÓ"]]


def test_invoice_below(spark):
    below = [
        *grid(["Natureza da operação", "Protocolo de autorização de uso"], ["Devolução", "31-B"]), *grid(["Razão social", "Data da emissão"], ["Pedreira Azul", "30/06/2025"], top=200),
        *grid(["Valor total dos produtos", "Valor total da nota"], ["12,00", "13,50"], top=300), *grid(["Razão social"], ["Outra Casa"], top=400),
    ]
    taxes_first = ["Valor total da nota 8,00", "Dados do produto", "um", "Dados adicionais", "dois"]
    id_beside = grid(["Razão social", None], ["Pedreira Azul", shown(QUARRY)])
    id_above = grid(["Razão social", shown(QUARRY)], ["Pedreira Azul", None])
    worded = ["Razão social / Data emissão 1/3/2025"]
    sibling = grid(["Valor do ICMS substituição"], ["3,21"])
    far = [*grid(["Razão social"], top=0), *grid(["Longe Demais"], top=100)]
    got = by_page(D.extract_invoices(lines(spark, below, taxes_first, id_beside, id_above, worded, sibling, far)))
    r = got[0]
    assert (r["natureza"], r["protocolo"], r["destinatario_nome"], r["data_emissao"]) == ("Devolução", "31-B", "Pedreira Azul", dt.date(2025, 6, 30))
    assert r["impostos"] == {"VALOR TOTAL DOS PRODUTOS": 1200, "VALOR TOTAL DA NOTA": 1350}
    assert got[1]["impostos"] == {"VALOR TOTAL DA NOTA": 800} and got[1]["itens"] == [["um"]]
    assert [(got[i]["destinatario_nome"], got[i]["destinatario_id"]) for i in (2, 3)] == [("Pedreira Azul", shown(QUARRY))] * 2
    assert got[4]["data_emissao"] == dt.date(2025, 3, 1)
    assert got[5]["impostos"] == {"VALOR DO ICMS SUBSTITUIÇÃO": 321}  # not read as the shorter label too
    assert got[6]["destinatario_nome"] is None


def test_service_invoice(spark):
    got = by_page(D.extract_service_invoices(lines(spark, SERVICE, LETTER)))
    r = got[0]
    assert (r["municipio"], r["numero"], r["chave"], r["competencia"], r["data_emissao"]) == ("Vila Nova/ZZ", "88", SERVICE_KEY, dt.date(2025, 10, 1), dt.date(2025, 10, 21))
    assert (r["prestador_id"], r["prestador_nome"], r["tomador_id"], r["tomador_nome"]) == (shown(BAKER), "Oficina Sol", shown(MILL), "Moinho do Vale")
    assert (r["descricao"], r["valor_servico"], r["base_issqn"], r["issqn"], r["valor_liquido"]) == ("conserto de portas", 51000, 51000, 2550, 48450)
    assert got[1]["numero"] is None and got[1]["valor_servico"] == 0


def test_free_fields(spark):
    page = [f"{shown(MILL)} e {QUARRY} em 2 de maio de 2025", f"{shown(BAKER)} 11111111111", "Total a pagar sem valor", "Total a pagar: 3,10", "Total a pagar: 4,00"]
    r = by_page(D.free_fields(lines(spark, page)))[0]
    assert (r["cnpjs"], r["cpfs"], r["datas"], r["valores"]) == ([shown(MILL), shown(QUARRY)], [shown(BAKER)], [dt.date(2025, 5, 2)], {"Total a pagar": 310})


def test_dispatch(spark):
    """The struct of each page's own type is what the type's extraction gives; the others are null."""
    pages = lines(spark, SLIP, INVOICE, SERVICE, LETTER)
    got = by_page(D.extract_documents(pages))
    assert [got[i]["tipo"] for i in range(4)] == ["DAV", "DANFE", "NFSe", "desconhecido"]
    assert [[got[i][c] is not None for c in ("dav", "danfe", "nfse")] for i in range(4)] == [[True, False, False], [False, True, False], [False, False, True], [False] * 3]
    for i, (column, extract) in enumerate((("dav", D.extract_slips), ("danfe", D.extract_invoices), ("nfse", D.extract_service_invoices))):
        want = by_page(extract(pages))[i].asDict()
        assert want.pop("page_id") == i and got[i][column].asDict() == want
    assert D.extract_documents(pages.limit(0)).count() == 0
