"""Printed labels of the document types. All are fixed values: the words that the forms print."""

TYPE_MARKERS = (("NFSe", "danfse"), ("DANFE", "danfe"), ("DAV", "documentoauxiliardevenda"))
UNKNOWN_TYPE = "desconhecido"

MONEY_LABELS = ("Total a pagar", "Valor Produtos", "Total Bruto Produtos")

SLIP_ISSUER, SLIP_RECIPIENT, SLIP_DATE = "Social:", "Nome:", "Emis:"
SLIP_NUMBERS = ("do Documento:", "Documento:")
SLIP_FOOTERS = ("plano de pagamento", "dados complementares")
SLIP_ITEM_HEADERS = ("endere", "quantidade")

INVOICE_TAXES = (
    "VALOR TOTAL DOS PRODUTOS", "VALOR TOTAL DA NOTA", "BASE DE CÁLCULO DO ICMS SUBSTITUIÇÃO", "VALOR DO ICMS SUBSTITUIÇÃO",
    "BASE DE CÁLCULO DO ICMS", "VALOR DO ICMS", "VALOR DO FRETE", "VALOR DO SEGURO", "DESCONTO", "OUTRAS DESPESAS ACESSÓRIAS", "VALOR DO IPI",
)
INVOICE_RECIPIENT, INVOICE_NATURE, INVOICE_SERIES = "RAZÃO SOCIAL", "NATUREZA DA OPERAÇÃO", "SÉRIE"
INVOICE_NUMBERS = ("N.º", "Nº")
INVOICE_PROTOCOL = "PROTOCOLO DE AUTORIZAÇÃO DE USO"
INVOICE_ISSUED = ("DATA DA EMISSÃO", "DATA EMISSÃO")
INVOICE_MOVED = ("DATA DA SAÍDA/ENTRADA", "DATA DE SAÍDA/ENTRADA", "DATA DA SAÍDA", "DATA DA ENTRADA")
INVOICE_RECIPIENT_SECTION, INVOICE_ITEMS, INVOICE_ITEMS_END = "destinat", "dados do produto", "dados adicionais"
INVOICE_KEY = r"(?<![0-9A-Za-z_])(?:\d{4}\s*){10}\d{4}(?![0-9A-Za-z_])"

SERVICE_CUSTOMER_SECTION = "tomador/adquirente"
SERVICE_NAME, SERVICE_ID, SERVICE_TOWN = "Nome/Nome Empresarial", "CNPJ/CPF/NIF", "Município:"
SERVICE_NUMBER, SERVICE_PERIOD, SERVICE_ISSUED = "NÚMERO DA NFS-E", "COMPETÊNCIA DA NFS-E", "DATA E HORA DA EMISSÃO DA NFS-E"
SERVICE_DESCRIPTION = "Descrição do Serviço"
SERVICE_MONEY = {"valor_servico": "Valor da Operação/Serviço", "base_issqn": "BC ISSQN", "issqn": "ISSQN Apurado", "valor_liquido": "Valor Líquido da NFS-e"}
SERVICE_KEY = r"(?<![0-9A-Za-z_])\d{50}(?![0-9A-Za-z_])"
