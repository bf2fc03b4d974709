"""Word lists, labels and patterns whose exact values decide the results."""

# --------------------------------------------------------------------------
# Ledger contract
# --------------------------------------------------------------------------
LEDGER_REQUIRED = ("data", "categoria", "fornecedor", "valor")
BUDGET_REQUIRED = ("categoria", "limite")
ENTRY_TYPES = ("receita", "despesa")
STANDARD_CATEGORIES = (
    "mercadorias", "energia", "aluguel", "folha", "transporte", "servicos", "impostos", "outros",
)
SEVERITIES = ("baixa", "media", "alta", "critica")
DEFAULT_THRESHOLDS = {"baixa": 10.0, "media": 20.0, "alta": 35.0, "critica": 50.0}
ALERT_KIND = {"orcamento": "estouro_orcamento", "historico": "variacao_historica"}
ALERT_PHRASE = {
    "orcamento": "estourou o orçamento",
    "historico": "aumentou frente ao período anterior",
}

# --------------------------------------------------------------------------
# labels
# --------------------------------------------------------------------------
SITUATION_LABEL = {
    "lucro": "LUCRO",
    "prejuizo": "PREJUÍZO",
    "equilibrio": "EQUILÍBRIO (receita = despesa)",
}
SEVERITY_LABEL = {"critica": "CRÍTICA", "alta": "ALTA", "media": "MÉDIA", "baixa": "BAIXA"}
NATURE_LABEL = {"D": "Devedora", "C": "Credora"}
ABC_LABEL = {"A": "A — Alto impacto", "B": "B — Impacto médio", "C": "C — Baixo impacto"}
NO_PERIOD_LABEL = "Período não identificado"
NO_COMPANY_LABEL = "Empresa não identificada"

# --------------------------------------------------------------------------
# Advice on alerts
# --------------------------------------------------------------------------
ACTIONS = {
    "mercadorias": (
        "Cotar preços com pelo menos 2-3 fornecedores alternativos.",
        "Negociar prazos de pagamento e descontos por volume com o fornecedor atual.",
    ),
    "energia": (
        "Avaliar migração para mercado livre de energia ou fontes alternativas.",
        "Auditar consumo e identificar equipamentos ineficientes.",
    ),
    "aluguel": ("Renegociar valor de locação ou avaliar espaços alternativos.",),
    "folha": ("Revisar estrutura de cargos, horas extras e benefícios.",),
    "transporte": (
        "Cotar frete com transportadoras alternativas.",
        "Avaliar consolidação de cargas para reduzir custo por entrega.",
    ),
    "servicos": ("Revisar contrato de prestação de serviço e buscar propostas concorrentes.",),
    "outros": ("Investigar causa do aumento e buscar alternativas de redução de custo.",),
}
ACTION_PREFIX = {
    "critica": "PRIORIDADE CRÍTICA: ação imediata recomendada.",
    "alta": "PRIORIDADE ALTA: ação imediata recomendada.",
    "media": "Prioridade média: monitorar de perto no próximo período.",
}

# --------------------------------------------------------------------------
# Ledger categories of an account, first group with a hit wins
# --------------------------------------------------------------------------
LEDGER_CATEGORY_WORDS = (
    ("energia", (
        "energia", "eletrica", "luz", "cpfl", "enel", "cemig", "light", "eletropaulo", "copel",
        "coelba", "celesc", "energisa", "equatorial", "neoenergia", "elektro",
        "distribuidora de energia",
    )),
    ("aluguel", ("aluguel", "condominio", "locacao", "arrendamento", "imovel")),
    ("folha", (
        "salario", "ordenado", "folha", "inss", "fgts", "vale transporte", "vale-transporte",
        "vale alimentacao", "vale-alimentacao", "vale refeicao", "vale-refeicao", "pessoal",
        "encargo", "pro labore", "pro-labore", "decimo terceiro", "13o salario", "ferias",
        "rescisao", "beneficio", "plano de saude",
    )),
    ("transporte", (
        "transporte", "frete", "combustivel", "logistica", "pedagio", "gasolina", "diesel",
        "etanol", "posto de combustivel", "seguro veicular", "manutencao de veiculo",
        "transportadora",
    )),
    ("servicos", (
        "servico", "contabil", "manutencao", "internet", "telefonia", "assessoria",
        "consultoria", "honorario", "advocacia", "juridico", "software", "licenca de uso",
        "assinatura", "tecnologia da informacao", "terceirizado", "mao de obra terceirizada",
    )),
    ("impostos", (
        "imposto", "tributo", "icms", "iss", "irpj", "csll", "pis", "cofins",
        "simples nacional", "darf", "taxa", "multa fiscal",
    )),
    ("mercadorias", (
        "mercadoria", "compra", "revenda", "fornecedor", "insumo", "produto", "materia prima",
        "materia-prima", "cmv", "custo da mercadoria",
    )),
)

# Categories of an uploaded row, first group with a hit wins
UPLOAD_CATEGORY_WORDS = (
    ("ENERGIA", (
        "energia eletrica", "energia elétrica", "conta de luz", "cpfl", "enel", "cemig",
        "light", "eletropaulo", "copel", "eletricidade",
    )),
    ("COMBUSTIVEL", (
        "gasolina", "diesel", "etanol", "combustivel", "combustível", "posto",
        "abastecimento", "alcool", "álcool",
    )),
    ("ALUGUEL", ("aluguel", "locacao", "locação", "rent")),
    ("SALARIOS", (
        "salario", "salário", "folha de pagamento", "pro labore", "pró labore", "ordenados",
        "remuneracao", "remuneração",
    )),
    ("IMPOSTOS", (
        "imposto", "tributo", "icms", "iss", "irpj", "csll", "pis", "cofins",
        "simples nacional", "darf",
    )),
    ("FORNECEDORES", ("fornecedor", "fornecedores", "compra", "aquisicao", "aquisição")),
    ("RECEITAS", (
        "receita", "venda", "faturamento", "servicos prestados", "serviços prestados",
    )),
    ("BANCOS", (
        "banco", "caixa", "conta corrente", "aplicacao financeira", "aplicação financeira",
    )),
    ("DEPRECIACAO", ("depreciacao", "depreciação", "amortizacao", "amortização")),
)
UPLOAD_CATEGORY_DEFAULT = "OUTROS"

# Supplier categories, first group with a hit wins
SUPPLIER_CATEGORY_WORDS = (
    ("Tecnologia / TI", (
        "INFORMATICA", "TECNOLOGIA", "SOFTWARE", "SISTEMAS", "DIGITAL", "COMPUTACAO",
        "TELECOM", "INTERNET", "HOSTING", "CLOUD", "DADOS", "TECH", "ELETRONIC",
    )),
    ("Contabilidade / Jurídico / Consultoria", (
        "CONTABIL", "CONTABILIDADE", "ADVOCACIA", "ADVOGADO", "JURIDIC", "CONSULTORIA",
        "AUDITORIA", "ASSESSORIA CONTABIL", "PERICIA",
    )),
    ("Assinaturas / Publicações / Informação", (
        "EDICOES", "EDITORA", "PUBLICACOES", "REVISTA", "JORNAL", "ASSINATURA",
        "INFORMACOES CADASTRAIS", "BOLETIM",
    )),
    ("Material de Escritório / Papelaria", (
        "PAPELARIA", "ESCRITORIO", "SUPRIMENTOS", "GRAFICA", "IMPRESSOS",
    )),
    ("Logística / Transporte", (
        "TRANSPORTE", "LOGISTICA", "FRETE", "ENTREGA", "CARGO", "EXPRESS", "COURIER",
        "MOTOBOY",
    )),
    ("Alimentação", (
        "ALIMENTOS", "ALIMENTICIA", "REFEICOES", "RESTAURANTE", "LANCHONETE", "PADARIA",
        "DISTRIBUIDORA DE ALIMENTOS",
    )),
    ("Construção / Manutenção / Engenharia", (
        "CONSTRUCAO", "ENGENHARIA", "REFORMA", "MANUTENCAO", "ELETRICA", "HIDRAULICA",
        "PREDIAL", "ARQUITETURA",
    )),
    ("Marketing / Publicidade", (
        "MARKETING", "PUBLICIDADE", "PROPAGANDA", "COMUNICACAO", "AGENCIA", "DESIGN",
    )),
    ("Saúde / Segurança do Trabalho", (
        "SAUDE", "MEDICIN", "SEGURANCA DO TRABALHO", "CLINICA", "LABORATORIO", "ODONTO",
    )),
    ("Energia / Utilidades", (
        "ENERGIA", "ELETRICIDADE", "SANEAMENTO", "AGUA E ESGOTO", "GAS",
    )),
    ("Serviços Gerais / Terceirizados", (
        "SERVICOS GERAIS", "LIMPEZA", "VIGILANCIA", "SEGURANCA PATRIMONIAL", "TERCEIRIZ",
    )),
)
PERSON_CATEGORY = "Prestador Pessoa Física / Autônomo"
SUPPLIER_CATEGORY_DEFAULT = "Outros / Não classificado"
PERSON_PATTERN = r"^\d{5,}\s+[A-ZÀ-Ü][A-ZÀ-Ü\s]+$"

# Words that end the supplier section of a chart of accounts
SECTION_END_WORDS = (
    "ATIVO", "PASSIVO", "PATRIMONIO", "PATRIMÔNIO", "RECEITA", "RECEITAS", "DESPESA",
    "DESPESAS", "CUSTO", "CUSTOS", "RESULTADO", "CIRCULANTE", "DISPONIVEL", "DISPONÍVEL",
    "ESTOQUE", "IMOBILIZADO", "INTANGIVEL", "INTANGÍVEL", "TRIBUTOS", "IMPOSTOS",
    "EMPRESTIMO", "EMPRÉSTIMO", "FINANCIAMENTO", "PROVISAO", "PROVISÃO", "LUCRO", "PREJUIZO",
    "PREJUÍZO", "CAPITAL SOCIAL", "RESERVA", "OBRIGACOES TRIBUTARIAS",
    "OBRIGAÇÕES TRIBUTÁRIAS", "SALARIOS", "SALÁRIOS", "ENCARGOS",
)
SECTION_WORD = "FORNECEDOR"

# Revenue or expense decision on a leaf account
STOCK_ROLLOVER_WORDS = ("estoque inicial", "estoque final")
EXPENSE_WORDS = ("despesa", "custo", "cpv", "cmv")
REVENUE_PATTERN = r"(?U)\b(?:receita|venda|faturamento|servicos? prestados?)"
REDUCER_PREFIX = "(-)"
PAYABLE_WORD = "fornecedor"

# Tolerances in cents
ACCOUNT_TOLERANCE_CENTS = 1
IDENTITY_TOLERANCE_CENTS = 100

# --------------------------------------------------------------------------
# Account terms of each indicator; a zero falls to the next set
# --------------------------------------------------------------------------
INDICATOR_TERMS = {
    "ativo_circulante": (("ATIVO", "CIRCULANTE"),),
    "passivo_circulante": (("PASSIVO", "CIRCULANTE"),),
    "caixa": (("CAIXA", "GERAL"), ("DISPONIVEL",), ("DISPONÍVEL",)),
    "estoque": (("ESTOQUE",),),
    "patrimonio_liquido": (("PATRIMONIO", "LIQUIDO"), ("PATRIMÔNIO", "LÍQUIDO")),
    "receita_bruta": (("RECEITA", "BRUTA"), ("RECEITA", "PRESTACAO"), ("RECEITA", "PRESTAÇÃO")),
    "resultado_liquido": (
        ("RESULTADO", "LIQUIDO", "PERIODO"), ("RESULTADO", "LÍQUIDO", "PERÍODO"),
        ("RESULTADO", "BRUTO"),
    ),
}

# --------------------------------------------------------------------------
# Patterns of extracted text
# --------------------------------------------------------------------------
BR_NUMBER = r"\d[\d.]*,\d{2}"
BR_NUMBER_GROUPED = r"\d{1,3}(?:\.\d{3})*,\d{2}"
PERIOD_PATTERN = r"(\d{2}/\d{2}/\d{4})\s*-\s*(\d{2}/\d{2}/\d{4})"
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
MONEY_PATTERN = (
    r"(?i)^\s*(?:R\$\s*)?(?:\()?-?"
    r"(\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d+(?:,\d{2})?|\d+(?:\.\d{2})?)"
    r"-?\)?\s*[DCdc]?\s*$"
)
NATURE_PATTERN = r"\d\s*([DC])\s*$"
DOCUMENT_TYPE_PATTERNS = (
    ("BALANCETE", r"\bBALANCETE\b"),
    ("BALANCO_PATRIMONIAL", r"\bBALAN[ÇC]O\s+PATRIMONIAL\b"),
    ("DRE", r"\bDEMONSTRA[ÇC][AÃ]O\s+DO\s+RESULTADO\b|\bDRE\b"),
    ("LIVRO_RAZAO", r"\bLIVRO\s+RAZ[AÃ]O\b"),
    ("LIVRO_DIARIO", r"\bLIVRO\s+DI[AÁ]RIO\b"),
)
UNKNOWN_DOCUMENT = "DESCONHECIDO"
HEADER_PATTERNS = {
    "empresa": r"(?:empresa|raz[aã]o\s+social)\s*[:\-]?\s*(.+?)(?:\n|cnpj|$)",
    "cnpj": r"\b(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{14})\b",
    "periodo": r"(?:per[ií]odo|compet[eê]ncia|refer[eê]ncia)\s*[:\-]?\s*(.+?)(?:\n|$)",
    "data_emissao": r"(?:data\s+(?:de\s+)?emiss[aã]o|emitido\s+em)\s*[:\-]?\s*(\d{2}/\d{2}/\d{4})",
    "numero_livro": r"(?:livro|n[ºo]\.?\s+livro)\s*[:\-]?\s*(\d+)",
    "folha": r"(?:folha|fl\.?)\s*[:\-]?\s*(\d+)",
    "sistema_emissor": r"(?:sistema|software|gerado\s+por)\s*[:\-]?\s*(.+?)(?:\n|$)",
}
SUPPLIER_HEADER_PATTERNS = {
    "nome": r"Empresa:\s*(.+?)\s+(?:Folha:|C\.N\.P\.J\.|$)",
    "cnpj": r"C\.N\.P\.J\.:\s*([\d./-]+)",
    "periodo": r"Per[íi]odo:\s*(\d{2}/\d{2}/\d{4})\s*-\s*(\d{2}/\d{2}/\d{4})",
}
MIN_TEXT_CHARS = 20
MAX_FILE_BYTES = 50 * 1024 * 1024
ACCEPTED_EXTENSIONS = ("csv", "pdf", "xlsx")

# --------------------------------------------------------------------------
# Columns of uploaded tables
# --------------------------------------------------------------------------
STANDARD_ACCOUNT_COLUMNS = (
    "codigo", "descricao", "saldo_anterior", "debito", "credito", "saldo_atual", "natureza",
)
COLUMN_ALIASES = {
    "codigo": ("codigo", "código", "cod", "cod.", "cod conta", "cod. conta"),
    "descricao": (
        "descricao", "descrição", "historico", "histórico", "nome", "conta", "conta contabil",
        "conta contábil", "conta descricao", "conta descrição", "titulo", "título",
    ),
    "saldo_anterior": (
        "saldo anterior", "saldo ant", "saldo ant.", "sld anterior", "saldo inicial",
    ),
    "debito": ("debito", "débito", "deb", "deb.", "valor debito", "valor débito"),
    "credito": ("credito", "crédito", "cred", "cred.", "valor credito", "valor crédito"),
    "saldo_atual": (
        "saldo atual", "saldo final", "saldo", "sld atual", "sld final", "saldo final atual",
    ),
    "natureza": ("natureza", "nat", "tipo", "dc", "d/c"),
    "data": ("data", "dt", "dt.", "data lancamento", "data lançamento", "data movimento"),
    "valor": ("valor", "vlr", "vlr.", "montante", "quantia"),
    "categoria": ("categoria", "tipo despesa", "classificacao", "classificação", "grupo"),
}
DATE_COLUMNS = ("data", "data_emissao", "data_lancamento", "data_movimento", "periodo")
MONEY_COLUMNS = (
    "valor", "debito", "credito", "saldo", "saldo_anterior", "saldo_atual", "saldo_final",
)
MONEY_HINTS = ("saldo", "debito", "credito", "valor", "vlr", "montante")
SUPPLIER_COLUMNS = (
    "fornecedor", "fornecedores", "nome_fornecedor", "razao_social", "razão_social",
)
SUPPLIER_ROW_WORDS = ("FORNECEDOR", "FORNECEDORES", "COMPRA", "AQUISICAO", "AQUISIÇÃO")
USELESS_COLUMN_PATTERNS = (r"(?i)^unnamed", r"(?i)^col_\d+$", r"^$")

# Cells of a delimited file that mean a missing value
MISSING_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
