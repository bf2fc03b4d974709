import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerloom.operators.layouts import KNOWN_LAYOUTS
from ledgerloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 8, checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


FIELDS = {layout.name: layout.groups for layout in KNOWN_LAYOUTS}
# What stands before each field on a line; all other fields follow without a gap.
GAPS = {
    "reverso": {"descricao": " "},
    "natural": {"descricao": " ", "anterior": "  ", "debito": "  ", "credito": "  ", "atual": "  "},
    "classificado": {"classificacao": " ", "atual": " ", "debito": " ", "credito": " "},
}


def money(cents):
    whole, rest = divmod(cents, 100)
    groups = []
    while whole >= 1000:
        whole, last = divmod(whole, 1000)
        groups.insert(0, f"{last:03d}")
    return ".".join([str(whole), *groups]) + f",{rest:02d}"


def account(layout, **cells):
    """A line of the layout; amounts are cents and 0 where they are not given."""
    text = ""
    for field in FIELDS[layout]:
        cell = cells.get(field, "" if field.startswith("natureza") else 0)
        text += GAPS[layout].get(field, "") + (cell if isinstance(cell, str) else money(cell))
    return text


def moved(layout, code, name, nature, cents, **more):
    """An account that got its whole balance in the period."""
    side = {"debito" if nature == "D" else "credito": cents}
    return account(layout, codigo=str(code), descricao=name, natureza=nature, atual=cents, **side, **more)


PERIOD = "Periodo: 01/01/2025 - 31/12/2025"
# A tailor's shop: 73.450,20 on either side.
SHOP = [
    (1, "ATIVO", "D", 7345020),
    (2, "NUMERARIO EM BANCOS", "D", 6120000),
    (3, "ESTOQUE DE TECIDOS", "D", 1225020),
    (30, "PASSIVO", "C", 2195020),
    (31, "FORNECEDORES", "C", 975020),
    (32, "TECELAGEM AURORA LTDA", "C", 650020),
    (33, "AVIAMENTOS SERRANA EIRELI", "C", 325000),
    (34, "CAPITAL SOCIAL DA LOJA", "C", 1220000),
    (70, "APURACAO DO EXERCICIO", "C", 5150000),
    (71, "RECEITA COM SERVICOS DE COSTURA", "C", 5150000),
]
# A workshop with class codes; the last two accounts do not move, or change their side.
WORKSHOP = [
    ("1", "ATIVO", "D", 240000),
    ("1.1", "DISPONIVEL", "D", 240000),
    ("2", "PASSIVO", "C", 96000),
    ("2.1", "FORNECEDORES", "C", 96000),
    ("2.1.1", "METALURGICA BOREAL LTDA", "C", 96000),
    ("3", "APURACAO", "C", 216000),
    ("3.1", "RECEITA DO PERIODO", "C", 180000),
    ("3.1.1", "VENDA DE PORTOES", "C", 180000),
    ("3.2", "DESPESAS DE OPERACAO", "D", 72000),
    ("3.2.1", "DESPESAS DE ENTREGA", "D", 72000),
    ("3.2.1.1", "FRETE ATE O CLIENTE", "D", 72000),
    ("3.3", "DEDUCOES DA RECEITA", "D", 36000),
    ("3.3.1", "TRIBUTOS DA VENDA", "D", 36000),
    ("3.3.1.1", "(-) ICMS DA VENDA", "D", 36000),
]
WORKSHOP_TEXT = "\n".join(
    [
        PERIOD,
        *[moved("classificado", 500 + i, name, nature, cents, classificacao=cls) for i, (cls, name, nature, cents) in enumerate(WORKSHOP)],
        account("classificado", codigo="590", classificacao="8", descricao="CONTA PARADA", natureza="C", atual=120000, natureza_anterior="C", anterior=120000),
        account("classificado", codigo="591", classificacao="9", descricao="VIROU DE LADO", natureza="D", atual=48000, natureza_anterior="C", anterior=72000, debito=192000, credito=72000),
    ]
)


def shop_text(layout="reverso"):
    return "\n".join([PERIOD, *[moved(layout, *row) for row in SHOP]])
