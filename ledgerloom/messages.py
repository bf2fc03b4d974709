"""Texts of the advice rules. Readers compare them word for word.

``{name}`` marks where a value goes.
"""

# rule number: (priority, subject, title, description)
RULES = {
    1: (
        "Alta", "Risco de Concentração",
        "Dependência crítica de {nome}",
        "Este fornecedor concentra {percentual}% de toda a movimentação com fornecedores no período. "
        "Qualquer problema de preço, prazo ou disponibilidade nessa relação afeta diretamente a operação. "
        "Vale negociar um contrato formal com condições de preço e prazo mais claras, e mapear ao menos um "
        "fornecedor alternativo para essa categoria como plano de contingência.",
    ),
    2: (
        "Média", "Negociação",
        "Alta concentração nos 3 maiores fornecedores",
        "{nomes} respondem juntos por {percentual}% do total movimentado com fornecedores. É uma concentração "
        "saudável de acompanhar de perto: negociações de melhores preços ou prazos com esse grupo têm o maior "
        "impacto financeiro possível por unidade de esforço.",
    ),
    3: (
        "Média", "Risco de Concentração",
        "Índice de concentração de fornecedores elevado (HHI)",
        "O índice Herfindahl-Hirschman da base de fornecedores está em {hhi} pontos (de um máximo de 10.000). "
        "Valores acima de 2.500 indicam uma base pouco diversificada — o mesmo indicador que reguladores usam "
        "para apontar mercados concentrados. Aumentar o número de fornecedores homologados por categoria reduz "
        "o risco de interrupção de suprimento.",
    ),
    4: (
        "Baixa", "Diversificação",
        "Base de fornecedores muito pequena",
        "Foram identificados apenas {quantidade} fornecedor(es) em aberto neste balancete. Uma base tão enxuta é "
        "normal em empresas pequenas, mas aumenta o risco operacional: qualquer atraso ou problema com um deles "
        "pode travar a operação. Vale mapear ao menos um fornecedor alternativo por categoria essencial.",
    ),
    5: (
        "Média", "Negociação",
        "Categoria '{categoria}' domina os gastos",
        "{percentual}% do valor movimentado com fornecedores está concentrado em '{categoria}' ({quantidade} "
        "fornecedor(es)). Vale avaliar contratos anuais ou de volume nessa categoria especificamente, onde o "
        "ganho percentual de uma negociação tem o maior efeito no caixa.",
    ),
    6: (
        "Baixa", "Consolidação",
        "Possível consolidação em '{categoria}'",
        "Há {quantidade} fornecedores nessa mesma categoria ({nomes}), somando {total}. Vale avaliar se faz "
        "sentido concentrar o volume em um único parceiro para negociar desconto por escala, ou se a "
        "pulverização atual é intencional (redundância proposital por segurança de fornecimento).",
    ),
    7: (
        "Alta", "Fluxo de Caixa",
        "Liquidez corrente abaixo de 1,0 — atenção ao caixa",
        "O índice de liquidez corrente está em {liquidez}, ou seja, o ativo circulante não cobre integralmente "
        "as obrigações de curto prazo (incluindo fornecedores). Priorize renegociar prazos com fornecedores e "
        "acelerar o recebimento de clientes antes de assumir novos compromissos.",
    ),
    8: (
        "Baixa", "Fluxo de Caixa",
        "Caixa parado muito acima das obrigações de curto prazo",
        "O caixa disponível ({caixa}) é {razao}x maior que o total a pagar a fornecedores e demais obrigações de "
        "curto prazo ({passivo}). Depois de reservar um colchão de segurança, o excedente parado no caixa "
        "poderia render em uma aplicação de baixo risco (CDB, Tesouro Selic) ou ser reinvestido no negócio.",
    ),
    9: (
        "Alta", "Fluxo de Caixa",
        "Capital de giro negativo",
        "O capital de giro está negativo em {capital} (ativo circulante menor que o passivo circulante). Esse é "
        "um sinal de alerta financeiro que costuma preceder dificuldades para pagar fornecedores em dia — vale "
        "revisar o ciclo financeiro (prazo de recebimento vs. prazo de pagamento) com prioridade.",
    ),
    10: (
        "Baixa", "Alerta de Dados",
        "Margem líquida aparente muito alta — validar despesas",
        "O resultado do período equivale a {margem}% da receita bruta. Isso costuma indicar que este balancete "
        "não tem uma conta de Despesas detalhada (comum em empresas que lançam custos de forma simplificada) — "
        "ou seja, a margem real provavelmente é menor. Vale conferir com o contador se há despesas operacionais "
        "não classificadas separadamente.",
    ),
    11: (
        "Média", "Rentabilidade",
        "Margem líquida baixa",
        "O resultado do período representa apenas {margem}% da receita bruta. Vale revisar tanto o custo dos "
        "fornecedores quanto a política de preços praticada.",
    ),
    12: (
        "Baixa", "Alerta de Dados",
        "Nenhum fornecedor em aberto neste período",
        "Não foi identificada nenhuma conta de fornecedores com saldo no balancete analisado. Isso pode "
        "significar que a empresa pagou tudo à vista no período (sem saldo em aberto no encerramento), ou que o "
        "plano de contas usa um nome diferente de 'Fornecedores' para essas obrigações.",
    ),
    13: (
        "Baixa", "Boas Práticas",
        "Boas práticas recorrentes de gestão de fornecedores",
        "Independente da situação atual, três hábitos costumam trazer retorno consistente: (1) renegociar prazos "
        "e condições anualmente, mesmo com fornecedores satisfatórios; (2) sempre cotar com pelo menos 2 "
        "fornecedores antes de compras relevantes; (3) revisar trimestralmente esta mesma análise para "
        "acompanhar tendências de concentração e custo ao longo do tempo.",
    ),
    14: (
        "Baixa", "Variação de Período",
        "Novo fornecedor: {nome}",
        "Passou a movimentar {atual} neste período, sem histórico no período anterior. Vale confirmar se há "
        "contrato/condições formalizadas.",
    ),
    15: (
        "Média", "Variação de Período",
        "Alta de {percentual}% em {nome}",
        "A movimentação com este fornecedor saltou de {anterior} para {atual}. Vale entender se foi aumento de "
        "preço, de volume comprado, ou reclassificação contábil — e se o aumento é sustentável.",
    ),
    16: (
        "Baixa", "Variação de Período",
        "Queda de {percentual}% em {nome}",
        "A movimentação caiu de {anterior} para {atual}. Se não foi uma decisão deliberada, vale confirmar se o "
        "fornecimento continua ativo e nas condições esperadas.",
    ),
}

PRIORITY_ORDER = {"Alta": 0, "Média": 1, "Baixa": 2}

# What stands for the names in rule 6; the names are rows, in any number
NAMES_ELSEWHERE = "nomes na lista de fornecedores da categoria"
