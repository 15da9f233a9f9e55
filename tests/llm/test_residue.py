from insumo.llm.residue import residue

GOOD = "A cotação vale por dez dias. O comprador conferiu peça por peça o lote de fixadores, pedido 12.\n"
CASES = {
    "slot": ["Prazo: {{ prazo }}\nContato: %%CONTATO%%", GOOD + "O lote ${prazo} chegou.", GOOD + "Olá <inserir contato>, segue a proposta.", GOOD + "Valor (preencher prazo).", GOOD + "Entrega em $PRAZO$.", "Item {0}", "Unidade: «contato»"],
    "filler": ["insira seu texto. insira seu texto. insira seu texto. insira seu texto.", "Título\nxxxxx\nxxxxx\nxxxxx\nxxxxx", "Conteúdo em breve!", "Lorem ipsum dolor elitum lorem ipsum sitar dolor lorem", GOOD + "\nLorem elitum dolor ipsum sitar elitum dolor lorem ipsum"],
    "message": ["HTTP 404 - Not Found\nMenu Conta", "Ative o JavaScript para continuar!", "Erro 500 Internal Server Error. Contact the administrator.", "Sessão expirada. Faça login novamente.", "Traceback: falha em render linha 3\nNullReference: objeto x indefinido"],
    "blank": ["Prazo: ____\nContato:\nPreço: ...."],
    "": [
        GOOD, "", None, "No modelo de cotação, escreva {{ contato }} onde o prazo deve aparecer; o sistema troca o campo.", '{"codigo": "PX-1", "obs": "entregar na doca"}', "[07:04] ok, fecho\n[1] Medir o furo\n[2] Anotar o valor <3 mm>", "<p>" + GOOD + "</p>",
        "Quando o portal avisa que é preciso ativar o JavaScript, o comprador abre a planilha local e segue a conferência.", "A página não encontrada na semana passada voltou ao ar e a tabela de cabos foi copiada para o histórico.", "O inversor mostrou o erro E-04 na partida e a página 404 do manual pede troca do fusível. " + GOOD,
        "O fornecedor mandou a proposta com texto de exemplo no rodapé e o analista pediu outra versão. " + GOOD, "10 10 10 10 10 10", GOOD * 400,
    ],
}


def test_cases(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in CASES.items() for t in ts)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, kind string")
    got = {(r.doc_id, r.kind) for r in residue(df.select("doc_id", "text", "kind")).collect()}
    assert got == {(i, k) for i, _, k in rows if k}


def test_mentions_excuse_only_the_slots_they_govern(spark):
    unfilled = ["o técnico de campo <%= prazo %> novamente o preço", "Modelo: {{prazo}}", "<%= prazo %> técnico de campo devolveu a nota.", "O técnico de campo mandou a unidade sem ${prazo} o pedido.", "No modelo, escreva {{prazo}} aqui, e envie ao técnico de campo até {{contato}}.", "o técnico de campo «prazo» recebeu"]
    spoken = ["No modelo de cotação, escreva ${prazo} onde o prazo deve aparecer;", "No modelo de cotação, escreva o prazo como {{prazo}} e salve.", "O sistema troca o campo {{prazo}} pelo valor.", "A variável %%prazo%% é trocada.", "Write {{prazo}} or {{contato}} in the mail.", "{{prazo}} é um marcador."]
    df = spark.createDataFrame(list(enumerate(unfilled + spoken)), "doc_id long, text string")
    assert {r.doc_id for r in residue(df).filter("kind = 'slot'").collect()} == set(range(len(unfilled)))


FILLED = ["Prezado João Silva, segue a proposta.", "Prezado Otávio, segue a proposta.", "Prezado Comprador, segue a proposta.", "Veja o pedido 12 para Campinas.", "Veja o pedido 9 para Santos.", "Veja o pedido AB para Vitória."]
MENU = "\n" + " ".join(["Início Produtos Cabos Válvulas Tubos Contato Carrinho Conta Entrar Ajuda"] * 6)


def test_aligned_records_show_names_and_blanks_in_their_slots(spark):
    kept = ["Prezado [NOME DO CLIENTE], segue a proposta.", "Veja o pedido NUM_PEDIDO para CIDADE.", "Veja o pedido  para ."]
    other = ["Visto [NA DOCA] pelo turno.", "O lote TIPO_X ficou na doca.", "Cabo  azul  de  seis  metros  para  o  pedido", "Total  UN  R$ 12 ."]
    df = spark.createDataFrame(list(enumerate(kept + FILLED + other)), "doc_id long, text string")
    assert sorted((r.doc_id, r.kind) for r in residue(df).collect()) == [(0, "slot"), (1, "slot"), (2, "blank")]


def test_message_pages_of_any_length(spark):
    prose = " ".join([GOOD.strip()] * 3)
    texts = ["Erro 404. Página não encontrada." + MENU, "Acesso negado. " + prose, prose + " Ontem a página não foi encontrada no portal e o comprador ligou."]
    long = ["Falha 0x%x ao abrir %d. " % (i, i) + "Tente de novo. " * 2 + "Volte ao menu. Conta. Carrinho. Ajuda. Produtos de hoje. Ofertas da semana. Cabos. Tubos. Chapas lisas. Graxas. Tintas. Motores. Luvas. Veja mais. Fale conosco. Siga-nos. Mapa." for i in range(3)]
    df = spark.createDataFrame(list(enumerate(texts + long)), "doc_id long, text string")
    assert sorted((r.doc_id, r.kind) for r in residue(df).collect()) == [(0, "message"), (3, "message"), (4, "message"), (5, "message")]


def test_empty(spark):
    assert residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0
