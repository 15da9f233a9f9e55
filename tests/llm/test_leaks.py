import random

import numpy as np

from insumo.llm.leaks import Index, _aligned, leaks, words

WORDS = [a + b + c for a in "bcdfglm" for b in "aeiou" for c in ("ra", "lo", "ti", "su", "ne")]


def setup(seed=1, items=30):
    r = random.Random(seed)
    return r, [(i, [r.choice(WORDS) for _ in range(r.randint(30, 90))]) for i in range(items)]


def brute(item, text):
    ids = {w: k for k, w in enumerate({*item, *text})}
    return _aligned(np.array([ids[w] for w in item]), np.array([ids[w] for w in text])) / len(item)


def test_recall_against_brute_force(spark):
    r, items = setup()
    docs = []
    for d in range(240):
        i, w = r.choice(items)
        n = int(len(w) * r.uniform(0.1, 1.0))
        at = r.randint(0, len(w) - n)
        piece = [x if r.random() > 0.1 else r.choice(WORDS) for x in w[at : at + n]]
        around = ["outro" + r.choice(WORDS) for _ in range(40)]
        text = " ".join(around[:20]) + "\n> " + ", ".join(piece).upper() + ". <b>" + " ".join(around[20:]) + "</b>"
        docs.append((d, text))
    want = {(d, i) for d, t in docs for i, w in items if brute(w, words(t)) >= 0.4}
    got = {(x.doc_id, x.item_id) for x in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, item_text string")).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 50


def test_blocks_and_defined_cases(spark):
    item = "Certo oleiro módesto da aldeia alta embarca 557 lingotes raros ao lado do celeiro vizinho"
    items = spark.createDataFrame([(1, item), (2, None), (3, "!!!"), (4, "só")], "item_id long, item_text string")
    docs = spark.createDataFrame([(1, "x " + item.upper() + " y"), (2, None), (3, ""), (4, item[:44]), (1, "x " + item.upper() + " y"), (5, "lingotes alta oleiro celeiro raros aldeia")], "doc_id long, text string")
    for words_ in (1_000_000, 4):
        assert sorted((r.doc_id, r.item_id) for r in leaks(docs, items, block_words=words_).collect()) == [(1, 1), (4, 1)]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_words():
    assert words("<p>A&nbsp;Ação\n1.5­0</p>") == ["a", "acao", "1", "50"] and words(None) == []
    assert Index([]).tables == []
