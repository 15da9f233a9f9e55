import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from insumo.operators import audit, features, ingest, resolve, search, suppress
from insumo.sources import catalog, html, store, workbook


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_document_to_tables(spark, tmp_path):
    doc = {"revision": 1, "suppliers": [{"id": "s", "name": " Atlas  Ltda", "aliases": ["A"]}], "products": [{"id": "p", "code": "C1", "name": "Chapa Inox", "unit": "", "specs": [{"label": "Liga", "value": "316"}], "supplierLinks": [{"supplierId": "s", "name": "Atlas", "kind": "quoted", "source": "x"}] * 2, "offers": [{"id": "o", "finalPrice": "1.234,50", "updatedAt": "2026-01-01"}, {"id": "o", "finalPrice": 7, "divisor": 2}]}, {"id": "q"}]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc))
    d = catalog.read_document(spark, str(path))
    assert rows(catalog.products(d), "id", "unit", "offer_count") == [("p", "un", 2), ("q", "un", 0)]
    assert rows(catalog.offers(d), "id", "final_price", "quantity") == [("o", 7.0, 2.0)]
    assert catalog.links(d).count() == 1 and rows(catalog.suppliers(d), "name_norm") == [("atlas ltda",)]
    old = spark.createDataFrame([("p", "C1", "Chapa Inox"), ("r", "c1", "chapa  inox"), ("t", "C9", "Tubo")], "id string, code string, name string")
    assert rows(catalog.migrated(old, catalog.products(d)), "id") == [("p",), ("q",), ("t",)]


def test_store_conflict_restore_retention(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    df = lambda n: spark.range(n)
    assert s.save({"a": df(2)}, 0)["current_revision"] == 1
    assert s.save({"a": df(3)}, 0)["conflict"] and s.save({"a": df(3)}, 1)["ok"]
    assert s.load("a").count() == 3 and s.restore(1)["current_revision"] == 3 and s.load("a").count() == 2
    assert s.retain(1) == 2 and [r.revision for r in s.versions().collect()] == [3] and s.load("a").count() == 2


def test_changes_and_keyed_writes(spark):
    a = spark.createDataFrame([("1", "x", 1), ("2", "y", 2)], "id string, name string, n int")
    b = store.replaced(a, spark.createDataFrame([("2", "z", 2)], a.schema), ["id"])
    assert rows(store.changes(a, b, "id", ["name", "n"]), "id", "field", "before", "after") == [("2", "name", "y", "z")]
    assert store.added(b, b, ["id"]).count() == 2 and store.without(b, a.filter("id = '1'"), ["id"]).count() == 1


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("á & b", 1.5), (None, 2.0)], "Nome string, `Preço` double")
    workbook.write_workbook(str(tmp_path / "w.xlsx"), {"Plan/1": df, "Plan 1": df.limit(0)})
    assert zipfile.is_zipfile(tmp_path / "w.xlsx")
    got = workbook.workbooks(spark, str(tmp_path))
    assert rows(got.filter("sheet = 'Plan 1'").select("row_idx", F.to_json("cells").alias("c")), "row_idx", "c") == [(0, '["Nome","Preço"]'), (1, '["á & b","1.5"]'), (2, '[null,"2.0"]')]
    assert workbook.sheet_names(["a" * 40, "A" * 40, ""]) == ["a" * 31, "A" * 29 + "_2", "Sheet"] and workbook.column_index("AA7") == 26


def test_headings_inference_and_import(spark):
    cells = [["x", None, None, None, None], ["Código", "Descrição", "Preço", "Fornecedor", "Data"], ["C1", "Parafuso sextavado inox M8", "1,84", "Atlas", "20/06/2026"], ["C1", "Parafuso sextavado inox M8", "2,00", "Atlas", "01/07/2026"], [None, "Porca sextavada M8", "0,50", "Nova", "01/07/2026"], [None, "Total", "100", None, None], ["X1", "Chapa 2 mm", "0", None, "01/07/2026"], [None, "Tubo", "10", None, "31/02/2026"]]
    sheet = spark.createDataFrame([("Plan1", i, c) for i, c in enumerate(cells)], "sheet string, row_idx int, cells array<string>")
    heads = ingest.headings(sheet)
    assert rows(heads, "header_row", "role", "col_idx") == [(1, "base_price", 2), (1, "code", 0), (1, "date", 4), (1, "name", 1), (1, "supplier", 3)]
    assert ("name", 1) in rows(ingest.inferred_columns(sheet.filter("row_idx > 1")), "role", "col_idx")
    products = spark.createDataFrame([("p", "C1", "Parafuso sextavado inox M8")], "id string, code string, name string")
    events = spark.createDataFrame([("p", 1.84, "2026-06-20")], "product_id string, final_price double, updated_at string")
    got = ingest.preview(ingest.table_rows(sheet, heads), products, events)
    assert rows(got, "row_idx", "outcome") == [(2, "unchanged"), (3, "update"), (4, "newProduct"), (5, "newProduct"), (6, "skipped"), (7, "skipped")]


def test_invoice_and_lines(spark):
    xml = '<nfe xmlns="http://x"><ide><dhEmi>2026-01-02T10:00:00</dhEmi></ide><emit><xNome>Atlas</xNome><CNPJ>1</CNPJ></emit><det><prod><cProd>A</cProd><xProd>Cabo</xProd><qCom>2,0</qCom><vUnCom>3.5</vUnCom></prod></det><det><prod><cProd>B</cProd><cEAN>4006381333931</cEAN><xProd>Tubo</xProd><vProd>9</vProd></prod></det></nfe>'
    got = ingest.nfe_items(spark.createDataFrame([("1", xml)], "id string, xml string"))
    assert rows(got, "code", "gtin", "quantity", "total", "supplier") == [("A", "", 2.0, 7.0, "Atlas"), ("B", "4006381333931", 1.0, 9.0, "Atlas")]
    t = spark.createDataFrame([(1, "5 un do cabo flexivel por R$ 4,50 do fornecedor Alfa\nnão comprar 3 un tubo\n")], "k int, text string")
    assert rows(ingest.typed_lines(t, "k"), "quantity", "price", "supplier", "description") == [(5.0, 4.5, "Alfa", "cabo flexivel")]


def test_page(spark):
    page = '<title>x</title><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Chapa Inox 316L 2 x 1 m","mpn":"CH316","gtin13":"4006381333931","brand":{"name":"Atlas"},"offers":{"price":"894,50","seller":{"name":"Loja X"}}}]}</script>'
    df = spark.createDataFrame([(1, "https://loja.example/p", page), (2, "u", "<title>Só título</title>"), (3, "u", None)], "page_id long, url string, html string")
    r = {x.page_id: x for x in html.extracted(df).collect()}
    assert (r[1].kind, r[1].manufacturer, r[1].product_line, r[1].code, r[1].gtin, r[1].price, r[1].seller, r[1].source_kind) == ("chapa", "", "Atlas", "CH316", "4006381333931", 894.5, "Loja X", "retailer")
    assert [tuple(s) for s in r[1].specs] == [("Material", "Aço inoxidável"), ("Liga", "316L"), ("Comprimento", "2 m"), ("Largura", "1 m")]
    assert set(r) == {1, 2} and r[2].name == "Só título" and not r[2].structured


@pytest.mark.parametrize("text, want", [("Chapa 2 x 1 m", [2000.0, 1000.0]), ("M8 x 30 mm", [30.0]), ('1/2" e 12,7 mm', [12.7]), ("inox 304", [])])
def test_dimensions(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(features.dimensions(F.col("t")).alias("d")).first().d
    assert [x.value_mm for x in got] == want


def test_match_score(spark):
    q = spark.createDataFrame([("q", "chapa inox 316"), ("t", "tubo inox")], "qid string, text string")
    c = spark.createDataFrame([("a", "Chapa Inox 316L"), ("b", "Porca latão")], "id string, name string")
    assert rows(features.matches(q, c), "qid", "id", "score", "confidence") == [("q", "a", 92, "alta")]


def test_matches_lose_none(spark):
    import random

    r = random.Random(5)
    text = lambda: f"{r.choice(['Chapa', 'Tubo', 'Peça', ''])} {r.choice(['inox', 'pvc', 'aluminio', ''])} {r.choice(['304', '304L', '316', ''])} {r.choice(['lisa', 'fina', 'azul'])} {r.choice(['2 mm', '3 x 4 m', ''])} {r.choice(['alfa', 'beta', 'gama'])}"
    q = spark.createDataFrame([(f"q{i:02}", text()) for i in range(40)], "qid string, text string")
    c = spark.createDataFrame([(f"c{i:02}", text(), r.choice(["", "2 mm", "inox 316"]), r.choice(["", "", "chapa"]), r.random() < 0.3) for i in range(60)], "id string, name string, more string, kind string, preferred boolean")
    got = {(x.qid, x.id): x.score for x in features.matches(q, c, n=1000).collect()}
    cols = ["kind", "material", "alloys", "tokens", "dims"]
    dq, dc = features.described(q, "text").select("qid", F.struct(*cols).alias("q")), features.described(c.withColumnRenamed("kind", "_k"), "name", F.col("more"), F.col("_k")).select("id", F.struct(*cols).alias("c"))
    every = dq.crossJoin(dc).select("qid", "id", features.match_score("q", "c").alias("score")).filter("score >= 45").collect()
    assert got == {(x.qid, x.id): x.score for x in every} and len(got) > 100
    five = features.matches(q, c).collect()
    order = {x.id: not x.preferred for x in c.collect()}
    assert sorted((x.qid, x.rank_no, x.id) for x in five) == sorted((k, i + 1, x[2]) for k in {a for a, _ in got} for i, x in enumerate(sorted((-s, order[b], b) for (a, b), s in got.items() if a == k)[:5]))


def test_new_codes_are_new(spark):
    p = spark.createDataFrame([("1", "AB-005", "F1"), ("2", "", "F1"), ("3", "ab 5", "F2"), ("4", None, "F2"), ("5", "AB-006", "F3"), ("6", " ", "F3"), ("7", "", "F4")], "id string, code string, family string")
    assert rows(audit.numbered(p), "id", "new_code") == [("2", "AB-007"), ("4", "AB-008"), ("6", "AB-009"), ("7", "F4-001")]


def test_duplicate_suppliers(spark):
    s = spark.createDataFrame([("1", "Ferro Norte", "a@x", "1"), ("2", "Ferro Norte Central", None, None), ("3", "Metal Sul Ltda", "A@x ", "22"), ("4", "METAL SUL ME", "", "2-2"), ("5", None, None, None)], "id string, name string, email string, phone string")
    assert rows(resolve.bigram_pairs(s), "id_a", "id_b", "score") == [("1", "2", 56), ("3", "4", 100)]
    assert rows(resolve.ratio_pairs(s), "id_a", "id_b", "score") == [("3", "4", 100)]
    assert rows(resolve.contact_pairs(s), "id_a", "id_b", "reason") == [("1", "3", "1-email"), ("3", "4", "2-phone")]


def test_contact_pairs_of_a_hot_address_are_whole(spark):
    ids = [f"{i:03}" for i in range(60)]
    s = spark.createDataFrame([(i, None, "office@x", None) for i in ids] + [(f"p{i}", None, None, "55 11 4002-8922") for i in ids], "id string, name string, email string, phone string")
    want = [("000", b, "1-email") for b in ids[1:]] + [("p000", f"p{b}", "2-phone") for b in ids[1:]]
    assert rows(resolve.contact_pairs(s), "id_a", "id_b", "reason") == want


def test_near_codes_lose_nothing(spark):
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(4)
    codes = sorted({"".join(r.choice("ab-1") for _ in range(r.randint(1, 9))) for _ in range(120)} | {"cb-jdd59-03", "cbjdd59-03"})
    want = [(a, b, d) for i, a in enumerate(codes) for b in codes[i + 1 :] if (d := edits(a, b)) <= 2]
    assert rows(resolve.near_codes(spark.createDataFrame([(c,) for c in codes], "code string")), "code_a", "code_b", "d") == want and ("cb-jdd59-03", "cbjdd59-03", 1) in want


def test_ratio_pairs_lose_nothing(spark):
    import difflib
    import random

    r = random.Random(3)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(6, 14))) for _ in range(70)})
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if round(100 * difflib.SequenceMatcher(None, a, b).ratio()) >= 88}
    got = resolve.ratio_pairs(spark.createDataFrame([(n, n) for n in names], "id string, name string"))
    assert {(x.id_a, x.id_b) for x in got.collect()} == want and want


def test_ratio_pairs_of_short_keys_lose_nothing(spark):
    import difflib
    import itertools

    names = ["abxcd", "xabcd", *("".join(x) for n in (4, 5) for x in itertools.product("bdf", repeat=n)), "abcd"]
    names = sorted(set(names))
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if round(100 * difflib.SequenceMatcher(None, a, b).ratio()) >= 88}
    got = resolve.ratio_pairs(spark.createDataFrame([(n, n) for n in names], "id string, name string"))
    assert {(x.id_a, x.id_b) for x in got.collect()} == want and ("abcd", "abxcd") in want


def test_suppression(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("k", t + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 1, 2, 3))] + [("k2", t, 9), (None, t, 8)], "k string, at timestamp, id int")
    assert rows(suppress.suppress(e, "k", "at", "id", 2.5), "id") == [(0,), (3,), (9,)]


def test_search(spark):
    p = spark.createDataFrame([("1", "Chapa inox 316", "C-1", False), ("2", "Parafuso inox", "C-2", False), ("3", "Chapa inox 316 velha", "C-3", True)], "id string, name string, code string, archived boolean")
    p = p.selectExpr("*", "'' family", "'' subcategory", "'' manufacturer", "null aliases_json", "'[]' external_codes_json", "'[{\"label\":\"L\",\"value\":\"1/4\"}]' specs_json", "1 offer_count")
    got = search.search(p, "chapa inox 316").collect()
    assert [r.id for r in got] == ["1", "2"] and search.search(p, "").count() == 0 and rows(search.search(p, '1/4"'), "id") == [("1",), ("2",)]
    assert rows(search.like(p, "c-9"), "id") == [] and rows(search.like(p, "c-2"), "id") == [("2",)] and rows(search.like(p, "C-2"), "id") == [("2",)]
    assert rows(search.staged(p, "c-1"), "id", "stage") == [("1", 1)] and rows(search.simple_rank(p, "cha"), "id") == [("1",)]
    w = spark.createDataFrame([("https://aco.example/a", "Chapa inox", "x"), ("https://github.com/a", "Chapa inox", "x"), ("https://b.example", "", "x")], "url string, title string, snippet string")
    assert [r.url for r in search.web_rank(w, "chapa inox").collect()] == ["https://aco.example/a"]


def test_merge_targets_of_many_equal_names(spark):
    s = spark.createDataFrame([(f"{i:04}", "Metal Sul") for i in range(3000)] + [("a1", "Metal Sul Central"), ("a0", "Outra Casa")], "id string, name string")
    got = {r.old: r.new for r in resolve.bigram_targets(s).collect()}
    assert got == {**{f"{i:04}": "0000" for i in range(1, 3000)}, "a1": "0000"}


def test_bigram_pairs_equal_all_pairs(spark):
    import random

    r = random.Random(6)
    names = sorted({f"{r.choice(['abrasivos ', 'abrasivos x', ''])}{''.join(r.choice('ab') + r.choice('oi') for _ in range(r.randint(2, 6)))}" for _ in range(150)} | {"abrasivos"})
    grams = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    share = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    solid = {n: n.replace(" ", "") for n in names}
    for least in (0.6, 0.86):
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if share(solid[a], solid[b]) >= least or b.startswith(a) and len(a) >= 7}
        got = resolve.bigram_pairs(spark.createDataFrame([(n, n) for n in names if len(n) >= 4], "id string, name string"), least)
        assert {(x.id_a, x.id_b) for x in got.collect()} == want and want


def test_common_first_words_are_no_candidates(spark):
    import itertools

    names = ["abrasivos " + "".join(x) for x in itertools.product(["ba", "ce", "di", "fo", "gu", "mar"], ["lu", "mi", "nor", "pe"], ["ra", "sol", "te", "vi"])]
    keys = spark.createDataFrame([(n,) for n in names], "key string").selectExpr("key", "length(key) n")
    assert resolve.begun_pairs(keys.select("key"), 7).count() == 0
    sets = resolve.gram_sets(resolve.ordered_grams(keys), F.col("n") - 8, 2).groupBy("x").count().selectExpr("sum(count * (count - 1) / 2) p").first().p
    assert sets < 3 * len(names) * (len(names) - 1) / 2


def test_contact_slips_lose_nothing(spark):
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(8)
    base = ["".join(r.choice("abc") for _ in range(r.randint(7, 14))) for _ in range(40)] + ["aaaaaaaaaaaa", "abababababab"]
    slip = lambda x: (lambda i: x[:i] + r.choice(["", "z", x[i] + "q"]) + x[i + 1 :])(r.randrange(len(x)))
    names = sorted({*base, *(slip(x) for x in base), *(slip(slip(x)) for x in base)})
    got = resolve.contact_pairs(spark.createDataFrame([(n, n, None, None) for n in names], "id string, name string, email string, phone string"))
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if abs(len(a) - len(b)) <= 1 and edits(a, b) <= 2}
    assert {(x.id_a, x.id_b) for x in got.collect()} == want and want


def test_forms_of_codes_are_not_broadcast(spark):
    codes = spark.createDataFrame([(f"cb-{i:05}-03",) for i in range(50)], "code string")
    assert "BroadcastHashJoin" not in resolve.near_codes(codes)._jdf.queryExecution().executedPlan().toString()


def test_import_of_a_hot_product(spark):
    n = 1500
    r = spark.range(n).selectExpr("'s' sheet", "cast(id as int) row_idx", "'C1' code", "'Parafuso M8' name", "cast(null as string) base_price", "cast(1000 + id as string) final_price", "'' supplier", "if(id % 2 = 0, '', '20/06/2026') date", "'' ipi", "'' adjustment", "'' quantity")
    events = spark.range(n).selectExpr("'p' product_id", "1000.0 + id + if(id % 3 = 0, 0.0049, if(id % 3 = 1, -0.0049, 0.006)) final_price", "'2026-06-20' updated_at")
    products = spark.createDataFrame([("p", "C1", "Parafuso M8")], "id string, code string, name string")
    got = ingest.preview(r, products, events)
    assert {(x.outcome, x.n) for x in ingest.import_stats(got).collect()} == {("unchanged", 1000), ("update", 500)}
    # rows and offers of one product don't all meet
    assert "step#" in got._jdf.queryExecution().optimizedPlan().toString()
