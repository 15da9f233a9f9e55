import pytest
from pyspark.sql import functions as F

from insumo.llm import parties
from insumo.sources.shared import RELEASE


@pytest.mark.parametrize("name, want", [("Abrasivos Cacife Secume ME", "cacife secume"), ("TosebiDucigo - Mat. Elétr. - Filial 2", "ducigo tosebi"), ("Sr(a). Toninho FipunolGifusi", "fipunol gifusi"), ("Legacan Napifu - Ferragens - Lagoa Funda Nova", "legacan napifu"), ("Parаfusos Mesunan Bepati EPP", "bepati mesunan"), ("Grupo Decusofe", "decusofe"), ("LTDA", None), ("", None), (None, None)])
def test_core(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(parties.core(F.col("n")).alias("c")).first().c == want


def pairs(spark, suppliers, offers):
    s = spark.createDataFrame(suppliers, "id string, name string, aliases_json string, extra int")
    o = spark.createDataFrame(offers, "id string, name string")
    return {(r.key_a, r.key_b) for r in parties.same_party_pairs(s, o).collect()}


def test_variants_and_partly_equal_names(spark):
    suppliers = [("s1", "Abrasivos Migifo Bulabu S/A", '["Grupo Migilabu"]', 1), ("s2", "MIGIFO BULABU (ABRAS.)", None, 1), ("s3", "Abrasivos Migifo Caludu", "[]", 1), ("s4", "Bulabu Migiifo Abrasivos & Cia", "", 1), ("s5", None, None, 1), ("s6", "Tubos Dorilo Sanepa", "x", 1)]
    offers = [("o1", "MigiBulabu"), ("o2", "migilabu"), ("o3", "Zuteco Rafimo"), ("o4", None), ("o5", "caludu migifo ltda"), ("o6", "Dori- Sanepa")]
    got = pairs(spark, suppliers, offers)
    same = {("s1", "s2"), ("s1", "s4"), ("s2", "s4")} | {(o, s) for o in ("o1", "o2") for s in ("s1", "s2", "s4")} | {("o5", "s3"), ("o6", "s6")}
    assert got == same


def test_join_against_brute_force(spark):
    import itertools
    import math
    import random

    r = random.Random(2)
    names = sorted({" ".join(sorted("".join(r.choice("bcdf") + r.choice("aeo") for _ in range(3)) for _ in range(2))) for _ in range(120)})
    grams = {n: {x for w in n.split() for x in ["=" + w, *(w[i : i + k] for k in parties.GRAMS for i in range(len(w) - k + 1))]} for n in names}
    df = {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    w2 = {x: round(math.log((len(names) + 1) / n) ** 2 * 256) for x, n in df.items()}
    norm = {n: math.sqrt(sum(w2[x] for x in g)) for n, g in grams.items()}
    cos = {(a, b): sum(w2[x] for x in grams[a] & grams[b]) / norm[a] / norm[b] for a, b in itertools.combinations(names, 2)}
    want = {p for p, c in cos.items() if c >= 0.35}
    got = {(x.a, x.b): x.cosine for x in parties.links(spark.createDataFrame([(n,) for n in names], "core string"), 0.35).collect()}
    assert want and want <= set(got) and all(got[p] >= cos[p] - 1e-6 for p in want)


def test_average_linkage_and_components(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.95)], "a string, b string, cosine double")
    c = spark.createDataFrame([(x, x) for x in "abcde"], "core string, party string")
    got = {}
    for r in parties.average_linkage(c, e, 0.6, 0.0).collect():
        got.setdefault(r.party, set()).add(r.core)
    assert sorted(map(sorted, got.values())) == [["a", "b"], ["c", "d"], ["e"]]
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y")], "x string, y string")
    assert {r.label for r in parties.components(chain).collect()} == {"n00", "x"}


def test_average_linkage_ends_only_when_none_is_joined(spark):
    import itertools

    # every variant is nearest to the clean spelling, so a round takes in one
    names = [f"v{i:02}" for i in range(100)]
    star = [("hub", n, 0.99) for n in names] + [(a, b, 0.9) for a, b in itertools.combinations(names, 2)]
    c = spark.createDataFrame([(x, x) for x in ["hub", *names]], "core string, party string")
    got = parties.average_linkage(c, spark.createDataFrame(star, "a string, b string, cosine double"), rounds=3).collect()
    assert {r.party for r in got} == {"hub"} and len(got) == 101


def test_average_linkage_is_the_same_after_any_number_of_rounds(spark):
    import random

    r = random.Random(5)
    names = [f"n{i:02}" for i in range(60)]
    e = spark.createDataFrame([(a, b, r.uniform(0.5, 1.0)) for i, a in enumerate(names) for b in names[i + 1 :] if r.random() < 0.3], "a string, b string, cosine double")
    c = spark.createDataFrame([(x, x) for x in names], "core string, party string")
    by = [sorted(map(tuple, parties.average_linkage(c, e, rounds=n).collect())) for n in (0, 2, 100)]
    assert by[0] == by[1] == by[2] and 1 < len({p for _, p in by[0]}) < 60


def test_empty(spark):
    assert pairs(spark, [], []) == set()


def test_given_names_and_lines_of_business_keep_apart(spark):
    rows = [("s1", "Maria Fipunol", None), ("s2", "Antonio Fipunol", None), ("s3", "Toninho Fipunol", None), ("s4", "Tubos Zuteco Ltda", None), ("s5", "Tintas Zuteco", None), ("s6", "ZUTECO TUBOS E CONEXOES", None)]
    suppliers = spark.createDataFrame(rows, "id string, name string, aliases_json string")
    offers = spark.createDataFrame([("o1", "Maria Fipunol")], "id string, name string")
    got = sorted((r.key_a, r.key_b) for r in parties.same_party_pairs(suppliers, offers).collect())
    assert got == [("o1", "s1"), ("s2", "s3"), ("s4", "s6")]


def test_slips_are_met_by_what_they_leave(spark):
    import itertools
    import random

    r = random.Random(9)
    word = lambda n: "".join(r.choice("bcdfg" if i % 2 else "aeo") for i in range(n))
    names = {" ".join(sorted(word(r.choice((3, 4, 5, n))) for _ in range(2))) for n in (6, 8, 25, 27, 28, 29) for _ in range(12)}
    for n in sorted(names):
        for _ in range(3):
            x = list(n)
            for _ in range(r.choice((1, 2))):
                i = r.randrange(len(x))
                x[i : i + 1] = r.choice(([], ["a"], [x[i], "o"]))
            names.add(" ".join(sorted("".join(x).split())))
    names = sorted(n for n in names if n)
    form = lambda n: (n.replace(" ", ""), "".join(reversed(n.split())), {g for w in n.split() for g in ["=" + w, *(w[i : i + k] for k in (4, 5) for i in range(len(w) - k + 1))]})

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    want = set()
    for a, b in itertools.combinations(names, 2):
        (s, q, g), (t, u, h) = form(a), form(b)
        n = min(len(s), len(t))
        if abs(len(s) - len(t)) <= 2 and g & h and min(edits(s, t), edits(s, u), edits(q, t)) <= (2 if n >= 10 else 1 if n >= 7 else 0):
            want.add((a, b))
    got = {(x.a, x.b) for x in parties._slips(spark.createDataFrame([(n,) for n in names], "core string")).collect()}
    assert got == want and len(want) > 50 and any(len(a) > 32 for a, _ in want)
    # a word in common brings no two spellings together
    hot = spark.createDataFrame([(f"distribuidora {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}",) for i in range(600)], "core string")
    forms = hot.select("core", F.explode(parties._shortened(F.replace("core", F.lit(" "), F.lit("")))).alias("f"))
    assert forms.groupBy("f").count().filter("count > 1").count() == 0


def test_ngrams_of_one_spelling_are_not_posted(spark):
    names = spark.createDataFrame([(n,) for n in ("bacelo dufami", "bacelo dufamo", "gitopa zurine")], "core string")
    v = parties._vectors(names).cache()
    held = {(r.core, g) for r in v.collect() for g in r.v}
    posted = {(r.core, r.g) for r in parties._postings(v, 0.7).collect()}
    shared = {g for _, g in held if len({c for c, x in held if x == g}) > 1}
    assert posted <= held and {g for _, g in posted} <= shared and {c for c, _ in posted} == {"bacelo dufami", "bacelo dufamo"}


def test_forms_leave_the_disk_once_slips_are_met(spark):
    import random
    import time
    from pathlib import Path

    r = random.Random(4)
    names = sorted({"".join(r.choice("bcdfghjlm") + r.choice("aeiou") for _ in range(9)) for _ in range(2000)})
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p: p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*.data")}
    before, was = set(files()), spark.conf.get(RELEASE)
    parties._slips(spark.createDataFrame([(n,) for n in names], "core string")).collect()
    for _ in range(20):
        left = sum(n for p, n in files().items() if p not in before)
        if left < 1_000_000:
            break
        time.sleep(0.5)
    # 171 forms a name are some 4 MB
    assert left < 1_000_000 and spark.conf.get(RELEASE) == was
