"""Attributes parsed out of material descriptions, as Column expressions, and the scores that compare them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insumo.functions.norms import jaccard, norm, squeeze, token_set
from insumo.functions.text import fold
from insumo.functions.numbers import fuzzy_equal, to_mm, within
from insumo.functions.units import QUANTITY, figure_value, unit_table
from insumo.operators.nearest import best, ranked
from insumo.sources.shared import saved

# Kind of material -> its words (the first that fits holds); labels of kinds; makers; usual units.
TYPES = [("barra_chata", "barra chata|b chata"), ("chapa", r"chapas?|ch\.|folha metalica|lamina"), ("tubo", "tubos?|tubulacao"), ("fita", "silver tape|fita adesiva|fita"), ("parafuso", r"parafuso|paraf\."), ("porca", "porca"), ("arruela", "arruela"), ("rebite", "rebite"), ("cantoneira", "cantoneira|perfil l"), ("arame", "arame|fio de solda"), ("tela", "tela|malha"), ("flange", "flange"), ("tarugo", "tarugo"), ("conexao", "conexao|niple|nipple|luva|cotovelo|joelho|valvula|adaptador"), ("mangueira", "mangueira"), ("cabo", "cabo"), ("prensa_cabo", "prensa[ -]cabo"), ("rolamento", "rolamento|retentor"), ("adesivo", "adesivo|cola")]
MATERIALS = [("inox", r"\b(?:inox|stainless)\b"), ("aluminio", r"\baluminio\b|\bal\."), ("aco_carbono", r"\b(?:aco carbono|carbon steel)\b"), ("pvc", r"\bpvc\b"), ("borracha", r"\bborracha\b"), ("latao", r"\blatao\b"), ("bronze", r"\bbronze\b"), ("cobre", r"\bcobre\b"), ("nylon", r"\bnylon\b")]
ALLOYS = "304l?|316l?|201|202|310s?|321|409|410|420|430|440|1010|1018|1020|1045|4140|4340|8620|a36|3003|4043|5052f?|6061|6063|7075|2024"
MAKERS = {"3m": "3M", "weg": "WEG", "tigre": "Tigre", "tramontina": "Tramontina", "bosch": "Bosch", "siemens": "Siemens", "schneider": "Schneider", "vonder": "Vonder", "norton": "Norton", "makita": "Makita", "dewalt": "DeWalt", "skf": "SKF", "loctite": "Loctite", "tekbond": "Tekbond", "adere": "Adere"}
UNIT_WORDS = [("rolo", r"\b(?:rolo|bobina)\b"), ("cx", r"\b(?:caixa|cx)\b"), ("pct", r"\b(?:pacote|pct)\b"), ("par", r"\bpar\b"), ("kg", r"\bkg\b"), ("m²", r"\bm2\b")]
UNIT_OF = {"fita": "rolo", "cabo": "m", "mangueira": "m", "arame": "kg", "tela": "m²"}
MARKETPLACES = ["mercadolivre", "mercadolibre", "amazon", "shopee", "aliexpress", "magazineluiza", "americanas"]
CANONICAL = [("Largura", "largura|width"), ("Comprimento", "comprimento|length"), ("Espessura", "espessura|thickness"), ("Diâmetro", "diametro|diameter"), ("Altura", "altura|height"), ("Peso / capacidade", "peso|weight|capacidade"), ("Cor", "cor|color"), ("Liga", "liga|alloy"), ("Rosca", "rosca|thread"), ("Schedule", r"schedule|\bsch\b"), ("Medida", "medida|dimension|size")]
COLOURS = "pret[oa]|prata|branc[oa]|azul|amarel[oa]|verde|vermelh[oa]|cinza|marrom|transparente"
_VALUE = r"(?:\d+\s+\d+/\d+|\d+\.\d+/\d+|\d+/\d+|\d+(?:[.,]\d+)?)"
_UNIT = r'(?:mm|cm|mt|m|inch|in|pol|")'
_CHAIN = rf"(?<![A-Za-z0-9])(?i)({_VALUE})\s*({_UNIT})?\s*x\s*({_VALUE})\s*({_UNIT})?(?:\s*x\s*({_VALUE})\s*({_UNIT})?)?(?![A-Za-z0-9])"
_SINGLE = rf"(?<![A-Za-z0-9])(?i){_VALUE}\s*{_UNIT}(?![A-Za-z0-9])"


def material_type(text: Column, form: Column | None = None) -> Column:
    """Kind of material; '' for none, and for a flange outside an industrial context. form: the text's normal form, where it is at hand."""
    n = F.concat(F.lit(" "), norm(text) if form is None else form, F.lit(" "))
    other = ~n.rlike(r"\b(?:aco|inox|aluminio|dn|ansi|npt|rosca|tubo|solda|industrial|alta pressao|valvula|conexao)\b")
    found = F.when(n.rlike(r" flange ") & other, "").when(n.rlike(r" ch\.? "), "chapa")
    for kind, words in TYPES:
        found = found.when(n.rlike(rf" (?:{words}) "), kind)
    return found.otherwise("")


def material(text: Column, form: Column | None = None) -> Column:
    n = norm(text) if form is None else form
    return F.coalesce(*(F.when(n.rlike(p), F.lit(v)) for v, p in MATERIALS), F.lit(""))


def materials(text: Column) -> Column:
    """All materials of a text, in the order of the table."""
    n = norm(text)
    return F.array_compact(F.array(*(F.when(n.rlike(p), F.lit(v)) for v, p in MATERIALS)))


def alloys(text: Column, form: Column | None = None) -> Column:
    """Alloy grades, upper case, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(norm(text) if form is None else form, F.lit(rf"\b(?:aisi\s*)?f?({ALLOYS})\b"), 1), F.upper))


def threads(text: Column, form: Column | None = None) -> Column:
    """Threads (M8, NPT, DN50), upper case without blanks, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(norm(text) if form is None else form, F.lit(r"\b(npt|bspt?|unc|unf|m\s*\d+(?:[.,]\d+)?(?!\d*\s*(?:mm|m)\b)|dn\s*\d+)\b"), 1), lambda x: F.upper(F.replace(x, F.lit(" "), F.lit("")))))


def schedule(text: Column, form: Column | None = None) -> Column:
    return F.nullif(F.regexp_extract(norm(text) if form is None else form, r"\b(?:sch|schedule)\s*(\d+)\b", 1), F.lit(""))


def dimensions(text: Column) -> Column:
    """array<struct<raw, value_mm>>: chains first (a x b x c; a figure without a unit takes the chain's last), then single figures
    with a unit; values less than 0.001 mm apart count once. Alloys and threads are no dimensions."""
    raw = F.translate(squeeze(text), "×“”", 'x""')
    raw = F.regexp_replace(raw, rf"(?i)\b(?:aisi\s*)?(?:f)?(?:{ALLOYS})\b", " ")
    raw = F.regexp_replace(F.regexp_replace(raw, r"(?i)\bM\s*\d+(?:[.,]\d+)?\b", " "), r"(?i)\b3M\b[™®]?", " ")
    chains = F.regexp_extract_all(raw, F.lit(_CHAIN), 0)
    g = lambda s, i: F.regexp_extract(s, _CHAIN, i)
    last = lambda s: F.coalesce(*(F.nullif(g(s, i), F.lit("")) for i in (6, 4, 2)), F.lit(""))
    pair = lambda v, u: F.struct(squeeze(F.concat_ws(" ", v, u)).alias("raw"), F.round(to_mm(v, u), 4).alias("value_mm"))
    of_chain = lambda s: F.filter(F.array(*(F.when(g(s, i) != "", pair(g(s, i), F.coalesce(F.nullif(g(s, i + 1), F.lit("")), last(s)))) for i in (1, 3, 5))), lambda x: x.isNotNull())
    in_chains = F.flatten(F.transform(chains, of_chain))
    rest = F.regexp_replace(raw, _CHAIN, " | ")
    singles = F.transform(F.regexp_extract_all(rest, F.lit(_SINGLE), 0), lambda s: pair(F.regexp_extract(s, rf"^({_VALUE})", 1), F.regexp_extract(s, rf"(?i)({_UNIT})$", 1)))
    every = F.filter(F.concat(in_chains, singles), lambda d: d["value_mm"].isNotNull())
    start = F.array().cast("array<struct<raw:string,value_mm:double>>")
    return F.aggregate(every, start, lambda acc, d: F.when(F.exists(acc, lambda o: F.abs(o["value_mm"] - d["value_mm"]) < 0.001), acc).otherwise(F.concat(acc, F.array(d))))


def canonical_label(label: Column) -> Column:
    n = norm(label)
    return F.coalesce(*(F.when(n.rlike(p), F.lit(v)) for v, p in CANONICAL), F.nullif(squeeze(label), F.lit("")), F.lit("Característica"))


def specs(n: Column, kind: Column, m: Column, grades: Column, d: Column, t: Column) -> Column:
    """array<struct<label, value>> of a description: material, alloys, schedule, thread, protection, colour, and dimensions by kind. n: its
    normal form; kind, m (material), grades, d (dimensions), t (threads): as parsed() gives them, each computed once."""
    one = lambda label, value, cond: F.when(cond, F.struct(F.lit(label).alias("label"), value.alias("value")))
    ip, colour = F.regexp_extract(n, r"\b(ip\s*\d{2,3})\b", 1), F.regexp_extract(n, rf"\b({COLOURS})\b", 1)
    labels = (
        F.when((kind == "fita") & (F.size(d) >= 2), F.array(F.lit("Largura"), F.lit("Comprimento")))
        .when((kind == "chapa") & (F.size(d) >= 3), F.array(F.lit("Espessura"), F.lit("Comprimento"), F.lit("Largura")))
        .when((kind == "chapa") & (F.size(d) == 2), F.array(F.lit("Comprimento"), F.lit("Largura")))
        .when(kind.isin("barra_chata", "cantoneira") & (F.size(d) >= 2), F.array(F.lit("Largura"), F.lit("Espessura"), F.lit("Comprimento")))
        .when((kind == "parafuso") & (F.size(d) == 1) & (F.size(t) > 0), F.array(F.lit("Comprimento")))
    )
    by_kind = F.filter(F.zip_with(F.slice(d, F.lit(1), F.least(F.size(d), F.size(labels))), F.slice(labels, F.lit(1), F.least(F.size(d), F.size(labels))), lambda x, y: F.struct(y.alias("label"), x["raw"].alias("value"))), lambda x: x["value"].isNotNull())
    size = F.array(F.struct(F.lit("Medida").alias("label"), F.array_join(F.transform(F.slice(d, 1, 3), lambda x: x["raw"]), " × ").alias("value")))
    rest = F.when(labels.isNotNull(), by_kind).when(F.size(d) > 0, size).otherwise(F.array().cast("array<struct<label:string,value:string>>"))
    return F.concat(F.array_compact(F.array(
        one("Material", F.when(m == "inox", "Aço inoxidável").otherwise(F.translate(m, "_", " ")), m != ""),
        one("Liga", F.array_join(grades, ", "), F.size(grades) > 0),
        one("Schedule", F.concat(F.lit("SCH "), schedule(n, n)), schedule(n, n).isNotNull()),
        one("Rosca", F.get(t, F.lit(0)), F.size(t) > 0),
        one("Proteção", F.upper(F.replace(ip, F.lit(" "), F.lit(""))), ip != ""),
        one("Cor", colour, colour != ""),
    )), rest)


def specs_of(text: Column, kind: Column) -> Column:
    """specs() of a text in one expression, for rows that parsed() doesn't go through."""
    return specs(norm(text), kind, material(text), alloys(text), dimensions(text), threads(text))


def maker(text: Column, explicit: Column) -> Column:
    n = norm(text)
    return F.coalesce(F.nullif(squeeze(explicit), F.lit("")), *(F.when(n.rlike(rf"\b{k}\b"), F.lit(v)) for k, v in MAKERS.items()), F.lit(""))


def unit(kind: Column, text: Column) -> Column:
    """struct(unit, confidence): named in the text, else usual for the kind."""
    n = norm(F.translate(text, "²", "2"))
    named = F.coalesce(*(F.when(n.rlike(p), F.lit(v)) for v, p in UNIT_WORDS))
    usual = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in UNIT_OF.items()), F.lit("un"))
    guess = F.when(kind.isin("fita", "parafuso", "porca", "arruela", "rebite"), "média").otherwise("baixa")
    return F.struct(F.coalesce(named, usual).alias("unit"), F.when(named.isNotNull(), "alta").otherwise(guess).alias("confidence"))


def source_kind(host_: Column, brand: Column, manufacturer: Column, seller: Column) -> Column:
    bare = lambda c: F.regexp_replace(norm(c), "[^a-z0-9]", "")
    market = F.exists(F.array(*map(F.lit, MARKETPLACES)), lambda m: F.contains(bare(host_), m))
    own = (bare(manufacturer) != "") & F.contains(bare(host_), bare(manufacturer))
    return F.when(market, "marketplace").when(F.coalesce(seller, F.lit("")) != "", "retailer").when(own | (F.coalesce(brand, F.lit("")) != ""), "manufacturer").otherwise("reference")


def alloy_fits(asked: Column, found: Column) -> Column:
    """304 is met by 304 and 304L; 304L by itself alone."""
    return F.exists(asked, lambda a: F.exists(found, lambda b: (a == b) | (~a.endswith("L") & (b == F.concat(a, F.lit("L"))))))


def parsed(rows: DataFrame, text: str) -> DataFrame:
    """rows with form (normal form), kind, material, alloys, threads, dimensions of a text column.

    Every step goes through a generator, whose output is computed once; as nested expressions the normal form would be written
    out, and computed, in every branch of every parser."""
    t, n = F.col(text), F.col("form")
    once = lambda df, **cs: df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in cs.items())))).alias("_p")).select("*", "_p.*").drop("_p")
    rows = once(rows, form=norm(t), dimensions=dimensions(t))
    return once(rows, kind=material_type(t, n), material=material(t, n), alloys=alloys(t, n), threads=threads(t, n))


def described(rows: DataFrame, text: str, more: Column | None = None, kind: Column | None = None) -> DataFrame:
    """rows with kind, material, alloys, tokens, dims of a text column: the features that matching needs, once per row. more: further text
    (values of specifications) that material, alloys and dimensions are read from too; kind: one stated elsewhere, which holds if not ''."""
    rows = rows.withColumn("_t", F.col(text))
    whole = parsed(rows.withColumn("_all", F.col(text) if more is None else F.concat_ws(" ", text, more)), "_all")
    kinds = F.col("kind") if more is None else material_type(F.col("_t"))
    kinds = kinds if kind is None else F.coalesce(F.nullif(kind, F.lit("")), kinds)
    out = whole.select("*", F.explode(F.array(F.struct(kinds.alias("k"), token_set(F.col("_t")).alias("tokens")))).alias("_p"))
    return out.withColumns({"kind": F.col("_p.k"), "tokens": F.col("_p.tokens"), "dims": F.transform("dimensions", lambda d: d["value_mm"])}).drop("_p", "_t", "_all", "form", "dimensions", "threads")


def match_score(q: str, c: str) -> Column:
    """Score 0..100 of a candidate (struct alias c) for a query (alias q), both described(): 10, 30 for the kind, 18 the material,
    22 the alloy, up to 25 for shared words and 20 for met dimensions; a contradiction, or fewer than 60 % of dimensions met, is 0."""
    Q, C = (lambda f: F.col(f"{q}.{f}")), (lambda f: F.col(f"{c}.{f}"))
    both = lambda f: (Q(f) != "") & (C(f) != "")
    alloy_both = (F.size(Q("alloys")) > 0) & (F.size(C("alloys")) > 0)
    met = F.size(F.filter(Q("dims"), lambda d: F.exists(C("dims"), lambda e: within(d, e, 0.25, 0.015))))
    nq, nc = F.size(Q("dims")), F.size(C("dims"))
    clash = (both("kind") & (Q("kind") != C("kind"))) | (both("material") & (Q("material") != C("material"))) | (alloy_both & ~alloy_fits(Q("alloys"), C("alloys"))) | ((nq > 0) & (nc > 0) & (met / nq < 0.6))
    score = F.lit(10) + F.when(both("kind"), 30).otherwise(0) + F.when(both("material"), 18).otherwise(0) + F.when(alloy_both, 22).otherwise(0)
    score = score + F.bround(25 * jaccard(Q("tokens"), C("tokens"), 0.0), 0) + F.when(nq > 0, F.bround(20 * met / nq, 0)).otherwise(0)
    return F.when(clash, 0).otherwise(F.least(F.lit(100), score)).cast("int")


def _match_points(kind: np.ndarray, mat: np.ndarray, alloy: np.ndarray, share: np.ndarray, met: np.ndarray, asked: int, stated: np.ndarray) -> np.ndarray:
    """match_score() of the rows that contradict in no kind, material or alloy."""
    points = 10 + 30 * kind + 18 * mat + 22 * alloy + np.rint(25 * share)
    if asked:
        points = np.where((stated > 0) & (met / asked < 0.6), 0, points + np.rint(20 * met / asked))
    return np.minimum(points, 100).astype(np.int32)


def matches(queries: DataFrame, candidates: DataFrame, least: int = 45, n: int = 5) -> DataFrame:
    """qid, rank_no, id, score, confidence: the n best candidates of each query (qid, text) with a match_score() of `least` (45 or more) or better; ties: candidates that are
    preferred (a maker's own page), then the least id. candidates: id, name; optionally more (text of the specifications), kind (stated), preferred.

    Complete: a query is scored against all candidates of its kind and without one; only its best leave a block (nearest.py). Queries
    are a stated set, which every block of their kind gets."""
    if least < 45:
        raise ValueError("scores under 45 are no match")
    has = candidates.columns
    cols = ["kind", "material", "alloys", "tokens", "dims"]
    q = described(queries.select("qid", "text"), "text").select("qid", *cols)
    stated = candidates.select("id", "name", *(F.col(c).alias(f"_{c}") for c in ("more", "kind") if c in has), (F.coalesce("preferred", F.lit(False)) if "preferred" in has else F.lit(False)).alias("preferred"))
    c = saved(described(stated, "name", F.coalesce("_more", F.lit("")) if "more" in has else None, F.coalesce("_kind", F.lit("")) if "kind" in has else None).select("id", "preferred", *cols), "match-candidates")
    found = ranked(best(q, c, _match_points, least, n, (0.25, 0.015)), "points", n, F.col("preferred").desc())
    return found.select("qid", "rank_no", "id", F.col("points").alias("score"), F.when(F.col("points") >= 75, "alta").otherwise("média").alias("confidence"))


def scored_type(text: Column) -> Column:
    """Kind by points instead of the first fit: 5000 for a kind's word or phrase in the text, 1500 if a word begins with it, 250 for
    each word a slip away, and its length; the most points hold, ties by the table's order; '' for none."""
    n = F.concat(F.lit(" "), norm(text), F.lit(" "))
    words = F.filter(F.split(norm(text), " "), lambda w: w != "")
    near = lambda word: F.size(F.filter(words, lambda w: fuzzy_equal(w, F.lit(word))))
    options = []
    for i, (kind, alias) in enumerate(TYPES):
        for word in (a.replace(r"\.", ".").replace("s?", "").replace("[ -]", " ") for a in alias.split("|")):
            exact = F.when(F.contains(n, F.lit(f" {word} ")), 5000).when(F.contains(n, F.lit(f" {word}")), 1500).otherwise(0)
            slips = 250 * near(word) if " " not in word else F.lit(0)
            options.append(F.struct((exact + slips + F.when(exact + slips > 0, len(word)).otherwise(0)).alias("points"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*options))
    return F.when(best["points"] > 0, best["kind"]).otherwise("")


def facts(rows: DataFrame, key: str, text: str, specs_: str | None = None) -> DataFrame:
    """key, pos, kind, value, unit of every measurement in a text, in the common unit of its kind, and of all poles, protections,
    wires and areas: typed facts, one row each. Texts without any give none. specs_: a column of JSON specifications (label,
    value), whose values are read like texts, pos from 10000 on for each; those equal to a fact of before are left out."""
    if specs_:
        each = F.from_json(F.col(specs_), "array<struct<label:string,value:string>>")
        said = rows.select(F.col(key), F.lit(0).alias("_at"), F.col(text).alias("_t")).union(rows.select(F.col(key), F.posexplode(each).alias("_at", "_s")).select(key, F.col("_at") + 1, "_s.value"))
        found = facts(said.select(F.struct(F.col(key).alias("k"), F.col("_at").alias("at")).alias("_k"), "_t"), "_k", "_t").select(F.col("_k.k").alias(key), (F.col("pos") + 10000 * F.col("_k.at")).alias("pos"), "kind", "value", "unit")
        first = found.filter("pos >= 10000").groupBy(key, "kind", "value", "unit").agg(F.min("pos").alias("pos")).select(*found.columns)
        own = found.filter("pos < 10000")
        return own.unionByName(first.alias("s").join(own.select(F.col(key).alias("_k"), F.col("kind").alias("_kind"), F.col("value").alias("_value"), F.col("unit").alias("_unit")), (F.col(f"s.{key}") == F.col("_k")) & (F.col("s.kind") == F.col("_kind")) & F.col("s.value").eqNullSafe(F.col("_value")) & (F.col("s.unit") == F.col("_unit")), "left_anti"))
    units = F.broadcast(unit_table(rows.sparkSession))
    t = F.translate(fold(F.col(text)), "²³", "23")
    q = rows.select(F.col(key), F.posexplode(F.regexp_extract_all(t, F.lit(f"({QUANTITY})"), 1)).alias("pos", "q"))
    figure = F.regexp_extract("q", r"^(\d{1,2}[ .]\d{1,2}/\d{1,2}|\d{1,3}/\d{1,3}|\d+(?:[.,]\d+)*)", 1)
    alias = F.rtrim(F.regexp_replace(F.trim(F.substr(F.col("q"), F.length(figure) + 1)), r"\.$", ""))
    common = {"length": "mm", "mass": "kg", "volume": "l", "voltage": "v", "power": "w", "pressure": "kpa"}
    scale = {"length": 1000.0, "mass": 1_000_000.0, "volume": 1000.0, "voltage": 1.0, "power": 1.0, "pressure": 1.0}
    m = q.withColumn("a", alias).join(units, F.col("a") == F.col("alias"))
    div = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in scale.items()))
    measured = m.select(key, "pos", "kind", F.round((figure_value(figure) * F.col("factor")).cast("double") / div, 4).alias("value"), F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in common.items())).alias("unit"))
    others = {"poles": r"(\d+) ?polos", "protection": r"\bip ?(\d{2})\b", "wires": r"(\d+) ?fios", "area_mm2": r"(\d+(?:[.,]\d+)?) ?mm2"}
    named_ = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), F.replace(x, F.lit(","), F.lit(".")).try_cast("double").alias("value"))
    each = F.filter(F.concat(*(F.transform(F.regexp_extract_all(t, F.lit(p), 1), named_(k)) for k, p in others.items())), lambda x: x["value"].isNotNull())
    named = rows.select(F.col(key), F.posexplode(each).alias("pos", "x")).select(key, (F.col("pos") + 1000).alias("pos"), "x.kind", "x.value", F.lit("").alias("unit"))
    return measured.unionByName(named)


def parsed_specs(text: Column) -> Column:
    """array<struct<label, value>> of `label: value` lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n+"), lambda x: x.rlike(r"^[^:]{1,60}:\s*\S"))
    return F.transform(lines, lambda x: F.struct(squeeze(F.regexp_extract(x, r"^([^:]+):", 1)).alias("label"), squeeze(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("value")))


def tidy_specs(specs_: Column) -> Column:
    """Specifications with canonical labels, equal ones once, several sizes joined by ' × '."""
    named = F.array_distinct(F.transform(F.filter(specs_, lambda s: squeeze(s["value"]) != ""), lambda s: F.struct(canonical_label(s["label"]).alias("label"), squeeze(s["value"]).alias("value"))))
    size = F.array_join(F.transform(F.filter(named, lambda s: s["label"] == "Medida"), lambda s: s["value"]), " × ")
    rest = F.filter(named, lambda s: s["label"] != "Medida")
    return F.when(size == "", rest).otherwise(F.concat(rest, F.array(F.struct(F.lit("Medida").alias("label"), size.alias("value")))))


def attribute_rank(products: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """id, tier, score: active products for a described wish. Tier 5: the code or the whole name; 1 to 4: no contradiction, and so many
    of kind, material, alloy, dimensions met; 0: a contradiction of kind, material, alloy or dimension, listed last. Within a tier:
    the inverse document frequency of shared words over all products, then id."""
    q = described(products.sparkSession.range(1).select(F.lit(query).alias("text")), "text").select(*(F.col(f).alias(f"q_{f}") for f in ("kind", "material", "alloys", "tokens", "dims")))
    p = described(products.select("id", "name", "code", "archived"), "name")
    n = p.agg(F.count("*").alias("n"))
    df = p.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    asked = q.select(F.explode("q_tokens").alias("t")).join(df, "t").crossJoin(F.broadcast(n)).select("t", F.log(1 + (F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    lexical = p.filter(~F.col("archived")).select("id", F.explode("tokens").alias("t")).join(F.broadcast(asked), "t").groupBy("id").agg(F.sum("idf").alias("lexical"))
    x = p.filter(~F.col("archived")).crossJoin(F.broadcast(q)).join(lexical, "id", "left")
    both = lambda f: (F.col(f"q_{f}") != "") & (F.col(f) != "")
    alloy_both = (F.size("q_alloys") > 0) & (F.size("alloys") > 0)
    met = F.size(F.filter("q_dims", lambda d: F.exists("dims", lambda e: within(d, e, 0.3, 0.005))))
    clash = (both("kind") & (F.col("q_kind") != F.col("kind"))) | (both("material") & (F.col("q_material") != F.col("material"))) | (alloy_both & ~alloy_fits(F.col("q_alloys"), F.col("alloys"))) | ((F.size("q_dims") > 0) & (F.size("dims") > 0) & (met == 0))
    exact = (norm(F.col("name")) == norm(F.lit(query))) | (F.upper(F.trim("code")) == query.strip().upper())
    facets = sum((c.cast("int") for c in (both("kind"), both("material"), alloy_both, met > 0)), F.lit(0))
    tier = F.when(exact, 5).when(clash, 0).otherwise(facets)
    out = x.filter(exact | F.col("lexical").isNotNull()).select("id", tier.alias("tier"), F.round(F.coalesce("lexical", F.lit(0.0)), 6).alias("score"))
    return out.orderBy(F.col("tier").desc(), F.col("score").desc(), "id").limit(limit)
