"""Problem 2: listings of different sellers that describe the same item, and the catalogue's product for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.functions.text import fold
from insumo.functions.units import figure_value, spread_x, unit_table
from insumo.llm.graph import components
from insumo.operators.measures import statements
from insumo.sources.shared import saved

# Fixed values (folded): how each kind of item is named. The earliest in the text holds.
KINDS = {"parafuso": r"parafusos?\b|paraf\.", "tubo": r"tubos?\b|canos?\b", "cabo": r"cabos?\b|condutor(?:es)?\b", "chapa": r"chapas?\b|placas?\b|ch\.", "valvula": r"valvulas?\b|valv\.", "tinta": r"tintas?\b|esmalte/tinta\b", "motor": r"motor(?:es)?\b|mot\.", "mangueira": r"mangueiras?\b|mang\.", "eletrodo": r"eletrodos?\b|varetas?\b|eletr\.(?! ?\d* ?(?:mono|tri))", "graxa": r"graxas?\b|lubrificantes?\b", "luva": r"(?:par de )?luvas?\b"}
# Fixed values (folded): the wordings of each property that tells siblings of a kind apart: property -> value -> pattern, the first that fits holds.
STEEL = {"zincado": r"\b(?:aco|ferro)?[ -]?zinc(?:ado|ada)?\b", "carbono": r"\bcarb(?:ono)?\b", "latao": r"\blatao\b", "bronze": r"\bbronze\b", "cobre": r"\bcobre\b", "aluminio": r"\balum(?:inio)?\b", "pvc": r"\bpvc\b", "pex": r"\bpex\b", "silicone": r"\bsilicone\b", "borracha": r"\bborr(?:acha)?\b", "inox": r"\binox|\baisi\b"}
COLOURS = {"azul": r"\b(?:azul|azuis|az)\b", "verde": r"\b(?:verde|vd)\b", "vermelho": r"\b(?:vermelh[oa]|vm)\b", "branco": r"\b(?:branc[oa]|bca|bco)\b", "preto": r"\b(?:pret[oa]|pt)\b", "cinza": r"\b(?:cinza|cz)\b", "amarelo": r"\b(?:amarel[oa]|am)\b"}
PROPERTIES: dict[str, dict[str, dict[str, str]]] = {
    "parafuso": {"variant": {"allen": r"\ballen\b", "philips": r"\bphil(?:ips)?\b", "frances": r"\bfrances\b", "sem cabeca": r"\b(?:sem|s/) cabeca\b", "sextavado": r"\bsext(?:av(?:ad[oa])?)?\b"}, "material": STEEL},
    "tubo": {"variant": {"soldavel": r"\bsold(?:avel)?\b|\bp(?:/|ara) solda\b", "roscavel": r"\brosc(?:avel)?\b", "sem costura": r"\b(?:sem|s/) costura\b"}, "material": STEEL},
    "cabo": {"variant": {"flexivel": r"\bflex(?:ivel)?\b", "rigido": r"\brig(?:ido)?\b", "blindado": r"\bblind(?:ado)?\b", "pp": r"\bpp\b"}, "colour": COLOURS},
    "chapa": {"variant": {"xadrez": r"\bxadrez\b", "perfurada": r"\bperf(?:urada)?\b|\b(?:c/|com) furos\b", "lisa": r"\blisa\b|\bplana\b"}, "material": STEEL},
    "valvula": {"variant": {"esfera": r"\besf(?:era)?\b", "gaveta": r"\bgav(?:eta)?\b", "globo": r"\bglobo\b", "retencao": r"\bret(?:encao)?\b"}, "material": STEEL},
    "tinta": {"variant": {"acrilica": r"\bacril(?:ica)?\b", "epoxi": r"\bepoxi\b", "anticorrosiva": r"\banticorr(?:osiva)?\b", "esmalte": r"\besmalte\b(?!/)"}, "finish": {"fosca": r"\bfosc[oa]\b", "acetinada": r"\bacetinad[oa]\b", "brilhante": r"\bbrilh(?:ante)?\b"}, "colour": COLOURS},
    "motor": {"variant": {"com freio": r"\b(?:com|c/) freio\b", "monofasico": r"\bmono(?:fasico)?\b|\b1 ?f\b", "trifasico": r"\btri(?:fasico)?\b|\b3 ?f\b"}},
    "mangueira": {"variant": {"ar": r"\bp(?:ara|/) ?ar\b", "agua": r"\bp(?:ara|/) ?agua\b", "trancada": r"\btranc(?:ada)?\b", "espiral": r"\bespiral\b"}, "material": STEEL},
    "eletrodo": {"variant": {"rutilico": r"\brutil(?:ico)?\b", "basico": r"\bbasico\b", "celulosico": r"\bcelul(?:osico)?\b"}},
    "graxa": {"variant": {"litio": r"\blitio\b", "grafitada": r"\bgraf(?:itada)?\b", "alimenticia": r"\baliment(?:icia)?\b", "alta temperatura": r"\balta temp(?:eratura)?\b"}},
    "luva": {"variant": {"nitrilica": r"\bnitril(?:ica|a)\b", "vaqueta": r"\bvaqueta\b", "anticorte": r"\banticorte\b", "termica": r"\btermica\b"}, "colour": COLOURS},
}
# Properties that are read out of the text itself, by kind: property -> pattern with one group.
READ = {
    "parafuso": {"thread": r"(?<![a-z0-9])m ?(\d{1,2})(?![0-9,.]|\s?(?:mm|m)\b)"},
    "tubo": {"grade": r"(?:inox\w*|aisi)[ -]*(?:aisi[ -]*)?([234]\d\d ?l?)(?![a-z0-9])"},
    "chapa": {"grade": r"(?:inox\w*|aisi)[ -]*(?:aisi[ -]*)?([234]\d\d ?l?)(?![a-z0-9])"},
    "valvula": {"grade": r"(?:inox\w*|aisi)[ -]*(?:aisi[ -]*)?([234]\d\d ?l?)(?![a-z0-9])"},
    "cabo": {"section": r"(\d+(?:[.,]\d+)?) ?mm2"},
    "motor": {"poles": r"(\d+) ?polos", "mount": r"\b(b\d{1,2})\b"},
    "eletrodo": {"grade": r"\be-? ?(\d{2})\b"},
    "graxa": {"grade": r"\bnlgi[ -]*(\d)"},
    "luva": {"size": r"\btam\.? ?(gg|pp|g|m|p)\b"},
}
# Measures that an item of each kind has.
MEASURES = {"parafuso": ["length"], "tubo": ["diameter", "length"], "cabo": ["voltage", "length"], "chapa": ["thickness", "length", "width"], "valvula": ["diameter", "pressure"], "tinta": ["volume"], "motor": ["power", "voltage"], "mangueira": ["diameter", "pressure", "length"], "eletrodo": ["diameter", "mass"], "graxa": ["mass"], "luva": []}
SPATIAL = {"parafuso": ["length"], "cabo": ["length"], "chapa": ["thickness", "length", "width"], "tubo": ["diameter", "length"], "mangueira": ["diameter", "length"], "eletrodo": ["diameter"], "valvula": ["diameter"]}
LONG_UM = 500_000
NOT_A_CODE = r"^(?:S/?REF|N/?A|N/?D|NULL|NONE|SEM|0+|-+|X+)$"
FIELDS = ["variant", "material", "colour", "finish", "thread", "grade", "section", "poles", "mount", "size"]


def _kind(text: Column, hint: Column) -> Column:
    found = F.array_compact(F.array(*(F.when(F.regexp_instr(text, F.lit(rf"(?<![a-z])(?:{p})")) > 0, F.struct(F.regexp_instr(text, F.lit(rf"(?<![a-z])(?:{p})")).alias("at"), F.lit(k).alias("kind"))) for k, p in KINDS.items())))
    return F.coalesce(F.array_min(found)["kind"], F.when(hint.isin(*KINDS), hint))


def _property(field: str, kind: Column, text: Column) -> Column:
    chains = []
    for k in KINDS:
        values = PROPERTIES[k].get(field)
        if values:
            chains.append(F.when(kind == k, F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for v, p in values.items()))))
        elif field in READ.get(k, {}):
            chains.append(F.when(kind == k, F.nullif(F.translate(F.regexp_extract(text, READ[k][field], 1), " ", ""), F.lit(""))))
    return F.coalesce(*chains) if chains else F.lit(None).cast("string")


def code_key(code: Column) -> Column:
    """Maker's prefix, model and number without their separators; NULL for what is no code (too short, only letters or figures, placeholders)."""
    up = F.upper(fold(code))
    bare = F.regexp_replace(F.regexp_replace(up, r"^\s*(?:REF|COD|PN|P/N|MOD)[ .:#-]+", ""), r"[^A-Z0-9]", "")
    return F.when(bare.rlike(r"^[A-Z0-9]{6,}$") & bare.rlike("[A-Z]") & bare.rlike("[0-9]") & ~F.trim(up).rlike(NOT_A_CODE), F.regexp_replace(bare, r"(?<=[A-Z0-9]{8})0+(?=[1-9]$)", ""))


def gtin_key(text: Column) -> Column:
    """The first 12, 13 or 14 figures of a text whose check digit is right, as 14 figures; 8 figures only where they are said to be one."""
    digits = F.regexp_extract_all(text, F.lit(r"((?<=(?i:ean|gtin)[^0-9a-z]{0,9})\d{8}|(?<!\d)\d{12,14})(?!\d)"), 1)
    padded = F.transform(digits, lambda d: F.lpad(d, 14, "0"))
    total = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda a, i: a + F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return F.get(F.filter(padded, lambda d: (total(d) % 10 == 0) & (d != "0" * 14)), F.lit(0))


def _measures(rows: DataFrame) -> DataFrame:
    """id, m (map of measure to amount) of rows with id, kind, name, unit, specs_json.

    A specification's labels go before the name. The lengths of a name that none of the labels states take the kind's
    remaining measures in order; a tube's or hose's only one is told by its size."""
    units = F.broadcast(unit_table(rows.sparkSession))
    as_ = lambda p: units.select(*(F.col(c).alias(f"{p}_{c}") for c in units.columns))
    s = statements(rows, F.col("kind")).withColumn("value", figure_value(F.col("figure"))).filter("value is not null")
    s = s.join(as_("t"), F.col("alias") == F.col("t_alias"), "left").join(as_("l"), F.col("fallback") == F.col("l_alias"), "left").join(as_("u"), F.col("unit_alias") == F.col("u_alias"), "left")
    own = Window.partitionBy("product_id")
    # a bare figure has the unit of the same figure of the same sort in the name
    sort = lambda c: F.when(c.isin("length", "width", "thickness", "diameter"), "length").when(c.isin("mass", "volume", "content"), "content").otherwise(c)
    same = Window.partitionBy("product_id", "value", F.when(F.col("origin") == "spec", sort(F.col("measure"))).otherwise(sort(F.col("t_kind"))))
    named = lambda c: F.max(F.when(F.col("origin") == "name", F.col(c))).over(same)
    s = s.repartition("product_id").withColumns({f"n_{c}": named(f"t_{c}") for c in ("kind", "factor")})
    bare_unit = F.when(F.col("origin") == "spec", F.col("u_kind")), F.when(F.col("origin") == "spec", F.col("u_factor"))
    s = s.withColumn("unit_kind", F.coalesce("t_kind", "l_kind", "n_kind", bare_unit[0])).withColumn("factor", F.coalesce("t_factor", "l_factor", "n_factor", bare_unit[1])).filter("factor is not null")
    s = s.withColumn("amount", F.round(F.col("value") * F.col("factor"), 0).cast("long"))
    spatial = F.col("unit_kind") == "length"
    label = F.when(F.col("origin") == "spec", F.when(F.col("measure").isin("content", "mass", "volume"), F.col("unit_kind")).otherwise(F.col("measure")))
    s = s.withColumn("label", F.when(label.isin("length", "width", "thickness", "diameter") == spatial, label))
    s = s.withColumn("stated", F.collect_set(F.when(spatial, F.col("label"))).over(own)).withColumn("amounts", F.collect_set(F.when(spatial & F.col("label").isNotNull(), F.col("amount"))).over(own))
    free = spatial & (F.col("origin") != "spec") & ~F.array_contains("amounts", F.col("amount"))
    s = s.withColumn("free", free)
    lengths = Window.partitionBy("product_id", "free")
    s = s.withColumn("nth", F.dense_rank().over(lengths.orderBy(F.col("origin"), "pos"))).withColumn("many", F.size(F.collect_set(F.struct("origin", "pos")).over(lengths)))
    slots = F.coalesce(*(F.when(F.col("item") == k, F.array(*map(F.lit, ms))) for k, ms in SPATIAL.items()))
    left = F.array_except(slots, "stated")
    tube = F.col("item").isin("tubo", "mangueira") & (F.size(left) == 2) & (F.col("many") == 1)
    measure = F.when(~spatial, F.coalesce("label", "unit_kind")).when(F.col("origin") == "spec", F.col("label")).when(~F.col("free"), None).when(tube, F.when(F.col("amount") >= LONG_UM, "length").otherwise("diameter")).otherwise(F.get(left, F.col("nth") - 1))
    s = s.withColumn("m", measure).filter("m is not null")
    rank = F.when(F.col("origin") == "spec", 0).when(F.col("origin") == "name", 1).otherwise(2)
    best = s.withColumn("rn", F.row_number().over(Window.partitionBy("product_id", "m").orderBy(rank, "pos", "amount"))).filter("rn = 1")
    return best.groupBy(F.col("product_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("m", "amount"))).alias("m"))


def _edits(word: Column) -> Column:
    """The word with each letter left out, and itself: words at one slip (a letter more, less, other, or two swapped) share one."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def with_brands(rows: DataFrame) -> DataFrame:
    """rows (id, maker, marked, words, prefix) -> id, brand: the maker field, else the specification's, else a word of the name that is
    a known brand or one slip from one, else the only brand whose codes have the row's prefix.

    Known brands are those named in a field of any row; they are matched by a join on words with one letter left out."""
    cleaned = F.coalesce(F.nullif(F.col("maker"), F.lit("")), F.nullif(F.col("marked"), F.lit("")))
    rows = rows.withColumn("field", cleaned)
    named = rows.filter("field is not null")
    known = named.groupBy(F.col("field").alias("brand")).agg(F.count("*").alias("n"))
    # a brand's own rare misspellings aren't brands
    keyed = known.withColumn("k", F.explode(_edits(F.col("brand"))))
    slips = keyed.alias("a").join(keyed.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.brand") != F.col("b.brand")) & (F.col("b.n") >= 10 * F.col("a.n"))).filter(F.levenshtein("a.brand", "b.brand") <= 2)
    slips = slips.groupBy(F.col("a.brand").alias("field")).agg(F.max_by("b.brand", F.struct("b.n", "b.brand")).alias("right_brand"))
    good = keyed.join(slips.select(F.col("field").alias("brand")), "brand", "left_anti")
    open_ = rows.filter("field is null").select("id", F.explode("words").alias("word")).filter(F.length("word") >= 5)
    distinct = open_.select("word").distinct().withColumn("k", F.explode(_edits(F.col("word"))))
    near = distinct.join(good, "k").withColumn("d", F.when(F.col("word") == F.col("brand"), 0).otherwise(1)).filter((F.col("d") == 0) | ((F.length("brand") >= 7) & (F.abs(F.length("word") - F.length("brand")) <= 1)))
    near = near.groupBy("word").agg(F.min(F.struct("d", (-F.col("n")).alias("n"), "brand")).alias("best")).select("word", "best.d", "best.brand")
    by_name = open_.join(near, "word").groupBy("id").agg(F.min(F.struct("d", "brand")).alias("b")).select("id", F.col("b.brand").alias("name_brand"))
    makers = named.filter("prefix is not null").groupBy("prefix").agg(F.countDistinct("field").alias("n"), F.first("field").alias("prefix_brand")).filter("n = 1").select("prefix", "prefix_brand")
    out = rows.join(slips, "field", "left").join(by_name, "id", "left").join(makers, "prefix", "left")
    return out.select("id", F.coalesce("right_brand", "field", "name_brand", "prefix_brand").alias("brand"))


def features(rows: DataFrame) -> DataFrame:
    """id, side, kind, brand, code, gtin, the properties in FIELDS and the measures in m, of rows with id, side, text, hint, about,
    maker, marked, codes (array), unit, specs_json. The result is written once."""
    text = spread_x(fold(F.col("text")))
    base = rows.withColumn("t", text).withColumn("kind", _kind(F.col("t"), fold(F.col("hint"))))
    clean = lambda c: F.trim(F.regexp_replace(fold(c), r"\s+(?:ind\.?|industria|do brasil|ltda\.?|s/?a\.?)\s*$", ""))
    base = base.withColumn("code", F.get(F.array_compact(F.transform("codes", code_key)), F.lit(0))).withColumn("prefix", F.substring("code", 1, 3))
    about = fold(F.col("about"))
    attributes = {f: F.coalesce(_property(f, F.col("kind"), F.col("t")), _property(f, F.col("kind"), about)) for f in FIELDS}
    gtin = gtin_key(F.concat_ws(" ", F.col("text"), F.concat_ws(" ", "codes"), F.col("specs_json")))
    one = saved(base.select("id", "side", F.col("t").alias("name"), "kind", "code", "prefix", gtin.alias("gtin"), clean(F.col("maker")).alias("maker"), clean(F.col("marked")).alias("marked"), F.array_distinct(F.regexp_extract_all("t", F.lit(r"([a-z]{5,})"), 1)).alias("words"), "unit", "specs_json", *(c.alias(f) for f, c in attributes.items())), "features")
    brands = with_brands(one.select("id", "maker", "marked", "words", "prefix"))
    out = one.drop("name", "prefix", "maker", "marked", "words", "unit", "specs_json").join(brands, "id", "left").join(_measures(one), "id", "left")
    return out


def _needed(kind: Column) -> Column:
    """Names of what makes an item of a kind: a property or measure each."""
    return F.coalesce(*(F.when(kind == k, F.array(*map(F.lit, [*(f for f in FIELDS if f in PROPERTIES[k] or f in READ.get(k, {})), *MEASURES[k]]))) for k in KINDS), F.array().cast("array<string>"))


def keyed(features_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, side, tuple, stated, parts) and (id, key): rows with what they state, and their reliable keys.

    Keys are g: a GTIN with a right check digit, c: a maker's code, t: the whole set of what makes an item of its kind (brand,
    what tells siblings apart, measures), for rows that state it all. `stated` has kind, brand, properties and measures as
    name=value, for rows of any kind."""
    value = lambda f: F.coalesce(F.col(f), F.lit("")) if f in FIELDS else F.coalesce(F.col("m")[f].cast("string"), F.lit(""))
    every = [*FIELDS, *dict.fromkeys(x for ms in MEASURES.values() for x in ms)]
    state = F.map_from_entries(F.array(*(F.struct(F.lit(f).alias("k"), value(f).alias("v")) for f in every)))
    rows = features_.withColumn("needed", _needed(F.col("kind"))).withColumn("state", state)
    # a grade belongs to stainless items alone
    optional = F.when(F.col("kind").isin("tubo", "chapa", "valvula") & (F.coalesce("material", F.lit("")) != "inox"), F.array(F.lit("grade"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("needed", F.array_except("needed", optional))
    parts = F.concat(F.array(F.coalesce("kind", F.lit("")), F.coalesce("brand", F.lit(""))), F.transform("needed", lambda n: F.col("state")[n]))
    # what a kind doesn't need isn't told apart by; of an unknown kind, measures alone are told
    told = F.when(F.col("kind").isNotNull(), F.col("needed")).otherwise(F.array(*map(F.lit, (f for f in every if f not in FIELDS))))
    stated = F.filter(F.concat(F.array(F.struct(F.lit("kind").alias("k"), F.coalesce("kind", F.lit("")).alias("v")), F.struct(F.lit("brand").alias("k"), F.coalesce("brand", F.lit("")).alias("v"))), F.transform(told, lambda n: F.struct(n.alias("k"), F.col("state")[n].alias("v")))), lambda x: x["v"] != "")
    rows = rows.withColumn("parts", parts).withColumn("stated", stated).withColumn("whole", F.col("kind").isNotNull() & F.col("brand").isNotNull() & ~F.array_contains("parts", ""))
    rows = saved(rows.select("id", "side", "code", "gtin", "parts", "stated", F.when(F.col("whole"), F.array_join("parts", "|")).alias("tuple")).distinct(), "items")
    named = lambda c, name: F.when(F.col(c).isNotNull(), F.concat(F.lit(name), c))
    keys = rows.select("id", F.explode(F.array_compact(F.array(named("code", "c:"), named("gtin", "g:"), named("tuple", "t:")))).alias("key"))
    return rows.drop("code", "gtin"), keys


def items(features_: DataFrame) -> DataFrame:
    """id, side, item: rows of one item have one item key; rows without a reliable key have none.

    Rows are linked through the keys that they share (GTIN, maker's code, whole set of attributes), each guarded: a key whose
    rows state two values of one attribute links none of them, and such rows take part by their whole set, or by the only
    whole set under the key that agrees with all that they state. Connected components of the keys, by label propagation until
    nothing moves, are the items. A component that holds two whole sets is split into these by the same rule. The graph's nodes are keys, not
    rows, so copies of a row, however many, add nothing to it; keys are guarded by aggregates, never by pairs of rows."""
    rows, keys = keyed(features_)
    hard = keys.filter("key not like 't:%'").join(rows, "id")
    values = hard.select("key", F.explode("stated").alias("s")).groupBy("key", "s.k").agg(F.min("s.v").alias("least"), F.max("s.v").alias("most"))
    torn = saved(values.filter("least <> most").select("key").distinct(), "torn-keys")
    # rows under a torn key: the only whole set there that agrees
    under = hard.join(torn, "key")
    wholes = under.filter("tuple is not null").select("key", "tuple", F.col("stated").alias("theirs")).distinct()
    agrees = F.forall("stated", lambda s: ~F.exists("theirs", lambda t: (t["k"] == s["k"]) & (t["v"] != s["v"])))
    fits = lambda partial, wholes: partial.drop("tuple").join(wholes, "key").filter(agrees).groupBy("id").agg(F.min("tuple").alias("least"), F.max("tuple").alias("most")).filter("least = most").select("id", F.concat(F.lit("t:"), "least").alias("key"))
    good = saved(keys.join(torn, "key", "left_anti").union(fits(under.filter("tuple is null"), wholes)).distinct(), "good-keys")
    label = components(good.groupBy("id").agg(F.min("key").alias("x"), F.collect_set("key").alias("ys")).select("x", F.explode("ys").alias("y")).distinct())
    label = label.withColumnRenamed("node", "key")
    of_row = saved(good.join(label, "key").groupBy("id").agg(F.min("label").alias("label")), "labelled")
    # components with several whole sets
    sets = label.filter("key like 't:%'").groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
    split = of_row.join(sets, "label").join(rows, "id")
    theirs = split.filter("tuple is not null").select(F.col("label").alias("key"), "tuple", F.col("stated").alias("theirs")).distinct()
    by_set = split.filter("tuple is not null").select("id", F.concat(F.lit("t:"), "tuple").alias("key")).union(fits(split.filter("tuple is null").withColumn("key", F.col("label")), theirs))
    whole = of_row.join(sets, "label", "left_anti").select("id", F.col("label").alias("item"))
    return whole.union(by_set.select("id", F.col("key").alias("item"))).join(rows.select("id", "side"), "id").select("id", "side", "item")


def kinds_of_key(features_: DataFrame) -> DataFrame:
    """key_kind (gtin, code, attributes), rows_ that have such a key, shared: rows that share it with another row."""
    _, keys = keyed(features_)
    n = keys.groupBy("key").agg(F.count_distinct("id").alias("n"))
    kind = F.when(F.col("key").like("g:%"), "gtin").when(F.col("key").like("c:%"), "code").otherwise("attributes")
    return n.groupBy(kind.alias("key_kind")).agg(F.sum("n").alias("rows_"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"))


def listing_rows(candidates: DataFrame) -> DataFrame:
    """match_candidate rows for features(). Null names fall back to raw_name."""
    spec = lambda labels: F.get(F.transform(F.filter("specs", lambda s: fold(F.trim(s["label"])).isin(*labels)), lambda s: s["value"]), F.lit(0))
    return candidates.select("id", F.lit("listing").alias("side"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), "raw_name").alias("text"), F.col("product_type").alias("hint"), F.col("description").alias("about"), F.col("manufacturer").alias("maker"), spec(["marca", "fabricante", "brand"]).alias("marked"), F.array("manufacturer_code").alias("codes"), "unit", F.to_json("specs").alias("specs_json"))


def product_rows(products: DataFrame) -> DataFrame:
    """product rows for features(). Codes are the external ones, else maker's prefix with the model and number of the own code."""
    own = F.regexp_extract_all(F.upper(fold(F.col("code"))), F.lit(r"^[A-Z]{2}-([A-Z0-9]{5})-(\d+)$"), 0)
    model = F.when(F.size(own) > 0, F.concat(F.upper(F.substring(fold(F.col("manufacturer")), 1, 3)), F.regexp_replace(F.regexp_replace(F.get(own, F.lit(0)), r"^[A-Z]{2}-", ""), r"-0*(?=\d)", "")))
    codes = F.concat(F.coalesce(F.from_json("external_codes_json", "array<string>"), F.array().cast("array<string>")), F.array(F.when(F.length("manufacturer") >= 3, model)))
    none = F.lit(None).cast("string")
    return products.select("id", F.lit("product").alias("side"), F.col("name").alias("text"), F.col("family").alias("hint"), none.alias("about"), F.col("manufacturer").alias("maker"), none.alias("marked"), codes.alias("codes"), "unit", "specs_json")


def same_item_pairs(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """key_a, key_b (key_a < key_b): listings of the same item, and a listing with a product of the same item. Rows repeated in
    either table count once; pairs of two products aren't formed. The pairs of an item are the result asked for, whole."""
    keyed = saved(items(features(listing_rows(candidates).unionByName(product_rows(products)))).distinct(), "item-keys")
    listings = keyed.filter("side = 'listing'").select("item", F.col("id").alias("a"))
    pairs = listings.join(keyed.select("item", F.col("id").alias("b"), "side"), "item").filter("(side = 'product' and a <> b) or a < b")
    return pairs.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
