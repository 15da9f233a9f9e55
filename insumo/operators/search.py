"""Ranked search: inverted index with BM25, substring fallback, token prefilter and simple rank, web result rank, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.functions.norms import host, norm, norm_index, squeeze
from insumo.functions.text import strip_accents

#: Weights of the index' columns.
WEIGHTS = {"name": 5.0, "code": 4.0, "family": 1.2, "manufacturer": 2.0, "search_text": 1.0}
K1, B, QUERY_TOKENS = 1.2, 0.75, 8


def search_text(products: DataFrame) -> DataFrame:
    """products with search_text: all fields that are searched, as they are and in the index form."""
    strings = lambda c: F.concat_ws(" ", F.from_json(c, "array<string>"))
    specs = F.concat_ws(" ", F.transform(F.from_json("specs_json", "array<struct<label:string,value:string>>"), lambda s: F.concat_ws(" ", s["label"], s["value"])))
    raw = squeeze(F.concat_ws(" ", "name", "code", "family", "subcategory", "manufacturer", strings("aliases_json"), strings("external_codes_json"), specs))
    return products.withColumn("search_text", F.concat_ws(" ", raw, norm_index(raw)))


def index_terms(c: Column) -> Column:
    """Terms of the index: runs of letters and figures, without case and accents."""
    return F.regexp_extract_all(F.lower(strip_accents(F.coalesce(c, F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def postings(docs: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """doc, col, pos, term: the inverted index."""
    each = F.array(*(F.struct(F.lit(c).alias("col"), index_terms(F.col(c)).alias("terms")) for c in columns))
    cols = docs.select(F.col(key).alias("doc"), F.explode(each).alias("c"))
    return cols.select("doc", F.col("c.col").alias("col"), F.posexplode("c.terms").alias("pos", "term"))


def query_terms(query: str) -> list[list[str]]:
    """The first tokens of a query, each as the terms it consists of (1/4 is a phrase of two); quotes are dropped."""
    import re
    import unicodedata

    text = unicodedata.normalize("NFD", query.replace("×", "x")).encode("ascii", "ignore").decode().lower()
    text = re.sub(r"\bmilimetros?\b", "mm", re.sub(r"(?<=\d),(?=\d)", ".", text))
    parts = [re.findall(r"[a-z0-9]+", t) for t in text.split()]
    return [p for p in parts if p][:QUERY_TOKENS]


def bm25(index: DataFrame, docs: DataFrame, query: str, weights: dict[str, float] = WEIGHTS, key: str = "id") -> DataFrame:
    """doc, score (lower is better) of documents with a term of the query as a prefix of theirs; a token of several terms is a phrase.

    Corpus statistics run over all documents, hits over the postings of the query's terms alone. A term in half of the
    documents or more weighs 1e-6. An empty query finds nothing."""
    tokens = query_terms(query)
    spark = docs.sparkSession
    if not tokens:
        return spark.createDataFrame([], "doc string, score double")
    sizes = index.groupBy("doc").agg(F.count("*").alias("len"))
    stats = docs.agg(F.count("*").alias("n")).crossJoin(sizes.agg(F.sum("len").alias("total")))
    weight = F.coalesce(*(F.when(F.col("col") == c, F.lit(w)) for c, w in weights.items()))
    hits = None
    for q, terms in enumerate(tokens):
        found = index.filter(F.col("term").startswith(terms[-1]) if len(terms) == 1 else F.col("term") == terms[0])
        for k, t in enumerate(terms[1:], 1):
            then = index.filter(F.col("term").startswith(t) if k == len(terms) - 1 else F.col("term") == t).select("doc", "col", (F.col("pos") - k).alias("pos"))
            found = found.join(then, ["doc", "col", "pos"], "left_semi")
        found = found.select("doc", F.lit(q).alias("q"), weight.alias("w"))
        hits = found if hits is None else hits.union(found)
    tf = hits.groupBy("doc", "q").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("q").agg(F.count("*").alias("df"))
    x = tf.join(F.broadcast(df), "q").join(sizes, "doc").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (F.col("total") / F.col("n"))))
    return x.groupBy("doc").agg((-F.sum(part)).alias("score"))


def search(products: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """The best active products: id, name, score (rounded), the least first, ids break ties. Archived ones count in the statistics."""
    docs = search_text(products)
    scored = bm25(postings(docs, list(WEIGHTS)), docs, query)
    live = docs.filter(~F.col("archived")).select("id", "name")
    return scored.join(live, scored["doc"] == live["id"]).select("id", "name", F.round("score", 6).alias("score")).orderBy("score", "id").limit(limit)


def snippet(text: Column, terms: list[str], words: int = 10) -> Column:
    """The first window of so many words that begins at a word with a term as prefix, hits in <b>; '…' where text is left out."""
    w = F.split(squeeze(text), " ")
    is_hit = lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.startswith(F.lower(strip_accents(x)), t))
    at = F.greatest(F.lit(1), F.array_position(F.transform(w, lambda x: is_hit(x)), True).cast("int"))
    cut = F.transform(F.slice(w, at, F.lit(words)), lambda x: F.when(is_hit(x), F.concat(F.lit("<b>"), x, F.lit("</b>"))).otherwise(x))
    return F.concat(F.when(at > 1, "…").otherwise(""), F.array_join(cut, " "), F.when(at + words - 1 < F.size(w), "…").otherwise(""))


def like(products: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Fallback: active products whose normal name, search text or code holds the query; by id."""
    spark = products.sparkSession
    forms = spark.range(1).select(norm_index(F.lit(query)).alias("q"), squeeze(F.lit(query)).alias("raw"))
    docs = search_text(products).filter(~F.col("archived")).crossJoin(F.broadcast(forms))
    hit = F.contains(norm_index(F.col("name")), F.col("q")) | F.contains(F.lower("search_text"), F.col("q")) | F.contains(F.coalesce("code", F.lit("")), F.col("raw"))
    return docs.filter(hit).select("id", "name").orderBy("id").limit(limit)


def simple_rank(products: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Products all of whose query words begin a word of the name or search text: 2200 for each in the name, else 1200, 700 more
    if it only begins one, 10000 to begin with, and up to 500 for offers."""
    words = [t for token in query_terms(query) for t in token]
    name = index_terms(F.col("name"))
    docs = search_text(products).filter(~F.col("archived")).select("id", "name", "offer_count", name.alias("n"), index_terms(F.col("search_text")).alias("s"))
    begins = lambda arr, t: F.exists(arr, lambda x: x.startswith(t))
    for t in words:
        docs = docs.filter(begins(F.col("n"), t) | begins(F.col("s"), t))
    score = F.lit(10000) + F.least(F.lit(500), F.coalesce("offer_count", F.lit(0)) * 10)
    for t in words:
        score = score + F.when(F.array_contains("n", t), 2200).when(begins(F.col("n"), t), 1500).when(F.array_contains("s", t), 1200).otherwise(700)
    return docs.select("id", "name", score.cast("long").alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


def staged(products: DataFrame, query: str) -> DataFrame:
    """id, stage of products in the first stage that finds any: 1 exact code, 2 exact name, 3 name that holds all words."""
    words = [t for token in query_terms(query) for t in token]
    q = norm(F.lit(query))
    n = index_terms(F.col("name"))
    stage = F.when(F.upper(F.trim("code")) == F.upper(F.trim(F.lit(query))), 1).when(norm(F.col("name")) == q, 2).when(F.forall(F.array(*map(F.lit, words)), lambda t: F.array_contains(n, t)) if words else F.lit(False), 3)
    found = products.filter(~F.col("archived")).select("id", stage.alias("stage")).filter("stage is not null")
    first = found.agg(F.min("stage").alias("stage"))
    return found.join(F.broadcast(first), "stage").select("id", "stage")


# Hosts that are no source for materials, words of industry, words of product pages, and parts of fitting hosts.
BLOCKED = ["stackoverflow.com", "developer.mozilla.org", "w3schools.com", "freecodecamp.org", "geeksforgeeks.org", "github.com", "gitlab.com", "npmjs.com", "python.org", "microsoft.com", "learn.microsoft.com"]
INDUSTRIAL = ["aco", "inox", "inoxidavel", "aisi", "chapa", "tubo", "barra", "cantoneira", "flange", "parafuso", "porca", "arruela", "rebite", "bucha", "valvula", "conexao", "niple", "cotovelo", "eletroduto", "tomada", "plugue", "cabo", "mangueira", "rolamento", "retentor", "tigre", "weg", "tramontina", "3m", "scotch", "316", "316l", "304", "304l", "1020", "1045", "a36", "galvanizado", "carbono", "pvc", "mm", "pol"]
PREFERRED = ["catalogo", "ficha", "tecnica", "datasheet", "produto", "industrial", "aco", "inox", "fornecedor", "distribuidor", "fabricante", "metal", "metais", "siderurgica", "parafuso", "ferragem", "chapa"]
HOST_WORDS = ["metal", "aco", "inox", "ferr", "paraf", "industrial", "catalogo"]


def blocked(url: Column) -> Column:
    h = host(url)
    cond = h.isin(*BLOCKED)
    for d in BLOCKED:
        cond = cond | h.endswith("." + d)
    return cond


def web_rank(results: DataFrame, query: str) -> DataFrame:
    """url, score, confidence of usable results (url, title, snippet), one per url: 12 a shared word, 18 an industrial one, 8 a
    preferred one, 18 for a fitting host; under 18 they are left out if the query is industrial."""
    word = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1)), lambda t: F.length(t) > 1)
    q = word(norm(F.lit(query)))
    h = host(F.col("url"))
    w = word(norm(F.concat_ws(" ", F.lit(query), "title", "snippet", h)))
    const = lambda xs: F.array(*map(F.lit, xs))
    fitting = F.exists(const(HOST_WORDS), lambda x: F.contains(h, x))
    score = 12 * F.size(F.array_intersect(q, w)) + 18 * F.size(F.array_intersect(w, const(INDUSTRIAL))) + 8 * F.size(F.array_intersect(w, const(PREFERRED))) + F.when(fitting, 18).otherwise(0)
    industrial = F.arrays_overlap(q, const(INDUSTRIAL))
    usable = results.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & ~blocked(F.col("url")))
    scored = usable.select("url", score.alias("score"), F.when(score >= 70, "alta").when(score >= 38, "média").otherwise("baixa").alias("confidence"), industrial.alias("ind")).filter(~F.col("ind") | (F.col("score") >= 18)).drop("ind")
    return scored.groupBy("url").agg(F.max(F.struct("score", "confidence")).alias("m")).select("url", "m.score", "m.confidence")


def grouped(found: DataFrame) -> DataFrame:
    """Search results by family and name: family, name, n, best (the most offers, then the latest date, then id). found: products."""
    w = Window.partitionBy("family", "name").orderBy(F.col("offer_count").desc(), F.col("current_offer_date").desc_nulls_last(), "id")
    r = found.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("family", "name")))
    return r.filter("rn = 1").select("family", "name", "n", F.col("id").alias("best"))


def facets(products: DataFrame, links: DataFrame, events: DataFrame, family: str | None = None, supplier: str | None = None, manufacturer: str | None = None) -> DataFrame:
    """Active products of a family, of a supplier by link or offer, and whose manufacturer holds a text; a facet of None is no filter."""
    out = products.filter(~F.col("archived"))
    if family is not None:
        out = out.filter(F.col("family") == family)
    if manufacturer is not None:
        out = out.filter(F.contains(norm(F.col("manufacturer")), norm(F.lit(manufacturer))))
    if supplier is not None:
        rel = links.filter(F.trim("supplier_id") == supplier).select("product_id").union(events.filter(F.trim("supplier_id") == supplier).select("product_id"))
        out = out.join(rel.select(F.col("product_id").alias("id")), "id", "left_semi")
    return out
