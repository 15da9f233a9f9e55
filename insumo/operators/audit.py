"""Audits of the catalogue: counts, duplicates, coverage, quality, scores, queues. Every report's order is total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.functions.norms import norm, norm_audit, squeeze
from insumo.functions.numbers import iso_date, rounded
from insumo.operators.history import current_offers, days_since, positive


def strings(json: Column) -> Column:
    """A JSON list of strings; NULL and what is none become empty."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def index_counts(products: DataFrame, suppliers: DataFrame, events: DataFrame) -> DataFrame:
    """One row: active products, suppliers, priced events, active products without a price."""
    p = products.agg(F.count_if(~F.col("archived")).alias("products"), F.count_if(~F.col("archived") & F.col("current_price").isNull()).alias("products_without_price"))
    return p.crossJoin(suppliers.agg(F.count("*").alias("suppliers"))).crossJoin(positive(events).agg(F.count("*").alias("price_events")))


def duplicate_codes(products: DataFrame, most: int = 20) -> DataFrame:
    """The codes borne by most products: a top-k report."""
    return products.filter("code <> ''").groupBy("code").agg(F.count("*").alias("c")).filter("c > 1").orderBy(F.col("c").desc(), "code").limit(most)


def top_suppliers(events: DataFrame, most: int = 20) -> DataFrame:
    named = events.filter("supplier_name <> ''").groupBy("supplier_name").agg(F.count("*").alias("c"), F.countDistinct("product_id").alias("products"))
    return named.orderBy(F.col("c").desc(), "supplier_name").limit(most)


def shared_codes(products: DataFrame) -> DataFrame:
    """code, count of every normal form of a code (own or external, three characters or more) on more than one product."""
    codes = F.array_distinct(F.transform(F.concat(F.array(F.coalesce("code", F.lit(""))), strings(F.col("external_codes_json"))), norm))
    each = products.select("id", F.explode(codes).alias("code")).filter(F.length("code") >= 3).distinct()
    return each.groupBy("code").agg(F.count("*").alias("count")).filter(F.col("count") > 1)


def duplicate_names(products: DataFrame) -> DataFrame:
    """family_key, name_key, count of names that several products of a family bear."""
    keyed = products.select(norm_audit(F.col("family")).alias("family_key"), norm_audit(F.col("name")).alias("name_key")).filter("name_key <> ''")
    return keyed.groupBy("family_key", "name_key").agg(F.count("*").alias("count")).filter(F.col("count") > 1)


def family_medians(products: DataFrame, events: DataFrame) -> DataFrame:
    """family_key, n, median of the current prices of its products."""
    cur = current_offers(events).select(F.col("product_id").alias("id"), "final_price")
    return products.select("id", norm_audit(F.col("family")).alias("family_key")).join(cur, "id").groupBy("family_key").agg(F.count("*").alias("n"), rounded(F.median("final_price"), 4).alias("median_price"))


def product_medians(events: DataFrame) -> DataFrame:
    return positive(events).groupBy("product_id").agg(rounded(F.median("final_price"), 4).alias("median_price"), F.count("*").alias("n"))


def supplier_coverage(suppliers: DataFrame, events: DataFrame) -> DataFrame:
    """key, offers, products, total of each supplier, those without offers too; an offer without supplier id counts for its name."""
    named = events.withColumn("key", F.coalesce(F.nullif(F.trim("supplier_id"), F.lit("")), F.nullif("supplier_name", F.lit("")))).filter("key is not null")
    price = F.nanvl("final_price", F.lit(0.0))
    used = named.groupBy("key").agg(F.count("*").alias("offers"), F.countDistinct("product_id").alias("products"), rounded(F.sum(F.when(price > 0, price).otherwise(0.0)), 2).alias("total"))
    return suppliers.select(F.col("id").alias("key")).join(used, "key", "full").select("key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("offers", "products", "total")))


def family_report(products: DataFrame, events: DataFrame) -> DataFrame:
    """family, n, with_price, without_price, last_date of active products."""
    cur = current_offers(events).select(F.col("product_id").alias("id"), "updated_at")
    joined = products.filter(~F.col("archived")).select("id", F.coalesce("family", F.lit("")).alias("family")).join(cur, "id", "left")
    return joined.groupBy("family").agg(F.count("*").alias("n"), F.count("updated_at").alias("with_price"), F.count_if(F.col("updated_at").isNull()).alias("without_price"), F.max("updated_at").alias("last_date"))


def supplier_use(events: DataFrame) -> DataFrame:
    named = positive(events).filter("supplier_name <> ''")
    return named.groupBy("supplier_name").agg(F.count("*").alias("events"), F.countDistinct("product_id").alias("products"), rounded(F.sum("final_price"), 2).alias("total"), F.max("updated_at").alias("last_date"))


def health(statuses: DataFrame) -> DataFrame:
    """One row: products with a fresh, a stale and no price. statuses: product_id, status."""
    return statuses.agg(F.count_if(F.col("status").isin("dated", "undated")).alias("fresh"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "missing").alias("missing"))


def categories(products: DataFrame) -> DataFrame:
    """family_key, name (the least spelling), n."""
    keyed = products.select(norm_audit(F.col("family")).alias("family_key"), "family").filter("family_key <> ''")
    return keyed.groupBy("family_key").agg(F.min("family").alias("name"), F.count("*").alias("n"))


def search_rollup(searches: DataFrame, broad: int = 100) -> DataFrame:
    """Per normalised query: uses, times without result, times with many, last; rank weight zero * 10 + broad + uses. searches: normalized, count, at."""
    out = searches.groupBy("normalized").agg(F.count("*").alias("uses"), F.count_if(F.col("count") == 0).alias("zero"), F.count_if(F.col("count") >= broad).alias("broad"), F.max("at").alias("last"))
    return out.withColumn("weight", F.col("zero") * 10 + F.col("broad") + F.col("uses"))


# Parts of a reason's normal form, the group that they tell (the first that fits holds), and how grave each group is.
ISSUE_GROUPS = [("duplicate", ["codigo aparece"]), ("date", ["data"]), ("name", ["nome", "medida", "polos incomum"]), ("missingPrice", ["sem preco"]), ("missingCode", ["sem codigo"])]
SEVERITIES = {"duplicate": "critical", "date": "critical", "name": "warning", "missingPrice": "info", "missingCode": "info", "other": "warning"}


def issue_group(low: Column) -> Column:
    """The group of a reason in its normal form."""
    return F.coalesce(*(F.when(low.contains(p), F.lit(k)) for k, parts in ISSUE_GROUPS for p in parts), F.lit("other"))


def severity(group: Column) -> Column:
    return F.coalesce(*(F.when(group == k, F.lit(v)) for k, v in SEVERITIES.items()), F.lit("warning"))


def grave_issues(reasons: DataFrame) -> DataFrame:
    """One row: reasons (column reason) of critical and of warning groups, and both."""
    forms = reasons.select(F.explode(F.array(norm(F.col("reason")))).alias("low")).select(F.explode(F.array(severity(issue_group(F.col("low"))))).alias("level"))
    level = F.col("level")
    return forms.agg(F.count_if(level == "critical").alias("critical"), F.count_if(level == "warning").alias("warning"), F.count_if(level.isin("critical", "warning")).alias("grave"))


def unresolved(reasons: Column, resolved: Column) -> Column:
    """Reasons that aren't resolved, repeated ones kept."""
    return F.filter(reasons, lambda r: ~F.array_contains(F.coalesce(resolved, F.array().cast("array<string>")), r))


def issue_counts(events: DataFrame) -> DataFrame:
    """Per group of issues: events that have one, and how often, from the JSON list of each event's issues."""
    each = events.select("id", F.explode(strings(F.col("quality_json"))).alias("reason")).select("id", F.explode(F.array(norm(F.col("reason")))).alias("low")).select("id", issue_group(F.col("low")).alias("issue_group"))
    return each.groupBy("issue_group").agg(F.countDistinct("id").alias("events"), F.count("*").alias("issues"))


def quality_flags(products: DataFrame, statuses: DataFrame) -> DataFrame:
    """id, flag, level of each product's shortcomings. statuses: product_id, status."""
    p = products.join(statuses.withColumnRenamed("product_id", "id"), "id", "left")
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    flag = lambda cond, code, level: F.when(cond, F.struct(F.lit(code).alias("flag"), F.lit(level).alias("level")))
    no_specs = F.size(F.coalesce(F.from_json("specs_json", "array<struct<label:string,value:string>>"), F.array().cast("array<struct<label:string,value:string>>"))) == 0
    flags = F.array_compact(F.array(
        flag(empty(F.col("code")) & (F.size(strings(F.col("external_codes_json"))) == 0), "missing-code", "info"),
        flag(F.col("status") == "missing", "missing-price", "warning"),
        flag(F.col("status") == "stale", "stale", "warning"),
        flag(empty(F.col("manufacturer")), "missing-brand", "info"),
        flag(no_specs, "missing-specs", "info"),
        flag(F.col("needs_review"), "needs-review", "critical"),
    ))
    return p.select("id", F.explode(flags).alias("f")).select("id", "f.flag", "f.level")


def completeness(products: DataFrame) -> DataFrame:
    """id, percent of eight fields that are filled (half up), and the names of the missing ones, sorted."""
    filled = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("code", "name", "family", "subcategory", "unit", "manufacturer")}
    filled["price"] = F.coalesce(F.col("current_price"), F.lit(0.0)) > 0
    filled["specs"] = F.size(F.coalesce(F.from_json("specs_json", "array<struct<label:string,value:string>>"), F.array().cast("array<struct<label:string,value:string>>"))) > 0
    n = reduce(lambda a, b: a + b, (c.cast("int") for c in filled.values()))
    missing = F.array_sort(F.array_compact(F.array(*(F.when(~c, F.lit(k)) for k, c in filled.items()))))
    return products.select("id", F.floor(n * 100 / 8 + 0.5).cast("int").alias("percent"), F.array_join(missing, ",").alias("missing"))


def catalogue_score(products: DataFrame, events: DataFrame, as_of: str, supplier_pairs: DataFrame, stale_days: int = 180, caps: tuple[int, int] = (100, 100)) -> DataFrame:
    """One row: score 0..100 (half to even) = 100 - 45 x share without price - 35 x share stale - 2 per shared code - 1 per supplier
    pair, the latter two counted up to their caps."""
    cur = current_offers(events).select(F.col("product_id").alias("id"), "updated_at")
    age = days_since(iso_date(F.col("updated_at")), F.lit(as_of).cast("date"))
    base = products.select("id").join(cur, "id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("updated_at").isNull()).alias("no_price"), F.count_if(age > stale_days).alias("stale"))
    dup = shared_codes(products).limit(caps[0]).agg(F.count("*").alias("dup_codes"))
    sup = supplier_pairs.limit(caps[1]).agg(F.count("*").alias("supplier_pairs"))
    total = F.greatest(F.lit(1), F.col("total"))
    score = 100 - F.col("no_price") / total * 45 - F.col("stale") / total * 35 - 2 * F.col("dup_codes") - F.col("supplier_pairs")
    return base.crossJoin(dup).crossJoin(sup).select("total", "no_price", "stale", "dup_codes", "supplier_pairs", F.bround(F.greatest(F.lit(0.0), score), 0).cast("long").alias("score"))


def mean_score(flags: DataFrame, products: DataFrame) -> DataFrame:
    """One row: mean of four parts of 100 (with price, not stale, with code, with brand), half up."""
    n = products.agg(F.count("*").alias("n"))
    have = flags.groupBy().agg(*(F.countDistinct(F.when(F.col("flag") == f, F.col("id"))).alias(f.replace("-", "_")) for f in ("missing-price", "stale", "missing-code", "missing-brand")))
    part = lambda c: F.greatest(F.lit(0.0), 100 - 100 * F.col(c) / F.greatest(F.lit(1), F.col("n")))
    return n.crossJoin(have).select("n", F.floor((part("missing_price") + part("stale") + part("missing_code") + part("missing_brand")) / 4 + 0.5).cast("long").alias("score"))


def audit_queue(flags: DataFrame, slices: tuple[tuple[str, str, int], ...] = (("needs-review", "P0", 20), ("missing-price", "P1", 20), ("stale", "P1", 25), ("missing-code", "P2", 25), ("missing-specs", "P3", 25)), most: int = 100) -> DataFrame:
    """The queue of work: the first rows of each slice by id, slices in order, at most `most` rows; priority and position."""
    parts = [flags.filter(F.col("flag") == f).orderBy("id").limit(n).select(F.lit(i).alias("slice"), F.lit(p).alias("priority"), "flag", "id") for i, (f, p, n) in enumerate(slices)]
    whole = reduce(DataFrame.unionByName, parts).orderBy("slice", "id").limit(most)
    return whole.withColumn("position", F.row_number().over(Window.orderBy("slice", "id"))).select("position", "priority", "flag", "id")


def document_frequency(docs: DataFrame, words: Column) -> DataFrame:
    """token, df, idf = ln(1 + (N + 1) / (df + 1)) over token sets."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(1 + (F.col("n") + 1) / (F.col("df") + 1)), 6).alias("idf"))


def code_numbering(products: DataFrame) -> DataFrame:
    """family_key, prefix, next: a family's most frequent code prefix (one to six letters before a number; ties: the least; without any,
    the first two letters of its least name, or MA) and the number after the largest that any product's code has with that prefix."""
    pattern = r"^([A-Za-z]{1,6})[-_. ]?(\d+)$"
    code, family = F.trim(F.coalesce("code", F.lit(""))), squeeze(F.coalesce("family", F.lit("")))
    p = products.select(norm_audit(F.col("family")).alias("family_key"), family.alias("family"), F.upper(F.regexp_extract(code, pattern, 1)).alias("prefix"), F.regexp_extract(code, pattern, 2).try_cast("long").alias("number"))
    by = p.groupBy("family_key", "prefix").agg(F.count("*").alias("n"), F.max("number").alias("last"), F.min("family").alias("family"))
    last = by.filter("prefix <> ''").groupBy("prefix").agg(F.max("last").alias("last"))
    # rows without such a code count least
    top = Window.partitionBy("family_key").orderBy((F.col("prefix") != "").desc(), F.col("n").desc(), "prefix")
    mark = F.coalesce(F.nullif(F.col("prefix"), F.lit("")), F.nullif(F.upper(F.substring("family", 1, 2)), F.lit("")), F.lit("MA"))
    return by.drop("last").withColumn("rn", F.row_number().over(top)).filter("rn = 1").withColumn("prefix", mark).join(last, "prefix", "left").select("family_key", "prefix", (F.coalesce("last", F.lit(0)) + 1).alias("next"))


def numbered(products: DataFrame) -> DataFrame:
    """id, new_code of products without code: their family's prefix and a number from its next on, in order of family and id over all
    families with that prefix, so no code is given twice and none is in use. Bare products are ranked by (prefix, family), then shifted by
    the families before, so no prefix is one task."""
    rules = code_numbering(products)
    bare = products.filter(F.trim(F.coalesce("code", F.lit(""))) == "").select("id", norm_audit(F.col("family")).alias("family_key")).join(rules, "family_key")
    sizes = bare.groupBy("prefix", "family_key").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("prefix").orderBy("family_key")) - F.col("n")).select("family_key", "before")
    rank = F.row_number().over(Window.partitionBy("family_key").orderBy("id"))
    return bare.join(before, "family_key").select("id", F.concat("prefix", F.lit("-"), F.lpad((F.col("next") + F.col("before") + rank - 1).cast("string"), 3, "0")).alias("new_code"))


def supplier_relations(links: DataFrame, events: DataFrame) -> DataFrame:
    """supplier_id, products, quoted, listed: distinct products by any relation, by an offer or quoted link, by a listed link."""
    rel = links.select("supplier_id", "product_id", "kind").union(events.select("supplier_id", "product_id", F.lit("quoted"))).withColumn("supplier_id", F.trim("supplier_id")).filter("supplier_id <> ''").distinct()
    return rel.groupBy("supplier_id").agg(F.countDistinct("product_id").alias("products"), F.countDistinct(F.when(F.col("kind") == "quoted", F.col("product_id"))).alias("quoted"), F.countDistinct(F.when(F.col("kind") == "listed", F.col("product_id"))).alias("listed"))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Insert-or-ignore: the first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def retained(rows: DataFrame, order: list, n: int, by: list[str] | None = None) -> DataFrame:
    """The newest n rows (of each key)."""
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def brand_counts(products: DataFrame) -> DataFrame:
    """brand_key, name (the least spelling), n of products by the normal form of their maker."""
    b = products.select(norm(F.col("manufacturer")).alias("brand_key"), "manufacturer").filter("brand_key <> ''")
    return b.groupBy("brand_key").agg(F.min("manufacturer").alias("name"), F.count("*").alias("n"))


def supplier_directory(suppliers: DataFrame, text: str, most: int = 80) -> DataFrame:
    """Suppliers with products whose name, e-mail, phone or aliases hold a text; by name and id."""
    hay = norm(F.concat_ws(" ", "name", "email", "phone", F.concat_ws(" ", strings(F.col("aliases_json")))))
    return suppliers.filter((F.col("product_count") > 0) & F.contains(hay, norm(F.lit(text)))).select("id", "name", "product_count").orderBy("name", "id").limit(most)


def suggested_suppliers(events: DataFrame, products: DataFrame, most: int = 5) -> DataFrame:
    """product_id, rank_no, supplier_id: who to ask for a product: its own suppliers first, then those of its family by products, ties by id."""
    own = events.filter("trim(supplier_id) <> ''").select("product_id", "supplier_id").distinct()
    fam = own.join(products.select(F.col("id").alias("product_id"), norm_audit(F.col("family")).alias("family_key")), "product_id")
    w = Window.partitionBy("family_key").orderBy(F.col("n").desc(), "supplier_id")
    best = fam.groupBy("family_key", "supplier_id").agg(F.countDistinct("product_id").alias("n")).withColumn("r", F.row_number().over(w))
    per = fam.join(best.select("family_key", "supplier_id", "n"), ["family_key", "supplier_id"]).select("product_id", "supplier_id", F.lit(1).alias("own"), "n")
    others = products.select(F.col("id").alias("product_id"), norm_audit(F.col("family")).alias("family_key")).join(best.filter(F.col("r") <= most), "family_key").select("product_id", "supplier_id", F.lit(0).alias("own"), "n")
    every = per.union(others).groupBy("product_id", "supplier_id").agg(F.max("own").alias("own"), F.max("n").alias("n"))
    top = Window.partitionBy("product_id").orderBy(F.col("own").desc(), F.col("n").desc(), "supplier_id")
    return every.withColumn("rank_no", F.row_number().over(top)).filter(F.col("rank_no") <= most).select("product_id", "rank_no", "supplier_id")


def export_sheets(products: DataFrame, suppliers: DataFrame, events: DataFrame, flags: DataFrame) -> dict[str, DataFrame]:
    """The sheets of the catalogue's export: catalogue, last three prices, history, suppliers with products, open issues."""
    from insumo.operators.history import history, last_prices

    cur = current_offers(events).select(F.col("product_id").alias("id"), F.col("final_price").alias("price"), F.col("updated_at").alias("date"), "supplier_name")
    return {
        "Catalogo": products.filter(~F.col("archived")).select("id", "code", "name", "family", "unit", "manufacturer").join(cur, "id", "left").orderBy("id"),
        "Ultimos precos": last_prices(events, 3).orderBy("product_id"),
        "Historico": history(events).select("product_id", "ordinal", "updated_at", "supplier_name", "final_price").orderBy("product_id", "ordinal"),
        "Fornecedores": suppliers.filter("product_count > 0").select("id", "name", "email", "phone", "product_count").orderBy("id"),
        "Pendencias": flags.orderBy("id", "flag"),
    }
