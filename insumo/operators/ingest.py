"""From sheets, invoices and typed lines to reviewed changes of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.functions.norms import compact, norm, norm_audit, squeeze
from insumo.functions.numbers import last_amount, loose_number, percent, sheet_date, within
from insumo.operators.history import import_price
from insumo.sources.shared import saved

# How a heading (normal form) names each role, in the order in which a cell is tried.
HEADINGS = [
    ("code", r"cod(?:igo)?|ref(?:erencia)?|part[-_]?number"), ("name", "descricao|material|produto|nome|item"),
    ("base_price", r"preco\s*(?:base|unitario|bruto)?|valor\s*(?:base|unitario|bruto)?|val\.\s*unit"), ("final_price", r"preco\s*(?:final|liquido)?|valor\s*(?:final|liquido)?"),
    ("supplier", "fornecedor|empresa|vendedor|distribuidor"), ("date", "data|atualizado|compra"), ("ipi", "ipi"), ("adjustment", "ajuste|acrescimo|desconto"), ("quantity", "quantidade|qtd|divisor|embalagem|conversao"),
]
#: Rows of a sheet in which a heading is looked for; rows above that a missing name may come from.
HEAD_ROWS, CARRY_ROWS = 30, 6
NOUN = r"\b(?:parafuso|porca|arruela|chapa|tubo|cabo|valvula|motor|tinta|mangueira|eletrodo|graxa|luva|barra|cantoneira|flange|conexao|rolamento|disco|broca|fita|rebite|cola|adesivo|lixa|filtro|correia|oleo)\w*"


def cells(sheet: DataFrame) -> DataFrame:
    """sheet, row_idx, col_idx, value of sheets (sheet, row_idx, cells array)."""
    return sheet.select("sheet", "row_idx", F.posexplode("cells").alias("col_idx", "value"))


def headings(sheet: DataFrame) -> DataFrame:
    """sheet, header_row, role, col_idx: in the first of the sheet's first rows that names a name and a price, the columns of each role.

    A cell takes the first role that fits and is still free in its row; so a lone `preço` is the base price."""
    c = cells(sheet.filter(F.col("row_idx") < HEAD_ROWS)).withColumn("h", norm(F.col("value"))).filter("h <> ''")
    fits = F.array_compact(F.array(*(F.when(F.col("h").rlike(p), F.struct(F.lit(i).alias("i"), F.lit(r).alias("role"))) for i, (r, p) in enumerate(HEADINGS))))
    row = c.select("sheet", "row_idx", "col_idx", fits.alias("fits")).filter(F.size("fits") > 0).groupBy("sheet", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "fits"))).alias("cs"))
    taken = F.aggregate("cs", F.array().cast("array<struct<role:string,col_idx:int>>"), lambda acc, x: F.coalesce(F.concat(acc, F.transform(F.slice(F.filter(x["fits"], lambda f: ~F.exists(acc, lambda t: t["role"] == f["role"])), 1, 1), lambda f: F.struct(f["role"].alias("role"), x["col_idx"].alias("col_idx")))), acc))
    r = row.withColumn("t", taken)
    has = lambda *roles: F.exists("t", lambda x: x["role"].isin(*roles))
    first = r.filter(has("name") & has("base_price", "final_price")).groupBy("sheet").agg(F.min(F.struct("row_idx", "t")).alias("m"))
    return first.select("sheet", F.col("m.row_idx").alias("header_row"), F.explode("m.t").alias("x")).select("sheet", "header_row", "x.role", "x.col_idx")


def column_kinds(sheet: DataFrame) -> DataFrame:
    """sheet, col_idx and counts of empty, date, number, float, short and text cells in the first rows."""
    c = cells(sheet.filter(F.col("row_idx") < HEAD_ROWS))
    v = F.trim("value")
    num = F.replace(F.regexp_replace(v, r"R\$|\s", ""), F.lit(","), F.lit(".")).try_cast("double")
    kind = F.when(F.coalesce(v, F.lit("")) == "", "empty").when(sheet_date(v).isNotNull(), "date").when(num > 0, "number").when(F.length(v) <= 15, "short").otherwise("text")
    c = c.withColumn("kind", kind).withColumn("whole", num == F.floor(num))
    return c.groupBy("sheet", "col_idx").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("empty", "date", "number", "short", "text")), F.count_if((F.col("kind") == "number") & ~F.col("whole")).alias("float"))


def inferred_columns(sheet: DataFrame) -> DataFrame:
    """sheet, role, col_idx without headings: the name has the most text, the price the most (broken) numbers, a code is the first
    short column before the name, the date has the most dates, the supplier the most short or long text of the rest."""
    k = column_kinds(sheet)
    used: list[tuple[str, DataFrame]] = []

    def pick(role: str, score: Column, order: Column | None = None, extra: Column | None = None) -> DataFrame:
        rest = k
        for _, d in used:
            rest = rest.join(d.select("sheet", "col_idx"), ["sheet", "col_idx"], "left_anti")
        if extra is not None:
            rest = rest.join(used[0][1].select("sheet", F.col("col_idx").alias("name_col")), "sheet").filter(extra)
        w = Window.partitionBy("sheet").orderBy(*([order] if order is not None else [F.col("_s").desc()]), "col_idx")
        return rest.withColumn("_s", score).filter("_s > 0").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("sheet", F.lit(role).alias("role"), "col_idx")

    used.append(("name", pick("name", F.col("text") * 1000 + F.when(F.col("text") > 0, 0).otherwise(F.col("short")))))
    used.append(("base_price", pick("base_price", F.col("number") + 2 * F.col("float"))))
    used.append(("code", pick("code", F.col("short"), F.col("col_idx"), F.col("col_idx") < F.col("name_col"))))
    used.append(("date", pick("date", F.col("date"))))
    used.append(("supplier", pick("supplier", F.col("short") + F.col("text"))))
    out = used[0][1]
    for _, d in used[1:]:
        out = out.unionByName(d)
    return out


def legacy_layout(sheets: DataFrame, known: list[str], least: int = 8) -> DataFrame:
    """One row: whether at least so many sheets bear known names, which means fixed columns."""
    return sheets.select("sheet").distinct().agg((F.count_if(F.col("sheet").isin(*known)) >= least).alias("legacy"))


def table_rows(sheet: DataFrame, columns: DataFrame) -> DataFrame:
    """sheet, row_idx and a text column for each role, below the heading. columns: sheet, header_row, role, col_idx."""
    m = columns.groupBy("sheet", "header_row").agg(F.map_from_entries(F.collect_list(F.struct("role", "col_idx"))).alias("m"))
    j = sheet.join(m, "sheet").filter(F.col("row_idx") > F.col("header_row"))
    at = lambda r: F.when(F.col("m")[r].isNotNull(), F.get("cells", F.col("m")[r]))
    return j.select("sheet", "row_idx", *(at(r).alias(r) for r, _ in HEADINGS))


def carried_names(rows: DataFrame) -> DataFrame:
    """rows with `context`: their name if it has a noun of the trade, else the last such of the rows just above."""
    named = F.when(norm(F.col("name")).rlike(NOUN), squeeze(F.col("name")))
    # a sheet may be very long, so its normal forms are computed before its rows come together, each once
    w = Window.partitionBy("sheet").orderBy("row_idx").rowsBetween(-CARRY_ROWS, 0)
    return rows.withColumn("_named", named).withColumn("context", F.last("_named", ignorenulls=True).over(w)).drop("_named")


def preview(rows: DataFrame, products: DataFrame, events: DataFrame) -> DataFrame:
    """sheet, row_idx, product_id, price, day, outcome of imported rows (table_rows): dropped, skipped (no price, no date, repeated,
    no valid name), review (a code of several products), unchanged (such an offer exists), update, newProduct.

    Products are found by their code alone if only one bears it, by code and name, or by name if only one bears it: equi-joins
    on keys aggregated before. Of equal rows of a sheet the first counts. Same offer: the price within half a cent and the
    day, or no day given."""
    day = sheet_date(F.col("date"))
    n = lambda c: F.coalesce(loose_number(F.col(c)), F.lit(0.0))
    r = carried_names(rows).withColumns({
        "code_key": norm(F.col("code")), "name_key": norm(F.coalesce("context", "name")), "day": day,
        "price": F.round(import_price(n("final_price"), n("base_price"), percent(n("ipi")), percent(n("adjustment")), F.when(n("quantity") > 0, n("quantity")).otherwise(1.0)), 4),
    })
    p = products.select("id", norm(F.col("code")).alias("code_key"), norm(F.col("name")).alias("name_key"))
    by = lambda *keys: p.filter(" and ".join(f"{k} <> ''" for k in keys)).groupBy(*keys).agg(F.min("id").alias(f"by_{len(keys)}_{keys[0]}"), F.count("*").alias(f"n_{len(keys)}_{keys[0]}"))
    r = r.join(by("code_key"), "code_key", "left").join(by("code_key", "name_key"), ["code_key", "name_key"], "left").join(by("name_key"), "name_key", "left")
    pid = F.when(F.col("n_1_code_key") == 1, F.col("by_1_code_key")).when(F.col("n_2_code_key") == 1, F.col("by_2_code_key")).when(F.col("n_1_code_key").isNull() & (F.col("n_1_name_key") == 1), F.col("by_1_name_key"))
    r = saved(r.withColumn("product_id", pid).withColumn("ambiguous", (F.col("n_1_code_key") > 1) & pid.isNull()), "import-rows")
    # prices within half a cent lie in one step of half a cent or in the next, so a product of many rows and offers meets by its prices alone
    step = lambda c: F.floor(F.col(c) / 0.005)
    e = events.select("product_id", F.col("final_price").alias("old_price"), F.col("updated_at").alias("old_day")).filter("old_price is not null")
    x = r.filter("product_id is not null").select("sheet", "row_idx", "product_id", "price", F.date_format("day", "yyyy-MM-dd").alias("old_day")).distinct()
    x = x.select("*", F.explode(F.array(*(step("price") + k for k in (-1, 0, 1)))).alias("step"))
    hit = lambda days, keys: x.filter(f"old_day is {'not ' if days else ''}null").drop(*(() if days else ("old_day",))).join(e.select("product_id", "old_price", *(("old_day",) if days else ())).distinct().withColumn("step", step("old_price")).hint("merge"), keys).filter(F.abs(F.col("price") - F.col("old_price")) < 0.005).select("sheet", "row_idx")
    same = hit(True, ["product_id", "old_day", "step"]).union(hit(False, ["product_id", "step"])).distinct().withColumn("same", F.lit(True))
    r = r.join(same, ["sheet", "row_idx"], "left")
    ok = (F.col("price") > 0) & ((F.coalesce(F.trim("date"), F.lit("")) == "") | F.col("day").isNotNull())
    sig = F.coalesce("product_id", F.when(F.col("code_key") != "", F.concat(F.lit("c:"), "code_key")), F.concat(F.lit("n:"), "name_key"))
    w = Window.partitionBy("sheet", sig, "price", "day", ok).orderBy("row_idx")
    r = r.withColumn("nth", F.row_number().over(w))
    empty = (F.col("code_key") == "") & (norm(F.col("name")) == "")
    outcome = (
        F.when(empty, "dropped").when(F.col("price") <= 0, "skipped").when(~ok, "skipped").when(F.col("ambiguous"), "review").when(F.col("nth") > 1, "skipped")
        .when(F.col("same"), "unchanged").when(F.col("product_id").isNotNull(), "update").when(~F.coalesce(F.col("name_key").rlike(NOUN), F.lit(False)), "skipped").otherwise("newProduct")
    )
    return r.select("sheet", "row_idx", "product_id", "price", "day", outcome.alias("outcome"))


def import_stats(previewed: DataFrame) -> DataFrame:
    return previewed.groupBy("outcome").agg(F.count("*").alias("n"))


def nfe_items(invoices: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows of invoice documents: supplier, cnpj, date, item_no, code, gtin, name, quantity, unit, unit_price, total."""
    clean = F.regexp_replace(F.col(xml), r"\sxmlns(?::\w+)?=\"[^\"]*\"", "")
    x = invoices.select("id", clean.alias("x"))
    text = lambda path: F.xpath_string("x", F.lit(path))
    n = F.xpath_int("x", F.lit("count(//det)"))
    item = x.select("id", "x", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("item_no"))
    # tags may be absent in some items, so each is read from its own item
    det = F.regexp_extract_all("x", F.lit(r"(?s)(<det\b.*?</det>)"), 1)
    item = item.withColumn("d", F.get(det, F.col("item_no") - 1))
    tag = lambda t: squeeze(F.xpath_string("d", F.lit(f"//{t}")))
    num = lambda t: F.replace(tag(t), F.lit(","), F.lit(".")).try_cast("double")
    quantity, unit_price = F.coalesce(num("qCom"), F.lit(1.0)), F.coalesce(num("vUnCom"), F.lit(0.0))
    when = F.coalesce(F.nullif(text("//ide/dhEmi"), F.lit("")), text("//ide/dEmi"))
    gtin = F.coalesce(F.nullif(tag("cEAN"), F.lit("")), F.nullif(tag("cEANTrib"), F.lit("")), F.lit(""))
    return item.select("id", "item_no", squeeze(text("//emit/xNome")).alias("supplier"), squeeze(text("//emit/CNPJ")).alias("cnpj"), F.try_to_date(F.substring(when, 1, 10), "yyyy-MM-dd").alias("date"), tag("cProd").alias("code"), gtin.alias("gtin"), tag("xProd").alias("name"), quantity.alias("quantity"), tag("uCom").alias("unit"), unit_price.alias("unit_price"), F.coalesce(num("vProd"), unit_price * quantity).alias("total")).filter("name <> '' or code <> ''")


def invoice_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, amount, description of each line of a text that ends with an amount."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), r"\n+")).alias("line_no", "line"))
    a = lines.withColumn("a", last_amount(F.trim("line"))).filter("a is not null")
    return a.select(key, "line_no", F.col("a.amount").alias("amount"), F.col("a.rest").alias("description"))


_QTY = r"(?i)\b(\d+(?:[.,]\d+)?)\s*(?:unidades?|unid|un|pcs|pçs|metros|m|barras|kg|litros|l)\b"
NEGATIVE = r"\b(?:nao comprar|recusado|cancelado|ignorar|nao salvar)\b"


def typed_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, quantity, price, supplier, description of purchase lines as people type them (5 un do cabo ... por R$ 4,50 do
    fornecedor X). Lines that say not to buy are left out; a missing quantity is 1, a missing price 0."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), r"\n+")).alias("line_no", "line")).withColumn("line", squeeze(F.col("line"))).filter(F.col("line") != "")
    lines = lines.filter(~norm_audit(F.col("line")).rlike(NEGATIVE))
    num = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    quantity = F.coalesce(num(F.nullif(F.regexp_extract("line", _QTY, 1), F.lit(""))), F.lit(1.0))
    money = F.coalesce(F.nullif(F.regexp_extract("line", r"(?i)(?:r\$|\$|brl)\s*(\d+(?:[.,]\d+)?)", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"(?i)\b(?:por|cada)\s*(\d+(?:[.,]\d+)?)", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"\b(\d+[.,]\d{2})\b", 1), F.lit("")))
    supplier = squeeze(F.regexp_extract("line", r"(?i)(?:fornecedor|empresa)\s+([^\d]{2,60})$", 1))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"(?i)\b(?:do )?(?:fornecedor|empresa)\s+[^\d]{2,60}$", " "), r"(?i)\b(?:por|a|cada)?\s*(?:r\$|\$|brl)\s*\d+(?:[.,]\d+)*", " "), _QTY, " ")
    rest = squeeze(F.regexp_replace(rest, r"(?i)\b(?:por|cada|de|da|do)\b", " "))
    return lines.select(key, "line_no", quantity.alias("quantity"), F.coalesce(num(money), F.lit(0.0)).alias("price"), supplier.alias("supplier"), rest.alias("description")).filter("description <> ''")


def code_matches(codes: DataFrame, products: DataFrame) -> DataFrame:
    """code, product_id (the least) of products that bear the code as their own or an external one."""
    ext = F.coalesce(F.from_json("external_codes_json", "array<string>"), F.array().cast("array<string>"))
    known = products.select("id", F.explode(F.concat(F.array("code"), ext)).alias("c")).select("id", squeeze(F.col("c")).alias("code")).filter("code <> ''")
    return codes.select(squeeze(F.col("code")).alias("code")).distinct().join(known, "code").groupBy("code").agg(F.min("id").alias("product_id"))


def same_offers(new: DataFrame, events: DataFrame) -> DataFrame:
    """new rows (product_id, price, day, supplier) that no stored offer equals: an anti-join on the product with a tolerance of half a cent."""
    e = events.select(F.col("product_id").alias("p"), F.col("final_price").alias("q"), F.col("updated_at").alias("d"), compact(norm(F.col("supplier_name"))).alias("s"))
    hit = (F.col("product_id") == F.col("p")) & (F.abs(F.col("price") - F.col("q")) < 0.005) & ((F.coalesce("day", F.lit("")) == "") | (F.col("day") == F.col("d"))) & (compact(norm(F.col("supplier"))) == F.col("s"))
    return new.join(e, hit, "left_anti")


def quarantine(price: Column, reference: Column, factor: float = 5.0, least: float = 0.01, most: float = 1e6) -> Column:
    """Reason to set a price aside against its history: invalid, low, high; NULL if none."""
    f = F.greatest(F.lit(1.2), F.lit(factor))
    return F.when(price.isNull() | (price <= 0), "invalid").when(price < least, "low").when(price > most, "high").when(price > reference * f, "high").when(price < reference / f, "low")


def near_measure(a: Column, b: Column) -> Column:
    return within(a, b, 0.3, 0.005)
