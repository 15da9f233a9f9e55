"""Queries of the catalogue's own operators over whole tables, and the same in SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.functions import norms, numbers
from insumo.functions.text import valid_date
from insumo.operators import audit, features, history, ingest, resolve, search, suppress
from insumo.sources.tables import table

AS_OF = "2026-06-30"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL for the check."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return history.price_events(table(spark, sf, "offers"))


# SQL of the pieces that several queries share
_EVENTS = "ev as (select * exclude (rn, updated_at), coalesce(updated_at, '') as updated_at from (select *, row_number() over (partition by id order by ingest_seq desc) as rn from offers where id is not null) where rn = 1)"
_NEWEST = f"{_EVENTS}, newest as (select *, row_number() over (partition by product_id order by updated_at desc, id desc) as rn from ev where final_price > 0), cur as (select * from newest where rn = 1)"


def _ascii(c: str) -> str:
    return f"lower(regexp_replace(strip_accents(translate(trim(regexp_replace(coalesce({c}, ''), '[\\s\\pZ]+', ' ', 'g')), '“”″’‘′×', '\"\"\"''''''x')), '[^\\x00-\\x7F]', '', 'g'))"


def _point(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '(\\d),(\\d)', '\\1.\\2', 'g'), '(\\d),(\\d)', '\\1.\\2', 'g')"


def _rounded(c: str, n: int) -> str:
    return f"floor(({c}) * {10**n} + 0.500001) / {10**n}"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s\\pZ]+', ' ', 'g'))"


def _norm(c: str) -> str:
    x = f"regexp_replace({_point(_ascii(c))}, '\\b(304|316|310|321|409|410|420|430|440)\\s+l\\b', '\\1l', 'g')"
    return _squeeze(f"regexp_replace({x}, '\\baco\\s+(?:inoxidavel|inox)\\b', 'inox', 'g')")


def _norm_index(c: str) -> str:
    x = f"regexp_replace({_point(_ascii(c))}, '\\baco\\s+(?:inoxidavel|inox)\\b', 'inox', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\bmilimetros?\\b', 'mm', 'g'), '\\bpolegadas?|\\bpol\\b', '\"', 'g')"
    return _squeeze(f"regexp_replace({x}, '[^a-z0-9#/+.''\" -]+', ' ', 'g')")


def _norm_audit(c: str) -> str:
    x = f"regexp_replace({_point(_ascii(c))}, '\\baco\\s+(?:inoxidavel|inox)\\b', 'inox', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\b(?:polegadas?|pol)\\b', '\"', 'g'), '\\bmilimetros?\\b', 'mm', 'g')"
    x = f"regexp_replace({x}, '\\b(?:metros?|mt)\\b', 'm', 'g')"
    return _squeeze(f"regexp_replace({x}, '[^a-z0-9#/+.\\-\" ]+', ' ', 'g')")


def _key(c: str) -> str:
    return _squeeze(f"regexp_replace(regexp_replace({_norm(c)}, '\\b(?:{norms.COMPANY_WORDS})\\b', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')")


def _json(c: str) -> str:
    return f"coalesce(try_cast(case when {c} like '[%' then {c} end as json)::varchar[], []::varchar[])"


# --- history -------------------------------------------------------------------------------------------------------------


@query(f"""with {_NEWEST}, two as (select product_id, max(final_price) filter (where rn = 1) as c, max(final_price) filter (where rn = 2) as p, max(updated_at) filter (where rn = 1) as cd, max(updated_at) filter (where rn = 2) as pd
  from newest where rn <= 2 group by 1)
select product_id, round_even((c - p) / p * 100, 2) as delta_pct, c as cur_price, p as prev_price, cd as cur_date, pd as prev_date from two where abs((c - p) / p * 100) >= 30""")
def wn2_price_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return history.price_alerts(_events(spark, sf))


@query(f"with {_NEWEST} select product_id, id as offer_id, supplier_id, final_price, updated_at from cur")
def wn1_current_offer(spark: SparkSession, sf: str) -> DataFrame:
    return history.current_offers(_events(spark, sf)).select("product_id", F.col("id").alias("offer_id"), "supplier_id", "final_price", "updated_at")


@query(f"""with {_NEWEST} select product_id, max(final_price) filter (where rn = 1) as price_1, max(updated_at) filter (where rn = 1) as date_1, max(final_price) filter (where rn = 2) as price_2,
  max(updated_at) filter (where rn = 2) as date_2, max(final_price) filter (where rn = 3) as price_3, max(updated_at) filter (where rn = 3) as date_3 from newest where rn <= 3 group by 1""")
def wn3_last_three(spark: SparkSession, sf: str) -> DataFrame:
    return history.last_prices(_events(spark, sf), 3)


@query(f"with {_EVENTS} select product_id, id, updated_at, final_price, cast(row_number() over (partition by product_id order by updated_at desc, ingest_seq desc) as integer) as ordinal from ev")
def wn4_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.history(_events(spark, sf)).select("product_id", "id", "updated_at", "final_price", "ordinal")


_STATUS = f"""{_NEWEST}, st as (select p.id as product_id, case when c.product_id is null then 'missing' when d is null then 'undated' when date '{AS_OF}' - d > 180 then 'stale' else 'dated' end as status, date '{AS_OF}' - d as days
  from product p left join (select *, case when regexp_matches(updated_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then try_cast(updated_at as date) end as d from cur) c on c.product_id = p.id)"""


@query(f"with {_STATUS} select product_id, status, cast(days as integer) as days from st")
def fil5_status(spark: SparkSession, sf: str) -> DataFrame:
    return history.status(table(spark, sf, "product"), _events(spark, sf), AS_OF)


@query(f"""with {_NEWEST}, d as (select product_id, final_price, updated_at, cast(date '{AS_OF}' - case when regexp_matches(updated_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then try_cast(updated_at as date) end as integer) as days from cur)
select * from d where days > 180""")
def prj6_stale(spark: SparkSession, sf: str) -> DataFrame:
    return history.staleness(_events(spark, sf), AS_OF)


@query(f"with {_EVENTS} select id, {_rounded("base_price * (1 + 5e0 / 100 + -2e0 / 100) / greatest(1, coalesce(quantity, 1))", 4)} as price from ev where base_price is not null")
def prj4_import_price(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).filter(F.col("base_price").isNotNull())
    return e.select("id", numbers.rounded(history.import_price(F.lit(0.0), F.col("base_price"), F.lit(5.0), F.lit(-2.0), F.coalesce("quantity", F.lit(1.0))), 4).alias("price"))


@query(f"with {_EVENTS} select id, {_rounded("case when coalesce(quantity, 1) > 0 then base_price * (1 + 10e0 / 100 + -5e0 / 100) / coalesce(quantity, 1) else 0 end", 4)} as price from ev where base_price is not null")
def prj3_price_formula(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).filter(F.col("base_price").isNotNull())
    return e.select("id", numbers.rounded(history.price_formula(F.col("base_price"), F.lit(10.0), F.lit(-5.0), F.coalesce("quantity", F.lit(1.0))), 4).alias("price"))


# --- audits --------------------------------------------------------------------------------------------------------------


@query(f"""with {_EVENTS} select (select count(*) from product where not archived) as products, (select count(*) from product where not archived and current_price is null) as products_without_price,
  (select count(*) from suppliers) as suppliers, (select count(*) from ev where final_price > 0) as price_events""")
def ag1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.index_counts(table(spark, sf, "product"), table(spark, sf, "suppliers"), _events(spark, sf))


@query("select code, count(*) as c from product where code <> '' group by 1 having count(*) > 1 order by c desc, code limit 20")
def ag2_dup_codes(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_codes(table(spark, sf, "product"))


@query(f"with {_EVENTS} select supplier_name, count(*) as c, count(distinct product_id) as products from ev where supplier_name <> '' group by 1 order by c desc, supplier_name limit 20")
def ag3_top_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return audit.top_suppliers(_events(spark, sf))


@query(f"""with e as (select distinct id, {_norm('c')} as code from (select id, unnest(list_concat([coalesce(code, '')], {_json('external_codes_json')})) as c from product))
select code, count(*) as count from e where length(code) >= 3 group by 1 having count(*) > 1""")
def ag4_dup_codes_multi(spark: SparkSession, sf: str) -> DataFrame:
    return audit.shared_codes(table(spark, sf, "product"))


@query(f"select {_norm_audit('family')} as family_key, {_norm_audit('name')} as name_key, count(*) as count from product group by 1, 2 having count(*) > 1 and {_norm_audit('name')} <> ''".replace(f"having count(*) > 1 and {_norm_audit('name')} <> ''", "having count(*) > 1 and name_key <> ''"))
def ag5_dup_names(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_names(table(spark, sf, "product"))


@query(f"with {_NEWEST} select {_norm_audit('p.family')} as family_key, count(*) as n, {_rounded('median(c.final_price)', 4)} as median_price from product p join cur c on c.product_id = p.id group by 1")
def ag6_family_median(spark: SparkSession, sf: str) -> DataFrame:
    return audit.family_medians(table(spark, sf, "product"), _events(spark, sf))


@query(f"with {_EVENTS} select product_id, {_rounded('median(final_price)', 4)} as median_price, count(*) as n from ev where final_price > 0 group by 1")
def ag6_product_median(spark: SparkSession, sf: str) -> DataFrame:
    return audit.product_medians(_events(spark, sf))


@query(f"""with {_EVENTS}, u as (select coalesce(nullif(trim(supplier_id), ''), nullif(supplier_name, '')) as key, count(*) as offers, count(distinct product_id) as products, {_rounded('sum(case when final_price > 0 then final_price else 0 end)', 2)} as total
  from ev where coalesce(nullif(trim(supplier_id), ''), nullif(supplier_name, '')) is not null group by 1)
select coalesce(s.id, u.key) as key, coalesce(offers, 0) as offers, coalesce(products, 0) as products, coalesce(total, 0.0) as total from suppliers s full join u on u.key = s.id""")
def ag7_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.supplier_coverage(table(spark, sf, "suppliers"), _events(spark, sf))


@query(f"with {_NEWEST} select coalesce(p.family, '') as family, count(*) as n, count(c.updated_at) as with_price, count(*) - count(c.updated_at) as without_price, max(c.updated_at) as last_date from product p left join cur c on c.product_id = p.id where not p.archived group by 1")
def ag8_family(spark: SparkSession, sf: str) -> DataFrame:
    return audit.family_report(table(spark, sf, "product"), _events(spark, sf))


@query(f"with {_EVENTS} select supplier_name, count(*) as events, count(distinct product_id) as products, {_rounded('sum(final_price)', 2)} as total, max(updated_at) as last_date from ev where final_price > 0 and supplier_name <> '' group by 1")
def ag9_supplier_use(spark: SparkSession, sf: str) -> DataFrame:
    return audit.supplier_use(_events(spark, sf))


@query(f"with {_STATUS} select count(*) filter (where status in ('dated', 'undated')) as fresh, count(*) filter (where status = 'stale') as stale, count(*) filter (where status = 'missing') as missing from st")
def ag10_health(spark: SparkSession, sf: str) -> DataFrame:
    return audit.health(fil5_status(spark, sf))


@query(f"select * from (select {_norm_audit('family')} as family_key, min(family) as name, count(*) as n from product group by 1) where family_key <> ''")
def ag11_categories(spark: SparkSession, sf: str) -> DataFrame:
    return audit.categories(table(spark, sf, "product"))


_SEARCHES = 's as (select event_type as normalized, cast(floor(value) as bigint) as n, ts as "at" from events)'


@query(f"with {_SEARCHES} select normalized, count(*) as uses, count(*) filter (where n = 0) as zero, count(*) filter (where n >= 100) as broad, max(\"at\") as last, count(*) filter (where n = 0) * 10 + count(*) filter (where n >= 100) + count(*) as weight from s group by 1")
def ag12_search_insights(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return audit.search_rollup(e.select(F.col("event_type").alias("normalized"), F.floor("value").cast("long").alias("count"), F.col("ts").alias("at")))


@query(f"""with {_EVENTS}, e as (select id, {_norm('r')} as r from (select id, unnest({_json('quality_json')}) as r from ev)), g as (select id, case when contains(r, 'codigo aparece') then 'duplicate' when contains(r, 'data') then 'date' when contains(r, 'nome') or contains(r, 'medida') or contains(r, 'polos incomum') then 'name'
  when contains(r, 'sem preco') then 'missingPrice' when contains(r, 'sem codigo') then 'missingCode' else 'other' end as issue_group from e)
select issue_group, count(distinct id) as events, count(*) as issues from g group by 1""")
def ag13_issue_groups(spark: SparkSession, sf: str) -> DataFrame:
    return audit.issue_counts(_events(spark, sf))


_FLAGS = f"""{_STATUS}, fl as (select p.id, unnest(list_filter([
  case when trim(coalesce(code, '')) = '' and len({_json('external_codes_json')}) = 0 then {{'f': 'missing-code', 'l': 'info'}} end,
  case when st.status = 'missing' then {{'f': 'missing-price', 'l': 'warning'}} end, case when st.status = 'stale' then {{'f': 'stale', 'l': 'warning'}} end,
  case when trim(coalesce(manufacturer, '')) = '' then {{'f': 'missing-brand', 'l': 'info'}} end,
  case when coalesce(json_array_length(try_cast(case when specs_json like '[%' then specs_json end as json)), 0) = 0 then {{'f': 'missing-specs', 'l': 'info'}} end,
  case when needs_review then {{'f': 'needs-review', 'l': 'critical'}} end], lambda x: x is not null)) as x from product p left join st on st.product_id = p.id)"""


@query(f"with {_FLAGS} select id, x.f as flag, x.l as level from fl")
def cls18_quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    return audit.quality_flags(table(spark, sf, "product"), fil5_status(spark, sf))


@query(f"""with {_EVENTS}, e as (select {_norm('r')} as r from (select unnest({_json('quality_json')}) as r from ev)), g as (select case when contains(r, 'codigo aparece') or contains(r, 'data') then 'critical'
  when contains(r, 'nome') or contains(r, 'medida') or contains(r, 'polos incomum') then 'warning' when contains(r, 'sem preco') or contains(r, 'sem codigo') then 'info' else 'warning' end as level from e)
select count(*) filter (where level = 'critical') as critical, count(*) filter (where level = 'warning') as warning, count(*) filter (where level <> 'info') as grave from g""")
def ag14_critical(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(F.explode(F.from_json("quality_json", "array<string>")).alias("reason")).filter("reason is not null")
    return audit.grave_issues(e)


@query(f"""with {_FLAGS}, q as (select *, row_number() over (partition by f order by id) as rn from (select id, x.f as f from fl)),
o as (select case f when 'needs-review' then 0 when 'missing-price' then 1 when 'stale' then 2 when 'missing-code' then 3 else 4 end as s, f, id from q
  where (f = 'needs-review' and rn <= 20) or (f = 'missing-price' and rn <= 20) or (f = 'stale' and rn <= 25) or (f = 'missing-code' and rn <= 25) or (f = 'missing-specs' and rn <= 25))
select cast(row_number() over (order by s, id) as integer) as position, case s when 0 then 'P0' when 1 then 'P1' when 2 then 'P1' when 3 then 'P2' else 'P3' end as priority, f as flag, id from o order by s, id limit 100""")
def tk6_queue(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_queue(cls18_quality_flags(spark, sf))


@query("""with f as (select id, [case when trim(coalesce(code, '')) = '' then 'code' end, case when trim(coalesce(family, '')) = '' then 'family' end, case when trim(coalesce(manufacturer, '')) = '' then 'manufacturer' end, case when trim(coalesce(name, '')) = '' then 'name' end,
  case when not coalesce(current_price, 0) > 0 then 'price' end, case when coalesce(json_array_length(try_cast(case when specs_json like '[%' then specs_json end as json)), 0) = 0 then 'specs' end, case when trim(coalesce(subcategory, '')) = '' then 'subcategory' end, case when trim(coalesce(unit, '')) = '' then 'unit' end] as l from product)
select id, cast(floor((8 - len(list_filter(l, lambda x: x is not null))) * 100 / 8.0 + 0.5) as integer) as percent, array_to_string(list_filter(l, lambda x: x is not null), ',') as missing from f""")
def prj7_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return audit.completeness(table(spark, sf, "product"))


_BIGRAM = f"""k as (select id, {_squeeze("coalesce(name, '')")} as nm, {_key('name')} as key from suppliers), g as (select id, key, list_distinct(list_transform(range(1, greatest(length(replace(key, ' ', '')), 1)), lambda i: substr(replace(key, ' ', ''), i, 2))) as b from k where length(nm) >= 4 and length(key) >= 4),
bp as (select least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b, case when a.key = b.key then 1.0 else len(list_intersect(a.b, b.b)) / len(list_distinct(list_concat(a.b, b.b))) end as s, a.key as ka, b.key as kb from g a join g b on a.id < b.id),
pairs as (select id_a, id_b, cast(floor(s * 100 + 0.5) as integer) as score from bp where s >= 0.86 or (least(length(ka), length(kb)) >= 7 and (starts_with(ka, kb) or starts_with(kb, ka))))"""


@query(f"with {_BIGRAM} select * from pairs")
def er2_bigram_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.bigram_pairs(table(spark, sf, "suppliers"))


@query()
def er1_ratio_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.ratio_pairs(table(spark, sf, "suppliers"))


@query(f"""with r as (select id, nullif(lower(trim(email)), '') as email, nullif(regexp_replace(phone, '\\D', '', 'g'), '') as phone, {_key('name')} as key from suppliers where id is not null), w as (select *, list_filter(list_distinct(string_split(key, ' ')), lambda x: length(x) > 2) as ws from r),
k as (select key, min(id) as id, any_value(ws) as ws from w where key <> '' group by 1),
p as (select min(id) over (partition by email) as id_a, id as id_b, '1-email' as reason from w where email is not null union all select min(id) over (partition by phone), id, '2-phone' from w where phone is not null
  union all select min(id) over (partition by key), id, case when len(ws) > 0 then '3-words' else '4-slips' end from w where key <> ''
  union all select least(a.id, b.id), greatest(a.id, b.id), case when len(list_distinct(list_concat(a.ws, b.ws))) > 0 and len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.75 then '3-words'
    when length(a.key) >= 3 and length(b.key) >= 3 and abs(length(a.key) - length(b.key)) <= 1 and levenshtein(a.key, b.key) <= 2 then '4-slips' end from k a join k b on a.key < b.key)
select id_a, id_b, min(reason) as reason from p where reason is not null and id_a <> id_b group by 1, 2""")
def er3_contact_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.contact_pairs(table(spark, sf, "suppliers"))


@query(f"""with {_EVENTS}, {_BIGRAM}, m as (select id_b as old, min(id_a) as new from pairs group by 1) select id, coalesce(m.new, supplier_id) as supplier_id from ev left join m on m.old = supplier_id""")
def er4_merge(spark: SparkSession, sf: str) -> DataFrame:
    mapping = resolve.bigram_targets(table(spark, sf, "suppliers"))
    return resolve.merged(_events(spark, sf), mapping).select("id", "supplier_id")


@query(f"""with {_BIGRAM}, m as (select id_b as old, min(id_a) as new from pairs group by 1), n as (select id, name, list_distinct(list_concat([name], {_json('aliases_json')})) as ns, {_json('aliases_json')} as al from suppliers),
own as (select * from n where id not in (select old from m)), x as (select id, unnest(al) as a from own union select m.new, unnest(n.ns) from n join m on m.old = n.id)
select own.id, own.name, array_to_string(list_filter(list_sort(coalesce(list(distinct x.a) filter (where x.a is not null), [])), lambda z: z <> own.name), '|') as aliases from own left join x on x.id = own.id group by own.id, own.name""")
def er4_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    mapping = resolve.bigram_targets(table(spark, sf, "suppliers"))
    out = resolve.merged_suppliers(table(spark, sf, "suppliers"), mapping)
    return out.select("id", "name", F.coalesce("aliases", F.lit("")).alias("aliases"))


@query()
def ag15_score(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier pairs are those of er1_ratio_pairs, which SQL has no function for."""
    return audit.catalogue_score(table(spark, sf, "product"), _events(spark, sf), AS_OF, er1_ratio_pairs(spark, sf))


@query(f"""with {_FLAGS}, n as (select count(*) as n from product), h as (select count(distinct id) filter (where x.f = 'missing-price') as a, count(distinct id) filter (where x.f = 'stale') as b, count(distinct id) filter (where x.f = 'missing-code') as c, count(distinct id) filter (where x.f = 'missing-brand') as d from fl)
select n, cast(floor((4 * 100 - 100.0 * (a + b + c + d) / n) / 4 + 0.5) as bigint) as score from n, h""")
def ag16_score_mean(spark: SparkSession, sf: str) -> DataFrame:
    return audit.mean_score(cls18_quality_flags(spark, sf), table(spark, sf, "product"))


_NUMBER = f"""pp as (select {_norm_audit('family')} as family_key, {_squeeze("coalesce(family, '')")} as family, upper(regexp_extract(trim(coalesce(code, '')), '^([A-Za-z]{{1,6}})[-_. ]?(\\d+)$', 1)) as prefix, try_cast(regexp_extract(trim(coalesce(code, '')), '^([A-Za-z]{{1,6}})[-_. ]?(\\d+)$', 2) as bigint) as number from product),
most as (select prefix, max(number) as last from pp where prefix <> '' group by 1),
best as (select family_key, case when prefix <> '' then prefix when upper(substr(family, 1, 2)) <> '' then upper(substr(family, 1, 2)) else 'MA' end as prefix from (select *, row_number() over (partition by family_key order by prefix = '', n desc, prefix) as rn from (select family_key, prefix, count(*) as n, min(family) as family from pp group by 1, 2)) where rn = 1),
pr as (select family_key, best.prefix, coalesce(last, 0) + 1 as next from best left join most on most.prefix = best.prefix)"""


@query(f"with {_NUMBER} select * from pr")
def ag17_code_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return audit.code_numbering(table(spark, sf, "product"))


@query(f"""with {_NUMBER}, n as (select id, prefix, next + row_number() over (partition by prefix order by x.family_key, id) - 1 as k from (select id, {_norm_audit('family')} as family_key from product where trim(coalesce(code, '')) = '') x join pr on pr.family_key = x.family_key)
select id, prefix || '-' || case when k < 1000 then lpad(cast(k as varchar), 3, '0') else cast(k as varchar) end as new_code from n""")
def wn10_new_codes(spark: SparkSession, sf: str) -> DataFrame:
    return audit.numbered(table(spark, sf, "product"))


@query(f"""with t as (select id, unnest(list_distinct(list_filter(string_split({_norm_audit('name')}, ' '), lambda x: x <> '' and not list_contains({norms.STOP_WORDS}, x)))) as token from product), n as (select count(*) as n from product)
select token, count(*) as df, round(ln(1 + (any_value(n.n) + 1) / (count(*) + 1)), 6) as idf from t, n group by 1""")
def ag18_idf(spark: SparkSession, sf: str) -> DataFrame:
    return audit.document_frequency(table(spark, sf, "product"), norms.tokens(F.col("name")))


@query(f"with {_EVENTS} select (select count(*) from product where not archived) as active, (select count(*) from product where not archived and current_price > 0) as with_price, (select count(*) from ev where final_price > 0) as events")
def ag20_kpi(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "product").filter(~F.col("archived")).agg(F.count("*").alias("active"), F.count_if(F.col("current_price") > 0).alias("with_price"))
    return p.crossJoin(history.positive(_events(spark, sf)).agg(F.count("*").alias("events")))


@query(f"""with {_EVENTS}, r as (select distinct trim(supplier_id) as supplier_id, product_id, kind from (select supplier_id, product_id, kind from supplier_link union all select supplier_id, product_id, 'quoted' from ev) where trim(supplier_id) <> '')
select supplier_id, count(distinct product_id) as products, count(distinct product_id) filter (where kind = 'quoted') as quoted, count(distinct product_id) filter (where kind = 'listed') as listed from r group by 1""")
def jn3_relations(spark: SparkSession, sf: str) -> DataFrame:
    return audit.supplier_relations(table(spark, sf, "supplier_link"), _events(spark, sf))


@query("select link_seq, product_id, supplier_name, kind, source from (select *, row_number() over (partition by product_id, supplier_name, kind, source order by link_seq) as rn from supplier_link) where rn = 1")
def snk3_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return audit.keep_first(table(spark, sf, "supplier_link"), ["product_id", "supplier_name", "kind", "source"], ["link_seq"]).select("link_seq", "product_id", "supplier_name", "kind", "source")


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 3")
def wn9_retention(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return audit.retained(e, [F.col("ts").desc(), F.col("event_id").desc()], 3, ["user_id"]).select("user_id", "event_id", "ts")


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events where user_id is not null and ts is not null),
f as (select user_id, event_id, t, rn, t as last, true as kept from e where rn = 1
  union all select e.user_id, e.event_id, e.t, e.rn, case when e.t - f.last > 86400000000 then e.t else f.last end, e.t - f.last > 86400000000 from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select user_id, event_id from f where kept""")
def wn8_suppress(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return suppress.suppress(e, "user_id", "ts", "event_id", 86400.0).select("user_id", "event_id")


# --- text and numbers ----------------------------------------------------------------------------------------------------


@query(f"select id, {_norm('name')} as n, {_key('manufacturer')} as k from product")
def str2_norm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "product").select("id", norms.norm(F.col("name")).alias("n"), norms.company_key(F.col("manufacturer")).alias("k"))


@query(f"select id, {_norm_index('name')} as n from product")
def str3_norm_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "product").select("id", norms.norm_index(F.col("name")).alias("n"))


@query(f"select id, array_to_string(list_filter(string_split({_norm_audit('name')}, ' '), lambda x: x <> '' and not list_contains({norms.STOP_WORDS}, x)), '|') as tokens from product")
def str7_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "product").select("id", F.array_join(norms.tokens(F.col("name")), "|").alias("tokens"))


@query(f"select id, {_key('name')} as key from suppliers")
def str9_company_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "suppliers").select("id", norms.company_key(F.col("name")).alias("key"))


@query("select id, regexp_replace(lower(coalesce(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), '')), '^www\\.', '') as host from match_candidate")
def str13_host(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "match_candidate").select("id", norms.host(F.col("url")).alias("host"))


@query()
def str17_money(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(numbers.amounts(F.col("text"))).alias("amount"))


@query()
def str18_invoice_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.invoice_lines(table(spark, sf, "documents"), "doc_id")


@query()
def str19_typed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.typed_lines(table(spark, sf, "documents"), "doc_id")


@query(f"""with c as (select distinct {_norm('code')} as code from product where code <> '') select a.code as code_a, b.code as code_b, levenshtein(a.code, b.code) as d from c a join c b
  on a.code < b.code and abs(length(a.code) - length(b.code)) <= 2 where levenshtein(a.code, b.code) <= 2""")
def num8_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of codes within two edits, wherever these are."""
    return resolve.near_codes(table(spark, sf, "product").filter("code <> ''").select(norms.norm(F.col("code")).alias("code")).distinct())


@query("""with g as (select p_partkey, lpad(cast(p_partkey * 7919 + 1000000 as varchar), 8, '0') as d from part) select p_partkey, d as gtin, (3 * (substr(d, 1, 1)::int + substr(d, 3, 1)::int + substr(d, 5, 1)::int + substr(d, 7, 1)::int)
  + substr(d, 2, 1)::int + substr(d, 4, 1)::int + substr(d, 6, 1)::int + substr(d, 8, 1)::int) % 10 = 0 and length(d) = 8 as valid from g""")
def num13_gtin(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 + 1000000).cast("string"), 8, "0").alias("gtin"))
    return g.withColumn("valid", numbers.gtin_valid(F.col("gtin")))


@query(f"""with {_EVENTS} select id, strftime(case when regexp_matches(trim(updated_at_raw), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then try_cast(trim(updated_at_raw) as date)
  when regexp_matches(trim(updated_at_raw), '^\\d{{1,2}}[/.-]\\d{{1,2}}[/.-](\\d{{2}}|\\d{{4}})$') then try_cast(try_strptime(regexp_extract(trim(updated_at_raw), '^(\\d{{1,2}})', 1) || '/' || regexp_extract(trim(updated_at_raw), '^\\d{{1,2}}[/.-](\\d{{1,2}})', 1) || '/' ||
    case when length(regexp_extract(trim(updated_at_raw), '(\\d+)$', 1)) = 2 then '20' else '' end || regexp_extract(trim(updated_at_raw), '(\\d+)$', 1), '%d/%m/%Y') as date)
  when try_cast(updated_at_raw as double) > 30000 and try_cast(updated_at_raw as double) < 80000 then date '1899-12-30' + cast(round(try_cast(updated_at_raw as double)) as integer) end, '%Y-%m-%d') as day from ev""")
def dat3_typed_date(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("id", F.date_format(numbers.typed_date(F.col("updated_at_raw")), "yyyy-MM-dd").alias("day"))


@query(f"with {_EVENTS} select id, strftime(case when regexp_matches(updated_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and try_cast(updated_at as date) between date '2010-01-01' and date '2026-06-30' then try_cast(updated_at as date) end, '%Y-%m-%d') as day from ev")
def dat1_iso_date(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("id", F.date_format(valid_date(F.col("updated_at")), "yyyy-MM-dd").alias("day"))


# --- search --------------------------------------------------------------------------------------------------------------


def _bm25_sql(query_: str) -> str:
    """The rank of search() in SQL, for queries of plain words."""
    text = _norm_index("x")
    spec = "coalesce((select string_agg(concat_ws(' ', s ->> 'label', s ->> 'value'), ' ' order by i) from (select unnest(json_extract(try_cast(case when specs_json like '[%' then specs_json end as json), '$[*]')) as s, generate_subscripts(json_extract(try_cast(case when specs_json like '[%' then specs_json end as json), '$[*]'), 1) as i)), '')"
    raw = f"concat_ws(' ', name, code, family, subcategory, manufacturer, array_to_string({_json('aliases_json')}, ' '), array_to_string({_json('external_codes_json')}, ' '), {spec})"
    terms = " union all ".join(f"select {q} as q, '{t[0]}' as t" for q, t in enumerate(search.query_terms(query_)))
    cols = " union all ".join(f"select id, {w} as w, unnest(regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')) as term from docs" for c, w in search.WEIGHTS.items())
    return f"""with r as (select *, {_squeeze(raw)} as x from product), docs as (select * exclude (x), concat_ws(' ', x, {text}) as search_text from r), post as ({cols}), q as ({terms}),
len as (select id, count(*) as len from post group by 1), tf as (select post.id, q.q, sum(w) as tf from post join q on starts_with(post.term, q.t) group by 1, 2), df as (select q, count(*) as df from tf group by 1),
st as (select (select count(*) from product) as n, (select sum(len) from len) as total),
sc as (select tf.id, -sum((case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / n)))) as score from tf join df on df.q = tf.q join len on len.id = tf.id, st group by 1)
select p.id, p.name, round(score, 6) as score from sc join product p on p.id = sc.id where not p.archived order by 3, 1 limit 25"""


@query(_bm25_sql("chapa inox 304 lisa"))
def sch2_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "product"), "chapa inox 304 lisa")


@query(f"""with post as (select doc_id, unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+')) as term from documents), q as (select 0 as q, 'parafuso' as t union all select 1, 'reajuste'), len as (select doc_id, count(*) as len from post group by 1),
tf as (select post.doc_id, q.q, count(*) as tf from post join q on starts_with(post.term, q.t) group by 1, 2), df as (select q, count(*) as df from tf group by 1), st as (select (select count(*) from documents) as n, (select sum(len) from len) as total)
select tf.doc_id, round(-sum((case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / n)))), 6) as score from tf join df on df.q = tf.q join len on len.doc_id = tf.doc_id, st group by 1""")
def sch2_bm25_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return search.bm25(search.postings(d, ["text"], "doc_id"), d, "parafuso reajuste", {"text": 1.0}, "doc_id").select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"select id, name from product where not archived and (contains({_norm_index('name')}, 'latao m8') or contains(coalesce(code, ''), 'latao m8')) order by id limit 25")
def fil3_like(spark: SparkSession, sf: str) -> DataFrame:
    return search.like(table(spark, sf, "product"), "latão M8")


@query()
def sch6_simple_rank(spark: SparkSession, sf: str) -> DataFrame:
    return search.simple_rank(table(spark, sf, "product"), "tubo pvc")


@query()
def sch7_staged(spark: SparkSession, sf: str) -> DataFrame:
    return search.staged(table(spark, sf, "product"), "chapa lisa inox")


@query()
def sch3_snippet(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter(F.lower("text").contains("reajuste"))
    return d.select("doc_id", search.snippet(F.col("text"), ["reajuste"]).alias("snippet"))


@query()
def sch12_web_rank(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "match_candidate").select("url", F.col("name").alias("title"), F.col("description").alias("snippet"))
    return search.web_rank(m, "chapa inox 304")


@query("""select family, name, n, best from (select family, name, id as best, count(*) over (partition by family, name) as n, row_number() over (partition by family, name order by offer_count desc, current_offer_date desc nulls last, id) as rn from product) where rn = 1""")
def sch17_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return search.grouped(table(spark, sf, "product"))


@query(f"""with {_EVENTS} select id, name from product where not archived and contains({_norm('manufacturer')}, 'pocefese') and id in (select product_id from supplier_link where trim(supplier_id) = 'sup_00000033' union all select product_id from ev where trim(supplier_id) = 'sup_00000033')""")
def fil4_facets(spark: SparkSession, sf: str) -> DataFrame:
    return search.facets(table(spark, sf, "product"), table(spark, sf, "supplier_link"), _events(spark, sf), supplier="sup_00000033", manufacturer="Pocefese").select("id", "name")


# --- attributes ----------------------------------------------------------------------------------------------------------


@query(f"""with n as (select id, {_norm('name')} as x from product) select id, case when regexp_matches(x, '\\b(?:inox|stainless)\\b') then 'inox' when regexp_matches(x, '\\baluminio\\b|\\bal\\.') then 'aluminio' when regexp_matches(x, '\\b(?:aco carbono|carbon steel)\\b') then 'aco_carbono' when regexp_matches(x, '\\bpvc\\b') then 'pvc'
  when regexp_matches(x, '\\bborracha\\b') then 'borracha' when regexp_matches(x, '\\blatao\\b') then 'latao' when regexp_matches(x, '\\bbronze\\b') then 'bronze' when regexp_matches(x, '\\bcobre\\b') then 'cobre' when regexp_matches(x, '\\bnylon\\b') then 'nylon' else '' end as material,
  array_to_string(list_transform(list_distinct_ordered, lambda z: upper(z)), ',') as alloys from (select id, x, regexp_extract_all(x, '\\b(?:aisi\\s*)?f?({features.ALLOYS})\\b', 1) as l, list_filter(regexp_extract_all(x, '\\b(?:aisi\\s*)?f?({features.ALLOYS})\\b', 1), lambda v, i: list_position(regexp_extract_all(x, '\\b(?:aisi\\s*)?f?({features.ALLOYS})\\b', 1), v) = i) as list_distinct_ordered from n)""")
def cls4_material_alloys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "product").select("id", features.material(F.col("name")).alias("material"), F.array_join(features.alloys(F.col("name")), ",").alias("alloys"))


@query(f"""with n as (select id, ' ' || {_norm("coalesce(name, '')")} || ' ' as x from product) select id, case when regexp_matches(x, ' flange ') and not regexp_matches(x, '\\b(?:aco|inox|aluminio|dn|ansi|npt|rosca|tubo|solda|industrial|alta pressao|valvula|conexao)\\b') then '' when regexp_matches(x, ' ch\\.? ') then 'chapa'
  {' '.join(f"when regexp_matches(x, ' (?:{w}) ') then '{k}'" for k, w in features.TYPES)} else '' end as kind from n""")
def cls1_types(spark: SparkSession, sf: str) -> DataFrame:
    return features.parsed(table(spark, sf, "product").select("id", "name"), "name").select("id", "kind")


@query()
def cls6_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "product").select("id", F.posexplode(features.dimensions(F.col("name"))).alias("pos", "d"))
    return d.select("id", "pos", "d.raw", "d.value_mm")


@query()
def cls19_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Kind, material, alloys, unit and specifications of every description."""
    p = features.parsed(table(spark, sf, "product").select("id", "name"), "name")
    specs = features.specs(F.col("form"), F.col("kind"), F.col("material"), F.col("alloys"), F.col("dimensions"), F.col("threads"))
    return p.select("id", "kind", "material", F.array_join("alloys", ",").alias("alloys"), features.unit(F.col("kind"), F.col("name"))["unit"].alias("unit_"), F.to_json(specs).alias("specs"))


@query()
def sch10_match(spark: SparkSession, sf: str) -> DataFrame:
    """The five best of all listings for each product whose number is divisible by 20."""
    p = table(spark, sf, "product")
    q = p.filter(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 20 == 0).select(F.col("id").alias("qid"), F.col("name").alias("text"))
    c = table(spark, sf, "match_candidate")
    values = F.array_join(F.transform("specs", lambda s: F.coalesce(s["value"], F.lit(""))), " ")
    return features.matches(q, c.select("id", "name", values.alias("more"), F.col("product_type").alias("kind"), (F.col("source_type") == "manufacturer").alias("preferred")))


# --- import --------------------------------------------------------------------------------------------------------------


@query()
def jn7_find_supplier(spark: SparkSession, sf: str) -> DataFrame:
    names = _events(spark, sf).filter("supplier_id is null and supplier_name is not null").select(F.col("supplier_name").alias("name"))
    return resolve.find_supplier(names, table(spark, sf, "suppliers"))


@query("""with k as (select id, trim(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g')) as code from (select id, unnest(list_concat([code], """ + _json("external_codes_json") + """)) as c from product)),
q as (select distinct trim(regexp_replace(coalesce(manufacturer_code, ''), '\\s+', ' ', 'g')) as code from match_candidate) select q.code, min(k.id) as product_id from q join k on k.code = q.code where k.code <> '' group by 1""")
def jn10_scanned_codes(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.code_matches(table(spark, sf, "match_candidate").select(F.col("manufacturer_code").alias("code")), table(spark, sf, "product"))


@query()
def import_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The offers without supplier, as rows of a sheet, against the catalogue: rows per outcome."""
    e = table(spark, sf, "offers").filter("supplier_id is null")
    p = table(spark, sf, "product").select(F.col("id").alias("pid"), "code", "name")
    rows = e.join(p, e["product_id"] == p["pid"]).select(
        F.regexp_extract("source_json", r'"sheet": "([^"]*)"', 1).alias("sheet"), F.col("ingest_seq").alias("row_idx"), "code", "name", F.col("base_price").cast("string").alias("base_price"), F.col("final_price").cast("string").alias("final_price"),
        F.col("supplier_name").alias("supplier"), F.col("updated_at_raw").alias("date"), F.lit("").alias("ipi"), F.lit("").alias("adjustment"), F.col("quantity").cast("string").alias("quantity"),
    )
    return ingest.import_stats(ingest.preview(rows, table(spark, sf, "product"), _events(spark, sf).filter("supplier_id is not null")))


@query(f"""with {_EVENTS}, f as (select {_norm_audit('p.family')} as k, median(e.final_price) as m from product p join ev e on e.product_id = p.id where e.final_price > 0 group by 1)
select e.id, case when e.final_price is null or e.final_price <= 0 then 'invalid' when e.final_price < 0.01 then 'low' when e.final_price > 1000000 then 'high' when e.final_price > m.m * 5 then 'high' when e.final_price < m.m / 5 then 'low' end as reason
from ev e join (select product_id, median(final_price) as m from ev where final_price > 0 group by 1) m on m.product_id = e.product_id where case when e.final_price is null or e.final_price <= 0 then 'invalid' when e.final_price < 0.01 then 'low' when e.final_price > 1000000 then 'high' when e.final_price > m.m * 5 then 'high' when e.final_price < m.m / 5 then 'low' end is not null""")
def imp5_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Prices far from their product's median."""
    e = _events(spark, sf)
    m = history.positive(e).groupBy("product_id").agg(F.median("final_price").alias("m"))
    return e.join(m, "product_id").select("id", ingest.quarantine(F.nanvl("final_price", F.lit(None).cast("double")), F.col("m")).alias("reason")).filter("reason is not null")


@query(f"with {_EVENTS}, b as (select id from ev where ingested_at >= timestamptz '2026-06-01 00:00:00+00') select id, product_id from ev where id not in (select id from b)")
def dml3_undo(spark: SparkSession, sf: str) -> DataFrame:
    """The offers without the last batch."""
    e = _events(spark, sf)
    return e.join(e.filter("ingested_at >= timestamp '2026-06-01 00:00:00'").select("id"), "id", "left_anti").select("id", "product_id")


@query(f"""with {_EVENTS}, n as (select {_norm('supplier_name')} as k, min(supplier_name) as name from ev where supplier_id is null and coalesce(supplier_name, '') <> '' group by 1), h as (select distinct {_norm('name')} as k from suppliers)
select k as name_key, name from n where k <> '' and k not in (select k from h)""")
def dml8_supplier_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that the offers' names would add: those whose normal name is new."""
    n = _events(spark, sf).filter("supplier_id is null and supplier_name <> ''").groupBy(norms.norm(F.col("supplier_name")).alias("name_key")).agg(F.min("supplier_name").alias("name")).filter("name_key <> ''")
    return n.join(table(spark, sf, "suppliers").select(norms.norm(F.col("name")).alias("name_key")).distinct(), "name_key", "left_anti")


@query("select p_brand as family, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank_no, p_partkey from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 12".replace("row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank_no", "cast(row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as integer) as rank_no"))
def tk8_top_in_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, sf, "part").withColumn("rank_no", F.row_number().over(w)).filter("rank_no <= 12").select(F.col("p_brand").alias("family"), "rank_no", "p_partkey")



# --- more of the catalogue -----------------------------------------------------------------------------------------------


@query(f"select * from (select {_norm('manufacturer')} as brand_key, min(manufacturer) as name, count(*) as n from product group by 1) where brand_key <> ''")
def jn13_brand_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.brand_counts(table(spark, sf, "product"))


@query(f"""select id, name, product_count from suppliers where product_count > 0 and contains({_norm("concat_ws(' ', name, email, phone, array_to_string(" + _json('aliases_json') + ", ' '))")}, 'hidraul') order by name, id limit 80""")
def fil7_directory(spark: SparkSession, sf: str) -> DataFrame:
    return audit.supplier_directory(table(spark, sf, "suppliers"), "Hidrául")


@query(f"""with {_EVENTS}, own as (select distinct product_id, supplier_id from ev where trim(supplier_id) <> ''), f as (select id as product_id, {_norm_audit('family')} as k from product), fam as (select own.*, f.k from own join f on f.product_id = own.product_id),
b as (select *, row_number() over (partition by k order by n desc, supplier_id) as r from (select k, supplier_id, count(distinct product_id) as n from fam group by 1, 2)),
e as (select fam.product_id, fam.supplier_id, 1 as own, b.n from fam join b on b.k = fam.k and b.supplier_id = fam.supplier_id union all select f.product_id, b.supplier_id, 0, b.n from f join b on b.k = f.k where b.r <= 5),
g as (select product_id, supplier_id, max(own) as own, max(n) as n from e group by 1, 2)
select product_id, cast(rn as integer) as rank_no, supplier_id from (select *, row_number() over (partition by product_id order by own desc, n desc, supplier_id) as rn from g) where rn <= 5""")
def fil8_suggested(spark: SparkSession, sf: str) -> DataFrame:
    return audit.suggested_suppliers(_events(spark, sf), table(spark, sf, "product"))


@query()
def cls2_scored_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "match_candidate").select("id", features.scored_type(F.col("name")).alias("kind"))


@query()
def cls8_facts(spark: SparkSession, sf: str) -> DataFrame:
    return features.facts(table(spark, sf, "product"), "id", "name", "specs_json")


@query()
def arr1_tidy_specs(spark: SparkSession, sf: str) -> DataFrame:
    specs = F.from_json("specs_json", "array<struct<label:string,value:string>>")
    return table(spark, sf, "product").select("id", F.to_json(features.tidy_specs(specs)).alias("specs")).filter("specs is not null")


@query()
def sch8_attribute_rank(spark: SparkSession, sf: str) -> DataFrame:
    return features.attribute_rank(table(spark, sf, "product"), "chapa inox 304 lisa 2 mm")


@query()
def er6_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Products whose number is divisible by 20, against all."""
    p = table(spark, sf, "product").filter(~F.col("archived"))
    return resolve.similar_products(p.filter(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 20 == 0), p)


@query(f"""with recursive w as (select event_type, date_trunc('hour', ts) as window_start, count(*) as n, floor(sum(value) * 100 + 0.500001) / 100 as total from events group by 1, 2) select window_start, event_type, n, total from w""".replace("with recursive", "with"))
def str215_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's windows over the events at rest."""
    e = table(spark, sf, "events")
    w = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), numbers.rounded(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
