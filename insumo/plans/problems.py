"""Queries of the general data-quality problems (1, 4, 5), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insumo.operators import measures, references, series
from insumo.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return measures.measures(table(spark, sf, "product"))


def p1_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Per measure: products that state it, least and largest amount in the common unit."""
    return measures.measures(table(spark, sf, "product")).groupBy("measure").agg(F.count("*").alias("products"), F.min("amount").alias("least"), F.max("amount").alias("largest"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return series.implausible(table(spark, sf, "offers")).select("offer_id").distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged offers per kind of fault."""
    found = series.implausible(table(spark, sf, "offers"))
    return found.agg(*(F.count_if(c).alias(c) for c in ("price_bad", "date_bad", "spike", "stuck")))


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    link, product, suppliers = (table(spark, sf, t) for t in ("supplier_link", "product", "suppliers"))
    refs = references.references(link, "supplier_link", F.col("link_seq"), F.col("supplier_id"), F.col("recorded_at"))
    refs = refs.unionByName(references.references(product, "product", F.col("id"), F.col("current_supplier_id"), F.col("recorded_at")))
    return refs, suppliers.select(F.col("id").alias("key"), "loaded_at", "deleted_at")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphans(*_references(spark, sf)).select("table_name", "period", "row_key").distinct()


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_report(*_references(spark, sf))


QUERIES = {q.__name__: q for q in (p1_found, p1_kinds, p4_found, p4_report, p5_found, p5_report)}

_REFS = """
refs as (select 'supplier_link' as table_name, cast(link_seq as varchar) as row_key, trim(supplier_id) as k, recorded_at from supplier_link
         union all select 'product', id, trim(current_supplier_id), recorded_at from product),
state as (select r.table_name, r.row_key, r.k, r.recorded_at,
            case when count(*) filter (where s.loaded_at <= r.recorded_at and (s.deleted_at is null or s.deleted_at > r.recorded_at)) > 0 then 'valid'
                 when count(*) filter (where s.loaded_at <= r.recorded_at) > 0 then 'deleted'
                 when count(s.id) > 0 then 'late' else 'missing' end as state
          from refs r left join suppliers s on s.id = r.k where r.k is not null and r.k <> '' group by all)"""


def _series_sql() -> str:
    """The marks of problem 4, from its statement: neighbours as columns of a row, figures of a series as windows over it."""
    x = {k: f"x{k + 5}" for k in range(-5, 6)}
    fine = {k: f"({x[k]} - {x[k - 1]})" for k in range(-4, 6)}
    coarse = {k: f"({x[k]} + {x[k - 1]} - {x[k - 2]} - {x[k - 3]})" for k in range(-2, 6)}
    same = {k: f"coalesce({fine[k]} = 0, false)::int" for k in fine}
    chain = lambda ks: " + ".join("*".join(same[j] for j in ks[: i + 1]) for i in range(len(ks)))
    median3 = lambda a, b, c: f"(case when {b} is null then {a} when {c} is null then ({a} + {b}) / 2.0 else list_sort([{a}, {b}, {c}])[2] end)"

    def pulse(i: int, long: int) -> str:
        name = lambda k: x.get(k, "null::bigint")
        before, after = median3(*(name(i - k) for k in (1, 2, 3))), median3(*(name(i + long - 1 + k) for k in (1, 2, 3)))
        pairs = [(fine[i], fine[i + long], "scale1")]
        if long == 2:
            pairs.append((f"coalesce({coarse[i + 1]}, 2 * {fine[i]})", f"coalesce({coarse[i + 3]}, 2 * {fine[i + 2]})", "scale2"))
        opposite = " and ".join(f"sign({a}) * sign({b}) < 0 and least(abs({a}), abs({b})) > 5.8 * {c}" for a, b, c in pairs)
        off = "least(" + ", ".join(f"abs({x[i + j]} - {m})" for j in range(long) for m in (before, after)) + ")"
        return f"coalesce({x[i - 1]} is not null and {x[i + long]} is not null and {opposite} and {off} > 5.8 * scale1 and abs({before} - {after}) <= 0.5 * {off} and abs({x[i]} - {x[i + long - 1]}) <= 0.5 * {off}, false)"

    shifted = ", ".join(f"{'lag' if k < 0 else 'lead'}(x, {abs(k)}) over w as {x[k]}" if k else f"x as {x[0]}" for k in x)
    return f"""
valid as (select *, case when regexp_matches(updated_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and try_cast(updated_at as date) between date '2010-01-01' and date '2026-06-30' then try_cast(updated_at as date) end as day
          from (select *, row_number() over (partition by id order by ingest_seq desc) as rn from offers where id is not null) where rn = 1),
readings as (select id, product_id, supplier_id, day, round(ln(final_price) * 1e12)::bigint as x from valid
             where final_price > 0 and not isnan(final_price) and day is not null and product_id is not null and trim(supplier_id) <> ''),
near as (select id, product_id, supplier_id, {shifted} from readings window w as (partition by product_id, supplier_id order by day, id)),
details as (select *, {fine[0]} as d1, {coarse[0]} as d2, coalesce({fine[-1]} = 0, false) as z_before, coalesce({fine[0]} = 0, false) and ({chain([0, -1, -2, -3])}) + ({chain([1, 2, 3, 4])}) >= 4 as in_run from near),
series as (select product_id, supplier_id, count(*) as n, count(*) filter (where d1 <> 0) as changes, count(*) filter (where d1 = 0 and not in_run) as rests, count(*) filter (where in_run and not z_before) as runs,
           median(abs(d1)) filter (where d1 <> 0) as size1, median(abs(d2)) filter (where d2 <> 0) as size2 from details group by all),
judged as (select *, changes >= 3 * runs and rests <= 0.25 * (rests + changes) as lively from series),
scaled as (select *, greatest(1e10, case when lively or changes > 0.5 * (n - 1) then 1.4826 * size1 else 0 end) as scale1, greatest(2e10, case when lively or changes > 0.5 * (n - 1) then 1.4826 * size2 else 0 end) as scale2 from judged),
marked as (select id as offer_id, {pulse(0, 1)} or {pulse(0, 2)} or {pulse(-1, 2)} as spike, in_run and lively as stuck from details join scaled using (product_id, supplier_id) where n >= 10),
faults as (select id as offer_id, coalesce(final_price <= 0, false) as price_bad, coalesce(trim(updated_at) <> '' and day is null, false) as date_bad, false as spike, false as stuck from valid
           where coalesce(final_price <= 0, false) or coalesce(trim(updated_at) <> '' and day is null, false)
           union all select offer_id, false, false, spike, stuck from marked where spike or stuck)"""


_SERIES = _series_sql()
ORACLES = {
    "p4_found": f"with {_SERIES} select distinct offer_id from faults",
    "p4_report": f"with {_SERIES} select count(*) filter (where price_bad) as price_bad, count(*) filter (where date_bad) as date_bad, count(*) filter (where spike) as spike, count(*) filter (where stuck) as stuck from faults",
    "p5_found": f"with {_REFS} select distinct table_name, strftime(recorded_at at time zone 'UTC', '%Y-%m') as period, row_key from state where state <> 'valid'",
    "p5_report": f"with {_REFS} select table_name, strftime(recorded_at at time zone 'UTC', '%Y-%m') as period, state, count(*) as n, count(distinct k) as n_keys from state group by all",
}
