"""Product data out of pages: JSON-LD nodes, meta tags and titles, by the standard library's tolerant parser, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insumo.functions.norms import clean_title, host
from insumo.functions.numbers import gtin_valid
from insumo.operators import features

#: Pages over this size aren't read.
MOST_BYTES = 3_000_000
SCHEMA = "page_id long, url string, name string, description string, brand string, manufacturer string, code string, gtins array<string>, price double, seller string, properties array<struct<label:string,value:string>>, structured boolean"
PROPERTY_LABELS = {"width": "Largura", "height": "Altura", "depth": "Comprimento", "weight": "Peso / capacidade", "color": "Cor", "size": "Medida"}


class _Page(HTMLParser):
    """Scripts of JSON-LD, meta tags and the title of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.ld: list[str] = []
        self.meta: dict[str, str] = {}
        self.title = ""
        self._in = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "script":
            self._in = "ld" if "ld+json" in a.get("type", "") else ""
            if self._in:
                self.ld.append("")
        elif tag == "title":
            self._in = "title"
        elif tag == "meta":
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a.get("content", ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "title"):
            self._in = ""

    def handle_data(self, data: str) -> None:
        if self._in == "ld":
            self.ld[-1] += data
        elif self._in == "title":
            self.title += data


def text_of(value: Any) -> str:
    """First text in a JSON-LD value: of a list its first, of an object its name, value or id."""
    while isinstance(value, list):
        value = value[0] if value else ""
    if isinstance(value, dict):
        value = next((value[k] for k in ("name", "value", "@id") if value.get(k)), "")
    return " ".join(str("" if value is None else value).split())


def nodes_of(value: Any) -> Iterator[dict]:
    """All objects in a JSON-LD value, a graph's before the other children. Deep values are walked without recursion."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            yield v
            children = [c for k, c in v.items() if k != "@graph" and isinstance(c, (dict, list))]
            todo.extend(reversed(([v["@graph"]] if "@graph" in v else []) + children))
        elif isinstance(v, list):
            todo.extend(reversed(v))


def is_product(node: dict) -> bool:
    types = node.get("@type")
    return any(str(t).lower().endswith("product") for t in (types if isinstance(types, list) else [types]) if t)


def number_of(value: Any) -> float | None:
    try:
        n = float(re.sub(r"[^\d.,]", "", str(value)).replace(",", "."))
    except ValueError:
        return None
    return n if n > 0 else None


def read_page(html: str) -> dict:
    """The fields of SCHEMA that a page states itself."""
    page = _Page()
    page.feed(html or "")
    node: dict = {}
    for raw in page.ld:
        try:
            found = next((n for n in nodes_of(json.loads(raw)) if is_product(n)), None)
        except ValueError:
            continue
        if found:
            node = found
            break
    offers = node.get("offers")
    offers = [o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)]
    price = next((p for o in offers if (p := number_of(o.get("price"))) is not None), None)
    if price is None:
        price = next((p for k in ("product:price:amount", "og:price:amount", "price", "twitter:data1") if (p := number_of(page.meta.get(k))) is not None), None)
    extra = node.get("additionalProperty") or node.get("additionalProperties") or []
    extra = [p for p in (extra if isinstance(extra, list) else [extra]) if isinstance(p, dict)]
    stated = [(text_of(p.get("name") or p.get("propertyID")), text_of(p.get("value") or p.get("valueReference"))) for p in extra]
    stated += [(label, text_of(node.get(k))) for k, label in PROPERTY_LABELS.items()]
    return {
        "name": text_of(node.get("name")) or text_of(page.meta.get("og:title")) or text_of(page.title),
        "description": (text_of(node.get("description")) or text_of(page.meta.get("og:description")) or text_of(page.meta.get("description")))[:600],
        "brand": text_of(node.get("brand")),
        "manufacturer": text_of(node.get("manufacturer")),
        "code": next((t for k in ("mpn", "model", "sku") if (t := text_of(node.get(k)))), ""),
        "gtins": [re.sub(r"\D", "", text_of(node.get(k))) for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin", "ean") if node.get(k)],
        "price": price,
        "seller": next((s for o in offers if (s := text_of(o.get("seller") or o.get("offeredBy")))), ""),
        "properties": [{"label": a, "value": b} for a, b in stated if a and b],
        "structured": bool(node),
    }


def pages(rows: DataFrame) -> DataFrame:
    """SCHEMA of rows (page_id, url, html). Pages over the size limit, and null ones, give no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"page_id": i, "url": u} | read_page(h) for i, u, h in zip(b["page_id"], b["url"], b["html"], strict=True)], columns=[c.split()[0] for c in "page_id,url,name,description,brand,manufacturer,code,gtins,price,seller,properties,structured".split(",")])

    small = rows.select("page_id", "url", "html").filter((F.octet_length("html") <= MOST_BYTES) & F.col("html").isNotNull())
    return small.mapInPandas(read, SCHEMA)


def extracted(rows: DataFrame) -> DataFrame:
    """Products of pages: name, kind, maker, code, valid gtin, price, seller, unit, source kind, specs (the page's, then the text's
    for labels that the page doesn't state)."""
    p = pages(rows).filter("name <> ''").withColumn("t", F.concat_ws(" ", "name", "description"))
    kind = features.material_type(F.col("t"))
    maker = features.maker(F.col("t"), F.col("manufacturer"))
    p = p.withColumns({"kind": kind, "maker": maker, "host": host(F.col("url"))})
    own = F.transform("properties", lambda s: F.struct(features.canonical_label(s["label"]).alias("label"), s["value"].alias("value")))
    from_text = F.filter(features.specs_of(F.col("t"), F.col("kind")), lambda s: ~F.exists(own, lambda o: o["label"] == s["label"]))
    line = F.when((F.col("brand") != "") & (F.lower("brand") != F.lower("maker")), F.col("brand")).otherwise("")
    return p.select(
        "page_id", clean_title(F.col("name")).alias("name"), "kind", F.col("maker").alias("manufacturer"), line.alias("product_line"), "code",
        F.coalesce(F.get(F.filter("gtins", gtin_valid), F.lit(0)), F.lit("")).alias("gtin"), "price", "seller", features.unit(F.col("kind"), F.col("name"))["unit"].alias("unit"),
        features.source_kind(F.col("host"), F.col("brand"), F.col("maker"), F.col("seller")).alias("source_kind"), F.concat(own, from_text).alias("specs"), "structured",
    )
