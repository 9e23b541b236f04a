"""Native range of a plant: lookup chain, and the split of regions into native and background."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def name_to_id(names: DataFrame, name: str, column: str = "name", key: str = "id") -> DataFrame:
    """At most one row (key): the smallest id of that exact name; a blank name finds nothing."""
    wanted = (name or "").strip()
    hit = names.filter(F.col(column) == F.lit(wanted)) if wanted else names.limit(0)
    return hit.select(key).orderBy(key).limit(1)


def native_codes(distribution: DataFrame, key: str, code: str) -> DataFrame:
    """(key, code): the distinct non-empty region codes of each id."""
    return distribution.select(key, code).filter(F.coalesce(F.col(code), F.lit("")) != "").distinct()


def native_regions(features: DataFrame, codes: DataFrame, code: str, name: str) -> DataFrame:
    """Features whose code is among the codes, as (code, name); a missing name falls back to the code."""
    hit = features.join(codes.select(code).distinct(), code, "left_semi")
    return hit.select(code, F.coalesce(F.when(F.col(name) != "", F.col(name)), F.col(code).cast("string")).alias(name))


def background_regions(features: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """All other features, those with a null code among them."""
    return features.join(codes.select(code).distinct(), code, "left_anti")


def match_stats(features: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """One row: native_codes (distinct) and matched_features."""
    matched = features.join(codes.select(code).distinct(), code, "left_semi").agg(F.count(F.lit(1)).alias("matched_features"))
    return codes.agg(F.countDistinct(code).alias("native_codes")).withColumn("matched_features", F.lit(matched.first()[0]))


def feature_collection(features: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One row (geojson): a FeatureCollection of the features, for drawing a map; features of one map, so few."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*properties).alias("properties")))
    body = F.array_join(F.sort_array(F.collect_list(feature)), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))


# draws GeoJSON polygons in degrees, north up
_DRAW = """
const svg=document.getElementById('map'),ns='http://www.w3.org/2000/svg';
function layer(data,fill){for(const f of data.features){const g=typeof f.geometry==='string'?JSON.parse(f.geometry):f.geometry;if(!g)continue;
const many=g.type==='Polygon'?[g.coordinates]:g.type==='MultiPolygon'?g.coordinates:[];
const p=document.createElementNS(ns,'path');p.setAttribute('d',many.map(rings=>rings.map(r=>'M'+r.map(c=>c[0]+','+(-c[1])).join('L')+'Z').join('')).join(''));
p.setAttribute('fill',fill);p.setAttribute('fill-rule','evenodd');p.setAttribute('stroke','#666');p.setAttribute('stroke-width','0.2');
const t=document.createElementNS(ns,'title');t.textContent=(f.properties&&f.properties.name)||'';p.appendChild(t);svg.appendChild(p);}}
layer(background,'#ddd');layer(native,'#2e7d32');
"""


def map_page(native: str, background: str, name: str, panel: dict[str, str | None]) -> str:
    """An HTML page that draws both layers, with a legend and a panel of facts, "N/A" where one is missing."""
    from html import escape

    facts = "".join(f"<dt>{escape(k)}</dt><dd>{escape(v or 'N/A')}</dd>" for k, v in panel.items())
    layers = f"const native={native};const background={background};".replace("</", "<\\/")
    legend = "<ul><li style='color:#2e7d32'>native</li><li style='color:#888'>not native</li></ul>"
    drawing = "<svg id='map' viewBox='-180 -90 360 180' width='100%'></svg>"
    return f"<!doctype html><meta charset='utf-8'><title>{escape(name)}</title><h1>{escape(name)}</h1><dl>{facts}</dl>{legend}{drawing}<script>{layers}{_DRAW}</script>"


def native_range(names: DataFrame, distribution: DataFrame, features: DataFrame, name: str, folder: str | None = None) -> tuple[DataFrame, str] | None:
    """(native regions, map page) of a plant by name, or None where the name or its regions are unknown; the page is saved in `folder`.

    names: (name, id); distribution: (id, code, origin, lifeform, climate); features: (geometry, code, name).
    """
    found = name_to_id(names, name).first()
    if found is None:
        return None
    own = distribution.filter(F.col("id") == found[0])
    codes = native_codes(own, "id", "code")
    facts = own.select("origin", "lifeform", "climate").first()
    native = native_regions(features, codes, "code", "name")
    if facts is None or codes.isEmpty():
        return None
    layer = lambda rows: feature_collection(rows, "geometry", ["code", "name"]).first()["geojson"]
    page = map_page(layer(features.join(codes.select("code"), "code", "left_semi")), layer(background_regions(features, codes, "code")), name, facts.asDict())
    if folder:
        with open(f"{folder}/{map_file_name(name)}", "w", encoding="utf-8") as out:
            out.write(page)
    return native, page


def map_file_name(name: str) -> str:
    return name.strip().replace(" ", "_") + "_native.html"
