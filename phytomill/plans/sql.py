"""DuckDB statements equal to the catalog's queries."""

from __future__ import annotations

# pieces of SQL also used elsewhere
TAXON = "try_cast(regexp_extract(cast(taxon_id as varchar), '([0-9]+)([.]0*)?[^0-9]*$', 1) as bigint)"
MISSING = "('', '-', '--', '?', 'n/a', 'na', 'nan', 'none', 'null')"


def stripped(column: str) -> str:
    return f"trim(replace(replace(replace({column}, chr(8203), ''), chr(160), ' '), chr(9), ' '))"


def present(column: str) -> str:
    return f"(case when lower({stripped(column)}) not in {MISSING} then {column} end)"


def name(column: str) -> str:
    s = stripped(column)
    return f"(case when lower({s}) not in {MISSING} then upper(left({s}, 1)) || lower(substr({s}, 2)) end)"


HITS = """with unit as (select vec_id, embedding::double[] e from embeddings),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) e from unit),
s as (select q.vec_id query_id, i.vec_id vec_id, list_dot_product(q.e, i.e) sim from u q join u i on q.vec_id <> i.vec_id where q.vec_id % 20 = 0),
h as (select * from (select *, row_number() over (partition by query_id order by round(sim, 6) desc, vec_id) rank from s) where rank <= 5),
r as (select query_id, rank, vec_id, sim, round(sim, 5) similarity, round(sim * 100, 2) similarity_pct,
  case when round(sim * 100, 2) >= 35 then 'high' when round(sim * 100, 2) >= 22 then 'medium' else 'low' end confidence from h)
"""
MEANS = """with x as (select label, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) - 1 pos from embeddings),
a as (select label, pos, avg(x) x, count(*) n from x group by 1, 2),
m as (select label, pos, n, x / sqrt(sum(x * x) over (partition by label)) x from a)
"""
SCORES = (
    MEANS
    + """, p as (select label, list(x order by pos) e from m group by 1),
sc as (select v.vec_id, v.label, p.label class, round(list_dot_product(v.embedding::double[], p.e), 6) score from embeddings v, p),
rk as (select *, row_number() over (partition by vec_id order by score desc, class) rank from sc)
"""
)
TREE = """with t as (select c_custkey taxon_id, c_name, n_nationkey + 2000 own, n_regionkey + 1000 region, c_nationkey from customer join nation on c_nationkey = n_nationkey),
anc as (select taxon_id, unnest(case when c_nationkey % 2 = 0 then [region, own, region, 9999] else [region, own] end) node_id,
  unnest(case when c_nationkey % 2 = 0 then [0, 1, 2, 3] else [0, 1] end) pos from t),
nodes as (select r_regionkey + 1000 node_id, 'family' rank, r_name as name from region
  union all select n_nationkey + 2000, case when n_nationkey % 5 = 0 then 'family' else 'genus' end, n_name from nation)
"""
RANKS = ("kingdom", "phylum", "class_", "order_", "family", "genus", "species")
COUNTS = "with c as (select c_custkey, count(o_orderkey) existing from customer left join orders on o_custkey = c_custkey group by 1) "
FILES = """with f as (select regexp_extract(dir, '^[^_]*') as key, file, path from
  (select path, list_extract(string_split(path, '/'), -2) dir, list_extract(string_split(path, '/'), -1) file from test_images where path is not null)
  where regexp_matches(lower(file), '[.](jpg|jpeg|png|webp)$')) """
OUTCOMES = "with o as (select event_id // 3 batch, sum((event_type = 'signup')::int) downloaded, sum((event_type = 'error')::int) skipped from events group by 1) "
CODES = "with codes as (select s_nationkey code from supplier where s_acctbal < 0), f as (select n_nationkey::bigint code, case when n_nationkey % 4 = 0 then '' else n_name end as name from nation) "


def _path(parts: tuple[str, ...]) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif(trim({present(p)}), '')" for p in parts) + ")"


def _exploded(keys: str, column: str, source: str) -> str:
    return f"select {keys}, generate_subscripts({column}, 1) - 1 pos, round(unnest({column}), 6) x from {source}"


def _mode(keys: str, column: str, least: int, tag: str) -> str:
    return f"""{tag} as (select {keys}, max({column}) v from (select {keys}, {column}, n, max(n) over (partition by {keys}) m, sum(n) over (partition by {keys}) s
  from (select {keys}, {column}, count(*) n from g where {keys} is not null and {column} is not null group by 1, 2)) where n = m and s >= {least} group by 1 having count(*) = 1)"""


def _median(keys: str, column: str, least: int, tag: str) -> str:
    return f"{tag} as (select {keys}, quantile_disc({column}, 0.5) v from g where {keys} is not null and {column} is not null group by 1 having count(*) >= {least})"


GAPPY = f"""with g as (select row_id, {name('family')} family_key, {name('genus')} genus_key, {stripped('species')} species_key,
  {present('common_name')} common_name, {name('phylum')} phylum, {name('class_')} class_, observations_count from taxonomy_enriched)"""

P4_FOUND = f"""{GAPPY}, {_mode('species_key', 'common_name', 1, 'a')}, {_mode('family_key', 'phylum', 1, 'b')}, {_mode('family_key', 'class_', 1, 'c')}
select row_id, 'common_name' field_name, v filled_value from g join a using (species_key) where common_name is null
union all select row_id, 'phylum', v from g join b using (family_key) where phylum is null
union all select row_id, 'class_', v from g join c using (family_key) where class_ is null"""


def _filled() -> str:
    plan = {
        "common_name": (("species_key", "genus_key"), _mode, 1),
        "phylum": (("species_key", "genus_key", "family_key"), _mode, 2),
        "class_": (("species_key", "genus_key", "family_key"), _mode, 2),
        "observations_count": (("species_key", "genus_key", "family_key"), _median, 3),
    }
    parts, joins, columns = [GAPPY], [], ["g.row_id", "g.species_key", "g.genus_key", "g.family_key"]
    for column, (keys, kind, least) in plan.items():
        tags = [f"{column}{i}" for i in range(len(keys))]
        parts += [kind(k, column, least, t) for k, t in zip(keys, tags)]
        joins += [f"left join {t} on {t}.{k} = g.{k}" for k, t in zip(keys, tags)]
        found = "coalesce(" + ", ".join(f"{t}.v" for t in tags) + ")"
        level = "case " + " ".join(f"when {t}.v is not null then {i}" for i, t in enumerate(tags)) + " end"
        columns += [f"coalesce(g.{column}, {found}) {column}", f"g.{column} is null and {found} is not null {column}_filled", f"case when g.{column} is null then {level} end {column}_level"]
    return ", ".join(parts) + " select " + ", ".join(columns) + " from g " + " ".join(joins)


ORACLE = {
    "topk_single": """with u as (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) e from embeddings),
h as (select i.vec_id, list_dot_product(q.e, i.e) sim from u q, u i where q.vec_id = 0),
r as (select *, row_number() over (order by round(sim, 6) desc, vec_id) rank from h)
select rank, vec_id, round(sim, 5) similarity, round(sim * 100, 2) similarity_pct,
  case when round(sim * 100, 2) >= 35 then 'high' when round(sim * 100, 2) >= 22 then 'medium' else 'low' end confidence from r where rank <= 5""",
    "topk_batch": HITS + "select query_id, rank, vec_id, similarity from r",
    "topk_with_metadata": HITS + "select query_id, rank, vec_id, p_name, p_type from r left join part on p_partkey = vec_id",
    "confidence_tier_pct": HITS + "select query_id, rank, similarity_pct, confidence from r",
    "confidence_tier_fixed5": HITS + "select query_id, rank, case when similarity * 100 >= 35 then 'high' when similarity * 100 >= 22 then 'medium' else 'low' end confidence from r",
    "confidence_histogram": HITS + "select confidence, count(*) n from r group by 1",
    "top1_advisory": HITS + "select query_id, case when similarity_pct < 22 then 'low_confidence' when similarity_pct < 35 then 'medium_confidence' else 'none' end advisory from r where rank = 1",
    "bar_width_display": HITS + "select query_id, rank, printf('%.1f', least(100.0, similarity_pct / 50 * 100)) width, case confidence when 'high' then 'High confidence' when 'medium' then 'Medium confidence' else 'Low confidence' end as label from r",
    "null_normalized_meta": "select vec_id, " + ", ".join(f"case when {c} not in ('', 'nan', 'None') then {c} end {c}" for c in ("taxon_id", "scientific_name", "common_name", "kingdom", "family", "genus")) + " from bioclip_full_index",
    "clamp_topk": "select p_partkey, least(greatest(p_size - 10, 1), 20)::bigint k from part",
    "l2_normalize": "with s as (select vec_id, list_transform(embedding::double[], lambda x: x * (vec_id + 1)) e from embeddings), n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) v from s) " + _exploded("vec_id", "v", "n"),
    "l2_normalize_guarded": """with s as (select vec_id, list_transform(embedding::double[], lambda x: x * case when vec_id % 7 = 0 then 0.0 else 3.0 end) e from embeddings),
n as (select vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-8)) a from s),
u as (select vec_id, generate_subscripts(a, 1) - 1 pos, unnest(a) x from n)
select vec_id, pos, round(x, 6) + 0.0 clipped, round(x, 6) + 0.0 if_long from u""",
    "ensemble3": """with x as (select vec_id, generate_subscripts(embedding, 1) - 1 pos, unnest(embedding::double[]) x from embeddings),
s as (select a.vec_id, a.pos, (a.x + b.x + c.x) / 3 x from x a join x b on b.vec_id = a.vec_id + 1 and b.pos = a.pos join x c on c.vec_id = a.vec_id + 2 and c.pos = a.pos)
select vec_id, pos, round(x / greatest(sqrt(sum(x * x) over (partition by vec_id)), 1e-8), 6) x from s""",
    "class_mean": MEANS + "select label::bigint as label, n, pos, round(x, 6) x from m",
    "class_coverage": MEANS + "select l.range as label, coalesce(n, 0) n, n is not null covered, round(coalesce(x, 0.0), 6) first_value from range(12) l left join m on m.label = l.range and pos = 0",
    "coverage_totals": "with c as (select l.range, count(e.vec_id) n from range(12) l left join embeddings e on e.label = l.range group by 1) select count(*) filter (where n > 0) covered, count(*) total, count(*) filter (where n = 0) uncovered from c",
    "nearest_prototype": SCORES + "select vec_id, class::bigint predicted, score from rk where rank = 1",
    "accuracy_at_k": SCORES + "select count(*) n, " + ", ".join(f"round(avg((rank <= {k})::int), 6) acc{k}" for k in (1, 3, 5)) + " from rk where label = class",
    "macro_auc": SCORES + """, w as (select class, label = class pos, rank() over (partition by class order by score) + (count(*) over (partition by class, score) - 1) / 2 r from sc),
areas as (select class, (sum(case when pos then r end) - sum(pos::int) * (sum(pos::int) + 1) / 2) / (sum(pos::int) * sum((not pos)::int)) auc from w group by 1)
select round(avg(auc), 6) macro_auc from areas""",
    "per_class_accuracy": SCORES + ", o as (select label, count(*) n, avg((label = class)::int) a from rk where rank = 1 group by 1) select sum(n)::bigint n_rows, count(*) classes, round(avg(a), 6) mean_acc, round(median(a), 6) median_acc, round(min(a), 6) min_acc, round(max(a), 6) max_acc from o",
    "index_stats": "select count(*) n_rows, max(len(embedding)) dim, count(distinct label) classes from embeddings",
    "species_ranking": f"select row_number() over (order by photos desc, taxon_id) rank, taxon_id, photos from (select {TAXON} taxon_id, count(*) photos from test_images where {TAXON} is not null group by 1 order by photos desc, taxon_id limit 500)",
    "page_plan": "with n as (select count(*) n from global_plants_top5000) select p.range page, least(500, n - (p.range - 1) * 500) size from n, range(1, 1000000) p where p.range <= ceil(n / 500)",
    "ancestor_distinct": TREE + "select distinct node_id from anc",
    "taxonomy_pivot": TREE + """select t.taxon_id, '' kingdom, '' class_,
  coalesce((select max_by(name, pos) from anc join nodes using (node_id) where anc.taxon_id = t.taxon_id and rank = 'family'), '') family,
  coalesce((select max_by(name, pos) from anc join nodes using (node_id) where anc.taxon_id = t.taxon_id and rank = 'genus'), '') genus, c_name species from t""",
    "taxonomy_enrich_left": f"""with e as (select {TAXON} taxon_id, row_id, """ + ", ".join(f"{present(c)} {c}" for c in ("kingdom", "phylum", "family", "genus")) + f""" from taxonomy_enriched where {TAXON} is not null),
f as (select taxon_id, """ + ", ".join(f"min_by({c}, row_id) filter (where {c} is not null) {c}" for c in ("kingdom", "phylum", "family", "genus")) + f""" from e group by 1)
select s.rank, {TAXON.replace('taxon_id', 's.taxon_id')} taxon_id, s.observations_count, coalesce(f.kingdom, 'Plantae') kingdom, coalesce(f.phylum, '') phylum, coalesce(f.family, '') family, coalesce(f.genus, '') genus
from global_plants_top5000 s left join f on f.taxon_id = {TAXON.replace('taxon_id', 's.taxon_id')}""",
    "cache_validity": f"select count(*) n_rows, count({present('phylum')}) filled, count({present('phylum')}) > 0.5 * count(*) valid from taxonomy_enriched",
    "prompt_taxpath": f"select row_id, case when {_path(RANKS)} <> '' then 'a photo of ' || {_path(RANKS)} else '' end prompt from taxonomy_enriched",
    "prompt_sci": f"select row_id, coalesce('a photo of ' || trim({present('scientific_name')}), '') prompt from taxonomy_enriched",
    "prompt_common": f"select row_id, coalesce('a photo of ' || trim(coalesce({present('common_name')}, {present('scientific_name')})), '') prompt from taxonomy_enriched",
    "legacy_path": f"select row_id, {_path((*RANKS[:-1], 'scientific_name'))} path from taxonomy_enriched",
    "parse_rank_array": """with r as (select vec_id, case when vec_id % 3 = 0 then string_split(taxon_path, ' ')[1:4] else string_split(taxon_path, ' ') end r from bioclip_full_index),
c as (select vec_id, r, """ + ", ".join(f"coalesce(r[{k + 1}], '') {n}" for k, n in enumerate((*RANKS[:-1], "epithet"))) + """ from r)
select vec_id, kingdom, phylum, class_, order_, family, genus, epithet, concat_ws(' ', nullif(genus, ''), nullif(epithet, '')) as name, coalesce(array_to_string(list_filter(r, lambda x: x <> ''), ' '), '') path from c""",
    "kingdom_filter": "select vec_id, scientific_name, kingdom from bioclip_full_index where kingdom = 'Plantae'",
    "native_regions": CODES + "select code, coalesce(nullif(name, ''), code::varchar) as name from f where code in (select code from codes)",
    "background_regions": CODES + "select code from f where code not in (select code from codes)",
    "native_match_stats": CODES + "select (select count(distinct code) from codes) native_codes, (select count(*) from f where code in (select code from codes)) matched_features",
    "lookup_chain": "select n_nationkey::varchar code, n_name as name from nation where n_regionkey = (select min(r_regionkey) from region where r_name = (select min(r_name) from region))",
    "panel_defaults": "select vec_id, " + ", ".join(f"coalesce(nullif({c}, ''), 'N/A') {c}" for c in ("taxon_id", "common_name", "family")) + " from bioclip_full_index",
    "safe_dirname": """select row_id, row_id || '_' || trim(regexp_replace(concat_ws('/', scientific_name, common_name), '[\\\\/:*?"<>|]', '_', 'g'), E' \\t\\n') dirname from taxonomy_enriched""",
    "url_size_rewrite": "select image_id, regexp_replace(url, '/(square|small|medium|large|original)[.]', '/medium.', 'g') url from test_images",
    "photos_first_n": f"""with p as (select {TAXON} taxon, obs_id, photo_id, image_id from test_images where coalesce(url, '') <> '' and {TAXON} is not null),
r as (select *, row_number() over (partition by taxon order by obs_id nulls first, photo_id nulls first, image_id) position from p)
select taxon, position, image_id, obs_id || '_' || photo_id || '.jpg' file from r where position <= 5""",
    "files_scan": FILES + f""", d as (select distinct * from f where key in (select {TAXON}::varchar from global_plants_top5000 where {TAXON} is not null))
select key, file, position from (select key, file, row_number() over (partition by key order by path) position from d) where position <= 3""",
    "files_totals": FILES + "select count(distinct key) classes, count(*) files from f",
    "gap_scan": COUNTS + "select c_custkey, existing from c where existing < 10",
    "gap_totals": COUNTS + "select count(*) filter (where existing < 10) missing, count(*) filter (where existing >= 10) complete from c",
    "resume_need": COUNTS + "select c_custkey, greatest(10 - existing, 0) need from c where existing < 10",
    "resume_plan": f"""with p as (select {TAXON} taxon, obs_id || '_' || photo_id || '.jpg' file, image_id from test_images where obs_id <> 0 and photo_id is not null and {TAXON} is not null),
l as (select distinct taxon, file from p where file not in (select file from p where image_id % 2 = 0))
select taxon, file, position from (select *, row_number() over (partition by taxon order by file) position from l) where position <= 3""",
    "sample_exact": "select p_partkey from part order by substr(md5('42:' || p_partkey), 1, 15) limit (select cast(floor(count(*) * 0.8) as bigint) from part)",
    "outcome_totals": OUTCOMES + "select count(*) classes, sum(downloaded)::bigint downloaded, sum(skipped)::bigint skipped, count(*) filter (where downloaded = 0 and skipped = 0) failures from o",
    "failure_head": OUTCOMES + "select batch, greatest(count(*) over () - 20, 0) beyond from o where downloaded = 0 and skipped = 0 order by batch limit 20",
    "json_props": "select event_id, coalesce(json_extract_string(props, '$.k')::bigint, 0) k, coalesce(json_extract_string(props, '$.none_such'), '') other from events",
    "strip_and_underscore": "select p_partkey, p_name stripped, replace(p_name, ' ', '_') || '_native.html' map_file from part",
    "base64_roundtrip": "select doc_id, base64(coalesce(source, '')::blob) coded, coalesce(source, '') source from documents",
    "url_suffix": """with u as (select image_id, coalesce(case when image_id % 5 = 0 then url || '?size=x.png' when image_id % 5 = 1 then regexp_replace(url, '[.][a-z]+$', '') else url end, '') url from test_images),
x as (select image_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([.][A-Za-z0-9]+)$', 1) e from u) select image_id, case when e <> '' then e else '.jpg' end suffix from x""",
    "batch_id_lists": f"with k as (select distinct {TAXON} t from taxonomy_enriched where {TAXON} is not null), r as (select t, (row_number() over (order by t) - 1) // 30 batch from k) select batch, string_agg(t::varchar, ',' order by t) ids from r group by 1",
    "size_label_map": "select p_partkey, case p_type when 'ECONOMY' then 'small' when 'SMALL' then 'small' when 'MEDIUM' then 'medium' when 'LARGE' then 'large' else 'medium' end size from part",
    "union_all_batches": "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)",
    "p4_found": P4_FOUND,
    "p4_filled": _filled(),
}
