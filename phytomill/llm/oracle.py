"""DuckDB statements for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

from phytomill.plans.sql import TAXON, name


def top_counts(n: int, columns: str) -> str:
    return f"""
with newest as (select t taxon_id, c observations_count from (select {TAXON} t, observations_count c, row_number() over (
    partition by {TAXON} order by fetched_at desc nulls last, observations_count desc) r
    from global_plants_top5000 where observations_count is not null and {TAXON} is not null) where r = 1),
fam as (select {TAXON} taxon_id, min({name('family')}) family from taxonomy_enriched where {name('family')} is not null and {TAXON} is not null group by 1),
ranked as (select family, taxon_id, observations_count, row_number() over (partition by family order by observations_count desc, taxon_id) r
    from newest join fam using (taxon_id))
select {columns} from ranked where r <= {n}"""


P2_FOUND = f"""
with recursive e as (select distinct obs_id o, {TAXON} t from test_images where obs_id <> 0 and {TAXON} is not null),
k as (select distinct a.t a, b.t b from e a join e b on a.o = b.o and a.t <> b.t),
reach(a, b) as (select a, b from k union select r.a, k.b from reach r join k on r.b = k.a)
select a taxon_lo, b taxon_hi from reach where a < b"""


def ledger_sql(share: float, batches: int = 5) -> str:
    pr = "substr(md5('sample:' || cast(taxon as varchar)), 1, 15)"
    parts = [f"f as (select {TAXON} taxon, min(batch_no) b from taxonomy_enriched where {TAXON} is not null group by 1)"]
    for i in range(1, batches + 1):
        old = f"(select * from l{i - 1})" if i > 1 else "(select cast(null as bigint) taxon, 0 chosen_at where false)"
        quota = f"(select cast(ceil(count(*) * {share}) as bigint) from f where b <= {i}) - (select count(*) from {old})"
        parts.append(
            f"n{i} as (select taxon, row_number() over (order by {pr}) r from f where b <= {i} and taxon not in (select taxon from {old}))"
        )
        parts.append(f"l{i} as (select taxon, chosen_at from {old} union all select taxon, {i} from n{i} where r <= {quota})")
    return "with " + ", ".join(parts) + f" select row_id, taxon, chosen_at from (select row_id, {TAXON} taxon from taxonomy_enriched) join l{batches} using (taxon)"


def neighbours(ask: str, ask_id: str, where: str, columns: str) -> str:
    usable = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0"
    cosine = "round(list_cosine_similarity(q.e, i.e), 5)"
    return f"""
with q as (select {ask_id} id, embedding::double[] e from {ask} where {usable} and {where}),
i as (select vec_id id, embedding::double[] e from bioclip_full_index where {usable}),
s as (select q.id qid, i.id iid, {cosine} similarity from q join i on {'q.id <> i.id' if ask == 'bioclip_full_index' else 'true'}),
r as (select *, row_number() over (partition by qid order by similarity desc, iid) n from s)
select {columns} from r where n <= 3"""


ORACLE = {
    "p1_found": top_counts(5, "family, taxon_id"),
    "p1_top100": top_counts(100, "family, taxon_id, observations_count"),
    "p2_found": P2_FOUND,
    "p5_found": neighbours("image_index", "img_vec_id", "true", "qid img_vec_id, iid vec_id"),
    "p5_within": neighbours("bioclip_full_index", "vec_id", "vec_id % 20 = 0", "qid query_vec_id, iid vec_id, similarity"),
    "p3_sample": ledger_sql(0.2),
}
