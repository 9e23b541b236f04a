"""The engine's queries over the driver's tables, with their DuckDB statements in sql.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phytomill.functions import clean, text
from phytomill.operators import acquire, evaluate, impute, regions, search, taxonomy, vector
from phytomill.plans.sql import ORACLE  # noqa: F401
from phytomill.runtime import materialize, read

DIMS = 64


def _big(*columns: str) -> dict:
    return {c: F.col(c).cast("bigint") for c in columns}


# search
def _hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The k nearest other rows of every row whose id is divisible by 20."""
    index = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = index.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return search.topk(index, asked, k, "vec_id", "query_id", exclude_self=True)


def topk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = index.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    return search.results(search.topk(index, asked, 5, "vec_id", "query_id")).select("rank", "vec_id", "similarity", "similarity_pct", "confidence")


def topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.results(_hits(spark, sf_dir)).select("query_id", "rank", "vec_id", "similarity")


def topk_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_name", "p_type")
    return search.results(_hits(spark, sf_dir)).join(part, "vec_id", "left").select("query_id", "rank", "vec_id", "p_name", "p_type")


def confidence_tier_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.results(_hits(spark, sf_dir)).select("query_id", "rank", "similarity_pct", "confidence")


def confidence_tier_fixed5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "rank", search.tier_of_rounded(F.col("sim")).alias("confidence"))


def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.results(_hits(spark, sf_dir)).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def top1_advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.results(_hits(spark, sf_dir)).filter("rank = 1")
    return best.select("query_id", search.advisory(F.col("similarity_pct")).alias("advisory"))


def bar_width_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = search.results(_hits(spark, sf_dir))
    return shown.select("query_id", "rank", search.bar_width(F.col("similarity_pct")).alias("width"), search.tier_label(F.col("confidence")).alias("label"))


def null_normalized_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = read(spark, sf_dir, "bioclip_full_index")
    return index.select("vec_id", *[search.null_meta(F.col(c)).alias(c) for c in ("taxon_id", "scientific_name", "common_name", "kingdom", "family", "genus")])


def clamp_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", search.clamp_k(F.col("p_size") - 10).cast("bigint").alias("k"))


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = search.results(_hits(spark, sf_dir))
    row = F.to_json(F.struct("rank", "vec_id", "similarity", "similarity_pct", "confidence"), {"ignoreNullFields": "false"})
    return shown.groupBy("query_id").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(row)), ","), F.lit("]")).alias("results"))


# vectors and evaluation
def _exploded(df: DataFrame, *keys: str, column: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("pos", "x")).select(*keys, F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    return _exploded(read(spark, sf_dir, "embeddings").select("vec_id", vector.l2_normalize(scaled).alias("v")), "vec_id", column="v")


def l2_normalize_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    some_zero = F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(3.0))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", some_zero.alias("e"))
    rows = rows.select("vec_id", F.arrays_zip(vector.l2_normalize_clipped(F.col("e")).alias("a"), vector.l2_normalize_if_long(F.col("e")).alias("b")).alias("z"))
    return rows.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), (F.round("z.a", 6) + 0.0).alias("clipped"), (F.round("z.b", 6) + 0.0).alias("if_long"))


def ensemble3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    second = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    third = rows.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("e3"))
    joined = rows.join(second, "vec_id").join(third, "vec_id")
    return _exploded(joined.select("vec_id", vector.ensemble(F.col("embedding"), F.col("e2"), F.col("e3")).alias("v")), "vec_id", column="v")


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.class_mean(read(spark, sf_dir, "embeddings"), "label", "embedding", DIMS)


def class_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_means(spark, sf_dir), "label", "n", column="mean").withColumns(_big("label"))


def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.range(12).select(F.col("id").cast("int").alias("label"))
    out = vector.aligned_means(classes, _means(spark, sf_dir), "label", DIMS)
    return out.select(F.col("label").cast("bigint").alias("label"), "n", "covered", F.round(F.get("mean", F.lit(0)), 6).alias("first_value"))


def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = class_coverage(spark, sf_dir)
    return out.agg(F.count_if(F.col("n") > 0).alias("covered"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") == 0).alias("uncovered"))


def _class_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_ranks(read(spark, sf_dir, "embeddings"), _means(spark, sf_dir), "vec_id", "label", "embedding")


def nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_ranks(spark, sf_dir).select("vec_id", F.col("predicted").cast("bigint").alias("predicted"), "score")


def accuracy_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy_at_k(_class_ranks(spark, sf_dir))


def macro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_auc(evaluate.class_areas(read(spark, sf_dir, "embeddings"), _means(spark, sf_dir), "vec_id", "label", "embedding"))


def per_class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_class_accuracy(_class_ranks(spark, sf_dir), "label")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.index_stats(read(spark, sf_dir, "embeddings"), "embedding", "label")


# species list and taxonomy
def species_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 taxa with most photos, with their place."""
    photos = read(spark, sf_dir, "test_images").select(clean.whole_number(F.col("taxon_id")).alias("taxon_id")).dropna()
    top = photos.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("photos")).orderBy(F.desc("photos"), "taxon_id").limit(500)
    return acquire.with_ordinal(top.withColumn("_o", -F.col("photos")), ["_o", "taxon_id"], "rank").select("rank", "taxon_id", "photos")


def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = read(spark, sf_dir, "global_plants_top5000").count()
    return acquire.page_plan(total, 500, spark)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as taxa: ancestors are 1000 + region and 2000 + nation, and once more the nation when its key is even."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = read(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey", "left")
    region, own = (F.col("n_regionkey") + 1000).cast("bigint"), (F.col("c_nationkey") + 2000).cast("bigint")
    ids = F.when(F.col("c_nationkey") % 2 == 0, F.array(region, own, region, F.lit(9999).cast("bigint"))).otherwise(F.array(region, own))
    return rows.select(F.col("c_custkey").alias("taxon_id"), ids.alias("ancestor_ids"), F.lit("species").alias("rank"), F.col("c_name").alias("name"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("bigint").alias("node_id"), F.lit("family").alias("rank"), F.col("r_name").alias("name"))
    nation = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2000).cast("bigint").alias("node_id"), F.when(F.col("n_nationkey") % 5 == 0, "family").otherwise("genus").alias("rank"), F.col("n_name").alias("name"))
    return region.union(nation)


def ancestor_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.distinct_ancestors(_tree(spark, sf_dir))


def taxonomy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = taxonomy.pivot_ranks(_tree(spark, sf_dir), _nodes(spark, sf_dir), "taxon_id")
    return wide.select("taxon_id", "kingdom", "class_", "family", "genus", "species")


def taxonomy_enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The species list with each taxon's first ranks among its enriched rows."""
    listed = read(spark, sf_dir, "global_plants_top5000").select("rank", clean.whole_number(F.col("taxon_id")).alias("taxon_id"), "observations_count")
    ranks = read(spark, sf_dir, "taxonomy_enriched").withColumn("taxon_id", clean.whole_number(F.col("taxon_id"))).filter("taxon_id is not null")
    named = {c: clean.present(F.col(c)) for c in ("kingdom", "phylum", "family", "genus")}
    first = ranks.withColumns(named).groupBy("taxon_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_id"))).alias(c) for c in named])
    return taxonomy.enrich(listed, first, columns=tuple(named))


def cache_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = read(spark, sf_dir, "taxonomy_enriched").withColumnRenamed("order_", "order").withColumn("phylum", clean.present(F.col("phylum")))
    return taxonomy.cache_valid(cache)


RANK_COLUMNS = ("kingdom", "phylum", "class_", "order_", "family", "genus", "species")


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "taxonomy_enriched")
    return rows.withColumns({c: clean.present(F.col(c)) for c in (*RANK_COLUMNS, "common_name", "scientific_name")})


def prompt_taxpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).select("row_id", text.path_prompt([F.col(c) for c in RANK_COLUMNS]).alias("prompt"))


def prompt_sci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).select("row_id", text.name_prompt(F.col("scientific_name")).alias("prompt"))


def prompt_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).select("row_id", text.common_prompt(F.col("common_name"), F.col("scientific_name")).alias("prompt"))


def legacy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in (*RANK_COLUMNS[:-1], "scientific_name")]
    return _ranks(spark, sf_dir).select("row_id", text.join_filled(parts).alias("path"))


def parse_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank arrays of differing length out of the full index's paths."""
    ranks = F.split("taxon_path", " ")
    rows = read(spark, sf_dir, "bioclip_full_index").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.slice(ranks, 1, 4)).otherwise(ranks).alias("r"))
    at = {n: text.rank_at(F.col("r"), k) for k, n in enumerate(("kingdom", "phylum", "class_", "order_", "family", "genus", "epithet"))}
    return rows.select("vec_id", *[c.alias(n) for n, c in at.items()], text.binomial(at["genus"], at["epithet"]).alias("name"), text.path_of(F.col("r")).alias("path"))


def kingdom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "bioclip_full_index").filter("kingdom = 'Plantae'").select("vec_id", "scientific_name", "kingdom")


# regions
def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations where suppliers of negative balance sit, as native codes."""
    return read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("code"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("name"))


def native_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.native_regions(_features(spark, sf_dir), _codes(spark, sf_dir), "code", "name").withColumns(_big("code"))


def background_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.background_regions(_features(spark, sf_dir), _codes(spark, sf_dir), "code").select(F.col("code").cast("bigint").alias("code"))


def native_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.match_stats(_features(spark, sf_dir), _codes(spark, sf_dir), "code")


def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's name, its key, its nations' keys, their features."""
    region = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id"))
    first = region.agg(F.min("name")).first()[0] or ""
    found = regions.name_to_id(region, first)
    nation = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), F.col("n_nationkey").cast("string").alias("code"))
    codes = regions.native_codes(nation.join(found, "id", "left_semi"), "id", "code")
    features = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return regions.native_regions(features, codes, "code", "name")


def panel_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "bioclip_full_index")
    return rows.select("vec_id", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A")).alias(c) for c in ("taxon_id", "common_name", "family")])


def feature_collection_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = native_regions(spark, sf_dir).withColumn("geometry", F.lit(None).cast("string"))
    return regions.feature_collection(rows, "geometry", ["code", "name"])


# files and acquisition
def safe_dirname(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", F.col("scientific_name"), F.col("common_name"))
    return read(spark, sf_dir, "taxonomy_enriched").select("row_id", text.safe_dirname(F.col("row_id"), name).alias("dirname"))


def url_size_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "test_images").select("image_id", text.resized_url(F.col("url"), "medium").alias("url"))


def photos_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five photos with an address of each taxon, by observation and photo."""
    photos = read(spark, sf_dir, "test_images").filter(F.coalesce("url", F.lit("")) != "")
    photos = photos.select(clean.whole_number(F.col("taxon_id")).alias("taxon"), "obs_id", "photo_id", "image_id").dropna(subset=["taxon"])
    first = acquire.first_n(photos, "taxon", [F.asc_nulls_first("obs_id"), F.asc_nulls_first("photo_id"), "image_id"], 5)
    return first.select("taxon", "position", "image_id", text.photo_file(F.col("obs_id"), F.col("photo_id")).alias("file"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, file, path) of the stored photos' paths."""
    path = F.split("path", "/")
    rows = read(spark, sf_dir, "test_images").filter("path is not null").select("path", F.element_at(path, -2).alias("dir"), F.element_at(path, -1).alias("file"))
    return rows.select(text.dir_key(F.col("dir")).alias("key"), "file", "path").filter(text.is_image(F.col("file")))


def files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three files, by path, of each directory of a listed taxon."""
    known = read(spark, sf_dir, "global_plants_top5000").select(clean.whole_number(F.col("taxon_id")).cast("string").alias("key")).dropna().distinct()
    files = _files(spark, sf_dir).distinct().join(known, "key", "left_semi")
    return acquire.first_n(files, "key", ["path"], 3).select("key", "file", "position")


def files_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).agg(F.countDistinct("key").alias("classes"), F.count(F.lit(1)).alias("files"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return acquire.existing_counts(read(spark, sf_dir, "customer"), orders, "c_custkey")


def gap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.gaps(_counts(spark, sf_dir), 10).select("c_custkey", "existing")


def gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.col("existing") < 10
    return _counts(spark, sf_dir).agg(F.count_if(short).alias("missing"), F.count_if(~short).alias("complete"))


def resume_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.gaps(_counts(spark, sf_dir), 10).select("c_custkey", "need")


def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to fetch: files not stored yet, then up to three an observation's taxon."""
    photos = read(spark, sf_dir, "test_images").filter("obs_id is not null and obs_id <> 0 and photo_id is not null")
    photos = photos.select(clean.whole_number(F.col("taxon_id")).alias("taxon"), text.photo_file(F.col("obs_id"), F.col("photo_id")).alias("file"), "image_id").dropna()
    stored = photos.filter(F.col("image_id") % 2 == 0)
    return acquire.plan_fetch(photos.select("taxon", "file").distinct(), stored, "taxon", "file", ["file"], 3).select("taxon", "file", "position")


def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.sample_exact(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 0.8)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda t: F.count_if(F.col("event_type") == t).cast("int")
    batch = F.floor(F.col("event_id") / 3).alias("batch")  # some hold neither kind of event
    return read(spark, sf_dir, "events").groupBy(batch).agg(own("signup").alias("downloaded"), own("error").alias("skipped"))


def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.outcome_totals(_outcomes(spark, sf_dir))


def failure_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.failure_head(_outcomes(spark, sf_dir), "batch").select("batch", "beyond")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda name: F.get_json_object("props", f"$.{name}")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(field("k").cast("bigint"), F.lit(0)).alias("k"), F.coalesce(field("none_such"), F.lit("")).alias("other"))


def strip_and_underscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \t\n"), F.col("p_name"), F.lit(" \n"))
    rows = read(spark, sf_dir, "part").select("p_partkey", text.strip(padded).alias("stripped"))
    return rows.withColumn("map_file", F.concat(text.underscored(F.col("stripped")), F.lit("_native.html")))


def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.base64(F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    rows = read(spark, sf_dir, "documents").select("doc_id", coded.alias("coded"))
    return rows.select("doc_id", "coded", F.decode(F.unbase64("coded"), "UTF-8").alias("source"))


def url_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("image_id") % 5 == 0, F.concat(F.col("url"), F.lit("?size=x.png"))).when(F.col("image_id") % 5 == 1, F.regexp_replace("url", r"\.[a-z]+$", "")).otherwise(F.col("url"))
    return read(spark, sf_dir, "test_images").select("image_id", text.url_suffix(F.coalesce(url, F.lit(""))).alias("suffix"))


def batch_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "taxonomy_enriched").select(clean.whole_number(F.col("taxon_id")).alias("taxon_id"))
    return acquire.id_batches(ids, "taxon_id", 30)


def size_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for x in ("ECONOMY", "small", "SMALL", "small", "MEDIUM", "medium", "LARGE", "large")])
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(labels, F.col("p_type")), F.lit("medium")).alias("size"))


def union_all_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = orders.filter("o_orderkey % 3 = 0").unionByName(orders.filter("o_orderkey % 3 <> 0"))
    rich = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return both.join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


# problem 4: missing values
def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "taxonomy_enriched")
    ranks = {c: clean.name(F.col(c)) for c in ("phylum", "class_")}
    keys = {"family_key": clean.name(F.col("family")), "genus_key": clean.name(F.col("genus")), "species_key": clean.strip(clean.present(F.col("species")))}
    return rows.withColumns(ranks | keys | {"common_name": clean.present(F.col("common_name"))})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [impute.Target("common_name", [["species_key"]]), impute.Target("phylum", [["family_key"]]), impute.Target("class_", [["family_key"]])]
    rows = _gappy(spark, sf_dir).select("row_id", "species_key", "family_key", "common_name", "phylum", "class_")
    done = materialize(impute.group_fill(rows, targets), "filled")
    parts = [done.filter(f"{c}_filled").select("row_id", F.lit(c).alias("field_name"), F.col(c).alias("filled_value")) for c in ("common_name", "phylum", "class_")]
    return parts[0].union(parts[1]).union(parts[2])


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, filled from species, genus or family with flags; counts by median of at least three."""
    targets = [
        impute.Target("common_name", [["species_key"], ["genus_key"]]),
        impute.Target("phylum", [["species_key"], ["genus_key"], ["family_key"]], min_support=2),
        impute.Target("class_", [["species_key"], ["genus_key"], ["family_key"]], min_support=2),
        impute.Target("observations_count", [["species_key"], ["genus_key"], ["family_key"]], kind="median", min_support=3),
    ]
    rows = _gappy(spark, sf_dir).select("row_id", "species_key", "genus_key", "family_key", "common_name", "phylum", "class_", "observations_count")
    return impute.group_fill(rows, targets)


QUERIES = {
    f.__name__: f
    for f in (
        topk_single, topk_batch, topk_with_metadata, confidence_tier_pct, confidence_tier_fixed5, confidence_histogram, top1_advisory,
        null_normalized_meta, bar_width_display, l2_normalize, l2_normalize_guarded, ensemble3, class_mean, class_coverage,
        coverage_totals, nearest_prototype, accuracy_at_k, macro_auc, per_class_accuracy, index_stats, species_ranking, page_plan,
        ancestor_distinct, taxonomy_pivot, taxonomy_enrich_left, cache_validity, prompt_taxpath, prompt_sci, prompt_common,
        legacy_path, parse_rank_array, kingdom_filter, native_regions, background_regions, native_match_stats, lookup_chain,
        panel_defaults, safe_dirname, url_size_rewrite, photos_first_n, files_scan, files_totals, gap_scan, gap_totals, resume_need,
        resume_plan, sample_exact, outcome_totals, failure_head, json_props, feature_collection_json, strip_and_underscore,
        base64_roundtrip, url_suffix, batch_id_lists, size_label_map, clamp_topk, union_all_batches, result_json, p4_found, p4_filled,
    )
}
