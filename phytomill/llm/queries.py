"""The pN_ queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phytomill.functions import clean
from phytomill.llm import clusters, knn, leaks, mixing, sample, splits, subjects, topn
from phytomill.runtime import materialize, read, scratch

SPLIT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
SAMPLE_SHARE = 0.2


# problem 1
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, taxon_id, observations_count): one row a taxon that has both."""
    listed = read(spark, sf_dir, "global_plants_top5000").select(clean.whole_number(F.col("taxon_id")).alias("taxon_id"), "observations_count", "fetched_at")
    newest = listed.dropna(subset=["taxon_id", "observations_count"]).groupBy("taxon_id").agg(F.max(F.struct("fetched_at", "observations_count"))["observations_count"].alias("observations_count"))
    ranks = read(spark, sf_dir, "taxonomy_enriched").select(clean.whole_number(F.col("taxon_id")).alias("taxon_id"), clean.name(F.col("family")).alias("family"))
    family = ranks.dropna().groupBy("taxon_id").agg(F.min("family").alias("family"))
    return newest.join(family, "taxon_id").select("family", "taxon_id", "observations_count")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n_per_group(family_counts(spark, sf_dir), "family", "observations_count", "taxon_id", 5).select("family", "taxon_id")


def p1_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with n = 100 and the counts."""
    return topn.top_n_per_group(family_counts(spark, sf_dir), "family", "observations_count", "taxon_id", 100)


# problem 2
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, taxon and obs as numbers (null where unknown), genus."""
    obs = F.when(F.col("obs_id") != 0, F.col("obs_id"))
    genus = F.substring_index(clean.strip(clean.present(F.col("scientific_name"))), " ", 1)
    return read(spark, sf_dir, "test_images").select("image_id", clean.whole_number(F.col("taxon_id")).alias("taxon"), obs.alias("obs"), genus.alias("genus"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = materialize(splits.linked_entities(images(spark, sf_dir).select("obs", "taxon").distinct(), "obs", "taxon"), "taxon-labels")
    low = labels.select("label", F.col("taxon").alias("taxon_lo"))
    high = labels.select("label", F.col("taxon").alias("taxon_hi"))
    return low.join(high, "label").filter("taxon_lo < taxon_hi").select("taxon_lo", "taxon_hi")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(splits.components(images(spark, sf_dir), "image_id", "obs", "taxon"), "components")
    return splits.assign_groups(rows, "component", "genus", SPLIT_SHARES)


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("image_id", "component", "split")


def p2_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the splits divide each genus, and all images."""
    return splits.split_balance(_split(spark, sf_dir), "genus", SPLIT_SHARES)


# problem 3
def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, taxon, chosen_at of all rows of the taxa in the sample after the fifth delivery, drawn delivery by delivery."""
    rows = read(spark, sf_dir, "taxonomy_enriched").select("row_id", clean.whole_number(F.col("taxon_id")).alias("taxon"), "batch_no")
    first = materialize(rows.dropna(subset=["taxon"]).groupBy("taxon").agg(F.min("batch_no").alias("batch_no")), "first-batch")
    path = scratch(spark, "ledger")  # a pipeline names a lasting folder
    for batch in range(1, 6):
        ledger = sample.grow_ledger(first.filter(F.col("batch_no") <= batch), path, "taxon", SAMPLE_SHARE, batch)
    return rows.join(ledger.select("taxon", "chosen_at"), "taxon").select("row_id", "taxon", "chosen_at")


# problem 5
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.nearest(read(spark, sf_dir, "image_index"), read(spark, sf_dir, "bioclip_full_index"), 3, "img_vec_id", "vec_id")
    return found.select("img_vec_id", "vec_id")


def p5_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_vec_id, vec_id, similarity): within the name index, for every row whose id is divisible by 20."""
    index = read(spark, sf_dir, "bioclip_full_index")
    return knn.nearest(index.filter(F.col("vec_id") % 20 == 0), index, 3, "vec_id", "vec_id", same=True)


# problem 6
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(read(spark, sf_dir, "bioclip_full_index"), "vec_id").select("vec_id", "cluster_id")


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cluster: size, families, commonest family and its share, most typical entries."""
    index = read(spark, sf_dir, "bioclip_full_index")
    members = materialize(clusters.cluster(index, "vec_id"), "members")
    return clusters.describe(members, index.select("vec_id", clean.name(F.col("family")).alias("family")), "vec_id", "family")


# problem 7
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, leaked stretches cut out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.remove_leaks(docs, read(spark, sf_dir, "eval_items"))


# problem 8
def mix_plan(spark: SparkSession, sf_dir: str, target_size: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    sized = materialize(mixing.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "source", "text")), "sizes")
    return sized, mixing.plan_mix(sized, read(spark, sf_dir, "mix_targets"), target_size=target_size)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(spark, sf_dir)[1].filter("not reachable").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw_mix(*mix_plan(spark, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, plan = mix_plan(spark, sf_dir)
    return mixing.report_mix(mixing.draw_mix(sized, plan), plan)


def p8_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the largest mix in which every source reaches its share."""
    sized, plan = mix_plan(spark, sf_dir, "feasible")
    return mixing.report_mix(mixing.draw_mix(sized, plan), plan)


# problem 9
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    model = subjects.fit_subjects(docs, read(spark, sf_dir, "subject_labels"), read(spark, sf_dir, "subject_areas"), hint="source")
    return subjects.assign_subjects(docs, model).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p1_found, p1_top100, p2_found, p2_splits, p2_balance, p3_sample, p5_found, p5_within, p6_found, p6_clusters, p7_found, p7_clean, p8_found, p8_mix, p8_report, p8_feasible, p9_found)}
