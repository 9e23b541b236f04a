"""Enrichment of a species list with its ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytomill.runtime import lookup_join

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")  # fixed values, in this order
COLUMNS = {r: "class_" if r == "class" else r for r in RANKS}


def distinct_ancestors(taxa: DataFrame, ancestors: str = "ancestor_ids") -> DataFrame:
    """(node_id): every id in any ancestor list, once."""
    return taxa.select(F.explode(ancestors).alias("node_id")).dropna().distinct()


def pivot_ranks(taxa: DataFrame, nodes: DataFrame, key: str, ancestors: str = "ancestor_ids", columns: Mapping[str, str] = COLUMNS) -> DataFrame:
    """(key, one column a rank): the name of the last ancestor of each rank; the taxon's own rank and name go over it.

    taxa: (key, ancestor ids, rank, name); nodes: (node_id, rank, name). Unknown ids and ranks give blanks ('').
    """
    rows = taxa.select(key, F.posexplode(ancestors).alias("pos", "node_id"))
    rows = lookup_join(rows, nodes.select("node_id", "rank", "name"), ["node_id"], "inner").select(key, "pos", "rank", "name")
    own = taxa.select(key, F.lit(1 << 30).alias("pos"), "rank", "name")
    every = rows.unionByName(own).unionByName(taxa.select(key, F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("rank"), F.lit(None).cast("string").alias("name")))
    last = lambda r: F.max_by(F.when(F.col("rank") == r, F.col("name")), F.when(F.col("rank") == r, F.col("pos")))
    return every.groupBy(key).agg(*[F.coalesce(last(r), F.lit("")).alias(c) for r, c in columns.items()])


def cache_valid(cache: DataFrame, columns: Sequence[str] = tuple(COLUMNS.values()), probe: str = "phylum") -> DataFrame:
    """One row: n_rows, filled, valid. Valid: all columns there and the probe column filled in more than half the rows."""
    present = set(columns) <= set(cache.columns)
    filled = F.count_if(F.trim(F.coalesce(F.col(probe), F.lit(""))) != "") if present else F.lit(0).cast("bigint")
    out = cache.agg(F.count(F.lit(1)).alias("n_rows"), filled.alias("filled"))
    return out.withColumn("valid", F.lit(present) & (F.col("filled") > 0.5 * F.col("n_rows")))


def enrich(species: DataFrame, ranks: DataFrame, key: str = "taxon_id", default_kingdom: str = "Plantae", columns: Sequence[str] = tuple(COLUMNS.values())) -> DataFrame:
    """`species` with the rank columns of `ranks` (one row a key is kept); blanks where unknown, the kingdom defaulted."""
    one = ranks.select(key, *columns).dropDuplicates([key])
    out = lookup_join(species.drop(*columns), one, [key])
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    fill = {c: F.coalesce(blank(c), F.lit(default_kingdom if c == "kingdom" else "")) for c in columns}
    return out.withColumns(fill)
