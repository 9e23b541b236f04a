"""Planning what to fetch: exact samples, first N a key, gaps, and totals of outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phytomill.runtime import lookup_join, materialize


def priority(key: Column, seed: str) -> Column:
    """60 bits of md5(seed:key): the same in every run, partitioning and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def lowest(df: DataFrame, column: str, count: int, bits: int = 60, step: int = 12) -> DataFrame:
    """The `count` rows lowest in a non-negative BIGINT column of at most `bits` bits; more where values tie at the end.

    Counts per slice of 2^step narrow the cutoff, so no ordering of all rows and no big limit is needed.
    """
    if count <= 0:
        return df.limit(0)
    base, need, left = 0, count, bits
    while left > 0:
        take = min(step, left)
        left -= take
        inside = df.filter((F.col(column) >= base) & (F.col(column) < base + (1 << (left + take))))
        counts = inside.groupBy(F.shiftright(F.col(column) - F.lit(base), left).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
        for row in sorted(counts.collect()):  # at most 2^step rows
            if row["n"] >= need:
                base, held = base + (row["slice"] << left), row["n"]
                break
            need -= row["n"]
        else:
            return df  # fewer rows than asked for
        if held == need:
            break
    return df.filter(F.col(column) < base + (1 << left))


def sample_exact(df: DataFrame, key: str, share: float, seed: str = "42") -> DataFrame:
    """int(n x share) of the rows, those of lowest hash of their (unique, non-null) key."""
    rows = df.filter(F.col(key).isNotNull()).withColumn("_pm_priority", priority(F.col(key), seed))
    return lowest(rows, "_pm_priority", int(rows.count() * share)).drop("_pm_priority")


def first_n(df: DataFrame, key: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key, with their `position`; only n rows a key and task are shuffled."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("position", position).filter(F.col("position") <= n).withColumn("position", F.col("position").cast("bigint"))


def existing_counts(catalog: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, existing): how many files each catalog key has, 0 for none."""
    counts = files.groupBy(key).agg(F.count(F.lit(1)).alias("existing"))
    return catalog.select(key).join(counts, key, "left").select(key, F.coalesce("existing", F.lit(0)).alias("existing"))


def gaps(counts: DataFrame, target: int) -> DataFrame:
    """Keys short of `target`, with `need`."""
    return counts.filter(F.col("existing") < target).withColumn("need", F.greatest(F.lit(target) - F.col("existing"), F.lit(0)))


def without_existing(photos: DataFrame, existing: DataFrame, name: str) -> DataFrame:
    """Photos whose file name isn't there yet."""
    return photos.join(existing.select(name).distinct(), name, "left_anti")


def plan_fetch(photos: DataFrame, existing: DataFrame, key: str, name: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """What to fetch: existing files are taken out first, then the first n a key (so a key isn't under-filled)."""
    return first_n(without_existing(photos, existing, name), key, order, n)


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """One row: classes, downloaded, skipped, failures (neither downloaded nor skipped)."""
    failed = (F.col("downloaded") == 0) & (F.col("skipped") == 0)
    return outcomes.agg(F.count(F.lit(1)).alias("classes"), F.sum("downloaded").cast("bigint").alias("downloaded"), F.sum("skipped").cast("bigint").alias("skipped"), F.count_if(failed).alias("failures"))


def failure_head(outcomes: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first n failures by key, with `beyond`: how many more there are."""
    failed = outcomes.filter("downloaded = 0 and skipped = 0")
    return failed.orderBy(key).limit(n).withColumn("beyond", F.lit(max(0, failed.count() - n)).cast("bigint"))


def page_plan(total: int, per_page: int, spark) -> DataFrame:
    """(page, size) of ceil(total / per_page) pages."""
    pages = -(-total // per_page)
    size = F.least(F.lit(per_page), F.lit(total) - (F.col("id") - 1) * per_page)
    return spark.range(1, pages + 1).select(F.col("id").alias("page"), size.cast("bigint").alias("size"))


def with_ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """`df` with each row's place, from 1, in the order of the given columns; rows are numbered range by range in parallel."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    numbered = materialize(ranged.withColumn("_pm_part", F.shiftright(at, 33)).withColumn("_pm_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "ordinal")
    sizes = numbered.groupBy("_pm_part").agg(F.count(F.lit(1)).alias("_pm_n"))
    before = Window.orderBy("_pm_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_pm_part", F.coalesce(F.sum("_pm_n").over(before), F.lit(0)).alias("_pm_start"))
    out = lookup_join(numbered, starts, ["_pm_part"], "inner")
    return out.withColumn(name, F.col("_pm_start") + F.col("_pm_at") + 1).drop("_pm_part", "_pm_at", "_pm_start")


def id_batches(df: DataFrame, key: str, size: int = 30) -> DataFrame:
    """(batch, ids): keys in order, `size` to a batch, comma-joined."""
    rows = with_ordinal(df.select(key).dropna().distinct(), [key])
    batch = F.floor((F.col("ordinal") - 1) / size).cast("bigint")
    lists = rows.groupBy(batch.alias("batch")).agg(F.sort_array(F.collect_list(key)).alias("k"))  # `size` keys
    return lists.select("batch", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("ids"))
