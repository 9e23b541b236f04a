"""Fill missing values from records of the same group, backing off from finer to coarser groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytomill.runtime import lookup_join


@dataclass(frozen=True)
class Target:
    """One column to fill.

    levels: groups from finest to coarsest, each a list of key columns. kind: "mode" or "median".
    min_support: present values a group needs before its statistic counts.
    """

    column: str
    levels: Sequence[Sequence[str]]
    kind: str = "mode"
    min_support: int = 1


def _mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    # counts per value first: a hot group shrinks to its distinct values before anything is gathered by group
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.sum("_n").alias("_support"),
        F.max_by(column, F.struct("_n", column)).alias("_last"),
        F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("_value"),
    ).withColumn("_value", F.when(F.col("_value") == F.col("_last"), F.col("_value"))).drop("_last")


def _median(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    # the lower median is the first value up to which half of the rows lie; only counts per value are ordered
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumns({"_upto": upto, "_support": F.sum("_n").over(group)})
    return counts.filter(F.col("_upto") * 2 >= F.col("_support")).groupBy(*keys).agg(F.max("_support").alias("_support"), F.min(column).alias("_value"))


def group_fill(df: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """Fill each target's nulls with the mode or median of its finest group that has enough support.

    Adds `<column>_filled` (BOOLEAN) and `<column>_level` (INT: 0 the finest level, null where nothing was filled).
    Defined cases: a null in a level's keys excludes the row from that level; a group whose top values tie has no mode
    and the next level is tried; a median is the lower one, exact at every size;
    rows repeat as often as they came; input columns with an added column's name are replaced; an empty table gives an empty table. Statistics come from the values given, never
    from filled ones. Blank strings are values here: turn them to null first.
    """
    extra = [f"{t.column}{s}" for t in targets for s in ("_filled", "_level")]
    out = df.drop(*extra)
    for t in targets:
        value, level = F.col(t.column), F.lit(None).cast("int")
        for i, keys in enumerate(t.levels):
            keys, tag = list(keys), f"_pm_{t.column}_{i}"
            known = df.select(*keys, t.column).dropna()
            stats = (_mode if t.kind == "mode" else _median)(known, keys, t.column)
            stats = stats.filter((F.col("_support") >= t.min_support) & F.col("_value").isNotNull())
            stats = stats.select(*keys, F.col("_value").alias(tag))
            out = lookup_join(out, stats, keys)
            level = F.coalesce(level, F.when(F.col(tag).isNotNull(), F.lit(i)))
            value = F.coalesce(value, F.col(tag))
        missing = F.col(t.column).isNull()
        out = out.withColumns(
            {
                f"_pm_{t.column}_new": value,
                f"{t.column}_filled": missing & value.isNotNull(),
                f"{t.column}_level": F.when(missing, level),
            }
        )
    swap = {t.column: F.col(f"_pm_{t.column}_new") for t in targets}
    return out.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in df.columns if c not in extra], *extra)
