"""Vector columns: dot products, three normalisations, ensembles, class means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-8  # fixed value: the least norm the guarded variants divide by


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row instead of once an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _normalized(v: Column, how: Callable[[Column, Column], Column]) -> Column:
    return _bound(v, lambda w: _bound(norm(w), lambda n: how(w, n)))


def _scaled(w: Column, by: Column) -> Column:
    return F.transform(w, lambda x: x.cast("double") / by)


def l2_normalize(v: Column) -> Column:
    """v / |v|; null for the zero vector."""
    return _normalized(v, lambda w, n: F.when(n > 0, _scaled(w, n)))


def l2_normalize_clipped(v: Column) -> Column:
    """v / max(|v|, FLOOR)."""
    return _normalized(v, lambda w, n: _scaled(w, F.greatest(n, F.lit(FLOOR))))


def l2_normalize_if_long(v: Column) -> Column:
    """v / |v| where |v| exceeds FLOOR, else v as it is."""
    return _normalized(v, lambda w, n: F.when(n > FLOOR, _scaled(w, n)).otherwise(F.transform(w, lambda x: x.cast("double"))))


def ensemble(*vectors: Column) -> Column:
    """The normalised mean of several vectors of one row; null ones are left out, all null gives null."""
    present = F.filter(F.array(*vectors), lambda v: v.isNotNull())
    total = F.aggregate(
        F.slice(present, 2, len(vectors)),
        F.transform(F.get(present, F.lit(0)), lambda x: x.cast("double")),
        lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")),
    )
    return l2_normalize_clipped(F.transform(total, lambda x: x / F.size(present)))


def class_mean(df: DataFrame, label: str, column: str, dims: int) -> DataFrame:
    """(label, n, mean ARRAY<DOUBLE>): each class's normalised mean vector; null vectors aren't counted.

    One aggregate of `dims` sums with map-side combine, so neither order nor size of a class matters.
    """
    rows = df.filter(F.col(column).isNotNull())
    sums = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(column)[k].cast("double")) for k in range(dims)]).alias("m"))
    return sums.select(label, "n", l2_normalize_if_long(F.col("m")).alias("mean"))


def aligned_means(classes: DataFrame, means: DataFrame, label: str, dims: int) -> DataFrame:
    """Every class with its mean and count; classes without vectors get the zero vector, 0 and covered = false."""
    zero = F.array_repeat(F.lit(0.0), dims)
    out = classes.select(label).distinct().join(means, label, "left")
    return out.select(label, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", zero).alias("mean"), F.col("n").isNotNull().alias("covered"))


def index_stats(df: DataFrame, column: str, label: str) -> DataFrame:
    """One row: rows, dim, classes."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(column)).cast("bigint").alias("dim"), F.countDistinct(label).alias("classes"))
