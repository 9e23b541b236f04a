"""The N highest-scoring items of every group, by bisecting all groups' cutoffs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytomill.runtime import lookup_join, materialize


def _bisect(coded: DataFrame, state: DataFrame, fanout: int) -> DataFrame:
    """A written table (g, size, lo, hi, need): the brackets left when they hold `need` rows or fewer, or one code only.

    coded: (g, c); state: (g, size, lo, hi, need), the rows of a group from code lo to hi and how many of the highest are wanted.
    """
    kind = dict(coded.dtypes)["c"]
    cut = (lambda x, by: f"({x}) div ({by})") if kind == "bigint" else (lambda x, by: f"floor(({x}) / ({by}))")
    done, open_ = "size <= need or lo = hi", state
    closed = []
    step = Window.partitionBy("g").orderBy(F.desc("slice"))
    while True:
        closed.append(open_.filter(done))
        open_ = open_.filter(f"not ({done})")
        if open_.isEmpty():
            break
        inside = lookup_join(coded, open_.select("g", "lo", "hi", "need"), ["g"], "inner").filter("c between lo and hi")
        # slices of equal width between lo and hi; for fanout 2 this is plain bisection
        sliced = inside.withColumn("wide", F.expr(f"cast({cut('hi - lo', fanout)} + 1 as {kind})")).withColumn("slice", F.expr(cut("c - lo", "wide")))
        counted = sliced.groupBy("g", "need", "slice").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        upto = counted.withColumn("upto", F.sum("size").over(step))  # at most `fanout` rows a group
        hit = upto.filter("upto >= need and upto - size < need")
        open_ = materialize(hit.select("g", "size", "lo", "hi", (F.col("need") - F.col("upto") + F.col("size")).alias("need")), "topn-state")
    out = closed[0]
    for part in closed[1:]:
        out = out.union(part)
    return materialize(out, "topn-cutoffs")


def _brackets(coded: DataFrame, need) -> DataFrame:
    return materialize(coded.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"), need.alias("need")), "topn-state")


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int, fanout: int = 32) -> DataFrame:
    """Columns (group, item, score) of each group's `n` highest scores; equal scores: smaller item first.

    Every row gets a code that orders like (score, -item); each round counts, for all open groups together, the rows in
    `fanout` slices of the group's bracket of codes and keeps the slice in which the n-th row lies, until exactly n rows
    lie above the cutoff. Rounds move counts per (group, slice), never the rows of a group, so a group of any size is fine.

    score and item are whole numbers. Defined cases: rows with a null group, score or item are left out; rows repeating a
    (group, item) count once, with the highest score; groups of n or fewer items are returned whole; an empty table or
    n = 0 gives no rows; other columns are ignored. Where the ranges of score and item multiply to 2^62 or more the code has
    two parts: the cutoff is sought among scores first, then among the items of the cutoff's score.
    """
    rows = (
        df.select(F.col(group).alias("g"), F.col(score).cast("bigint").alias("s"), F.col(item).cast("bigint").alias("i"))
        .dropna()
        .groupBy("g", "i")
        .agg(F.max("s").alias("s"))
    )
    rows = materialize(rows, "topn-rows")
    final = [F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score)]
    low_s, high_s, low_i, high_i = rows.agg(F.min("s"), F.max("s"), F.min("i"), F.max("i")).first()
    if low_s is None or n <= 0:
        return rows.limit(0).select(*final)
    width, need = high_i - low_i + 1, F.lit(n).cast("bigint")
    if (high_s - low_s + 1) * width < 1 << 62:
        coded = rows.withColumn("c", (F.col("s") - F.lit(low_s)) * F.lit(width) + (F.lit(high_i) - F.col("i")))
        cutoffs = _bisect(coded, _brackets(coded, need), fanout)
        return lookup_join(coded, cutoffs.select("g", "lo"), ["g"], "inner").filter("c >= lo").select(*final)
    wide = "decimal(20,0)"  # differences of any two BIGINT
    coded = rows.withColumn("c", F.col("s").cast(wide))
    first = _bisect(coded, _brackets(coded, need), fanout)
    marked = lookup_join(coded, first.select("g", "lo", (F.col("size") > F.col("need")).alias("tied"), "need"), ["g"], "inner").filter("c >= lo")
    ties = materialize(marked.filter("tied and c = lo").select("g", "s", "i", (-F.col("i").cast(wide)).cast(wide).alias("c"), "need"), "topn-ties")
    second = _bisect(ties.select("g", "c"), _brackets(ties, F.first("need")), fanout)
    last = lookup_join(ties.select("g", "s", "i", "c"), second.select("g", "lo"), ["g"], "inner").filter("c >= lo")
    return marked.filter("not tied or c > lo").select(*final).union(last.select(*final))
