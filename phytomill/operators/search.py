"""Exact cosine search of stated queries against a whole index, and how results are shown."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phytomill.functions.arrays import matrix, unit
from phytomill.runtime import materialize

#: Queries that are sent to the executors at once; more are answered block by block.
QUERIES_AT_ONCE = 8192

# fixed values: least percentages of the tiers
HIGH, MEDIUM = 35, 22


def topk(index: DataFrame, queries: DataFrame, k: int, key: str, query: str, column: str = "embedding", exclude_self: bool = False, tie_places: int = 6) -> DataFrame:
    """(query, key, sim, rank): each query's k index rows of highest cosine; equal to `tie_places`: smaller key first.

    queries: (query, column). Queries are taken in blocks of about QUERIES_AT_ONCE, one block at a time on the driver and the
    executors; each index batch is scored by one matrix product, a task keeps only its own best k a query, and only these are shuffled,
    so no pairs are. Null vectors, those of another length than the first query's or with values that are no number are
    left out; zero vectors score 0. k above the index size gives all rows.
    """
    spark = index.sparkSession
    kind = dict(index.dtypes)[key]
    qkind = dict(queries.dtypes)[query]
    source = index.select(key, column).dropna()
    asked = queries.select(query, column).dropna()
    asked = materialize(asked, "queries")
    some = asked.first()
    width, blocks = (len(some[1]), -(-asked.count() // QUERIES_AT_ONCE)) if some else (0, 1)
    order = Window.partitionBy("q").orderBy(F.desc(F.round("s", tie_places)), "i")
    out = None
    for block in range(blocks):
        part = (asked.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == block) if blocks > 1 else asked).toArrow()
        good, rows = matrix(part.column(1), width, np.float64)
        sent = spark.sparkContext.broadcast((np.array(part.column(0).filter(pa.array(good)).to_pylist()), unit(rows)))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, queries_ = sent.value
            held = [np.zeros(0, np.int64), np.zeros(0), None]  # query, similarity and key of the best so far
            if not len(names):
                return
            for b in batches:
                good, rows = matrix(b.column(1), width, np.float64)
                if not len(rows):
                    continue
                keys = np.array(b.column(0).filter(pa.array(good)).to_pylist())
                sims = unit(rows) @ queries_.T
                tied = np.where(np.isfinite(sims), np.round(sims, tie_places), -np.inf)
                if exclude_self:
                    tied[keys[:, None] == names[None, :]] = -np.inf
                edge = np.partition(tied, len(tied) - k, axis=0)[-k] if len(tied) > k else np.full(len(names), -np.inf)
                at, q = np.nonzero((tied >= edge) & np.isfinite(tied))
                q, s, i = np.concatenate([held[0], q]), np.concatenate([held[1], sims[at, q]]), keys[at] if held[2] is None else np.concatenate([held[2], keys[at]])
                best = np.lexsort((i, -np.round(s, tie_places), q))
                q, s, i = q[best], s[best], i[best]
                top = np.arange(len(q)) - np.searchsorted(q, q) < k
                held = [q[top], s[top], i[top]]
            if held[2] is not None:
                hits = [pa.array(names[held[0]]), pa.array(held[2]), pa.array(held[1])]
                yield pa.RecordBatch.from_arrays([h.cast(t) for h, t in zip(hits, (_arrow(qkind), _arrow(kind), pa.float64()))], names=["q", "i", "s"])

        hits = source.mapInArrow(score, f"q {qkind}, i {kind}, s double")
        ranked = hits.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
        if blocks > 1:
            ranked = materialize(ranked, "hits")
            sent.destroy()
        out = ranked if out is None else out.union(ranked)
    return out.select(F.col("q").alias(query), F.col("i").alias(key), F.col("s").alias("sim"), "rank")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def similarity(sim: Column) -> Column:
    return F.round(sim, 5)


def percent(sim: Column) -> Column:
    return F.round(sim * 100, 2)


def tier(pct: Column) -> Column:
    return F.when(pct >= HIGH, "high").when(pct >= MEDIUM, "medium").otherwise("low")


def tier_of_percent(sim: Column) -> Column:
    """The service rule: on the percentage rounded to 2 places."""
    return tier(percent(sim))


def tier_of_rounded(sim: Column) -> Column:
    """The command-line rule: on the similarity rounded to 5 places, times 100."""
    return tier(similarity(sim) * 100)


def advisory(pct: Column) -> Column:
    """Warning code of a query's best percentage; no result counts as 0."""
    p = F.coalesce(pct, F.lit(0.0))
    return F.when(p < MEDIUM, "low_confidence").when(p < HIGH, "medium_confidence").otherwise("none")


def null_meta(c: Column) -> Column:
    """Text metadata with "", "nan" and "None" as null."""
    return F.when(~c.isin("", "nan", "None"), c)


def null_number(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def bar_width(pct: Column) -> Column:
    return F.format_string("%.1f", F.least(F.lit(100.0), pct / 50 * 100))


def tier_label(t: Column) -> Column:
    return F.when(t == "high", "High confidence").when(t == "medium", "Medium confidence").otherwise("Low confidence")


def clamp_k(k: Column) -> Column:
    return F.least(F.greatest(k, F.lit(1)), F.lit(20))


def results(hits: DataFrame) -> DataFrame:
    """Result records: topk's rows with similarity, similarity_pct and confidence."""
    sim = F.col("sim")
    return hits.withColumns({"similarity": similarity(sim), "similarity_pct": percent(sim), "confidence": tier_of_percent(sim)}).drop("sim")
