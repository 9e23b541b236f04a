"""Classification metrics against class prototypes: accuracy at k, macro AUC, per-class statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytomill.functions.arrays import matrix
from phytomill.runtime import lookup_join, materialize

#: Prototypes, and scores of true classes, that travel to the executors at once; rows scored at once.
CLASSES_AT_ONCE, POSITIVES_AT_ONCE, ROWS_AT_ONCE = 16_384, 1_000_000, 1024


def _true_scores(df: DataFrame, prototypes: DataFrame, key: str, label: str, column: str, places: int) -> DataFrame:
    """(key, label, vector, own): each row's rounded dot product with its own class's prototype, null where it has none."""
    means = prototypes.select(F.col(label).alias("_pm_class"), F.col("mean").alias("_pm_mean"))
    rows = lookup_join(df.select(key, label, column).dropna().withColumn("_pm_class", F.col(label)), means, ["_pm_class"])
    kinds = dict(df.dtypes)

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [None if m is None else round(float(np.dot(np.asarray(v, dtype=np.float64), np.asarray(m))), places) for v, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(own, pa.float64())], names=["k", "l", "v", "own"])

    return rows.select(key, label, column, "_pm_mean").mapInArrow(dot, f"k {kinds[key]}, l {kinds[label]}, v {kinds[column]}, own double")


def _blocks(table: DataFrame, by: str, at_once: int) -> Iterator[pa.Table]:
    """`table` in blocks of about at_once rows, one after the other on the driver."""
    blocks = max(1, -(-table.count() // at_once))
    for block in range(blocks):
        part = table.filter(F.pmod(F.xxhash64(by), F.lit(blocks)) == block) if blocks > 1 else table
        yield part.toArrow()


def _scored(b: pa.RecordBatch, at: int, means: np.ndarray, places: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, rounded dot products with the prototypes) of a batch, ROWS_AT_ONCE at a time."""
    good, rows = matrix(b.column(at), means.shape[1], np.float64)
    if not good.all():
        raise ValueError("a vector is not as long as the prototypes or holds no number")
    for a in range(0, len(rows), ROWS_AT_ONCE):
        yield slice(a, a + ROWS_AT_ONCE), np.round(rows[a : a + ROWS_AT_ONCE] @ means.T, places)


def class_ranks(df: DataFrame, prototypes: DataFrame, key: str, label: str, column: str, places: int = 6) -> DataFrame:
    """(key, label, predicted, score, rank): each row's most similar class and the rank of its own class.

    prototypes: (label, mean). Scores are rounded dot products; equal scores: smaller class first; a label without prototype has
    no rank. Prototypes travel in blocks of CLASSES_AT_ONCE, and a row carries its best class and the count of classes before its own
    from block to block, so no row-class pairs are written. Rows with a null key, label or vector are left out.
    """
    kinds = dict(df.dtypes)
    rows = _true_scores(df, prototypes, key, label, column, places)
    rows = rows.withColumns({"predicted": F.lit(None).cast(kinds[label]), "score": F.lit(None).cast("double"), "before": F.lit(0).cast("bigint")})
    schema = f"k {kinds[key]}, l {kinds[label]}, v {kinds[column]}, own double, predicted {kinds[label]}, score double, before bigint"
    spark, first = df.sparkSession, True
    for table in _blocks(prototypes.select(F.col(label).alias("c"), F.col("mean").cast("array<double>").alias("m")).dropna(), "c", CLASSES_AT_ONCE):
        table = table.sort_by("c")
        if not table.num_rows:
            continue
        sent = spark.sparkContext.broadcast((table.column("c").combine_chunks(), np.array(table.column("m").to_pylist())))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, means = sent.value
            order = {c: k for k, c in enumerate(names.to_pylist())}
            values = names.to_pylist()
            for b in batches:
                if not b.num_rows:
                    continue
                own, held = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
                at, top = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows)
                before = b.column(6).to_numpy().copy()
                labels = b.column(1).to_pylist()
                place = np.array([order[x] if x in order else sum(v < x for v in values) for x in labels])  # classes smaller than the row's
                for span, s in _scored(b, 2, means, places):
                    at[span], top[span] = s.argmax(axis=1), s.max(axis=1)
                    mine = own[span][:, None]
                    ahead = (s > mine) | ((s == mine) & (np.arange(s.shape[1])[None, :] < place[span][:, None]))
                    before[span] += np.where(np.isnan(own[span]), 0, ahead.sum(axis=1))
                best = b.column(4).to_pylist()
                chosen = [values[i] if h != h or t > h or (t == h and values[i] < p) else p for i, t, h, p in zip(at.tolist(), top.tolist(), held.tolist(), best)]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(chosen, names.type), pa.array(np.fmax(held, top)), pa.array(before)], names=["k", "l", "v", "own", "predicted", "score", "before"])

        rows = (rows if first else materialize(rows, "class-ranks")).mapInArrow(score, schema)
        first = False
    rank = F.when(F.col("own").isNotNull(), F.col("before") + 1)
    return rows.select(F.col("k").alias(key), F.col("l").alias(label), "predicted", "score", rank.alias("rank"))


def accuracy_at_k(ranks: DataFrame) -> DataFrame:
    """One row: n, acc1, acc3, acc5 of class_ranks' rows that have a rank."""
    share = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 6)
    return ranks.filter("rank is not null").agg(F.count(F.lit(1)).alias("n"), share(1).alias("acc1"), share(3).alias("acc3"), share(5).alias("acc5"))


def class_areas(df: DataFrame, prototypes: DataFrame, key: str, label: str, column: str, places: int = 6) -> DataFrame:
    """(label, auc): each class's one-against-rest area, ties counting half; classes without positives or negatives have none.

    The area is the share of (positive, negative) pairs in the right order. Positives' own scores, counted by value, travel
    in blocks of POSITIVES_AT_ONCE; against them each batch adds up, by class, how many lie above its negatives; only these sums,
    one a class and task, are shuffled.
    """
    kind = dict(df.dtypes)[label]
    spark = df.sparkSession
    rows = materialize(_true_scores(df, prototypes, key, label, column, places).filter("own is not null").select("l", "v", "own"), "true-scores")
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("p"))
    total = rows.count()
    positives = materialize(rows.groupBy("l", "own").agg(F.count(F.lit(1)).alias("w")).join(prototypes.select(F.col(label).alias("l"), F.col("mean").cast("array<double>").alias("m")), "l"), "positives")
    # a class with more distinct scores than one block holds is spread over several
    pieces = positives.withColumn("piece", F.pmod(F.xxhash64("own"), F.lit(max(1, -(-total // POSITIVES_AT_ONCE)))))
    means = materialize(pieces.groupBy("l", "piece").agg(F.first("m").alias("m"), F.collect_list(F.struct("own", "w")).alias("s")), "positive-pieces")
    per = max(1, POSITIVES_AT_ONCE * max(1, means.count()) // max(1, total))
    sums = None
    for table in _blocks(means, "l", min(per, CLASSES_AT_ONCE)):
        if not table.num_rows:
            continue
        known = []
        for s in table.column("s").to_pylist():
            own = sorted((x["own"], x["w"]) for x in s)
            known.append((np.array([x for x, _ in own]), np.concatenate([[0], np.cumsum([w for _, w in own])])))
        sent = spark.sparkContext.broadcast((table.column("l").combine_chunks(), np.array(table.column("m").to_pylist()), known))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, means, known = sent.value
            values = names.to_pylist()
            right = np.zeros(len(values))
            for b in batches:
                if not b.num_rows:
                    continue
                labels = np.array(b.column(0).to_pylist(), dtype=object)
                for span, s in _scored(b, 1, means, places):
                    for c, (at, upto) in enumerate(known):
                        x = s[labels[span] != values[c], c]
                        above, not_below = upto[-1] - upto[np.searchsorted(at, x, "right")], upto[-1] - upto[np.searchsorted(at, x, "left")]
                        right[c] += (above + not_below).sum() / 2
            yield pa.RecordBatch.from_arrays([names, pa.array(right)], names=["l", "right"])

        part = materialize(rows.select("l", "v").mapInArrow(count, f"l {kind}, right double").groupBy("l").agg(F.sum("right").alias("right")), "areas")
        sent.destroy()
        sums = part if sums is None else sums.union(part)
    if sums is None:
        return spark.createDataFrame([], f"{label} {kind}, auc double")
    areas = sums.groupBy("l").agg(F.sum("right").alias("right")).join(sizes, "l")
    return areas.filter(F.col("p") < total).select(F.col("l").alias(label), (F.col("right") / (F.col("p") * (F.lit(total) - F.col("p")))).alias("auc"))


def macro_auc(areas: DataFrame) -> DataFrame:
    """One row: macro_auc, the mean of class_areas' areas."""
    return areas.agg(F.round(F.avg("auc"), 6).alias("macro_auc"))


def per_class_accuracy(ranks: DataFrame, label: str) -> DataFrame:
    """One row: n_rows, classes and the mean, median, least and greatest of the classes' top-1 accuracies."""
    own = ranks.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("a"))
    r = lambda c: F.round(c, 6)
    return own.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("classes"), r(F.avg("a")).alias("mean_acc"), r(F.median("a")).alias("median_acc"), r(F.min("a")).alias("min_acc"), r(F.max("a")).alias("max_acc"))
