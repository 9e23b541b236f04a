"""Clusters of mutually similar vectors by density peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytomill.llm import vectors as V
from phytomill.llm.knn import RANGE_ROWS, mix, window_hits
from phytomill.llm.topn import top_n_per_group
from phytomill.runtime import lookup_join, materialize, release

#: Rows of vectors up to which a side of a join is broadcast; rounds after which means count as settled.
CENTRE_ROWS, ROUNDS = 20_000, 20


def neighbours(points: DataFrame, n: int, k: int, near: float, dims: int, curves: int, window: int, seed: int) -> DataFrame:
    """A written table (qid, iid, s, pos): each point's k nearest of cosine `near` or more, by windows of Hilbert orderings.

    pos counts from 0 by falling s, equal: rising iid.
    """
    return materialize(window_hits(points, None, n, n, k, dims, curves, max(window, round(n ** (2 / 3)) // 4), True, 6, True, seed, near), "neighbours")


def density(lists: DataFrame, points: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """(id, rho): a point's own weight plus the summed weight x cosine of its listed neighbours, in millionths.

    heavy: (id, w) of the points that don't weigh 1; null: all weigh 1.
    """
    rated = lists.select("qid", "iid", F.round(F.col("s") * 1_000_000).cast("bigint").alias("r"))
    if heavy is not None:
        rated = lookup_join(rated, heavy.select(F.col("id").alias("iid"), "w"), ["iid"])
        rated = rated.withColumn("r", F.col("r") * F.coalesce("w", F.lit(1)))
    own = points.select("id", (F.col("w") * 1_000_000).alias("r"))
    return own.union(rated.select("qid", "r")).groupBy("id").agg(F.sum("r").alias("rho"))


def denser_pointers(lists: DataFrame, rho: DataFrame, most: int | None = None) -> DataFrame:
    """(id, parent): each point with the most similar denser one on its list; equal densities: the smaller id is denser."""
    pairs = lookup_join(lists, rho.select(F.col("id").alias("qid"), F.col("rho").alias("q")), ["qid"], "inner", most=most)
    pairs = lookup_join(pairs, rho.select(F.col("id").alias("iid"), F.col("rho").alias("i")), ["iid"], "inner", most=most)
    denser = pairs.filter("i > q or (i = q and iid < qid)")
    return denser.groupBy(F.col("qid").alias("id")).agg(F.min_by("iid", "pos").alias("parent"))  # a number, not a struct: no sort


def follow(parents: DataFrame, most: int | None = None) -> DataFrame:
    """(id, peak) from (id, parent), where a peak is its own parent: pointers are followed four times as far until none changes."""
    at = last = materialize(parents.select("id", F.col("parent").alias("peak")), "pointers")
    while True:
        hop = materialize(lookup_join(at, at.select(F.col("id").alias("peak"), F.col("peak").alias("next")), ["peak"], "inner", most=most).select("id", "next"), "pointers")
        moved = lookup_join(hop, hop.select(F.col("id").alias("next"), F.col("next").alias("peak")), ["next"], "inner", most=most)
        moved = materialize(moved.select("id", "peak", (F.col("next") != F.col("peak")).alias("moved")), "pointers")
        release(last, hop)
        at, last = moved.select("id", "peak"), moved
        if moved.filter("moved").isEmpty():
            return at


def peaks(points: DataFrame, rho: DataFrame, lists: DataFrame, k: int, near: float, dims: int, curves: int, window: int, seed: int, n: int | None = None) -> DataFrame:
    """(id, peak) of every point: follow pointers to the most similar denser point, up to a peak.

    Points with no denser one on their list are looked up again among themselves, which brings their nearest denser one
    within reach if there is one of cosine `near` or more, until none finds any: those left are the peaks. n: the points' number.
    """
    found = materialize(denser_pointers(lists, rho, n), "denser")
    edges, open_ = found, materialize(rho.join(found, "id", "left_anti"), "open")
    left, vectors = open_.count(), points.select("id", "vec")
    while left > 1:
        wider, vectors = vectors, materialize(lookup_join(vectors, open_.select("id"), ["id"], "inner", most=left), "open-vectors")
        release(wider)
        seed += 100
        again = neighbours(vectors, left, k, near, dims, curves, window, seed)
        found = materialize(denser_pointers(again, open_, left), "denser")
        release(again)
        fewer = left - found.count()
        if fewer == left:
            break
        edges = edges.union(found)
        open_ = materialize(lookup_join(open_, found.select("id"), ["id"], "left_anti", most=left), "open")
        left = fewer
    release(vectors)
    return follow(edges.union(open_.select("id", F.col("id").alias("parent"))), n)


def _cosines(rows: DataFrame, dims: int) -> DataFrame:
    """(id, w, centre, cos) from (id, vec, w, centre, cvec): cos is null where cvec is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.settle()
        for b in batches:
            there = np.nonzero(b.column(4).is_valid().to_numpy(zero_copy_only=False))[0]
            cos = np.full(b.num_rows, np.nan)
            if len(there):
                at = pa.array(there)
                cos[there] = (V.unit(V.unpacked(b.column(1).take(at), dims)) * V.unpacked(b.column(4).take(at), dims, np.float64)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(cos, from_pandas=True)], names=["id", "w", "centre", "cos"])

    return rows.select("id", "vec", "w", "centre", "cvec").mapInArrow(run, "id bigint, w bigint, centre bigint, cos double")


def means(members: DataFrame, dims: int, n: int = 1) -> DataFrame:
    """A written table (centre, cvec BINARY of float64, w): mean directions of (vec, w, centre), n rows at most; summed a batch before the shuffle."""
    record = np.dtype([("centre", "<i8"), ("w", "<i8"), ("s", "<i8", (dims,))])
    buckets = max(1, -(-n // RANGE_ROWS))

    def added(which: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        """One record a centre: whole numbers add up the same in any order."""
        order = np.argsort(which, kind="stable")
        names, first = np.unique(which[order], return_index=True)
        total = np.zeros(len(names), dtype=record)
        if len(names):
            total["centre"], total["w"], total["s"] = names, np.add.reduceat(w[order], first), np.add.reduceat(s[order], first)
        return total

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.settle()
        for b in batches:
            w = b.column(2).to_numpy()
            total = added(b.column(1).to_numpy(), w, np.rint(V.unit(V.unpacked(b.column(0), dims)) * (w * 1e9)[:, None]).astype(np.int64))
            bucket = (mix(total["centre"]) * buckets).astype(np.int64)
            which = np.unique(bucket)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array([total[bucket == x].tobytes() for x in which], pa.binary())], names=["b", "block"])

    def direction(table: pa.Table) -> pa.Table:
        V.settle()
        every = np.frombuffer(b"".join(table.column("block").to_pylist()), dtype=record)
        total = added(every["centre"], every["w"], every["s"])
        rows = total["s"].astype(np.float64)
        rows[~rows.any(axis=1)] = 1.0  # opposite vectors that cancel out
        return pa.table({"centre": np.ascontiguousarray(total["centre"]), "cvec": V.packed(V.unit(rows)), "w": np.ascontiguousarray(total["w"])})

    sums = members.select("vec", "centre", "w").mapInArrow(partial, "b bigint, block binary")
    return materialize(sums.groupBy("b").applyInArrow(direction, "centre bigint, cvec binary, w bigint"), "means")


def _renewed(centres: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """The means with those of the touched centres replaced by fresh ones; a touched centre without one is gone."""
    out = materialize(lookup_join(centres, touched, ["centre"], "left_anti").union(fresh), "means")
    release(centres, touched, fresh)
    return out


def _single(centres: DataFrame, dims: int) -> DataFrame:
    """Centres as points (id, vec BINARY of float32, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        V.settle()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), V.packed(V.unpacked(b.column(1), dims, np.float64).astype(np.float32)), b.column(2)], names=["id", "vec", "w"])

    return materialize(centres.select("centre", "cvec", "w").mapInArrow(run, "id bigint, vec binary, w bigint"), "centres")


def cluster(
    df: DataFrame, id_: str, column: str = "embedding", dims: int = 64, cosine: float = 0.7, least: int = 10,
    near: float = 0.5, together: float = 0.8, k: int = 8, curves: int = 2, window: int = 1024, seed: int = 31,
) -> DataFrame:
    """(id, cluster_id, similarity): members of clusters of at least `least` vectors within `cosine` of their mean direction.

    Density peaks: a neighbour join along `curves` Hilbert orderings lists each vector's k nearest of cosine `near` (about
    cosine^2) or more; these give its density and its pointer to the nearest denser vector; vectors without one are joined again
    among themselves, at `cosine` or more, until only peaks are left, no two of which are so similar; pointers are followed to the peaks, which are the labels. Peaks of one mean
    direction (`together` or more) are linked the same way, the heavier being denser. A check of the bound ends it, repeated until
    nothing changes: members below `cosine` to their label's mean leave it, and vectors in no cluster of `least` join the nearest
    mean if they reach `cosine`. cluster_id is the cluster's smallest id.

    Unusable vectors (null, not `dims` long, not finite, all zero) and null ids are in no cluster; repeated vectors each
    count, but travel as one weighted row. No usable vector: no rows. Ids must be unique.
    """
    spark = df.sparkSession
    every = V.usable_vectors(df, id_, column, dims)
    copies = materialize(every.groupBy("h").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("rep")).filter("w > 1"), "copies")
    vectors, heavy = every.select("id", "vec", F.lit(1).cast("bigint").alias("w")), None
    if not copies.isEmpty():
        rows = lookup_join(every, copies, ["h"]).filter("rep is null or rep = id")
        vectors = materialize(rows.select("id", "vec", F.coalesce("w", F.lit(1)).alias("w")), "weighted")
        heavy = copies.select(F.col("rep").alias("id"), "w")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], f"{id_} bigint, cluster_id bigint, similarity double")
    lists = neighbours(vectors, n, k, near, dims, curves, window, seed)
    rho = materialize(density(lists, vectors, heavy), "density")
    label = peaks(vectors, rho, lists, k, max(near, cosine), dims, curves, window, seed, n)
    release(lists, rho)
    label = label.withColumnRenamed("peak", "centre")
    centres = means(lookup_join(vectors, label, ["id"], "inner", most=n), dims, n)
    points = _single(centres.filter("w > 1"), dims)
    count = points.count()
    if count > 1:
        lists = neighbours(points, count, k, together, dims, curves, window, seed + 50)
        joined = peaks(points, points.select("id", F.col("w").alias("rho")), lists, k, together, dims, curves, window, seed + 60, count)
        joined = joined.filter("id <> peak").select(F.col("id").alias("was"), F.col("peak").alias("centre"))
        joined = materialize(joined, "joined")
        label = lookup_join(label.withColumnRenamed("centre", "was"), joined, ["was"], most=count)
        label = materialize(label.select("id", F.coalesce("centre", "was").alias("centre")), "labels")
        touched = materialize(joined.select("centre").union(joined.select("was")).distinct(), "touched")
        moving = lookup_join(vectors, lookup_join(label, touched, ["centre"], "inner", most=count), ["id"], "inner", most=n)
        release(lists)
        centres = _renewed(centres, touched, means(moving, dims, n))
    known = lookup_join(lookup_join(vectors, label, ["id"], most=n), centres.filter("w > 1").select("centre", "cvec"), ["centre"], max_rows=CENTRE_ROWS, most=count)
    own, before = materialize(_cosines(known, dims), "own"), None
    for left in range(ROUNDS, -1, -1):
        release(points)
        members = own.filter(F.col("cos") >= cosine)
        signs = members.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", "centre")), F.coalesce(F.sum("w"), F.lit(0))).first()
        if signs == before or not left:
            break
        before = signs
        held = materialize(members.groupBy("centre").agg(F.sum("w").alias("size")).filter(F.col("size") * 2 >= least), "held")
        points = _single(lookup_join(centres.drop("w"), held.withColumnRenamed("size", "w"), ["centre"], "inner", most=2 * signs[2] // max(1, least)), dims)
        count = points.count()
        if not count:
            return spark.createDataFrame([], f"{id_} bigint, cluster_id bigint, similarity double")
        # whoever is in no cluster large enough joins the most similar mean, sooner that of one large enough
        own_ = lookup_join(own, held, ["centre"], most=count).withColumn("held", F.coalesce((F.col("cos") >= cosine) & (F.col("size") >= least), F.lit(False)))
        loose = materialize(own_.filter("not held").select("id"), "loose")
        outside = loose.count()
        free = materialize(lookup_join(vectors.select("id", "vec"), loose, ["id"], "inner", most=outside), "free")
        hits = window_hits(points, free, count, outside, 3, dims, curves + 2, max(4 * window, round(count ** (2 / 3))), False, 6, False, seed + 70, cosine - 1e-5)
        hits = lookup_join(hits, held.withColumnRenamed("centre", "iid"), ["iid"], "inner", most=count)
        hits = materialize(hits.groupBy(F.col("qid").alias("id")).agg(F.max_by("iid", F.struct(F.col("size") >= least, "s", -F.col("iid"))).alias("joins")), "nearest-mean")
        now = F.when(F.col("held"), F.col("centre")).otherwise(F.col("joins"))
        labels = materialize(lookup_join(own_, hits, ["id"], most=outside).select("id", "w", now.alias("centre"), F.col("centre").alias("was"), "cos"), "labels")
        # only labels that someone left or joined get a new mean, and only their vectors a new cosine
        changed = labels.filter(~F.col("centre").eqNullSafe(F.col("was")))
        touched = materialize(changed.select("centre").union(changed.select("was")).dropna().distinct(), "touched")
        many = touched.count()
        if not many:
            break
        ids = lookup_join(labels.select("id", "centre"), touched, ["centre"], "inner", most=many)
        moving = materialize(lookup_join(vectors, ids, ["id"], "inner", most=n), "moving")
        fresh = means(moving, dims, n)
        again = _cosines(lookup_join(moving, fresh.filter("w > 1").select("centre", "cvec"), ["centre"], max_rows=CENTRE_ROWS, most=many), dims)
        same = lookup_join(labels, touched, ["centre"], "left_anti", most=many).select("id", "w", "centre", F.when(F.col("centre").isNotNull(), F.col("cos")).alias("cos"))
        last, own = own, materialize(same.union(again), "own")
        release(last, held, loose, free, hits, labels, moving)
        centres = _renewed(centres, touched, fresh)
    sizes = materialize(members.groupBy("centre").agg(F.sum("w").alias("size"), F.min("id").alias("cluster_id")).filter(F.col("size") >= least).select("centre", "cluster_id"), "sizes")
    out = lookup_join(members.select("id", "centre", "cos"), sizes, ["centre"], "inner").select("id", "cluster_id", "cos")
    if heavy is not None:  # copies follow the row that stands for them
        others = lookup_join(every.select("h", F.col("id").alias("copy")), copies, ["h"], "inner").filter("copy <> rep")
        out = out.union(lookup_join(others.select("copy", "rep"), out.withColumnRenamed("id", "rep"), ["rep"], "inner").select("copy", "cluster_id", "cos"))
    return out.select(F.col("id").alias(id_), "cluster_id", F.round("cos", 6).alias("similarity"))


def describe(members: DataFrame, rows: DataFrame, id_: str, label: str, typical: int = 5) -> DataFrame:
    """(cluster_id, size, labels, commonest_label, label_share, typical): one row a cluster.

    members: of cluster(); rows: the clustered table with the label column (null labels count to the size only). typical: ids of
    the members most similar to the mean direction, most similar first.
    """
    scored = members.withColumn("score", F.round(F.col("similarity") * 1_000_000).cast("bigint"))
    top = top_n_per_group(scored, "cluster_id", "score", id_, typical)
    top = top.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_).alias("i")))).alias("t"))
    top = top.select("cluster_id", F.col("t.i").alias("typical"))
    counts = members.join(rows.select(id_, F.col(label).alias("label")), id_, "left").groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("label").isNotNull()
    sizes = counts.groupBy("cluster_id").agg(
        F.sum("n").alias("size"),
        F.count("label").alias("labels"),
        F.min_by(F.when(named, F.col("label")), F.when(named, F.struct(-F.col("n"), F.col("label")))).alias("commonest_label"),
        F.max(F.when(named, F.col("n"))).alias("most"),
    )
    sizes = sizes.withColumn("label_share", F.coalesce(F.col("most") / F.col("size"), F.lit(0.0))).drop("most")
    return sizes.join(top, "cluster_id")
