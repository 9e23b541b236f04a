"""The k most similar vectors of every vector, by windows of several Hilbert orderings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytomill.llm import vectors as V

#: Index rows of one range of a curve, and queries one task takes of it; queries, index rows and candidate pairs multiplied at once.
RANGE_ROWS, RANGE_QUERIES, TILE, STEP, PAIRS = 32_768, 16_384, 512, 1024, 65_536
_INDEX, _QUERY = 1, 2


class Best:
    """The k best index vectors of some queries so far: highest rounded cosine, equal: smaller id.

    Single precision only rules out: what could still reach a query's k-th value, by rounding or by the error of single
    precision, is computed in double precision and rounded before it is compared.
    """

    def __init__(self, ids: np.ndarray, exact: np.ndarray, k: int, same: bool, places: int):
        self.ids, self.exact, self.rough, self.k, self.same, self.places = ids, exact, exact.astype(np.float32), k, same, places
        self.score, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
        self.slack = 10.0**-places + exact.shape[1] * 2.5e-7

    def compare(self, names: np.ndarray, own: np.ndarray, light: np.ndarray) -> None:
        """Take in index vectors: ids, unit vectors, and those in single precision."""
        k, kth = self.k, self.k + self.same  # a query itself may be among the best
        s = self.rough @ light.T
        edge = self.score[:, -1]
        if np.isinf(edge).any() and s.shape[1] > kth:
            edge = np.maximum(edge, np.partition(s, s.shape[1] - kth, axis=1)[:, -kth])
        edge = (edge - self.slack).astype(np.float32)
        open_ = np.nonzero(s.max(axis=1) >= edge)[0]
        flat = np.flatnonzero(s[open_] >= edge[open_, None])
        if not len(flat):
            return
        q, i = open_[flat // s.shape[1]], flat % s.shape[1]
        if self.same:
            other = self.ids[q] != names[i]
            q, i = q[other], i[other]
        cos = [(self.exact[q[j : j + PAIRS]] * own[i[j : j + PAIRS]]).sum(axis=1) for j in range(0, len(q), PAIRS)]
        cos = np.round(np.concatenate(cos), self.places) if cos else np.array([])
        which = np.unique(q)
        q = np.concatenate([np.repeat(which, k), q])
        cos, i = np.concatenate([self.score[which].ravel(), cos]), np.concatenate([self.found[which].ravel(), names[i]])
        order = np.lexsort((i, -cos, q))
        q, cos, i = q[order], cos[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < k
        self.score[q[best], rank[best]], self.found[q[best], rank[best]] = cos[best], i[best]


def mix(ids: np.ndarray) -> np.ndarray:
    """A hash of each id, in [0, 1)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def window_hits(
    index: DataFrame, queries: DataFrame | None, n: int, m: int, k: int, dims: int, curves: int, window: int, same: bool, places: int, half: bool, seed: int, near: float | None = None,
) -> DataFrame:
    """(qid, iid, s): for each curve and range it touches, a query's k best index vectors within its window; repeats occur.

    near: instead (qid, iid, s, pos), the k best of each query over all curves that are as similar as that, without repeats, and their
    places among them from 0; hits meet in blocks, which spares the JVM a row for each.

    index, queries: (id, vec); n, m: their rows. queries None: every index row is a query. Every row of a curve has a place, estimated
    on the sample, and belongs to a range of about RANGE_ROWS places. Queries travel to all ranges their window touches (or, where
    every row is a query, rows travel to the ranges that may see them). Ranges that many queries touch are
    taken by several tasks, each with some of the queries and all index rows of the range. half: vectors travel in half precision.
    """
    spark = index.sparkSession
    if n <= window:
        curves = 1  # the window holds everything
    sample = V.fit_sample(index, n, dims)
    plan = spark.sparkContext.broadcast([V.Curve(sample, seed + c) for c in range(curves)])
    parts = max(1, min(-(-n // RANGE_ROWS), V.FIT_ROWS // 8))  # a range is known by eight sample rows or more
    record = np.dtype([("key", "<i8"), ("id", "<i8"), ("role", "u1"), ("vec", "<f2" if half else "<f4", (dims,))])

    def places_of(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(curve, rows, keys, home, first and last range of the window) of a batch (id, vec)."""
        rows = V.unit(V.unpacked(b.column(1), dims))
        u = mix(b.column(0).to_numpy(zero_copy_only=False))
        for c, curve in enumerate(plan.value):
            key, before, upto = curve.place(rows)
            at = (before + u * (upto - before)) * n  # rows of one key are spread over its places
            home, first, last = (np.clip(x * parts // n, 0, parts - 1).astype(np.int64) for x in (at, at - window, at + window))
            yield c, rows, key, home, first, last

    def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, range) for every range from first to last."""
        count = last - first + 1
        row = np.repeat(np.arange(len(first)), count)
        return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)

    tasks = np.ones(curves * parts, dtype=np.int64)
    if queries is not None and m > RANGE_QUERIES:

        def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros(curves * parts, dtype=np.int64)
            for b in batches:
                if b.num_rows:
                    for c, _, _, _, first, last in places_of(b):
                        count += np.bincount(c * parts + spread(first, last)[1], minlength=len(count))
            at = np.nonzero(count)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["g", "n"])

        for r in queries.select("id", "vec").mapInArrow(touched, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():  # at most curves x parts rows
            tasks[r["g"]] = -(-r["n"] // RANGE_QUERIES)
    start = np.concatenate([[0], np.cumsum(tasks)])

    def scatter(role: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            V.settle()
            for b in batches:
                if not b.num_rows:
                    continue
                block = np.zeros(b.num_rows, dtype=record)
                block["id"] = b.column(0).to_numpy(zero_copy_only=False)
                u = mix(block["id"])
                groups, blocks = [], []
                for c, rows, key, home, first, last in places_of(b):
                    block["key"], block["vec"] = key, rows
                    if role == _INDEX:
                        row, part = np.arange(len(home)), home
                    else:
                        row, part = spread(first, last)
                    g = c * parts + part
                    if role == _INDEX:  # to every task of the range
                        row, g = spread(start[g], start[g + 1] - 1)
                    else:
                        g = start[g] + (u[row] * tasks[g]).astype(np.int64)
                    sent = block[row]
                    sent["role"] = np.where(part == home[row], role, _INDEX) if role == _INDEX | _QUERY else role
                    order = np.argsort(g, kind="stable")
                    g, sent = g[order], sent[order]
                    edges = np.concatenate([[0], np.nonzero(np.diff(g))[0] + 1, [len(g)]])
                    groups += g[edges[:-1]].tolist()
                    blocks += [sent[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(blocks, pa.binary())], names=["g", "block"])

        return run

    def search(table: pa.Table) -> pa.Table:
        V.settle()
        every = np.frombuffer(b"".join(table.column("block").to_pylist()), dtype=record)
        every = every[np.lexsort((mix(every["id"]), every["key"]))]  # of rows with one key a query sees those around its own hash
        known, asked = every[every["role"] & _INDEX > 0], every[every["role"] & _QUERY > 0]
        out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        if len(known) and len(asked):
            own = V.unit(known["vec"])
            light = own.astype(np.float32)
            at = np.cumsum(every["role"] & _INDEX > 0)[every["role"] & _QUERY > 0]
            for a in range(0, len(asked), TILE):
                part = asked[a : a + TILE]
                best = Best(part["id"], V.unit(part["vec"]), k, same, places)
                near, far = int(at[a]), int(at[a + len(part) - 1])
                low, high = max(0, near - window), min(len(known), far + window)
                middle = max(low, near - TILE), min(high, far + TILE)
                spans = [middle, (low, middle[0]), (middle[1], high)]
                for x, y in spans:
                    for z in range(x, y, STEP):
                        end = min(y, z + STEP)
                        best.compare(known["id"][z:end], own[z:end], light[z:end])
                q, i = np.nonzero(best.score > -np.inf)
                for x, y in zip(out, (part["id"][q], best.found[q, i], best.score[q, i])):
                    x.append(y)
        return pa.table({n_: np.concatenate(x) for n_, x in zip(("qid", "iid", "s"), out)})

    if queries is None:
        sent = index.select("id", "vec").mapInArrow(scatter(_INDEX | _QUERY), "g bigint, block binary")
    else:
        sent = index.select("id", "vec").mapInArrow(scatter(_INDEX), "g bigint, block binary").union(queries.select("id", "vec").mapInArrow(scatter(_QUERY), "g bigint, block binary"))
    if near is None:
        return sent.groupBy("g").applyInArrow(search, "qid bigint, iid bigint, s double")
    buckets = max(1, -(-m // RANGE_ROWS))
    hit = np.dtype([("qid", "<i8"), ("iid", "<i8"), ("s", "<i4")])  # s in units of the last place

    def packed(table: pa.Table) -> pa.Table:
        q, i, s = (x.to_numpy() for x in search(table).columns)
        there = s >= near
        block = np.zeros(there.sum(), dtype=hit)
        block["qid"], block["iid"], block["s"] = q[there], i[there], np.rint(s[there] * 10**places)
        b = (mix(block["qid"]) * buckets).astype(np.int64)
        order = np.argsort(b, kind="stable")
        which, first = np.unique(b[order], return_index=True)
        return pa.table({"b": which, "block": pa.array([x.tobytes() for x in np.split(block[order], first[1:])] if len(which) else [], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        V.settle()
        every = np.frombuffer(b"".join(table.column("block").to_pylist()), dtype=hit)
        every = every[np.lexsort((every["iid"], -every["s"], every["qid"]))]
        q = every["qid"]
        every = every[np.concatenate([[True], (q[1:] != q[:-1]) | (every["iid"][1:] != every["iid"][:-1])])]  # one pair has one cosine: its repeats are side by side
        rank = np.arange(len(every)) - np.searchsorted(every["qid"], every["qid"])
        every, rank = every[rank < k], rank[rank < k]
        return pa.table({"qid": np.ascontiguousarray(every["qid"]), "iid": np.ascontiguousarray(every["iid"]), "s": every["s"] / 10**places, "pos": rank.astype(np.int32)})

    return sent.groupBy("g").applyInArrow(packed, "b bigint, block binary").groupBy("b").applyInArrow(merged, "qid bigint, iid bigint, s double, pos int")


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    """(qid, iid, s): the k best of each query's hits, repeats once; a query has at most a few times k x curves."""
    top = hits.groupBy("qid").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("s")).alias("s"), "iid"))), 1, k).alias("top"))
    top = top.select("qid", F.explode("top").alias("t"))
    return top.select("qid", F.col("t.iid").alias("iid"), (-F.col("t.s")).alias("s"))


def nearest(
    queries: DataFrame, index: DataFrame, k: int, query_id: str, index_id: str, column: str = "embedding", dims: int = 64,
    curves: int = 4, window: int = 8192, same: bool = False, places: int = 5, seed: int = 5,
) -> DataFrame:
    """(query_id, index_id, similarity): each usable query's k index vectors of highest cosine, rounded; equal: smaller id.

    Projected on `curves` rotated and shifted sets of axes, all vectors are ordered along Hilbert curves (see V.Curve; the fit takes
    about V.FIT_ROWS rows). Curves are cut into ranges, and each query is compared exactly, up to rounding to `places`, with the
    `window` index rows to either side of its place on each curve, across range borders; the hits of all curves are merged. The
    window is n^(2/3) where that is more, so it grows with an index of n rows. Results are exact while the index has
    no more rows than the window; beyond, a neighbour is missed where no curve brings it near.
    Index copies beyond the k smallest ids of one direction (to 6 decimals) can't be among the k and stay out.

    Unusable vectors (null, not `dims` long, not finite, all zero) and null ids take no part. With `same` a query never finds
    its own id. Fewer than k usable index vectors: all of them. Ids must not repeat on a side. An empty side gives no rows.
    """
    spark = queries.sparkSession
    own_index, own_query = (index_id, query_id) if index_id != query_id else (index_id, f"query_{query_id}")
    base = V.usable_vectors(index, index_id, column, dims, "index")
    asked = V.usable_vectors(queries, query_id, column, dims, "queries")
    base = V.without_surplus_copies(base, k + same).select("id", "vec")
    n, m = base.count(), asked.count()
    if not n or not m:
        return spark.createDataFrame([], f"{own_query} bigint, {own_index} bigint, similarity double")
    hits = window_hits(base, asked, n, m, k, dims, curves, max(window, round(n ** (2 / 3))), same, places, False, seed)
    return best_hits(hits, k).select(F.col("qid").alias(own_query), F.col("iid").alias(own_index), F.col("s").alias("similarity"))
