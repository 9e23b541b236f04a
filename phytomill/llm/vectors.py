"""Vectors in Arrow batches, their copies, and Hilbert orderings of their projections."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytomill.functions.arrays import matrix, unit
from phytomill.runtime import lookup_join, materialize

#: Rows, lowest by hash, on which projections and the spread of keys are fitted, and ranges fitted anew. All rows are then indexed.
FIT_ROWS, RANGES = 16_384, 16


def settle() -> None:
    """Once a Python worker: what is loaded by now stays, so that the collection after each of its tasks needn't walk it again."""
    if not gc.get_freeze_count():
        gc.collect()
        gc.freeze()


def usable(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, float32 rows of the usable): those of `dims` finite numbers, not all zero."""
    good, rows = matrix(column, dims)
    full = (rows != 0).any(axis=1)
    good[np.nonzero(good)[0][~full]] = False
    return good, rows[full]


def packed(rows: np.ndarray) -> pa.Array:
    """A BINARY array, one value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, dims: int, dtype=np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dims), dtype=dtype)
    size = np.dtype(dtype).itemsize * dims
    start = column.offset
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    first = np.frombuffer(column.buffers()[1], dtype=np.int32)[start]
    return raw[first : first + len(column) * size].view(dtype).reshape(len(column), dims)


def usable_vectors(df: DataFrame, id_: str, column: str, dims: int, name: str = "vectors") -> DataFrame:
    """A written table (id BIGINT, vec BINARY of float32, h BIGINT) of the rows with an id and a usable vector.

    h is a hash of the direction to 6 decimals: vectors that agree in it count as copies of one, whatever their lengths.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, rows = usable(b.column(1), dims)
            course = packed(np.rint(unit(rows) * 1e6).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), packed(rows), course], names=["id", "vec", "course"])

    rows = df.filter(F.col(id_).isNotNull() & (F.size(column) == dims)).select(F.col(id_).cast("bigint").alias("id"), F.col(column).cast("array<float>").alias("v"))
    read_ = rows.mapInArrow(read, "id bigint, vec binary, course binary")
    return materialize(read_.select("id", "vec", F.xxhash64("course").alias("h")), name)


def without_surplus_copies(vectors: DataFrame, most: int) -> DataFrame:
    """`vectors` with the `most` smallest ids of each repeated vector; only vectors repeated more often are looked at closely."""
    hot = materialize(vectors.groupBy("h").count().filter(F.col("count") > most).select("h", F.lit(True).alias("hot")), "hot")
    if hot.isEmpty():
        return vectors
    order = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    repeated = lookup_join(vectors.select("h", "id"), hot.select("h"), ["h"], "inner")
    kept = materialize(repeated.withColumn("r", order).filter(F.col("r") <= most).select("h", "id", F.lit(True).alias("kept")), "kept")  # cut to `most` a task before the shuffle
    marked = lookup_join(lookup_join(vectors, hot, ["h"]), kept, ["h", "id"])
    return marked.filter("hot is null or kept").select("id", "vec", "h")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of whole-number cells (rows of fewer than 64 / bits coordinates), by Gray-code untangling."""
    x = [c.astype(np.uint32) for c in cells.T]
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(d):
            upper = (x[i] >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(upper, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> np.uint32(level)) & np.uint32(1) == 1, turn ^ np.uint32((1 << level) - 1), turn)
    key = np.zeros(len(turn), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> np.uint32(level)) & np.uint32(1)).astype(np.int64)
    return key


class _Order:
    """One Hilbert ordering: rotated axes of the widest spread of `sample`, each cut into cells that hold equally many sample rows."""

    def __init__(self, sample: np.ndarray, rng: np.random.Generator, span: int, dims: int, bits: int):
        self.bits = bits
        span = min(span, sample.shape[1])
        dims = min(dims, span)
        centred = sample - sample.mean(axis=0)
        axes = np.linalg.eigh(centred.T @ centred / len(centred) + 1e-12 * np.eye(sample.shape[1]))[1]
        self.axes = axes[:, ::-1][:, :span] @ np.linalg.qr(rng.normal(size=(span, span)))[0][:, :dims]
        at = sample @ self.axes
        levels = (np.arange(1, 1 << bits) + rng.uniform(-0.5, 0.5, size=(dims, 1))) / (1 << bits)  # each axis' grid is shifted
        self.edges = [np.quantile(at[:, d], levels[d]) for d in range(dims)]

    def key(self, rows: np.ndarray) -> np.ndarray:
        at = rows @ self.axes
        cells = [np.searchsorted(e, at[:, d], side="right") for d, e in enumerate(self.edges)]
        return hilbert(np.stack(cells, axis=1).astype(np.uint32), self.bits)


class Curve:
    """A Hilbert ordering of projected vectors whose ranges are ordered once more, each on its own projection.

    Cells follow the spread of the sample, so a dense region gets as many of them as its rows; what the first ordering leaves
    close together the second tells apart on axes fitted there.
    """

    def __init__(self, sample: np.ndarray, seed: int, span: int = 24, dims: int = 6, bits: int = 6):
        rng = np.random.default_rng(seed)
        self.first = _Order(sample, rng, span, dims, bits)
        key = self.first.key(sample)
        order = np.argsort(key, kind="stable")
        key = key[order]
        ranges = max(1, min(RANGES, len(key) // 128))
        self.cuts = np.unique(key[np.arange(1, ranges) * len(key) // ranges])
        part = np.searchsorted(self.cuts, key, side="right")
        self.own, self.keys, self.start = [], [], []
        for r in range(len(self.cuts) + 1):
            rows = sample[order[part == r]]
            own = _Order(rows, rng, span, dims, bits) if len(rows) > 1 else None
            self.own.append(own)
            self.keys.append(np.sort(own.key(rows)) if own else np.zeros(len(rows), dtype=np.int64))
            self.start.append(int(np.searchsorted(part, r)))
        self.rows, self.bits = len(sample), dims * bits

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's position, and the shares of the sample before it and before or equal to it."""
        part = np.searchsorted(self.cuts, self.first.key(rows), side="right")
        key = np.zeros(len(rows), dtype=np.int64)
        before, upto = np.zeros(len(rows)), np.zeros(len(rows))
        for r in np.unique(part):
            at = np.nonzero(part == r)[0]
            if self.own[r]:
                key[at] = self.own[r].key(rows[at])
            before[at] = self.start[r] + np.searchsorted(self.keys[r], key[at], "left")
            upto[at] = self.start[r] + np.searchsorted(self.keys[r], key[at], "right")
        return (part.astype(np.int64) << self.bits) | key, before / self.rows, upto / self.rows


def fit_sample(vectors: DataFrame, n: int, dims: int, rows: int = FIT_ROWS) -> np.ndarray:
    """Unit vectors of about `rows` rows of lowest hash, on the driver."""
    part = vectors.filter(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, n))))
    table = part.select("vec").toArrow() if n else None
    if table is None or not table.num_rows:
        table = vectors.select("vec").limit(rows).toArrow()
    return unit(unpacked(table.column(0), dims))
