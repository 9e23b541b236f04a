"""Mix sources to target shares of the total size by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytomill.functions import clean
from phytomill.runtime import lookup_join, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this vocabulary splits text before merging
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, object] = {}


def _encoder(path: str, content: bytes):
    if path not in _loaded:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(df: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """`df` without the text, with `tokens` BIGINT: the size in tokens of a public byte-level vocabulary; null texts have 0.

    The vocabulary, a file of a megabyte or so at `path` on the driver, is broadcast.
    """
    with open(path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    columns = [c for c in df.columns if c not in (text, "tokens")]
    from pyspark.sql.types import LongType, StructType

    schema = StructType([df.schema[c] for c in columns]).add("tokens", LongType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, sent.value)
        for b in batches:
            sizes = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(sizes, pa.int64())], names=[*columns, "tokens"])

    return df.select(*columns, text).mapInArrow(scan, schema)


def probabilities(rate: float, most: int) -> list[float]:
    """Of 0, 1, ... most - 1 copies under a Poisson rate."""
    if rate <= 0:
        return [1.0] + [0.0] * (most - 1) if most else []
    return [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(most)]


def truncated_mean(rate: float, most: int) -> float:
    """The mean of a Poisson count cut off at `most`."""
    p = probabilities(rate, most)
    return sum(k * x for k, x in enumerate(p)) + most * max(0.0, 1 - sum(p))


def rate_for(mean: float, most: int) -> float:
    """The Poisson rate whose count, cut off at `most`, has this mean; infinite where the mean reaches `most`."""
    if mean >= most:
        return math.inf
    low, high = 0.0, 1.0
    while truncated_mean(high, most) < mean and math.isfinite(high):
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if truncated_mean(mid, most) < mean else (low, mid)
    return high


def plan_mix(sized: DataFrame, targets: DataFrame, source: str = "source", target_size: int | str | None = None) -> DataFrame:
    """One row a target: (key, source, target_share, max_repeats, size, wanted, mean, reachable, feasible_size, steps).

    sized: documents with `tokens`. The mix aimed at is as large as all texts together, or target_size tokens, or, for "feasible",
    as large as every source can reach its share of (feasible_size, the least of max_repeats x size / target_share). `mean` is
    the mean repetition wanted, at most max_repeats; `reachable` is false where max_repeats times the source's size is below its
    share of the size aimed at; `steps` are the cumulative probabilities of 0, 1, ... max_repeats - 1 copies. Names are compared
    without capitals and outer spacing; targets of one name are one, of their summed share and greatest max_repeats; a source
    without documents has size 0; targets without a name or share are left out.
    """
    key = F.lower(clean.strip(F.col(source)))
    sizes = materialize(sized.groupBy(key.alias("key")).agg(F.sum("tokens").alias("size")), "source-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    wanted = targets.dropna(subset=["source", "target_share"]).select(F.lower(clean.strip(F.col("source"))).alias("key"), clean.strip(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    wanted = wanted.groupBy("key").agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))

    def steps(mean: float | None, most: int) -> list[float]:
        rate = rate_for(mean or 0.0, most)
        if math.isinf(rate):
            return [0.0] * most
        total_p, out = 0.0, []
        for p in probabilities(rate, most):
            total_p += p
            out.append(min(1.0, total_p))
        return out

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [steps(m, n) for m, n in zip(b.column("mean").to_pylist(), b.column("max_repeats").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names, "steps"])

    planned = wanted.join(sizes, "key", "left").select("key", "source", "target_share", "max_repeats", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    planned = materialize(planned, "mix-sizes")
    most = planned.filter("target_share > 0").agg(F.min(F.floor(F.col("max_repeats") * F.col("size") / F.col("target_share")))).first()[0] or 0
    aim = total if target_size is None else most if target_size == "feasible" else target_size
    planned = planned.withColumn("wanted", F.col("target_share") * F.lit(float(aim)))
    planned = planned.withColumn("mean", F.when(F.col("size") > 0, F.least(F.col("wanted") / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    planned = planned.withColumn("reachable", F.col("max_repeats") * F.col("size") >= F.col("wanted"))
    planned = planned.withColumn("feasible_size", F.lit(int(most)))
    schema = planned.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ",steps array<double>"
    return materialize(planned.mapInArrow(solve, schema), "mix-plan")


def draw_mix(sized: DataFrame, plan: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, copy, source, tokens, position): each document as often as its hash-seeded Poisson count says, in shuffled order.

    The count inverts the distribution at a hash of (seed, id), so it is the same in every run and partitioning and never above
    max_repeats; where a source can't reach its share every document has max_repeats copies. position is a hash to sort by; the
    rows come sorted by it, range-partitioned. Rows with a null id or source, of a source without target, or without tokens
    aren't drawn. Repeated rows of one id are drawn alike.
    """
    keyed = sized.filter(F.col("tokens") > 0).select(doc_id, F.lower(clean.strip(F.col(source))).alias("key"), "tokens").dropna()
    rows = lookup_join(keyed, plan.select("key", F.col("source").alias("source"), "steps"), ["key"], "inner")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = rows.withColumn("_pm_u", u)
    copies = F.size(F.filter("steps", lambda edge: F.col("_pm_u") >= edge))
    rows = rows.withColumn("_pm_n", copies).filter("_pm_n > 0")
    rows = rows.select(doc_id, F.explode(F.sequence(F.lit(1), F.col("_pm_n"))).alias("copy"), "source", "tokens")
    rows = rows.withColumn("position", F.xxhash64(F.lit(seed + "-order"), F.col(doc_id).cast("string"), "copy"))
    return rows.repartitionByRange("position", doc_id).sortWithinPartitions("position", doc_id)


def report_mix(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """One row a target: source, target_share, actual_share (of the mix's tokens), share_of_aim, size, drawn, most_copies, reachable, feasible_size.

    share_of_aim is the share of the size aimed at: about target_share for every reachable source, whatever the others lack.
    """
    drawn = materialize(mix.groupBy("source").agg(F.sum("tokens").alias("drawn"), F.max("copy").alias("most_copies")), "drawn")
    total = drawn.agg(F.sum("drawn")).first()[0] or 0
    out = plan.join(drawn, "source", "left")
    share = F.coalesce("drawn", F.lit(0)) / F.lit(float(total)) if total else F.lit(0.0)
    of_aim = F.coalesce(F.try_divide(F.coalesce("drawn", F.lit(0)) * F.col("target_share"), F.col("wanted")), F.lit(0.0))
    return out.select("source", "target_share", share.alias("actual_share"), of_aim.alias("share_of_aim"), "size", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "reachable", "feasible_size")
