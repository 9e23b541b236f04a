"""Train, validation and test splits that keep connected records together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytomill.runtime import lookup_join, materialize, release

BUCKETS = 4096


def propagate_labels(edges: DataFrame, record: str, entity: str) -> DataFrame:
    """Columns (entity, label): the smallest entity reachable over shared records. Both ids are BIGINT.

    Each round every record takes the least label of its entities, every entity the least of its records (both are
    aggregated before the shuffle, so a hot record or entity is spread), then each label is replaced by its own label, which
    doubles the reach; rounds stop when no label changes. Null edges are ignored, repeats count once, no edges give no rows.
    """
    edges = materialize(edges.select(F.col(record).alias("r"), F.col(entity).alias("e")).dropna().distinct(), "edges")
    labels = materialize(edges.select("e").distinct().withColumn("label", F.col("e")), "labels")
    last = labels
    while True:
        least = materialize(lookup_join(edges, labels, ["e"], "inner").groupBy("r").agg(F.min("label").alias("m")), "record-labels")
        near = materialize(lookup_join(edges, least, ["r"], "inner").groupBy("e").agg(F.min("m").alias("m")), "near")
        hop = near.select(F.col("e").alias("m"), F.col("m").alias("further"))
        new = lookup_join(lookup_join(near, labels, ["e"], "inner"), hop, ["m"], "left")
        new = materialize(new.select("e", F.col("label").alias("old"), F.least("m", F.coalesce("further", "m")).alias("label")), "labels")
        release(last, least, near)
        labels, last = new.drop("old"), new
        if new.filter("old <> label").isEmpty():
            release(edges)
            return labels.select(F.col("e").alias(entity), "label")


def linked_entities(edges: DataFrame, record: str, entity: str) -> DataFrame:
    """(entity, label) of the entities that share a record with another entity; records of one entity link nothing."""
    linking = edges.dropna().groupBy(record).agg(F.min(entity).alias("a"), F.max(entity).alias("b")).filter("a <> b").select(record)
    return propagate_labels(lookup_join(edges.dropna(), linking, [record], "inner"), record, entity)


def components(rows: DataFrame, record_id: str, first: str, second: str) -> DataFrame:
    """`rows` with `component` STRING: rows with an equal `first` or `second`, directly or through other rows, share it.

    Nulls link nothing: a row with neither value is a component of its own, named by record_id. Repeated rows share it too.
    """
    edges = rows.select(F.col(first).alias("f"), F.col(second).alias("s")).dropna().distinct()
    edges = materialize(edges, "bipartite")
    labels = linked_entities(edges, "f", "s")
    rooted = lookup_join(edges, labels, ["s"], "left").groupBy("f").agg(F.min(F.coalesce("label", "s")).alias("root"))
    out = lookup_join(rows, labels.select(F.col("s").alias(second), F.col("label").alias("_pm_label")), [second])
    out = lookup_join(out, materialize(rooted.select(F.col("f").alias(first), F.col("root").alias("_pm_root")), "rooted"), [first])
    root = F.coalesce("_pm_label", second, "_pm_root")
    name = F.when(root.isNotNull(), F.concat(F.lit("s"), root)).when(F.col(first).isNotNull(), F.concat(F.lit("f"), first))
    return out.select(*[rows[c] for c in rows.columns], F.coalesce(name, F.concat(F.lit("r"), record_id)).alias("component"))


def _fit(aims: DataFrame, sizes: list[float], rounds: int = 12) -> list[float]:
    """Factors of the columns of `open` with which rows that sum to `all` give columns in proportion to `sizes` (raking)."""
    factors = [1.0] * len(sizes)
    for _ in range(rounds):
        weight = sum((F.col("open")[k] * f for k, f in enumerate(factors)), F.lit(0.0))
        got = aims.agg(*[F.sum(F.col("all") * F.col("open")[k] * f / weight) for k, f in enumerate(factors)]).first()  # one row
        if got[0] is None or not sum(got) or not sum(sizes):
            break
        off = [(sizes[k] / sum(sizes)) / (x / sum(got)) if x else 1.0 for k, x in enumerate(got)]
        if max(abs(x - 1) for x in off) < 1e-3 or min(off) <= 0:
            break
        factors = [f * x for f, x in zip(factors, off)]
    return factors


def assign_groups(rows: DataFrame, group: str, label: str, shares: Mapping[str, float], seed: str = "split", heavy: int = 1000) -> DataFrame:
    """`rows` with `split`: every group whole in one split, each label's rows divided as near to `shares` as groups allow.

    Groups of more than 1/heavy of all rows (so fewer than `heavy`) are placed one by one, largest first, where they leave the
    least squared deviation over labels. The others are divided within their commonest label by hash, along the shares the
    heavy ones left open, fitted so that the splits' whole sizes come out too; only counts per (label, hash bucket) are ordered. A null label is a label of its own; a null group
    gets a null split; an empty table gives an empty one; the same rows always get the same split.
    """
    names = list(shares)
    total_share = sum(shares.values())
    want = [shares[s] / total_share for s in names]
    sizes = rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "group-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    groups = sizes.groupBy("g").agg(F.sum("n").alias("n"), F.max_by("l", F.struct("n", "l")).alias("l"))
    groups = materialize(groups, "groups")
    big = groups.filter(F.col("n") * heavy > total)  # fewer than `heavy`
    common = materialize(sizes.groupBy("l").agg(F.sum("n").alias("n")).filter(F.col("n") * heavy > total), "labels")  # as few
    label_total = {r["l"]: r["n"] for r in common.collect()}
    label_total[None] = total - sum(label_total.values())  # labels rarer than that count as one here
    pooled = lookup_join(lookup_join(sizes, big.select("g"), ["g"], "inner"), common.select("l", F.col("l").alias("c")), ["l"])
    parts: dict[str, list[tuple[str | None, int]]] = {}
    for r in pooled.groupBy("g", "c").agg(F.sum("n").alias("n")).toLocalIterator():
        parts.setdefault(r["g"], []).append((r["c"], r["n"]))
    per_label: dict[str | None, list[float]] = {}
    placed: list[tuple[str, str]] = []
    whole = [0.0] * len(names)
    for g, own in sorted(parts.items(), key=lambda x: (-sum(n for _, n in x[1]), str(x[0]))):
        def cost(k: int) -> float:
            size = sum(n for _, n in own)
            change = (whole[k] + size - want[k] * total) ** 2 - (whole[k] - want[k] * total) ** 2
            for name, n in own:
                at, aim = per_label.get(name, [0.0] * len(names))[k], want[k] * label_total[name]
                change += (at + n - aim) ** 2 - (at - aim) ** 2
            return change

        k = min(range(len(names)), key=cost)
        placed.append((g, names[k]))
        for name, n in own:
            per_label.setdefault(name, [0.0] * len(names))[k] += n
            whole[k] += n
    spark = rows.sparkSession
    kind = dict(groups.dtypes)["g"]
    fixed = spark.createDataFrame(placed, f"g {kind}, heavy_split string")
    taken = spark.createDataFrame([(name, [float(x) for x in at]) for name, at in per_label.items()], "l string, taken array<double>")

    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("g").cast("string")), F.lit(BUCKETS))
    light = lookup_join(groups, fixed.select("g"), ["g"], "left_anti").withColumn("b", bucket)
    counted = materialize(light.groupBy("l", "b").agg(F.sum("n").alias("n")), "buckets")  # at most BUCKETS rows a label
    aims = lookup_join(counted.groupBy("l").agg(F.sum("n").alias("all")), taken, ["l"]).withColumn("taken", F.coalesce("taken", F.array_repeat(F.lit(0.0), len(names))))
    full = F.col("all") + F.aggregate("taken", F.lit(0.0), lambda a, x: a + x)
    aims = materialize(aims.select("l", "all", F.array(*[F.greatest(F.lit(0.0), F.lit(w) * full - F.col("taken")[k]) for k, w in enumerate(want)]).alias("open")), "aims")
    factors = _fit(aims, [max(0.0, w * total - whole[k]) for k, w in enumerate(want)])
    parts_ = [F.col("open")[k] * f for k, f in enumerate(factors)]
    weight = sum(parts_, F.lit(0.0))
    edges = materialize(aims.select("l", "all", F.array(*[sum(parts_[: k + 1], F.lit(0.0)) / weight for k in range(len(names))]).alias("edges")), "edges")
    placed_ = counted.withColumn("mid", F.sum("n").over(Window.partitionBy("l").orderBy("b")) - F.col("n") / 2)
    # each label begins at a place of its own, so that the remainders of small labels don't all fall to one split
    turn = (F.pmod(F.xxhash64(F.lit(seed), F.lit("turn"), F.col("l")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    placed_ = lookup_join(placed_, edges, ["l"]).withColumn("at", F.pmod(F.col("mid") / F.col("all") + turn, F.lit(1.0)))
    chosen = F.lit(names[-1])
    for k in range(len(names) - 2, -1, -1):
        chosen = F.when(F.col("at") <= F.col("edges")[k], names[k]).otherwise(chosen)
    by_bucket = materialize(placed_.select("l", "b", chosen.alias("light_split")), "buckets")
    split = lookup_join(lookup_join(groups.withColumn("b", bucket), by_bucket, ["l", "b"]), fixed, ["g"])
    split = materialize(split.select(F.col("g").alias(group), F.coalesce("heavy_split", "light_split").alias("split")), "split")
    return lookup_join(rows.drop("split"), split, [group]).select(*[c for c in rows.columns if c != "split"], "split")


def split_balance(rows: DataFrame, label: str, shares: Mapping[str, float]) -> DataFrame:
    """(label, split, n, share, wanted, deviation): how each label's rows, and all rows (label null), are divided.

    Rows without a split are left out; a label that has no row in a split has a line with 0 there.
    """
    whole = sum(shares.values())
    counts = rows.filter("split is not null").groupBy(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).agg(*[F.count_if(F.col("split") == s).alias(s) for s in shares])
    counts = counts.unionByName(counts.agg(F.lit(None).cast("string").alias("label"), *[F.sum(s).alias(s) for s in shares]))
    total = sum((F.col(s) for s in shares), F.lit(0))
    line = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n"), F.lit(w / whole).alias("wanted")) for s, w in shares.items()])).alias("x")
    out = counts.select("label", total.alias("all"), line).select("label", "x.split", "x.n", (F.col("x.n") / F.col("all")).alias("share"), "x.wanted")
    return out.withColumn("deviation", F.col("share") - F.col("wanted"))
