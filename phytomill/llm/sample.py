"""A sample that keeps what it once chose while the data grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phytomill.operators.acquire import lowest, priority
from phytomill.runtime import materialize


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def load_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed steps of the ledger in folder `path`; None where there is none yet."""
    place, files = _files(spark, path)
    if not files.exists(place):
        return None
    steps = sorted(str(f.getPath()) for f in files.listStatus(place) if f.getPath().getName().startswith("step-"))
    return spark.read.parquet(*steps) if steps else None


def grow_ledger(keys: DataFrame, path: str, key: str, share: float, step_no: int, seed: str = "sample") -> DataFrame:
    """The state of the selection ledger kept in folder `path` after this step, columns (key, priority, chosen_at).

    keys: the keys known now (repeats and nulls are ignored). Every key the ledger holds stays chosen, even one no longer among
    the keys. The quota is ceil(share x distinct keys); what the ledger's present keys leave open is filled from unseen keys of
    lowest hash priority. Neither order nor partitioning of the input matters. No keys: the ledger as it was. A lower share
    later removes nothing.

    The keys of a step are written to one side and moved into place whole, so a run that dies leaves no half step and another
    process, at any later time, goes on from what is there. A step that is there already is not drawn again. Two
    processes must not run the same step at once: the second finds it taken and fails.
    """
    spark = keys.sparkSession
    ledger = load_ledger(spark, path)
    name = f"step-{step_no:06d}"
    place, files = _files(spark, f"{path}/{name}")
    if files.exists(place):
        return ledger
    known = keys.select(F.col(key)).dropna().distinct().withColumn("priority", priority(F.col(key), seed))
    if ledger is None:
        unseen, kept = known, 0
    else:
        unseen = known.join(ledger.select(key), key, "left_anti")
        kept = known.join(ledger.select(key), key, "left_semi").count()
    unseen = materialize(unseen, "unseen")
    total = kept + unseen.count()
    quota = -int(-total * share // 1) - kept
    aside = f"{path}/.{name}-{uuid.uuid4().hex[:12]}"
    lowest(unseen, "priority", quota).withColumn("chosen_at", F.lit(step_no).cast("int")).write.parquet(aside)
    if files.exists(place) or not files.rename(_files(spark, aside)[0], place):
        raise FileExistsError(f"{path}/{name} was written by another process")
    return load_ledger(spark, path)
