"""Session defaults, written intermediate tables and size-checked joins."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side is broadcast only up to this many rows and bytes; beyond them the join shuffles and AQE splits hot keys.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
_COSTLY = re.compile(r"\b(Aggregate|Join|Window|Generate|MapInArrow|MapInPandas|FlatMapGroupsInArrow|FlatMapGroupsInPandas|Sort|Repartition\w*)\b")

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def session(app: str = "phytomill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; `conf` overrides."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application; local masters share the driver's files."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    base = f"{tempfile.mkdtemp(prefix='phytomill-code-')}/phytomill-code"
    sc.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where that is unset and the master local (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="phytomill-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and a lost executor costs no rerun."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/phytomill-{uuid.uuid4().hex[:12]}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._pm_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a query's own files; cleanup deletes it."""
    path = f"{shared_dir(spark)}/phytomill-{uuid.uuid4().hex[:12]}-{name}"
    _written.append((spark, path))
    return path


def release(*tables: DataFrame | None) -> None:
    """Delete tables that `materialize` returned and nothing reads any more; other frames are left alone."""
    paths = {getattr(t, "_pm_path", None) for t in tables} - {None}
    for spark, path in [x for x in _written if x[1] in paths]:
        _delete(spark, path)
        _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cleanup() -> None:
    """Delete the intermediate tables written so far; frames built on them can't be read afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            pass


atexit.register(cleanup)


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, most: int | None = None) -> DataFrame:
    """Join a big side with a lookup table: broadcast after measuring it, else an ordinary join (AQE splits hot keys).

    most: rows that the table has at most, where the caller knows; within max_rows they aren't counted again.

    A table that takes more than reading and filtering is written first, so that measuring it doesn't compute it twice. Broadcast
    are at most max_rows rows whose files, as Spark estimates the columns read, hold at most BROADCAST_BYTES.
    """
    plan = table._jdf.queryExecution().optimizedPlan()
    if _COSTLY.search(plan.toString()):
        table = materialize(table, "lookup")
        plan = table._jdf.queryExecution().optimizedPlan()
    few = most is not None and most <= max_rows
    small = int(str(plan.stats().sizeInBytes())) <= BROADCAST_BYTES and (few or table.limit(max_rows + 1).count() <= max_rows)
    return rows.join(F.broadcast(table) if small else table, on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
