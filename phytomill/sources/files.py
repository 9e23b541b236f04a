"""Readers and writers: species lists, vector indexes, image folders, region features."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phytomill.functions import text
from phytomill.operators.acquire import first_n

SPECIES = "rank INT, common_name STRING, scientific_name STRING, taxon_id STRING, observations_count BIGINT, iconic_taxon STRING, rank_level STRING"
FEATURES = "features ARRAY<STRUCT<geometry: STRING, properties: STRUCT<LEVEL3_COD: STRING, LEVEL3_NAM: STRING>>>"
PAGE = "results ARRAY<STRUCT<count: BIGINT, taxon: STRUCT<id: BIGINT, name: STRING, preferred_common_name: STRING, iconic_taxon_name: STRING, rank: STRING>>>"


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df`, or ValueError naming the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_species(spark: SparkSession, path: str, schema: str = SPECIES) -> DataFrame:
    """A species list from CSV; ids stay text, a byte-order mark is skipped."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return require_columns(df, ["taxon_id", "scientific_name"])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mark: bool = True) -> None:
    """CSV with the given columns in order and a header; every file begins with a byte-order mark, or doesn't."""
    first, *rest = columns
    rows = df.select(F.col(first).alias(("\ufeff" if mark else "") + first), *rest)
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_index(df: DataFrame, path: str) -> None:
    """A vector index as compressed Parquet, by kingdom where it has one."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy("kingdom") if "kingdom" in df.columns else writer).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A vector index; a missing one is named in the error."""
    try:
        return require_columns(spark.read.parquet(path), ["embedding"])
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no index at {path}: build it with write_index") from error
        raise


def import_matrix(spark: SparkSession, path: str, names: DataFrame, at_once: int = 4096) -> DataFrame:
    """(pos, ranks, common, embedding) from a dims x N matrix file (.npy, on a path all executors see) and names (pos, ranks, common).

    Tasks map the file and read their columns only; nothing passes through the driver. Numbers of names and columns must agree.
    """
    n = int(np.load(path, mmap_mode="r").shape[1])
    if names.count() != n:
        raise ValueError("there must be as many names as columns")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(path, mmap_mode="r")
        for b in batches:
            for start in b.column(0).to_pylist():
                own = np.ascontiguousarray(matrix[:, start : start + at_once].T, dtype=np.float32)
                offsets = pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(own))), pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))], names=["pos", "embedding"])

    vectors = spark.range(0, n, at_once).mapInArrow(read, "pos bigint, embedding array<float>")
    return names.select(F.col("pos").cast("bigint").alias("pos"), "ranks", "common").join(vectors, "pos")


DISTRIBUTION = "id STRING, taxonRemarks STRING, lifeform STRING, climate STRING, distribution STRUCT<natives: ARRAY<STRUCT<tdwgCode: STRING>>>"


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    """(id, code, origin, lifeform, climate) of nested distribution records: a row a native region, one with a null code where there is none."""
    rows = spark.read.schema(DISTRIBUTION).json(path)
    return rows.select("id", F.explode_outer("distribution.natives.tdwgCode").alias("code"), F.col("taxonRemarks").alias("origin"), "lifeform", "climate")


def scan_images(spark: SparkSession, root: str, known: DataFrame, key: str = "taxon_id", n: int | None = None) -> DataFrame:
    """(key, file, path) of image files in folders named "<key>_<name>" of known keys; the first n by path, or all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split("path", "/")
    files = files.select("path", F.url_decode(F.element_at(parts, -2)).alias("dir"), F.url_decode(F.element_at(parts, -1)).alias("file"))
    files = files.filter(text.is_image(F.col("file"))).select(text.dir_key(F.col("dir")).alias(key), "file", "path")
    files = files.join(known.select(key).distinct(), key, "left_semi")
    return files if n is None else first_n(files, key, ["path"], n).drop("position")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of image files; decoding is the encoder's part."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(text.is_image(F.col("path"))).select("path", "content")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(geometry as JSON text, code, name) of a region FeatureCollection."""
    rows = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.inline("features"))
    return rows.select("geometry", F.col("properties.LEVEL3_COD").alias("code"), F.col("properties.LEVEL3_NAM").alias("name"))


def flatten_pages(pages: DataFrame) -> DataFrame:
    """The species of result pages, blanks for missing texts and 0 for missing counts."""
    rows = pages.select(F.inline("results"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        blank("taxon.preferred_common_name").alias("common_name"), blank("taxon.name").alias("scientific_name"),
        F.coalesce(F.col("taxon.id").cast("string"), F.lit("")).alias("taxon_id"), F.coalesce("count", F.lit(0)).alias("observations_count"),
        blank("taxon.iconic_taxon_name").alias("iconic_taxon"), blank("taxon.rank").alias("rank_level"),
    )


def flatten_photos(observations: DataFrame, size: str = "medium") -> DataFrame:
    """(obs_id, photo_id, url, obs_pos, photo_pos) of nested observations, photos without address dropped."""
    rows = observations.select(F.col("id").alias("obs_id"), F.monotonically_increasing_id().alias("obs_pos"), F.posexplode("photos").alias("photo_pos", "p"))
    rows = rows.filter(F.coalesce("p.url", F.lit("")) != "")
    return rows.select("obs_id", F.col("p.id").alias("photo_id"), text.resized_url(F.col("p.url"), size).alias("url"), "obs_pos", "photo_pos")


def to_json_rows(df: DataFrame) -> DataFrame:
    """(json) with nulls kept and letters beyond ASCII as they are."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def single_json(record: dict) -> str:
    return json.dumps(record, ensure_ascii=False)
