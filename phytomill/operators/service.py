"""Identification requests, answered in batches: one row a request, errors as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytomill.functions import images
from phytomill.functions.encoder import Encoder, HashEncoder, PixelEncoder, encode_column
from phytomill.operators import search


def health(index: DataFrame) -> DataFrame:
    """One row: status and species_count."""
    return index.agg(F.when(F.count(F.lit(1)) > 0, "ok").otherwise("empty").alias("status"), F.count(F.lit(1)).alias("species_count"))


def checked_k(k: int) -> int:
    """k of 1 to 20, else ValueError."""
    if not 1 <= k <= 20:
        raise ValueError("topk must lie between 1 and 20")
    return k


def identify(index: DataFrame, requests: DataFrame, key: str, k: int = 5, make: Callable[[], Encoder] = HashEncoder) -> DataFrame:
    """(request_id, results JSON, error): requests (request_id, image as base64 text) against the index.

    A missing image and one that can't be decoded give an error and no results. Results carry rank, similarity,
    similarity_pct, confidence and the index's text columns with blanks, "nan" and "None" as null.
    """
    k = checked_k(k)
    body = F.expr("try_to_binary(image, 'base64')")
    decoded = requests.select("request_id", F.when(F.coalesce("image", F.lit("")) == "", "missing image").when(body.isNull(), "image can't be decoded").alias("error"), body.alias("body"))
    asked = decoded.filter("error is null").select("request_id", encode_column(F.col("body"), make).alias("embedding"))
    hits = search.results(search.topk(index, asked, k, key, "request_id"))
    kinds = dict(index.dtypes)
    meta = [c for c in index.columns if c not in ("embedding", key)]
    shown = index.select(key, *[search.null_meta(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in meta])
    rows = hits.join(shown, key, "left")
    record = F.struct("rank", "similarity", "similarity_pct", "confidence", key, *meta)
    lists = rows.groupBy("request_id").agg(F.to_json(F.sort_array(F.collect_list(record)), {"ignoreNullFields": "false"}).alias("results"))
    return decoded.select("request_id", "error").join(lists, "request_id", "left").select("request_id", "results", "error")


def health_record(index: DataFrame | None, device: str = "spark") -> dict:
    """The answer of a health request: status, device, species_count."""
    if index is None:
        return {"status": "loading", "device": device, "species_count": 0}
    row = health(index).first()
    return {"status": row["status"], "device": device, "species_count": row["species_count"]}


def predict(index: DataFrame | None, image: bytes | None, key: str, k: int = 5, make: Callable[[], Encoder] = HashEncoder) -> tuple[int, dict]:
    """(status, body) of one request: 200 with results, 422 for k outside 1 to 20, 400 for a bad image, 503 before an index is there, 500 otherwise."""
    if index is None:
        return 503, {"detail": "the index is not ready"}
    try:
        checked_k(k)
    except ValueError as error:
        return 422, {"detail": str(error)}
    vector = make().encode([image])[0] if image else None
    if vector is None:
        return 400, {"detail": "the image can't be decoded"}
    try:
        return 200, {"results": _answer(index, vector, key, k)}
    except Exception as error:
        return 500, {"detail": str(error)}


def _answer(index: DataFrame, vector: list[float], key: str, k: int) -> list[dict]:
    asked = index.sparkSession.createDataFrame([(0, vector)], "request_id bigint, embedding array<float>")
    hits = search.results(search.topk(index, asked, k, key, "request_id")).drop("request_id")
    return [r.asDict() for r in hits.join(index.drop("embedding"), key, "left").orderBy("rank").collect()]  # at most 20 rows


def identify_image(index: DataFrame, source: str, key: str, k: int = 5, make: Callable[[], Encoder] = PixelEncoder) -> list[dict]:
    """The k results for an image at a path or address; FileNotFoundError or ValueError where there is none."""
    vector = make().encode([images.read(source)])[0]
    if vector is None:
        raise ValueError(f"{source} can't be decoded")
    return _answer(index, vector, key, k)


def report(results: DataFrame) -> DataFrame:
    """Lines to show: place, name, similarity, tier label and bar width."""
    name = F.coalesce(search.null_meta(F.col("scientific_name")), search.null_meta(F.col("common_name")), F.lit("unknown"))
    pct = F.col("similarity_pct")
    return results.select("rank", name.alias("name"), "similarity", search.tier_label(search.tier(pct)).alias("tier"), search.bar_width(pct).alias("width"))
