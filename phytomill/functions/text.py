"""Text columns: prompts, rank paths, file names, URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "a photo of "  # fixed value
SIZES = ("square", "small", "medium", "large", "original")  # fixed values: size tokens of photo URLs


def strip(c: Column) -> Column:
    """Without outer white space of any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """Stripped, null where nothing is left."""
    return F.when(strip(c) != "", strip(c))


def join_filled(parts: Sequence[Column]) -> Column:
    return F.concat_ws(" ", *[filled(p) for p in parts])


def path_prompt(ranks: Sequence[Column]) -> Column:
    path = join_filled(ranks)
    return F.when(path != "", F.concat(F.lit(PREFIX), path)).otherwise("")


def name_prompt(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit(PREFIX), filled(name)), F.lit(""))


def common_prompt(common: Column, name: Column) -> Column:
    """Of the common name, of the scientific one where that is missing."""
    return name_prompt(F.coalesce(filled(common), filled(name)))


def rank_at(ranks: Column, k: int) -> Column:
    """The k-th entry (from 0) of a rank array, '' where it is too short or null."""
    return F.coalesce(F.get(ranks, F.lit(k)), F.lit(""))


def path_of(ranks: Column) -> Column:
    return F.concat_ws(" ", F.filter(ranks, lambda x: F.coalesce(x, F.lit("")) != ""))


def binomial(genus: Column, epithet: Column) -> Column:
    return F.concat_ws(" ", F.when(genus != "", genus), F.when(epithet != "", epithet))


def safe_name(c: Column) -> Column:
    """A name fit for file systems: reserved characters (fixed values) become "_"."""
    return strip(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"))


def safe_dirname(key: Column, name: Column) -> Column:
    return F.concat(key.cast("string"), F.lit("_"), safe_name(name))


def resized_url(url: Column, size: str) -> Column:
    """The URL of another size of the same photo; an unknown size means medium."""
    return F.regexp_replace(url, r"/(" + "|".join(SIZES) + r")\.", f"/{size if size in SIZES else 'medium'}.")


def photo_file(obs: Column, photo: Column) -> Column:
    return F.concat(obs.cast("string"), F.lit("_"), photo.cast("string"), F.lit(".jpg"))


def dir_key(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def is_image(c: Column) -> Column:
    return F.lower(c).rlike(r"\.(jpg|jpeg|png|webp)$")


def url_suffix(url: Column) -> Column:
    """The path's extension, ".jpg" where it has none."""
    ext = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1)
    return F.when(ext != "", ext).otherwise(".jpg")


def underscored(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def query_url(base: str, **params: object) -> str:
    """A URL with percent-encoded parameters (spaces as %20)."""
    from urllib.parse import quote, urlencode

    return base + ("&" if "?" in base else "?") + urlencode(params, quote_via=quote)
