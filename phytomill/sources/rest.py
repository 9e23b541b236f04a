"""Paged REST scans as a Spark data source, with a retry policy and atomic downloads."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from phytomill.functions.text import SIZES, query_url
from phytomill.operators.acquire import id_batches

SIZE = re.compile("/(" + "|".join(SIZES) + r")\.")
RESERVED = '\\/:*?"<>|'  # fixed values: characters no file name may hold


@dataclass(frozen=True)
class Retry:
    """Waits busy x attempt after "too many requests", other seconds after any other error; gives up after `tries`.

    The defaults are fixed values.
    """

    tries: int = 3
    busy: float = 60.0
    other: float = 2.0
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def run(self, get: Callable[[], bytes]) -> bytes | None:
        for attempt in range(1, self.tries + 1):
            try:
                return get()
            except urllib.error.HTTPError as error:
                wait = self.busy * attempt if error.code == 429 else self.other
            except OSError:
                wait = self.other
            if attempt < self.tries:
                self.sleep(wait)
        return None


def fetch(url: str, headers: dict[str, str] | None = None, timeout: float = 30.0) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": "phytomill", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def download(url: str, path: str, retry: Retry = Retry()) -> bool:
    """Save a file in pieces of 64 KiB: written beside its place and renamed when whole; False when it can't be had."""
    part = f"{path}.part-{os.getpid()}"

    def save() -> bytes:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "phytomill"}), timeout=60) as answer, open(part, "wb") as out:
            shutil.copyfileobj(answer, out, 1 << 16)
        return b""

    if retry.run(save) is None:
        if os.path.exists(part):
            os.remove(part)
        return False
    os.replace(part, path)
    return True


def cached_file(url: str, path: str, retry: Retry = Retry()) -> str:
    """`path`, fetched from `url` where it isn't there yet; OSError when it can't be had."""
    if not os.path.exists(path) and not download(url, path, retry):
        raise OSError(f"{url} could not be read")
    return path


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.filters = {k[6:]: v for k, v in options.items() if k.startswith("param.")}
        self.per_page, self.field = int(options.get("per_page", "500")), options.get("field", "results")

    def _page(self, page: int, per_page: int) -> dict:
        url = query_url(self.options["url"], **self.filters, page=page, per_page=per_page)
        body = Retry(int(self.options.get("tries", "3"))).run(lambda: fetch(url))
        if body is None:  # a partial list must not pass for a whole one
            raise OSError(f"page {page} could not be read")
        return json.loads(body)

    def total(self) -> int:
        there = int(self._page(1, 1)[self.options.get("total_field", "total_results")]) if "total" not in self.options or "most" in self.options else int(self.options["total"])
        return min(there, int(self.options.get("most", there)))

    def partitions(self) -> list[InputPartition]:
        total = self.total()
        return [InputPartition((page, min(self.per_page, total - (page - 1) * self.per_page))) for page in range(1, -(-total // self.per_page) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        page, most = partition.value
        for row in self._page(page, self.per_page)[self.field][:most]:  # a short or empty page just ends
            yield page, json.dumps(row, ensure_ascii=False)


class PagedSource(DataSource):
    """format("paged_rest"): (page INT, row STRING of JSON), a partition a page, the last one cut to the total.

    Options: url; per_page (500); field (results); tries (3); param.<name> for filters such as place, taxon, grade and rank; total, or
    else the answer's total_field (total_results) counts, up to `most` rows.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "page INT, row STRING"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(dict(self.options))


TAXON = "id STRING, rank STRING, name STRING, ancestor_ids ARRAY<STRING>"


def lookup_taxa(ids: DataFrame, key: str, url: str, size: int = 30, tries: int = 3, field: str = "results") -> DataFrame:
    """(id, rank, name, ancestor_ids) of the ids' taxa or nodes, `size` ids a request (url/1,2,...); ids the answer lacks have no row.

    A batch that can't be read is an error, not a gap. Nulls are left out, repeats asked for once.
    """
    batches = id_batches(ids, key, size)

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for own in b.column(0).to_pylist():
                body = Retry(tries).run(lambda own=own: fetch(f"{url}/{own}"))
                if body is None:
                    raise OSError(f"ids {own} could not be read")
                out += [json.dumps(r) for r in json.loads(body)[field]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["row"])

    rows = batches.select("ids").repartition(batches.sparkSession.sparkContext.defaultParallelism).mapInArrow(ask, "row string")
    return rows.select(F.from_json("row", TAXON).alias("t")).select("t.*")


@dataclass(frozen=True)
class Photos:
    """Finds and stores observation photos of one class a row; runs in tasks."""

    url: str
    root: str
    size: str = "medium"
    tries: int = 4
    delay: float = 1.0
    busy: float = 60.0
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def observations(self, taxon_id: str, n: int) -> list[dict]:
        """Up to min(3n, 50) observations; [] on an HTTP error other than "too many requests" or when tries run out."""
        address = query_url(self.url, taxon_id=taxon_id, per_page=min(3 * n, 50))
        for attempt in range(1, self.tries + 1):
            try:
                return json.loads(fetch(address)).get("results", [])
            except urllib.error.HTTPError as error:
                if error.code != 429:
                    return []
                wait = self.busy * attempt
            except (OSError, ValueError):
                wait = 2 * self.delay
            if attempt < self.tries:
                self.sleep(wait)
        return []

    def photos(self, taxon_id: str, n: int) -> list[tuple[str, str]]:
        """The first n (file name, url) of the class's observations."""
        out = []
        for o in self.observations(taxon_id, n):
            for p in o.get("photos") or []:
                if p.get("url") and len(out) < n:
                    out.append((f"{o['id']}_{p['id']}.jpg", SIZE.sub(f"/{self.size}.", p["url"])))
        return out

    def store(self, taxon_id: str, sci_name: str, n: int) -> tuple[int, int]:
        """(downloaded, skipped): photos into folder "<id>_<name>" of the shared root, those there already skipped."""
        folder = os.path.join(self.root, f"{taxon_id}_" + "".join("_" if c in RESERVED else c for c in sci_name or "").strip())
        os.makedirs(folder, exist_ok=True)
        got = skipped = 0
        for name, url in self.photos(taxon_id, n):
            path = os.path.join(folder, name)
            if os.path.exists(path):
                skipped += 1
            elif download(url, path, Retry(3, self.busy, 2 * self.delay, self.sleep)):
                got += 1
        return got, skipped


def store_photos(classes: DataFrame, how: Photos, key: str = "taxon_id", name: str = "sci_name", need: str = "need") -> DataFrame:
    """(key, name, downloaded, skipped): one outcome a row of `classes`; rows with a null key or need are left out.

    Has side effects, and a task may run twice: files are renamed into place whole, and a second run skips what is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [how.store(k, s, n) for k, s, n in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], pa.int32()) for i in (0, 1))], names=[key, name, "downloaded", "skipped"])

    rows = classes.select(F.col(key).cast("string").alias(key), F.col(name).cast("string").alias(name), F.col(need).cast("int").alias(need)).dropna(subset=[key, need])
    return rows.mapInArrow(run, f"{key} string, {name} string, downloaded int, skipped int")
