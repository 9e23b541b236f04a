"""Held-out test passages inside a training corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructType

from phytomill.functions.plaintext import plain, words
from phytomill.runtime import lookup_join, materialize

#: Words of the items that travel to the executors at once; more items are taken in further passes over the corpus.
WORDS_AT_ONCE = 2_000_000
#: Hits a task looks at together.
HITS_AT_ONCE = 2_000_000


class PassageIndex:
    """Sorted n-grams of passages as integers; finds how much of each passage a text holds."""

    def __init__(self, passages: list[list[str]], n: int):
        self.n, self.words = n, {}
        self.exact = [np.array([self.words.setdefault(x, len(self.words) + 1) for x in w], dtype=np.uint64) for w in passages]
        self.length = np.array([len(w) for w in passages], dtype=np.int64)
        flat, starts = self._flat(self.exact)
        codes, at = self._grams(flat, starts)
        order = np.argsort(codes, kind="stable")
        self.codes, owner = codes[order], np.repeat(np.arange(len(passages)), self.length)[at[order]]
        self.owner, self.position, self.flat, self.starts = owner, at[order] - starts[owner], flat, starts

    @staticmethod
    def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All rows in one array, and where each begins."""
        size = np.array([len(r) for r in rows], dtype=np.int64)
        return (np.concatenate(rows) if rows else np.zeros(0, np.uint64)), np.cumsum(size) - size

    def _grams(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of known words that lie within one row, and where they begin."""
        m = max(0, len(flat) - self.n + 1)
        out = np.zeros(m, dtype=np.uint64)
        known = np.ones(m, dtype=bool)
        with np.errstate(over="ignore"):
            for j in range(self.n):  # a hash; hits are compared word by word
                own = flat[j : j + m]
                out = (out ^ own) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
                known &= own > 0
        for j in range(1, self.n):
            border = starts - j
            known[border[(border >= 0) & (border < m)]] = False
        at = np.nonzero(known)[0]
        return out[at], at

    def search(self, texts: list[list[str]], gap: int, share: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, passage, which of the passage's words the text reproduces, which of the text's words do so), from `share` on."""
        get = self.words.get
        flat, starts = self._flat([np.array([get(x, 0) for x in t], dtype=np.uint64) for t in texts])
        codes, at = self._grams(flat, starts)
        low, high = np.searchsorted(self.codes, codes, "left"), np.searchsorted(self.codes, codes, "right")
        hit = high > low
        at, low, many = at[hit], low[hit], (high - low)[hit]
        text = np.searchsorted(starts, at, "right") - 1
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + HITS_AT_ONCE, HITS_AT_ONCE))
        first = np.unique(np.concatenate([np.searchsorted(text, text[cuts[cuts < len(text)]]), [0, len(text)]]))  # whole texts together
        for a, z in zip(first[:-1], first[1:]):
            own = np.repeat(np.arange(a, z), many[a:z])
            h = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(many[a:z]) - many[a:z], many[a:z])
            k, passage, p = at[own], self.owner[h], self.position[h]
            same = np.ones(len(k), dtype=bool)
            for j in range(self.n):
                same &= flat[k + j] == self.flat[self.starts[passage] + p + j]
            pair = (text[own] * len(self.length) + passage)[same]
            k, p = k[same], p[same]
            order = np.lexsort((p, k, pair))
            pair, k, p = pair[order], k[order], p[order]
            edge = np.concatenate([[0], np.nonzero(np.diff(pair))[0] + 1, [len(pair)]]) if len(pair) else np.zeros(1, dtype=np.int64)
            # a hit adds its own n words and at most the gap before it
            enough = np.diff(edge) * (self.n + gap) >= share * self.length[pair[edge[:-1]] % len(self.length)] if len(pair) else []
            for i in np.nonzero(enough)[0]:
                own_pair, span = int(pair[edge[i]]), slice(edge[i], edge[i + 1])
                t, passage_ = divmod(own_pair, len(self.length))
                there, here = self._cover(k[span] - starts[t], p[span], len(texts[t]), int(self.length[passage_]), gap)
                if there.mean() >= share:
                    yield t, passage_, there, here

    def _cover(self, at: np.ndarray, position: np.ndarray, text: int, passage: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
        there, here = np.zeros(passage, dtype=bool), np.zeros(text, dtype=bool)
        last: dict[int, tuple[int, int]] = {}
        for k, p in zip(at.tolist(), position.tolist()):
            there[p : p + self.n] = here[k : k + self.n] = True
            # a run broken by a few altered, dropped or added words goes on
            for shift in (0, -1, 1, -2, 2):
                before = last.get(k - p + shift)
                if before and 0 < p - before[1] <= self.n + gap and 0 < k - before[0] <= self.n + gap + 2:
                    there[before[1] : p] = here[before[0] : k] = True
                    break
            last[k - p] = (k, p)
        return there, here


def passages(items: DataFrame, item_id: str, text: str, shared: int, n: int) -> DataFrame:
    """A written table (item, words) of the items of n words or more, without an opening sentence that `shared` items have in common."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, first, own = [], [], []
            for t in b.column(1).to_pylist():
                body = plain(t)
                head = re.match(r"\s*[^.!?]+[.!?]+\s+", body)
                before = words(body[: head.end()]) if head else []
                heads.append(" ".join(before))
                first.append(len(before))
                own.append(words(body))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, pa.string()), pa.array(first, pa.int32()), pa.array(own, pa.list_(pa.string()))], names=["item", "head", "first", "words"])

    kind = items.schema[item_id].dataType.simpleString()
    rows = materialize(items.select(item_id, text).dropna().mapInArrow(read, f"item {kind}, head string, first int, words array<string>"), "items")
    common = rows.filter("head <> ''").groupBy("head").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= shared).select("head", F.lit(True).alias("cut"))
    rows = lookup_join(rows, materialize(common, "openings"), ["head"])
    own = F.when(F.col("cut"), F.slice("words", F.col("first") + 1, F.size("words"))).otherwise(F.col("words"))
    return materialize(rows.select("item", own.alias("words")).filter(F.size("words") >= n), "passages")


def _blocks(items: DataFrame, n: int, words_at_once: int) -> Iterator[tuple[int, int, Broadcast]]:
    """(block, blocks, broadcast (index, ids by passage)): of about words_at_once words each; equal passages are in one block."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // words_at_once))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block) if blocks > 1 else items
        ids: dict[tuple[str, ...], list] = {}
        for r in own.toLocalIterator():
            ids.setdefault(tuple(r["words"]), []).append(r["item"])
        yield block, blocks, items.sparkSession.sparkContext.broadcast((PassageIndex([list(w) for w in ids], n), list(ids.values())))


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    n: int = 4, share: float = 0.5, gap: int = 3, shared: int = 3, words_at_once: int = WORDS_AT_ONCE,
) -> DataFrame:
    """(doc_id, item_id, coverage) of every document that reproduces at least `share` of an item's words.

    Items and documents are brought to folded words of plain text. A set of the items' n-grams is broadcast; every document's
    windows are looked up in it, and hits are verified: an item's words count as reproduced when n or more of them follow each
    other in the document, or lie in a gap of at most `gap` words between two such runs of the same order. An opening sentence
    common to `shared` or more items is no part of them. Items of fewer than n words can't be found.

    Defined cases: null and blank texts match nothing; repeated documents are each reported, repeated items too; whole texts
    are read; an empty table on either side gives no rows. The driver and the executors hold about words_at_once words of the
    items at a time (and one item at least); more are taken in further passes over the corpus, each written before the next.
    """
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, coverage double"
    source = docs.select(doc_id, text).dropna()
    out = None
    for _, blocks, sent in _blocks(passages(items, item_id, text, shared, n), n, words_at_once):

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, ids = sent.value
            for b in batches:
                at, found, part = [], [], []
                texts = [words(plain(t)) for t in b.column(1).to_pylist()]
                for t, k, there, _ in index.search(texts, gap, share):
                    at += [t] * len(ids[k])
                    found += ids[k]
                    part += [float(there.mean())] * len(ids[k])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, to_arrow_type(kind)), pa.array(part, pa.float64())], names=[doc_id, item_id, "coverage"])

        kind = items.schema[item_id].dataType
        part = source.mapInArrow(scan, schema)
        if blocks > 1:
            part = materialize(part, "leaks")
            sent.destroy()
        out = part if out is None else out.union(part)
    return out


def _cut(t: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The plain text without the words of the spans, and how many these are."""
    if not spans:
        return t, 0
    chunks = list(re.finditer(r"\S+", plain(t)))
    drop = {k for a, z in spans for k in range(a, z)}
    kept, k = [], 0
    for m in chunks:
        count = len(words(m[0]))
        if drop.isdisjoint(range(k, k + count)):
            kept.append(m[0])
        k += count
    return " ".join(kept), len(drop)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge > 0)[0].tolist(), np.nonzero(edge < 0)[0].tolist()))


def remove_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    whole: bool = False, n: int = 4, share: float = 0.5, gap: int = 3, shared: int = 3, words_at_once: int = WORDS_AT_ONCE,
) -> DataFrame:
    """`docs` without leaking documents (whole), or with the leaked stretches cut out of their plain text.

    Adds `removed_words` (INT). Documents that leak nothing, null and blank texts stay as they are, with 0. Items beyond
    words_at_once are taken in further passes, as in find_leaks; stretches are cut after the last.
    """
    if whole:
        leaking = materialize(find_leaks(docs, items, doc_id, item_id, text, n, share, gap, shared, words_at_once).select(doc_id).distinct(), "leaking")
        return lookup_join(docs.drop("removed_words"), leaking, [doc_id], "left_anti").withColumn("removed_words", F.lit(0))
    columns = [c for c in docs.columns if c != "removed_words"]
    schema = StructType([docs.schema[c] for c in columns]).add("removed_words", IntegerType())
    where = columns.index(text)

    def spans_of(texts: list[str | None], index: PassageIndex) -> list[list[tuple[int, int]]]:
        tokens = [[] if t is None else words(plain(t)) for t in texts]
        drop: dict[int, np.ndarray] = {}
        for t, _, _, here in index.search(tokens, gap, share):
            drop[t] = drop[t] | here if t in drop else here
        return [_runs(drop[t]) if t in drop else [] for t in range(len(texts))]

    def without(b: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        done = [(None, 0) if t is None else _cut(t, s) for t, s in zip(b.column(where).to_pylist(), spans)]
        arrays = [pa.array([x[0] for x in done], pa.string()) if k == where else b.column(k) for k in range(len(columns))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([x[1] for x in done], pa.int32())], names=[*columns, "removed_words"])

    rows, hits = docs.select(*columns), None
    for _, blocks, sent in _blocks(passages(items, item_id, text, shared, n), n, words_at_once):
        if blocks == 1:

            def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield without(b, spans_of(b.column(where).to_pylist(), sent.value[0]))

            return rows.mapInArrow(scan, schema)
        if hits is None:
            rows = materialize(rows.withColumn("_pm_row", F.monotonically_increasing_id()), "rows")

        def mark(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans = spans_of(b.column(1).to_pylist(), sent.value[0])
                at = [k for k, s in enumerate(spans) if s]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([[x for pair in spans[k] for x in pair] for k in at], pa.list_(pa.int64()))], names=["_pm_row", "s"])

        part = materialize(rows.select("_pm_row", text).mapInArrow(mark, "_pm_row bigint, s array<bigint>"), "spans")
        sent.destroy()
        hits = part if hits is None else hits.union(part)
    hits = materialize(hits.groupBy("_pm_row").agg(F.flatten(F.collect_list("s")).alias("_pm_spans")), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield without(b, [list(zip(s[::2], s[1::2])) if s else [] for s in b.column(len(columns)).to_pylist()])

    return lookup_join(rows, hits, ["_pm_row"]).select(*columns, "_pm_spans").mapInArrow(cut, schema)
