"""Encoders of texts and images as vectorised functions; a hashing stand-in where no model is at hand."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phytomill.functions import images


class Encoder(Protocol):
    """Brings a batch to vectors; None for what can't be decoded."""

    def encode(self, batch: Sequence[str | bytes]) -> list[list[float] | None]: ...


class HashEncoder:
    """Deterministic unit vectors: sums of hashed word (or byte) features."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def _vector(self, item: str | bytes) -> list[float] | None:
        parts = [item[i : i + 8] for i in range(0, len(item), 8)] if isinstance(item, bytes) else [w.encode() for w in item.lower().split()]
        if not parts:
            return None
        v = np.zeros(self.dims)
        for p in parts:
            seed = int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little")
            v += np.random.default_rng(seed).normal(size=self.dims)
        return (v / np.linalg.norm(v)).tolist()

    def encode(self, batch: Sequence[str | bytes]) -> list[list[float] | None]:
        return [self._vector(x) for x in batch]


class PixelEncoder:
    """A stand-in image encoder on decoded pixels: means of a grid of the preprocessed image; None for what is no image."""

    def __init__(self, grid: int = 4):
        self.grid = grid

    def encode(self, batch: Sequence[bytes]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for item in batch:
            rgb = images.decode(item)
            if rgb is None:
                out.append(None)
                continue
            cells = images.preprocess(rgb).reshape(3, self.grid, images.SIDE // self.grid, self.grid, images.SIDE // self.grid).mean(axis=(2, 4)).ravel()
            length = float(np.linalg.norm(cells))
            out.append((cells / length).tolist() if length else None)
        return out


def resolve(candidates: Sequence[str], fetch: Callable[[], str] | None = None, least: int = 1) -> str:
    """The first file of at least `least` bytes, so no stub of one; else what `fetch` brings; FileNotFoundError without either."""
    for path in candidates:
        if os.path.isfile(path) and os.path.getsize(path) >= least:
            return path
    if fetch is None:
        raise FileNotFoundError(f"no model at any of: {', '.join(candidates)}")
    return fetch()


def token_ids(text: str, encode: Callable[[str], list[int]], first: int, last: int, length: int = 77) -> list[int]:
    """Exactly `length` token ids of lower-cased text in single spaces: first, the text's (cut off), last, then zeros."""
    own = encode(" ".join(text.lower().split()))[: length - 2]
    return [first, *own, last, *[0] * (length - 2 - len(own))]


def encode_column(c: Column, make: Callable[[], Encoder] = HashEncoder, batch: int = 256) -> Column:
    """Unit vectors of a text or binary column; the encoder is made once a task; null, blank and undecodable give null."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for s in series:
            out: list = [None] * len(s)
            at = [i for i, x in enumerate(s) if x is not None and len(x)]
            for a in range(0, len(at), batch):
                part = at[a : a + batch]
                for i, v in zip(part, encoder.encode([bytes(s.iloc[i]) if isinstance(s.iloc[i], (bytes, bytearray)) else s.iloc[i] for i in part])):
                    out[i] = v
            yield pd.Series(out)

    return run(c)
