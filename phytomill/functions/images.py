"""Images: decoding to RGB, and what a vision encoder wants of them."""

from __future__ import annotations

import io
import struct
import urllib.request
import zlib

import numpy as np

# fixed values: side, mean and deviation of the public image encoder's input
SIDE = 224
MEAN = (0.48145466, 0.4578275, 0.40821073)
DEVIATION = (0.26862954, 0.26130258, 0.27577711)


def _png(data: bytes) -> np.ndarray:
    """RGB of a PNG of 8 bits a channel, not interlaced."""
    at, body, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
    if depth != 8 or interlaced or colour not in (0, 2, 3, 4, 6):
        raise ValueError("a kind of PNG that is not read here")
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(width, step), axis=0).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for x in range(len(line)):
                left, up = (line[x - step] if x >= step else 0), above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = above[x - step] if x >= step else 0
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda c: abs(p - c))
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    pixels = out.reshape(height, width, step)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if step < 3 else pixels[:, :, :3]


def decode(data: bytes | None) -> np.ndarray | None:
    """Height x width x 3 bytes, or None for what is no image; PNG is read here, other kinds where Pillow is installed."""
    if not data:
        return None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(bytes(data))
    except (ValueError, struct.error, zlib.error, UnboundLocalError, TypeError, IndexError):
        pass
    try:
        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except Exception:  # not installed, or not an image
        return None


def read(source: str) -> bytes:
    """What lies at a path or http(s) address; FileNotFoundError where nothing does."""
    if source.startswith(("http://", "https://")):
        with urllib.request.urlopen(source, timeout=30) as answer:
            return answer.read()
    with open(source, "rb") as f:
        return f.read()


def load(source: str) -> np.ndarray:
    """RGB of an image at a path or http(s) address; ValueError where it can't be decoded."""
    rgb = decode(read(source))
    if rgb is None:
        raise ValueError(f"{source} can't be decoded")
    return rgb


def _weights(old: int, new: int) -> np.ndarray:
    """new x old weights of bicubic interpolation, widened where the image shrinks."""
    scale = old / new
    wide = max(scale, 1.0)
    x = np.abs(((np.arange(new) + 0.5) * scale - 0.5)[:, None] - np.arange(old)[None, :]) / wide
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def preprocess(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """3 x side x side floats: shorter side brought to `side`, middle cut out, mean and deviation taken off."""
    height, width = rgb.shape[:2]
    by = side / min(height, width)
    tall, broad = max(side, round(height * by)), max(side, round(width * by))
    scaled = np.einsum("ab,bcd->acd", _weights(height, tall), rgb.astype(np.float64))
    scaled = np.clip(np.rint(np.einsum("ec,acd->aed", _weights(width, broad), scaled)), 0, 255)
    top, left = (tall - side) // 2, (broad - side) // 2
    cut = scaled[top : top + side, left : left + side] / 255
    return ((cut - np.array(MEAN)) / np.array(DEVIATION)).transpose(2, 0, 1).astype(np.float32)
