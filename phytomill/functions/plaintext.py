"""Plain text out of marked-up, damaged or oddly typed text; runs inside Arrow functions."""

from __future__ import annotations

import html
import re
import unicodedata

# UTF-8 read as Windows-1252: a lead byte's letter, then letters of continuation bytes
_LATER = "[\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]"
_DAMAGED = re.compile(f"[Â-ß]{_LATER}|[à-ï]{_LATER}{{2}}|[ð-ô]{_LATER}{{3}}")
_TAG = re.compile(r"<(?:/?[a-zA-Z!][^<>]*|/)>")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_ACCENT = re.compile(f"[{''.join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.combining(c))}]+")


def _mend(m: re.Match) -> str:
    raw = bytearray()
    for ch in m[0]:
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            raw.append(ord(ch))  # a C1 control, kept as its byte
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def plain(text: str) -> str:
    """Undo damaged encoding, entities, tags, compatibility forms, invisible characters and hyphens at line ends."""
    if not text.isascii():
        text = _DAMAGED.sub(_mend, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _HYPHEN.sub("", text) if "-" in text else text


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.casefold()
    if text.isascii():
        return text
    return _ACCENT.sub("", unicodedata.normalize("NFKD", text))


def words(text: str) -> list[str]:
    """The words and numbers of plain text, folded."""
    return _WORD.findall(fold(text))
