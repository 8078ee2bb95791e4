"""Texts without a character from U+0100 on, normalised and cut a batch at once on their UTF-8 bytes.

Such texts are stable under composition, and lower case keeps each character's length, so the training text and the
encoder's text are the same: lower case, runs of whitespace as one space, none at the ends. Everything else takes the
general path of ``functions.text``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE, WORD, OTHER, LETTER, NUMBER = range(5)
WHITESPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0]


def _word_kind(code: int) -> int:
    # Letters, decimal digits and the low line; other numbers are no word characters.
    if code in WHITESPACE:
        return SPACE
    category = unicodedata.category(chr(code))
    return WORD if category[0] == "L" or category in ("Nd", "Pc") else OTHER


def _piece_kind(code: int) -> int:
    if code in WHITESPACE:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(code))[0], OTHER)


WORD_KINDS = np.array([_word_kind(c) for c in range(256)], np.uint8)
PIECE_KINDS = np.array([_piece_kind(c) for c in range(256)], np.uint8)
_OF = {kind: "".join(chr(c) for c in range(256) if PIECE_KINDS[c] == kind) for kind in (LETTER, NUMBER)}
LATIN_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_OF[LETTER]}]+| ?[{_OF[NUMBER]}]+| ?[^ {_OF[LETTER]}{_OF[NUMBER]}]+| +")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACED = np.arange(256, dtype=np.uint8)
SPACED[0x09:0x0E] = 0x20
CAPITAL = np.zeros(256, bool)
CAPITAL[[b for b in range(0x80, 0x9F) if b != 0x97]] = True


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of some texts begins and the last one ends, and their UTF-8 bytes, one text after the other."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], raw


def apart(text: Column, specials: Sequence[str] = ()) -> Column:
    """The texts that need the general path, as they hold a character from U+0100 on or a special token; else null."""
    marks = [np.frombuffer(t.encode(), np.uint8) for t in specials]

    @F.arrow_udf(T.StringType())
    def general(texts: pa.Array) -> pa.Array:
        at, raw = flat_bytes(texts.fill_null(""))
        places = [np.flatnonzero(raw >= 0xC4)]
        for mark in marks:
            found = np.flatnonzero(raw[: max(len(raw) - len(mark) + 1, 0)] == mark[0])
            for k in range(1, len(mark)):
                found = found[raw[found + k] == mark[k]]
            places.append(found[found + len(mark) <= at[np.searchsorted(at, found, side="right")]])
        kept = np.zeros(len(texts), bool)
        kept[np.searchsorted(at, np.concatenate(places), side="right") - 1] = True
        return pc.if_else(pa.array(kept), texts, None).cast(pa.string())

    return general(text)


def _lowered(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A copy of the bytes in lower case, and where characters of two bytes begin."""
    raw = LOWER[raw] if lower else raw.copy()
    wide = np.flatnonzero(raw >= 0xC2)
    if lower:
        capital = wide[(raw[wide] == 0xC3) & CAPITAL[raw[wide + 1]]] + 1
        raw[capital] += 0x20
    return raw, wide


def _characters(raw: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The code point of each character of two bytes."""
    return (raw[wide] & 3) << 6 | raw[wide + 1] & 0x3F


def _without(gone: np.ndarray, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places = np.flatnonzero(gone)
    return (raw[~gone], at - np.searchsorted(places, at)) if len(places) else (raw, at)


def normal_bytes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the normalised texts, as ``flat_bytes`` gives them; a null counts as empty."""
    at, raw = flat_bytes(texts.fill_null(""))
    raw, wide = _lowered(raw, lower)
    blank = wide[np.isin(_characters(raw, wide), (0x85, 0xA0))]
    raw[blank], raw[blank + 1] = 0x20, 0x20
    raw = SPACED[raw]
    space = raw == 0x20
    # Of a run of spaces the first is kept, of one at the start none.
    gone = np.zeros(len(raw), bool)
    gone[1:] = space[:-1]
    gone[at[:-1][at[:-1] < len(raw)]] = True
    gone &= space
    raw, at = _without(gone, raw, at)
    last = at[1:][at[1:] > at[:-1]] - 1
    gone = np.zeros(len(raw), bool)
    gone[last[raw[last] == 0x20]] = True
    return _without(gone, raw, at)[::-1]


def words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of the texts, and where each text's begin and the last one's end; a null has none.

    Whitespace is in no pre-token, so it need not be collapsed before.
    """
    at, raw = flat_bytes(texts.fill_null(""))
    raw, wide = _lowered(raw, lower)
    kinds = WORD_KINDS[raw]
    kinds[wide] = kinds[wide + 1] = WORD_KINDS[_characters(raw, wide)]
    first = np.ones(len(raw), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    first[at[:-1][at[:-1] < len(raw)]] = True
    inside = kinds != SPACE
    starts = np.flatnonzero(first & inside)
    counts = np.searchsorted(starts, at)
    raw, first = raw[inside], first[inside]
    offsets = np.append(np.flatnonzero(first), len(raw))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)), counts


def piece_begins(raw: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a piece of the byte-level tokeniser begins at the characters at some places inside normalised texts."""
    before = places - 1
    left, right = raw[before].copy(), raw[places].copy()
    wide = left >= 0x80
    left[wide] = (raw[before[wide] - 1] & 3) << 6 | left[wide] & 0x3F
    wide = right >= 0x80
    right[wide] = (right[wide] & 3) << 6 | raw[places[wide] + 1] & 0x3F
    # A space belongs to what follows it.
    begins = (left != 0x20) & (PIECE_KINDS[left] != PIECE_KINDS[right])
    unclear = np.zeros(len(places), bool)
    for back in range(3):
        # A contraction may begin or end here.
        unclear |= raw[np.maximum(before - back, 0)] == 0x27
    held = raw.tobytes() if unclear.any() else b""
    known: dict[bytes, set[int]] = {}
    for k in np.flatnonzero(unclear & (right != 0x20)).tolist():
        place = int(places[k])
        text = int(np.searchsorted(at, place, side="right")) - 1
        # Every space begins a piece, so what stands between two is cut alone.
        start = max(held.rfind(b" ", int(at[text]), place), int(at[text]))
        end = held.find(b" ", place, int(at[text + 1]))
        part = held[start : end if end >= 0 else int(at[text + 1])]
        if part not in known:
            ends = np.cumsum([len(p.encode()) for p in LATIN_PIECE.findall(part.decode())])
            known[part] = set(ends.tolist())
        begins[k] = place - start in known[part]
    return begins
