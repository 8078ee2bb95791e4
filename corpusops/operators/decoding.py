"""Text of token ids by the decoder of a tokenizer file.

A decoder is a chain of steps, each from a list of token strings to another; what the last one leaves is
joined. Steps are set up once per task from the file's own node.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.contracts import DatasetError
from corpusops.operators.tokenizer import TokenizerModel, byte_characters

Step = Callable[[list[str]], list[str]]

# What English clean-up replaces, in this order.
CLEANED = [
    (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"),
    (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"),
]
BYTE_TOKEN = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def decode(rows: DataFrame, model: TokenizerModel, ids: str = "input_ids", name: str = "text", skip_special: bool = True) -> DataFrame:
    """Add the text of a column of token ids, by the model's decoder.

    Ids without a token and null ids are left out, and special tokens as well unless ``skip_special``
    is off. A null list gives null, an empty one the empty text. Without a decoder tokens are joined by a space. Bytes that
    are no valid UTF-8 become U+FFFD. Nothing is shuffled; the broadcast table is the vocabulary.
    """
    decoder_step(model.decoder_node)  # refuse before anything runs
    by_place = _by_place(model.decoder_node)
    left_out = set(model.specials) if skip_special else set()
    tokens = [None if t in left_out else t for t in model.tokens]
    shared = rows.sparkSession.sparkContext.broadcast((tokens, model.decoder_node))
    tables: list[pa.Array | np.ndarray] = []

    @F.arrow_udf(T.StringType())
    def decoded(lists: pa.Array) -> pa.Array:
        known, node = shared.value
        step = decoder_step(node)
        if by_place:
            if not tables:
                tables.extend(_spellings(known, node))
            return _joined(lists, *tables)
        texts = []
        for numbers in lists.to_pylist():
            if numbers is None:
                texts.append(None)
                continue
            found = [known[n] for n in numbers if n is not None and 0 <= n < len(known)]
            texts.append((" " if node is None else "").join(step([t for t in found if t is not None])))
        return pa.array(texts, pa.string())

    return rows.withColumn(name, decoded(F.col(f"`{ids}`")))


def _by_place(node: dict[str, Any] | None) -> bool:
    """Whether a token's text depends only on whether it is the first of its row."""
    return node is None or node["type"] in ("WordPiece", "Metaspace")


def _spellings(known: list[str | None], node: dict[str, Any] | None) -> tuple[pa.Array, np.ndarray]:
    """Texts of all tokens behind others, then of all at the start of a row; which of them are tokens."""
    step = decoder_step(node)
    tokens = [t or "" for t in known]
    first = [step([t])[0] for t in tokens]
    later = [" " + t for t in tokens] if node is None else [step(["", t])[1] for t in tokens]
    return pa.array(later + first, pa.large_string()), np.array([t is not None for t in known], dtype=bool)


def _joined(lists: pa.Array, spelled: pa.Array, held: np.ndarray) -> pa.Array:
    """The texts of lists of ids, put together for a whole batch at once."""
    flat = lists.flatten()
    ids = flat.fill_null(-1).to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    kept = (ids >= 0) & (ids < len(held))
    kept[kept] = held[ids[kept]]
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    ends = ends - np.searchsorted(np.flatnonzero(~kept), ends)
    ids = ids[kept].astype(np.int64)
    ids[ends[:-1][ends[1:] > ends[:-1]]] += len(held)
    # Each row's text is a stretch of the bytes of all tokens.
    texts = spelled.take(pa.array(ids))
    at = np.frombuffer(texts.buffers()[1], np.int64)[ends] if len(ids) else np.zeros(len(ends), np.int64)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    whole = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(at.tobytes()), texts.buffers()[2] or pa.py_buffer(b""))
    return pc.if_else(pa.array(valid), whole, pa.scalar(None, pa.large_string())).cast(pa.string())


def decoder_step(node: dict[str, Any] | None) -> Step:
    if node is None:
        return lambda tokens: tokens
    kind = node["type"]
    if kind not in _STEPS:
        raise DatasetError(f"cannot decode with '{kind}'")
    return _STEPS[kind](node)


def _sequence(node: dict[str, Any]) -> Step:
    steps = [decoder_step(inner) for inner in node["decoders"]]

    def run(tokens: list[str]) -> list[str]:
        for step in steps:
            tokens = step(tokens)
        return tokens

    return run


def _byte_level(node: dict[str, Any]) -> Step:
    value = {c: b for b, c in enumerate(byte_characters())}

    def run(tokens: list[str]) -> list[str]:
        raw = bytearray()
        for token in tokens:
            plain = all(c in value for c in token)
            raw += bytes(value[c] for c in token) if plain else token.encode("utf-8")
        return [raw.decode("utf-8", "replace")]

    return run


def _word_piece(node: dict[str, Any]) -> Step:
    prefix, cleanup = node.get("prefix", "##"), node.get("cleanup", True)

    def run(tokens: list[str]) -> list[str]:
        out = []
        for i, token in enumerate(tokens):
            if i:
                token = token[len(prefix) :] if token.startswith(prefix) else " " + token
            if cleanup:
                for old, new in CLEANED:
                    token = token.replace(old, new)
            out.append(token)
        return out

    return run


def _metaspace(node: dict[str, Any]) -> Step:
    mark = node.get("replacement", "▁")
    prepended = node.get("prepend_scheme", "always" if node.get("add_prefix_space", True) else "never") != "never"

    def run(tokens: list[str]) -> list[str]:
        first = [t.replace(mark, "" if prepended else " ") for t in tokens[:1]]
        return first + [t.replace(mark, " ") for t in tokens[1:]]

    return run


def _byte_fallback(node: dict[str, Any]) -> Step:
    def run(tokens: list[str]) -> list[str]:
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            # A run that is no valid text gives one replacement character a byte.
            try:
                out.extend([held.decode("utf-8")] if held else [])
            except UnicodeDecodeError:
                out.extend(["�"] * len(held))
            held.clear()

        for token in tokens:
            byte = BYTE_TOKEN.fullmatch(token)
            if byte:
                held.append(int(byte[1], 16))
            else:
                flush()
                out.append(token)
        flush()
        return out

    return run


def _replace(node: dict[str, Any]) -> Step:
    pattern = node["pattern"]
    if "String" not in pattern:
        raise DatasetError("cannot decode with a Replace step by a regular expression")
    return lambda tokens: [t.replace(pattern["String"], node["content"]) for t in tokens]


def _strip(node: dict[str, Any]) -> Step:
    content, start, stop = node["content"], node["start"], node["stop"]

    def stripped(token: str) -> str:
        low, high = 0, len(token)
        while low < min(start, len(token)) and token[low] == content:
            low += 1
        while high > max(low, len(token) - stop) and token[high - 1] == content:
            high -= 1
        return token[low:high]

    return lambda tokens: [stripped(t) for t in tokens]


def _word_end(node: dict[str, Any]) -> Step:
    suffix = node.get("suffix", "</w>")
    return lambda tokens: [t.replace(suffix, "" if i == len(tokens) - 1 else " ") for i, t in enumerate(tokens)]


_STEPS: dict[str, Callable[[dict[str, Any]], Step]] = {
    "Sequence": _sequence,
    "ByteLevel": _byte_level,
    "WordPiece": _word_piece,
    "Metaspace": _metaspace,
    "ByteFallback": _byte_fallback,
    "Fuse": lambda node: lambda tokens: ["".join(tokens)],
    "Replace": _replace,
    "Strip": _strip,
    "BPEDecoder": _word_end,
}
