"""A trained tokenizer: vocabulary, its JSON form, and encoding of whole corpora."""

from __future__ import annotations

import heapq
import itertools
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.contracts import DatasetError
from corpusops.functions import latin
from corpusops.functions.latin import flat_bytes
from corpusops.functions.text import (
    ALGORITHMS,
    FEW_SPECIALS,
    IMPORTED,
    NORMS,
    PUNCT_POLICIES,
    SPECIAL_TOKENS,
    byte_pieces,
    check_text_options,
    clean_parts,
    cut_specials,
    holds_special,
    marked_pieces,
    normalize_both,
    normalize_encoding,
    normalize_parts,
    pretokenize,
    single_punct_pieces,
    unbroken_pieces,
)
from corpusops.operators.vocab import add_missing_specials
from corpusops.operators.wordpiece import PieceOptions, piece_segmenter, word_segmenter

UNKNOWN_PENALTY = 10.0
WORD_CACHE = 200_000
CACHED_LENGTH = 256  # longer words are segmented anew, so the cache stays small
MOST_ID = 20_000_000  # of an imported vocabulary


@dataclass(frozen=True)
class TokenizerConfig:
    algo: str
    vocab_size: int
    norm: str = "nfc"
    lower: bool = True
    punct_policy: str = "keep"
    seed: int = 13

    def __post_init__(self):
        if self.algo not in (*ALGORITHMS, *IMPORTED):
            raise DatasetError(f"unknown algorithm '{self.algo}', expected one of {list(ALGORITHMS)}")
        check_text_options(self.norm, self.punct_policy)
        if self.vocab_size <= len(SPECIAL_TOKENS):
            raise DatasetError("no room for anything but special tokens in a vocabulary of this size")

    @property
    def tokenizer_id(self) -> str:
        lower = "lower" if self.lower else "nolower"
        return f"{self.algo}-{self.vocab_size}-{self.norm}-{lower}-{self.punct_policy}-s{self.seed}"

    def manifest_fragment(self) -> dict[str, Any]:
        return {
            "algo": self.algo,
            "vocab_size": self.vocab_size,
            "normalizer": {"nfc": self.norm == "nfc", "lower": self.lower, "punct_policy": self.punct_policy},
            "seed": self.seed,
            "special_tokens": list(SPECIAL_TOKENS),
        }

    @property
    def keeps_latin(self) -> bool:
        """Whether texts of ``functions.latin`` are normalised as it does."""
        return self.punct_policy == "keep" and (self.lower or self.norm != "none")

    def latin_apart(self, text: Column) -> Column | None:
        """The texts that ``functions.latin`` does not normalise, if it does any."""
        return latin.apart(text) if self.keeps_latin else None

    def training_text(self, text: Column) -> Column:
        return normalize_both(text, self.norm, self.lower, self.punct_policy)

    def encoding_text(self, text: Column) -> Column:
        return normalize_encoding(text, self.norm, self.lower, self.punct_policy)


def byte_characters() -> list[str]:
    """The printable stand-in of each byte value: itself where printable, else the next free one
    from U+0100 on. Public convention of byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [], 0
    for value in range(256):
        if value in printable:
            table.append(chr(value))
        else:
            table.append(chr(0x100 + extra))
            extra += 1
    return table


BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


@dataclass(frozen=True)
class TokenizerModel:
    config: TokenizerConfig
    # A token's id is its place; a file may leave places empty.
    tokens: list[str | None]
    scores: list[float] = field(default_factory=list)
    merges: list[tuple[str, str]] = field(default_factory=list)
    byte_level: bool = False
    unknown: str | None = "<unk>"
    fuse_unk: bool = False
    specials: tuple[str, ...] = SPECIAL_TOKENS
    # What files of other kinds say: nodes of the exchange layout, kept as they are.
    model_type: str | None = None
    pieces: PieceOptions = PieceOptions()
    byte_fallback: bool = False
    splitter: dict[str, Any] | None = None
    cleaner: dict[str, Any] | None = None
    decoder: dict[str, Any] | None | str = "own"

    @property
    def kind(self) -> str:
        if self.model_type is not None:
            return self.model_type
        return "BPE" if self.merges or not self.scores else "Unigram"

    @property
    def ids(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens) if t is not None}

    @property
    def unk_id(self) -> int:
        return self.ids["<unk>"]

    def special_ids(self) -> dict[str, int]:
        ids = self.ids
        return {t: ids[t] for t in SPECIAL_TOKENS}

    def byte_ids(self) -> dict[str, int]:
        """Id by byte value in hex, for byte-level vocabularies."""
        ids = self.ids
        return {f"{b:02X}": ids[c] for b, c in enumerate(byte_characters()) if c in ids}

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        scores = self.scores or [None] * len(self.tokens)
        return spark.createDataFrame(
            [(t, i, s) for i, (t, s) in enumerate(zip(self.tokens, scores)) if t is not None], "token string, id long, score double"
        )

    def merge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.merges)], "rank long, left string, right string")

    @property
    def decoder_node(self) -> dict[str, Any] | None:
        """The decoder of the file, or that of the engine's own models."""
        if self.decoder == "own":
            return BYTE_LEVEL if self.byte_level else None
        return self.decoder

    def to_json(self) -> dict[str, Any]:
        """The common exchange layout of tokenizer files."""
        steps = normalizer_steps(self.config.norm, self.config.lower, self.config.punct_policy)
        ids = self.special_ids()
        level = BYTE_LEVEL
        piece = {"Sequence": {"id": "A", "type_id": 0}}
        other = {"Sequence": {"id": "B", "type_id": 0}}
        mark = {t: {"SpecialToken": {"id": t, "type_id": 0}} for t in SPECIAL_TOKENS}
        if self.kind == "BPE":
            model: dict[str, Any] = {
                "type": "BPE", "dropout": None, "unk_token": self.unknown, "continuing_subword_prefix": None,
                "end_of_word_suffix": None, "fuse_unk": self.fuse_unk, "byte_fallback": False, "ignore_merges": False,
                "vocab": self.ids, "merges": [list(m) for m in self.merges],
            }
        elif self.kind == "WordLevel":
            model = {"type": "WordLevel", "vocab": self.ids, "unk_token": self.unknown}
        elif self.kind == "WordPiece":
            model = {
                "type": "WordPiece", "unk_token": self.unknown, "continuing_subword_prefix": self.pieces.prefix,
                "max_input_chars_per_word": self.pieces.most_characters, "vocab": self.ids,
            }
        else:
            model = {
                "type": "Unigram", "unk_id": self.ids[self.unknown], "byte_fallback": self.byte_fallback,
                "vocab": [[t, s] for t, s in zip(self.tokens, self.scores)],
            }
        return {
            "version": "1.0",
            "truncation": None,
            "padding": {
                "strategy": "BatchLongest", "direction": "Right", "pad_to_multiple_of": None,
                "pad_id": ids["<pad>"], "pad_type_id": 0, "pad_token": "<pad>",
            },
            "added_tokens": [
                {"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
                for t, i in self.ids.items()
                if t in self.specials
            ],
            "normalizer": self.cleaner or ({"type": "Sequence", "normalizers": steps} if steps else None),
            "pre_tokenizer": level if self.byte_level else self.splitter or {"type": "Whitespace"},
            "post_processor": {
                "type": "TemplateProcessing",
                "single": [mark["<bos>"], piece, mark["<eos>"]],
                "pair": [mark["<bos>"], piece, mark["<sep>"], other, mark["<eos>"]],
                "special_tokens": {t: {"id": t, "ids": [ids[t]], "tokens": [t]} for t in ("<bos>", "<eos>", "<sep>")},
            },
            "decoder": self.decoder_node,
            "model": model,
        }

    @classmethod
    def from_json(cls, document: dict[str, Any], seed: int = 13) -> TokenizerModel:
        """Import a tokenizer file with the ids it has; special tokens it lacks are appended.

        Whatever this engine would encode differently from the file is refused.
        """
        model = document["model"]
        kind = model.get("type") or ("BPE" if "merges" in model else "Unigram")
        scores: list[float] = []
        merges: list[tuple[str, str]] = []
        if kind == "BPE":
            _refuse(model, "model", dropout=None, continuing_subword_prefix=None, end_of_word_suffix=None, byte_fallback=False, ignore_merges=False)
            tokens = _by_id(model["vocab"].items())
            merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            unknown, fuse = model.get("unk_token"), bool(model.get("fuse_unk"))
            if unknown is not None and unknown not in model["vocab"]:
                raise DatasetError(f"the unknown token '{unknown}' is not in the vocabulary")
        elif kind == "Unigram":
            tokens = [t for t, _ in model["vocab"]]
            scores = [float(s) for _, s in model["vocab"]]
            if model.get("unk_id") is None:
                raise DatasetError("cannot import a Unigram model without an unknown token")
            unknown, fuse = tokens[model["unk_id"]], True
        elif kind in ("WordLevel", "WordPiece") and "merges" not in model:
            tokens = _by_id(model["vocab"].items())
            unknown, fuse = model.get("unk_token"), False
            if unknown not in model["vocab"]:
                raise DatasetError(f"the unknown token '{unknown}' is not in the vocabulary")
        else:
            raise DatasetError(f"cannot import a tokenizer of type '{kind}'")
        added = document.get("added_tokens") or []
        for token in added:
            _refuse(token, f"added token '{token['content']}'", single_word=False, lstrip=False, rstrip=False, normalized=False)
            tokens = _placed(tokens, token["content"], token["id"])
        specials = tuple(dict.fromkeys([*(t["content"] for t in added), *SPECIAL_TOKENS]))
        tokens = add_missing_specials(tokens)
        scores = scores + [0.0] * (len(tokens) - len(scores)) if scores else scores
        normalizer = document.get("normalizer")
        cleaner = normalizer if normalizer is not None and normalizer["type"] == "BertNormalizer" else None
        norm, lower, policy = _read_normalizer(None if cleaner else normalizer)
        pre = document.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel"
        if byte_level or pre.get("type") == "Whitespace":
            _refuse(pre, "pre-tokenizer", add_prefix_space=False, use_regex=True)
        elif pre.get("type") == "Metaspace" and kind == "Unigram":
            _refuse(pre, "pre-tokenizer", replacement="\u2581")
        elif pre.get("type") not in ("BertPreTokenizer", "WhitespaceSplit"):
            raise DatasetError(f"cannot import pre-tokenizer '{pre.get('type')}' for a model of type '{kind}'")
        algo = {"BPE": "bpe", "Unigram": "char" if byte_level else "unigram"}.get(kind, kind.lower())
        config = TokenizerConfig(algo, len(tokens), norm, lower, policy, seed)
        return cls(
            config, tokens, scores, merges, byte_level, unknown, fuse, specials,
            model_type=kind,
            pieces=PieceOptions(model.get("continuing_subword_prefix") or "##", model.get("max_input_chars_per_word", 100)),
            byte_fallback=bool(model.get("byte_fallback")),
            splitter=None if byte_level or pre["type"] == "Whitespace" else pre,
            cleaner=cleaner,
            decoder=document.get("decoder"),
        )

    def parts(self) -> tuple[Any, ...]:
        """The model as plain values, to be broadcast."""
        return (
            self.kind, self.tokens, self.scores, self.merges, self.byte_level, self.unknown, self.fuse_unk, self.specials,
            self.pieces, self.byte_fallback,
        )

    def word_lists(self, text: Column, first: Column) -> Column:
        """Pre-tokens of a normalised text; ``first`` tells whether the text begins there."""
        kind = "ByteLevel" if self.byte_level else (self.splitter or {}).get("type", "Whitespace")
        if kind == "Metaspace":
            scheme = self.splitter.get("prepend_scheme", "always" if self.splitter.get("add_prefix_space", True) else "never")
            prepend = first if scheme == "first" else F.lit(scheme == "always")
            return marked_pieces(text, prepend, self.splitter.get("split", True))
        cut = {"ByteLevel": byte_pieces, "Whitespace": pretokenize, "BertPreTokenizer": single_punct_pieces, "WhitespaceSplit": unbroken_pieces}
        return cut[kind](text)

    def latin_apart(self, text: Column) -> Column | None:
        """The texts that need more than ``functions.latin``, special tokens among them, if any need no more."""
        known = _is_bytewise(self) if self.byte_level else self.splitter is None or self.splitter.get("type") == "Whitespace"
        plain = known and self.cleaner is None and self.config.keeps_latin and len(self.specials) <= FEW_SPECIALS
        return latin.apart(text, self.specials) if plain else None

    def normal_parts(self, parts: Column) -> Column:
        """Each part of a cut text as the encoder normalises it."""
        if self.cleaner is None:
            return normalize_parts(parts, self.config.norm, self.config.lower, self.config.punct_policy, self.specials)
        lower = self.cleaner.get("lowercase", True)
        strip = self.cleaner.get("strip_accents")
        return clean_parts(
            parts,
            self.cleaner.get("clean_text", True),
            self.cleaner.get("handle_chinese_chars", True),
            lower if strip is None else strip,
            lower,
            self.specials,
        )

    def normal_text(self, text: Column) -> Column:
        """A text without special tokens as the encoder normalises it."""
        if self.cleaner is None:
            return self.config.encoding_text(text)
        return F.get(self.normal_parts(F.when(text.isNotNull(), F.array(text))), F.lit(0))


def segmenter(
    kind: str,
    tokens: list[str | None],
    scores: list[float],
    merges: list[tuple[str, str]],
    byte_level: bool,
    unknown: str | None = "<unk>",
    fuse_unk: bool = False,
    specials: tuple[str, ...] = SPECIAL_TOKENS,
    pieces: PieceOptions = PieceOptions(),
    byte_fallback: bool = False,
) -> Callable[[str], list[int]]:
    """Segmentation of one pre-token into ids. Called once per distinct word of a batch.

    A special token is a word of its own; no pre-token of ordinary text can be spelled like one.
    """
    ids = {t: i for i, t in enumerate(tokens) if t is not None}
    if kind == "BPE":
        core = _bpe_segmenter(tokens, merges, unknown, fuse_unk)
    elif kind == "WordLevel":
        core = word_segmenter(ids, unknown)
    elif kind == "WordPiece":
        core = piece_segmenter(ids, unknown, pieces)
    else:
        core = _unigram_segmenter(tokens, scores, unknown, byte_fallback)
    whole = {t: [i] for i, t in enumerate(tokens) if t in specials}
    table = byte_characters()

    def segment(word: str) -> list[int]:
        if word in whole:
            return whole[word]
        return core("".join(table[b] for b in word.encode("utf-8"))) if byte_level else core(word)

    return segment


def _refuse(node: dict[str, Any], what: str, **expected: Any) -> None:
    """Raise unless each setting that is given has the value this engine implements."""
    for name, value in expected.items():
        if node.get(name, value) not in (value, *((None, "", False) if not value else ())):
            raise DatasetError(f"cannot import {what} with {name} = {node[name]!r}")


def _by_id(entries) -> list[str | None]:
    """Tokens at the place of their id; a place without a token holds None."""
    tokens: list[str | None] = []
    for token, number in sorted(entries, key=lambda e: e[1]):
        tokens = _placed(tokens, token, number)
    return tokens


def _placed(tokens: list[str | None], token: str, number: int) -> list[str | None]:
    if number > MOST_ID:
        raise DatasetError(f"token ids must not exceed {MOST_ID}")
    tokens += [None] * (number + 1 - len(tokens))
    if tokens[number] not in (None, token):
        raise DatasetError(f"id {number} stands for '{tokens[number]}' and for '{token}'")
    tokens[number] = token
    return tokens


def normalizer_steps(norm: str, lower: bool, punct_policy: str) -> list[dict[str, Any]]:
    """The encoder's normaliser in the exchange layout."""
    steps: list[dict[str, Any]] = []
    if norm == "nfc":
        steps.append({"type": "NFC"})
    if lower:
        steps.append({"type": "Lowercase"})
    if punct_policy != "keep":
        content = " " if punct_policy == "space" else ""
        steps.append({"type": "Replace", "pattern": {"Regex": r"\p{P}+"}, "content": content})
    if steps:
        steps.append({"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
        steps.append({"type": "Strip", "strip_left": True, "strip_right": True})
    return steps


def _read_normalizer(node: dict[str, Any] | None) -> tuple[str, bool, str]:
    """The options that make exactly these steps."""
    steps = [] if node is None else node["normalizers"] if node["type"] == "Sequence" else [node]
    for norm, lower, policy in itertools.product(NORMS, (False, True), PUNCT_POLICIES):
        if normalizer_steps(norm, lower, policy) == steps:
            return norm, lower, policy
    raise DatasetError(f"cannot import normaliser {[step.get('type') for step in steps]}")


def _bpe_segmenter(
    tokens: list[str | None], merges: list[tuple[str, str]], unknown: str | None, fuse_unk: bool
) -> Callable[[str], list[int]]:
    ids = {t: i for i, t in enumerate(tokens) if t is not None}
    unk = None if unknown is None else ids[unknown]
    ranks = {pair: i for i, pair in enumerate(merges)}

    def segment(word: str) -> list[int]:
        # Merges by rank, then from the left; a heap keeps very long words affordable.
        parts: list[str | None] = list(word)
        size = len(parts)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        waiting = [
            (ranks[pair], i, pair) for i, pair in enumerate(zip(word, word[1:])) if pair in ranks
        ]
        heapq.heapify(waiting)
        while waiting:
            _, i, (left, right) = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != left or j >= size or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < size and (parts[a], parts[b]) in ranks:
                    heapq.heappush(waiting, (ranks[parts[a], parts[b]], a, (parts[a], parts[b])))
        found = [ids.get(p, unk) for p in parts if p is not None]
        # Without an unknown token what is unknown leaves nothing.
        return [t for i, t in enumerate(found) if t is not None and not (fuse_unk and t == unk and i and found[i - 1] == unk)]

    return segment


def _unigram_segmenter(
    tokens: list[str], scores: list[float], unknown_token: str, byte_fallback: bool = False
) -> Callable[[str], list[int]]:
    ids = {t: i for i, t in enumerate(tokens)}
    unk = ids[unknown_token]
    score = {t: s for t, s in zip(tokens, scores) if t not in SPECIAL_TOKENS}
    longest = max((len(t) for t in score), default=1)
    unknown = min(scores, default=0.0) - UNKNOWN_PENALTY

    def segment(word: str) -> list[int]:
        size = len(word)
        value = [0.0] + [-math.inf] * size
        back = [(0, unk)] * (size + 1)
        for i in range(size):
            for j in range(i + 1, min(i + longest, size) + 1):
                gain = score.get(word[i:j])
                if gain is not None and value[i] + gain > value[j]:
                    value[j], back[j] = value[i] + gain, (i, ids[word[i:j]])
            if word[i] not in score and value[i] + unknown > value[i + 1]:
                value[i + 1], back[i + 1] = value[i] + unknown, (i, unk)
        path: list[int] = []
        node = size
        while node > 0:
            end = node
            node, token = back[node]
            # A run of unknown characters counts as one unknown token, or as its bytes if all are known.
            if token == unk:
                while node > 0 and back[node][1] == unk:
                    node = back[node][0]
                spelled = [ids.get(f"<0x{b:02X}>") for b in word[node:end].encode("utf-8")] if byte_fallback else [None]
                path += [unk] if None in spelled else spelled[::-1]
            else:
                path.append(token)
        return path[::-1]

    return segment


def encode_words(words: Column, model: TokenizerModel, spark: SparkSession, simple: Column | None = None) -> Column:
    """Token ids of a list of pre-tokens, or of the pre-tokens of ``simple`` where that is not null.

    Runs where the text is read: nothing is shuffled. Each batch segments its distinct words once
    (a bounded cache carries them across batches) and lays out all ids by array arithmetic. The
    broadcast vocabulary is bounded by its size setting.
    """
    if simple is None and _is_bytewise(model):
        return encode_bytes(words, model)
    shared = spark.sparkContext.broadcast(model.parts())
    lower = model.config.lower
    cache: dict[str, list[int]] = {}
    state: list[Callable[[str], list[int]]] = []

    def segmented(flat: pa.Array, at: np.ndarray) -> pa.Array:
        """Ids of words as lists, one for the words from each place of ``at`` to the next."""
        if not state:
            state.append(segmenter(*shared.value))
        if len(cache) > WORD_CACHE:
            cache.clear()
        coded = flat.dictionary_encode()
        parts = []
        for word in coded.dictionary.to_pylist():
            found = cache.get(word)
            if found is None:
                found = state[0](word)
                if len(word) <= CACHED_LENGTH:
                    cache[word] = found
            parts.append(found)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        pool = np.fromiter(itertools.chain.from_iterable(parts), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        use = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = sizes[use] if len(use) else np.zeros(0, dtype=np.int64)
        ends = np.append(0, np.cumsum(counts))
        take = np.repeat(starts[use] - ends[:-1], counts) + np.arange(ends[-1]) if len(use) else np.zeros(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), pa.array(pool[take], pa.int32()))

    def of_lists(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.string()))
        rows = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return segmented(lists.flatten(), np.append(0, np.cumsum(rows)))

    if simple is None:

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encoded(lists: pa.Array) -> pa.Array:
            return of_lists(lists)

        return encoded(words)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded_either(texts: pa.Array, lists: pa.Array) -> pa.Array:
        found = segmented(*latin.words(texts, lower))
        return pc.if_else(texts.is_valid(), found, of_lists(lists)) if texts.null_count else found

    return encoded_either(simple, words)


def _is_bytewise(model: TokenizerModel) -> bool:
    """Whether each byte of a pre-token is a token of its own."""
    own = [(t, s) for t, s in zip(model.tokens, model.scores) if t not in SPECIAL_TOKENS]
    return model.kind == "Unigram" and model.byte_level and all(t is not None and len(t) == 1 and math.isfinite(s) for t, s in own)


def encode_bytes(words: Column, model: TokenizerModel) -> Column:
    """Token ids of a list of pre-tokens by a vocabulary of single bytes, looked up a whole batch at once.

    Unknown bytes next to each other in a pre-token count as one token.
    """
    table, unk = _byte_table(model)
    whole = {t: i for t, i in model.ids.items() if t in model.specials}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.string()))
        flat = lists.flatten()
        # Where words begin, then where rows do.
        at, raw = flat_bytes(flat)
        coded = table[raw]
        dropped = _follows(coded == unk, at)
        special = pc.index_in(flat, value_set=pa.array(list(whole), pa.string()))
        for k in np.flatnonzero(special.is_valid().to_numpy(zero_copy_only=False)).tolist():
            dropped[at[k] + 1 : at[k + 1]] = True
            coded[at[k]] = whole[flat[k].as_py()]
        rows = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return _id_lists(coded, dropped, at[np.append(0, np.cumsum(rows, dtype=np.int64))])

    return encoded(words)


def encode_whole(text: Column, model: TokenizerModel) -> Column:
    """The same for normalised texts that hold no special token, without cutting them into pre-tokens.

    Where a pre-token ends matters only between unknown bytes of two characters; a text with such a place gives null.
    """
    table, unk = _byte_table(model)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        ends, raw = flat_bytes(texts.fill_null(""))
        coded = table[raw]
        dropped = _follows(coded == unk, ends)
        meet = np.flatnonzero(dropped & ((raw & 0xC0) != 0x80))
        left = texts.is_null().to_numpy(zero_copy_only=False).copy()
        left[np.searchsorted(ends, meet, side="right") - 1] = True
        return _id_lists(coded, dropped, ends, left)

    return encoded(text)


def encode_latin(text: Column, model: TokenizerModel, others: Column) -> Column:
    """The same for raw texts without special tokens that ``functions.latin`` normalises; ``others`` where these are null.

    Where unknown bytes of two characters meet, it is seen whether a pre-token ends there.
    """
    table, unk = _byte_table(model)
    lower = model.config.lower

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array, others: pa.Array) -> pa.Array:
        ends, raw = latin.normal_bytes(texts, lower)
        coded = table[raw]
        dropped = _follows(coded == unk, ends)
        meet = np.flatnonzero(dropped & ((raw & 0xC0) != 0x80))
        dropped[meet[latin.piece_begins(raw, ends, meet)]] = False
        found = _id_lists(coded, dropped, ends)
        return pc.if_else(texts.is_valid(), found, others.cast(found.type)) if texts.null_count else found

    return encoded(text, others)


def _byte_table(model: TokenizerModel) -> tuple[np.ndarray, int]:
    """The id of each byte, and that of unknown ones."""
    ids = model.ids
    unk = ids[model.unknown]
    return np.array([ids.get(c, unk) for c in byte_characters()], dtype=np.int32), unk


def _follows(unknown: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which unknown bytes follow another of the same word or text, as these begin ``at``."""
    result = np.zeros(len(unknown), bool)
    result[1:] = unknown[1:] & unknown[:-1]
    result[at[:-1][at[:-1] < len(unknown)]] = False
    return result


def _id_lists(coded: np.ndarray, dropped: np.ndarray, ends: np.ndarray, left: np.ndarray | None = None) -> pa.Array:
    """Ids as lists without the dropped ones; null where ``left`` out."""
    gone = np.flatnonzero(dropped)
    if len(gone):
        coded, ends = coded[~dropped], ends - np.searchsorted(gone, ends)
    mask = None if left is None else pa.array(left)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(coded, pa.int32()), mask=mask)


def encode(texts: DataFrame, model: TokenizerModel, text: str = "payload", name: str = "input_ids") -> DataFrame:
    """Add the token ids of a text column; no special tokens are added.

    Special tokens spelled out in a text become their ids. They are cut out before anything is
    normalised; texts without any take the plain path.
    """
    raw = F.col(text)
    apart = model.latin_apart(raw)
    simple = None if apart is None else F.when(apart.isNull(), raw)
    other = raw if apart is None else apart
    special = holds_special(other, model.specials)
    parts = model.normal_parts(cut_specials(F.when(special, other), model.specials))
    cut = F.flatten(
        F.transform(parts, lambda p, i: F.when(p.isin(*model.specials), F.array(p)).otherwise(model.word_lists(p, i == 0)))
    )
    plain = F.when(~special, other)
    no_words = F.array().cast("array<string>")
    if _is_bytewise(model) and set(model.specials) <= set(SPECIAL_TOKENS):
        # No pre-token can be spelled like one of these special tokens, so most texts need none.
        whole = encode_whole(model.normal_text(plain), model)
        rest = model.word_lists(model.normal_text(F.when(whole.isNull(), plain)), F.lit(True))
        others = F.coalesce(whole, encode_bytes(F.coalesce(rest, cut, no_words), model))
        # Most ids come last, so that no other step in Python carries them.
        return texts.withColumn(name, others if simple is None else encode_latin(simple, model, others))
    words = F.coalesce(model.word_lists(model.normal_text(plain), F.lit(True)), cut, no_words)
    return texts.withColumn(name, encode_words(words, model, texts.sparkSession, simple))


def dump(model: TokenizerModel) -> str:
    return json.dumps(model.to_json(), ensure_ascii=False, indent=2)
