"""Text functions: normalisers and pre-tokenisers as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.contracts import DatasetError

# Patterns that decide what a token is, so they must not vary.
# Whitespace of the record statistics also counts the four ASCII separators.
STAT_SPACE = r"(?U)[\s\x1c-\x1f]+"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
# Whitespace runs other than one plain space, which collapsing leaves as it is.
STAT_RUN = r"(?U)(?:[^\S ]|[\x1c-\x1f])[\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
RUN = r"(?U)[^\S ]\s*| \s+"
PUNCTUATION = r"\p{P}+"
WORD_OR_PUNCT = r"(?U)\w+|[^\w\s]+"
BYTE_PIECE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?(?U:[^\s\p{L}\p{N}])+|(?U:\s)+(?!(?U:\S))|(?U:\s)+"
)

# Control and format characters that cleaning takes away; line breaks and tabs become spaces.
CONTROL = r"[\x00\x{FFFD}]|(?![\t\n\r])[\p{Cc}\p{Cf}\p{Co}]"
IDEOGRAPH = (
    r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}"
    r"\x{2B920}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])"
)
MARKED_PIECE = "\u2581[^\u2581]*|[^\u2581]+"
# One punctuation character, or a run of everything else that is not whitespace.
SINGLE_PUNCT = r"(?U)[!-/:-@\[-`{-~\p{P}]|[^\s!-/:-@\[-`{-~\p{P}]+"

ALGORITHMS = ("char", "bpe", "unigram")
IMPORTED = ("wordpiece", "wordlevel")  # kinds of tokenizer files that are not learnt from a corpus
NORMS = ("none", "nfc")
PUNCT_POLICIES = ("keep", "strip", "space")
SPECIAL_TOKENS = ("<pad>", "<bos>", "<eos>", "<unk>", "<sep>")
UNK_ID = 3
FEW_SPECIALS = 16
# Composition leaves texts without any such character as they are.
MAY_COMPOSE = r"[^\x{0}-\x{2FF}]"


@F.arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()],
        pa.string(),
    )


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has no built-in, so Python does it where it can matter.

    Every code point below U+0300 is stable under composition with its peers, so texts made of
    those alone stay in the JVM and only nulls cross to Python in their place.
    """
    may_change = text.rlike(MAY_COMPOSE)
    return F.coalesce(F.when(~may_change, text), _nfc(F.when(may_change, text)))


def check_text_options(norm: str, punct_policy: str) -> None:
    if norm not in NORMS:
        raise DatasetError(f"unknown normalisation '{norm}', expected one of {list(NORMS)}")
    if punct_policy not in PUNCT_POLICIES:
        raise DatasetError(f"unknown punctuation policy '{punct_policy}', expected one of {list(PUNCT_POLICIES)}")


def _base(text: Column, norm: str, lower: bool, punct_policy: str) -> Column:
    check_text_options(norm, punct_policy)
    if norm == "nfc":
        text = nfc(text)
    if lower:
        text = F.lower(text)
    if punct_policy != "keep":
        text = F.regexp_replace(text, PUNCTUATION, " " if punct_policy == "space" else "")
    return text


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfc_parts(lists: pa.Array) -> pa.Array:
    lists = lists.cast(pa.list_(pa.string()))
    return pa.array([None if x is None else [unicodedata.normalize("NFC", t) for t in x] for x in lists.to_pylist()], lists.type)


def cut_specials(text: Column, specials: Sequence[str] = SPECIAL_TOKENS) -> Column:
    """A text cut before and after every special token it spells out."""
    names = "|".join(rf"\Q{t}\E" for t in sorted(specials, key=len, reverse=True))
    # Marked by a noncharacter, which no text holds, so the longest token at a place wins.
    return F.split(F.regexp_replace(text, f"({names})", "\uffff$1\uffff"), "\uffff")


def holds_special(text: Column, specials: Sequence[str] = SPECIAL_TOKENS) -> Column:
    # A few plain searches cost less than one by pattern.
    found = reduce(or_, [text.contains(t) for t in specials]) if len(specials) <= FEW_SPECIALS else text.rlike("|".join(rf"\Q{t}\E" for t in specials))
    return F.coalesce(found, F.lit(False))


def normalize_parts(parts: Column, norm: str, lower: bool, punct_policy: str, specials: Sequence[str]) -> Column:
    """The encoder's normaliser for each part of a cut text; special tokens stay as they are."""
    if norm == "nfc":
        parts = _nfc_parts(parts)
    collapse = norm != "none" or lower or punct_policy != "keep"

    def normal(part: Column) -> Column:
        if lower:
            part = F.translate(part, "\u03a3", "\u03c3")
        part = _base(part, "none", lower, punct_policy)
        return _collapse(part, RUN) if collapse else part

    return F.transform(parts, lambda part: F.when(part.isin(*specials), part).otherwise(normal(part)))


def _collapse(text: Column, run: str) -> Column:
    return F.trim(F.regexp_replace(text, run, " "))


def _stable_apart(text: Column, norm: str, normal: Callable[[Column, bool], Column]) -> Column:
    """A normaliser, with texts that are stable under composition sent past all its steps in Python.

    No other step makes such a text change under composition: mapping to lower case only adds a dot above to
    the i of U+0130, and the two compose with nothing there. So most texts pass built-in expressions alone, once.
    """
    if norm != "nfc":
        return normal(text, False)
    may_change = text.rlike(MAY_COMPOSE)
    return F.coalesce(normal(F.when(~may_change, text), False), normal(F.when(may_change, text), True))


def _training(text: Column, compose: bool, lower: bool, punct_policy: str) -> Column:
    result = _base(text, "nfc" if compose else "none", lower, punct_policy)
    return result if punct_policy == "keep" else _collapse(result, STAT_RUN)


def _encoding(text: Column, compose: bool, lower: bool, punct_policy: str, collapse: bool) -> Column:
    if lower:
        # The encoder maps characters one by one, so a final capital sigma becomes the plain one.
        # Neither sigma composes with anything, so the text stays composed.
        text, compose = F.replace(nfc(text) if compose else text, F.lit("\u03a3"), F.lit("\u03c3")), False
    result = _base(text, "nfc" if compose else "none", lower, punct_policy)
    return _collapse(result, RUN) if collapse else result


def normalize_training(text: Column, norm: str = "nfc", lower: bool = True, punct_policy: str = "keep") -> Column:
    """Normaliser of the training text: whitespace is collapsed only when punctuation is touched."""
    check_text_options(norm, punct_policy)
    return _stable_apart(text, norm, lambda t, compose: _training(t, compose, lower, punct_policy))


def normalize_encoding(text: Column, norm: str = "nfc", lower: bool = True, punct_policy: str = "keep") -> Column:
    """Normaliser of the encoder: whitespace is collapsed as soon as any step is on."""
    check_text_options(norm, punct_policy)
    collapse = norm != "none" or lower or punct_policy != "keep"
    return _stable_apart(text, norm, lambda t, compose: _encoding(t, compose, lower, punct_policy, collapse))


def normalize_both(text: Column, norm: str = "nfc", lower: bool = True, punct_policy: str = "keep") -> Column:
    """The encoder's normaliser after that of the training text."""
    check_text_options(norm, punct_policy)
    collapse = norm != "none" or lower or punct_policy != "keep"

    def normal(part: Column, compose: bool) -> Column:
        trained = _training(part, compose, lower, punct_policy)
        if norm == "nfc" and not compose:
            # Stable texts hold no sigma, and the steps taken change nothing the second time.
            return _collapse(trained, RUN)
        return _encoding(trained, compose, lower, punct_policy, collapse)

    return _stable_apart(text, norm, normal)


def split_whitespace(text: Column) -> Column:
    return F.filter(F.split(text, STAT_SPACE), lambda x: x != "")


def pretokenize(text: Column) -> Column:
    """Runs of word characters, and runs of everything else that is not whitespace."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_PUNCT), 0)


def byte_pieces(text: Column) -> Column:
    """Pieces within which the byte-level tokeniser works."""
    return F.regexp_extract_all(text, F.lit(BYTE_PIECE), 0)


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes as two-digit hex strings."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), 0)


def tokenizer_id(algo: Column, vocab_size: Column, norm: Column, lower: Column, punct_policy: Column, seed: Column) -> Column:
    """Name of a tokenizer configuration."""
    return F.concat_ws(
        "-",
        algo,
        vocab_size.cast("string"),
        norm,
        F.when(lower, "lower").otherwise("nolower"),
        punct_policy,
        F.concat(F.lit("s"), seed.cast("string")),
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decomposed(lists: pa.Array) -> pa.Array:
    lists = lists.cast(pa.list_(pa.string()))
    return pa.array([None if x is None else [unicodedata.normalize("NFD", t) for t in x] for x in lists.to_pylist()], lists.type)


def clean_parts(parts: Column, clean: bool, ideographs: bool, strip_accents: bool, lower: bool, specials: Sequence[str]) -> Column:
    """The cleaning normaliser of word-piece files for each part of a cut text; special tokens stay.

    Removes control characters, sets ideographs apart, removes accents, maps to lower case. Only lists
    with a character from U+00C0 on cross to Python, to be decomposed.
    """

    def each(parts: Column, change: Callable[[Column], Column]) -> Column:
        return F.transform(parts, lambda part: F.when(part.isin(*specials), part).otherwise(change(part)))

    if clean:
        parts = each(parts, lambda p: F.regexp_replace(F.regexp_replace(p, CONTROL, ""), r"(?U)\s", " "))
    if ideographs:
        parts = each(parts, lambda p: F.regexp_replace(p, IDEOGRAPH, " $1 "))
    if strip_accents:
        may_change = F.exists(parts, lambda p: p.rlike(r"[^\x{0}-\x{BF}]"))
        apart = _decomposed(F.when(may_change, parts))
        bare = F.zip_with(parts, apart, lambda p, d: F.when(p.isin(*specials), p).otherwise(F.regexp_replace(d, r"\p{Mn}", "")))
        parts = F.when(may_change, bare).otherwise(parts)
    if lower:
        parts = each(parts, lambda p: F.lower(F.translate(p, "\u03a3", "\u03c3")))
    return parts


def single_punct_pieces(text: Column) -> Column:
    """Punctuation characters one by one, and runs of everything else that is not whitespace."""
    return F.regexp_extract_all(text, F.lit(SINGLE_PUNCT), 0)


def unbroken_pieces(text: Column) -> Column:
    """Runs of everything that is not whitespace."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), 0)


def marked_pieces(text: Column, prepend: Column, split: bool) -> Column:
    """Spaces as U+2581, one put in front where ``prepend`` holds; cut before each of them if ``split``.

    Without ``split`` the whole text is one piece, whose tokens may cross the borders of words.
    """
    marked = F.translate(text, " ", "\u2581")
    marked = F.when(prepend & ~marked.startswith("\u2581"), F.concat(F.lit("\u2581"), marked)).otherwise(marked)
    pieces = F.regexp_extract_all(marked, F.lit(MARKED_PIECE), 0) if split else F.array(marked)
    return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), pieces)
