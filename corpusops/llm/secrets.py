"""Secret scan: exact patterns, and a linear-chain conditional random field (CRF) that adds spans of its own.

Tokens (runs of word characters, or single marks) are tagged secret begin, inside or outside.

1. **Features**: the token's shape (lengths, kinds of characters, changes between them, hexadecimal or not), the
   three words before and the one after (hashed), and features of the file (how dense assignments, digits and
   marks are). A token's own word is no feature, so the model learns what secrets look like and where they stand.
2. **Training**: windows of tokens from a bounded sample of distinct texts, tagged by the exact patterns, are
   collected, those with a secret also with a made-up one in its place; the weights maximise the conditional likelihood (forward-backward and gradient steps in numpy).
3. **Decoding**: each distinct token's scores are computed once per task, so scoring a text is a few table lookups a
   token. Viterbi runs where a secret is possible at all: the best conceivable score of every stretch is bounded
   by cumulative sums, and tokens in no stretch with a positive bound are outside on every best path.

Rows are judged alone, where they are read; nothing is shuffled but the hashes that pick the sample.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm.common import bound_batches

KINDS = ("assign", "access", "hex", "crf")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# Greedy runs are whole, so those long enough are found alone.
HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
# Words for keys that windows are also trained with, so that the model does not rest on the patterns' own.
OTHER_KEYS = (*KEYS, "passphrase", "credential", "auth", "pwd", "key")
TOKEN = re.compile(r"\w+|[^\w\s]")

# Sample: so many distinct texts at most, of each so many windows with and without a secret.
SAMPLE_TEXTS = 20_000
WINDOW = 32
MOST_WINDOWS = 12_000
WITH_SECRETS, WITHOUT_SECRETS = 4, 2
WORD_BUCKETS = 4_096
CONTEXTS = 4  # words before: 1, 2, 3; then the word after
EPOCHS = 12
RATE = 0.3
L2 = 2e-4
TOKENS_CACHED = 200_000
# A boundary between texts: no stretch reaches across it.
APART = -1e6

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


# ---------------------------------------------------------------- exact patterns


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the matches of the exact patterns; places count code points."""
    found = []
    low = text.lower()
    if any(key in low for key in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def value_spans(text: str) -> list[tuple[int, int]]:
    """What the patterns mark as the secret itself: values without their keys."""
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    values += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    values += [m.span() for m in HEX.finditer(text)]
    merged: list[tuple[int, int]] = []
    for start, end in sorted(values):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


# ---------------------------------------------------------------- features

# Sizes of the groups of features of a token's own shape.
SHAPE_SIZES = {"length": 16, "kinds": 16, "changes": 12, "hex": 16, "variety": 8, "mark": 128}
SHAPE_START = dict(zip(SHAPE_SIZES, np.cumsum([0, *SHAPE_SIZES.values()])))
N_SHAPE = sum(SHAPE_SIZES.values())
FILE_SIZES = 3 * 6
N_FEATURES = N_SHAPE + CONTEXTS * WORD_BUCKETS + FILE_SIZES
BETWEEN = re.compile(r"(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])")


def _size_class(n: int) -> int:
    """1 to 8 as they are, then two classes a doubling."""
    return n if n <= 8 else min(15, 5 + int(2 * np.log2(n / 8)) + 3)


def _variety(token: str) -> int:
    return min(7, 8 * len(set(token)) // (len(token) + 1))


def is_word(token: str) -> bool:
    """Letters only, in lower case but for the first: its length, variety and script are its whole shape."""
    return token.isalpha() and (token.islower() or token.istitle())


def shape_features(token: str) -> list[int]:
    """Features of a token without regard to where it stands."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return [SHAPE_START["mark"] + min(ord(token), 127)]
    if is_word(token):
        mixed = 8 * (not token.isascii()) + 2 * token.istitle() + 1
        return [SHAPE_START["length"] + _size_class(n), SHAPE_START["kinds"] + mixed, SHAPE_START["variety"] + _variety(token)]
    lower, upper = any("a" <= c <= "z" for c in token), any("A" <= c <= "Z" for c in token)
    digit, other = any("0" <= c <= "9" for c in token), not token.isascii() or "_" in token
    mixed = 8 * other + 4 * digit + 2 * upper + lower
    start = SHAPE_START
    features = [
        start["length"] + _size_class(n),
        start["kinds"] + mixed,
        start["changes"] + min(11, len(BETWEEN.findall(token))),
        start["variety"] + _variety(token),
    ]
    if digit and not token.lower().strip("0123456789abcdef"):
        features.append(start["hex"] + _size_class(n))
    return features


def word_bucket(token: str) -> int:
    return zlib.crc32(token.lower().encode()) % WORD_BUCKETS


def file_features(text: str) -> list[int]:
    """How dense assignments, digits and marks are in the whole text, as classes."""
    per = 1000 / (len(text) + 1)
    assigned = (text.count("=") + text.count(":")) * per
    digits = sum(map(text.count, "0123456789")) * per
    marks = sum(map(text.count, "{}<>;\"'")) * per
    classes = [min(5, int(np.log2(1 + x))) for x in (assigned, digits / 8, marks)]
    first = N_SHAPE + CONTEXTS * WORD_BUCKETS
    return [first + 6 * k + c for k, c in enumerate(classes)]


def tags(text: str, tokens: list[re.Match]) -> list[int]:
    """0 outside, 1 begin, 2 inside, by the exact patterns."""
    out, at, spans = [], 0, value_spans(text)
    begun = None
    for token in tokens:
        while at < len(spans) and spans[at][1] <= token.start():
            at += 1
        if at < len(spans) and spans[at][0] < token.end():
            out.append(2 if begun == at else 1)
            begun = at
        else:
            out.append(0)
    return out


# ---------------------------------------------------------------- the chain


@dataclass(frozen=True)
class Chain:
    """Weights of begin and inside against outside, and of the steps between tags (outside to outside: 0)."""

    weights: np.ndarray  # (N_FEATURES, 2)
    steps: np.ndarray  # (3, 3) from, to


NEVER = -1e9
ALLOWED = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool)


def window_features(tokens: list[str], file: list[int], at: int, size: int) -> list[list[int]]:
    rows = []
    for k in range(at, min(at + size, len(tokens))):
        row = shape_features(tokens[k]) + file
        for c, place in enumerate((k - 1, k - 2, k - 3, k + 1)):
            if 0 <= place < len(tokens):
                row.append(N_SHAPE + c * WORD_BUCKETS + word_bucket(tokens[place]))
        rows.append(row)
    return rows


def train(windows: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS, seed: int = 5) -> Chain:
    """Maximise the conditional likelihood of tagged windows by stochastic gradient steps (AdaGrad)."""
    weights, steps = np.zeros((N_FEATURES + 1, 2)), np.zeros((3, 3))
    weights[:N_SHAPE] = -0.1
    if not windows or not any(any(t) for _, t in windows):
        # Nothing to learn from: everything is outside.
        return Chain(np.full((N_FEATURES, 2), -1.0), steps)
    most = max(len(r) for x, _ in windows for r in x)
    n = len(windows)
    features = np.full((n, WINDOW, most), N_FEATURES, np.int32)
    gold, mask = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    for k, (rows, tag) in enumerate(windows):
        for t, row in enumerate(rows):
            features[k, t, : len(row)] = row
        gold[k, : len(tag)], mask[k, : len(tag)] = tag, True
    rng = np.random.default_rng(seed)
    seen, seen_steps = np.full_like(weights, 1e-6), np.full_like(steps, 1e-6)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), n // 128 + 1):
            grad, grad_steps = gradient(weights, steps, features[part], gold[part], mask[part])
            grad = grad / len(part) - L2 * weights
            grad_steps = np.where(ALLOWED, grad_steps / len(part) - L2 * steps, 0)
            grad[N_FEATURES] = 0
            grad_steps[0, 0] = 0
            seen += grad**2
            seen_steps += grad_steps**2
            weights += RATE * grad / np.sqrt(seen)
            steps += RATE * grad_steps / np.sqrt(seen_steps)
    return Chain(weights[:N_FEATURES], steps)


def gradient(weights: np.ndarray, steps: np.ndarray, features: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed less expected counts of features and steps; before and after a window stands a token outside."""
    n, size, _ = features.shape
    score = np.zeros((n, size, 3))
    score[:, :, 1:] = weights[features].sum(2)
    move = np.where(ALLOWED, steps, NEVER)
    # Padding stays outside, so that windows end there.
    score[~mask, 1:] = NEVER
    ahead = np.empty((n, size + 1, 3))
    ahead[:, 0] = [0, NEVER, NEVER]
    for t in range(size):
        ahead[:, t + 1] = _logsum(ahead[:, t, :, None] + move, 1) + score[:, t]
    back = np.empty((n, size + 1, 3))
    back[:, size] = move[:, 0]
    for t in range(size - 1, -1, -1):
        back[:, t] = _logsum(move + (score[:, t] + back[:, t + 1])[:, None, :], 2)
    total = _logsum(ahead[:, size] + back[:, size], 1)
    share = np.exp(ahead[:, 1:] + back[:, 1:] - total[:, None, None])
    wrong = np.stack([gold == 1, gold == 2], 2) - share[:, :, 1:]
    wrong[~mask] = 0
    grad = np.zeros_like(weights)
    for c in range(2):
        grad[:, c] = np.bincount(features.ravel(), np.repeat(wrong[:, :, c].ravel(), features.shape[2]), len(weights))
    grad_steps = np.zeros((3, 3))
    before = np.concatenate([np.zeros((n, 1), np.int64), gold], 1)
    after = np.concatenate([gold, np.zeros((n, 1), np.int64)], 1)
    np.add.at(grad_steps, (before.ravel(), after.ravel()), 1)
    pairs = ahead[:, :-1, :, None] + move + (score + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
    grad_steps -= np.exp(pairs).sum((0, 1))
    grad_steps -= np.exp(ahead[:, size, :] + back[:, size] - total[:, None]).sum(0)[:, None] * np.array([1, 0, 0])
    return grad, grad_steps


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def viterbi(scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """Best tags for scores of begin and inside, between tokens outside; of equal paths the one outside longest."""
    move = np.where(ALLOWED, steps, NEVER).tolist()
    best, back = [0.0, NEVER, NEVER], []
    for begin, inside in scores.tolist():
        row, chosen = [], []
        for to, gain in ((0, 0.0), (1, begin), (2, inside)):
            options = [best[f] + move[f][to] for f in range(3)]
            f = max(range(3), key=options.__getitem__)
            row.append(options[f] + gain)
            chosen.append(f)
        best = row
        back.append(chosen)
    options = [best[f] + move[f][0] for f in range(3)]
    tag = max(range(3), key=options.__getitem__)
    path = []
    for chosen in reversed(back):
        path.append(tag)
        tag = chosen[tag]
    return path[::-1]


def possible(scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Tokens that may be in a secret on a best path: some stretch through them can score above zero."""
    most_step = float(np.where(ALLOWED, steps, NEVER).ravel()[1:].max())
    best = np.maximum(scores[0], scores[1]) + most_step
    total = np.append(0.0, np.cumsum(best))
    ending = total[1:] - np.minimum.accumulate(total[:-1])
    starting = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
    return ending + starting - best + max(most_step, 0.0) > -1e-3


class TokenScores(dict):
    """Numbers of the tokens seen lately; for each number the token's shape and the bucket of its word.

    Tokens share few shapes, and a shape's scores are summed once.
    """

    def __init__(self, chain: Chain):
        super().__init__()
        self.weights = chain.weights
        # What a word gives to the tokens after and before it; the last bucket is that of a boundary.
        context = chain.weights[N_SHAPE : N_SHAPE + CONTEXTS * WORD_BUCKETS].reshape(CONTEXTS, WORD_BUCKETS, 2)
        self.context = np.concatenate([context, np.zeros((CONTEXTS, 1, 2))], 1).transpose(2, 0, 1).copy()
        self.shapes: dict[tuple, int] = {}
        self.shape_scores: list[np.ndarray] = [np.full(2, APART)]
        self.shape, self.bucket = array("i", [0]), array("i", [WORD_BUCKETS])

    def __missing__(self, token: str) -> int:
        # The features of a word follow from these four.
        key = (len(token), len(set(token)), token.isascii(), token.istitle()) if is_word(token) else tuple(shape_features(token))
        shape = self.shapes.get(key)
        if shape is None:
            shape = self.shapes[key] = len(self.shape_scores)
            self.shape_scores.append(self.weights[shape_features(token)].sum(0))
        number = self[token] = len(self.shape)
        self.shape.append(shape)
        self.bucket.append(word_bucket(token))
        return number

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """Scores of begin and inside of each token of a sequence, by its shape and the words around it."""
        shape, bucket = np.array(self.shape)[numbers], np.array(self.bucket)[numbers]
        own = np.array(self.shape_scores).T.copy()
        scores = own[:, shape]
        for c in range(3):
            scores[:, c + 1 :] += self.context[:, c][:, bucket[: -c - 1]]
        scores[:, :-1] += self.context[:, 3][:, bucket[1:]]
        return scores

    def trim(self) -> None:
        if len(self) > TOKENS_CACHED:
            self.clear()
            del self.shape[1:], self.bucket[1:]
        if len(self.shapes) > TOKENS_CACHED:
            self.clear()
            self.shapes.clear()
            del self.shape[1:], self.bucket[1:], self.shape_scores[1:]


def tagged_spans(texts: list[str | None], chain: Chain, cache: TokenScores) -> list[list[tuple[int, int]]]:
    """Spans of the secrets that the chain finds in each text, by Viterbi over its whole length."""
    cache.trim()
    numbers, sizes, files = array("q"), [], []
    for text in texts:
        tokens = TOKEN.findall(text or "")
        # Three boundaries before each text, so that no word of another is in its context.
        numbers.extend((0, 0, 0))
        numbers.extend(map(cache.__getitem__, tokens))
        sizes.append(len(tokens))
        files.append(chain.weights[file_features(text)].sum(0) if tokens else np.zeros(2))
    numbers.extend((0, 0, 0))
    scores = cache.of(np.array(numbers))
    at = np.cumsum([0, *(s + 3 for s in sizes)])[:-1] + 3
    for start, size, file in zip(at, sizes, files):
        scores[:, start : start + size] += file[:, None]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    alive = np.flatnonzero(possible(scores, chain.steps))
    if not alive.size:
        return out
    places: dict[int, list[re.Match]] = {}
    for run in np.split(alive, np.flatnonzero(np.diff(alive) > 1) + 1):
        path = viterbi(scores[:, run[0] : run[-1] + 1].T, chain.steps)
        if not any(path):
            continue
        row = int(np.searchsorted(at, run[0], "right")) - 1
        if row not in places:
            places = {row: list(TOKEN.finditer(texts[row]))}
        for k, tag in enumerate(path):
            token = places[row][int(run[0] - at[row]) + k]
            if tag == 1:
                out[row].append(token.span())
            elif tag == 2:
                out[row][-1] = (out[row][-1][0], token.end())
    return out


def all_spans(text: str | None, added: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``start, kind, end``: base spans, and the chain's where they overlap none."""
    spans = base_spans(text) if text else []
    base = list(spans)
    spans += [(s, 3, e) for s, e in added if not any(s < end and start < e for start, _, end in base)]
    return sorted(spans)


# ---------------------------------------------------------------- Spark


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE_TEXTS) -> Chain:
    """Train on windows of at most ``sample`` distinct texts, those with the smallest hashes.

    The tags come from the exact patterns. Null texts are left out; without any secret in the sample the chain
    tags nothing. At most ``MOST_WINDOWS`` windows reach the driver.
    """
    bound_batches(docs.sparkSession)
    column = F.col(f"`{text}`")
    hashed = docs.filter(column.isNotNull()).select(F.xxhash64(column).alias("h"), column.alias("t"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).collect()[0][0]
    if last is None:
        return train([])

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for h, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    out += [(h, k, *w) for k, w in enumerate(cut_windows(body, h))]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32())]
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["h", "k", "secret", "features", "tags"])

    cut = hashed.filter(F.col("h") <= last).mapInArrow(windows, "h long, k int, secret boolean, features array<array<int>>, tags array<int>")
    # Copies of a text in several tasks give the same windows. Those with a secret come first.
    chosen = cut.dropDuplicates(["h", "k"]).orderBy(F.desc("secret"), "k", "h").limit(MOST_WINDOWS).collect()
    return train([(r["features"], r["tags"]) for r in sorted(chosen, key=lambda r: (r["h"], r["k"]))])


def cut_windows(text: str, seed: int) -> list[tuple[bool, list[list[int]], list[int]]]:
    """A few windows of a text: around secrets, around other tokens with digits, and anywhere."""
    tokens = list(TOKEN.finditer(text))
    if not tokens:
        return []
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    tag, words, file = tags(text, tokens), [t[0] for t in tokens], file_features(text)
    begins = [k for k, t in enumerate(tag) if t == 1]
    odd = [k for k, w in enumerate(words) if not tag[k] and len(w) > 3 and not w.isalpha()]
    chosen = [begins[k] for k in rng.permutation(len(begins))[:WITH_SECRETS]]
    chosen += [odd[k] for k in rng.permutation(len(odd))[: WITHOUT_SECRETS - 1]]
    chosen.append(int(rng.integers(len(tokens))))
    out = []
    for k in chosen:
        at = max(0, min(k - int(rng.integers(4, WINDOW - 8)), len(tokens) - WINDOW))
        while at > 0 and tag[at] == 2:
            at -= 1
        part = tag[at : at + WINDOW]
        out.append((any(part), window_features(words, file, at, WINDOW), part))
        if any(part):
            # The same place with another secret and another word for its key.
            other, retagged = [], []
            for word, t in zip(words[max(0, at - 3) : at + WINDOW + 1], [0] * min(at, 3) + tag[at : at + WINDOW + 1]):
                if t != 2:
                    other.append(made_up(rng) if t else OTHER_KEYS[int(rng.integers(len(OTHER_KEYS)))] if word.lower() in KEYS else word)
                    retagged.append(t)
            skip = min(at, 3)
            out.append((True, window_features(other, file, skip, WINDOW), retagged[skip : skip + WINDOW]))
    return out


def made_up(rng: np.random.Generator) -> str:
    """A random secret: hexadecimal, letters and digits, or capitals and digits."""
    kind = int(rng.integers(3))
    letters = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")[kind]
    size = int(rng.integers(*((16, 65), (10, 41), (14, 25))[kind]))
    return "".join(letters[x] for x in rng.integers(len(letters), size=size))


def find_secrets(docs: DataFrame, chain: Chain, text: str = "text", result: str = "secrets") -> DataFrame:
    """``docs`` with ``result``: an array of ``kind, start, end`` by start, then kind (assign, access, hex, crf).

    Base kinds are the matches of the exact patterns, leftmost and without overlap in a kind; a match whose value is too
    short is no span. ``crf`` are the chain's spans that overlap no base span. Places count code points, ends
    are exclusive. A null text counts as empty and has no spans. Every row is judged alone and whole, so repeated
    rows get equal results; a column named ``result`` is replaced. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(result, scanned(F.col(f"`{text}`"), docs.sparkSession.sparkContext.broadcast(chain)))


def scanned(text: Column, shared) -> Column:
    cache: list[TokenScores] = []

    @F.arrow_udf(T.ArrayType(SPAN))
    def scan(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(TokenScores(shared.value))
        bodies = texts.to_pylist()
        found = [all_spans(t, s) for t, s in zip(bodies, tagged_spans(bodies, shared.value, cache[0]))]
        flat = [x for spans in found for x in spans]
        values = pa.StructArray.from_arrays(
            [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())],
            ["kind", "start", "end"],
        )
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), values)

    return scan.asNondeterministic()(text)
