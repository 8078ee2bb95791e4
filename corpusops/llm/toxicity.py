"""Toxicity by a classifier chain over sparse word features.

Categories are predicted in a fixed order. Each has a linear model over the words and word pairs a
text holds, and every later model also sees the log-odds of the categories before it. Those inputs
are out-of-fold predictions while training, so a later model learns how far to trust an earlier one
on texts that one has not seen. Features are chosen by how far their presence shifts the odds of a
category, which keeps long clean texts from adding up noise.

Models are fitted in numpy on a bounded sample of labelled texts, weighted back to the share of each
label combination; prediction reads every text whole, in Arrow batches where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm.common import WordHashes, alnum_words, as_bytes, bound_batches, mix

BITS = 20
TRAIN_TEXTS = 8_000
MOST_FEATURES = 1_024
LEAST_TEXTS = 3  # in which a feature must occur
LEAST_SHIFT = 3.0  # standard deviations of the log-odds
FOLDS = 5
STEPS = 150
RIDGE = 1e-3


@dataclass
class Link:
    """Model of one category: weights of hashed features, of earlier log-odds, bias and threshold."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float = 0.5


@dataclass
class Chain:
    categories: list[str]
    links: list[Link]


def features(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Distinct hashed words and pairs of neighbouring words of a text."""
    words = hashes.of(alnum_words(text))
    if not len(words):
        return np.zeros(0, np.int64)
    pairs = mix(words[:-1] * np.uint64(31) + words[1:])
    return np.unique(np.concatenate([words, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Texts as index lists, laid end to end."""

    def __init__(self, texts: list[np.ndarray], column: np.ndarray):
        """``column`` maps a hashed feature to its column or -1."""
        picked = [column[t] for t in texts]
        picked = [c[c >= 0] for c in picked]
        self.row = np.repeat(np.arange(len(picked)), [len(c) for c in picked])
        self.column = np.concatenate(picked) if picked else np.zeros(0, np.int64)
        self.n = len(picked)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], minlength=self.n)

    def back(self, error: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, error[self.row], minlength=width)


def fit_linear(rows: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Adam on the whole sample."""
    w, e, b = np.zeros(width), np.zeros(extra.shape[1]), np.zeros(1)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, e, b)]
    scale = weight / weight.sum()
    for step in range(1, STEPS + 1):
        error = (sigmoid(rows.dot(w) + extra @ e + b[0]) - y) * scale
        grads = (rows.back(error, width) + RIDGE * w, extra.T @ error + RIDGE * e, np.array([error.sum()]))
        for value, grad, (m, v) in zip((w, e, b), grads, state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, e, float(b[0])


def informative(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Features whose presence shifts the odds of the label, the strongest first."""
    size = 1 << BITS
    def count(some):
        return np.bincount(np.concatenate(some), minlength=size) if some else np.zeros(size)
    yes, no = count([t for t, l in zip(texts, y) if l]), count([t for t, l in zip(texts, y) if not l])
    n_yes, n_no = y.sum(), len(y) - y.sum()
    odds = lambda k, n: np.log((k + 0.5) / (n - k + 0.5))
    spread = np.sqrt(1 / (yes + 0.5) + 1 / (n_yes - yes + 0.5) + 1 / (no + 0.5) + 1 / (n_no - no + 0.5))
    shift = np.abs(odds(yes, n_yes) - odds(no, n_no)) / spread
    shift[(yes + no < LEAST_TEXTS) | (shift < LEAST_SHIFT)] = 0
    best = np.argsort(-shift, kind="stable")[:MOST_FEATURES]
    return best[shift[best] > 0]


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Middle of the gap that gives the best F1."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(weight[order] * y[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    usable = np.append(p[order][1:] < p[order][:-1], True)
    at = int(np.argmax(np.where(usable, f1, -1)))
    lower = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + lower) / 2)


def train(texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, categories: list[str], seed: int = 5) -> Chain:
    """One link per category, in order; each sees out-of-fold log-odds of those before it."""
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(texts)) % FOLDS if texts else np.zeros(0, np.int64)
    extra = np.zeros((len(texts), 0))
    links = []
    for i, _ in enumerate(categories):
        y = labels[:, i].astype(float) if texts else np.zeros(0)
        if not len(y) or y.min() == y.max():
            # Nothing to tell apart: the category always or never holds.
            constant = 30.0 if len(y) and y[0] else -30.0
            links.append(Link(np.zeros(1 << BITS, np.float32), np.zeros(i), constant, 0.5))
            extra = np.column_stack([extra, np.full(len(texts), constant)])
            continue
        out = np.zeros(len(texts))
        for f in [*range(FOLDS), None]:
            learn = np.flatnonzero(fold != f) if f is not None else np.arange(len(texts))
            chosen = informative([texts[j] for j in learn], y[learn])
            column = np.full(1 << BITS, -1, np.int64)
            column[chosen] = np.arange(len(chosen))
            rows = Rows([texts[j] for j in learn], column)
            w, e, b = fit_linear(rows, extra[learn], y[learn], weight[learn], len(chosen))
            if f is not None:
                rest = np.flatnonzero(fold == f)
                out[rest] = Rows([texts[j] for j in rest], column).dot(w) + extra[rest] @ e + b
        full = np.zeros(1 << BITS, np.float32)
        full[chosen] = w
        links.append(Link(full, e, b, best_threshold(sigmoid(out), y, weight)))
        extra = np.column_stack([extra, np.clip(out, -30, 30)])
    return Chain(categories, links)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], text: str, doc_id: str, most: int):
    """At most about ``most`` labelled texts, every combination of labels with its share, chosen by hash."""
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"`{c}`").cast("int").alias(c) for c in categories]).dropna()
    combination = F.concat_ws(",", *categories)
    sizes = {r["c"]: r["count"] for r in known.groupBy(combination.alias("c")).count().collect()}
    if not sizes:
        return [], np.zeros((0, len(categories))), np.zeros(0)
    each = most / len(sizes)
    share = F.create_map(*[F.lit(x) for c, n in sorted(sizes.items()) for x in (c, min(1.0, each / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    # About ``most`` rows of a few numbers.
    picked = F.broadcast(known.filter(place < F.element_at(share, combination)))
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(picked, "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [features(t, hashes).astype("<i4").tobytes() for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["f", "l"])

    rows = texts.select("text", F.array(*categories)).mapInArrow(extract, "f binary, l array<int>").collect()
    rows.sort(key=lambda r: (bytes(r["f"]), r["l"]))
    labels_found = np.array([r["l"] for r in rows], np.int64).reshape(len(rows), len(categories))
    seen: dict[str, int] = {}
    names = [",".join(map(str, r["l"])) for r in rows]
    for name in names:
        seen[name] = seen.get(name, 0) + 1
    weight = np.array([sizes[name] / seen[name] for name in names])
    return [np.frombuffer(r["f"], "<i4").astype(np.int64) for r in rows], labels_found, weight


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], text: str = "text", doc_id: str = "doc_id", most: int = TRAIN_TEXTS) -> Chain:
    """Learn the chain from ``labels(doc_id, <categories>)`` with values 0 and 1.

    ``most`` bounds the texts trained on. Labels with a null are left out, as are labels without a text
    row; a null text has no features. A category without both values is predicted as its only one.
    """
    bound_batches(docs.sparkSession)
    return train(*labelled_sample(docs, labels, categories, text, doc_id, most), categories)


def predict(df: DataFrame, text: Column, chain: Chain, result: str = "toxicity") -> DataFrame:
    """``df`` with ``result``: for every category its probability ``p_<name>`` and decision ``is_<name>``.

    Null and empty texts have no features and get the probability of the bias. Whole texts are read;
    other columns pass through, one already named ``result`` is replaced.
    """
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(chain)
    names = [n for c in chain.categories for n in (f"p_{c}", f"is_{c}")]
    kind = T.StructType([T.StructField(n, T.DoubleType() if n.startswith("p_") else T.BooleanType()) for n in names])

    @F.arrow_udf(kind)
    def predicted(texts: pa.Array) -> pa.Array:
        links, hashes = shared.value.links, WordHashes()
        logits = np.zeros((len(texts), len(links)))
        for row, text in enumerate(as_bytes(texts)):
            found = features(text, hashes)
            for i, link in enumerate(links):
                logits[row, i] = np.clip(link.weights[found].sum() + logits[row, :i] @ link.earlier + link.bias, -30, 30)
        columns = []
        for i, link in enumerate(links):
            p = sigmoid(logits[:, i])
            columns += [pa.array(p), pa.array(p > link.threshold)]
        return pa.StructArray.from_arrays(columns, names)

    return df.withColumn(result, predicted.asNondeterministic()(text))
