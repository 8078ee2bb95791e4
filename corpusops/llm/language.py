"""Language identification from averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords (byte n-grams of lower-cased words, a space
marking the word's ends, hashed to a fixed number of buckets), and a linear softmax maps the mean to
languages. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
texts. As everything is linear, embedding and output layer collapse into one score per bucket and
language, so prediction sums table rows over the whole text.

Scores are calibrated on texts kept out of the training: a temperature is fitted, and a text is
rejected if its calibrated score lies below nearly all correct scores of the calibration texts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm.common import bound_batches

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
DIMENSION = 16
TRAIN_TEXTS = 4_000
EPOCHS = 8
REJECT_SHARE = 0.001
MOST_REJECTING_SCORE = 0.5
UNKNOWN = "und"
# Word characters that are neither letters nor decimal digits: fractions, superscripts, Roman numerals.
NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
ANY_NUMBER = re.compile(f"[{re.escape(''.join(sorted(NUMBERS)))}]")
NOT_LETTERS = re.compile(r"[\W\d_]+")
PIECE = 1 << 20  # characters handled at once; only memory depends on it

PREDICTION = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


@dataclass
class Model:
    """``table``: score of each bucket and language; ``bias``; temperature and threshold of the calibration."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def only_letters(text: str) -> str:
    """The text with each stretch of other characters as one space."""
    if not text.isascii() and not NUMBERS.isdisjoint(text):
        text = ANY_NUMBER.sub(" ", text)
    return NOT_LETTERS.sub(" ", text)


def grams_at(letters: bytes, start: int, stop: int) -> Iterator[np.ndarray]:
    """Buckets of the subwords that begin in ``start..stop``; a space is only their first or last byte."""
    for n in GRAMS:
        raw = np.frombuffer(letters[start : stop + n - 1], np.uint8)
        m = len(raw) - n + 1
        if m <= 0:
            continue
        wide, space = raw.astype(np.uint32), raw == 32
        code, inner = wide[:m].copy(), np.zeros(m, bool)
        for j in range(1, n):
            code |= wide[j : j + m] << np.uint32(8 * j)
            if j < n - 1:
                inner |= space[j : j + m]
        # The upper bits of an odd multiple, another for each length.
        yield ((code * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(16))[~inner]


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all subwords of the whole text; nothing if it has no letter."""
    letters = only_letters(f" {text.lower()} ").encode("utf-8", "ignore") if text else b""
    if not letters.isspace():
        for start in range(0, len(letters), PIECE):
            yield from grams_at(letters, start, start + PIECE)


def text_scores(model: Model, text: str | None) -> np.ndarray | None:
    """Logits of a text, or None if it has no letter."""
    total, n = np.zeros(len(model.languages)), 0
    for buckets in subwords(text):
        total += model.table[buckets].sum(axis=0, dtype=np.float64)
        n += len(buckets)
    return total / n + model.bias if n else None


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def training_sample(rows: DataFrame, text: str, lang: str, most: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """At most about ``most`` texts as (language, buckets, counts), spread evenly over the languages.

    A row is taken if the hash of its text lies below its language's share, so no sort is needed and
    the same texts are taken however the table is split. Copies of a text under one language are one
    text, folded in each task before they are shuffled, so a text on a third of all rows weighs no more than
    any other. Only bucket counts reach the driver.
    """
    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return []
    each = most / len(sizes)
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, each / n))])
    place = F.pmod(F.xxhash64(F.col("text")), F.lit(1 << 30)) / (1 << 30)
    picked = known.filter(place < F.element_at(share, F.col("lang"))).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                parts = list(subwords(text.as_py()))
                if parts:
                    buckets, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang.as_py()]), pa.array([buckets.astype("<u2").tobytes()]), pa.array([n.astype("<f4").tobytes()])],
                        ["lang", "buckets", "n"],
                    )

    sample = picked.mapInArrow(count, "lang string, buckets binary, n binary").collect()
    unpacked = [(r["lang"], np.frombuffer(r["buckets"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<f4")) for r in sample]
    return sorted(unpacked, key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """SGD over the sample; every fifth text is kept for the calibration."""
    languages = sorted({lang for lang, _, _ in sample})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    shuffled = [sample[i] for i in rng.permutation(len(sample))]
    target = {lang: i for i, lang in enumerate(languages)}
    held, learn = shuffled[::5], [x for i, x in enumerate(shuffled) if i % 5] or shuffled
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    output = np.zeros((DIMENSION, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)):
            lang, buckets, n = learn[i]
            weight = (n / n.sum()).astype(np.float32)
            mean = weight @ embedding[buckets]
            error = softmax(mean @ output + bias)
            error[target[lang]] -= 1
            rate = np.float32(1 - done / steps)
            back = output @ error
            output -= np.float32(1.0) * rate * np.outer(mean, error).astype(np.float32)
            bias -= np.float32(0.1) * rate * error.astype(np.float32)
            # Shares are small, so embeddings take a larger step.
            embedding[buckets] -= np.float32(60.0) * rate * np.outer(weight, back).astype(np.float32)
            done += 1
    model = Model(languages, np.ascontiguousarray(embedding @ output), bias.astype(np.float64))
    return calibrated(model, held or learn)


def calibrated(model: Model, held: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Fit the temperature by likelihood; put the threshold below nearly all correct scores."""
    logits = np.array([(n / n.sum()) @ model.table[b] + model.bias for _, b, n in held])
    truth = np.array([model.languages.index(lang) for lang, _, _ in held])
    grid = np.geomspace(0.1, 10, 60)
    losses = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    if len(right):
        model.threshold = float(min(np.quantile(right, REJECT_SHARE), MOST_REJECTING_SCORE))
    return model


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", most: int = TRAIN_TEXTS) -> Model:
    """Learn from labelled ``rows``. ``most`` bounds the texts trained on; nothing else is sampled."""
    bound_batches(rows.sparkSession)
    return train(training_sample(rows, text, lang, most))


def predict(df: DataFrame, text: Column, model: Model, result: str = "language") -> DataFrame:
    """``df`` with ``result``: ``lang_pred``, calibrated ``score`` in [0, 1] and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and rejected. If nothing was learned,
    every text is ``und`` with score 0, and those with letters are not rejected: there is no ground to.
    Whole texts are read. Ties go to the first language by name. Other columns pass through; one
    already named ``result`` is replaced.
    """
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def predicted(texts: pa.Array) -> pa.Array:
        known = shared.value
        names, scores, rejected = [], [], []
        for text in texts:
            logits = text_scores(known, text.as_py())
            if logits is None or not known.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                rejected.append(logits is None)
                continue
            p = softmax(logits / known.temperature)
            best = int(p.argmax())
            names.append(known.languages[best])
            scores.append(float(min(1.0, p[best])))
            rejected.append(scores[-1] < known.threshold)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            ["lang_pred", "score", "rejected"],
        )

    return df.withColumn(result, predicted.asNondeterministic()(text))
