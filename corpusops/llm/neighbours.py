"""Approximate nearest neighbours over learned partitions.

Fitting uses a bounded sample, on the driver: the exact neighbour graph of the sample is cut into
balanced parts by recursive spectral bisection with swap refinement, and a softmax classifier learns
to predict in which parts the neighbours of a vector lie. The number of parts grows with the square
root of the table, and the number of parts probed is the smallest that finds ``RECALL`` of the
neighbours of sampled queries.

Every vector, sampled or not, is stored in its most probable part. Vectors of a part are cut into
blocks of bounded size, and so are the queries sent to it; Spark brings each pair of blocks
together, and each reranks its vectors exactly in double precision. The search has two rounds: the
few most probable parts first, then the others, whose queries carry the last score of the first
round, so that a block returns only what can still win. Rows per query then do not grow with the
number of parts probed. What remains is merged by a window with a group limit.

Equal vectors are one class. Ties go to the smaller id, so no query can use more than the ``k + 1``
smallest ids of a class, and equal queries share one search; a vector that makes up a third of
the table costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm.common import bound_batches
from corpusops.session import cut_lineage

SAMPLE = 8_192
GRAPH_DEGREE = 10
PARTS_PER_ROOT = 0.25  # parts for each unit of the square root of the rows
ROWS_PER_BLOCK = 4_096
QUERIES_PER_BLOCK = 4_096
FIRST_SHARE = 8  # the first round takes one in so many of the parts probed
RECALL = 0.95
PROBE_QUERIES = 512
EPOCHS = 40
TIE = 1e-9  # scores this near to the last one kept are summed again before they are ranked


@dataclass
class Router:
    """Linear softmax over parts, and how many of them a query probes."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.bias)

    def ranked(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each vector, best first; ties to the lower number."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.argsort(-(unit @ self.weights + self.bias), axis=1, kind="stable")[:, :n].astype(np.int32)


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each vector by inner product, exact, in blocks of rows."""
    n = len(vectors)
    k = min(k, n - 1)
    near = np.empty((n, max(k, 0)), np.int64)
    for start in range(0, n, 512):
        scores = vectors[start : start + 512] @ vectors.T
        rows = np.arange(len(scores))
        scores[rows, start + rows] = -np.inf
        if k:
            near[start : start + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return near


def bisect(nodes: np.ndarray, source: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halve a graph: True for the nodes of the second half. ``source`` and ``target`` index ``nodes``."""
    n = len(nodes)
    degree = np.maximum(np.bincount(source, minlength=n), 1e-9)
    root = np.sqrt(degree)
    trivial = root / np.linalg.norm(root)
    x = rng.normal(size=n)
    for _ in range(60):
        x -= trivial * (trivial @ x)
        x /= np.linalg.norm(x) or 1.0
        x = 0.5 * x + 0.5 * np.bincount(source, x[target] / (root[source] * root[target]), minlength=n)
    side = np.zeros(n, bool)
    side[np.argsort(x / root, kind="stable")[n // 2 :]] = True
    best, cut = side.copy(), int((side[source] != side[target]).sum())
    for _ in range(20):
        # Swap the nodes that have most edges across, as many from each half.
        gain = np.bincount(source, np.where(side[source] != side[target], 1.0, -1.0), minlength=n)
        left = np.flatnonzero(~side)
        right = np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        most = max(1, n // 50)
        pairs = min(most, len(left), len(right))
        swap = int((gain[left[:pairs]] + gain[right[:pairs]] > 0).sum())
        if not swap:
            break
        side[left[:swap]], side[right[:swap]] = True, False
        now = int((side[source] != side[target]).sum())
        if now >= cut:
            break
        best, cut = side.copy(), now
    return best


def balanced_parts(near: np.ndarray, levels: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each node after ``levels`` bisections; parts differ by one node at most per level."""
    n = len(near)
    source = np.repeat(np.arange(n), near.shape[1])
    target = near.ravel()
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        following = np.zeros(n, np.int64)
        same = part[source] == part[target]
        source, target = source[same], target[same]
        for number in range(int(part.max()) + 1):
            nodes = np.flatnonzero(part == number)
            inside = part[source] == number
            local = np.full(n, -1)
            local[nodes] = np.arange(len(nodes))
            second = bisect(nodes, local[source[inside]], local[target[inside]], rng) if len(nodes) > 1 else np.zeros(len(nodes), bool)
            following[nodes] = 2 * number + second
        part = following
    return part


def train_router(unit: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    """Softmax regression on soft targets by Adam."""
    parts = target.shape[1]
    weights, bias = np.zeros((unit.shape[1], parts)), np.zeros(parts)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
    step, size = 0, 256
    for _ in range(EPOCHS):
        order = rng.permutation(len(unit))
        for start in range(0, len(order), size):
            rows = order[start : start + size]
            logits = unit[rows] @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            step += 1
            for i, (value, grad) in enumerate(((weights, unit[rows].T @ error), (bias, error.sum(axis=0)))):
                m, v = state[2 * i], state[2 * i + 1]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(weights, bias, 1)


def fit_router(vectors: np.ndarray, rows: int, k: int, recall: float = RECALL, seed: int = 3) -> Router:
    """Router for a table of ``rows`` vectors from a sample of them."""
    levels = int(np.ceil(np.log2(max(1, PARTS_PER_ROOT * np.sqrt(rows)))))
    levels = min(levels, max(0, int(np.log2(max(1, len(vectors) // 16)))))
    if not levels:
        return Router(np.zeros((vectors.shape[1], 1)), np.zeros(1), 1)
    rng = np.random.default_rng(seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = neighbour_graph(vectors.astype(np.float32), GRAPH_DEGREE)
    part = balanced_parts(near, levels, rng)
    parts = 1 << levels
    own = np.eye(parts)[part]
    router = train_router(unit, 0.5 * own + 0.5 * own[near].mean(axis=1), rng)

    # Probe until the sample finds nearly all of its own neighbours.
    queries = rng.permutation(len(unit))[:PROBE_QUERIES]
    scores = vectors[queries] @ vectors.T
    scores[np.arange(len(queries)), queries] = -np.inf
    k = min(k, len(unit) - 1)
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    home = router.ranked(vectors, 1)[:, 0]
    order = router.ranked(vectors[queries], parts)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts, dtype=np.int32)[None, :].repeat(len(order), 0), axis=1)
    needed = np.take_along_axis(place, home[true], axis=1)
    found = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    router.probes = int(np.argmax(found >= recall)) + 1 if recall < 1 else parts
    return router


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def routed(vector: Column, shared, n: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def route(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        ranked = shared.value.ranked(matrix(vectors), n)
        return pa.ListArray.from_arrays(np.arange(0, ranked.size + 1, n, dtype=np.int32), ranked.ravel())

    return route(vector)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v``: finite, non-zero vectors of the table's usual length, as doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sized = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = sized.filter(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    lengths = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def _rerank(k: int):
    """The ``k`` best of a block for each query whose score is not below the query's ``least``."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({"key": pa.array([], pa.string()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(queries) or not len(rows):
            return empty
        q, v = matrix(queries["q"].combine_chunks()), matrix(rows["v"].combine_chunks())
        floor = queries["least"].to_numpy()
        ids, keys = rows["vec_id"].to_numpy(), queries["key"].to_pylist()
        found_keys, found_ids, found_scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        for start in range(0, len(q), 256):
            scores = q[start : start + 256] @ v.T
            for i, row in enumerate(scores):
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                least = max(least, floor[start + i])
                pick = np.flatnonzero(row >= least - TIE * max(1.0, abs(least)) if np.isfinite(least) else row == row)
                exact = (q[start + i] * v[pick]).sum(axis=1)
                order = np.lexsort((ids[pick], -exact))[:k]
                found_keys += [keys[start + i]] * len(order)
                found_ids.append(ids[pick][order])
                found_scores.append(exact[order])
        return pa.table({"key": pa.array(found_keys, pa.string()), "vec_id": np.concatenate(found_ids), "score": np.concatenate(found_scores)})

    return run


def _search(sent: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """``key, vec_id, score``: the best of each block of ``stored`` for the queries ``part, key, q, least``.

    Both sides of a part are cut into blocks, so no group grows with the table; a vector travels once for
    each block of queries its part has.
    """
    # One row a part on both sides, of the order of the square root of the table.
    blocks = F.broadcast(stored.groupBy("part").agg(F.ceil(F.count("*") / ROWS_PER_BLOCK).cast("int").alias("blocks")))
    turns = F.broadcast(sent.groupBy("part").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("turns")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")
    rows = stored.join(blocks, "part").join(turns, "part").select("part", block, each("turns").alias("turn"), "vec_id", "v")
    turn = F.pmod(F.xxhash64("key"), F.col("turns")).cast("int").alias("turn")
    asked = sent.join(blocks, "part").join(turns, "part").select("part", each("blocks").alias("block"), turn, "key", "q", "least")
    place = ["part", "block", "turn"]
    found = asked.groupBy(*place).cogroup(rows.groupBy(*place)).applyInArrow(_rerank(k), "key string, vec_id long, score double")
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of every row with ``is_query``.

    ``is_query`` is a condition on ``vec_id``. Nearness is the largest inner product of the original
    vectors in double precision; ties go to the smaller id, and a query does not find its own id.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without an id and vectors of another length than the most frequent one. Rows that share an id
    are one candidate for every vector they hold. The router is fitted on about ``sample`` vectors,
    chosen by hash, and probes as many parts as give its queries ``recall`` (1: all parts, which is
    exact); every row is indexed. Fewer candidates than ``k`` give all; an empty table
    gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    named = usable(vectors, vec_id, vector).withColumn("key", F.md5(F.col("v").cast("string")))
    smallest = W.partitionBy("key").orderBy("vec_id")
    classes = named.dropDuplicates(["vec_id", "key"]).withColumn("turn", F.row_number().over(smallest)).filter(F.col("turn") <= k + 1)
    classes = cut_lineage(classes)
    n = classes.count()

    share = min(1.0, sample / max(n, 1))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / (1 << 30)
    picked = classes.filter(place < share).select("v").orderBy("v").limit(2 * sample).toArrow() if n else None
    fitted = picked is not None and len(picked) > 1
    router = fit_router(matrix(picked["v"].combine_chunks()), n, k, recall) if fitted else None
    dimension = 1 if router is None else len(router.weights)
    shared = spark.sparkContext.broadcast(router or Router(np.zeros((dimension, 1)), np.zeros(1), 1))
    probes = shared.value.probes

    stored = classes.withColumn("part", F.element_at(routed(F.col("v"), shared, 1), 1) if fitted else F.lit(0))
    stored = cut_lineage(stored)
    cells = stored.select("part", "vec_id", "v")

    asked = named.filter(is_query).select("vec_id", "key")
    searched = stored.filter("turn = 1").join(asked.select("key").distinct(), "key", "left_semi").select("key", "v")
    parts = routed(F.col("v"), shared, probes) if fitted else F.array(F.lit(0))
    queries = cut_lineage(searched.select("key", F.col("v").alias("q"), parts.alias("parts")))
    first = -(-probes // FIRST_SHARE)
    sent = queries.select(F.explode(F.slice("parts", 1, first)).alias("part"), "key", "q", F.lit(float("-inf")).alias("least"))
    merged = cut_lineage(_search(sent, cells, k + 1))
    if probes > first:
        last = merged.filter(F.col("_rank") == k + 1).select("key", F.col("score").alias("least"))
        rest = queries.join(last, "key", "left").select(
            F.explode(F.slice("parts", first + 1, probes)).alias("part"), "key", "q",
            F.coalesce("least", F.lit(float("-inf"))).alias("least"),
        )
        both = merged.drop("_rank").unionByName(_search(rest, cells, k + 1).drop("_rank"))
        merged = _best(both, k + 1)
    lists = merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_rank", "vec_id", "score"))).alias("near"))

    answers = asked.select(F.col("vec_id").alias("query_id"), "key").distinct().join(lists, "key")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
