"""How filters interact: what each removes in every order, with exact duplicates found in radix tries of the texts.

1. **Gather**: tasks fold rows of equal text, part and labels into one record with its count, its smallest id and
   the rows that have it, as long as they fit a bounded table. A text that a third of all rows share thus
   leaves each task a few times only.
2. **Range-partition** by adaptive prefixes: records are dealt by the first ``PREFIX`` characters, and where many texts share
   these by the hash of the whole text. Equal texts meet in one task, in the order of their smallest ids.
3. **Tries**: the full texts of a stretch of prefixes go into a compressed trie. A terminal holds the smallest id,
   known from the first record that reaches it, the failing filters of the text as a mask, and the counts of its
   records. When the trie exceeds ``TRIE_BYTES`` it is traversed: rows above the smallest id also fail filter E. It
   is then emptied, except while texts of the hash at hand follow, so neither many prefixes nor one hot text pile up.
4. **Reduce**: counts of a part and mask are added up; 32 masks a part answer all 120 orders.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm.common import as_bytes, bound_batches
from corpusops.session import join_small

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
PREFIX = 64
TRIE_BYTES = 24 << 20
FOLD_BYTES = 16 << 20
# What an entry of a task's table takes besides its text.
ENTRY_BYTES = 400

UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"
# UTF-8 bytes that begin no code point.
CONTINUED = bytes(range(0x80, 0xC0))

RECORDS = "_text string, _part string, _good boolean, _toxic boolean, _n long, _first long, _at_first long, _unnamed long"
COUNTS = "part string, mask int, good boolean, toxic boolean, n long"


def failing(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()
    points = len(text.translate(None, CONTINUED))
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * upper > 2 * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


class Terminal:
    __slots__ = ("first", "mask", "counts")

    def __init__(self, first: int | None, mask: int):
        self.first, self.mask = first, mask
        self.counts: dict[tuple, list[int]] = {}


class Node:
    __slots__ = ("edges", "terminal")

    def __init__(self) -> None:
        # First byte of an edge: its whole label and the node below.
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.terminal: Terminal | None = None


class RadixTrie:
    """Compressed trie of whole texts."""

    def __init__(self) -> None:
        self.root = Node()

    def node(self, text: bytes) -> Node:
        """The node of ``text``; edges are made and split as needed."""
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                below = Node()
                node.edges[text[at]] = (text[at:], below)
                return below
            label, below = edge
            if not text.startswith(label, at):
                size = _shared(label, text, at)
                middle = Node()
                middle.edges[label[size]] = (label[size:], below)
                node.edges[text[at]] = (label[:size], middle)
                label, below = label[:size], middle
            node, at = below, at + len(label)
        return node

    def terminals(self) -> Iterator[Terminal]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.terminal is not None:
                yield node.terminal
            stack.extend(below for _, below in node.edges.values())


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Common prefix of an edge and the text from ``at``, by halving."""
    low, high = 1, min(len(label), len(text) - at)
    while low < high:
        half = (low + high + 1) // 2
        if text.startswith(label[:half], at):
            low = half
        else:
            high = half - 1
    return low


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    size = 0

    def batch() -> pa.RecordBatch:
        keys, values = list(zip(*held)), list(zip(*held.values()))
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
        names = [f.split()[0] for f in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([*keys, *values], kinds)], names)

    for rows in batches:
        for text, part, good, toxic, doc_id in zip(*(c.to_pylist() for c in rows.columns)):
            key = (text, part, good, toxic)
            entry = held.get(key)
            if entry is None:
                # Rows, smallest id, rows with it, rows without id.
                entry = held[key] = [0, None, 0, 0]
                size += 2 * len(text) + ENTRY_BYTES
            entry[0] += 1
            if doc_id is None:
                entry[3] += 1
            elif entry[1] is None or doc_id < entry[1]:
                entry[1:3] = doc_id, 1
            elif doc_id == entry[1]:
                entry[2] += 1
            if size > FOLD_BYTES:
                yield batch()
                held.clear()
                size = 0
    if held:
        yield batch()


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, held, last = RadixTrie(), 0, None

    def traverse() -> pa.RecordBatch:
        total: dict[tuple, int] = {}
        for terminal in trie.terminals():
            for (part, good, toxic), (unique, repeated) in terminal.counts.items():
                for mask, n in ((terminal.mask, unique), (terminal.mask | DUPLICATE, repeated)):
                    if n:
                        total[part, mask, good, toxic] = total.get((part, mask, good, toxic), 0) + n
            terminal.counts.clear()
        columns = [[k[i] for k in total] for i in range(4)] + [list(total.values())]
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in COUNTS.split(", ")])

    for rows in batches:
        texts = as_bytes(rows.column(0))
        for text, part, good, toxic, n, first, at_first, unnamed, key in zip(texts, *(c.to_pylist() for c in rows.columns[1:])):
            if held > TRIE_BYTES:
                yield traverse()
                held = 0
                if key != last:
                    trie = RadixTrie()
            node = trie.node(text)
            if node.terminal is None:
                node.terminal = Terminal(first, failing(text))
                held += len(text) + ENTRY_BYTES
            terminal, last = node.terminal, key
            counts = terminal.counts.setdefault((part, good, toxic), [0, 0])
            held += ENTRY_BYTES
            unique = unnamed + (at_first if first == terminal.first else 0)
            counts[0] += unique
            counts[1] += n - unique
    yield traverse()


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: rows of each part by the filters they fail (bit 0 is filter A).

    A null text is empty, a null part the empty string. A row fails E if a smaller id has the same text; a row with a
    null id neither fails E nor makes others fail it. ``labels`` (``doc_id, quality, toxic``) hold for every
    row of an id; an id labelled more than once has a label if any of its rows has it, and labels of null ids are
    not used. Other columns are not read. Labels are broadcast only if they are counted to be few.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    named = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    marks = named.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"_{n}") for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = docs.select(
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("_part"),
        F.col(f"`{doc_id}`").cast("long").alias("_id"),
    )
    marked = join_small(rows, marks.filter("_good or _toxic"), ["_id"], "left", row_bytes=32)
    no = F.lit(False)
    marked = marked.select("_text", "_part", F.coalesce("_good", no).alias("_good"), F.coalesce("_toxic", no).alias("_toxic"), "_id")
    folded = marked.mapInArrow(_fold, RECORDS)
    prefix, whole = F.substring("_text", 1, PREFIX), F.xxhash64("_text")
    dealt = folded.withColumns({"_prefix": prefix, "_hash": whole}).repartitionByRange("_prefix", "_hash")
    ordered = dealt.sortWithinPartitions("_prefix", "_hash", F.col("_first").asc_nulls_last())
    judged = ordered.drop("_prefix").mapInArrow(_judge, COUNTS)
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return judged.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def interactions(masks: DataFrame) -> DataFrame:
    """All orders of the filters over the counts of :func:`mask_counts`: one row a part, order and step.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (failing, but removed earlier), ``unique_fails`` (failing
    this filter only), ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``, what the filter removes
    summed over all orders. A part has all rows, zeros included; no parts, no rows.
    """
    size = len(FILTERS)
    sums = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for c in ("n", "good", "toxic") for m in range(1 << size)]
    cells = 1 << size
    counted = masks.groupBy("part").agg(*(s.alias(f"c{k}") for k, s in enumerate(sums)))
    counted = counted.select("part", *(F.array(*(f"c{k * cells + m}" for m in range(cells))).alias(c) for k, c in enumerate(("n", "good", "toxic"))))

    def total(column: str, chosen) -> Column:
        """Sum over the masks for which ``chosen(mask)`` holds."""
        zero = F.lit(0).cast("long")
        return F.aggregate(F.sequence(F.lit(0), F.lit(cells - 1)), zero, lambda s, m: s + F.when(chosen(m), F.get(column, m)).otherwise(zero))

    # What a filter removes depends only on the set that went before it.
    bit, before = F.col("bit"), F.col("before")
    fails, earlier = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    steps = F.explode(F.sequence(F.lit(0), F.lit(cells * size - 1)))
    cases = counted.select("*", steps.alias("_k")).select("*", F.get(F.array(*(F.lit(1 << k) for k in range(size))), F.col("_k") % size).alias("bit"), F.floor(F.col("_k") / size).cast("int").alias("before"))
    cases = cases.filter(bit.bitwiseAND(before) == 0).select(
        "part",
        "bit",
        "before",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & ~earlier(m)).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("n", bit).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~earlier(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & ~earlier(m)).alias("toxic_lost"),
    )
    # So many orders begin with the filters of a set, then the filter.
    weights = F.array(*(F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size)))
    weighted = F.col("removed") * F.get(weights, F.bit_count("before"))
    # 80 rows a part, so the window is cheap and the tries are walked once.
    cases = cases.withColumn("shapley", F.sum(weighted).over(Window.partitionBy("part", "bit")))
    orders = ["".join(p) for p in permutations(FILTERS)]
    spark = masks.sparkSession
    order_rows = spark.range(len(orders)).select(F.get(F.array(*map(F.lit, orders)), F.col("id").cast("int")).alias("filter_order"))
    placed = order_rows.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    bits = F.create_map(*(x for k, c in enumerate(FILTERS) for x in (F.lit(c), F.lit(1 << k))))
    letters = F.split(F.expr("substring(filter_order, 1, step - 1)"), "")
    earlier_bits = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda s, c: s + bits[c])
    placed = placed.select("filter_order", "step", bits[F.expr("substring(filter_order, step, 1)")].alias("bit"), earlier_bits.alias("before"))
    # 600 rows, whatever the tables.
    return cases.join(F.broadcast(placed), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """Interactions of the five filters over all ``docs``; see :func:`mask_counts` and :func:`interactions`."""
    return interactions(mask_counts(docs, labels, text, doc_id, part))
