"""Profile of a record set: counts, distributions, coverage, vocabulary, text length, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.contracts import Contract
from corpusops.functions.text import split_whitespace
from corpusops.operators.validation import record_of


def profile_view(
    df: DataFrame, contract: Contract, flat: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The narrow projection all statistics read: raw and typed records look the same here.

    ``flat`` also counts top-level ``text``, ``src``, ``tgt`` and ``label`` of records whose
    task is a plain name, which carry no texts of their own otherwise.
    """
    record = record_of(df)
    texts, label = record.task_texts(), record.task_label()
    if flat:
        own = F.array(*[record.string(f) for f in ("text", "src", "tgt", "label")])
        texts = F.concat(texts, F.filter(own, lambda x: x.isNotNull()))
        label = F.coalesce(label, record.string("label"))
    return df.select(
        record.shown("id").alias("id"),
        record.task_type().alias("task_type"),
        label.alias("task_label"),
        texts.alias("texts"),
        record.truthy("meta", "is_noisy").alias("noisy"),
        record.string("meta", "grammar_rev").alias("grammar_rev"),
        F.array(*[record.covered(f) for f in contract.required_fields]).cast("array<boolean>").alias("fields"),
        F.array(*[record.is_mapping("meta") & record.covered("meta", k) for k in contract.meta_required])
        .cast("array<boolean>")
        .alias("meta_fields"),
        *keep,
    )


def _rate(count: Column, total: Column) -> Column:
    """Share with 6 decimals, half-even; 0 for an empty set."""
    return F.bround(F.coalesce(F.try_divide(count, total), F.lit(0.0)), 6)


def unique_ids(view: DataFrame) -> DataFrame:
    """Exact number of ids; a missing id counts as one value. Shuffles ids only."""
    return view.agg(
        (F.count_distinct("id") + F.coalesce(F.max(F.col("id").isNull().cast("long")), F.lit(0))).alias("unique_ids")
    )


def task_distribution(view: DataFrame) -> DataFrame:
    return view.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"))


def label_distribution(view: DataFrame) -> DataFrame:
    kept = view.filter(F.col("task_type").isNotNull() & F.col("task_label").isNotNull())
    return kept.groupBy("task_type", "task_label").agg(F.count(F.lit(1)).alias("n"))


def coverage(view: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Coverage of each name as one wide row; ``column`` holds one flag per name."""
    total = F.count(F.lit(1))
    return view.agg(*[_rate(F.count_if(F.col(column)[i]), total).alias(n) for i, n in enumerate(names)])


def vocabulary_size(view: DataFrame) -> DataFrame:
    """Distinct whitespace tokens per task.

    Tokens are first made distinct within a row, then by the partial aggregation of the task,
    so a frequent token crosses the network once per task rather than once per use.
    """
    tokens = F.array_distinct(F.flatten(F.transform("texts", split_whitespace)))
    return (
        view.filter(F.col("task_type").isNotNull())
        .select("task_type", F.explode(tokens).alias("token"))
        .groupBy("task_type", "token")
        .agg(F.lit(1).alias("one"))
        .groupBy("task_type")
        .agg(F.count("one").alias("vocab_size"))
    )


def _length_sums(texts: Column) -> list[Column]:
    """Count, sum, sum of squares, min, max of text lengths, summed without exploding.

    The sums are exact decimals, so the deviation does not depend on how rows are partitioned.
    """
    lengths = F.transform(texts, lambda t: F.char_length(t).cast("long"))
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return [
        F.sum(F.size(texts).cast("long")).alias("n"),
        F.sum(total.cast("decimal(20,0)")).alias("s1"),
        F.sum(squares.cast("decimal(20,0)")).alias("s2"),
        F.min(F.array_min(lengths)).alias("lo"),
        F.max(F.array_max(lengths)).alias("hi"),
    ]


def _length_stats() -> list[Column]:
    n = F.col("n").cast("double")
    # n*s2 - s1^2 in exact arithmetic before the only rounding step.
    spread = (F.col("n").cast("decimal(18,0)") * F.col("s2").cast("decimal(20,0)")).cast("decimal(38,0)") - (
        F.col("s1").cast("decimal(19,0)") * F.col("s1").cast("decimal(19,0)")
    ).cast("decimal(38,0)")
    zero = F.lit(0.0)
    return [
        F.coalesce(F.bround(F.try_divide(F.col("s1").cast("double"), n), 6), zero).alias("mean"),
        F.coalesce(F.bround(F.try_divide(F.sqrt(spread.cast("double")), n), 6), zero).alias("stdev"),
        F.coalesce(F.col("lo").cast("double"), zero).alias("min"),
        F.coalesce(F.col("hi").cast("double"), zero).alias("max"),
    ]


def text_length(view: DataFrame) -> DataFrame:
    return view.agg(*_length_sums(F.col("texts"))).select(*_length_stats())


def noise_rate(view: DataFrame) -> DataFrame:
    return view.agg(_rate(F.count_if("noisy"), F.count(F.lit(1))).alias("noise_rate"))


def first_grammar_rev(view: DataFrame, order: str) -> DataFrame:
    """First string ``grammar_rev`` in row order."""
    return view.agg(F.min_by("grammar_rev", F.when(F.col("grammar_rev").isNotNull(), F.col(order))).alias("grammar_rev"))


def profile_long(view: DataFrame, contract: Contract) -> DataFrame:
    """All statistics in tidy form: ``(stat, key, subkey, value)``.

    Everything that needs no key is one aggregation over one scan. The id count shuffles ids
    alone; the keyed statistics shuffle partial counts. Tasks and labels come from the same
    grouped counts, so their shuffle is shared.
    """
    total = F.count(F.lit(1))
    scalars = view.agg(
        total.alias("rows_total"),
        _rate(F.count_if("noisy"), total).alias("noise_rate"),
        *[_rate(F.count_if(F.col("fields")[i]), total).alias(f"f{i}") for i in range(len(contract.required_fields))],
        *[_rate(F.count_if(F.col("meta_fields")[i]), total).alias(f"m{i}") for i in range(len(contract.meta_required))],
        *_length_sums(F.col("texts")),
    ).select("*", *_length_stats())
    entries = [
        ("rows_total", "", "rows_total"),
        ("noise_rate", "", "noise_rate"),
        *[("text_length", k, k) for k in ("mean", "stdev", "min", "max")],
        *[("field_coverage", name, f"f{i}") for i, name in enumerate(contract.required_fields)],
        *[("meta_field_coverage", name, f"m{i}") for i, name in enumerate(contract.meta_required)],
    ]
    long = scalars.select(
        F.inline(F.array(*[_entry(stat, F.lit(key), F.lit(""), F.col(column)) for stat, key, column in entries]))
    )
    counts = view.groupBy("task_type", "task_label").agg(F.count(F.lit(1)).alias("n"))
    tasks = counts.groupBy("task_type").agg(F.sum("n").alias("n"))
    labels = counts.filter(F.col("task_type").isNotNull() & F.col("task_label").isNotNull())
    parts = [
        (unique_ids(view), "unique_ids", F.lit(""), F.lit(""), "unique_ids"),
        (tasks, "task_distribution", F.coalesce("task_type", F.lit("null")), F.lit(""), "n"),
        (labels, "label_distribution", F.col("task_type"), F.col("task_label"), "n"),
        (vocabulary_size(view), "ngram_vocab", F.col("task_type"), F.lit(""), "vocab_size"),
    ]
    for frame, stat, key, subkey, value in parts:
        long = long.unionByName(frame.select(F.inline(F.array(_entry(stat, key, subkey, F.col(value))))))
    return long


def _entry(stat: str, key: Column, subkey: Column, value: Column) -> Column:
    return F.struct(
        F.lit(stat).alias("stat"), key.alias("key"), subkey.alias("subkey"), value.cast("double").alias("value")
    )


def profile(view: DataFrame, contract: Contract) -> DataFrame:
    """All statistics as one row. It gathers one entry per statistic, task and label name."""

    def scalar(stat: str, key: str = "") -> Column:
        return F.max(F.when((F.col("stat") == stat) & (F.col("key") == key), F.col("value")))

    def mapping(stat: str, as_type: str) -> Column:
        entry = F.struct("key", F.col("value").cast(as_type).alias("value"))
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("stat") == stat, entry))))

    label = F.struct("key", "subkey", F.col("value").cast("long").alias("n"))
    labels = F.array_sort(F.collect_list(F.when(F.col("stat") == "label_distribution", label)))
    nested = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform("labels", lambda e: e["key"])),
            lambda task: F.struct(
                task,
                F.map_from_entries(
                    F.transform(
                        F.filter("labels", lambda e: e["key"] == task), lambda e: F.struct(e["subkey"], e["n"])
                    )
                ),
            ),
        )
    )
    return (
        profile_long(view, contract)
        .agg(
            scalar("rows_total").cast("long").alias("rows_total"),
            scalar("unique_ids").cast("long").alias("unique_ids"),
            mapping("task_distribution", "long").alias("task_distribution"),
            labels.alias("labels"),
            mapping("field_coverage", "double").alias("field_coverage"),
            mapping("meta_field_coverage", "double").alias("meta_field_coverage"),
            mapping("ngram_vocab", "long").alias("ngram_vocab"),
            F.struct(*[scalar("text_length", k).alias(k) for k in ("mean", "stdev", "min", "max")]).alias("text_length"),
            scalar("noise_rate").alias("noise_rate"),
        )
        .withColumn("labels", nested)
        .withColumnRenamed("labels", "label_distribution")
    )
