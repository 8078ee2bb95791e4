import json

import pytest
from pyspark.sql import functions as F

from corpusops.contracts import DEFAULT_CONTRACT, DatasetError, InvalidDatasetError
from corpusops.operators.profile import profile, profile_view
from corpusops.operators.ranking import ordinals, seeded_key, with_place
from corpusops.operators.splits import allocate, allocation, assign_splits, normalise_ratios, parse_ratios
from corpusops.plans.dataset_job import process_dataset
from corpusops.sources.readers import parse_lines, read_json_document


def sample(count=6):
    return [
        {
            "id": f"rec/{i:03d}",
            "meta": {"grammar_rev": "2024a", "seed": 7 + i, "split": "all", "template_index": 10 * i, "is_noisy": i % 2 == 0},
            "task": "lm",
        }
        for i in range(count)
    ]


def raw(spark, rows):
    return parse_lines(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))


def test_profile_of_plain_records(spark):
    stats = profile(profile_view(raw(spark, sample()), DEFAULT_CONTRACT), DEFAULT_CONTRACT).first()
    assert (stats["rows_total"], stats["unique_ids"], stats["noise_rate"]) == (6, 6, 0.5)
    assert stats["task_distribution"] == {"lm": 6}
    assert stats["field_coverage"]["id"] == 1.0 and stats["meta_field_coverage"]["grammar_rev"] == 1.0
    assert stats["ngram_vocab"] == {} and stats["text_length"]["mean"] == 0.0


def test_profile_of_mapping_tasks(spark):
    rows = [
        {"id": None, "meta": {"is_noisy": "false"}, "task": {"type": "cls", "label": "x", "text": "a b  a", "n": 3}},
        {"id": "", "meta": [1], "task": {"type": "cls", "label": "x", "text": "c"}},
        {"meta": {"is_noisy": 0}, "task": {"type": "lm", "text": ""}},
        {"id": "k", "task": {"label": "y"}},
    ]
    stats = profile(profile_view(raw(spark, rows), DEFAULT_CONTRACT), DEFAULT_CONTRACT).first()
    assert stats["unique_ids"] == 3
    assert stats["label_distribution"] == {"cls": {"x": 2}}
    assert stats["ngram_vocab"] == {"cls": 5, "lm": 1}
    assert stats["noise_rate"] == 0.25
    assert stats["field_coverage"] == {"id": 0.25, "meta": 0.75, "task": 1.0}
    lengths = [3, 1, 6, 3, 1, 1, 2, 0, 1]
    mean = sum(lengths) / len(lengths)
    deviation = (sum((x - mean) ** 2 for x in lengths) / len(lengths)) ** 0.5
    assert stats["text_length"]["mean"] == round(mean, 6) and stats["text_length"]["stdev"] == round(deviation, 6)


def test_empty_profile(spark):
    view = profile_view(raw(spark, sample(1)).limit(0), DEFAULT_CONTRACT)
    stats = profile(view, DEFAULT_CONTRACT).first()
    assert stats["rows_total"] == 0 and stats["noise_rate"] == 0.0 and stats["field_coverage"]["id"] == 0.0


def test_flat_profile_counts_top_level_texts(spark):
    rows = [{"id": 1, "task": "lm", "text": "one two"}]
    view = profile_view(raw(spark, rows), DEFAULT_CONTRACT, flat=True)
    assert profile(view, DEFAULT_CONTRACT).first()["ngram_vocab"] == {"lm": 2}


@pytest.mark.parametrize(
    "total, ratios, counts",
    [
        (10, {"train": 0.7, "dev": 0.2, "test": 0.1}, {"train": 7, "dev": 2, "test": 1}),
        (6, {"train": 0.6, "dev": 0.2, "test": 0.2}, {"train": 4, "dev": 1, "test": 1}),
        (6, {"train": 0.5, "dev": 0.3, "test": 0.2}, {"train": 3, "dev": 2, "test": 1}),
        (8, {"train": 0.75, "dev": 0.125, "test": 0.125}, {"train": 6, "dev": 1, "test": 1}),
        (7, {"a": 1, "b": 1, "c": 1}, {"a": 2, "b": 2, "c": 3}),
        (2, {"a": 1, "b": 1, "c": 1, "d": 1}, {"a": 0, "b": 0, "c": 1, "d": 1}),
        (0, {"a": 1}, {"a": 0}),
    ],
)
def test_allocation(spark, total, ratios, counts):
    assert allocate(total, ratios) == counts
    rows = allocation(spark.createDataFrame([(total,)], "total long"), ratios).collect()
    assert {r["split"]: r["rows"] for r in rows} == counts


def test_ratio_errors():
    assert parse_ratios("a=0.6, b=0.4") == {"a": 0.6, "b": 0.4}
    for text in ("", "a", "a=", "=1", "a=x"):
        with pytest.raises(DatasetError):
            parse_ratios(text)
    for ratios in ({}, {"a": -1, "b": 2}, {"a": 0}):
        with pytest.raises(DatasetError):
            normalise_ratios(ratios)


RATIOS = {"train": 0.5, "dev": 0.3, "test": 0.2}


def split_rows(frame, seed=1):
    assigned, counts = assign_splits(frame, RATIOS, seed)
    rows = sorted((r["split"], str(r["id"]), r["text"]) for r in assigned.select("split", "id", "text").collect())
    return rows, counts


@pytest.mark.parametrize("shape", ["unique", "hot_id", "copies", "null_ids", "one_row_many_times"])
def test_splits_are_exact_and_stable(spark, shape):
    n = 3_000
    base = spark.range(n).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    hot = F.col("text") < "t2"
    frame = {
        "unique": base,
        "hot_id": base.withColumn("id", F.when(hot, "hot").otherwise(F.col("id"))),
        "copies": base.withColumn("id", F.when(hot, "hot").otherwise(F.col("id"))).withColumn(
            "text", F.when(hot, "same").otherwise(F.col("text"))
        ),
        "null_ids": base.withColumn("id", F.lit(None).cast("string")),
        "one_row_many_times": base.select(F.lit("x").alias("id"), F.lit("y").alias("text")),
    }[shape]
    rows, counts = split_rows(frame)
    assert counts == allocate(n, RATIOS)
    assert {name: sum(r[0] == name for r in rows) for name in RATIOS} == counts
    assert sorted(r[1:] for r in rows) == sorted((str(r["id"]), r["text"]) for r in frame.collect())
    assert split_rows(frame.repartition(5))[0] == rows
    if shape == "unique":
        assert split_rows(frame, seed=2)[0] != rows


@pytest.mark.parametrize("leaf_rows", [1, 50, 10_000])
@pytest.mark.parametrize("shape", ["unique", "hot_id", "copies"])
def test_ordinals_with_crowded_prefixes(spark, shape, leaf_rows):
    """Any leaf size gives the ranks of a full sort by hash, even if one id owns most rows."""
    base = spark.range(600).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("text"))
    if shape != "unique":
        base = base.withColumn("id", F.when(F.col("text") < "5", "hot").otherwise(F.col("id")))
    if shape == "copies":
        base = base.withColumn("text", F.when(F.col("id") == "hot", "same").otherwise(F.col("text")))
    placed = with_place(base)
    key = seeded_key(placed, 9)
    ranked = ordinals(placed, key, leaf_rows=leaf_rows).select("ordinal", key.by_id.alias("h"), key.by_content.alias("c")).collect()
    assert sorted(r["ordinal"] for r in ranked) == list(range(1, 601))
    in_order = sorted(ranked, key=lambda r: r["ordinal"])
    assert [(r["h"], r["c"]) for r in in_order] == sorted((r["h"], r["c"]) for r in ranked)


def test_process_job(spark, tmp_path):
    source = tmp_path / "corpus.jsonl"
    source.write_text("".join(json.dumps(r) + "\n" for r in sample(10)))
    run = lambda out: process_dataset(spark, str(source), DEFAULT_CONTRACT, "jsonl", RATIOS, 5, str(tmp_path / out))
    first, second = run("one"), run("two")
    manifest = read_json_document(spark, str(tmp_path / "one" / "dataset.manifest.json"))
    assert manifest["dataset_id"] == "corpus" and manifest["grammar_rev"] == "2024a" and manifest["seed"] == 5
    assert {n: s["rows"] for n, s in manifest["splits"].items()} == {"train": 5, "dev": 3, "test": 2}
    assert [s["sha256"] for s in first.manifest["splits"].values()] == [s["sha256"] for s in second.manifest["splits"].values()]
    lines = [spark.read.text(s["path"]) for s in manifest["splits"].values()]
    ids = [json.loads(r[0])["id"] for frame in lines for r in frame.collect()]
    assert sorted(ids) == [f"rec/{i:03d}" for i in range(10)]
    assert first.metrics()["valid_ratio"] == 1.0
    source.write_text(json.dumps({"id": 1}) + "\n")
    with pytest.raises(InvalidDatasetError):
        run("three")


def test_process_empty_dataset(spark, tmp_path):
    source = tmp_path / "none.jsonl"
    source.write_text("\n  \n")
    result = process_dataset(spark, str(source), DEFAULT_CONTRACT, "jsonl", RATIOS, 5, str(tmp_path / "out"))
    assert result.stats["rows_total"] == 0
    assert all(s["rows"] == 0 and s["sha256"] == "" for s in result.manifest["splits"].values())
