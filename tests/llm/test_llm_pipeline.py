"""The stages against brute force, and whole runs on small tables."""

import random
import re

import corpus_pipeline
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row int"


def prose(rng, n, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, prose(rng, rng.randint(30, 90), "abcde" if i % 2 else "uvwxy"), "xx" if i % 2 else "yy", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more", "xx", "s0") for i in range(6)]
    rows += [(200, None, None, None), (201, "", "xx", "s1"), (202, "12 .. 3", "yy", "s1"), (None, rows[8][1] + " a", None, "s2"), (7, rows[7][1], "xx", "s1")]
    rows += [(300, "start " + rows[20][1][: 150] + " end of it", "yy", "s2")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], COLUMNS)
    docs.write.parquet(f"{path}/documents.parquet")
    benchmark = [(1, rows[20][1]), (2, None)]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages_keep_columns_and_take_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) in (4, 5)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language_id"](spark, docs, path)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect())
    assert ids == sorted((i is None, i) for i, t, _, _ in rows if t and re.search(r"[^\W\d_]", t))

    single = stages["near_duplicates"](spark, kept, path)
    assert single.columns == docs.columns
    ids = [r["doc_id"] for r in single.collect()]
    assert sorted((i is None, i or 0) for i in ids) == sorted([(False, i) for i in range(60)] + [(False, 300), (True, 0)])

    clean = stages["decontamination"](spark, single, path)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(ids) - {20, 300}

    mixed = stages["mixture"](spark, clean, path)
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts) <= set(ids) and max(counts.values()) <= 2

    shards = stages["sharding"](spark, mixed, path).collect()
    assert len(shards) == sum(counts.values())
    sizes = [sum(r["shard"] == s for r in shards) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_run_equals_the_stages_and_reruns_agree(spark, folder):
    path, _ = folder
    first = sorted(map(repr, corpus_pipeline.run(spark, path).collect()))
    assert first and first == sorted(map(repr, corpus_pipeline.run(spark, path).collect()))


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    def words(tag, n=60):
        return " ".join(f"{tag}{i}" for i in range(n))

    rows = [
        (1, words("a")), (2, words("a")), (2, words("b")), (3, words("c")), (3, words("d")), (3, words("d") + " end"), (4, words("e")),
        (4, words("e")), (None, words("f")), (None, words("f")), (None, words("g")), (None, words("a")), (5, words("g")), (None, None),
    ]
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, other int")
    kept = corpus_pipeline.near_duplicate(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"] or 0, (r["text"] or "-").split("0")[0]) for r in kept.collect())
    assert found == [(0, "-"), (0, "f"), (1, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "e"), (5, "g")]
