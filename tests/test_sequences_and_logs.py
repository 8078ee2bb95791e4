import json
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusops.contracts import DEFAULT_CONTRACT, DatasetError
from corpusops.functions import arrays
from corpusops.operators import report, runlog, sequences
from corpusops.operators.validation import check, split_valid
from corpusops.plans.queries import QUERIES
from corpusops.plans.run_tables import RunLog, read_table
from corpusops.sources.readers import is_object, parse_lines, read_sequences
from corpusops.sources.writers import append_metrics
from corpusops.streaming import jobs

SCHEMA = "seq_id long, input_ids array<int>, attention_mask array<int>"


def allowed(q, k, window, causal, n_global, size):
    g = min(n_global, size)
    near = abs(q - k) <= window and (k <= q or not causal)
    return near or k < g or q < g


@pytest.mark.parametrize("window, causal, n_global", [(2, True, 0), (1, False, 0), (1, True, 2), (0, False, 3), (3, False, 1), (2, True, 50)])
def test_context_pairs_by_brute_force(spark, window, causal, n_global):
    pick = random.Random(3)
    rows = [(i, [pick.randrange(6) for _ in range(pick.randrange(0, 12))], None) for i in range(12)]
    expected = Counter(
        (ids[q], ids[k])
        for _, ids, _ in rows
        for q in range(len(ids))
        for k in range(len(ids))
        if allowed(q, k, window, causal, n_global, len(ids))
    )
    found = sequences.context_pairs(spark.createDataFrame(rows, SCHEMA), window, causal, n_global).collect()
    assert {(r["query"], r["key"]): r["pairs"] for r in found} == expected


def test_context_pairs_golden(spark):
    one = spark.createDataFrame([(0, list(range(8)), None)], SCHEMA)
    keys = sequences.context_pairs(one, 2, True).filter("query = 5").collect()
    assert sorted(r["key"] for r in keys) == [3, 4, 5]
    with pytest.raises(DatasetError):
        sequences.context_pairs(one, -1, True)


def test_means(spark):
    one = spark.createDataFrame([(0, [4, 8, 0, 2], [1, 1, 0, 1])], SCHEMA)
    run = lambda frame: frame.first()["mean"]
    assert run(sequences.prefix_mean(one)) == [4.0, 6.0, 6.0, 14 / 3]
    assert run(sequences.prefix_mean(one, causal=False)) == [14 / 3] * 4
    assert run(sequences.sliding_mean(one, 1)) == [4.0, 6.0, 8.0, 2.0]
    assert run(sequences.sliding_mean(one, 1, causal=False)) == [6.0, 6.0, 5.0, 2.0]


def test_means_of_odd_rows_without_a_shuffle(spark):
    rows = [(0, [], None), (1, [5], None), (2, None, None), (3, [1, 2, 3], [0, 0, 0]), (4, [2, None, 4], None)]
    frame = sequences.prefix_mean(spark.createDataFrame(rows, SCHEMA))
    assert {r["seq_id"]: r["mean"] for r in frame.collect()} == {0: [], 1: [5.0], 2: None, 3: [0.0] * 3, 4: [2.0, 2.0, 3.0]}
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_means_of_long_rows_by_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i, n in enumerate([127, 128, 129, 256, 700]):
        ids = [rng.choice([None, *range(50)]) for _ in range(n)]
        rows.append((i, ids, None if i == 1 else [rng.choice([None, 0, 1, 1]) for _ in range(n + rng.choice([-9, 0, 9]))]))
    table = spark.createDataFrame(rows, SCHEMA)
    for frame, reach, ahead in ((sequences.prefix_mean(table), 10**6, 0), (sequences.sliding_mean(table, 5, False), 5, 5)):
        found = {r["seq_id"]: r["mean"] for r in frame.collect()}
        for i, ids, mask in rows:
            kept = [x if x is not None and (mask is None or p < len(mask) and mask[p]) else None for p, x in enumerate(ids)]
            spans = [[x for x in kept[max(0, p - reach) : p + ahead + 1] if x is not None] for p in range(len(ids))]
            assert found[i] == [sum(x) / len(x) if x else 0.0 for x in spans]


def test_batches(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"input_ids":[101,5,2]}\n{"input_ids":[7],"attention_mask":[1]}\n{"input_ids":[9,9],"attention_mask":[1,0]}\n')
    rows = read_sequences(spark, str(tmp_path / "s.jsonl")).withColumn("row", F.monotonically_increasing_id() + 1)
    padded = sequences.pad_batches(rows, 2, pad_id=0).orderBy("row").collect()
    assert [r["input_ids"] for r in padded] == [[101, 5, 2], [7, 0, 0], [9, 9]]
    assert [r["attention_mask"] for r in padded] == [[1, 1, 1], [1, 0, 0], [1, 0]]
    assert [r["batch"] for r in padded] == [0, 0, 1]
    assert sequences.over_length(rows, 2).count() == 1
    with pytest.raises(Exception, match="exceeds 2"):
        sequences.require_max_length(rows, 2).collect()


def test_labels_and_template(spark):
    row = spark.createDataFrame([(0, [5, 6, 7], [1, 1, 0]), (1, [5], None)], SCHEMA).select(
        arrays.shift_labels(F.col("input_ids"), F.col("attention_mask")).alias("labels"),
        arrays.mask_labels(F.col("input_ids"), F.col("attention_mask")).alias("given"),
        arrays.template(F.col("input_ids"), 1, 2, 4).alias("single"),
        arrays.template(F.col("input_ids"), 1, 2, 4, F.col("input_ids")).alias("pair"),
        arrays.batch_tokens(F.col("input_ids"), F.col("attention_mask")).alias("tokens"),
    )
    first, second = row.collect()
    assert first["labels"] == [6, -100] and second["labels"] == []
    assert first["given"] == [5, 6, -100] and second["given"] == [5]
    assert first["single"] == [1, 5, 6, 7, 2] and first["pair"] == [1, 5, 6, 7, 4, 5, 6, 7, 2]
    assert (first["tokens"], second["tokens"]) == (2, 1)


def test_report_percentiles_and_empty(spark):
    samples = spark.createDataFrame([("a", "lm", n, 1) for n in (1, 2, 3, 10)], "split string, task string, n_tokens long, n_unk long")
    row = report.token_metrics(report.length_histogram(samples)).first()
    assert abs(row["tokens_len_p95"] - 8.95) < 1e-9 and row["tokens_len_p50"] == 2.5
    assert row["oov_rate"] == 0.25 and row["avg_tokens_per_sample"] == 4.0
    empty = report.token_metrics(report.length_histogram(samples.limit(0))).first()
    assert empty["num_samples"] == 0 and empty["tokens_len_p95"] == 0.0 and empty["oov_rate"] == 0.0


def test_tags_and_flatten(spark):
    pairs = spark.createDataFrame([(["k1=v1", " k2 = a=b ", "none", "k1=last"],)], "p array<string>")
    assert pairs.select(arrays.parse_tags(F.col("p"))).first()[0] == {"k1": "last", "k2": "a=b"}
    assert runlog.flatten({"a": 1, "b": {"c": 2}}) == {"a": 1, "b.c": 2}


def test_best_so_far_over_blocks(spark):
    pick = random.Random(1)
    rows = [(pick.randrange(2), step, pick.random()) for step in range(300)]
    best, expected = {}, {}
    for run, step, loss in rows:
        best[run] = min(best.get(run, 9.0), loss)
        expected[run, step] = best[run]
    found = runlog.best_so_far(spark.createDataFrame(rows, "run long, step long, loss double"), block_steps=17)
    assert {(r["run"], r["step"]): r["best"] for r in found.collect()} == expected


def test_eval_summary_empty_and_capped(spark):
    log = spark.createDataFrame([(50.0, 2), (10.0, 2)], "loss double, n_tokens long")
    row = runlog.eval_summary(log).first()
    assert row["loss"] == 30.0 and abs(row["ppl"] - 2.718281828459045**20) < 1.0
    assert runlog.eval_summary(log.limit(0)).first()["loss"] == 0.0


def test_registry_order(spark):
    schema = "tokenizer_id string, created_at string"
    old = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", None)], schema)
    new = spark.createDataFrame([("a", "2"), ("c", "4")], schema)
    rows = runlog.newest_first(runlog.upsert(old, new)).collect()
    assert [(r[0], r[1]) for r in rows] == [("c", "4"), ("b", "3"), ("a", "2"), ("d", None)]


def test_run_tables(spark, tmp_path):
    path = str(tmp_path / "runs")
    RunLog(spark, path, "e", "off", enabled=False).log_params({"a": 1})
    assert not (tmp_path / "runs").exists()
    parent = RunLog(spark, path, "e", "parent", tags={"k": "v"})
    child = RunLog(spark, path, "e", "child", parent_run_id=parent.run_id)
    child.log_params({"a": 1, "b": {"c": True}})
    with child:
        child.log_metrics({"loss": 1}, step=3)
        assert not (tmp_path / "runs" / "metrics").exists()
    child.log_json({"x": 1}, "x.json")
    assert {(r["param"], r["value"]) for r in read_table(spark, path, "params").collect()} == {("a", "1"), ("b.c", "True")}
    assert read_table(spark, path, "metrics").first()["value"] == 1.0
    nested = runlog.children(read_table(spark, path, "runs")).collect()
    assert [(r["run_id"], r["parent_run_id"]) for r in nested] == [(child.run_id, parent.run_id)]


def test_metrics_log_as_stream(spark, tmp_path):
    log = str(tmp_path / "metrics")
    for n in range(3):
        append_metrics(spark, log, {"rows_total": 10 + n, "noise_rate": 0.5})
    out = str(tmp_path / "out")
    read = lambda: {r["metric"]: (r["n"], r["total"]) for r in jobs.tail_totals(jobs.read_metrics_stream(spark, log), out).collect()}
    assert read() == {"rows_total": (3, 33.0), "noise_rate": (3, 1.5)}
    append_metrics(spark, log, {"rows_total": 7})
    assert read() == {"rows_total": (4, 40.0), "noise_rate": (3, 1.5)}


def test_stream_validation_equals_batch(spark, tmp_path):
    meta = {"grammar_rev": "v", "seed": 1, "split": "t", "template_index": 0}
    source = tmp_path / "in"
    source.mkdir()
    for part in range(3):
        rows = [{"id": f"{part}-{i}", "meta": meta if i % 3 else {}, "task": "lm"} for i in range(20)]
        (source / f"{part}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = spark.readStream.text(str(source))
    valid, quarantine = jobs.validate_stream(stream, DEFAULT_CONTRACT, str(tmp_path / "out"))
    batch = check(parse_lines(spark.read.text(str(source))).filter(is_object()), DEFAULT_CONTRACT)
    good, bad = split_valid(batch)
    values = lambda frame: sorted(r["value"] for r in frame.select("value").collect())
    assert values(valid) == values(good) and values(quarantine) == values(bad)


@pytest.mark.parametrize("files", [None, 3, 0])
def test_table_streams_read_files_and_folders(spark, tmp_path, files):
    """A table may be one file, a folder of files, or an empty folder."""
    rows = pa.table({"doc_id": [9, 10, 5], "lang": ["en"] * 3, "source": ["web"] * 3, "text": ["a", "b", "c"]})
    events = pa.table({"event_type": ["click", "view", "click"], "value": [1.0, 2.0, 0.5]})
    for name, table in (("documents", rows), ("events", events)):
        path = tmp_path / f"{name}.parquet"
        if files is None:
            pq.write_table(table, path)
        else:
            spark.createDataFrame(table.to_pandas()).limit(files).repartition(max(files, 1)).write.parquet(str(path))
    found = QUERIES["st2_stream_validate"](spark, str(tmp_path)).collect()
    totals = {r["metric"]: r["total"] for r in QUERIES["st1_metrics_tail"](spark, str(tmp_path)).collect()}
    sides = [(5, "quarantine"), (9, "valid"), (10, "valid")]
    assert sorted((r["doc_id"], r["side"]) for r in found) == ([] if files == 0 else sides)
    assert totals == ({} if files == 0 else {"click": 1.5, "view": 2.0})


def test_stream_without_files_is_empty(spark, tmp_path):
    lines = spark.readStream.text(str(tmp_path))
    assert [f.count() for f in jobs.validate_stream(lines, DEFAULT_CONTRACT, str(tmp_path / "out"))] == [0, 0]
