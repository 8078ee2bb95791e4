import json

import pytest

from corpusops.contracts import DEFAULT_CONTRACT, Contract, ContractError, DatasetError, InvalidDatasetError, MalformedLineError
from corpusops.operators.validation import check, error_rows, require_valid, summary
from corpusops.plans.dataset_job import errors_of, validate_dataset
from corpusops.sources.positions import with_row_numbers
from corpusops.sources.readers import normalise_format, parse_lines, read_jsonl, scan_lines, task_samples, text_payloads

META = {"grammar_rev": "v1", "seed": 1, "split": "train", "template_index": 0}
CONTRACT_YAML = """
dataset:
  required_fields: [id, meta, task]
  meta_fields:
    required: [grammar_rev, seed, split, template_index]
task:
  required: [lm, seq2seq, cls]
"""


def write_lines(path, lines):
    path.write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines) + "\n")
    return str(path)


def test_contract_from_yaml():
    assert Contract.from_text(CONTRACT_YAML) == DEFAULT_CONTRACT


@pytest.mark.parametrize(
    "raw",
    [
        [],
        {"dataset": {}},
        {"dataset": [], "task": {"required": ["lm"]}},
        {"dataset": {}, "task": []},
        {"dataset": {}, "task": {"required": []}},
        {"dataset": {"required_fields": 3}, "task": {"required": ["lm"]}},
        {"dataset": {"meta_fields": [1]}, "task": {"required": ["lm"]}},
        {"dataset": {"meta_fields": {"required": 1}}, "task": {"required": ["lm"]}},
    ],
)
def test_malformed_contracts(raw):
    with pytest.raises(ContractError):
        Contract.from_mapping(raw)


def test_clean_row(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [{"id": "row-1", "meta": META, "task": "lm"}])
    report = validate_dataset(spark, path, DEFAULT_CONTRACT)
    assert (report["rows_total"], report["rows_valid"], report["rows_invalid"]) == (1, 1, 0)


def test_bad_row_messages(spark, tmp_path):
    meta = {k: v for k, v in META.items() if k != "template_index"}
    path = write_lines(tmp_path / "a.jsonl", ["", {"id": "row-1", "meta": meta, "task": "lm_error"}])
    out = str(tmp_path / "out")
    report = validate_dataset(spark, path, DEFAULT_CONTRACT, " jsonl ", out)
    assert report["rows_invalid"] == 1
    rows = spark.read.parquet(f"{out}/errors").orderBy("row", "ord").collect()
    assert [(r["row"], r["message"]) for r in rows] == [
        (1, "Missing meta field 'template_index'"),
        (1, "Missing task field 'lm_error', it must be '['lm', 'seq2seq', 'cls']'"),
    ]


def test_presence_is_not_null_check(spark):
    lines = spark.createDataFrame(
        [
            (1, json.dumps({"id": None, "meta": META, "task": "lm"})),
            (2, json.dumps({"meta": META, "task": "lm"})),
            (3, json.dumps({"id": 1, "meta": [1], "task": "cls"})),
            (4, json.dumps({"id": 1, "meta": META})),
            (5, json.dumps({"id": 1, "meta": META, "task": None})),
            (6, json.dumps({"id": 1, "meta": META, "task": {"type": "lm"}})),
        ],
        "n long, value string",
    )
    checked = check(parse_lines(lines), DEFAULT_CONTRACT)
    domain = "it must be '['lm', 'seq2seq', 'cls']'"
    found = {(r["n"], r["message"]) for r in error_rows(checked, "n").collect()}
    assert found == {
        (2, "Missing required field 'id'"),
        (3, "'meta' must be a mapping"),
        (4, "Missing required field 'task'"),
        (4, f"Missing task field 'None', {domain}"),
        (5, f"Missing task field 'None', {domain}"),
        (6, f"Missing task field '{{\"type\":\"lm\"}}', {domain}"),
    }
    assert summary(checked).first().asDict() == {"rows_total": 6, "rows_valid": 1, "rows_invalid": 5}
    with pytest.raises(InvalidDatasetError):
        require_valid(checked)


def test_odd_key_names(spark):
    contract = Contract(("a.b",), ("x'y",), ("lm",))
    lines = spark.createDataFrame(
        [(json.dumps({"a.b": 1, "meta": {"x'y": 1}, "task": "lm"}),), (json.dumps({"a": {"b": 1}, "meta": {}, "task": "lm"}),)],
        "value string",
    )
    rows = summary(check(parse_lines(lines), contract)).first()
    assert rows["rows_valid"] == 1


def test_typed_records(spark):
    frame = spark.createDataFrame(
        [("a", {"grammar_rev": "x", "seed": "1", "split": "t", "template_index": "0"}, "lm"), (None, {"seed": "1"}, "zz")],
        "id string, meta map<string,string>, task string",
    )
    messages = [r["message"] for r in error_rows(check(frame, DEFAULT_CONTRACT)).collect()]
    assert len(messages) == 4 and "Missing meta field 'split'" in messages
    missing = spark.createDataFrame([("lm",)], "task string")
    messages = [r["message"] for r in error_rows(check(missing, DEFAULT_CONTRACT)).collect()]
    assert messages == ["Missing required field 'id'", "Missing required field 'meta'", "'meta' must be a mapping"]


def test_strict_reader_names_the_line(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [{"id": 1}, "", "{bad", "[1]"])
    with pytest.raises(MalformedLineError, match="line 3"):
        read_jsonl(spark, path)
    path = write_lines(tmp_path / "b.jsonl", [{"id": 1}, "", "[1]", "{bad"])
    with pytest.raises(MalformedLineError, match="not a JSON object on line 3"):
        validate_dataset(spark, path, DEFAULT_CONTRACT)


def test_unknown_format():
    with pytest.raises(DatasetError):
        normalise_format("csv")


def test_lenient_scan(spark):
    lines = spark.createDataFrame(
        [(x,) for x in ['{"text":"a","task":"lm"}', "{bad", "  ", '{"src":"b","tgt":"c"}', '{"text":null}', "[1]", '{"text":3,"task":null}']],
        "value string",
    )
    parsed = parse_lines(lines)
    assert sorted(r["payload"] for r in text_payloads(parsed).collect()) == ["3", "a", "b", "c"]
    tasks = {(r["task"], r["payload"]) for r in task_samples(parsed).collect()}
    assert {("lm", "a"), ("unknown", "b"), ("unknown", "c")} <= tasks


def test_row_numbers_over_files_and_blocks(spark, tmp_path):
    """Ordinals follow file order over many files, blocks and tasks, and skip blank lines."""
    expected, number = {}, 0
    for name, size in (("a", 700), ("b", 3), ("c", 1500)):
        lines = []
        for i in range(size):
            lines.append("" if i % 7 == 3 else f'{{"id":"{name}-{i}"}}')
            if i % 7 != 3:
                number += 1
                expected[f'{{"id":"{name}-{i}"}}'] = number
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scanned = scan_lines(spark, str(tmp_path))
        assert scanned.rdd.getNumPartitions() > 4
        rows = {r["value"]: r["row"] for r in with_row_numbers(scanned).select("value", "row").collect()}
        assert rows == expected
        errors = errors_of(check(scanned, DEFAULT_CONTRACT))
        assert errors.filter("ord = 0").count() == number
        assert errors.agg({"row": "max"}).first()[0] == number
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_row_numbers_by_shuffle_join(spark, tmp_path, monkeypatch):
    """Beyond the broadcast bound the block table is joined by shuffle, with the same result."""
    from corpusops import session

    for name in "ab":
        write_lines(tmp_path / f"{name}.jsonl", [{"id": f"{name}{i}"} for i in range(50)])
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rows = with_row_numbers(scan_lines(spark, str(tmp_path))).collect()
    assert {json.loads(r["value"])["id"]: r["row"] for r in rows} == {
        f"{name}{i}": 50 * "ab".index(name) + i + 1 for name in "ab" for i in range(50)
    }
