"""Registered queries: one per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.contracts import DEFAULT_CONTRACT as CONTRACT
from corpusops.functions import arrays, text
from corpusops.functions.records import VariantRecord
from corpusops.operators import chars, ranking, report, runlog, sequences, splits, validation, vocab
from corpusops.operators import profile as prof
from corpusops.operators.decoding import decode
from corpusops.operators.tokenizer import TokenizerConfig, TokenizerModel, encode
from corpusops.operators.wordpiece import PieceOptions, piece_vocabulary
from corpusops.plans.tokenizer_job import learn, training_bytes, training_words
from corpusops.sources import readers, views
from corpusops.sources.positions import block_offsets, number_rows, with_row_numbers
from corpusops.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RATIOS = {"train": 0.8, "dev": 0.1, "test": 0.1}
SEED = 42


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


# Scans and validation over raw lines


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines that are JSON objects; the strict scan reports the others."""
    return readers.parse_lines(views.raw_lines(spark, sf_dir)).filter(readers.is_object())


@query("s01_strict_scan")
def s01_strict_scan(spark, sf_dir):
    return readers.bad_lines(readers.parse_lines(views.raw_lines(spark, sf_dir))).select("doc_id", "value", "problem")


@query("s02_parquet_scan")
def s02_parquet_scan(spark, sf_dir):
    scan = readers.read_parquet(spark, f"{sf_dir}/documents.parquet")
    return scan.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


@query("s04_text_scan")
def s04_text_scan(spark, sf_dir):
    parsed = readers.parse_lines(views.raw_lines(spark, sf_dir))
    return readers.text_payloads(parsed, ["doc_id"]).select("doc_id", "field", F.md5("payload").alias("payload_md5"))


@query("s05_task_samples")
def s05_task_samples(spark, sf_dir):
    parsed = readers.parse_lines(views.raw_lines(spark, sf_dir))
    return (
        readers.task_samples(parsed)
        .groupBy("task")
        .agg(F.count(F.lit(1)).alias("samples"), F.sum(F.char_length("payload").cast("long")).alias("chars"))
    )


@query("p01_missing_fields")
def p01_missing_fields(spark, sf_dir):
    missing = validation.missing_fields(VariantRecord(), CONTRACT)
    return _objects(spark, sf_dir).select("doc_id", F.explode(missing).alias("field"))


@query("p02_meta_mapping")
def p02_meta_mapping(spark, sf_dir):
    broken = validation.meta_is_broken(VariantRecord(), CONTRACT)
    return _objects(spark, sf_dir).filter(broken).select("doc_id", F.lit("'meta' must be a mapping").alias("message"))


@query("p03_missing_meta")
def p03_missing_meta(spark, sf_dir):
    missing = validation.missing_meta(VariantRecord(), CONTRACT)
    return _objects(spark, sf_dir).select("doc_id", F.explode(missing).alias("field"))


@query("p04_task_domain")
def p04_task_domain(spark, sf_dir):
    outside = validation.task_is_outside(VariantRecord(), CONTRACT)
    return _objects(spark, sf_dir).filter(outside).select("doc_id", VariantRecord().string("task").alias("task"))


def _checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.parse_lines(views.raw_lines(spark, sf_dir, positioned=True))
    return validation.check(lines.filter(readers.is_object()), CONTRACT)


@query("p05_row_errors")
def p05_row_errors(spark, sf_dir):
    offsets = block_offsets(views.raw_lines(spark, sf_dir, positioned=True))
    errors = validation.error_rows(_checked_lines(spark, sf_dir), "doc_id", "scan_pos")
    return number_rows(errors, offsets).select("row", "doc_id", "ord", "message")


@query("p09_quarantine")
def p09_quarantine(spark, sf_dir):
    lines = readers.parse_lines(views.raw_lines(spark, sf_dir))
    valid, quarantine = validation.split_valid(validation.check_lines(lines, CONTRACT))
    return valid.select("doc_id", F.lit("valid").alias("side"), F.lit("").alias("messages")).unionByName(
        quarantine.select("doc_id", F.lit("quarantine").alias("side"), F.array_join("errors", "; ").alias("messages"))
    )


@query("p11_row_number")
def p11_row_number(spark, sf_dir):
    return with_row_numbers(views.raw_lines(spark, sf_dir, positioned=True)).select("doc_id", "row")


@query("a01_validation_summary")
def a01_validation_summary(spark, sf_dir):
    lines = readers.parse_lines(views.raw_lines(spark, sf_dir))
    return validation.summary(validation.check_lines(lines, CONTRACT))


@query("k07_row_sha256")
def k07_row_sha256(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# Profile over records


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.profile_view(views.records(spark, sf_dir), CONTRACT)


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.profile_view(views.structured_records(spark, sf_dir), CONTRACT)


@query("a02_unique_ids")
def a02_unique_ids(spark, sf_dir):
    return prof.unique_ids(_view(spark, sf_dir))


@query("a03_task_distribution")
def a03_task_distribution(spark, sf_dir):
    return prof.task_distribution(_view(spark, sf_dir))


@query("a04_label_distribution")
def a04_label_distribution(spark, sf_dir):
    return prof.label_distribution(_structured(spark, sf_dir))


@query("a05_field_coverage")
def a05_field_coverage(spark, sf_dir):
    return prof.coverage(_view(spark, sf_dir), "fields", CONTRACT.required_fields)


@query("a06_meta_coverage")
def a06_meta_coverage(spark, sf_dir):
    return prof.coverage(_view(spark, sf_dir), "meta_fields", CONTRACT.meta_required)


@query("a07_vocab_size")
def a07_vocab_size(spark, sf_dir):
    return prof.vocabulary_size(_structured(spark, sf_dir))


@query("a08_text_length")
def a08_text_length(spark, sf_dir):
    return prof.text_length(_structured(spark, sf_dir))


@query("a09_noise_rate")
def a09_noise_rate(spark, sf_dir):
    return prof.noise_rate(_view(spark, sf_dir))


@query("a10_first_rev")
def a10_first_rev(spark, sf_dir):
    lines = readers.parse_lines(with_row_numbers(views.raw_lines(spark, sf_dir, positioned=True)))
    view = lines.select("row", VariantRecord().string("meta", "grammar_rev").alias("grammar_rev"))
    return prof.first_grammar_rev(view, "row")


@query("a11_profile")
def a11_profile(spark, sf_dir):
    return prof.profile_long(_structured(spark, sf_dir), CONTRACT)


# Splits


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(views.records(spark, sf_dir), RATIOS, SEED)[0]


@query("o01_split_assign")
def o01_split_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("id", "split")


@query("o02_allocation")
def o02_allocation(spark, sf_dir):
    totals = views.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("total"))
    return splits.allocation(totals, RATIOS)


@query("a12_split_rows")
def a12_split_rows(spark, sf_dir):
    return (
        _assigned(spark, sf_dir)
        .groupBy("split", "task")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query("o07_epoch_order")
def o07_epoch_order(spark, sf_dir):
    epoch = 3
    placed = ranking.with_place(views.records(spark, sf_dir).select("id", "task"))
    key = ranking.seeded_key(placed, f"{SEED}:{epoch}")
    return ranking.ordinals(placed, key).select("id", "ordinal")


# Text functions and vocabularies


@query("f01_normalize")
def f01_normalize(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    normal = text.normalize_training(F.col("text"), "nfc", True, "space")
    return docs.select("doc_id", F.char_length(normal).alias("chars"), F.md5(normal).alias("text_md5"))


@query("f02_normalize_encode")
def f02_normalize_encode(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    normal = text.normalize_encoding(F.col("text"), "nfc", True, "keep")
    return docs.select("doc_id", F.char_length(normal).alias("chars"), F.md5(normal).alias("text_md5"))


@query("f04_pretokenize")
def f04_pretokenize(spark, sf_dir):
    docs = views.documents(spark, sf_dir).withColumn("tokens", text.pretokenize(F.col("text")))
    return docs.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


@query("f05_bytes")
def f05_bytes(spark, sf_dir):
    docs = views.documents(spark, sf_dir).withColumn("symbols", text.bytes_of(F.col("text")))
    return docs.select(
        "doc_id", F.size("symbols").alias("n_bytes"), F.md5(F.array_join("symbols", "")).alias("bytes_md5")
    )


@query("f08_tags")
def f08_tags(spark, sf_dir):
    pairs = F.array(
        F.concat(F.lit("kind= "), F.col("event_type")),
        F.concat(F.lit(" user ="), F.col("user_id").cast("string")),
        F.concat(F.lit("props=a="), F.col("props")),
        F.col("event_type"),
    )
    return views.table(spark, sf_dir, "events").select("event_id", F.explode(arrays.parse_tags(pairs)).alias("tag", "value"))


@query("f09_flatten")
def f09_flatten(spark, sf_dir):
    nested = views.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.struct("source", "lang", F.struct("n_chars").alias("size")).alias("meta"),
    )
    flat = runlog.flatten_columns(nested)
    return flat.select("doc_id", F.to_json(F.struct(*[f"`{c}`" for c in flat.columns])).alias("flat"))


@query("f10_tokenizer_id")
def f10_tokenizer_id(spark, sf_dir):
    name = text.tokenizer_id(
        F.element_at(F.array(*[F.lit(a) for a in text.ALGORITHMS]), (F.col("doc_id") % 3 + 1).cast("int")),
        F.col("n_chars"),
        F.when(F.col("doc_id") % 2 == 0, "nfc").otherwise("none"),
        F.col("lang") == "en",
        F.element_at(F.array(*[F.lit(p) for p in text.PUNCT_POLICIES]), (F.col("doc_id") % 3 + 1).cast("int")),
        F.col("doc_id"),
    )
    return views.table(spark, sf_dir, "documents").select("doc_id", name.alias("tokenizer_id"))


LEARNING = TokenizerConfig("char", 64)


def _document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_words(views.documents(spark, sf_dir), LEARNING, "text")


@query("t01_word_freq")
def t01_word_freq(spark, sf_dir):
    return _document_words(spark, sf_dir)


@query("o05_topk_vocab")
def o05_topk_vocab(spark, sf_dir):
    return vocab.top_words(_document_words(spark, sf_dir), 2_000)


@query("j03_vocab_lookup")
def j03_vocab_lookup(spark, sf_dir):
    words = _document_words(spark, sf_dir)
    found = vocab.lookup_ids(words, vocab.top_words(words, 2_000), 2_000, text.UNK_ID)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("uses"))


@query("u03_missing_specials")
def u03_missing_specials(spark, sf_dir):
    return vocab.missing_specials(vocab.top_words(_document_words(spark, sf_dir), 2_000))


@query("t04_char_vocab")
def t04_char_vocab(spark, sf_dir):
    found = training_bytes(views.documents(spark, sf_dir), LEARNING, "text")
    return found.select("token", "n", "id", F.round("score", 6).alias("score"))


def _char_model(spark: SparkSession, sf_dir: str, size: int) -> TokenizerModel:
    return learn(views.documents(spark, sf_dir), TokenizerConfig("char", size), "text")


@query("t05_encode_char")
def t05_encode_char(spark, sf_dir):
    model = _char_model(spark, sf_dir, LEARNING.vocab_size)
    return encode(views.documents(spark, sf_dir), model, "text", "ids").select(
        "doc_id", F.size("ids").alias("n_tokens"), F.md5(arrays.joined_ids(F.col("ids"))).alias("ids_md5")
    )


@query("t11_decode_char")
def t11_decode_char(spark, sf_dir):
    model = _char_model(spark, sf_dir, 256 + len(text.SPECIAL_TOKENS))
    coded = encode(views.documents(spark, sf_dir), model, "text", "ids")
    return coded.select("doc_id", F.md5(chars.decode_bytes(F.col("ids"), model.byte_ids())).alias("text_md5"))


def _word_model(spark: SparkSession, sf_dir: str, kind: str, pieces: PieceOptions = PieceOptions()) -> TokenizerModel:
    """The most frequent words of the corpus as a vocabulary of the given kind."""
    config = TokenizerConfig(kind.lower(), WORD_VOCABULARY)
    words = training_words(views.documents(spark, sf_dir), config, "text")
    top = vocab.top_words(words, config.vocab_size)
    if kind == "WordLevel":
        tokens = [r["token"] for r in top.orderBy("id").collect()]
    else:
        tokens = piece_vocabulary(words, top, pieces.prefix)
    decoder = None if kind == "WordLevel" else {"type": "WordPiece", "prefix": pieces.prefix, "cleanup": False}
    return TokenizerModel(config, [*text.SPECIAL_TOKENS, *tokens], model_type=kind, pieces=pieces, decoder=decoder)


WORD_VOCABULARY = 2_000
# No pre-token mixes word characters with others, so none can be taken for a piece inside a word.
UNMISTAKABLE = PieceOptions("#_")


@query("t07_encode_words")
def t07_encode_words(spark, sf_dir):
    """Ids of whole words."""
    coded = encode(views.documents(spark, sf_dir), _word_model(spark, sf_dir, "WordLevel"), "text", "ids")
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(arrays.joined_ids(F.col("ids"))).alias("ids_md5"))


@query("t11_decode_pieces")
def t11_decode_pieces(spark, sf_dir):
    """Words cut by longest match and put together again; words above the length limit are unknown, so they go."""
    model = _word_model(spark, sf_dir, "WordPiece", UNMISTAKABLE)
    back = decode(encode(views.documents(spark, sf_dir), model, "text", "ids"), model, "ids", "back")
    return back.select("doc_id", F.md5("back").alias("text_md5"))


@query("t02_bpe_8000")
def t02_bpe_8000(spark, sf_dir):
    """The default vocabulary size; one merge at a time, as SQL has it, would take thousands of rounds."""
    return learn(views.documents(spark, sf_dir), TokenizerConfig("bpe", 8_000), "text").merge_table(spark)


@query("t02_bpe_merges")
def t02_bpe_merges(spark, sf_dir):
    return learn(views.documents(spark, sf_dir), TokenizerConfig("bpe", 256), "text").merge_table(spark)


@query("t03_unigram")
def t03_unigram(spark, sf_dir):
    config = TokenizerConfig("unigram", 4_000)
    return learn(views.documents(spark, sf_dir), config, "text").vocabulary(spark)


@query("t05_encode")
def t05_encode(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    model = learn(docs, TokenizerConfig("bpe", 128), "text")
    return encode(docs, model, "text").select(
        "doc_id", F.size("input_ids").alias("n_tokens"), F.md5(arrays.joined_ids(F.col("input_ids"))).alias("ids_md5")
    )


# Tokenisation report


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _char_model(spark, sf_dir, LEARNING.vocab_size)
    encoded = encode(views.record_texts(spark, sf_dir).select("split", "task", "payload"), model)
    return report.length_histogram(report.token_samples(encoded, model.unk_id))


METRICS = ["oov_rate", "avg_tokens_per_sample", "tokens_len_p50", "tokens_len_p95", "coverage"]


def _rounded(frame: DataFrame, names: list[str]) -> DataFrame:
    return frame.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in frame.columns])


@query("a13_token_metrics")
def a13_token_metrics(spark, sf_dir):
    metrics = report.token_metrics(_histogram(spark, sf_dir))
    return _rounded(metrics, METRICS).select("num_samples", "num_tokens", "oov_rate", "avg_tokens_per_sample")


@query("a14_length_percentiles")
def a14_length_percentiles(spark, sf_dir):
    metrics = report.token_metrics(_histogram(spark, sf_dir), "split")
    return _rounded(metrics, METRICS).select("split", "tokens_len_p50", "tokens_len_p95")


@query("a15_task_coverage")
def a15_task_coverage(spark, sf_dir):
    metrics = report.token_metrics(_histogram(spark, sf_dir), "split", "task")
    return _rounded(metrics, METRICS).select("split", "task", "coverage")


@query("a16_token_report")
def a16_token_report(spark, sf_dir):
    return _rounded(report.token_report(_histogram(spark, sf_dir)), METRICS)


@query("a17_macro_coverage")
def a17_macro_coverage(spark, sf_dir):
    return _rounded(report.macro_coverage(_histogram(spark, sf_dir)), ["macro_coverage"])


# Joins on names


@query("j01_split_semi")
def j01_split_semi(spark, sf_dir):
    sources = views.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    toxic = views.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    requested = (
        views.table(spark, sf_dir, "documents").join(toxic, "doc_id").select(F.col("source").alias("name")).distinct()
    )
    return sources.join(requested, "name", "left_semi")


def _registry(spark: SparkSession, sf_dir: str, updates: bool) -> DataFrame:
    """Tokenizer entries by user: the older ones from clicks and views, updates from purchases."""
    kind = F.col("event_type") == "purchase"
    return (
        views.table(spark, sf_dir, "events")
        .filter(kind if updates else ~kind)
        .groupBy(F.concat(F.lit("tok-"), F.col("user_id").cast("string")).alias("tokenizer_id"))
        .agg(F.max("event_id").alias("created_at"), F.lit("new" if updates else "old").alias("state"))
    )


@query("j02_registry_upsert")
def j02_registry_upsert(spark, sf_dir):
    merged = runlog.upsert(_registry(spark, sf_dir, False), _registry(spark, sf_dir, True))
    return runlog.newest_first(merged)


# Sequences


@query("s06_sequence_scan")
def s06_sequence_scan(spark, sf_dir):
    mask = readers.default_mask(F.col("input_ids"), F.col("attention_mask"))
    return views.sequences(spark, sf_dir).select(
        "seq_id",
        F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
        F.md5(F.array_join(mask, " ")).alias("mask_md5"),
    )


@query("p12_max_len")
def p12_max_len(spark, sf_dir):
    return sequences.over_length(views.sequences(spark, sf_dir), 512).select(
        "seq_id", F.size("input_ids").alias("n_tokens")
    )


@query("j04_context_pairs")
def j04_context_pairs(spark, sf_dir):
    return sequences.context_pairs(views.sequences(spark, sf_dir), window=3, causal=False)


@query("j05_global_pairs")
def j05_global_pairs(spark, sf_dir):
    return sequences.context_pairs(views.sequences(spark, sf_dir), window=2, causal=True, n_global=2)


def _mean_digest(means: DataFrame) -> DataFrame:
    """Figures per sequence that pin down the means at all its positions."""
    weighted = F.transform("mean", lambda m, pos: F.floor(m * 1000).cast("long") * (pos % 1000 + 1))
    return means.filter(F.size("mean") > 0).select(
        "seq_id",
        F.size("mean").cast("long").alias("positions"),
        F.array_min("mean").alias("low"),
        F.array_max("mean").alias("high"),
        F.aggregate(weighted, F.lit(0).cast("long"), lambda total, x: total + x).alias("digest"),
    )


@query("w02_prefix_mean")
def w02_prefix_mean(spark, sf_dir):
    return _mean_digest(sequences.prefix_mean(views.sequences(spark, sf_dir)))


@query("w03_sliding_mean")
def w03_sliding_mean(spark, sf_dir):
    return _mean_digest(sequences.sliding_mean(views.sequences(spark, sf_dir), window=4, causal=False))


def _numbered_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = readers.default_mask(F.col("input_ids"), F.col("attention_mask"))
    numbered = with_row_numbers(views.sequences(spark, sf_dir, positioned=True))
    return numbered.withColumn("attention_mask", mask)


@query("f12_pad_batch")
def f12_pad_batch(spark, sf_dir):
    return sequences.pad_batches(_numbered_sequences(spark, sf_dir), 8).select(
        "seq_id",
        "batch",
        F.size("input_ids").alias("width"),
        F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
        F.md5(F.array_join("attention_mask", " ")).alias("mask_md5"),
    )


@query("f14_shift_labels")
def f14_shift_labels(spark, sf_dir):
    labels = arrays.shift_labels(F.col("input_ids"), F.col("attention_mask"))
    return views.sequences(spark, sf_dir).select(
        "seq_id", F.size(labels).alias("n_labels"), F.md5(F.array_join(labels, " ")).alias("labels_md5")
    )


@query("f15_template")
def f15_template(spark, sf_dir):
    def lengths(name: str):
        return F.transform(text.pretokenize(F.col(name)), lambda t: F.char_length(t) + 4)

    single = arrays.template(lengths("text"), 1, 2, 4)
    pair = arrays.template(lengths("src"), 1, 2, 4, lengths("tgt"))
    joined = F.array_join(F.when(F.col("text").isNotNull(), single).otherwise(pair), " ")
    return views.records(spark, sf_dir).select("id", F.md5(joined).alias("ids_md5"))


@query("a19_batch_tokens")
def a19_batch_tokens(spark, sf_dir):
    numbered = with_row_numbers(views.sequences(spark, sf_dir, positioned=True))
    return numbered.groupBy(F.floor((F.col("row") - 1) / 8).cast("long").alias("batch")).agg(
        F.sum(arrays.batch_tokens(F.col("input_ids"), F.col("attention_mask"))).alias("tokens")
    )


# Run logs and streams


@query("a18_eval_summary")
def a18_eval_summary(spark, sf_dir):
    summary = runlog.eval_summary(views.eval_log(spark, sf_dir), "run")
    return summary.select("run", F.round("loss", 6).alias("loss"), F.round("ppl", 3).alias("ppl"))


@query("a20_throughput")
def a20_throughput(spark, sf_dir):
    log = views.eval_log(spark, sf_dir).withColumn("elapsed", F.col("loss"))
    return _rounded(runlog.throughput(log, 50, "run"), ["tokens_per_s", "step_ms"])


@query("w01_best_so_far")
def w01_best_so_far(spark, sf_dir):
    return runlog.best_so_far(views.eval_log(spark, sf_dir)).select("run", "step", "best")


@query("o06_latest_run")
def o06_latest_run(spark, sf_dir):
    return runlog.latest_run(views.runs(spark, sf_dir)).select("run_id", "kind")


@query("r01_params_long")
def r01_params_long(spark, sf_dir):
    return runlog.params_long(views.records(spark, sf_dir).select("id", "task", "meta"), "id")


@query("r02_metrics_long")
def r02_metrics_long(spark, sf_dir):
    return runlog.metrics_long(views.eval_log(spark, sf_dir), ["loss", "n_tokens"], "run", "step")


@query("r04_nested_runs")
def r04_nested_runs(spark, sf_dir):
    return runlog.children(views.runs(spark, sf_dir)).select(
        "run_id", "parent_run_id", (F.col("start_time") >= F.col("parent_start_time")).alias("in_order")
    )


@query("st1_metrics_tail")
def st1_metrics_tail(spark, sf_dir):
    events = views.table_stream(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")
    totals = jobs.tail_totals(events, jobs.work_folder(spark, "metrics-tail"))
    return _rounded(totals, ["total"])


@query("st2_stream_validate")
def st2_stream_validate(spark, sf_dir):
    lines = views.table_stream(spark, sf_dir, "documents").select("doc_id", views.raw_line().alias("value"))
    out = jobs.work_folder(spark, "stream-validate")
    valid, quarantine = jobs.validate_stream(lines, CONTRACT, out, ("doc_id",))
    return valid.select("doc_id", F.lit("valid").alias("side"), F.lit("").alias("messages")).unionByName(
        quarantine.select("doc_id", F.lit("quarantine").alias("side"), F.array_join("errors", "; ").alias("messages"))
    )
