"""The registered queries of the operators: each runs one operator over its whole table."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm import decontamination, filter_audit, language, licenses, links, mixture, near_duplicates, neighbours, repeats, runs, secrets, sharding, toxicity
from corpusops.llm.common import as_bytes, table

N_SHARDS = 16
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    learnable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = language.fit(docs.filter(learnable).select("text", "lang"))
    judged = language.predict(docs.select("doc_id", "text"), F.col("text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    judged = toxicity.predict(docs, F.col("text"), chain)
    return judged.select("doc_id", "toxicity.p_quality", "toxicity.p_toxic", F.col("toxicity.is_toxic").alias("toxic"))


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.stratified_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    none = F.lit(None).cast("int")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none.alias("grown_shard")
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.col("contamination.items")
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        decontamination.hit_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op9_mixture_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix_sources(table(spark, sf_dir, "documents"), n_shards=N_SHARDS)
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken")
    )


def op10_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = links.judge_urls(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_text_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secret_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.fit(docs))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans")
    )


def op13_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.find_runs(docs, planted_repeats(F.col("doc_id"), F.col("text")))
    each = F.col("periodic.runs")
    best = runs.strongest(each)
    lines = F.transform(each, lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    return found.select("doc_id", F.size(each).cast("long").alias("n_runs"), best.alias("best"), "periodic.collapsed", lines.alias("lines")).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_repeats(doc_id: Column, text: Column) -> Column:
    """The text, with the words from some place on repeated in every tenth document, as the query's definition asks."""

    @F.arrow_udf(T.StringType())
    def planted(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = as_bytes(texts)
        for row, (doc_id, text) in enumerate(zip(ids.to_pylist(), out)):
            h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
            words = text.split() if text and h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                out[row] = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
        return pa.array(out, pa.binary()).cast(pa.string())

    return planted(doc_id, text)


QUERIES = {
    "op1_learned_partitions": op1_learned_partitions,
    "op2_language_id": op2_language_id,
    "op3_toxicity_chain": op3_toxicity_chain,
    "op4_suffix_levels": op4_suffix_levels,
    "op5_superminhash": op5_superminhash,
    "op6_stratified_shards": op6_stratified_shards,
    "op7_license_scan": op7_license_scan,
    "op8_prefix_join": op8_prefix_join,
    "op9_mixture_tree": op9_mixture_tree,
    "op10_link_trust": op10_link_trust,
    "op11_text_tries": op11_text_tries,
    "op12_secret_chain": op12_secret_chain,
    "op13_cover_runs": op13_cover_runs,
}
