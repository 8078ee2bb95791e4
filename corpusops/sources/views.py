"""Input views the registered queries share, derived from the given tables.

``plans/oracle.py`` states the same views in SQL. Positions come from the file scan, so rows
can be numbered in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.functions.text import pretokenize
from corpusops.session import spread
from corpusops.sources.positions import scan_position
from corpusops.sources.readers import not_blank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for the heavy text jobs, spread over the cores if the table is one small file."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean corpus with the tasks cls, lm and seq2seq.

    The user turn and the assistant turn that answers it meet in an equi-join on conversation
    and turn, which stays even however long one conversation is.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    meta_doc = F.struct(
        F.col("source").alias("grammar_rev"),
        F.lit(42).cast("long").alias("seed"),
        F.col("lang").alias("split"),
        (F.col("doc_id") % 7).alias("template_index"),
        (F.col("toxic") == 1).alias("is_noisy"),
    )
    none = F.lit(None).cast("string")
    from_docs = docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("quality").isNotNull(), "cls").otherwise("lm").alias("task"),
        F.col("text"),
        none.alias("src"),
        none.alias("tgt"),
        F.col("quality").cast("string").alias("label"),
        meta_doc.alias("meta"),
    )
    turns = table(spark, sf_dir, "conversations")
    answers = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    meta_conv = F.struct(
        F.lit("conv").alias("grammar_rev"),
        F.lit(42).cast("long").alias("seed"),
        F.col("role").alias("split"),
        F.col("turn").alias("template_index"),
        F.lit(None).cast("boolean").alias("is_noisy"),
    )
    from_turns = (
        turns.filter(F.col("role") == "user")
        .join(answers, ["conv_id", "turn"])
        .select(
            F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
            F.lit("seq2seq").alias("task"),
            none.alias("text"),
            F.col("text").alias("src"),
            F.col("tgt"),
            none.alias("label"),
            meta_conv.alias("meta"),
        )
    )
    return from_docs.unionByName(from_turns)


def structured_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with the task as a mapping of its texts."""
    entries = F.array(
        F.struct(F.lit("type").alias("k"), F.col("task").alias("v")),
        *[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in ("label", "text", "src", "tgt")],
    )
    task = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return records(spark, sf_dir).select("id", "meta", task.alias("task"))


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text payload of the records, with its task and a split by language."""
    entries = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(n).alias("payload")) for n in ("text", "src", "tgt")]
    )
    split = F.when(F.col("meta.split").isin("en", "user"), "train").when(F.col("meta.split") == "fr", "dev").otherwise("test")
    return records(spark, sf_dir).select(
        "id", split.alias("split"), "task", F.inline(F.filter(entries, lambda e: e["payload"].isNotNull()))
    )


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files, whether it is one file or a folder of them.

    A stream refuses the plain path of a file; of a pattern that fits only the table it takes either.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def raw_lines(spark: SparkSession, sf_dir: str, positioned: bool = False) -> DataFrame:
    """One JSON line per document, with the usual defects of raw data by document number."""
    docs = table(spark, sf_dir, "documents")
    if not positioned:
        return spread(docs.select("doc_id", "lang", "source", "text")).select("doc_id", raw_line().alias("value"))
    lines = docs.select("doc_id", raw_line().alias("value"), "_metadata")
    return lines.filter(not_blank(F.col("value"))).select("doc_id", "value", scan_position())


def raw_line() -> Column:
    kind = F.col("doc_id") % 50
    ident = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id")
    begun = [F.col("source").alias("grammar_rev"), F.lit(42).alias("seed"), F.col("lang").alias("split")]
    meta = F.struct(*begun, (F.col("doc_id") % 7).alias("template_index")).alias("meta")
    task = F.lit("lm").alias("task")

    def line(*fields: Column) -> Column:
        return F.to_json(F.struct(*fields, "text"), {"ignoreNullFields": "false"})

    return (
        F.when(kind == 0, line(meta, task))
        .when(kind == 1, line(ident, F.struct(*begun).alias("meta"), task))
        .when(kind == 2, line(ident, F.array(F.lit(1)).alias("meta"), task))
        .when(kind == 3, line(ident, meta, F.lit("lm_error").alias("task")))
        .when(kind == 4, line(F.lit(None).cast("string").alias("id"), meta, task))
        .when(kind == 5, F.lit("{bad"))
        .when(kind == 6, F.lit("   "))
        .when(kind == 7, line(ident, meta))
        .when(kind == 8, F.lit("[1,2]"))
        .otherwise(line(ident, meta, task))
    )


def sequences(spark: SparkSession, sf_dir: str, positioned: bool = False) -> DataFrame:
    """One token sequence per document: the id of a token is its length.

    The mask is 0 where the id exceeds 8, and missing for every other document.
    """
    scan = table(spark, sf_dir, "documents").select("doc_id", "text")
    if positioned:
        scan = table(spark, sf_dir, "documents").select("doc_id", "text", scan_position())
    ids = F.transform(pretokenize(F.col("text")), lambda t: F.char_length(t))
    mask = F.when(
        F.col("doc_id") % 2 != 0, F.transform("input_ids", lambda x: F.when(x > 8, 0).otherwise(1))
    )
    return (
        spread(scan)
        .withColumn("input_ids", ids)
        .withColumn("attention_mask", mask)
        .withColumnRenamed("doc_id", "seq_id")
        .drop("text")
    )


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of batch losses from the event stream."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("run"),
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
        (1 + F.col("event_id") % 13).alias("n_tokens"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in families of five: the first of each family is the parent of the others."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event.alias("run_id"),
        F.when(event % 5 != 0, event - event % 5).alias("parent_run_id"),
        F.col("ts").alias("start_time"),
        F.col("event_type").alias("kind"),
    )
