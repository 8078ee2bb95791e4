"""Contract validation: presence rules as one error array per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.contracts import Contract, InvalidDatasetError
from corpusops.functions.records import TypedRecord, VariantRecord
from corpusops.sources.readers import is_object, line_problem

Record = VariantRecord | TypedRecord


def record_of(df: DataFrame) -> Record:
    """Raw lines carry a VARIANT column ``v``; everything else is taken as typed."""
    if dict(df.dtypes).get("v") == "variant":
        return VariantRecord("v")
    return TypedRecord(df)


def missing_fields(record: Record, contract: Contract) -> Column:
    return _compact(F.when(~record.present(f), F.lit(f)) for f in contract.required_fields)


def meta_is_broken(record: Record, contract: Contract) -> Column:
    """Meta must be a mapping, but only if the contract asks for meta keys."""
    return ~record.is_mapping("meta") if contract.meta_required else F.lit(False)


def missing_meta(record: Record, contract: Contract) -> Column:
    return _compact(
        F.when(record.is_mapping("meta") & ~record.present("meta", k), F.lit(k)) for k in contract.meta_required
    )


def task_is_outside(record: Record, contract: Contract) -> Column:
    return ~F.coalesce(record.string("task").isin(*contract.tasks), F.lit(False))


def row_errors(record: Record, contract: Contract) -> Column:
    """All messages of a row, in the order fields, meta, task."""
    domain = str(list(contract.tasks))
    task = F.coalesce(record.shown("task"), F.lit("None"))
    return F.concat(
        F.transform(missing_fields(record, contract), lambda f: F.concat(F.lit("Missing required field '"), f, F.lit("'"))),
        _compact([F.when(meta_is_broken(record, contract), F.lit("'meta' must be a mapping"))]),
        F.transform(missing_meta(record, contract), lambda k: F.concat(F.lit("Missing meta field '"), k, F.lit("'"))),
        _compact(
            [
                F.when(
                    task_is_outside(record, contract),
                    F.concat(F.lit("Missing task field '"), task, F.lit(f"', it must be '{domain}'")),
                )
            ]
        ),
    )


def _compact(items) -> Column:
    items = list(items)
    if not items:
        return F.array().cast("array<string>")
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def check(df: DataFrame, contract: Contract) -> DataFrame:
    """Add ``errors``: the messages of each row, empty for a valid one."""
    return df.withColumn("errors", row_errors(record_of(df), contract))


def check_lines(parsed: DataFrame, contract: Contract) -> DataFrame:
    """``check`` for parsed lines of any kind: one that holds no JSON object has that as its only message."""
    problem = F.array(line_problem())
    return parsed.withColumn("errors", F.when(is_object(), row_errors(VariantRecord("v"), contract)).otherwise(problem))


def summary(checked: DataFrame) -> DataFrame:
    """Total, valid and invalid rows in one pass."""
    return checked.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.size("errors") == 0).alias("rows_valid"),
        F.count_if(F.size("errors") > 0).alias("rows_invalid"),
    )


def error_rows(checked: DataFrame, *keep: str) -> DataFrame:
    """One row per message; ``ord`` is its place within the row."""
    return checked.filter(F.size("errors") > 0).select(*keep, F.posexplode("errors").alias("ord", "message"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the quarantined rest with its messages."""
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def require_valid(checked: DataFrame) -> None:
    """All-or-nothing gate."""
    invalid = summary(checked).first()["rows_invalid"]
    if invalid:
        raise InvalidDatasetError(f"{invalid} rows break the contract")
