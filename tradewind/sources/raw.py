"""Bulk load of source files into all-text raw tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tradewind.sources.files import exists
from tradewind.sources.ledger import RunLedger
from tradewind.sources.records import CELLS, cells, csv_records
from tradewind.sources.specs import SOURCES, SourceSpec
from tradewind.sources.tables import ensure_namespaces, materialize


def csv_reader(spark: SparkSession, multiline: bool) -> DataFrameReader:
    """Comma-separated text with doubled quotes. A quoted empty cell is an empty string, a
    bare one is NULL; a byte order mark is skipped."""
    return spark.read.options(**CELLS).option("multiLine", multiline).option("encoding", "UTF-8")


def has_spanning_records(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may run over a line end. The line that opens such a cell has an
    odd number of quotes, so files without such a line can be split at any line end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_raw(
    spark: SparkSession,
    spec: SourceSpec,
    directory: str,
    prefix: str = "",
    check_header: bool = True,
    multiline: bool | None = None,
) -> DataFrame:
    """One source as text columns in the order of its specification.

    A ragged row fails the job. ``check_header`` also compares the names in the header;
    without it columns go by position alone. The path may name a folder or glob of parts.
    ``multiline`` left open is what the specification declares; such files are split as well, see
    :func:`csv_records`. Files without such cells are split at line ends, after a pass that makes
    sure of it."""
    path = spec.path(directory, prefix)
    multiline = spec.multiline if multiline is None else multiline
    if multiline:
        return _read_records(csv_records(spark, path), spec, check_header)
    if has_spanning_records(spark, path):
        raise ValueError(f"{path} has cells that run over line ends; declare it multiline")
    return (
        csv_reader(spark, multiline)
        .schema(spec.schema)
        .option("header", True)
        .option("enforceSchema", not check_header)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def _read_records(records: DataFrame, spec: SourceSpec, check_header: bool) -> DataFrame:
    schema = ", ".join(f"`{name}` string" for name in spec.columns)
    if check_header:
        named = cells(F.col("record"), f"{schema}, _bad string", "PERMISSIVE", columnNameOfCorruptRecord="_bad")
        right = F.lit(True)
        for name in spec.columns:
            right = right & (F.lower(named[name]) == name.lower())
        told = F.concat(F.lit("the header does not name the columns of the source: "), F.col("record"))
        wrong = F.when(F.coalesce(right, F.lit(False)) & named["_bad"].isNull(), F.lit(False)).otherwise(
            F.raise_error(told).cast("boolean")
        )
        records = records.where(F.when(F.col("is_header"), wrong).otherwise(True))
    else:
        records = records.where(~F.col("is_header"))
    return records.select(cells(F.col("record"), schema, "FAILFAST").alias("row")).select("row.*")


def require_source(spark: SparkSession, spec: SourceSpec, directory: str, prefix: str = "") -> None:
    path = spec.path(directory, prefix)
    if not exists(spark, path):
        raise FileNotFoundError(f"expected source file not found: {path}")


def load_all(
    spark: SparkSession, directory: str, prefix: str = "", specs: list[SourceSpec] | None = None
) -> str:
    """Replace every raw table from its file and record the run. Tables loaded before a
    failure stay loaded. Returns the run id."""
    ensure_namespaces(spark)
    ledger = RunLedger(spark)
    run_id = ledger.start()
    started = time.monotonic()
    try:
        for spec in SOURCES if specs is None else specs:
            require_source(spark, spec, directory, prefix)
            table = materialize(read_raw(spark, spec, directory, prefix), f"raw.{spec.table}")
            ledger.table(run_id, spec.table, table.count())
    except Exception as error:
        ledger.finish(run_id, "failed", time.monotonic() - started, str(error))
        raise
    ledger.finish(run_id, "success", time.monotonic() - started)
    return run_id
