"""Landing of one uploaded CSV file as an all-text table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tradewind.sources.files import exists
from tradewind.sources.raw import csv_reader
from tradewind.sources.records import cell_count, cells, csv_records
from tradewind.sources.tables import UPLOADS, ensure_namespaces, materialize

# Characters of a table or column name, and what is taken for CSV.
MAX_NAME = 60
EXTENSIONS = {"csv", "txt"}

BAD_ROW = "_bad_row"


@dataclass(frozen=True)
class Landed:
    table: str
    columns: list[str]
    rows_loaded: int
    long_rows: int = 0


def slug(name: str) -> str:
    """Lower-case name of ASCII letters, digits and underscores; ``data`` if nothing is left."""
    joined = "_".join(re.findall("[a-z0-9_]+", name, re.ASCII | re.IGNORECASE))
    return joined.strip("_").lower()[:MAX_NAME] or "data"


def identifier(name: str) -> str:
    if not (name.isascii() and name.isidentifier()):
        raise ValueError(f"cannot name a table or column {name!r}")
    return name


def read_upload(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """All rows of the file under slugged column names.

    Cells may run over line ends; ``multiline=False`` saves a pass over a file without such cells.
    Either way many tasks read a large file. Missing cells of a short row are NULL, spare cells of
    a long one are left out; :func:`land_csv` says how many rows had any."""
    rows, names = _upload(spark, path, multiline)
    return rows.select(*names)


def _upload(spark: SparkSession, path: str, multiline: bool) -> tuple[DataFrame, list[str]]:
    """The rows with BAD_ROW, the text of a row that has not as many cells as the header."""
    if not exists(spark, path):
        raise FileNotFoundError(f"upload not found: {path}")
    if path.rpartition(".")[2].lower() not in EXTENSIONS:
        raise ValueError(f"uploads are CSV text, not {path}")

    header = csv_reader(spark, multiline).option("header", False).csv(path).first()
    if header is None:
        raise ValueError(f"no header in {path}")
    names = [identifier(slug(cell or "")) for cell in header]
    if len(set(names)) < len(names):
        raise ValueError(f"column names are not distinct: {names}")

    schema = StructType([StructField(name, StringType()) for name in [*names, BAD_ROW]])
    if multiline:
        told = ", ".join(f"{name} string" for name in schema.names)
        record = cells(F.col("record"), told, "PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW)
        rows = csv_records(spark, path).where(~F.col("is_header")).select(record.alias("row")).select("row.*")
    else:
        rows = (
            csv_reader(spark, multiline)
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD_ROW)
            .schema(schema)
            .csv(path)
        )
    # In a whole row an empty cell is an empty text, not a missing one.
    whole = F.col(BAD_ROW).isNull()
    filled = [
        F.when(whole, F.coalesce(name, F.lit(""))).otherwise(F.col(name)).alias(name) for name in names
    ]
    return rows.select(*filled, BAD_ROW), names


def land_csv(
    spark: SparkSession, path: str, now: datetime, multiline: bool = True
) -> Landed:
    """Store an upload as ``uploads.<file name>_<utc time>``. Rows with more cells than the header
    are counted while the table is written."""
    stem = path.rpartition("/")[2].rpartition(".")[0]
    table = identifier(f"{slug(stem)}_{now:%Y%m%d_%H%M%S}")
    rows, names = _upload(spark, path, multiline)
    seen = Observation()
    is_long = F.col(BAD_ROW).isNotNull() & (cell_count(F.col(BAD_ROW)) > len(names))
    df = rows.observe(seen, F.count_if(is_long).alias("long_rows")).select(*names)
    ensure_namespaces(spark, [UPLOADS])
    landed = materialize(df, f"{UPLOADS}.{table}")
    return Landed(f"{UPLOADS}.{table}", names, landed.count(), seen.get["long_rows"])
