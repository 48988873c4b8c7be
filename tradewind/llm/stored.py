"""Intermediate results as tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradewind.session import shared_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and opened again. It is computed
    once, later reads do not depend on executors that made it, and row numbers in it are final."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
