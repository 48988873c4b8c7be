"""Load ledger: one appended row per event, the state of a run is its latest event."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = (
    "run_id string, event_ts timestamp, status string, duration_seconds decimal(12,2), "
    "error_message string, table_name string, row_count bigint"
)


def latest_runs(events: DataFrame) -> DataFrame:
    """One row per run from its start and finish events. Of events at the same moment the
    finish counts. A maximum per key, so runs of any number of events combine on the map
    side."""
    rank = F.when(F.col("status") == "running", 0).otherwise(1)
    latest = F.max(F.struct(
        F.col("event_ts"), rank.alias("rank"), "status", "duration_seconds", "error_message"
    ))
    return (
        events.where(F.col("status").isNotNull())
        .groupBy("run_id")
        .agg(
            F.min(F.when(F.col("status") == "running", F.col("event_ts"))).alias("started_at"),
            latest.alias("latest"),
        )
        .select(
            "run_id",
            "started_at",
            F.when(F.col("latest.rank") == 1, F.col("latest.event_ts")).alias("finished_at"),
            "latest.status",
            "latest.duration_seconds",
            "latest.error_message",
        )
    )


def run_tables(events: DataFrame) -> DataFrame:
    return events.where(F.col("table_name").isNotNull()).select(
        "run_id", "table_name", "row_count", F.col("event_ts").alias("loaded_at")
    )


class RunLedger:
    def __init__(self, spark: SparkSession, table: str = "raw.ingestion_events"):
        self.spark = spark
        self.name = table

    def _append(self, **event) -> None:
        fields = [part.split(" ")[0] for part in EVENTS.split(", ")]
        event["event_ts"] = datetime.now(timezone.utc)
        row = tuple(event.get(name) for name in fields)
        frame = self.spark.createDataFrame([row], EVENTS)
        frame.write.mode("append").format("parquet").saveAsTable(self.name)

    def start(self) -> str:
        run_id = str(uuid.uuid4())
        self._append(run_id=run_id, status="running")
        return run_id

    def table(self, run_id: str, table_name: str, row_count: int) -> None:
        self._append(run_id=run_id, table_name=table_name, row_count=row_count)

    def finish(self, run_id: str, status: str, seconds: float, error: str | None = None) -> None:
        duration = Decimal(seconds).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
        self._append(
            run_id=run_id,
            status=status,
            duration_seconds=duration,
            error_message=error,
        )

    def events(self) -> DataFrame:
        return self.spark.table(self.name)

    def runs(self) -> DataFrame:
        return latest_runs(self.events())

    def tables(self) -> DataFrame:
        return run_tables(self.events())
