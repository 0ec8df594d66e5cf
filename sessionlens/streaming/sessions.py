"""The same row-wise operators on a stream of session lines.

Reading, checking and diagnosing a session need no state, so the batch functions
apply unchanged; each record is complete when it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sessionlens.functions.text import is_blank
from sessionlens.plans.diagnose import diagnose
from sessionlens.sources.readers import parse_sessions


def stream_sessions(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Checked session rows (with ``issues``) from JSON-line files that keep arriving in ``folder``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_sessions(lines.where(f"not {is_blank('value')}"))


def stream_diagnoses(sessions: DataFrame, **options) -> DataFrame:
    """Diagnoses of the valid sessions, without history."""
    return diagnose(sessions.where("size(issues) = 0").drop("issues"), **options)


def start_parquet(frame: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (frame.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
