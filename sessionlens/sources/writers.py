"""Session and report sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, functions as F

from sessionlens.operators.dataset import flat_rows
from sessionlens.session import file_system
from sessionlens.sources.validation import DatasetValidationError, with_round_trip

_EXTRA = ("row_id", "issues")


def write_sessions(sessions: DataFrame, path: str, mode: str = "errorifexists", check: bool = True) -> None:
    """One JSON object per session, absent values left out.

    With ``check`` every row must survive a round trip.  The rows are read once: the
    text that is written is the text that is checked, into a staging folder beside
    ``path``; while it is written, an observation counts the invalid rows and keeps
    the first of them.  Only a write without any is moved to ``path``, so a bad row
    leaves nothing behind.
    """
    plain = sessions.drop(*_EXTRA)
    if not check:
        plain.write.mode(mode).json(path)
        return
    spark = sessions.sparkSession
    files, target = file_system(spark, path)
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError("a checked write creates or replaces its folder: mode is errorifexists or overwrite")
    if mode != "overwrite" and files.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}._staged-{uuid.uuid4().hex}"
    seen = Observation("written")
    checked = with_round_trip(plain).observe(
        seen, F.count_if(F.size("issues") > 0).alias("bad"),
        F.min(F.when(F.size("issues") > 0, F.struct("session_id", F.array_join("issues", "; ").alias("why")))).alias("first"))
    _, place = file_system(spark, staged)
    try:
        checked.select("value").write.text(staged)
        found = seen.get
        if found["bad"]:
            raise DatasetValidationError(f"{found['bad']} sessions are invalid, such as {found['first']['session_id']}: {found['first']['why']}")
        if files.exists(target):
            files.delete(target, True)
        if not files.rename(place, target):
            raise OSError(f"{staged} could not be moved to {path}")
    finally:
        if files.exists(place):
            files.delete(place, True)


def write_flat_rows(sessions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The flattened 21 columns as CSV with a header."""
    flat_rows(sessions).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_report(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Every table of a report as JSON rows under ``folder/<name>``."""
    for name, table in tables.items():
        table.write.mode(mode).option("ignoreNullFields", False).json(f"{folder}/{name}")


def report_documents(table: DataFrame) -> DataFrame:
    """One JSON text per row, keys in sorted order."""
    return table.select(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}).alias("document"))


def document_text(row: DataFrame) -> str | None:
    """A one-row report as indented JSON with sorted keys; None without a row."""
    first = report_documents(row).limit(1).collect()
    return json.dumps(json.loads(first[0]["document"]), indent=2, sort_keys=True) if first else None


def save_document(row: DataFrame, path: str) -> None:
    """Store a one-row report (such as the best-model metadata) as one JSON file, in any store that Spark writes."""
    files, target = file_system(row.sparkSession, path)
    stream = files.create(target, True)
    try:
        stream.write(bytearray((document_text(row) or "null").encode()))
    finally:
        stream.close()
