"""Session sources: JSON lines, flat CSV, single documents, stored reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sessionlens.functions.text import is_blank
from sessionlens.operators.dataset import features_of_flat_rows, features_of_sessions
from sessionlens.schema import SESSION_DDL
from sessionlens.sources.csv_records import read_records
from sessionlens.sources.validation import LISTS, DatasetValidationError, canonical_uuid, with_issues

_PLACE = ("_metadata.file_path file", "_metadata.file_block_start block", "monotonically_increasing_id() row_id")


@dataclass(frozen=True)
class Loaded:
    """Valid rows, and (row_number, message, file) of the others."""

    rows: DataFrame
    issues: DataFrame


def _row_numbers(bad: DataFrame, every: DataFrame, first: int) -> DataFrame:
    """Row numbers within the file for the rows in ``bad``.

    Positions in a block are shifted by the rows of the earlier blocks; only bad
    rows are joined, so reading good data never pays for this.  The blocks (one row
    per split of a file) are the side that is broadcast: the size of parsed text is
    estimated far too small, and the bad rows would pass through the driver.
    """
    blocks = every.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row_id").alias("base"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    placed = blocks.withColumn("earlier", earlier)
    return bad.join(F.broadcast(placed), ["file", "block"]).selectExpr(
        f"earlier + row_id - base + {first} row_number", "message", "file")


def _finish(rows: DataFrame, issues: DataFrame, strict: bool) -> Loaded:
    if strict:
        first = issues.orderBy("file", "row_number").limit(1).collect()
        if first:
            raise DatasetValidationError(f"Row {first[0]['row_number']}: {first[0]['message']}")
    return Loaded(rows, issues)


def parse_sessions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Session columns and ``issues`` from a text column holding one JSON record each.

    Works the same on a batch and on a stream of lines.
    """
    ddl = " ".join((SESSION_DDL + ", _corrupt STRING").split())
    nulls = " or ".join(
        f"is_variant_null(try_variant_get(try_parse_json({column}), '$.{n}', 'variant'))" for n in LISTS)
    suspicious = f"{column} rlike r'\"({'|'.join(LISTS)})\"\\s*:\\s*null'"
    kept = [c for c in lines.columns if c != column]
    # inline() keeps later filters above the parse; pushed below it they would repeat from_json per field
    parsed = lines.selectExpr(
        *kept, f"coalesce(case when {suspicious} then {nulls} end, false) _null_list",
        f"inline(array(from_json({column}, '{ddl}',"
        " map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_corrupt'))))")
    empty = ", ".join(LISTS)
    checked = with_issues(parsed).selectExpr(
        f"* except (issues, _corrupt, _null_list, {empty})", *(f"coalesce({n}, array()) {n}" for n in LISTS),
        "case when _corrupt is not null then array('Invalid JSON or field type')"
        " when _null_list then array_append(issues, 'list fields must not be null') else issues end issues")
    return checked.withColumn("session_id", F.expr(canonical_uuid("session_id")))


def read_sessions(spark: SparkSession, path: str | list[str], strict: bool = False) -> Loaded:
    """One JSON record per line.  Blank lines are skipped but counted in row numbers (from 1)."""
    lines = spark.read.text(path).selectExpr("value", *_PLACE)
    parsed = parse_sessions(lines.where(f"not {is_blank('value')}"))
    good = parsed.where("size(issues) = 0").drop("issues", "file", "block")
    bad = parsed.where("size(issues) > 0").selectExpr("file", "block", "row_id", "array_join(issues, '; ') message")
    return _finish(good, _row_numbers(bad, lines, 1), strict)


def _split_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cells of the records of quoted CSV files, with their place; every file may be read by many tasks."""
    head = spark.read.option("multiLine", True).option("escape", '"').csv(path).first()
    if head is None:
        raise DatasetValidationError("a flat file needs a header")
    names = [name or f"_c{i}" for i, name in enumerate(head)]
    if len({n.lower() for n in names}) < len(names):
        raise DatasetValidationError("a flat file names a column twice")
    records = read_records(spark, path)
    ddl = ", ".join(f"`{n}` STRING" for n in names)
    parsed = records.select("file", "block", "row_id", "header", F.from_csv("value", F.lit(ddl), {"escape": '"'}).alias("cells"))
    own = F.array(*(F.coalesce(F.col("cells")[n], F.lit(f"_c{i}")) for i, n in enumerate(names)))
    same = F.regexp_replace(F.concat_ws("\x00", own), "^\ufeff", "") == F.lit("\x00".join(names).removeprefix("\ufeff"))
    wrong = F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean")
    data = parsed.where(F.when(F.col("header"), F.when(same, F.lit(False)).otherwise(wrong)).otherwise(F.lit(True)))
    return data.select(*(F.col("cells")[n].alias(n.removeprefix("\ufeff")) for n in names), "file", "block", "row_id")


def read_flat_rows(spark: SparkSession, path: str | list[str], strict: bool = False, multiline: bool = True, split: bool = True) -> Loaded:
    """Flat CSV with a header.  Rows without session id become issues; row numbers start at 2.

    All files must have the same header; reading one with another header fails.
    Cells may hold line breaks, and still many tasks read one file (see ``csv_records``).
    ``split=False`` gives each file to one task of Spark's own reader, which is lenient with
    stray quotes; ``multiline=False`` reads line by line where no cell holds a line break.
    """
    if multiline and split:
        raw = _split_rows(spark, path)
        names, place = raw.columns[:-3], raw.columns[-3:]
    else:
        raw = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("enforceSchema", False).csv(path)
        names, place = raw.columns, _PLACE
    if "session_id" not in names:
        raise DatasetValidationError("a flat file needs a session_id column")
    rows = raw.selectExpr(*(f"coalesce(`{c}`, '') `{c}`" for c in names), *place)
    good = rows.where("session_id <> ''").drop("file", "block")
    bad = rows.where("session_id = ''").selectExpr("file", "block", "row_id", "'Missing session_id.' message")
    return _finish(good, _row_numbers(bad, rows, 2), strict)


def load_features(spark: SparkSession, path: str, strict: bool = False) -> Loaded:
    """Feature table from a dataset file, by its suffix."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in (".jsonl", ".ndjson"):
        loaded = read_sessions(spark, path, strict)
        return Loaded(features_of_sessions(loaded.rows), loaded.issues)
    if suffix == ".csv":
        loaded = read_flat_rows(spark, path, strict)
        return Loaded(features_of_flat_rows(loaded.rows), loaded.issues)
    raise ValueError(f"Unsupported dataset format: {suffix}")


def read_session_document(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one JSON session, over any number of lines."""
    text = spark.read.text(path, wholetext=True).selectExpr("value", "0L row_id")
    state = parse_sessions(text).selectExpr("size(issues) n")
    if text.where(f"not {is_blank('value')}").isEmpty():
        raise ValueError("The uploaded file is empty.")
    if not state.where("n > 0").isEmpty():
        raise ValueError("The uploaded JSON is not a valid session.")
    return parse_sessions(text).drop("issues")


def read_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, report variant) of the JSON reports that can be parsed; empty or broken files drop out."""
    return spark.read.text(path, wholetext=True).selectExpr(
        "_metadata.file_path file", "try_parse_json(value) report").where("report is not null")


def importance_reports(reports: DataFrame) -> DataFrame:
    """(model_name, ranking) out of stored importance reports."""
    item = "array<struct<feature_name: string, importance_score: double, normalized_score: double, rank: bigint>>"
    return reports.selectExpr("try_variant_get(report, '$.model_name', 'string') model_name",
                              f"try_variant_get(report, '$.ranking', '{item}') ranking")
