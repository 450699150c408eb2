"""Readers and writers for requests, labelled sets, results and summaries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import HISTORY_TYPE, strip

# Quoted fields may hold line breaks and doubled quotes, and edge blanks count.
CSV_DIALECT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
REQUEST_FIELDS = ("query", "primary_category")
OPTIONAL_REQUEST_FIELDS = ("ground_truth_2026",)
PAYLOAD_SCHEMA = f"query string, history {HISTORY_TYPE}"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV whose fields may span lines.  Without a schema every column is text.

    A multi-line file is read by one task, so write results as many files
    (see :func:`write_results`).
    """
    reader = spark.read.options(multiLine=True, **CSV_DIALECT)
    return (reader.schema(schema) if schema else reader).csv(path)


def scan_requests(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Request set: ``query, primary_category`` and, where present, the true answer."""
    df = read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    missing = set(REQUEST_FIELDS) - set(df.columns)
    if missing:
        raise ValueError(f"request set lacks {sorted(missing)}")
    optional = [
        F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
        for c in OPTIONAL_REQUEST_FIELDS
    ]
    return df.select(*REQUEST_FIELDS, *optional)


def scan_labelled(
    spark: SparkSession,
    path: str,
    question: str = "Question",
    label: str = "Temporal_Category",
    fmt: str | None = None,
) -> DataFrame:
    """Labelled questions; the format follows the file extension unless given."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        df = read_csv(spark, path)
    elif fmt in ("parquet", "json", "orc"):
        df = spark.read.format(fmt).load(path)
    else:
        raise ValueError(f"cannot read '{fmt}'; convert to csv, json, orc or parquet")
    missing = {question, label} - set(df.columns)
    if missing:
        raise ValueError(f"dataset must contain '{question}' and '{label}' columns")
    return df


def stripped_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    kept = lines.select(strip(F.col(column)).alias("query"))
    return kept.filter(F.length("query") > 0)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """One query per line, stripped, blank lines dropped."""
    return stripped_lines(spark.read.text(path))


def parse_requests(payload: Column) -> Column:
    """JSON request body as (query, history); history may be absent."""
    return F.from_json(payload, PAYLOAD_SCHEMA)


def scan_conversations(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines requests carrying their history."""
    return spark.read.schema(PAYLOAD_SCHEMA).json(path)


def write_results(df: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Result rows as CSV files with a header and no index column."""
    (
        df.write.mode("overwrite").options(quoteAll=True, maxRecordsPerFile=max_records, **CSV_DIALECT)
        .csv(path)
    )


def write_checkpoint(df: DataFrame, folder: str, prefix: str = "checkpoint") -> tuple[str, str]:
    """Results as CSV and JSON under a time-stamped name; returns both paths."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    base = f"{folder.rstrip('/')}/{prefix}_{stamp}"
    write_results(df, f"{base}.csv")
    df.write.mode("overwrite").json(f"{base}.json")
    return f"{base}.csv", f"{base}.json"


def write_summary(summary: DataFrame, path: str) -> None:
    """The one-row metrics document as JSON, stamped with the time of writing."""
    stamped = summary.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "*")
    stamped.coalesce(1).write.mode("overwrite").json(path)
