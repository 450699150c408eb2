"""Evaluation of a probe set: decisions joined with truth, metrics, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plugins import Scorer
from ..functions.scores import is_hit
from ..operators import metrics
from ..operators.memo import memo_score
from ..session import written
from ..sources import io

REPORT_COLUMNS = (
    "query", "true_category", "predicted_category", "source", "latency", "confidence", "cache_hit",
    "volatile_bypass", "gemini_call", "similarity", "cached_response", "ground_truth",
)
WRONG_HIT_COLUMNS = (
    "query", "true_category", "source", "similarity_to_gt", "is_wrong_hit", "ground_truth", "cached_response",
)


def evaluation_rows(decisions: DataFrame, probes: DataFrame) -> DataFrame:
    """Report rows from decisions and ``probes(req_id, primary_category[, ground_truth_2026])``.

    Fields a path does not produce take the report's defaults: label Unknown,
    numbers 0, answer empty.  A probe without a decision is an ERROR row.
    """
    truth = probes.select(
        "req_id",
        F.col("query").alias("_asked"),
        F.col("primary_category").alias("true_category"),
        (F.col("ground_truth_2026") if "ground_truth_2026" in probes.columns else F.lit(None).cast("string")).alias("ground_truth"),
    )
    latency = F.col("latency") if "latency" in decisions.columns else F.lit(0.0)
    taken = decisions.select(
        "req_id", "query", "source", F.col("category").alias("predicted_category"), "confidence",
        "similarity", F.col("answer").alias("cached_response"), latency.alias("latency"),
    )
    joined = truth.join(taken, "req_id", "left").withColumn("query", F.coalesce("query", "_asked"))
    return metrics.decision_flags(joined).fillna(
        {"latency": 0.0, "confidence": 0.0, "similarity": 0.0, "cached_response": ""}
    ).select("req_id", *REPORT_COLUMNS)


def with_answer_vectors(rows: DataFrame, embedder: Scorer) -> DataFrame:
    """Vectors of truth and served answer, each distinct text embedded once."""
    served = rows.filter(is_hit(F.col("source")))
    served = memo_score(served, ["ground_truth"], embedder, "truth_vector")
    return memo_score(served, ["cached_response"], embedder, "served_vector")


def write_evaluation(
    rows: DataFrame, folder: str, embedder: Scorer | None = None, threshold: float = 0.70
) -> dict[str, str]:
    """Result rows, summary and wrong hits below ``folder``; returns their paths."""
    rows = written(rows, "evaluation")
    paths = {"results": f"{folder}/results.csv", "summary": f"{folder}/summary.json"}
    io.write_results(rows.drop("req_id"), paths["results"])
    io.write_summary(metrics.evaluation_summary(rows), paths["summary"])
    if embedder is not None:
        wrong = metrics.wrong_hit_rows(with_answer_vectors(rows, embedder), threshold)
        paths["wrong_hits"] = f"{folder}/wrong_hits.csv"
        io.write_results(wrong.select(*WRONG_HIT_COLUMNS), paths["wrong_hits"])
    return paths
