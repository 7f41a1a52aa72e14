"""Trajectory validation rows, reports and filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trajectory as J
from .ordering import once

CHECKS = ["xml_valid", "tool_results_match", "reasoning_coherent", "correction_demonstrated", "ground_truth_reached"]


def validate(
    df: DataFrame,
    trajectory: str = "trajectory",
    log: str = "tool_execution_log",
    truth: str = "ground_truth_answer",
    rtype: str = "reasoning_type",
    weights: dict[str, float] = J.WEIGHTS,
) -> DataFrame:
    """Adds the five check flags, ``quality_score`` and ``issues`` in check order.

    The correction check applies to type B only; it is false for others but counts as passed in the score.
    """
    is_b = F.coalesce(F.col(rtype).startswith("B"), F.lit(False))
    parts = once(
        df, __th=J.blocks(F.col(trajectory), "think"), __ob=J.blocks(F.col(trajectory), "observation"),
        __an=J.blocks(F.col(trajectory), "answer"), __w=J.truth_words(truth),
    )
    checked = once(
        parts.withColumn("__last", J.last_answer(F.col("__an"))),
        __f=J.check_format(trajectory), __t=J.check_tool_match(trajectory, log, F.col("__ob")),
        __c=J.check_coherence(trajectory, F.col("__th")), __b=F.when(is_b, J.check_correction(trajectory)),
        __a=J.check_answer(trajectory, truth, F.col("__an"), F.col("__last"), F.col("__w")),
    )
    correction = F.coalesce(F.col("__b.ok"), F.lit(False))
    score = J.quality_score({
        "xml_valid": F.col("__f.ok"), "tool_results_match": F.col("__t.ok"), "reasoning_coherent": F.col("__c.ok"),
        "correction_ok": F.when(is_b, correction).otherwise(F.lit(True)), "answer_correct": F.col("__a.ok"),
    }, weights)
    return checked.select(
        *df.columns,
        F.col("__f.ok").alias("xml_valid"), F.col("__t.ok").alias("tool_results_match"),
        F.col("__c.ok").alias("reasoning_coherent"), correction.alias("correction_demonstrated"),
        F.col("__a.ok").alias("ground_truth_reached"), score.alias("quality_score"),
        F.array_compact(F.array(*[F.col(f"{c}.issue") for c in ("__f", "__t", "__c", "__b", "__a")])).alias("issues"),
    )


@dataclass
class FilterPolicy:
    """``min_score`` is out of 1. Rows failing a required check are dropped; a demonstrated correction is
    kept whatever its score, but never with a format failure or unmatched tool evidence."""

    weights: dict[str, float] = field(default_factory=lambda: dict(J.WEIGHTS))
    min_score: float = 0.5
    required: tuple[str, ...] = ("xml_valid", "tool_results_match")
    keep_corrections: bool = True


def filter_trajectories(validated: DataFrame, policy: FilterPolicy | None = None, rtype: str = "reasoning_type") -> DataFrame:
    p = policy or FilterPolicy()
    is_b = F.coalesce(F.col(rtype).startswith("B"), F.lit(False))
    score = J.quality_score({
        "xml_valid": F.col("xml_valid"), "tool_results_match": F.col("tool_results_match"),
        "reasoning_coherent": F.col("reasoning_coherent"), "answer_correct": F.col("ground_truth_reached"),
        "correction_ok": F.when(is_b, F.col("correction_demonstrated")).otherwise(F.lit(True)),
    }, p.weights)
    enough = score >= p.min_score
    if p.keep_corrections:
        enough = enough | F.col("correction_demonstrated")
    for c in p.required:
        enough = enough & F.col(c)
    return validated.where(enough)


def validation_report(df: DataFrame, pass_at: float = 0.7, trajectory: str = "trajectory", score: str = "quality_score") -> DataFrame:
    """Total, validated (non-empty trajectory), mean score and pass rate over validated rows, to 3 places."""
    done = F.coalesce(F.col(trajectory) != "", F.lit(False))
    out = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("validated"),
        F.avg(F.when(done, F.col(score))).alias("__m"), F.count_if(done & (F.col(score) >= pass_at)).alias("__p"),
    )
    return out.select(
        "total", "validated", F.coalesce(F.bround("__m", 3), F.lit(0.0)).alias("avg_quality_score"),
        F.coalesce(F.bround(F.try_divide("__p", "validated"), 3), F.lit(0.0)).alias("pass_rate"),
    )


def issue_summary(df: DataFrame, k: int | None = 10, coded: bool = False, issues: str = "issues") -> DataFrame:
    """Issue frequency, most frequent first (ties by text). ``coded`` strips the numbers out of the texts."""
    text = F.col("issue")
    if coded:
        text = F.regexp_replace(text, r"\d+(\.\d+)?%?", "#")
    counts = df.select(F.explode(issues).alias("issue")).groupBy(text.alias("issue")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), "issue")
    return ordered if k is None else ordered.limit(k)
