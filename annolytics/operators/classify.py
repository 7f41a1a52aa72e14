"""Rule-based classification, gates, plans and evidence-driven relabelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phrases import Phrases
from ..functions.text import expand_answer, rule_label, rule_number, rule_phrases
from ..plans import rules as R
from .examples import may_become_correction
from .ordering import attach_row, once


def classify(
    df: DataFrame,
    question: str = "question",
    answer: str = "ground_truth_answer",
    rules: Sequence[dict] = R.MEDICAL_RULES,
    expand: bool = True,
) -> DataFrame:
    """Adds ``answer_text`` (options expanded, lower case), ``label`` struct or null.

    Lower-cased texts, the phrases in them and the rule number are each computed once per row, also under
    later filters on the label. Each text is read once for all rules.
    """
    text = expand_answer(question, answer) if expand else F.lower(F.col(answer))
    lowered = once(df, __q=F.lower(F.col(question)), answer_text=text)
    return _apply_rules(lowered, "answer_text", rules, "label").drop("__q")


def _apply_rules(df: DataFrame, answer_text: str, rules: Sequence[dict], name: str) -> DataFrame:
    """``df`` plus the label struct of the first rule that holds for ``__q`` and ``answer_text``."""
    phrases = Phrases(rule_phrases(rules))
    found = df.withColumns({"__hits_q": phrases.find("__q"), "__hits_a": phrases.find(answer_text)})
    hits = phrases.hits({"q": "__hits_q", "a": "__hits_a"})
    numbered = once(found, __rule=rule_number(hits, rules))
    return numbered.withColumn(name, rule_label("__rule", hits, rules)).drop("__hits_q", "__hits_a", "__rule")


def check_corrections(df: DataFrame, question: str = "question", answer_text: str = "answer_text") -> DataFrame:
    """The correction (B) rules on their own, as ``correction`` struct or null."""
    lowered = once(df, __q=F.lower(F.col(question)))
    return _apply_rules(lowered, answer_text, R.CORRECTION_RULES, "correction").drop("__q")


def gate_types(
    df: DataFrame,
    allowed: Sequence[str] | None,
    skip_healthy: bool = False,
    initial: str = "label",
    final: str | None = None,
    answer_text: str = "answer_text",
) -> DataFrame:
    """Adds ``skip_reason`` (null = keep): unclassified, type filter before and after relabelling, healthy.

    Before relabelling, a row passes a filter that includes B if it may still become B, and one that
    includes E always.
    """
    first, last = F.col(initial), F.coalesce(F.col(final), F.col(initial)) if final else F.col(initial)
    reason = F.when(first.isNull(), "unclassified")
    if allowed is not None:
        passes = first["type"].isin(*allowed)
        if "B" in allowed:
            passes = passes | ((first["type"] == "A") & may_become_correction(F.col(answer_text)))
        if "E" in allowed:
            passes = F.lit(True)
        reason = reason.when(~passes, "type filter").when(~last["type"].isin(*allowed), "type filter after relabel")
    if skip_healthy:
        reason = reason.when((last["type"] == "A") & (last["subtype"] == "healthy"), "healthy skipped")
    return df.withColumn("skip_reason", reason)


def resolve_dependencies(requested: Column, dependencies: dict[str, Sequence[str]]) -> Column:
    """Put each missing dependency right before the first step that needs it; drop duplicates.

    One level only; a dependency that is itself requested later keeps its requested place.
    """
    if dependencies:
        pairs = [x for k, v in dependencies.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))]
        needs = F.create_map(*pairs)
    else:
        needs = F.create_map().cast("map<string,array<string>>")
    empty = F.array().cast("array<string>")

    def with_needs(step: Column) -> Column:
        missing = F.filter(F.coalesce(needs[step], empty), lambda d: ~F.array_contains(requested, d))
        return F.array_append(missing, step)

    return F.array_distinct(F.flatten(F.transform(requested, with_needs)))


def plan_tools(
    df: DataFrame,
    plans: dict[tuple[str, str], Sequence[str]] = R.TOOL_PLANS,
    dependencies: dict[str, Sequence[str]] = R.TOOL_DEPENDENCIES,
    default: Sequence[str] = R.DEFAULT_PLAN,
    type_col: str = "label.type",
    subtype_col: str = "label.subtype",
) -> DataFrame:
    """Adds ``plan`` for (type, subtype), the default for unknown ones, and ``steps`` with dependencies."""
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(t, s, list(steps)) for (t, s), steps in plans.items()], "__t string, __s string, plan array<string>"
    )
    joined = df.join(  # the plan table is code, a few dozen rows
        F.broadcast(table), (F.col(type_col) == F.col("__t")) & (F.col(subtype_col) == F.col("__s")), "left"
    ).drop("__t", "__s")
    fallback = F.array(*[F.lit(s) for s in default]) if default else F.array().cast("array<string>")
    planned = joined.withColumn("plan", F.coalesce("plan", fallback))
    return planned.withColumn("steps", resolve_dependencies(F.col("plan"), dependencies))


def missing_steps(plan: Column, done: Column) -> Column:
    """Planned steps not yet done, order and repeats kept."""
    finished = F.coalesce(done, F.array().cast("array<string>"))
    return F.filter(plan, lambda s: ~F.array_contains(finished, s))


def distribution_gap(df: DataFrame, target: dict[str, float] = R.TARGET_SHARES, type_col: str = "label.type") -> DataFrame:
    """Share of each type among classified rows against its target share."""
    shares = df.where(F.col(type_col).isNotNull()).groupBy(F.col(type_col).alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    )
    goals = df.sparkSession.createDataFrame(list(target.items()), "type string, target double")
    total = shares.agg(F.sum("n").alias("total"))
    joined = attach_row(shares.join(F.broadcast(goals), "type", "full_outer"), total)
    actual = F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("total")), F.lit(0.0))
    return joined.select(
        "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"), actual.alias("share"),
        F.coalesce("target", F.lit(0.0)).alias("target"), (actual - F.coalesce("target", F.lit(0.0))).alias("gap"),
    )


def extract_evidence(df: DataFrame, results: str = "tool_results", name: str = "evidence", text: str | None = None) -> DataFrame:
    """``results`` is a VARIANT column (use ``parse_json`` on text); ``text``, the same as JSON text, keeps the
    order of tasks, which VARIANT sorts by name."""
    from ..functions.evidence import findings, read_results

    read = once(df, __read=read_results(results))
    found = findings("__read", text)
    for finding, value in found.items():  # one step each: the code of all in one is too long to be compiled well
        read = once(read, **{f"__{finding}": value})
    return read.select(*df.columns, F.struct(*[F.col(f"__{n}").alias(n) for n in found]).alias(name))


def adjust_labels(
    df: DataFrame, label: str = "label", answer_text: str = "answer_text", ev: str = "evidence", truth: str | None = None
) -> DataFrame:
    """Adds ``initial_label``, ``final_label`` and, where a rule changed it, the ``rule``, its ``reason`` and what
    that rests on (``reason_evidence``, with the answer as in ``truth``); else these three are null."""
    from ..functions.evidence import reason_evidence, relabel

    changed = once(df, __new=relabel(label, answer_text, ev))
    new = F.col("__new")
    return changed.select(
        *df.columns, F.col(label).alias("initial_label"),
        F.when(new.isNotNull(), F.struct(*[new[f].alias(f) for f in ("type", "subtype", "confidence", "description")]))
        .otherwise(F.col(label)).alias("final_label"),
        new["rule"].alias("rule"), new["reason"].alias("reason"),
        reason_evidence(new["rule"], truth or answer_text, ev).alias("reason_evidence"),
    )
