"""Trajectory checks as column expressions: format, tool evidence, coherence, correction, answer, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bind, col
from .text import contains_any, py_strip

# ---- Fixed values: tags, keywords, weights and issue texts that results depend on ----
REQUIRED_TAGS = ["<think>", "</think>", "<answer>", "</answer>"]
ATTEMPT_TAGS = ["<think>", "<answer>"]
REASONING_WORDS = ["visual", "observe", "analysis", "hypothesis", "plan", "观察", "分析", "假设", "计划", "发现"]
CORRECTION_WORDS = ["however", "but", "correction", "revise", "actually", "但是", "然而", "纠正", "修正", "实际上", "重新评估"]
WEIGHTS = {"xml_valid": 0.2, "tool_results_match": 0.25, "reasoning_coherent": 0.25, "correction_ok": 0.1, "answer_correct": 0.2}
RUBRIC_WEIGHTS = {"xml_valid": 0.10, "reasoning_coherent": 0.30, "tool_results_match": 0.40, "answer_correct": 0.20, "correction_ok": 0.0}
ISSUE_EMPTY = "轨迹为空"
ISSUE_TAG = "缺少必需标签: "
ISSUE_PAIRS = "tool_call (%d) 和 observation (%d) 数量不匹配"
ISSUE_START = "轨迹未以<think>开头"
ISSUE_TOOLS = "工具结果匹配率过低: %s"
ISSUE_NO_THINK = "没有找到think块"
ISSUE_HOLLOW = "过多空洞的think块: %d/%d"
ISSUE_WORDS = "缺少推理关键词"
ISSUE_CORRECTION = "Type B轨迹应包含纠错过程"
ISSUE_CALLS = "Type B轨迹应包含多个工具调用"
ISSUE_NO_ANSWER = "没有找到answer块"
ISSUE_ANSWER = "答案与ground truth匹配度过低: %s"
MIN_THINK_CHARS = 20
MAX_HOLLOW_SHARE = 0.3
MIN_TOOL_RATE = 0.5
MIN_ANSWER_RATE = 0.3
MIN_WORD_CHARS = 4


def occurrences(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def blocks(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1)


def percent_text(rate: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(rate * 100, 1))


def _verdict(chain: Column) -> Column:
    return F.struct(chain.isNull().alias("ok"), chain.alias("issue"))


def check_format(t: str | Column) -> Column:
    """struct(ok, issue): required tags, as many observations as calls, starts with a think block."""
    text = col(t)
    chain = F.when(F.coalesce(text, F.lit("")) == "", ISSUE_EMPTY)
    for tag in REQUIRED_TAGS:
        chain = chain.when(~text.contains(tag), ISSUE_TAG + tag)
    calls, seen = occurrences(text, "<tool_call>"), occurrences(text, "<observation>")
    chain = chain.when(calls != seen, F.format_string(ISSUE_PAIRS, calls, seen))
    return _verdict(chain.when(~py_strip(text).startswith("<think>"), ISSUE_START))


def check_tool_match(t: str | Column, log: str | Column, observations: Column | None = None) -> Column:
    """At least half of the log entries have their result's status in some observation; an empty log passes, an
    entry whose result has no status does not match."""
    entries = F.coalesce(F.transform(col(log), lambda e: F.struct(e["result"]["status"].alias("status"))), F.array().cast("array<struct<status:string>>"))
    seen = blocks(col(t), "observation") if observations is None else observations
    matched = bind(seen, lambda s: F.size(F.filter(entries, lambda e: F.exists(s, lambda o: o.contains(e["status"])))))
    rate = F.try_divide(F.greatest(matched, F.lit(0)), F.size(entries))
    return _verdict(F.when((F.size(entries) > 0) & (rate < MIN_TOOL_RATE), F.format_string(ISSUE_TOOLS, percent_text(rate))))


def check_coherence(t: str | Column, thinks: Column | None = None) -> Column:
    text = col(t)
    thinks = blocks(text, "think") if thinks is None else thinks
    n = F.size(thinks)
    hollow = F.size(F.filter(thinks, lambda b: F.length(py_strip(b)) < MIN_THINK_CHARS))
    chain = (
        F.when(n == 0, ISSUE_NO_THINK)
        .when(hollow > n * MAX_HOLLOW_SHARE, F.format_string(ISSUE_HOLLOW, hollow, n))
        .when(~contains_any(F.lower(text), REASONING_WORDS), ISSUE_WORDS)
    )
    return _verdict(chain)


def check_correction(t: str | Column) -> Column:
    text = col(t)
    chain = F.when(~contains_any(F.lower(text), CORRECTION_WORDS), ISSUE_CORRECTION).when(
        occurrences(text, "<tool_call>") < 2, ISSUE_CALLS
    )
    return _verdict(chain)


def truth_words(truth: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(truth)), F.lit(r"(?U)\w+"), 0)


def last_answer(answers: Column) -> Column:
    return F.lower(F.try_element_at(answers, F.lit(-1)))


def check_answer(
    t: str | Column, truth: str | Column, answers: Column | None = None, last: Column | None = None, words: Column | None = None
) -> Column:
    """Words of the truth longer than three characters found in the last answer, over all its words."""
    answers = blocks(col(t), "answer") if answers is None else answers
    last = last_answer(answers) if last is None else last
    words = truth_words(truth) if words is None else words
    hits = bind(last, lambda t: F.size(F.filter(words, lambda w: (F.length(w) >= MIN_WORD_CHARS) & t.contains(w))))
    rate = F.coalesce(F.try_divide(hits, F.size(words)), F.lit(0.0))
    chain = F.when(F.size(answers) == 0, ISSUE_NO_ANSWER).when(
        rate < MIN_ANSWER_RATE, F.format_string(ISSUE_ANSWER, percent_text(rate))
    )
    return _verdict(chain)


def quality_score(passed: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    total = None
    for name, weight in weights.items():
        part = F.when(passed[name], weight).otherwise(0.0)
        total = part if total is None else total + part
    return F.bround(total, 3)


def select_attempt(attempts: str | Column, required: Sequence[str] = ATTEMPT_TAGS) -> Column:
    """First attempt holding all required tags: struct(trajectory, attempt, error); all attempts stay in place."""
    tries = col(attempts)
    ok = F.get(F.filter(tries, lambda a: _has_all(a["trajectory"], required)), F.lit(0))
    return F.struct(
        ok["trajectory"].alias("trajectory"), ok["attempt"].alias("attempt"),
        F.when(ok.isNull(), F.concat(F.lit("no usable attempt out of "), F.size(tries).cast("string"))).alias("error"),
    )


def _has_all(text: Column, tags: Sequence[str]) -> Column:
    hit = text.isNotNull()
    for tag in tags:
        hit = hit & text.contains(tag)
    return hit


def missing_tags(text: Column, required: Sequence[str] = ATTEMPT_TAGS) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(text, F.lit("")).contains(t), t) for t in required]))


PLACEHOLDER = r"\[TOOL_RESULT_PLACEHOLDER:(\w+)\]"


def fill_placeholders(t: str | Column, summaries: str | Column) -> Column:
    """struct(text, found, left): placeholders replaced by the named tool's summary, unknown ones kept.

    The text is split at placeholders once, so inserted summaries are never searched again.
    """
    text, table = col(t), col(summaries)
    names = F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1)
    parts = F.split(text, PLACEHOLDER, -1)
    pieces = F.transform(names, lambda n: F.coalesce(
        F.try_element_at(table, n), F.concat(F.lit("[TOOL_RESULT_PLACEHOLDER:"), n, F.lit("]"))
    ))
    filled = F.zip_with(parts, pieces, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    known = F.size(F.filter(names, lambda n: F.try_element_at(table, n).isNotNull()))
    return F.struct(
        F.array_join(filled, "").alias("text"), F.size(names).alias("found"), (F.size(names) - known).alias("left")
    )
