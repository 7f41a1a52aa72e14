"""Text columns: option expansion, rule matching, answer parsing, salvage of JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col
from .phrases import Hits

OPTION_LETTERS = "ABCDEFGH"


def py_strip(c: Column) -> Column:
    """Strip every kind of white space at both ends, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _option_text(question: Column, letter: Column) -> Column:
    """Text after ``X:`` or, failing that, ``X)`` up to the line end; null when neither occurs. Each letter has a
    pattern of its own, so that it is compiled once and not for every row."""
    def after(x: str, mark: str) -> Column:
        return F.get(F.regexp_extract_all(question, F.lit(rf"(?iU){x}{mark}\s*([^\n]+)"), 1), F.lit(0))

    found = None
    for x in OPTION_LETTERS:
        text = F.coalesce(after(x, ":"), after(x, r"\)"))
        found = F.when(letter == x, text) if found is None else found.when(letter == x, text)
    return F.lower(py_strip(found))


def expand_answer(question: str | Column, answer: str | Column) -> Column:
    """Option letters in the answer → lower-cased option texts from the question, joined by blanks.

    A letter that cannot be found is left out of a list; when nothing is found the lower-cased
    answer itself is returned. The first ``b:`` anywhere in the question counts.
    """
    q, a = col(question), col(answer)
    letters = F.split(F.upper(py_strip(a)), ",")
    trimmed = F.transform(letters, py_strip)
    valid = F.filter(trimmed, lambda x: x.rlike(f"^[{OPTION_LETTERS}]$"))
    texts = F.filter(F.transform(valid, lambda x: _option_text(q, x)), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(texts, " ")).otherwise(F.lower(a))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = text.contains(words[0])
    for w in words[1:]:
        hit = hit | text.contains(w)
    return hit


def rule_phrases(rules: Sequence[dict]) -> list[str]:
    """All phrases that conditions, boosts and word groups of ``rules`` look for."""
    found = []
    for rule in rules:
        for _, _, words in [*rule["when"], *([rule["boost"][0]] if "boost" in rule else [])]:
            found.extend(words)
        for words in rule.get("detect", {}).values():
            found.extend(words)
    return list(dict.fromkeys(found))


def _condition(where: str, mode: str, words: Sequence[str], hits: Hits) -> Column:
    found = None
    for name in ("a", "q"):
        if name in where:
            found = hits(name, words) if found is None else found | hits(name, words)
    return ~found if mode == "none" else found


def rule_number(hits: Hits, rules: Sequence[dict]) -> Column:
    """Position of the first rule whose conditions all hold; null when none does. ``hits`` tells of phrases in the
    lower-cased question ``q`` and answer ``a``."""
    chain = None
    for number, rule in enumerate(rules):
        holds = None
        for condition in rule["when"]:
            part = _condition(*condition, hits)
            holds = part if holds is None else holds & part
        chain = F.when(holds, number) if chain is None else chain.when(holds, number)
    return chain


def rule_label(number: str | Column, hits: Hits, rules: Sequence[dict]) -> Column:
    """struct(type, subtype, confidence, description) of rule ``number``; null for no rule."""
    n = col(number)

    def lookup(value) -> Column:
        chain = None
        for i, rule in enumerate(rules):
            v = value(rule)
            chain = F.when(n == i, v) if chain is None else chain.when(n == i, v)
        return chain

    def confidence(rule: dict) -> Column:
        base = F.lit(float(rule["confidence"]))
        if "boost" in rule:
            condition, high = rule["boost"]
            base = F.when(_condition(*condition, hits), float(high)).otherwise(base)
        return base

    def description(rule: dict) -> Column:
        text = F.lit(rule["description"])
        if "detect" in rule:
            names = [F.when(hits("a", words), name) for name, words in rule["detect"].items()]
            text = F.concat(text, F.concat_ws(", ", *names))
        return text

    label = F.struct(
        lookup(lambda r: F.lit(r["type"])).alias("type"),
        lookup(lambda r: F.lit(r["subtype"])).alias("subtype"),
        lookup(confidence).alias("confidence"),
        lookup(description).alias("description"),
    )
    return F.when(n.isNotNull(), label)


def parse_answer(message: str | Column) -> Column:
    """First ``<answer>`` block (any case), trimmed; else a lone letter A-D in upper case; else null."""
    m = col(message)
    blocks = F.regexp_extract_all(m, F.lit(r"(?is)<answer>(.*?)</answer>"), 1)
    bare = F.upper(py_strip(m))
    return F.coalesce(py_strip(F.get(blocks, F.lit(0))), F.when(bare.rlike("^[A-D]$"), bare))


def label_list(c: str | Column) -> Column:
    """Comma list → sorted array of trimmed labels."""
    return F.array_sort(F.transform(F.split(col(c), ","), py_strip))


def is_correct(predicted: str | Column, truth: str | Column, mode: str = "single") -> Column:
    """``single``: exact equality, unparsed counts as wrong. ``multi``: same label list in any order."""
    p, t = col(predicted), col(truth)
    if mode == "single":
        return F.coalesce(p == t, F.lit(False))
    if mode == "multi":
        truth_labels = F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(label_list(t))
        return label_list(p) == truth_labels
    raise ValueError(f"unknown mode {mode!r}")


def is_one_json(text: Column) -> Column:
    """The whole text is one JSON value. Spark's parsers stop after the first value, so text behind it
    would pass; as an array element it cannot. Counting elements skips values without building them."""
    two = lambda before, after: F.json_array_length(F.concat(F.lit(before), text, F.lit(after))) == 2
    return F.coalesce(two("[", ",0]") & two("[0,", "]"), F.lit(False))


def outer_json(c: str | Column) -> Column:
    """Text from the first ``{`` to the last ``}`` when it is valid JSON, else null."""
    t = col(c)
    start = F.instr(t, "{")
    end = F.length(t) - F.instr(F.reverse(t), "}") + 1
    body = F.when((start > 0) & F.contains(t, F.lit("}")) & (end >= start), F.substring(t, start, end - start + 1))
    return F.when(is_one_json(body), body)


def last_json_object(text: str | None) -> str | None:
    """Last complete top-level JSON object in noisy text, as written."""
    if text is None:
        return None
    decoder, found, at = json.JSONDecoder(), None, 0
    while True:
        # arrays and strings are values too: braces inside them are not top level
        starts = [i for i in (text.find(ch, at) for ch in '{["') if i >= 0]
        if not starts:
            return found
        at = min(starts)
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, dict):
            found = text[at:end]
        at = end


@F.pandas_udf(T.StringType())
def _last_json(texts: pd.Series) -> pd.Series:
    return texts.map(last_json_object)


def salvage_json(c: str | Column, mode: str = "last") -> Column:
    if mode == "outer":
        return outer_json(c)
    if mode == "last":
        return _last_json(col(c))
    raise ValueError(f"unknown mode {mode!r}")
