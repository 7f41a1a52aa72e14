import pytest
from pyspark.sql import functions as F

from annolytics.functions import text as X
from annolytics.functions import trajectory as J
from annolytics.operators import validation as V

THINK = "<think>first a visual look at the picture</think>"
GOOD = THINK + "<tool_call>x</tool_call><observation>status success</observation><answer>moderate severe disease</answer>"
LOG = "tool_execution_log array<struct<tool_name:string,result:struct<status:string>>>"
SCHEMA = f"trajectory string, {LOG}, ground_truth_answer string, reasoning_type string"


def validated(spark, *cases):
    return V.validate(spark.createDataFrame(list(cases), SCHEMA)).collect()


def test_good_and_bad(spark):
    good, empty, pairs, start = validated(
        spark,
        (GOOD, [("t", ("success",))], "moderate disease", "A-x"),
        ("", [], "x", None),
        (GOOD + "<tool_call>y</tool_call>", [("t", ("failed",)), ("t", ("failed",))], "unrelated words everywhere", "B-x"),
        ("oops " + GOOD, [], "moderate disease", "A"),
    )
    assert good.quality_score == 1.0 and good.issues == [] and not good.correction_demonstrated
    assert empty.issues == ["轨迹为空", "没有找到think块", "没有找到answer块"] and empty.quality_score == 0.35
    assert pairs.issues == ["tool_call (2) 和 observation (1) 数量不匹配", "工具结果匹配率过低: 0.0%", "Type B轨迹应包含纠错过程", "答案与ground truth匹配度过低: 0.0%"]
    assert start.issues == ["轨迹未以<think>开头"]


def test_tag_order_and_hollow_blocks(spark):
    a, b, c = validated(
        spark, ("<think>x<answer>y</answer>", None, "y", None), ("<think>   </think><think>short</think><answer>yyyy</answer>", [], "yyyy", None),
        ("<think>nothing that counts is in here</think><answer>yyyy</answer>", [], "yyyy", None),
    )
    assert a.issues[0] == "缺少必需标签: </think>" and b.issues == ["过多空洞的think块: 2/2"] and c.issues == ["缺少推理关键词"]


def test_correction(spark):
    t = THINK + "but then" + "<tool_call>a</tool_call><observation>o</observation>" * 2 + "<answer>word</answer>"
    (r,) = validated(spark, (t, [], "word", "B"))
    assert r.correction_demonstrated and r.quality_score == 1.0


def test_answer_uses_last_block_and_all_words(spark):
    ok = lambda t, truth: spark.range(1).select(J.check_answer(F.lit(t), F.lit(truth)).alias("r")).first().r
    assert ok("<answer>no</answer><answer>Große Läsion</answer>", "große läsion").ok
    # short words count in the denominator only
    assert ok("<answer>disease</answer>", "a b c disease").issue == "答案与ground truth匹配度过低: 25.0%"


def test_filter_policy(spark):
    t = THINK + "but<tool_call>a</tool_call><observation>o</observation>" * 2 + "<answer>zzz</answer>"
    df = V.validate(spark.createDataFrame([(GOOD, [("t", ("success",))], "moderate disease", "A"), (t, [], "none there", "B"), (GOOD, [("t", ("bad",))], "moderate disease", "A")], SCHEMA))
    strict = V.FilterPolicy(min_score=0.95)
    assert V.filter_trajectories(df, strict).count() == 2  # the correction stays, the unmatched evidence goes
    assert V.filter_trajectories(df, V.FilterPolicy(min_score=0.95, keep_corrections=False)).count() == 1
    assert V.filter_trajectories(df, V.FilterPolicy(weights=J.RUBRIC_WEIGHTS, required=("xml_valid",), min_score=0.5)).count() == 3


def test_report_rounds_half_even_over_validated(spark):
    df = spark.createDataFrame([("t", 0.5), ("t", 0.7005), ("", 0.9), (None, 0.9)], "trajectory string, quality_score double")
    r = V.validation_report(df).first()
    assert (r.total, r.validated, r.avg_quality_score, r.pass_rate) == (4, 2, 0.6, 0.5)


def test_issue_codes(spark, rows):
    df = spark.createDataFrame([(["rate: 12.5%", "x"],), (["rate: 3%"],)], "issues array<string>")
    assert rows(V.issue_summary(df, coded=True)) == [("rate: #", 2), ("x", 1)]
    assert V.issue_summary(df, 1).count() == 1


def test_attempts(spark):
    tries = "attempts array<struct<attempt:int,trajectory:string>>"
    df = spark.createDataFrame([([(1, "<think>"), (2, "<think><answer>"), (3, "<think><answer>x")],), ([(1, None)],)], tries)
    a, b = [r.s for r in df.select(J.select_attempt("attempts").alias("s")).collect()]
    assert a.attempt == 2 and a.error is None and b.trajectory is None and b.error == "no usable attempt out of 1"


def test_placeholders_are_not_filled_twice(spark):
    df = spark.createDataFrame([("x [TOOL_RESULT_PLACEHOLDER:a] [TOOL_RESULT_PLACEHOLDER:zz]", {"a": "[TOOL_RESULT_PLACEHOLDER:zz] $1"})], "t string, m map<string,string>")
    r = df.select(J.fill_placeholders("t", "m").alias("f")).first().f
    assert (r.text, r.found, r.left) == ("x [TOOL_RESULT_PLACEHOLDER:zz] $1 [TOOL_RESULT_PLACEHOLDER:zz]", 2, 1)


@pytest.mark.parametrize("message,want", [("<Answer> B \n</ANSWER><answer>C</answer>", "B"), (" c ", "C"), ("E", None), ("it is B", None), ("", None), (None, None)])
def test_parse_answer(spark, message, want):
    assert spark.range(1).select(X.parse_answer(F.lit(message).cast("string"))).first()[0] == want


def test_grading(spark):
    df = spark.createDataFrame([("A", "A"), (None, "A"), ("B, A", "A,B"), ("A,A", "A")], "p string, t string")
    assert [r[0] for r in df.select(X.is_correct("p", "t")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(X.is_correct("p", "t", "multi")).collect()] == [True, None, True, False]


@pytest.mark.parametrize("text,last,outer", [
    ('x {"a": 1} y {"b": {"c": 2}} z', '{"b": {"c": 2}}', None),
    ('log {bad {"a": "}"} end', '{"a": "}"}', None),
    ('pre {"a": [1, {"b": 2}]} post', '{"a": [1, {"b": 2}]}', '{"a": [1, {"b": 2}]}'),
    ('[{"a": 1}] tail', None, '{"a": 1}'),
    ("none", None, None),
])
def test_salvage(spark, text, last, outer):
    r = spark.createDataFrame([(text,)], "t string").select(X.salvage_json("t").alias("l"), X.salvage_json("t", "outer").alias("o")).first()
    assert (r.l, r.o) == (last, outer)


def test_status_is_that_of_the_result(spark):
    log = "tool_execution_log array<struct<tool_name:string,result:struct<status:string>,status:string>>"
    text = GOOD.replace("status success", "status unknown")
    rows = spark.createDataFrame([(text, [("t", (None,), "unknown")]), (text, [("t", ("unknown",), "x")]), (text, [("t", None, "unknown")])], f"trajectory string, {log}")
    assert [r[0] for r in rows.select(J.check_tool_match("trajectory", "tool_execution_log")["ok"]).collect()] == [False, True, False]
