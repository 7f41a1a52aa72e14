import json

import pytest
from pyspark.sql import functions as F

from annolytics.functions import evidence as E
from annolytics.operators import classify as C


def evidence(spark, results):
    df = spark.createDataFrame([(json.dumps(results),)], "j string").select(F.parse_json("j").alias("tool_results"))
    return C.extract_evidence(df).first().evidence


def ok(result):
    return {"status": "success", "result": result}


def test_quality_takes_first_numeric_key(spark):
    assert evidence(spark, {"quality_assess": ok({"quality_score": "0.9", "score": 0.4, "confs": 0.2})}).quality == 0.4
    assert evidence(spark, {"quality_assess": {"status": "error", "result": {"score": 1}}}).quality is None


@pytest.mark.parametrize("class_id,grade", [(0, None), (1, "mild diabetic retinopathy"), (4, "proliferative diabetic retinopathy"), (-1, "mild diabetic retinopathy")])
def test_grade_is_a_substring_test(spark, class_id, grade):
    assert evidence(spark, {"DR_Grading": ok({"prediction": {"class_id": class_id}})}).dr_grade == grade


def test_empty_prediction_has_no_grade(spark):
    assert evidence(spark, {"DR_Grading": ok({"prediction": {}})}).dr_grade is None


def test_lesion_thresholds(spark):
    e = evidence(spark, {"detect_lesions": ok({E.METRICS: {E.HARD: 0.02, E.ANEURYSMS: 3}})})
    assert e.dr_features is None and e.artefact.hard == 0.02 and e.artefact.aneurysms == 3 and e.artefact.bleeding_size == 0
    assert evidence(spark, {"detect_lesions": ok({E.METRICS: {E.HARD: 0.03}})}).dr_features.asDict() == {
        "source": "detect_lesions", "hard": 0.03, "aneurysms": 0, "bleeding": 0, "soft": 0, "grade": None, "predicted_class": None, "confidence": None}
    assert evidence(spark, {"DR_Grading": ok({"prediction": {"class_id": 2, "class_name": "中度"}})}).dr_features.source == "DR_Grading"


def test_dme_levels(spark):
    sign = lambda r: evidence(spark, {"dme_risk_assess": ok(r)}).dme_signs
    assert sign({"risk_level": 1}) and sign({"dme_risk_assessment": {"risk_level": "High"}})
    assert sign({"risk_level": 0}) is None and sign({"risk_level": "low"}) is None and sign({"risk_level": 1.5}) is None
    many = {"detect_lesions": ok({E.TASKS: {"硬渗出物分割": {E.STATE: "成功", E.VALUES: {E.LESION_COUNT: 4}}}})}
    assert evidence(spark, many).dme_signs.hard_exudates_count == 4
    full = sign({"risk_level": 0, "dme_risk_assessment": {"risk_level": 2, "risk_category": "c", "description": "near"}})
    assert (full.source, full.risk_level, full.risk_category, full.exudates_near_fovea) == ("dme_risk_assess", "2", "c", "near")
    assert sign({"risk_level": 2, "dme_risk_assessment": {"other": 1}}) is None and sign({"risk_level": 2, "dme_risk_assessment": {}}).risk_level == "2"


def test_confidence_amd_cdr(spark):
    assert evidence(spark, {"AMD_predict": ok({"results": {"amd": {"label": "Yes", "confidence": 0.59}}})}).low_confidence.asDict() == {
        "tool_name": "AMD_predict", "feature": "amd", "confidence": 0.59, "threshold": 0.6, "label": "Yes"}
    assert evidence(spark, {"AMD_predict": ok({"results": {"amd": {"label": "No", "confidence": 0.1}}})}).low_confidence is None
    dr = {"DR_Grading": ok({"results": {"DEEPDR": {"diagnosis": {"predicted_class": 1, "probabilities": [{"probability": 0.1}, {"probability": 0.5}]}}}})}
    assert evidence(spark, dr).low_confidence.tool_name == "DR_Grading" and evidence(spark, dr).low_confidence.confidence == 0.5
    drusen = {"detect_lesions": ok({E.ANALYSIS: {"Drusen seg": {E.STATE: "已完成", E.VALUES: {E.LESION_COUNT: 2}}}})}
    assert evidence(spark, drusen).amd_features.drusen_count == 2
    positive = evidence(spark, {"AMD_predict": ok({"results": {"amd": {"label": "No"}, "drusen": {"label": "Yes", "confidence": 0.4}}})}).amd_features
    assert positive.drusen_detected and positive.drusen_confidence == 0.4 and positive.amd_confidence is None
    cdr = lambda v, h: evidence(spark, {"segment_by_AutoMorphalyzer": ok({"images": [{"optic_disc": {"cdr_vertical": v, "cdr_horizontal": h}}]})}).borderline_cdr
    assert cdr(0.5, 0.6).cdr_average == pytest.approx(0.55) and cdr(0.5, 0.6).cdr_horizontal == 0.6 and cdr(0.7, 0.6) is None


SUMMARIES = [
    ("quality_assess", ok({"confs": 0.876, "assessment": "good"}), "图像质量评分: 0.88, 评估结果: good"),
    ("quality_assess", {"status": "error"}, "工具执行失败: Unknown error"),
    ("AMD_predict", ok({"simplified_score": {"score": 3}, "results": {"drusen": {"label": "large"}, "amd": {"label": "No"}}}), "AREDS评分: 3/5, 玻璃膜疣: large, 晚期AMD: No"),
    ("fovea_od_localize", ok({"coordinates": {"fovea": {"x": 10.4, "y": 20.6}, "optic_disc": {"x": 1, "y": 2}}}), "黄斑中心位置: (10, 21), 视盘位置: (1, 2)"),
    ("detect_lesions", ok({E.ANALYSIS: {"出血分割": {E.STATE: "完成", E.VALUES: {E.BLEED: 0.0125, E.BLEED_SIZE: 300.0}}, "分类": {E.STATE: "完成"}}}), "检测到: 出血: 占比1.250% (面积300px)"),
    ("detect_lesions", ok({}), "未检测到明显病灶"),
    ("segment_by_AutoMorphalyzer", ok({"images": []}), "视盘分割完成"),
    ("enhance_image", ok({"output_path": "/o.png"}), "图像增强完成，输出路径: /o.png"),
    ("other", ok({"a": 1, "b": "x"}), "工具执行成功: a=1, b=x"),
    ("crop_roi", ok({"original_bbox": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "super_resolution_applied": True, "sr_scale": 2}), "裁剪区域: x=1, y=2, x2=3, y2=4. 超分辨率放大: 2x"),
]


def test_summaries(spark):
    df = spark.createDataFrame([(n, json.dumps(p), e) for n, p, e in SUMMARIES], "n string, p string, e string")
    for r in df.select("n", "e", E.summarize_tool("n", F.parse_json("p")).alias("s")).collect():
        assert r.s == r.e, r.n


def test_relabel_keeps_initial(spark):
    res = {"detect_lesions": ok({E.METRICS: {E.HARD: 0.5}})}
    df = spark.createDataFrame([("late amd", json.dumps(res), ("A", "pure_amd", 0.75, "d")), ("zz", "{}", ("A", "pure_dr", 0.75, "d"))],
                               "answer_text string, j string, label struct<type:string,subtype:string,confidence:double,description:string>")
    out = C.adjust_labels(C.extract_evidence(df.withColumn("tool_results", F.parse_json("j")))).collect()
    assert (out[0].initial_label.subtype, out[0].final_label.subtype, out[0].rule) == ("pure_amd", "false_dr_is_amd", "amd")
    assert out[0].reason == E.REASONS["amd"] and out[0].reason_evidence.ground_truth == "late amd"
    assert out[0].reason_evidence.tool_false_positive.hard == 0.5 and out[0].reason_evidence.cdr_metrics is None
    assert out[1].final_label.subtype == "pure_dr" and out[1].reason is None and out[1].reason_evidence is None


def test_payload_order(spark):
    task = lambda n: {E.STATE: "已完成", E.VALUES: {E.LESION_COUNT: n}}
    results = {"detect_lesions": ok({E.ANALYSIS: {"z drusen": task(0), "y drusen": task(5), "a drusen": task(7)}})}
    df = spark.createDataFrame([(json.dumps(results),)], "j string").withColumn("tool_results", F.parse_json("j"))
    assert C.extract_evidence(df, text="j").first().evidence.amd_features.drusen_count == 5
    assert C.extract_evidence(df).first().evidence.amd_features.drusen_count == 7  # by name
    other = ok({"zeta": 1, "b": True, "c": None, "a": "x", "m": [1, {"k": 2}], "aa": 3, "zz": 4})
    lesions = ok({E.ANALYSIS: {"软渗出物": {E.STATE: "完成", E.VALUES: {E.SOFT: 0.5}}, "出血": {E.STATE: "完成", E.VALUES: {E.BLEED: 0.25}}}})
    rows = spark.createDataFrame([(1, "t", json.dumps(other)), (2, "detect_lesions", json.dumps(lesions)), (3, "t", json.dumps(ok([1])))], "i int, n string, p string")
    got = {r.i: r.s for r in rows.select("i", E.summarize_tool("n", F.parse_json("p"), "p").alias("s")).collect()}
    assert got[1] == '工具执行成功: zeta=1, b=True, c=None, a=x, m=[1,{"k":2}]'
    assert got[2] == "检测到: 软渗出物: 占比50.000%, 出血: 占比25.000% (面积0px)" and got[3] == "工具执行成功"
