"""Evidence in nested tool results (a VARIANT column: tool → {status, result}) and one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import AMD_WORDS, DR_WORDS, HEALTHY_WORDS
from .columns import col
from .text import contains_any

# ---- Fixed values: result keys, thresholds and names that results depend on ----
METRICS, ANALYSIS, TASKS = "量化分析指标", "分析结果", "分析任务"
HARD, SOFT, BLEED, ANEURYSMS = "硬渗出物区域占比", "软渗出物区域占比", "出血区域占比", "微动脉瘤数量"
BLEED_SIZE, ANEURYSM_RATIO = "出血区域总大小", "微动脉瘤区域占比"
STATE, VALUES, LESION_COUNT, REGION = "状态", "指标", "病灶数量", "区域占比"
DR_THRESHOLDS = {HARD: 0.03, ANEURYSMS: 10, BLEED: 0.05, SOFT: 0.01}
ARTEFACT_THRESHOLDS = {ANEURYSMS: 3, BLEED: 0.02, HARD: 0.01, SOFT: 0.01}
QUALITY_KEYS = ["quality_score", "score", "overall_quality", "quality", "confs"]
GRADE_NAMES = {"1": "mild diabetic retinopathy", "2": "moderate diabetic retinopathy",
               "3": "severe diabetic retinopathy", "4": "proliferative diabetic retinopathy"}
GRADE_WORDS = ["视网膜病变", "轻度", "中度", "重度", "增生性"]
RISK_WORDS = ["moderate", "high", "中等", "高"]
HEALTHY_ARTEFACT_WORDS = ["healthy", "normal", "no abnormal", "健康", "正常"]
CASCADE_WORDS = ["diabetic retinopathy", "hard exudates", "exudates"]
BORDERLINE_CUP = (0.5, 0.6)
LOW_CONFIDENCE = 0.6
EXUDATE_COUNT = 3
DRUSEN = "玻璃膜疣"
HARD_TASK, DONE, SUCCEEDED = "硬渗出物分割", "完成", "成功"


def _path(*keys: str) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def _get(v: Column, kind: str, *keys) -> Column:
    return F.try_variant_get(v, _path(*keys), kind)


def _num(v: Column, *keys, default: float | None = 0.0) -> Column:
    value = _get(v, "double", *keys)
    return value if default is None else F.coalesce(value, F.lit(default))


#: What evidence reads of each tool's result. VARIANT parts hold values whose kind matters.
_RESULTS = {
    "quality_assess": {k: "variant" for k in QUALITY_KEYS},
    "DR_Grading": {
        "prediction": "map<string,variant>",
        "results": {"DEEPDR": {"diagnosis": {"probabilities": "array<variant>", "predicted_class": "int", "class_label": "string"}}},
    },
    "detect_lesions": {
        METRICS: {k: "double" for k in (HARD, SOFT, BLEED, ANEURYSMS, BLEED_SIZE)},
        ANALYSIS: "map<string,variant>",
        TASKS: {HARD_TASK: {STATE: "string", VALUES: {LESION_COUNT: "double"}}},
    },
    "AMD_predict": {"results": {k: {"label": "string", "confidence": "double"} for k in ("amd", "drusen")}},
    "dme_risk_assess": {
        "dme_risk_assessment": "map<string,variant>",
        "risk_level": "variant", "risk_category": "string", "description": "string",
    },
    "segment_by_AutoMorphalyzer": {"images": [{"optic_disc": {"cdr_vertical": "double", "cdr_horizontal": "double"}}]},
}


def _type(shape) -> str:
    if isinstance(shape, str):
        return shape
    if isinstance(shape, list):
        return f"array<{_type(shape[0])}>"
    return "struct<" + ",".join(f"`{k}`:{_type(v)}" for k, v in shape.items()) + ">"


def read_results(results: str | Column) -> Column:
    """The parts of a VARIANT column of tool results that evidence needs, as one struct, read in one walk. Parts
    that are missing or of another kind are null."""
    tools = ",".join(f"`{tool}`:struct<status:string,result:{_type(shape)}>" for tool, shape in _RESULTS.items())
    return F.try_variant_get(col(results), "$", f"struct<{tools}>")


def _done(r: Column, tool: str) -> Column:
    return F.coalesce(r[tool]["status"] == "success", F.lit(False))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _any_over(metrics: Column, thresholds: dict[str, float]) -> Column:
    hit = F.lit(False)
    for key, limit in thresholds.items():
        hit = hit | (_or_zero(metrics[key]) >= limit)
    return hit


def quality_score(r: Column) -> Column:
    """First numeric value among the accepted keys of a successful quality result."""
    tries = []
    for key in QUALITY_KEYS:
        value = r["quality_assess"]["result"][key]
        numeric = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        tries.append(F.when(numeric, F.try_variant_get(value, "$", "double")))
    return F.when(_done(r, "quality_assess"), F.coalesce(*tries))


def dr_features(r: Column) -> Column:
    """Signs of DR with their numbers: lesions over their thresholds, else a positive grade with a DR name."""
    m, p = r["detect_lesions"]["result"][METRICS], r["DR_Grading"]["result"]["prediction"]
    given = lambda key, kind: F.try_variant_get(p[key], "$", kind)
    name = F.coalesce(given("class_name", "string"), F.lit(""))
    null = lambda kind: F.lit(None).cast(kind)
    lesions = F.struct(
        F.lit("detect_lesions").alias("source"), *[_or_zero(m[k]).alias(n) for n, k in (("hard", HARD), ("aneurysms", ANEURYSMS), ("bleeding", BLEED), ("soft", SOFT))],
        null("string").alias("grade"), null("int").alias("predicted_class"), null("double").alias("confidence"),
    )
    ident = given("class_id", "double")
    grade = F.struct(
        F.lit("DR_Grading").alias("source"), *[null("double").alias(n) for n in ("hard", "aneurysms", "bleeding", "soft")],
        name.alias("grade"), ident.cast("int").alias("predicted_class"), _or_zero(given("confidence", "double")).alias("confidence"),
    )
    graded = (F.coalesce(ident, F.lit(-1.0)) > 0) & contains_any(F.lower(name), GRADE_WORDS)
    return F.when(_done(r, "detect_lesions") & _any_over(m, DR_THRESHOLDS), lesions).when(_done(r, "DR_Grading") & graded, grade)


def dr_grade(r: Column) -> Column:
    """Grade name by the first of 1-4 that occurs in the id's text: an id of -1 counts as mild, 0 as none."""
    present = r["DR_Grading"]["result"]["prediction"]
    ident = F.coalesce(F.try_variant_get(present["class_id"], "$", "string"), F.lit("-1"))
    chain = None
    for digit, grade in GRADE_NAMES.items():
        chain = F.when(ident.contains(digit), grade) if chain is None else chain.when(ident.contains(digit), grade)
    return F.when(_done(r, "DR_Grading") & (F.size(present) > 0), chain)


def _entries(tasks: Column, order: Column | None) -> Column:
    """Entries of a map of VARIANTs, in the order of ``order`` (keys) or, without it, by name."""
    if order is None:
        return F.map_entries(tasks)
    return F.transform(F.array_distinct(order), lambda k: F.struct(k.alias("key"), tasks[k].alias("value")))


def key_order(text: str | Column | None, *keys: str) -> Column | None:
    """Keys of the object below ``keys`` in the order in which the JSON ``text`` has them; VARIANT sorts by name."""
    return None if text is None else F.json_object_keys(F.get_json_object(col(text), "$" + "".join(f"['{k}']" for k in keys)))


def amd_features(r: Column, order: Column | None = None) -> Column:
    """Signs of AMD with their numbers: a positive label, positive drusen, or the first task in ``order`` that counted drusen."""
    amd, drusen = r["AMD_predict"]["result"]["results"]["amd"], r["AMD_predict"]["result"]["results"]["drusen"]
    tasks = _entries(r["detect_lesions"]["result"][ANALYSIS], order)

    def count(t: Column) -> Column:
        return _num(t["value"], VALUES, LESION_COUNT)

    def ratio(t: Column) -> Column:
        return F.coalesce(_num(t["value"], VALUES, REGION, default=None), _num(t["value"], VALUES, f"{DRUSEN}{REGION}"))

    def counted(t: Column) -> Column:
        named = F.lower(t["key"]).contains("drusen") | t["key"].contains(DRUSEN)
        done = F.coalesce(_get(t["value"], "string", STATE).contains(DONE), F.lit(False))
        return named & done & ((count(t) > 0) | (ratio(t) > 0))

    def finding(source: str, **values: Column) -> Column:
        kinds = {"has_amd": "boolean", "amd_confidence": "double", "drusen_detected": "boolean", "drusen_confidence": "double", "drusen_count": "double", "drusen_ratio": "double"}
        return F.struct(F.lit(source).alias("source"), *[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])

    yes = lambda part: _done(r, "AMD_predict") & F.coalesce(part["label"] == "Yes", F.lit(False))
    found = F.transform(F.filter(tasks, counted), lambda t: finding("detect_lesions", drusen_count=count(t), drusen_ratio=ratio(t)))
    return (
        F.when(yes(amd), finding("AMD_predict", has_amd=F.lit(True), amd_confidence=_or_zero(amd["confidence"])))
        .when(yes(drusen), finding("AMD_predict", has_amd=F.lit(True), drusen_detected=F.lit(True), drusen_confidence=_or_zero(drusen["confidence"])))
        .when(_done(r, "detect_lesions"), F.get(found, F.lit(0)))
    )


def dme_signs(r: Column) -> Column:
    """Signs of DME with their numbers: risk level (integer ≥ 1 or a named level), else more than three hard exudates."""
    flat = r["dme_risk_assess"]["result"]
    nested = flat["dme_risk_assessment"]
    given = F.coalesce(F.size(nested), F.lit(0)) > 0
    part = lambda name: F.when(given, F.try_variant_get(nested[name], "$", "string")).otherwise(flat[name])
    level = F.when(given, nested["risk_level"]).otherwise(flat["risk_level"])
    kind, text = F.schema_of_variant(level), F.try_variant_get(level, "$", "string")
    risky = ((kind == "BIGINT") & (F.try_variant_get(level, "$", "bigint") >= 1)) | ((kind == "STRING") & F.lower(text).isin(*RISK_WORDS))
    task = r["detect_lesions"]["result"][TASKS][HARD_TASK]
    count = task[VALUES][LESION_COUNT]
    many = (task[STATE] == SUCCEEDED) & (_or_zero(count) > EXUDATE_COUNT)
    none = F.lit(None).cast("string")
    return F.when(
        _done(r, "dme_risk_assess") & F.coalesce(risky, F.lit(False)),
        F.struct(F.lit("dme_risk_assess").alias("source"), text.alias("risk_level"), part("risk_category").alias("risk_category"),
                 part("description").alias("exudates_near_fovea"), F.lit(None).cast("double").alias("hard_exudates_count")),
    ).when(
        _done(r, "detect_lesions") & F.coalesce(many, F.lit(False)),
        F.struct(F.lit("detect_lesions").alias("source"), none.alias("risk_level"), none.alias("risk_category"), none.alias("exudates_near_fovea"), count.alias("hard_exudates_count")),
    )


def borderline_cdr(r: Column) -> Column:
    """Both cup/disc ratios and their mean when that lies in the borderline range."""
    disc = F.get(r["segment_by_AutoMorphalyzer"]["result"]["images"], F.lit(0))["optic_disc"]
    mean = (disc["cdr_vertical"] + disc["cdr_horizontal"]) / 2
    found = F.struct(disc["cdr_vertical"].alias("cdr_vertical"), disc["cdr_horizontal"].alias("cdr_horizontal"), mean.alias("cdr_average"))
    return F.when(_done(r, "segment_by_AutoMorphalyzer") & mean.between(*BORDERLINE_CUP), found)


def artefact_lesions(r: Column) -> Column:
    """Lesion numbers when one of them is over the thresholds for possible artefacts."""
    m = r["detect_lesions"]["result"][METRICS]
    names = {"aneurysms": ANEURYSMS, "bleeding": BLEED, "bleeding_size": BLEED_SIZE, "hard": HARD, "soft": SOFT}
    found = F.struct(*[_or_zero(m[k]).alias(n) for n, k in names.items()])
    return F.when(_done(r, "detect_lesions") & _any_over(m, ARTEFACT_THRESHOLDS), found)


def low_confidence_tool(r: Column) -> Column:
    """The tool whose overall confidence is under .6, and that number: a positive AMD call, else the graded class's probability."""
    amd = r["AMD_predict"]["result"]["results"]["amd"]
    diag = r["DR_Grading"]["result"]["results"]["DEEPDR"]["diagnosis"]
    cls = F.coalesce(diag["predicted_class"], F.lit(0))
    prob = F.coalesce(F.try_variant_get(F.get(diag["probabilities"], cls), "$.probability", "double"), F.lit(1.0))
    sure = F.coalesce(amd["confidence"], F.lit(1.0))
    weak_amd = (amd["label"] == "Yes") & (sure < LOW_CONFIDENCE)
    weak_dr = (F.size(diag["probabilities"]) > 0) & cls.between(0, F.size(diag["probabilities"]) - 1) & (prob < LOW_CONFIDENCE)

    def finding(tool: str, feature: str | None, value: Column, label: Column) -> Column:
        return F.struct(F.lit(tool).alias("tool_name"), F.lit(feature).cast("string").alias("feature"), value.alias("confidence"), F.lit(LOW_CONFIDENCE).alias("threshold"), label.alias("label"))

    return F.when(_done(r, "AMD_predict") & F.coalesce(weak_amd, F.lit(False)), finding("AMD_predict", "amd", sure, amd["label"])).when(
        _done(r, "DR_Grading") & F.coalesce(weak_dr, F.lit(False)), finding("DR_Grading", None, prob, F.coalesce(diag["class_label"], F.lit("")))
    )


def findings(read: str | Column, text: str | Column | None = None) -> dict[str, Column]:
    """All evidence of one row by name, a struct with its numbers per finding. ``read`` is a column made by
    ``read_results``; ``text``, the results as JSON text, gives the order of tasks."""
    r = col(read)
    return {
        "quality": quality_score(r), "dr_features": dr_features(r), "dr_grade": dr_grade(r),
        "amd_features": amd_features(r, key_order(text, "detect_lesions", "result", ANALYSIS)), "dme_signs": dme_signs(r),
        "borderline_cdr": borderline_cdr(r), "artefact": artefact_lesions(r), "low_confidence": low_confidence_tool(r),
    }


# Type, subtype, confidence and description given by each relabelling rule.
RELABELS = {
    "grade": ("B", "dr_grading_mismatch", 0.92, "纠错: DR分级工具误判，需要进一步深入分析"),
    "amd": ("B", "false_dr_is_amd", 0.88, "纠错: 工具误判DR硬性渗出，实为AMD玻璃膜疣"),
    "cup": ("B", "false_glaucoma", 0.85, "纠错: CDR偏大但实为生理性大视杯"),
    "artefact": ("B", "artifact", 0.80, "纠错: 工具检测到病灶，但可能是伪影"),
    "confidence": ("B", "low_confidence_recheck", 0.75, "纠错: 工具置信度低，需要Crop验证"),
    "cascade": ("C", "dr_to_dme", 0.85, "级联推理: dr_to_dme"),
}


# What each relabelling rule gives as its reason.
REASONS = {
    "grade": "DR分级工具结果不可靠，需要进一步收集病灶量化和空间分布证据",
    "amd": "GT标签为AMD，但DR病灶检测工具误报硬性渗出，需要纠正为玻璃膜疣",
    "cup": "GT标签为健康，但CDR计算显示边缘值，需要验证是否为生理性大视杯",
    "artefact": "GT标签为健康，但病灶检测工具报告异常，需要验证是否为伪影",
    "confidence": "工具返回低置信度结果，需要高清切片验证",
    "cascade": "DR患者检测到黄斑水肿风险，需要级联评估",
}


def relabel(label: str | Column, answer_lower: str | Column, ev: str | Column) -> Column:
    """The first rule that fires: its new label, its name as ``rule`` and its ``reason``; else null."""
    lab, a, e = col(label), col(answer_lower), col(ev)
    fires = {
        "grade": (lab["type"] == "A") & (lab["subtype"] == "pure_dr") & contains_any(a, DR_WORDS)
        & F.coalesce(~F.contains(a, e["dr_grade"]), F.lit(False)),
        "amd": contains_any(a, AMD_WORDS) & e["dr_features"].isNotNull(),
        "cup": contains_any(a, HEALTHY_WORDS) & e["borderline_cdr"].isNotNull(),
        "artefact": contains_any(a, HEALTHY_ARTEFACT_WORDS) & e["artefact"].isNotNull(),
        "confidence": e["low_confidence"].isNotNull(),
        "cascade": contains_any(a, CASCADE_WORDS) & e["dme_signs"].isNotNull(),
    }
    chain = None
    for name, hit in fires.items():
        t, s, c, d = RELABELS[name]
        out = F.struct(F.lit(t).alias("type"), F.lit(s).alias("subtype"), F.lit(c).alias("confidence"), F.lit(d).alias("description"),
                       F.lit(name).alias("rule"), F.lit(REASONS[name]).alias("reason"))
        chain = F.when(hit, out) if chain is None else chain.when(hit, out)
    return chain


def reason_evidence(rule: str | Column, truth: str | Column, ev: str | Column) -> Column:
    """What a relabelling rests on, by the rule that fired; null where none did."""
    n, e = col(rule), col(ev)
    parts = {
        "tool_grade": ("grade", "dr_grade"), "tool_false_positive": ("amd", "dr_features"), "cdr_metrics": ("cup", "borderline_cdr"),
        "detected_lesions": ("artefact", "artefact"), "low_confidence": ("confidence", "low_confidence"), "dme_signs": ("cascade", "dme_signs"),
    }
    shown = F.when(n.isin("grade", "amd", "cup", "artefact"), col(truth))
    return F.when(n.isNotNull(), F.struct(shown.alias("ground_truth"), *[F.when(n == name, e[field]).alias(k) for k, (name, field) in parts.items()]))


def _fmt(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def _text(v: Column, *keys, default: str = "") -> Column:
    return F.coalesce(_get(v, "string", *keys), F.lit(default))


def _lesion_line(entry: Column) -> Column:
    """Text for one finished segmentation task, null when there is nothing to tell."""
    name, t = entry["key"], entry["value"]
    share = lambda k: _num(t, VALUES, k)
    pct = lambda k: _fmt("%.3f%%", share(k) * 100)
    line = (
        F.when(name.contains("微动脉瘤"), F.when(share(ANEURYSMS) > 0, F.concat(
            F.lit("微动脉瘤: "), _text(t, VALUES, ANEURYSMS, default="0"), F.lit("个 (占比"), pct(ANEURYSM_RATIO), F.lit(")"))))
        .when(name.contains("出血"), F.when((share(BLEED) > 0.001) | (share(BLEED_SIZE) > 0), F.concat(
            F.lit("出血: 占比"), pct(BLEED), F.lit(" (面积"), _fmt("%.0f", share(BLEED_SIZE)), F.lit("px)"))))
        .when(name.contains("硬渗出物"), F.when(share(HARD) > 0.001, F.concat(F.lit("硬渗出物: 占比"), pct(HARD))))
        .when(name.contains("软渗出物"), F.when(share(SOFT) > 0.001, F.concat(F.lit("软渗出物: 占比"), pct(SOFT))))
    )
    done = ~name.contains("分类") & F.coalesce(_get(t, "string", STATE).contains("完成"), F.lit(False))
    return F.when(done, line)


def _shown(value: Column) -> Column:
    """A VARIANT as text: words for truth values and nothing, objects and lists as JSON."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string"))).when(kind == "VOID", "None")
        .otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value), F.lit("None")))
    )


def summarize_tool(name: str | Column, payload: str | Column, text: str | Column | None = None) -> Column:
    """One line about a tool's VARIANT result {status, error, result}. Unknown tools list their first five keys and
    lesions come by task: in the order of ``text``, the payload as JSON text, or without it by name."""
    n, v = col(name), col(payload)
    r = lambda *keys, default="": _text(v, "result", *keys, default=default)
    x = lambda *keys: _num(v, "result", *keys)

    tasks = F.try_variant_get(v, _path("result", ANALYSIS), "map<string,variant>")
    lesions = F.array_compact(F.transform(_entries(tasks, key_order(text, "result", ANALYSIS)), _lesion_line))
    lesions = F.coalesce(lesions, F.array().cast("array<string>"))
    labelled = [("drusen", "玻璃膜疣: "), ("pigment", "色素异常: "), ("amd", "晚期AMD: ")]
    amd_parts = [F.concat(F.lit("AREDS评分: "), r("simplified_score", "score", default="0"), F.lit("/5"))] + [
        F.concat(F.lit(text), F.nullif(r("results", k, "label"), F.lit("")))
        for k, text in labelled
    ]
    box = F.concat(*[
        piece for k in ("x1", "y1", "x2", "y2")
        for piece in (F.lit({"x1": "裁剪区域: x=", "y1": ", y=", "x2": ", x2=", "y2": ", y2="}[k]), r("original_bbox", k, default="0"))
    ])
    crop_parts = [
        box,
        F.when(F.coalesce(_get(v, "boolean", "result", "super_resolution_applied"), F.lit(False)),
               F.concat(F.lit("超分辨率放大: "), r("sr_scale", default="1"), F.lit("x"))),
        F.when(r("cropped_image_path") != "", F.concat(F.lit("输出图像: "), r("cropped_image_path"))),
    ]
    at = lambda part, axis: _fmt("%.0f", x("coordinates", part, axis))
    disc = ("images", 0, "optic_disc")
    fields = _entries(F.try_variant_get(v, _path("result"), "map<string,variant>"), key_order(text, "result"))
    pairs = F.transform(F.slice(fields, 1, 5), lambda e: F.concat(e["key"], F.lit("="), _shown(e["value"])))
    anchor_path = F.coalesce(
        _get(v, "string", "result", "results", "output_visualization_path"), _get(v, "string", "result", "output_visualization_path")
    )
    by_tool = (
        F.when(n == "quality_assess", F.concat(F.lit("图像质量评分: "), _fmt("%.2f", x("confs")), F.lit(", 评估结果: "), r("assessment", default="未知")))
        .when(n == "AMD_predict", F.concat_ws(", ", *amd_parts))
        .when(n == "fovea_od_localize", F.concat(
            F.lit("黄斑中心位置: ("), at("fovea", "x"), F.lit(", "), at("fovea", "y"), F.lit("), 视盘位置: ("),
            at("optic_disc", "x"), F.lit(", "), at("optic_disc", "y"), F.lit(")")))
        .when(n == "crop_roi", F.concat_ws(". ", *crop_parts))
        .when(n == "detect_lesions", F.when(F.size(lesions) > 0, F.concat(F.lit("检测到: "), F.array_join(lesions, ", "))).otherwise("未检测到明显病灶"))
        .when(n == "DR_Grading", F.concat(
            F.lit("DR分级: "), r("prediction", "class_name"), F.lit(" (类别 "), r("prediction", "class_id", default="-1"),
            F.lit(", 置信度: "), _fmt("%.2f", x("prediction", "confidence")), F.lit(")")))
        .when(n == "dme_risk_assess", F.concat(
            F.lit("DME风险: "), r("risk_level"),
            F.when(~r("exudates_near_fovea").isin("", "false"), ", 黄斑附近有渗出物").otherwise("")))
        .when(n == "DR_segmentation_anchor_ETDRS", F.when(F.coalesce(anchor_path, F.lit("")) != "", "已定位中央凹与视盘，并输出ETDRS锚定可视化结果").otherwise(""))
        .when(n == "segment_by_AutoMorphalyzer", F.when(
            _get(v, "variant", "result", "images", 0).isNotNull(),
            F.concat(F.lit("杯盘比垂直: "), _fmt("%.2f", x(*disc, "cdr_vertical")), F.lit(", 杯盘比水平: "), _fmt("%.2f", x(*disc, "cdr_horizontal"))),
        ).otherwise("视盘分割完成"))
        .when(n == "enhance_image", F.when(r("output_path") != "", F.concat(F.lit("图像增强完成，输出路径: "), r("output_path"))).otherwise("图像增强完成"))
        .otherwise(F.when(fields.isNotNull(), F.concat(F.lit("工具执行成功: "), F.array_join(pairs, ", "))).otherwise("工具执行成功"))
    )
    failed = F.concat(F.lit("工具执行失败: "), _text(v, "error", default="Unknown error"))
    return F.when(_text(v, "status") != "success", failed).otherwise(by_tool)
