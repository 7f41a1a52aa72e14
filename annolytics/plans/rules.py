"""Classification rules, tool plans and name tables as data. No logic lives here.

A rule is a dict: ``type``, ``subtype``, ``confidence``, ``description``, ``when`` (all conditions
must hold) and optionally ``boost`` (a condition and the confidence it gives). A condition is
``(where, mode, words)``; ``where`` is "q", "a" or "qa", ``mode`` is "any" or "none". Matching is by
substring of lower-cased text. ``detect`` lists named word groups that are appended to the
description when found in the answer.
"""

# ---- Fixed values: word lists, labels and confidences that results depend on ----

DR_WORDS = ["diabetic retinopathy"]
AMD_WORDS = ["amd", "drusen", "age-related macular", "age related macular", "macular degeneration"]
HEALTHY_WORDS = ["healthy", "normal", "physiologic", "生理性", "正常"]
LESION_WORDS = ["hard exudates", "microaneurysms", "soft exudates", "haemorrhages", "red small dots", "cotton wool spots"]

DISEASE_GROUPS = {
    "dr": ["diabetic retinopathy"],
    "amd": ["amd", "age-related macular", "macular degeneration", "黄斑变性", "drusen", "age related macular"],
    "glaucoma": ["glaucoma", "increased cup disc", "cdr", "optic disc cupping", "abnormal optic disc"],
}

MEDICAL_RULES = [
    dict(type="E", subtype="enhance_then_diagnose", confidence=0.90, description="拒诊/异常: enhance_then_diagnose",
         when=[("a", "any", ["after enhancement", "增强后", "enhanced", "improve"]),
               ("a", "none", ["cannot diagnose", "无法诊断"])]),
    dict(type="E", subtype="low_quality", confidence=0.85, description="拒诊/异常: low_quality",
         when=[("qa", "any", ["poor quality", "poor", "unclear", "blurry", "模糊", "质量差", "过暗"])],
         boost=(("qa", "any", ["cannot diagnose", "无法诊断", "重新拍摄"]), 0.95)),
    dict(type="E", subtype="undiagnosable", confidence=0.85, description="拒诊/异常: undiagnosable",
         when=[("qa", "any", ["undiagnosable", "无法诊断", "insufficient"])],
         boost=(("qa", "any", ["quality", "clarity"]), 0.95)),
    dict(type="D", subtype="dr_and_amd", confidence=0.9, description="多病并发: ", detect=DISEASE_GROUPS,
         when=[("a", "any", DISEASE_GROUPS["dr"]), ("a", "any", DISEASE_GROUPS["amd"])]),
    dict(type="D", subtype="dr_and_glaucoma", confidence=0.9, description="多病并发: ", detect=DISEASE_GROUPS,
         when=[("a", "any", DISEASE_GROUPS["dr"]), ("a", "any", DISEASE_GROUPS["glaucoma"])]),
    dict(type="D", subtype="multi_disease", confidence=0.9, description="多病并发: ", detect=DISEASE_GROUPS,
         when=[("a", "any", DISEASE_GROUPS["amd"]), ("a", "any", DISEASE_GROUPS["glaucoma"])]),
    dict(type="C", subtype="dr_to_dme", confidence=0.85, description="级联推理: dr_to_dme",
         when=[("a", "any", ["dme", "diabetic macular edema", "macular edema"])]),
    dict(type="C", subtype="pdr_to_nvg", confidence=0.85, description="级联推理: pdr_to_nvg",
         when=[("a", "any", ["neovascularization", "neovascularisation", "nvg", "新生血管性青光眼"]),
               ("qa", "any", ["proliferative", "new vessels"])]),
    dict(type="A", subtype="healthy", confidence=0.75, description="标准SOP: healthy",
         when=[("qa", "any", ["healthy", "normal", "no abnormalities", "健康", "正常"]),
               ("a", "any", ["healthy", "normal"]),
               ("a", "none", ["not healthy", "abnormal", "normal optic disc", "abnormality"])]),
    dict(type="A", subtype="pure_seg", confidence=0.75, description="标准SOP: pure_seg",
         when=[("qa", "any", ["hard exudates", "exudates", "microaneurysms", "soft exudates", "haemorrhages",
                              "red small dots", "cotton wool spots", "drusen"]),
               ("a", "none", ["diabetic retinopathy"])]),
    dict(type="A", subtype="pure_dr", confidence=0.75, description="标准SOP: pure_dr",
         when=[("qa", "any", [*DR_WORDS, *LESION_WORDS]), ("a", "none", ["combined"])]),
    dict(type="A", subtype="pure_amd", confidence=0.75, description="标准SOP: pure_amd",
         when=[("qa", "any", [*AMD_WORDS, "玻璃膜疣", "黄斑变性", "normal macula"]),
               ("a", "none", ["diabetic retinopathy", "glaucoma"])]),
    dict(type="A", subtype="pure_glaucoma", confidence=0.75, description="标准SOP: pure_glaucoma",
         when=[("qa", "any", ["glaucoma", "increased cup disc", "cdr", "optic disc cupping", "optic disc"]),
               ("a", "none", ["dr", "diabetic", "amd"])]),
]

CORRECTION_RULES = [  # type B; never given by the initial classification
    dict(type="B", subtype="dr_grading_mismatch", confidence=0.75, description="纠错鉴别: dr_grading_mismatch",
         when=[("qa", "any", [*DR_WORDS, *LESION_WORDS]),
               ("a", "none", ["normal", "healthy", "age-related macular", "amd", "glaucoma"])],
         boost=(("qa", "any", ["diabetic retinopathy"]), 0.85)),
    dict(type="B", subtype="false_dr_is_amd", confidence=0.88, description="纠错: 假DR实为AMD",
         when=[("q", "any", ["hard exudates", "硬性渗出"]), ("a", "any", ["amd", "drusen", "not dr", "非糖尿病"])]),
    dict(type="B", subtype="false_glaucoma", confidence=0.75, description="纠错鉴别: false_glaucoma",
         when=[("qa", "any", ["physiologic", "normal cup", "not glaucoma", "生理性", "正常视杯"])],
         boost=(("qa", "any", ["large cup", "大视杯", "borderline"]), 0.85)),
    dict(type="B", subtype="artifact", confidence=0.75, description="纠错鉴别: artifact",
         when=[("qa", "any", ["artifact", "reflection", "false positive", "伪影", "反光"])],
         boost=(("qa", "any", ["not real", "vessel wall", "血管壁"]), 0.85)),
    dict(type="B", subtype="low_confidence_recheck", confidence=0.75, description="纠错鉴别: low_confidence_recheck",
         when=[("qa", "any", ["uncertain", "需要复查", "low confidence", "置信度"])],
         boost=(("qa", "any", ["crop", "detail", "细节", "zoom"]), 0.85)),
]

TARGET_SHARES = {"A": 0.40, "B": 0.25, "C": 0.15, "D": 0.15, "E": 0.05}

TOOL_PLANS = {
    ("A", "healthy"): [],
    ("A", "pure_amd"): ["AMD_predict", "fovea_od_localize", "crop_roi"],
    ("A", "pure_glaucoma"): ["segment_by_AutoMorphalyzer"],
    ("A", "pure_dr"): ["DR_Grading"],
    ("A", "pure_seg"): ["detect_lesions", "DR_segmentation_anchor_ETDRS"],
    ("B", "dr_grading_mismatch"): ["DR_Grading", "detect_lesions", "DR_segmentation_anchor_ETDRS"],
    ("B", "false_dr_is_amd"): ["detect_lesions", "fovea_od_localize", "AMD_predict"],
    ("B", "false_glaucoma"): ["segment_by_AutoMorphalyzer", "fovea_od_localize", "crop_roi"],
    ("B", "artifact"): ["detect_lesions", "fovea_od_localize", "crop_roi"],
    ("B", "low_confidence_recheck"): ["AMD_predict", "fovea_od_localize", "crop_roi"],
    ("C", "dr_to_dme"): ["DR_Grading", "detect_lesions", "fovea_od_localize", "dme_risk_assess"],
    ("C", "pdr_to_nvg"): ["DR_Grading", "segment_by_AutoMorphalyzer"],
    ("D", "dr_and_amd"): ["DR_Grading", "detect_lesions", "AMD_predict"],
    ("D", "dr_and_glaucoma"): ["DR_Grading", "segment_by_AutoMorphalyzer"],
    ("D", "multi_disease"): ["quality_assess", "DR_Grading", "AMD_predict", "segment_by_AutoMorphalyzer"],
    ("E", "low_quality"): ["quality_assess"],
    ("E", "enhance_then_diagnose"): ["quality_assess", "enhance_image", "quality_assess", "DR_Grading"],
    ("E", "undiagnosable"): [],
}
DEFAULT_PLAN = ["quality_assess", "DR_Grading"]
TOOL_DEPENDENCIES = {
    "crop_roi": ["fovea_od_localize"],
    "dme_risk_assess": ["detect_lesions", "fovea_od_localize"],
    "DR_segmentation_anchor_ETDRS": ["detect_lesions"],
}

TOOL_ALIASES = {
    "DR_Grading": "DRgrading_by_DINO",
    "detect_lesions": "segment_by_unet",
    "fundus_lesion_segmentation": "fundus_lesion_segmentation",
    "segment_by_unet": "segment_by_unet",
    "DR_segmentation_anchor_ETDRS": "DR_segmentation_anchor_ETDRS",
    "AMD_predict": "AMD_predict_fundus_by_deepseenet",
    "AMD_predict_fundus": "AMD_predict_fundus_by_deepseenet",
    "AMD_predict_fundus_by_deepseenet": "AMD_predict_fundus_by_deepseenet",
    "segment_by_AutoMorphalyzer": "segment_by_AutoMorphalyzer",
    "glaucoma_segment": "segment_by_AutoMorphalyzer",
    "Lesion_predict_OCT": "Lesion_predict_OCT_by_opticnet",
    "Lesion_predict_OCT_by_opticnet": "Lesion_predict_OCT_by_opticnet",
    "dme_risk_assess": "dme_risk_assessment",
    "dme_risk_assessment": "dme_risk_assessment",
    "quality_assess": "quality_assess_by_fit",
    "quality_assess_by_fit": "quality_assess_by_fit",
    "enhance_image": "enhance_fundus_image",
    "enhance_fundus_image": "enhance_fundus_image",
    "enhance_by_fit": "enhance_by_fit",
    "crop_by_fit": "crop_by_fit",
    "fovea_od_localize": "fov_od_localization_by_fit",
    "fov_od_localization_by_fit": "fov_od_localization_by_fit",
    "vessel_segment": "vessel_segment_by_fit",
    "vessel_segment_by_fit": "vessel_segment_by_fit",
    "crop_roi": "crop_fundus_roi",
    "crop_fundus_roi": "crop_fundus_roi",
    "rag_query": "rag_query",
}
