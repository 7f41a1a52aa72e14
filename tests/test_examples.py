import pytest
from pyspark.sql import functions as F

from annolytics.functions import columns as K
from annolytics.functions import text as X
from annolytics.operators import classify as C
from annolytics.operators import examples as P
from annolytics.operators import stats as S
from annolytics.plans import rules as R

TURNS = "conversations array<struct<`from`:string,value:string>>, image string, question string, answer string"


@pytest.fixture
def records(spark):
    h, g = "Human", "GPT"
    return spark.createDataFrame([
        ([(h, ""), (g, "a1"), (h, "q1"), (g, "a2"), (h, "q2")], "x.png", None, None),
        ([(h, "q"), ("system", "s")], "x.png", "flat q", "flat a"),  # conversation without reply: no fallback
        (None, '["l1.png", "l2.png"]', "fq", "fa"),
        (None, "", "fq", "fa"),
    ], TURNS)


def test_pick_policies(records, rows):
    assert rows(P.normalize_examples(records)) == [("fq", "l1.png", "fa"), ("q1", "x.png", "a1")]
    assert ("q2", "x.png", "a2") in rows(P.normalize_examples(records, "last"))
    assert not any(r[1] == "x.png" and r[0] == "q1" for r in rows(P.normalize_examples(records, "positional")))
    with pytest.raises(ValueError):
        P.normalize_examples(records, "best")


def test_slice_end_zero_means_no_end(spark):
    df = spark.range(10)
    ids = lambda *bounds: sorted(r.id for r in P.slice_rows(df, ["id"], *bounds).collect())
    assert ids(3, 0) == list(range(3, 10))
    assert ids(3, 8, 2) == [3, 4]
    assert ids(0, 4) == [0, 1, 2, 3]
    assert ids(4, 2) == [] and ids(0, 0) == list(range(10)) and ids(0, 0, 3) == [0, 1, 2]


CASES = [
    ("Is this fundus image healthy?", "Yes, this is a healthy fundus image.", "A-healthy"),
    ("What is shown?", "hard exudates are present", "A-pure_seg"),
    ("What is shown?", "drusen with normal optic disc", "A-pure_seg"),
    ("Findings?", "Diabetic Retinopathy with DME", "C-dr_to_dme"),
    ("Findings?", "combined dr and amd", "A-pure_amd"),
    ("Image?", "poor quality", "E-low_quality"),
    ("Findings?", "diabetic retinopathy and drusen and glaucoma", "D-dr_and_amd"),
    ("Findings?", "amd with cdr increase", "D-multi_disease"),
    ("Shown?", "nothing of note", None),
    ("Image?", "diagnosed after enhancement", "E-enhance_then_diagnose"),
    ("Which proliferative sign?", "neovascularization", "C-pdr_to_nvg"),
]


def test_classification(spark):
    df = spark.createDataFrame([(q, a, e) for q, a, e in CASES], "question string, ground_truth_answer string, e string")
    for r in C.classify(df).collect():
        got = f"{r.label.type}-{r.label.subtype}" if r.label else None
        assert got == r.e, (r.question, r.ground_truth_answer)


def test_classification_details(spark):
    df = spark.createDataFrame([("q", "diabetic retinopathy and drusen and glaucoma"), ("q cannot diagnose", "poor"), ("q", "poor")],
                               "question string, ground_truth_answer string")
    a, b, c = [r.label for r in C.classify(df).collect()]
    assert a.description == "多病并发: dr, amd, glaucoma" and a.confidence == 0.9
    assert (b.confidence, c.confidence) == (0.95, 0.85)
    assert all(r["type"] != "B" for r in R.MEDICAL_RULES)
    n = C.check_corrections(spark.createDataFrame([("see hard exudates", "drusen")], "question string, answer_text string")).first().correction
    # table order: the grading rule fires on the question unless the answer speaks against it
    assert n.subtype == "dr_grading_mismatch"


def test_option_expansion(spark):
    q = "Which? A: Mild DR\nB) Severe DR \nC: None"
    df = spark.createDataFrame([("A",), ("b",), ("A, b",), ("H",), ("A,H",), ("F,G",), ("Mild",), (" C ",)], "a string")
    got = [r[0] for r in df.select(X.expand_answer(F.lit(q), "a")).collect()]
    assert got == ["mild dr", "severe dr", "mild dr severe dr", "h", "mild dr", "f,g", "mild", "none"]


def test_option_pattern_is_not_anchored(spark):
    assert spark.range(1).select(X.expand_answer(F.lit("rub: x\nB: y"), F.lit("B"))).first()[0] == "x"


def test_type_filter(spark):
    df = C.classify(spark.createDataFrame([("q", "macular degeneration"), ("q", "poor"), ("q", "zzz"), ("q", "macular edema")], "question string, ground_truth_answer string"))
    assert P.filter_by_type(df, "B").count() == 1
    assert P.filter_by_type(df, "E").count() == 3
    assert P.filter_by_type(df, "C").count() == 1
    assert P.filter_by_type(df, None).count() == 3


def test_gates(spark):
    df = C.classify(spark.createDataFrame([("q", "healthy retina"), ("q", "macular edema"), ("q", "zz"), ("q", "haemorrhages")], "question string, ground_truth_answer string"))
    reason = lambda *a, **k: [r.skip_reason for r in C.gate_types(df, *a, **k).collect()]
    assert reason(None) == [None, None, "unclassified", None]
    assert reason(None, skip_healthy=True)[0] == "healthy skipped"
    # a healthy row may still become B before relabelling, but is not B afterwards
    assert reason(["B"]) == ["type filter after relabel", "type filter", "unclassified", "type filter"]
    assert reason(["E"])[1] == "type filter after relabel"


def test_plans_and_dependencies(spark):
    want = F.array(*[F.lit(x) for x in ("crop_roi", "dme_risk_assess", "fovea_od_localize", "crop_roi")])
    got = spark.range(1).select(C.resolve_dependencies(want, R.TOOL_DEPENDENCIES)).first()[0]
    # fovea_od_localize is requested later, so it is not moved forward
    assert got == ["crop_roi", "detect_lesions", "dme_risk_assess", "fovea_od_localize"]
    missing = spark.range(1).select(C.missing_steps(want, F.array(F.lit("fovea_od_localize")))).first()[0]
    assert missing == ["crop_roi", "dme_risk_assess", "crop_roi"]


def test_gradable(spark):
    df = spark.createDataFrame([("0", "1"), (None, "2"), ("1", "x"), ("", "3")], "adjudicated_gradable string, adjudicated_dr_grade string")
    assert [r.label for r in P.gradable_labels(df, on_bad="skip").collect()] == [2, 3]
    with pytest.raises(Exception, match="not an integer"):
        P.gradable_labels(df).collect()


def test_small_columns(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert [val(K.remap_grade(F.lit(g), "referable")) for g in range(6)] == [0, 1, 1, 1, 2, -1]
    assert [val(K.remap_grade(F.lit(g), "paired")) for g in range(6)] == [0, 0, 1, 1, 2, -1]
    assert [val(K.quality_verdict(F.lit(p), F.lit(b))) for p, b in ((2, 0.1), (1, 0.16), (0, 0.9), (1, 0.25))] == ["bad", "good", "good", "bad"]
    assert val(K.severity_score(*[F.lit(x) for x in (2, 2, 1, 0, 0, 0)])) == 3
    assert val(K.severity_score(*[F.lit(x) for x in (1, 1, 1, 1, 1, 0)])) == 5
    assert val(K.severity_score(F.lit(None), *[F.lit(x) for x in (2, 1, 0, 1, 1)])) == 0
    assert val(K.preview(F.lit("abcdef"), 3)) == "abc..." and val(K.preview(F.lit("abc"), 3)) == "abc"
    assert tuple(val(K.roi_box(F.lit(None).cast("int"), F.lit(None).cast("int")))) == (256, 256, 768, 768, True)
    assert tuple(val(K.roi_box(F.lit(100), F.lit(1500), width=F.lit(1000), height=F.lit(1000)))) == (0, 1250, 350, 1000, False)
    assert tuple(val(K.argmax_prediction(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)), ["x", "y", "z"]))) == (0, "x", 0.4)
    assert [val(K.dme_risk(F.lit(d), F.lit(90.0)))[0] for d in (30.0, 31.0, 90.0, 91.0)] == [2, 1, 1, 0]
    assert val(K.dme_risk(F.lit(None).cast("double"), F.lit(90.0)))[0] == 0
    assert val(K.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_features_round_trip(spark, rows):
    df = spark.createDataFrame([("a.png", 0.9, "Left", 1.0, 2.0, -1.0)],
                               "Filename string, QuickQual_quality double, laterality string, vessel_density_artery_B double, fractal_dimension_vein_whole double, AVR_B double")
    nested = P.features_to_nested(df)
    r = nested.first()
    assert r.quality.quickqual_score == 0.9 and r.optic_disc.laterality == "Left" and r.optic_disc.disc_height_px == -1
    assert r.vessel_features["artery"]["B"] == {"vessel_density": 1.0} and r.large_vessel_metrics == {"AVR_B": -1.0}
    wide = P.long_to_wide(P.nested_to_long(nested)).first()
    assert wide.vessel_density_artery_B == 1.0 and wide.fractal_dimension_vein_whole == 2.0 and wide.vessel_density_vein_C is None


def test_classification_stats_counts_unmatched(spark, rows):
    df = C.classify(spark.createDataFrame([("d1", "q", "poor"), ("d1", "q", "zz"), ("d2", "q", "zz")], "dataset string, question string, ground_truth_answer string"))
    got = rows(S.classification_stats(df).select("dataset", "level", "n"))
    assert (None, "total", 3) in got and (None, "unclassified", 2) in got and ("d1", "subtype", 1) in got and ("d2", "classified", 1) not in got
    assert rows(S.top_answers(df, 1)) == [("zz", 2)]
