"""Queries: projections, filters, classification, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import evidence as E
from ..functions import text as X
from ..functions import trajectory as J
from ..operators import classify as C
from ..operators import examples as P
from ..operators import joins
from ..operators import stats as S
from ..operators import validation as V
from . import catalog as B
from . import rules as RULES
from .catalog import CLS_SQL, FEATS_SQL, PIECES_SQL, PROBS_SQL, QA_SQL, Tables, query, r6


# ---------------------------------------------------------------- projections and filters

@query("p1_normalize_examples", f"""WITH {QA_SQL} SELECT conv_id, question, 'img/' || conv_id || '.png' AS image_path, answer AS ground_truth_answer
FROM qa WHERE question <> '' AND answer <> ''""")
def p1(t: Tables) -> DataFrame:
    turns = F.array(
        F.struct(F.lit("Human").alias("from"), F.col("question").alias("value")),
        F.struct(F.lit("assistant").alias("from"), F.col("answer").alias("value")),
    )
    rec = B.first_turns(t).select("conv_id", turns.alias("conversations"), F.concat(F.lit("img/"), F.col("conv_id"), F.lit(".png")).alias("image"))
    return P.normalize_examples(rec, keep=["conv_id"])


# Whole conversations as records, and the three ways to pick a question and an answer among their turns.
CONV_SQL = "conv AS (SELECT conv_id, list(struct_pack(r := role, t := nullif(text, '')) ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)"


def whole_conversations(t: Tables) -> DataFrame:
    """Records with all turns of a conversation, in order; a conversation is one record and must fit a row."""
    speaker = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    turns = F.array_sort(F.collect_list(F.struct("turn", speaker.alias("from"), F.col("text").alias("value"))))
    rec = t.conversations.groupBy("conv_id").agg(turns.alias("t"))
    shown = F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value")))
    return rec.select("conv_id", F.col("conv_id").cast("string").alias("id"), shown.alias("conversations"), F.concat(F.lit("img/"), F.col("conv_id"), F.lit(".png")).alias("image"))


def _pick_sql(pick: str) -> str:
    said = lambda role: f"list_transform(list_filter(turns, lambda x: x.r = '{role}'), lambda x: x.t)"
    one = {
        "first": lambda role, i: f"list_filter({said(role)}, lambda x: x IS NOT NULL)[1]",
        "last": lambda role, i: f"{said(role)}[-1]",
        "positional": lambda role, i: f"turns[{i}].t",
    }[pick]
    return f"""SELECT * FROM (SELECT conv_id, {one('user', 1)} AS question, 'img/' || conv_id || '.png' AS image_path, {one('assistant', 2)} AS ground_truth_answer FROM conv)
WHERE question IS NOT NULL AND ground_truth_answer IS NOT NULL"""


for _pick in ("first", "last", "positional"):
    @query(f"p1_pick_{_pick}", f"WITH {CONV_SQL} {_pick_sql(_pick)}")
    def _picked(t: Tables, pick: str = _pick) -> DataFrame:
        return P.normalize_examples(whole_conversations(t), pick, keep=["conv_id"])


@query("p2_slice_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def p2(t: Tables) -> DataFrame:
    return P.slice_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 100, 400, 50)


@query("p2_slice_open", "SELECT event_id, event_type, user_id FROM events ORDER BY event_type, user_id, event_id OFFSET 500")
def p2_open(t: Tables) -> DataFrame:
    return P.slice_rows(t.events.select("event_id", "event_type", "user_id"), ["event_type", "user_id", "event_id"], 500, 0)


@query("p3_filter_by_type", f"WITH {CLS_SQL} SELECT doc_id, subtype FROM cls WHERE type = 'D'")
def p3(t: Tables) -> DataFrame:
    return P.filter_by_type(B.classified_documents(t), "D").select("doc_id", F.col("label.subtype").alias("subtype"))


@query("p4_gradable_labels", """SELECT event_id, CAST(user_id % 5 AS INTEGER) AS label FROM events
WHERE event_id % 4 <> 0 AND event_id % 7 <> 0""")
def p4(t: Tables) -> DataFrame:
    m = F.col("event_id") % 4
    raw = t.events.select(
        "event_id", F.when(m == 0, "0").when(m == 1, "1").when(m == 2, "").alias("adjudicated_gradable"),
        F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("user_id") % 5).cast("string")).alias("adjudicated_dr_grade"),
    )
    return P.gradable_labels(raw, on_bad="skip").select("event_id", "label")


@query("p5_coalesce_eye_label", """SELECT event_id, CAST(CASE WHEN event_id % 3 <> 0 THEN user_id % 5 ELSE value::BIGINT % 5 END AS INTEGER) AS label,
user_id || '/' || event_id || '.jpg' AS path FROM events WHERE event_id % 3 <> 0 OR event_id % 4 <> 0""".replace("value::BIGINT", "CAST(floor(value) AS BIGINT)"))
def p5(t: Tables) -> DataFrame:
    e = F.col("event_id")
    raw = t.events.select(
        "event_id", "user_id",
        F.when(e % 3 == 0, "").otherwise((F.col("user_id") % 5).cast("string")).alias("left_level"),
        F.when(e % 4 == 0, "").otherwise((F.floor("value") % 5).cast("string")).alias("right_level"),
    )
    return P.coalesce_eye_label(raw, "user_id", "event_id", "left_level", "right_level").select("event_id", "label", "path")


@query("p6_remap_grade", """SELECT user_id % 6 AS grade, CASE user_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE -1 END AS referable,
CASE user_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE -1 END AS paired, count(*) AS n FROM events GROUP BY ALL""")
def p6(t: Tables) -> DataFrame:
    g = t.events.select((F.col("user_id") % 6).alias("grade"))
    return g.groupBy("grade", K.remap_grade("grade", "referable").alias("referable"), K.remap_grade("grade", "paired").alias("paired")).agg(
        F.count(F.lit(1)).alias("n"))


GATE_SQL = f"""WITH {PROBS_SQL}, g AS (SELECT vec_id, list_position(p, list_max(p)) - 1 AS pred, p[3] AS bad FROM probs)"""


def gated(t: Tables) -> DataFrame:
    p = B.probabilities(t)
    return P.quality_gate(p.select(
        "vec_id", K.argmax_prediction("probs")["class_id"].alias("Prediction"), F.get("probs", F.lit(2)).alias("softmax_bad")), 0.33)


@query("p8_quality_gate", GATE_SQL + " SELECT vec_id, CASE WHEN pred = 0 OR (pred = 1 AND bad < 0.33) THEN 'good' ELSE 'bad' END AS verdict FROM g")
def p8(t: Tables) -> DataFrame:
    return gated(t).select("vec_id", "verdict")


@query("p8_quality_counts", GATE_SQL + """ SELECT count(*) FILTER (WHERE pred = 0 OR (pred = 1 AND bad < 0.33)) AS good,
count(*) FILTER (WHERE NOT (pred = 0 OR (pred = 1 AND bad < 0.33))) AS bad FROM g""")
def p8_counts(t: Tables) -> DataFrame:
    return P.quality_counts(gated(t))


@query("p9_pixel_scale", """SELECT s_suppkey, round(2 * radius / 912.0, 6) AS Scale, round(res * (2 * radius / 912.0) * 1000, 6) AS Scale_resolution
FROM (SELECT s_suppkey, CAST(s_suppkey % 400 + 100 AS DOUBLE) AS radius, n_nationkey * 0.0005::DOUBLE + 0.004::DOUBLE AS res
FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def p9(t: Tables) -> DataFrame:
    res = t.nation.select("n_nationkey", (F.col("n_nationkey") * 0.0005 + 0.004).alias("res"))
    s = t.supplier.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 400 + 100).cast("double").alias("radius"))
    out = P.add_pixel_scale(s.join(res, s.s_nationkey == res.n_nationkey))
    return out.select("s_suppkey", r6("Scale").alias("Scale"), r6("Scale_resolution").alias("Scale_resolution"))


@query("p10_default_resolution", "SELECT c_name AS fundus, 0.008::DOUBLE AS res FROM customer")
def p10(t: Tables) -> DataFrame:
    return P.default_resolution(t.customer, "c_name")


@query("p11_roi_box", """SELECT l_orderkey, l_linenumber, greatest(x - 250, 0) AS x1, greatest(y - 250, 0) AS y1, least(x + 250, 1000) AS x2,
least(y + 250, 1000) AS y2, least(x + 250, 1000) > greatest(x - 250, 0) AND least(y + 250, 1000) > greatest(y - 250, 0) AS valid
FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS INTEGER) AS x, CAST(l_orderkey AS INTEGER) AS y FROM lineitem)""")
def p11(t: Tables) -> DataFrame:
    box = K.roi_box("l_partkey", "l_orderkey", 250, F.lit(1000), F.lit(1000))
    return t.lineitem.select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


def all_features(t: Tables) -> DataFrame:
    parts = [B.status_table(t, s, f"v_{s}", f"m_{s}") for s in ("F", "O", "P")]
    return parts[0].join(parts[1], "Name", "full_outer").join(parts[2], "Name", "full_outer")


WIDE_SQL = FEATS_SQL + """, w AS (SELECT Name, """ + ", ".join(
    f"max(v) FILTER (WHERE s = '{s}') AS v_{s}, max(m) FILTER (WHERE s = '{s}') AS m_{s}" for s in "FOP") + " FROM f GROUP BY Name)"


@query("p12_sentinel_to_null", f"WITH {WIDE_SQL} SELECT Name, " + ", ".join(f"nullif({c}_{s}, -1) AS {c}_{s}" for s in "FOP" for c in "vm") + " FROM w")
def p12(t: Tables) -> DataFrame:
    return P.sentinel_to_null(all_features(t))


@query("p13_drop_all_sentinel_columns", f"WITH {WIDE_SQL} SELECT Name, v_F, m_F, v_O, m_O, v_P, m_P FROM w")
def p13(t: Tables) -> DataFrame:
    return P.drop_all_sentinel_columns(all_features(t).withColumn("empty", F.lit(-1.0)))


def wide_features(t: Tables) -> DataFrame:
    f = all_features(t)
    names = {"v_F": "vessel_density_binary_whole", "m_F": "fractal_dimension_binary_whole", "v_O": "vessel_density_artery_B",
             "m_O": "tortuosity_distance_artery_B", "v_P": "vessel_density_vein_C", "m_P": "tortuosity_density_vein_C"}
    return f.select(F.col("Name").alias("Filename"), *[F.col(k).alias(v) for k, v in names.items()])


LONG_SQL = WIDE_SQL + """, lng AS (
SELECT Name AS filename, 'binary' AS vessel_type, 'whole' AS zone, 'vessel_density' AS metric, v_F AS value FROM w UNION ALL
SELECT Name, 'binary', 'whole', 'fractal_dimension', m_F FROM w UNION ALL SELECT Name, 'artery', 'B', 'vessel_density', v_O FROM w UNION ALL
SELECT Name, 'artery', 'B', 'tortuosity_distance', m_O FROM w UNION ALL SELECT Name, 'vein', 'C', 'vessel_density', v_P FROM w UNION ALL
SELECT Name, 'vein', 'C', 'tortuosity_density', m_P FROM w)"""


@query("p14_nested_report", f"WITH {LONG_SQL} SELECT * FROM lng")
def p14(t: Tables) -> DataFrame:
    return P.nested_to_long(P.features_to_nested(wide_features(t)))


@query("p15_preview", """SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS short,
CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS long FROM documents""")
def p15(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", K.preview("text", 100).alias("short"), K.preview("text", 200).alias("long"))


# ---------------------------------------------------------------- classification

@query("c1_expand_answer", r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN lower(event_type) WHEN 1 THEN lower(props) ELSE lower(event_type) || ' ' || lower(props) END AS answer_text
FROM events""")
def c1(t: Tables) -> DataFrame:
    m = F.col("event_id") % 3
    q = F.concat(F.lit("Which? A: "), F.col("event_type"), F.lit("\nB: "), F.col("props"))
    a = F.when(m == 0, "A").when(m == 1, "b").otherwise("A, B")
    return t.events.select("event_id", q.alias("q"), a.alias("a")).select("event_id", X.expand_answer("q", "a").alias("answer_text"))


@query("c2_classify_documents", f"WITH {CLS_SQL} SELECT doc_id, type, subtype, confidence, description FROM cls")
def c2(t: Tables) -> DataFrame:
    return B.classified_documents(t).select("doc_id", "label.type", "label.subtype", "label.confidence", "label.description")


# The shipped rules: each document gets the first words of one rule's conditions, by its number.
SHIPPED = [*RULES.MEDICAL_RULES, *RULES.CORRECTION_RULES]
SHIPPED_PHRASES = [
    [" ".join(["", *[words[0] for where, mode, words in r["when"] if mode == "any" and side in where], ""]) for r in SHIPPED] for side in ("q", "a")
]
_phrase = lambda side: "[" + ", ".join(f"'{p}'" for p in SHIPPED_PHRASES[side]) + f"][CAST(doc_id % {len(SHIPPED)} AS INTEGER) + 1]"
_medical, _fixes = B.rules_sql(RULES.MEDICAL_RULES), B.rules_sql(RULES.CORRECTION_RULES)
SHIPPED_SQL = f"""sh AS (SELECT doc_id, lower(lang || {_phrase(0)}) AS q, lower(text || {_phrase(1)}) AS a FROM documents)"""


def shipped_documents(t: Tables) -> DataFrame:
    pick = lambda side: F.get(F.array(*[F.lit(p) for p in SHIPPED_PHRASES[side]]), (F.col("doc_id") % len(SHIPPED)).cast("int"))
    return t.texts.select("doc_id", F.concat("lang", pick(0)).alias("question"), F.concat("text", pick(1)).alias("ground_truth_answer"))


@query("c2_shipped_rules", f"""WITH {SHIPPED_SQL} SELECT doc_id, {_medical['type']} AS type, {_medical['subtype']} AS subtype, {_medical['confidence']} AS confidence, {_medical['description']} AS description FROM sh""")
def c2b(t: Tables) -> DataFrame:
    return C.classify(shipped_documents(t), expand=False).select("doc_id", "label.type", "label.subtype", "label.confidence", "label.description")


@query("c2_check_corrections", f"""WITH {SHIPPED_SQL} SELECT doc_id, {_fixes['type']} AS type, {_fixes['subtype']} AS subtype, {_fixes['confidence']} AS confidence, {_fixes['description']} AS description FROM sh""")
def c2c(t: Tables) -> DataFrame:
    rows = shipped_documents(t).withColumn("answer_text", F.lower("ground_truth_answer"))
    return C.check_corrections(rows).select("doc_id", "correction.type", "correction.subtype", "correction.confidence", "correction.description")


_open = " OR ".join(f"contains(a, '{w}')" for w in [*RULES.DR_WORDS, *RULES.AMD_WORDS, *RULES.HEALTHY_WORDS])
for _wanted, _where in (("B", f" AND ({_open})"), ("E", "")):
    @query(f"p3_filter_type_{_wanted.lower()}", f"WITH {SHIPPED_SQL} SELECT doc_id, {_medical['subtype']} AS subtype FROM sh WHERE {_medical['type']} IS NOT NULL{_where}")
    def _filtered(t: Tables, wanted: str = _wanted) -> DataFrame:
        return P.filter_by_type(C.classify(shipped_documents(t), expand=False), wanted).select("doc_id", F.col("label.subtype").alias("subtype"))


# Tool results built from events: grade, lesion shares, risk level, cup ratios and confidences.
def tool_results(t: Tables) -> DataFrame:
    v, u, e = F.col("value"), F.col("user_id"), F.col("event_id")
    ok = F.lit("success")
    result = F.struct(
        F.struct(F.when(e % 9 == 0, "error").otherwise("success").alias("status"), F.struct((v / 500).alias("score")).alias("result")).alias("quality_assess"),
        F.struct(ok.alias("status"), F.struct(F.struct((u % 5).alias("class_id"), F.when(u % 5 == 0, "正常").otherwise("中度").alias("class_name"),
                 (v / 400).alias("confidence")).alias("prediction")).alias("result")).alias("DR_Grading"),
        F.struct(ok.alias("status"), F.struct(F.struct((v / 5000).alias(E.HARD), (e % 12).alias(E.ANEURYSMS), (v / 9000).alias(E.BLEED)).alias(E.METRICS)).alias("result")).alias("detect_lesions"),
        F.struct(ok.alias("status"), F.struct((u % 3).alias("risk_level")).alias("result")).alias("dme_risk_assess"),
        F.struct(ok.alias("status"), F.struct(F.array(F.struct(F.struct((v / 200).alias("cdr_vertical"), (v / 250).alias("cdr_horizontal")).alias("optic_disc"))).alias("images")).alias("result")).alias("segment_by_AutoMorphalyzer"),
        F.struct(ok.alias("status"), F.struct(F.struct(F.struct(F.when(e % 2 == 0, "Yes").otherwise("No").alias("label"), (v / 300).alias("confidence")).alias("amd")).alias("results")).alias("result")).alias("AMD_predict"),
    )
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("diabetic retinopathy moderate diabetic retinopathy", "late amd", "normal fundus", "hard exudates", "no finding")]),
                         (e % 5 + 1).cast("int"))
    label = F.struct(F.lit("A").alias("type"), F.when(e % 5 == 0, "pure_dr").otherwise("pure_seg").alias("subtype"),
                     F.lit(0.75).alias("confidence"), F.lit("start").alias("description"))
    return t.heavy_events.select("event_id", "event_type", F.parse_json(F.to_json(result)).alias("tool_results"), kinds.alias("answer_text"), label.alias("label"))


EV_SQL = """ev AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value / 500 END AS quality,
CASE WHEN value / 5000 >= 0.03 OR event_id % 12 >= 10 OR value / 9000 >= 0.05 THEN 'detect_lesions' WHEN user_id % 5 > 0 THEN 'DR_Grading' END AS dr_features,
CASE user_id % 5 WHEN 1 THEN 'mild diabetic retinopathy' WHEN 2 THEN 'moderate diabetic retinopathy' WHEN 3 THEN 'severe diabetic retinopathy' WHEN 4 THEN 'proliferative diabetic retinopathy' END AS dr_grade,
CASE WHEN event_id % 2 = 0 THEN 'AMD_predict' END AS amd_features,
CASE WHEN user_id % 3 >= 1 THEN 'dme_risk_assess' END AS dme_signs,
CASE WHEN (value / 200 + value / 250) / 2 BETWEEN 0.5 AND 0.6 THEN (value / 200 + value / 250) / 2 END AS borderline_cdr,
event_id % 12 >= 3 OR value / 9000 >= 0.02 OR value / 5000 >= 0.01 AS artefact,
CASE WHEN event_id % 2 = 0 AND value / 300 < 0.6 THEN 'AMD_predict' END AS low_confidence, value, user_id FROM events)"""


@query("c3_extract_evidence", f"""WITH {EV_SQL} SELECT event_id, round(quality, 6) AS quality, dr_features AS dr_source, dr_grade, amd_features AS amd_source,
dme_signs AS dme_source, round(borderline_cdr, 6) AS cdr_average, low_confidence AS low_tool,
CASE WHEN dr_features = 'detect_lesions' THEN round(value / 5000, 6) END AS dr_hard, CASE WHEN dr_features = 'detect_lesions' THEN CAST(event_id % 12 AS DOUBLE) END AS dr_aneurysms,
CASE WHEN dr_features = 'detect_lesions' THEN round(value / 9000, 6) END AS dr_bleeding, CASE WHEN dr_features = 'detect_lesions' THEN CAST(0 AS DOUBLE) END AS dr_soft,
CASE WHEN dr_features = 'DR_Grading' THEN '中度' END AS dr_name, CASE WHEN dr_features = 'DR_Grading' THEN CAST(user_id % 5 AS INTEGER) END AS dr_class,
CASE WHEN dr_features = 'DR_Grading' THEN round(value / 400, 6) END AS dr_confidence, CASE WHEN amd_features IS NOT NULL THEN round(value / 300, 6) END AS amd_confidence,
CASE WHEN dme_signs IS NOT NULL THEN CAST(user_id % 3 AS VARCHAR) END AS dme_level, CASE WHEN borderline_cdr IS NOT NULL THEN round(value / 200, 6) END AS cdr_vertical,
CASE WHEN artefact THEN CAST(event_id % 12 AS DOUBLE) END AS artefact_aneurysms, CASE WHEN artefact THEN round(value / 5000, 6) END AS artefact_hard,
CASE WHEN low_confidence IS NOT NULL THEN round(value / 300, 6) END AS low_value, CASE WHEN low_confidence IS NOT NULL THEN CAST(0.6 AS DOUBLE) END AS low_threshold FROM ev""")
def c3(t: Tables) -> DataFrame:
    ev = C.extract_evidence(tool_results(t)).select("event_id", "evidence.*")
    names = {
        "dr_source": "dr_features.source", "dr_grade": "dr_grade", "amd_source": "amd_features.source", "dme_source": "dme_signs.source", "low_tool": "low_confidence.tool_name",
        "dr_aneurysms": "dr_features.aneurysms", "dr_soft": "dr_features.soft", "dr_name": "dr_features.grade", "dr_class": "dr_features.predicted_class",
        "dme_level": "dme_signs.risk_level", "artefact_aneurysms": "artefact.aneurysms", "low_threshold": "low_confidence.threshold",
    }
    rounded = {
        "quality": "quality", "cdr_average": "borderline_cdr.cdr_average", "cdr_vertical": "borderline_cdr.cdr_vertical", "dr_hard": "dr_features.hard", "dr_bleeding": "dr_features.bleeding",
        "dr_confidence": "dr_features.confidence", "amd_confidence": "amd_features.amd_confidence", "artefact_hard": "artefact.hard", "low_value": "low_confidence.confidence",
    }
    return ev.select("event_id", *[F.col(c).alias(n) for n, c in names.items()], *[r6(c).alias(n) for n, c in rounded.items()])


@query("c4_adjust_labels", f"""WITH {EV_SQL}, f AS (SELECT *, event_id % 5 AS k FROM ev),
g AS (SELECT *, CASE WHEN k = 0 AND dr_grade IS NOT NULL AND dr_grade <> 'moderate diabetic retinopathy' THEN 'grade'
WHEN k = 1 AND dr_features IS NOT NULL THEN 'amd' WHEN k = 2 AND borderline_cdr IS NOT NULL THEN 'cup'
WHEN k = 2 AND artefact THEN 'artefact' WHEN low_confidence IS NOT NULL THEN 'confidence' WHEN k IN (0, 3) AND dme_signs IS NOT NULL THEN 'cascade' END AS rule FROM f)
SELECT event_id, rule, CASE rule WHEN 'grade' THEN 'B-dr_grading_mismatch' WHEN 'amd' THEN 'B-false_dr_is_amd' WHEN 'cup' THEN 'B-false_glaucoma' WHEN 'artefact' THEN 'B-artifact'
WHEN 'confidence' THEN 'B-low_confidence_recheck' WHEN 'cascade' THEN 'C-dr_to_dme' ELSE CASE WHEN k = 0 THEN 'A-pure_dr' ELSE 'A-pure_seg' END END AS final,
CASE rule {" ".join(f"WHEN '{n}' THEN '{text}'" for n, text in E.REASONS.items())} END AS reason,
CASE rule WHEN 'grade' THEN 'Diabetic retinopathy' WHEN 'amd' THEN 'Late AMD' WHEN 'cup' THEN 'Normal fundus' WHEN 'artefact' THEN 'Normal fundus' END AS ground_truth,
CASE WHEN rule = 'grade' THEN dr_grade END AS tool_grade, CASE WHEN rule = 'amd' THEN dr_features END AS false_positive_source,
CASE WHEN rule = 'cup' THEN round(borderline_cdr, 6) END AS cdr_average, CASE WHEN rule = 'artefact' THEN round(value / 9000, 6) END AS bleeding,
CASE WHEN rule = 'confidence' THEN round(value / 300, 6) END AS low_value, CASE WHEN rule = 'cascade' THEN CAST(user_id % 3 AS VARCHAR) END AS dme_level FROM g""")
def c4(t: Tables) -> DataFrame:
    truth = F.element_at(F.array(*[F.lit(x) for x in ("Diabetic retinopathy", "Late AMD", "Normal fundus", "Hard exudates", "No finding")]), (F.col("event_id") % 5 + 1).cast("int"))
    out = C.adjust_labels(C.extract_evidence(tool_results(t).withColumn("truth", truth)), truth="truth")
    why = lambda field: F.col(f"reason_evidence.{field}")
    return out.select(
        "event_id", "rule", F.concat_ws("-", "final_label.type", "final_label.subtype").alias("final"), "reason", why("ground_truth"), why("tool_grade"),
        why("tool_false_positive.source").alias("false_positive_source"), r6(why("cdr_metrics.cdr_average")).alias("cdr_average"),
        r6(why("detected_lesions.bleeding")).alias("bleeding"), r6(why("low_confidence.confidence")).alias("low_value"), why("dme_signs.risk_level").alias("dme_level"),
    )


@query("c5_gate_types", f"""WITH {CLS_SQL} SELECT doc_id, CASE WHEN type IS NULL THEN 'unclassified'
WHEN type NOT IN ('A', 'B') THEN 'type filter' WHEN subtype = 'healthy' THEN 'healthy skipped' END AS skip_reason FROM cls""")
def c5(t: Tables) -> DataFrame:
    return C.gate_types(B.classified_documents(t), ["A", "B"], skip_healthy=True).select("doc_id", "skip_reason")


TEXT_PLANS = {("A", "plain_en"): ["view", "click"], ("A", "plain_other"): ["view"], ("C", "chained"): ["signup", "error", "view"],
              ("D", "english_french"): ["purchase", "view", "purchase"], ("E", "low_trust"): []}
TEXT_DEPENDENCIES = {"click": ["view"], "error": ["click", "purchase"], "purchase": ["signup"]}
PLAN_SQL = f"""WITH {CLS_SQL}, plans AS (SELECT doc_id, CASE WHEN type = 'A' AND subtype = 'plain_en' THEN 'view,click' WHEN subtype = 'plain_other' THEN 'view'
WHEN subtype = 'chained' THEN 'signup,click,purchase,error,view' WHEN subtype = 'english_french' THEN 'signup,purchase,view' WHEN subtype = 'low_trust' THEN ''
ELSE 'signup,click' END AS steps FROM cls)"""


@query("c6_plan_tools", PLAN_SQL.replace("'signup,click' END", "'view,click' END") + " SELECT doc_id, steps FROM plans")
def c6(t: Tables) -> DataFrame:
    planned = C.plan_tools(B.classified_documents(t), TEXT_PLANS, TEXT_DEPENDENCIES, ["click"])
    return planned.select("doc_id", F.array_join("steps", ",").alias("steps"))


# The shipped plans and dependencies: each document asks for one (type, subtype) by its number, one of them unknown.
_kinds = [*RULES.TOOL_PLANS, ("Z", "unknown")]
_plans_sql = ", ".join(f"({i}, {[*RULES.TOOL_PLANS.get(k, RULES.DEFAULT_PLAN)]!r}::VARCHAR[])" for i, k in enumerate(_kinds))
_needs_sql = "MAP {" + ", ".join(f"'{k}': {list(v)!r}" for k, v in RULES.TOOL_DEPENDENCIES.items()) + "}"


@query("c6_shipped_plans", f"""WITH p(i, plan) AS (VALUES {_plans_sql}), d AS (SELECT doc_id, plan FROM documents JOIN p ON doc_id % {len(_kinds)} = i),
s AS (SELECT doc_id, plan, flatten(list_transform(plan, lambda x: list_append(list_filter(coalesce({_needs_sql}[x], []::VARCHAR[]), lambda y: NOT list_contains(plan, y)), x))) AS f FROM d),
o AS (SELECT doc_id, plan, list_filter(f, lambda x, i: list_position(f, x) = i) AS steps FROM s)
SELECT doc_id, array_to_string(plan, ',') AS plan, array_to_string(steps, ',') AS steps FROM o""")
def c6_shipped(t: Tables) -> DataFrame:
    kind = F.get(F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("subtype")) for a, b in _kinds]), (F.col("doc_id") % len(_kinds)).cast("int"))
    planned = C.plan_tools(t.documents.select("doc_id", kind.alias("label")))
    return planned.select("doc_id", F.array_join("plan", ",").alias("plan"), F.array_join("steps", ",").alias("steps"))


@query("c7_missing_steps", """WITH done AS (SELECT user_id, list(DISTINCT event_type) AS d FROM events WHERE value > 40 GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, array_to_string(list_filter(['view', 'click', 'view', 'error'], lambda s: NOT list_contains(coalesce(d, []), s)), ',') AS missing
FROM u LEFT JOIN done USING (user_id)""")
def c7(t: Tables) -> DataFrame:
    # five event types at most, so the set per user is small; collect_set combines map-side
    done = t.events.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 40, F.col("event_type"))).alias("done"))
    plan = F.array(*[F.lit(s) for s in ("view", "click", "view", "error")])
    return done.select("user_id", F.array_join(C.missing_steps(plan, F.col("done")), ",").alias("missing"))


@query("c8_distribution_gap", f"""WITH {CLS_SQL}, s AS (SELECT type, count(*) AS n FROM cls WHERE type IS NOT NULL GROUP BY 1),
g(type, target) AS (VALUES ('A', 0.40::DOUBLE), ('B', 0.25::DOUBLE), ('C', 0.15::DOUBLE), ('D', 0.15::DOUBLE), ('E', 0.05::DOUBLE)), tot AS (SELECT sum(n) AS t FROM s)
SELECT g.type, coalesce(n, 0) AS n, round(coalesce(n, 0) / t, 6) AS share, target, round(coalesce(n, 0) / t - target, 6) AS gap FROM g LEFT JOIN s USING (type), tot""")
def c8(t: Tables) -> DataFrame:
    return C.distribution_gap(B.classified_documents(t)).withColumns({"share": r6("share"), "gap": r6("gap")})


@query("c11_argmax_prediction", f"""WITH {PROBS_SQL} SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS class_id,
['good', 'usable', 'bad'][list_position(p, list_max(p))] AS label, round(list_max(p), 6) AS confidence FROM probs""")
def c11(t: Tables) -> DataFrame:
    out = B.probabilities(t).select("vec_id", K.argmax_prediction("probs", ["good", "usable", "bad"]).alias("p")).select("vec_id", "p.*")
    return out.withColumn("confidence", r6("confidence"))


# ---------------------------------------------------------------- reports over classified rows

@query("g10_classification_stats", f"""WITH {CLS_SQL}, base AS MATERIALIZED (SELECT dataset, type, subtype, count(*) AS n FROM cls GROUP BY ALL),
x AS MATERIALIZED (SELECT dataset, 'total' AS level, NULL AS type, NULL AS subtype, sum(n) AS n FROM base GROUP BY dataset
UNION ALL SELECT dataset, CASE WHEN type IS NULL THEN 'unclassified' ELSE 'classified' END, NULL, NULL, sum(n) FROM base GROUP BY 1, 2
UNION ALL SELECT dataset, 'type', type, NULL, sum(n) FROM base WHERE type IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT dataset, 'subtype', type, subtype, sum(n) FROM base WHERE type IS NOT NULL GROUP BY 1, 3, 4),
y AS (SELECT * FROM x UNION ALL SELECT NULL, level, type, subtype, sum(n) FROM x GROUP BY level, type, subtype)
SELECT y.dataset, y.level, y.type, y.subtype, CAST(y.n AS BIGINT) AS n, round(y.n * 100 / tt.n, 6) AS percent
FROM y JOIN (SELECT dataset, n FROM y WHERE level = 'total') tt ON y.dataset IS NOT DISTINCT FROM tt.dataset""")
def g10(t: Tables) -> DataFrame:
    return S.classification_stats(B.classified_documents(t)).withColumn("percent", r6("percent"))


@query("g11_top_answers", f"""WITH {CLS_SQL} SELECT answer_text AS answer, count(*) AS n FROM cls WHERE type IS NULL GROUP BY 1 ORDER BY n DESC, answer LIMIT 20""")
def g11(t: Tables) -> DataFrame:
    return S.top_answers(B.classified_documents(t), 20, answer="answer_text")


@query("g11_frequent_answers", "SELECT event_type || ' ' || props AS answer, count(*) AS n FROM events WHERE user_id % 3 > 0 GROUP BY 1 ORDER BY n DESC, answer LIMIT 20")
def g11_frequent(t: Tables) -> DataFrame:
    rows = t.events.select(F.concat_ws(" ", "event_type", "props").alias("answer"), F.when(F.col("user_id") % 3 == 0, "known").alias("label"))
    return S.frequent_answers(rows, 20, answer="answer")


RUN_SQL = """r AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN NULL ELSE text END AS trajectory, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS type, role AS subtype FROM conversations)"""


@query("g12_run_report", f"""WITH {RUN_SQL} SELECT 'status' AS section, 'total' AS name, count(*) AS n, CAST(100 AS DOUBLE) AS percent FROM r
UNION ALL SELECT 'status', CASE WHEN trajectory IS NULL THEN 'failed' ELSE 'success' END, count(*), round(count(*) * 100 / (SELECT count(*) FROM r), 6) FROM r GROUP BY 2
UNION ALL SELECT 'type', type || '-' || subtype, count(*), round(count(*) * 100 / (SELECT count(*) FROM r WHERE trajectory IS NOT NULL), 6) FROM r WHERE trajectory IS NOT NULL GROUP BY 2""")
def g12(t: Tables) -> DataFrame:
    rows = t.conversations.select(
        F.when(F.col("conv_id") % 4 != 3, F.col("text")).alias("trajectory"),
        F.when(F.col("role") == "user", "A").otherwise("B").alias("type"), F.col("role").alias("subtype"))
    return S.run_report(rows).withColumn("percent", r6("percent"))


@query("g13_tool_usage", "SELECT event_type AS tool_name, count(*) AS n FROM events GROUP BY 1")
def g13(t: Tables) -> DataFrame:
    log = t.events.select(F.array(F.struct(F.col("event_type").alias("tool_name"), F.col("value").alias("execution_time"))).alias("tool_execution_log"))
    return S.tool_usage(log)


@query("j6_pair_eyes", """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'L' WHEN 'view' THEN 'R' END AS eye,
CAST(floor(value) AS BIGINT) % 3 AS drusen, event_id % 2 AS pigment, (event_id // 2) % 2 AS amd FROM events),
p AS (SELECT user_id, arg_min(drusen, event_id) FILTER (WHERE eye = 'L') AS dl, arg_min(drusen, event_id) FILTER (WHERE eye = 'R') AS dr,
arg_min(pigment, event_id) FILTER (WHERE eye = 'L') AS pl, arg_min(pigment, event_id) FILTER (WHERE eye = 'R') AS pr,
arg_min(amd, event_id) FILTER (WHERE eye = 'L') AS al, arg_min(amd, event_id) FILTER (WHERE eye = 'R') AS ar FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN dr IS NOT NULL THEN dl END AS drusen_L, CASE WHEN dl IS NOT NULL THEN dr END AS drusen_R, CASE WHEN dr IS NOT NULL THEN pl END AS pigment_L,
CASE WHEN dl IS NOT NULL THEN pr END AS pigment_R, CASE WHEN dr IS NOT NULL THEN al END AS amd_L, CASE WHEN dl IS NOT NULL THEN ar END AS amd_R FROM p""")
def j6(t: Tables) -> DataFrame:
    return eyes(t)


def eyes(t: Tables) -> DataFrame:
    e = t.events.select(
        "user_id", "event_id", F.when(F.col("event_type") == "click", "L").when(F.col("event_type") == "view", "R").alias("eye"),
        (F.floor("value") % 3).alias("drusen"), (F.col("event_id") % 2).alias("pigment"), (F.floor(F.col("event_id") / 2) % 2).alias("amd"))
    return joins.pair_eyes(e, "user_id", "eye", ["drusen", "pigment", "amd"], ["event_id"])


@query("c10_severity_score", B.SQL["j6_pair_eyes"].split("SELECT user_id, CASE WHEN dr IS NOT NULL")[0] + """SELECT user_id,
CASE WHEN dl IS NULL OR dr IS NULL THEN 0 ELSE least(5, 5 * (al = 1)::INT + 5 * (ar = 1)::INT + (pl = 1)::INT + (pr = 1)::INT + (dl = 2)::INT + (dr = 2)::INT + (dl = 1 AND dr = 1)::INT) END AS score FROM p""")
def c10(t: Tables) -> DataFrame:
    return eyes(t).select("user_id", K.severity_score("drusen_L", "drusen_R", "pigment_L", "pigment_R", "amd_L", "amd_R").alias("score"))


# ---------------------------------------------------------------- trajectories

VAL_SQL = PIECES_SQL + r""", parts AS (SELECT conv_id, trajectory AS tr, truth, statuses, reasoning_type,
regexp_extract_all(trajectory, '(?s)<think>(.*?)</think>', 1) AS thinks, regexp_extract_all(trajectory, '(?s)<observation>(.*?)</observation>', 1) AS obs,
regexp_extract_all(trajectory, '(?s)<answer>(.*?)</answer>', 1) AS answers, regexp_extract_all(lower(truth), '[\pL\pN_]+') AS words FROM traj),
m AS (SELECT *, len(string_split(tr, '<tool_call>')) - 1 AS calls, len(string_split(tr, '<observation>')) - 1 AS nobs,
len(list_filter(statuses, lambda s: len(list_filter(obs, lambda o: contains(o, s))) > 0)) AS matched,
len(list_filter(thinks, lambda b: length(trim(b, E' \n\t\r')) < 20)) AS hollow,
len(list_filter(words, lambda w: length(w) > 3 AND contains(lower(answers[-1]), w))) AS hits FROM parts),
c AS (SELECT *, contains(tr, '<think>') AND contains(tr, '</think>') AND contains(tr, '<answer>') AND contains(tr, '</answer>') AND calls = nobs AND starts_with(tr, '<think>') AS xml_valid,
len(statuses) = 0 OR matched / len(statuses) >= 0.5 AS tool_results_match,
len(thinks) > 0 AND hollow <= len(thinks) * 0.3 AND len(list_filter(['visual','observe','analysis','hypothesis','plan','观察','分析','假设','计划','发现'], lambda w: contains(lower(tr), w))) > 0 AS reasoning_coherent,
starts_with(reasoning_type, 'B') AND calls >= 2 AND len(list_filter(['however','but','correction','revise','actually','但是','然而','纠正','修正','实际上','重新评估'], lambda w: contains(lower(tr), w))) > 0 AS correction_demonstrated,
len(answers) > 0 AND len(words) > 0 AND hits / len(words) >= 0.3 AS ground_truth_reached FROM m),
v AS (SELECT *, round_even(0.2 * xml_valid::INT + 0.25 * tool_results_match::INT + 0.25 * reasoning_coherent::INT
+ 0.1 * (NOT starts_with(reasoning_type, 'B') OR correction_demonstrated)::INT + 0.2 * ground_truth_reached::INT, 3)::DOUBLE AS quality_score FROM c)"""

ISSUES_SQL = VAL_SQL + """, iss AS (SELECT v.*, list_filter([
CASE WHEN NOT contains(tr, '<think>') THEN '缺少必需标签: <think>' WHEN NOT contains(tr, '</think>') THEN '缺少必需标签: </think>' WHEN NOT contains(tr, '<answer>') THEN '缺少必需标签: <answer>'
WHEN NOT contains(tr, '</answer>') THEN '缺少必需标签: </answer>' WHEN calls <> nobs THEN 'tool_call (' || calls || ') 和 observation (' || nobs || ') 数量不匹配'
WHEN NOT starts_with(tr, '<think>') THEN '轨迹未以<think>开头' END,
CASE WHEN NOT tool_results_match THEN '工具结果匹配率过低: ' || printf('%.1f', round_even(100.0 * matched / len(statuses), 1)) || '%' END,
CASE WHEN len(thinks) = 0 THEN '没有找到think块' WHEN hollow > len(thinks) * 0.3 THEN '过多空洞的think块: ' || hollow || '/' || len(thinks) WHEN NOT reasoning_coherent THEN '缺少推理关键词' END,
CASE WHEN starts_with(reasoning_type, 'B') AND NOT correction_demonstrated THEN CASE WHEN len(list_filter(['however','but','correction','revise','actually'], lambda w: contains(lower(tr), w))) = 0
 THEN 'Type B轨迹应包含纠错过程' ELSE 'Type B轨迹应包含多个工具调用' END END,
CASE WHEN len(answers) = 0 THEN '没有找到answer块' WHEN NOT ground_truth_reached THEN '答案与ground truth匹配度过低: ' || printf('%.1f', round_even(100.0 * hits / len(words), 1)) || '%' END
], lambda x: x IS NOT NULL) AS issues FROM v)"""


def _check(name: str, flag: str, fn) -> None:
    @query(name, f"WITH {VAL_SQL} SELECT conv_id, {flag} AS ok FROM v")
    def run(t: Tables) -> DataFrame:
        return B.trajectories(t).select("conv_id", fn()["ok"].alias("ok"))


_check("v1_check_format", "xml_valid", lambda: J.check_format("trajectory"))
_check("v2_check_tool_match", "tool_results_match", lambda: J.check_tool_match("trajectory", "tool_execution_log"))
_check("v3_check_coherence", "reasoning_coherent", lambda: J.check_coherence("trajectory"))
_check("v4_check_correction", """(calls >= 2 AND len(list_filter(['however','but','correction','revise','actually','但是','然而','纠正','修正','实际上','重新评估'], lambda w: contains(lower(tr), w))) > 0)""",
       lambda: J.check_correction("trajectory"))
_check("v5_check_answer", "ground_truth_reached", lambda: J.check_answer("trajectory", "ground_truth_answer"))


@query("v6_quality_score", f"WITH {VAL_SQL} SELECT conv_id, quality_score FROM v")
def v6(t: Tables) -> DataFrame:
    return V.validate(B.trajectories(t)).select("conv_id", "quality_score")


@query("v7_validate", f"""WITH {ISSUES_SQL} SELECT conv_id, xml_valid, tool_results_match, reasoning_coherent, correction_demonstrated, ground_truth_reached, quality_score,
array_to_string(issues, ' | ') AS issues FROM iss""")
def v7(t: Tables) -> DataFrame:
    out = V.validate(B.trajectories(t))
    return out.select("conv_id", *V.CHECKS, "quality_score", F.array_join("issues", " | ").alias("issues"))


@query("v8_filter_trajectories", f"""WITH {VAL_SQL} SELECT conv_id FROM v WHERE xml_valid AND tool_results_match AND (quality_score >= 0.9 OR correction_demonstrated)""")
def v8(t: Tables) -> DataFrame:
    return V.filter_trajectories(V.validate(B.trajectories(t)), V.FilterPolicy(min_score=0.9)).select("conv_id")


@query("v9_select_attempt", f"""WITH {PIECES_SQL}, k AS (SELECT conv_id, trajectory, '<think>' || body || '</think><answer>' || body || '</answer>' AS retry FROM traj)
SELECT conv_id, CASE WHEN contains(trajectory, '<think>') AND contains(trajectory, '<answer>') THEN 1 WHEN conv_id % 2 = 0 THEN 2 END AS attempt,
CASE WHEN contains(trajectory, '<think>') AND contains(trajectory, '<answer>') THEN length(trajectory) WHEN conv_id % 2 = 0 THEN length(retry) END AS chars,
CASE WHEN NOT (contains(trajectory, '<think>') AND contains(trajectory, '<answer>')) AND conv_id % 2 <> 0 THEN 'no usable attempt out of 2' END AS error FROM k""")
def v9(t: Tables) -> DataFrame:
    first = B.first_turns(t).select("conv_id", F.coalesce("answer", F.lit("")).alias("body"))
    retry = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("<think>"), F.col("body"), F.lit("</think><answer>"), F.col("body"), F.lit("</answer>")))
    tries = B.trajectories(t).join(first, "conv_id").select("conv_id", F.array(
        F.struct(F.lit(1).alias("attempt"), F.col("trajectory")), F.struct(F.lit(2).alias("attempt"), retry.alias("trajectory"))).alias("attempts"))
    out = tries.select("conv_id", J.select_attempt("attempts").alias("s"))
    return out.select("conv_id", "s.attempt", F.length("s.trajectory").cast("long").alias("chars"), "s.error")


@query("v10_fill_placeholders", """SELECT event_id, 'Seen ' || event_type || '=' || props || '; then [TOOL_RESULT_PLACEHOLDER:other] and v=' || CAST(floor(value) AS BIGINT) AS text, 3 AS found, 1 AS "left" FROM events""")
def v10(t: Tables) -> DataFrame:
    whole = F.floor("value").cast("string")
    text = F.concat(F.lit("Seen [TOOL_RESULT_PLACEHOLDER:"), F.col("event_type"), F.lit("]; then [TOOL_RESULT_PLACEHOLDER:other] and [TOOL_RESULT_PLACEHOLDER:val]"))
    table = F.create_map(F.col("event_type"), F.concat_ws("=", "event_type", "props"), F.lit("val"), F.concat(F.lit("v="), whole))
    return t.events.select("event_id", text.alias("x"), table.alias("m")).select("event_id", J.fill_placeholders("x", "m").alias("f")).select("event_id", "f.*")


@query("v11_summarize_tool", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '工具执行失败: ' || event_type
WHEN 1 THEN 'DR分级: grade (类别 ' || user_id % 5 || ', 置信度: ' || printf('%.2f', round((user_id % 9) * 0.1::DOUBLE, 2)) || ')'
WHEN 2 THEN 'DME风险: ' || user_id % 3 || CASE WHEN user_id % 2 = 0 THEN ', 黄斑附近有渗出物' ELSE '' END
ELSE '工具执行成功: z=' || user_id || ', name=' || event_type || ', b=' || event_id || ', y=' || CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END || ', a=None' END AS summary FROM events""")
def v11(t: Tables) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    tool = F.element_at(F.array(*[F.lit(x) for x in ("any", "DR_Grading", "dme_risk_assess", "custom")]), (e % 4 + 1).cast("int"))
    payload = (
        F.when(e % 4 == 0, F.to_json(F.struct(F.lit("failed").alias("status"), F.col("event_type").alias("error"))))
        .when(e % 4 == 1, F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.struct(
            F.lit("grade").alias("class_name"), (u % 5).alias("class_id"), ((u % 9) * 0.1).alias("confidence")).alias("prediction")).alias("result"))))
        .when(e % 4 == 2, F.to_json(F.struct(F.lit("success").alias("status"), F.struct((u % 3).alias("risk_level"), (u % 2 == 0).alias("exudates_near_fovea")).alias("result"))))
        .otherwise(F.to_json(F.struct(F.lit("success").alias("status"), F.struct(
            u.alias("z"), F.col("event_type").alias("name"), e.alias("b"), (u % 2 == 0).alias("y"), F.lit(None).cast("string").alias("a"), e.alias("c"), u.alias("0")).alias("result")), {"ignoreNullFields": "false"}))
    )
    rows = t.heavy_events.select("event_id", tool.alias("tool"), payload.alias("text")).select("*", F.parse_json("text").alias("p"))
    return rows.select("event_id", E.summarize_tool("tool", "p", "text").alias("summary"))


GRADE_SQL = f"""{QA_SQL}, g AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'say <ANSWER> ' || coalesce(answer, '') || ' </answer> <answer>z</answer>' WHEN conv_id % 4 = 1 THEN ' b ' WHEN conv_id % 4 = 2 THEN coalesce(answer, '') ELSE '<answer>C, A</answer>' END AS message,
CASE WHEN conv_id % 4 = 0 THEN trim(coalesce(answer, ''), E' \\n\\t\\r') WHEN conv_id % 8 = 1 THEN 'B' WHEN conv_id % 4 = 1 THEN 'D' ELSE 'A,C' END AS truth FROM qa),
pg AS (SELECT conv_id, truth, CASE WHEN conv_id % 4 = 0 THEN trim(coalesce((SELECT answer FROM qa q2 WHERE q2.conv_id = g.conv_id), ''), E' \\n\\t\\r') WHEN conv_id % 4 = 1 THEN 'B' WHEN conv_id % 4 = 3 THEN 'C, A' END AS parsed FROM g)"""


def graded_input(t: Tables) -> DataFrame:
    c, a = F.col("conv_id"), F.coalesce("answer", F.lit(""))
    message = (
        F.when(c % 4 == 0, F.concat(F.lit("say <ANSWER> "), a, F.lit(" </answer> <answer>z</answer>"))).when(c % 4 == 1, " b ")
        .when(c % 4 == 2, a).otherwise("<answer>C, A</answer>"))
    truth = F.when(c % 4 == 0, X.py_strip(a)).when(c % 8 == 1, "B").when(c % 4 == 1, "D").otherwise("A,C")
    return B.first_turns(t).select("conv_id", truth.alias("truth"), X.parse_answer(message).alias("parsed"))


@query("v12_parse_answer", f"WITH {GRADE_SQL} SELECT conv_id, parsed FROM pg")
def v12(t: Tables) -> DataFrame:
    return graded_input(t).select("conv_id", "parsed")


@query("v13_grade_single", f"WITH {GRADE_SQL} SELECT conv_id, coalesce(parsed = truth, false) AS is_correct FROM pg")
def v13(t: Tables) -> DataFrame:
    return graded_input(t).select("conv_id", X.is_correct("parsed", "truth").alias("is_correct"))


@query("v13_grade_multi", f"""WITH {GRADE_SQL} SELECT conv_id, list_sort(list_transform(string_split(parsed, ','), lambda x: trim(x, E' \\n\\t\\r'))) =
CASE WHEN truth = '' THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_transform(string_split(truth, ','), lambda x: trim(x, E' \\n\\t\\r'))) END AS is_correct FROM pg WHERE parsed IS NOT NULL""")
def v13_multi(t: Tables) -> DataFrame:
    rows = graded_input(t).where("parsed is not null")
    return rows.select("conv_id", X.is_correct("parsed", "truth", "multi").alias("is_correct"))


@query("v14_salvage_json", """SELECT event_id, props AS last_object, '{"a": [' || props || ']}' AS outer_object FROM events""")
def v14(t: Tables) -> DataFrame:
    p = F.col("props")
    noisy = F.concat(F.lit('log {bad} [1, 2] {"first": {"n": 1}} tail '), p, F.lit(" } end"))
    wrapped = F.concat(F.lit("info: "), F.lit('{"a": ['), p, F.lit("]} done"))
    return t.heavy_events.select("event_id", X.salvage_json(noisy, "last").alias("last_object"), X.salvage_json(wrapped, "outer").alias("outer_object"))


@query("g14_validation_report", f"""WITH {VAL_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE tr <> '') AS validated,
round_even(avg(quality_score) FILTER (WHERE tr <> ''), 3) AS avg_quality_score, round_even(count(*) FILTER (WHERE tr <> '' AND quality_score >= 0.7) / count(*) FILTER (WHERE tr <> ''), 3) AS pass_rate FROM v""")
def g14(t: Tables) -> DataFrame:
    return V.validation_report(V.validate(B.trajectories(t)))


@query("g15_issue_summary", f"""WITH {ISSUES_SQL} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM iss) GROUP BY 1 ORDER BY n DESC, issue LIMIT 10""")
def g15(t: Tables) -> DataFrame:
    return V.issue_summary(V.validate(B.trajectories(t)))
