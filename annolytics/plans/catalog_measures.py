"""Queries: metrics, grouped statistics, geometry, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import components as U
from ..operators import geometry as G
from ..operators import joins
from ..operators import metrics as M
from ..operators import paths as W
from ..operators import stats as S
from ..operators import windows as N
from . import catalog as B
from . import catalog_examples as X
from .catalog import FEATS_SQL, PROBS_SQL, PTS_SQL, PX_SQL, Tables, query, r6

# ---------------------------------------------------------------- evaluation metrics


@query("g1_accuracy", f"WITH {X.GRADE_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE parsed = truth) AS correct, round(count(*) FILTER (WHERE parsed = truth) * 100 / count(*), 6) AS percent FROM pg")
def g1(t: Tables) -> DataFrame:
    from ..functions.text import is_correct

    rows = X.graded_input(t).select(is_correct("parsed", "truth").alias("is_correct"))
    return M.accuracy(rows).withColumn("percent", r6("percent"))


CM_SQL = """pr AS (SELECT user_id % 5 AS gt, (user_id + CAST(floor(value) AS BIGINT) % 2) % 5 AS pred FROM events),
lab(v) AS (VALUES (0), (1), (2), (3)), cm AS (SELECT g.v AS gt, p.v AS pred, count(pr.gt) AS n FROM lab g CROSS JOIN lab p LEFT JOIN pr ON pr.gt = g.v AND pr.pred = p.v GROUP BY ALL),
tot AS (SELECT sum(n) AS t FROM cm),
pc0 AS (SELECT l.v AS label, sum(n) FILTER (WHERE gt = l.v AND pred = l.v) AS tp, sum(n) FILTER (WHERE gt = l.v AND pred <> l.v) AS fn, sum(n) FILTER (WHERE gt <> l.v AND pred = l.v) AS fp FROM lab l, cm GROUP BY 1),
pc1 AS (SELECT label, tp + fn AS support, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce((t - tp - fn - fp) / nullif(t - tp - fn, 0), 0) AS specificity, coalesce(tp / nullif(tp + fp, 0), 0) AS precision FROM pc0, tot),
pc AS (SELECT *, coalesce(2 * precision * sensitivity / nullif(precision + sensitivity, 0), 0) AS f1 FROM pc1)"""


def matrix(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 5).alias("gt"), ((F.col("user_id") + F.floor("value") % 2) % 5).alias("pred"))
    return M.confusion_matrix(rows, [0, 1, 2, 3])


@query("g2_confusion_matrix", f"WITH {CM_SQL} SELECT gt, pred, n FROM cm")
def g2(t: Tables) -> DataFrame:
    return matrix(t)


@query("g3_class_metrics", f"""WITH {CM_SQL} SELECT label, CAST(support AS BIGINT) AS support, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM pc""")
def g3(t: Tables) -> DataFrame:
    return M.class_metrics(matrix(t)).withColumns({c: r6(c) for c in ("sensitivity", "specificity", "precision", "f1")})


@query("g4_averaged_f1", f"""WITH {CM_SQL} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(precision), 6) AS macro_precision,
round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(avg(sensitivity), 6) AS macro_recall, round(sum(sensitivity * support) / sum(support), 6) AS weighted_recall FROM pc""")
def g4(t: Tables) -> DataFrame:
    out = M.averaged_f1(M.class_metrics(matrix(t)))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("g5_quadratic_kappa", f"""WITH {CM_SQL}, r AS (SELECT gt, sum(n) AS a FROM cm GROUP BY 1), c AS (SELECT pred, sum(n) AS b FROM cm GROUP BY 1)
SELECT round(1 - (SELECT sum((gt - pred) ** 2 * n) FROM cm) / (SELECT sum((gt - pred) ** 2 * a * b) / max(t) FROM r, c, tot), 6) AS kappa""")
def g5(t: Tables) -> DataFrame:
    return M.quadratic_kappa(matrix(t)).withColumn("kappa", r6("kappa"))


@query("g6_balanced_accuracy", f"WITH {CM_SQL} SELECT round(avg(sensitivity) FILTER (WHERE support > 0), 6) AS balanced_accuracy FROM pc")
def g6(t: Tables) -> DataFrame:
    return M.balanced_accuracy(M.class_metrics(matrix(t))).withColumn("balanced_accuracy", r6("balanced_accuracy"))


@query("g7_auc", """WITH s AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)),
k AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM s), c AS (SELECT sum(y) AS p, count(*) - sum(y) AS q FROM s)
SELECT round(((SELECT sum(r) FROM k WHERE y = 1) - p * (p + 1) / 2.0) / (p * q), 6) AS auc, CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg FROM c""")
def g7(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    return M.auc(j, "n_chars", F.col("quality") == 1).withColumn("auc", r6("auc"))


OVO_SQL = f"""WITH {PROBS_SQL}, s AS (SELECT label % 3 AS c, p FROM probs), d AS (SELECT a.i AS a, b.i AS b, s.c, p[a.i + 1] AS x FROM s, range(3) a(i), range(3) b(i) WHERE a.i <> b.i AND s.c IN (a.i, b.i)),
k AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS r FROM d),
u AS (SELECT a, b, count(*) FILTER (WHERE c = a) AS p, count(*) FILTER (WHERE c = b) AS q, sum(r) FILTER (WHERE c = a) AS sr FROM k GROUP BY a, b),
pairs AS (SELECT least(a, b) AS i, greatest(a, b) AS j, avg((sr - p * (p + 1) / 2.0) / (p * q)) AS auc, max(p + q) AS n FROM u GROUP BY 1, 2)"""


@query("g8_auc_ovo_macro", OVO_SQL + " SELECT round(avg(auc), 6) AS auc FROM pairs")
def g8(t: Tables) -> DataFrame:
    p = B.probabilities(t).select("probs", (F.col("label") % 3).alias("label"))
    return M.auc_ovo(p, "probs", "label", 3).withColumn("auc", r6("auc"))


@query("g8_auc_ovo_weighted", OVO_SQL + " SELECT round(sum(auc * n) / sum(n), 6) AS auc FROM pairs")
def g8w(t: Tables) -> DataFrame:
    p = B.probabilities(t).select("probs", (F.col("label") % 3).alias("label"))
    return M.auc_ovo(p, "probs", "label", 3, "weighted").withColumn("auc", r6("auc"))


@query("g9_mask_agreement", """WITH m AS (SELECT l_suppkey AS image, l_partkey % 64 AS x, l_orderkey % 64 AS y, max((l_returnflag = 'A')::INT) AS a, max((l_linestatus = 'O')::INT) AS p FROM lineitem GROUP BY ALL),
c AS (SELECT image, count(*) AS n, count(*) FILTER (WHERE a = 1 AND p = 1) AS tp, count(*) FILTER (WHERE a = 1 AND p = 0) AS fn, count(*) FILTER (WHERE a = 0 AND p = 1) AS fp, count(*) FILTER (WHERE a = 0 AND p = 0) AS tn FROM m GROUP BY 1)
SELECT image, round(CASE WHEN 2 * tp + fn + fp = 0 THEN 1 ELSE 2 * tp / (2 * tp + fn + fp) END, 6) AS dice, round(tp / n, 6) AS positive_agreement, round((tp + tn) / n, 6) AS acc,
round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS precision, round(sqrt(tp / (tp + fn) * (tn / (tn + fp))), 6) AS g_mean,
round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round((fn + fp) / n, 6) AS mse, round(tp / (tp + fn + fp), 6) AS iou FROM c""")
def g9(t: Tables) -> DataFrame:
    px = t.lineitem.groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y")).agg(
        F.max((F.col("l_returnflag") == "A").cast("int")).alias("actual"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("predicted"))
    out = M.mask_agreement(px, ["image"])
    return out.select("image", *[r6(c).alias(c) for c in out.columns if c != "image"])


# ---------------------------------------------------------------- grouped statistics

@query("g16_batch_status", """WITH e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'running' END AS s, ts, event_id FROM events),
l AS (SELECT user_id, s FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), k(status) AS (VALUES ('completed'), ('failed'), ('skipped'), ('pending'))
SELECT coalesce(k.status, c.s) AS status, coalesce(n, 0) AS n FROM k FULL JOIN (SELECT s, count(*) AS n FROM l GROUP BY 1) c ON k.status = c.s""")
def g16(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(
        F.col("event_type") == "view", "skipped").otherwise("running")
    return S.batch_status(t.events.select(F.col("user_id").alias("dataset"), kind.alias("status"), "ts", "event_id"), order=["ts", "event_id"])


METHOD_SQL = """ml AS (SELECT l_returnflag || l_linestatus AS method, CAST(month(l_shipdate) AS INTEGER) AS lesion, l_quantity AS red, l_discount AS green, l_tax AS blue FROM lineitem)"""


def methods(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("method"), F.month("l_shipdate").alias("lesion"),
        F.col("l_quantity").alias("red"), F.col("l_discount").alias("green"), F.col("l_tax").alias("blue"))


@query("g17_delta_vs_baseline", f"""WITH {METHOD_SQL}, m AS (SELECT method, avg(red) AS red, avg(green) AS green, avg(blue) AS blue FROM ml GROUP BY 1), b AS (SELECT * FROM m WHERE method = 'NO')
SELECT m.method, round(m.red, 6) AS red, round(m.green, 6) AS green, round(m.blue, 6) AS blue, round(m.red - b.red, 6) AS red_delta, round(m.green - b.green, 6) AS green_delta, round(m.blue - b.blue, 6) AS blue_delta FROM m, b""")
def g17(t: Tables) -> DataFrame:
    out = S.delta_vs_baseline(methods(t), ["red", "green", "blue"], "NO")
    return out.select("method", *[r6(c).alias(c) for c in out.columns if c != "method"])


@query("g18_class_distribution", """SELECT lang AS split, quality AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def g18(t: Tables) -> DataFrame:
    j = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "lang"), "doc_id")
    return S.class_distribution(j, "quality", "lang").select("split", "label", "n", r6("share").alias("share"))


@query("g18_positive_shares", """SELECT 'quality' AS category, CAST(sum(quality) AS BIGINT) AS positives, count(*) AS total, round(avg(quality), 6) AS share FROM labels
UNION ALL SELECT 'toxic', CAST(sum(toxic) AS BIGINT), count(*), round(avg(toxic), 6) FROM labels""")
def g18p(t: Tables) -> DataFrame:
    return S.positive_shares(t.labels, ["quality", "toxic"]).withColumn("share", r6("share"))


HIST_SQL = """h0 AS (SELECT l_suppkey AS img, l_returnflag AS lesion, CAST(least(greatest(floor(l_quantity + 1), 0), 257) AS INTEGER) AS bin, l_linestatus FROM lineitem),
g AS (SELECT DISTINCT img, lesion FROM h0), h AS (SELECT g.img, g.lesion, CAST(b.i AS INTEGER) AS bin, count(h0.img) FILTER (WHERE l_linestatus = 'O') AS healthy, count(h0.img) FILTER (WHERE l_linestatus = 'F') AS diseased
FROM g CROSS JOIN range(258) b(i) LEFT JOIN h0 ON h0.img = g.img AND h0.lesion = g.lesion AND h0.bin = b.i GROUP BY ALL)"""


def hist(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("img"), F.col("l_returnflag").alias("lesion"), "l_quantity", "l_linestatus")
    return S.histogram_pair(rows, "l_quantity", F.col("l_linestatus") == "O", ["img", "lesion"])


@query("g19_histogram", """SELECT l_returnflag, CAST(b.i AS INTEGER) AS bin, count(l.q) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) g CROSS JOIN range(258) b(i)
LEFT JOIN (SELECT l_returnflag AS f, least(greatest(floor(l_quantity + 1), 0), 257) AS q FROM lineitem) l ON l.f = g.l_returnflag AND l.q = b.i GROUP BY ALL""")
def g19(t: Tables) -> DataFrame:
    return S.histogram(t.lineitem, "l_quantity", ["l_returnflag"])


@query("g20_ks_binned", f"""WITH {HIST_SQL}, k AS (SELECT lesion, CASE bin WHEN 0 THEN 1 WHEN 257 THEN 256 ELSE bin END AS bin, healthy AS a, diseased AS b FROM (SELECT lesion, bin, sum(healthy) AS healthy, sum(diseased) AS diseased FROM h GROUP BY ALL) WHERE bin NOT IN (1, 256)),
c AS (SELECT lesion, sum(a) OVER w / sum(a) OVER (PARTITION BY lesion) - sum(b) OVER w / sum(b) OVER (PARTITION BY lesion) AS d FROM k WINDOW w AS (PARTITION BY lesion ORDER BY bin))
SELECT lesion, round(max(abs(d)), 6) AS ks FROM c GROUP BY 1""")
def g20a(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("lesion"), "l_quantity", "l_linestatus")
    h = S.histogram_pair(rows, "l_quantity", F.col("l_linestatus") == "O", ["lesion"])
    return S.ks_binned(h, ["lesion"]).withColumn("ks", r6("ks"))


@query("g20_ks_exact", """WITH k AS (SELECT l_returnflag, l_extendedprice AS x, count(*) FILTER (WHERE l_linestatus = 'O') AS a, count(*) FILTER (WHERE l_linestatus <> 'O') AS b FROM lineitem GROUP BY ALL),
c AS (SELECT l_returnflag, sum(a) OVER w / sum(a) OVER (PARTITION BY l_returnflag) - sum(b) OVER w / sum(b) OVER (PARTITION BY l_returnflag) AS d FROM k WINDOW w AS (PARTITION BY l_returnflag ORDER BY x))
SELECT l_returnflag, round(max(abs(d)), 6) AS ks FROM c GROUP BY 1""")
def g20b(t: Tables) -> DataFrame:
    return S.ks_exact(t.lineitem, "l_extendedprice", F.col("l_linestatus") == "O", ["l_returnflag"]).withColumn("ks", r6("ks"))


@query("g21_consistency", f"WITH {HIST_SQL} SELECT lesion, round(stddev_pop(healthy), 6) AS healthy_std, round(stddev_pop(diseased), 6) AS diseased_std FROM h GROUP BY 1")
def g21(t: Tables) -> DataFrame:
    return S.consistency(hist(t), ["lesion"]).withColumns({c: r6(c) for c in ("healthy_std", "diseased_std")})


@query("g22_mean_histogram", f"WITH {HIST_SQL} SELECT lesion, bin, round(avg(diseased), 6) AS mean_n FROM h GROUP BY ALL")
def g22(t: Tables) -> DataFrame:
    return S.mean_histogram(hist(t), ["lesion"], "diseased").withColumn("mean_n", r6("mean_n"))


@query("g23_method_separability", f"WITH {METHOD_SQL} SELECT method, round(greatest(min(red), min(green), min(blue)), 6) AS separability FROM ml WHERE lesion IN (1, 2, 3, 6) GROUP BY 1")
def g23(t: Tables) -> DataFrame:
    return S.method_separability(methods(t), [1, 2, 3, 6], method="method", lesion="lesion").withColumn("separability", r6("separability"))


@query("g24_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def g24(t: Tables) -> DataFrame:
    return S.correlation(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", r6("r").alias("r"), "n")


@query("g25_class_weights", "SELECT toxic AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY 1")
def g25(t: Tables) -> DataFrame:
    return S.class_weights(t.labels, "toxic").withColumn("weight", r6("weight"))


@query("g34_melt_channels", f"WITH {METHOD_SQL}, m AS (SELECT method, round(avg(red), 6) AS red, round(avg(green), 6) AS green, round(avg(blue), 6) AS blue FROM ml GROUP BY 1) UNPIVOT m ON red, green, blue INTO NAME channel VALUE score")
def g34(t: Tables) -> DataFrame:
    means = S.method_means(methods(t), ["red", "green", "blue"])
    return S.melt_channels(means, ["method"]).withColumn("score", r6("score"))


@query("g35_valid_summary", "WITH v AS (SELECT c_acctbal AS x FROM customer WHERE c_acctbal >= 0) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std FROM v")
def g35(t: Tables) -> DataFrame:
    rows = t.customer.select(F.when(F.col("c_acctbal") < 0, -1.0).otherwise(F.col("c_acctbal")).alias("v"))
    out = S.valid_summary(rows, "v")
    return out.select("n", *[r6(c).alias(c) for c in ("mean", "median", "std")])


@query("g35_listing", "SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN 'N/A' ELSE printf('%.2f', c_acctbal) END AS value FROM customer")
def g35_listing(t: Tables) -> DataFrame:
    rows = t.customer.select("c_name", F.when(F.col("c_acctbal") < 0, -1.0).otherwise(F.col("c_acctbal")).alias("v"))
    return S.listing(rows, "c_name", "v", digits=2)


# ---------------------------------------------------------------- geometry

@query("g26_area_metrics", f"""WITH {PX_SQL}, m AS (SELECT image, x, y, max((lesion <> 'N')::INT) AS vessel, max((lesion = 'A')::INT) AS sk FROM px GROUP BY ALL),
c AS (SELECT image, sum(vessel) AS p, sum(sk) AS s FROM m GROUP BY 1)
SELECT s_suppkey AS image, CAST(coalesce(p, 0) AS BIGINT) AS positives, round(coalesce(p, 0) / 4096, 6) AS density, round(p / s, 6) AS mean_width FROM supplier LEFT JOIN c ON image = s_suppkey""")
def g26(t: Tables) -> DataFrame:
    px = B.pixels(t).groupBy("image", "x", "y").agg(
        F.max((F.col("lesion") != "N").cast("int")).alias("vessel"), F.max((F.col("lesion") == "A").cast("int")).alias("skeleton"))
    out = G.area_metrics(px, B.pixel_dims(t), skeleton="skeleton")
    return out.select("image", "positives", r6("density").alias("density"), r6("mean_width").alias("mean_width"))


@query("g27_box_dimension", f"""WITH {PX_SQL}, d AS (SELECT DISTINCT image, x, y FROM px), sz(s) AS (VALUES (4), (8), (16), (32), (64)),
b AS (SELECT image, s, x // s AS bx, y // s AS by_, count(*) AS n FROM d, sz GROUP BY ALL), k AS (SELECT image, s, count(*) FILTER (WHERE n < s * s) AS boxes FROM b GROUP BY ALL)
SELECT s_suppkey AS image, round(CASE WHEN count(*) FILTER (WHERE boxes > 0) = 5 THEN -regr_slope(ln(boxes), ln(s)) END, 6) AS fractal_dimension FROM supplier LEFT JOIN k ON image = s_suppkey GROUP BY 1""")
def g27(t: Tables) -> DataFrame:
    return G.box_dimension(B.pixels(t), B.pixel_dims(t)).withColumn("fractal_dimension", r6("fractal_dimension"))


DISC_SQL = PX_SQL + """, dm AS (SELECT image, min(x) FILTER (WHERE k = 'disc') AS dx0, max(x) FILTER (WHERE k = 'disc') AS dx1, min(y) FILTER (WHERE k = 'disc') AS dy0, max(y) FILTER (WHERE k = 'disc') AS dy1,
min(x) FILTER (WHERE k = 'cup') AS cx0, max(x) FILTER (WHERE k = 'cup') AS cx1, min(y) FILTER (WHERE k = 'cup') AS cy0, max(y) FILTER (WHERE k = 'cup') AS cy1,
avg(x) FILTER (WHERE k = 'disc') AS mx, avg(y) FILTER (WHERE k = 'disc') AS my, avg(x) FILTER (WHERE k = 'cup') AS ux, avg(y) FILTER (WHERE k = 'cup') AS uy
FROM (SELECT *, CASE lesion WHEN 'A' THEN 'disc' WHEN 'R' THEN 'cup' END AS k FROM shape WHERE lesion <> 'N') GROUP BY image)"""
# discs and cups of different extent: the lower bits of the positions are folded per class
SHAPE_SQL = """, shape AS (SELECT DISTINCT image, lesion, CASE lesion WHEN 'A' THEN 24 + x % (12 + image % 9) WHEN 'R' THEN 26 + x % (6 + image % 7) ELSE x END AS x,
CASE lesion WHEN 'A' THEN 22 + y % (11 + image % 12) WHEN 'R' THEN 25 + y % (5 + image % 5) ELSE y END AS y FROM px)"""
DISC_SQL = DISC_SQL.replace(", dm AS", SHAPE_SQL + ", dm AS")


def shapes(t: Tables) -> DataFrame:
    i, x, y = F.col("image"), F.col("x"), F.col("y")
    sx = F.when(F.col("lesion") == "A", x % (i % 9 + 12) + 24).when(F.col("lesion") == "R", x % (i % 7 + 6) + 26).otherwise(x)
    sy = F.when(F.col("lesion") == "A", y % (i % 12 + 11) + 22).when(F.col("lesion") == "R", y % (i % 5 + 5) + 25).otherwise(y)
    kind = F.when(F.col("lesion") == "A", "disc").when(F.col("lesion") == "R", "cup").otherwise("vessel")
    return B.pixels(t).select("image", kind.alias("kind"), sx.alias("x"), sy.alias("y")).distinct()


@query("g28_disc_metrics", f"""WITH {DISC_SQL} SELECT image, coalesce(dy1 - dy0, -1) AS disc_height, coalesce(dx1 - dx0, -1) AS disc_width, coalesce(cy1 - cy0, -1) AS cup_height, coalesce(cx1 - cx0, -1) AS cup_width,
round(CASE WHEN dy1 - dy0 > 0 AND cy1 IS NOT NULL THEN (cy1 - cy0) / (dy1 - dy0) ELSE -1 END, 6) AS CDR_vertical, round(CASE WHEN dx1 - dx0 > 0 AND cx1 IS NOT NULL THEN (cx1 - cx0) / (dx1 - dx0) ELSE -1 END, 6) AS CDR_horizontal,
coalesce(CAST(floor(ux) AS BIGINT), -1) AS cup_centre_x, coalesce(CAST(floor(uy) AS BIGINT), -1) AS cup_centre_y FROM dm""")
def g28(t: Tables) -> DataFrame:
    out = G.disc_metrics(shapes(t).where("kind != 'vessel'"))
    return out.select("image", "disc_height", "disc_width", "cup_height", "cup_width", r6("CDR_vertical").alias("CDR_vertical"),
                      r6("CDR_horizontal").alias("CDR_horizontal"), "cup_centre_x", "cup_centre_y")


@query("g29_disc_flags", f"""WITH {DISC_SQL}, s AS (SELECT v.image, count(*) FILTER (WHERE x < floor(ux)) AS l, count(*) FILTER (WHERE x >= floor(ux)) AS r FROM shape v JOIN dm USING (image) WHERE lesion = 'N' GROUP BY 1),
f AS (SELECT image, coalesce(dx1 - dx0 < 64 / 3 AND dy1 - dy0 < 64 / 3 AND floor(ux) BETWEEN dx0 AND dx1 AND floor(uy) BETWEEN dy0 AND dy1 AND cy1 - cy0 < dy1 - dy0 AND cx1 - cx0 < dx1 - dx0, false) AS plausible,
sqrt((mx - 32) ** 2 + (my - 32) ** 2) / 64 < 0.1 AS near, ux IS NOT NULL AND mx IS NOT NULL AS known, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM dm LEFT JOIN s USING (image))
SELECT image, plausible, CASE WHEN known THEN NOT (plausible AND coalesce(near, false)) END AS macular_centred, CASE WHEN known THEN CASE WHEN l > r THEN 'Right' ELSE 'Left' END END AS laterality FROM f""")
def g29(t: Tables) -> DataFrame:
    s = shapes(t)
    return G.disc_flags(G.disc_metrics(s.where("kind != 'vessel'")), s.where("kind = 'vessel'"), B.pixel_dims(t))


COMP_SQL = "WITH RECURSIVE " + PX_SQL + """, e AS (SELECT a.image, a.lesion, a.y * 4294967296 + a.x AS u, b.y * 4294967296 + b.x AS v FROM px a JOIN px b ON a.image = b.image AND a.lesion = b.lesion AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT image, lesion, u, v FROM e UNION SELECT r.image, r.lesion, r.u, e.v FROM reach r JOIN e ON e.image = r.image AND e.lesion = r.lesion AND e.u = r.v),
lab AS (SELECT image, lesion, u, min(v) AS component FROM reach GROUP BY ALL),
comp AS (SELECT image, lesion, component, count(*) AS area, CAST(min(u % 4294967296) AS BIGINT) AS min_x, CAST(max(u % 4294967296) AS BIGINT) AS max_x, CAST(min(u // 4294967296) AS BIGINT) AS min_y, CAST(max(u // 4294967296) AS BIGINT) AS max_y FROM lab GROUP BY ALL)"""


def components(t: Tables, tile: int = 256) -> DataFrame:
    return U.component_table(U.label_components(B.pixels(t), tile=tile))


@query("u3_label_components", COMP_SQL + " SELECT image, lesion, CAST(component AS BIGINT) AS component, area, min_x, max_x, min_y, max_y FROM comp")
def u3(t: Tables) -> DataFrame:
    return components(t, tile=32)  # four tiles per image, so that borders are crossed


@query("g30_lesion_stats", COMP_SQL + """ SELECT image, lesion, count(*) AS n, round(sum(area) / 4096, 6) AS area_ratio, round(avg(area), 6) AS mean_area,
round(CASE WHEN count(*) > 1 THEN stddev_pop(area) / avg(area) ELSE 0 END, 6) AS dispersion FROM comp GROUP BY ALL""")
def g30(t: Tables) -> DataFrame:
    out = G.lesion_stats(components(t), B.pixel_dims(t))
    return out.select("image", "lesion", "n", *[r6(c).alias(c) for c in ("area_ratio", "mean_area", "dispersion")])


@query("g30_lesion_compactness", COMP_SQL + """ SELECT image, lesion, count(*) AS n, round(avg(area), 6) AS mean_area, round(sum(area) / sum((max_x - min_x + 1) * (max_y - min_y + 1)), 6) AS compactness
FROM comp WHERE area >= 5 GROUP BY ALL""")
def g30c(t: Tables) -> DataFrame:
    out = G.lesion_compactness(components(t))
    return out.select("image", "lesion", "n", r6("mean_area").alias("mean_area"), r6("compactness").alias("compactness"))


CAL_SQL = """w0 AS (SELECT l_suppkey AS image, l_linestatus AS zone, CASE WHEN l_returnflag = 'A' THEN 'artery' ELSE 'vein' END AS vtype, l_partkey AS vessel_id, avg(l_quantity) AS width FROM lineitem GROUP BY ALL),
w1 AS (SELECT image, zone, vtype, list_sort(list(width)) AS w FROM (SELECT * FROM w0 QUALIFY row_number() OVER (PARTITION BY image, zone, vtype ORDER BY width DESC, vessel_id) <= 6) GROUP BY ALL)"""


def calibre_sql(name: str, artery: str, vein: str) -> str:
    pair = f"CASE WHEN vtype = 'artery' THEN {artery} ELSE {vein} END"
    f = lambda a, b: pair.replace("{a}", a).replace("{b}", b)
    return f"""WITH {CAL_SQL}, r1 AS (SELECT *, list_sort([{f('w[1]', 'w[6]')}, {f('w[2]', 'w[5]')}, {f('w[3]', 'w[4]')}]) AS p FROM w1),
r2 AS (SELECT *, list_sort([{f('p[1]', 'p[3]')}, p[2]]) AS s FROM r1) SELECT image, zone, vtype, round(CASE WHEN len(w) < 6 THEN -1 ELSE {f('s[1]', 's[2]')} END, 6) AS calibre FROM r2"""


def calibre(t: Tables, formula: str) -> DataFrame:
    widths = t.lineitem.groupBy(
        F.col("l_suppkey").alias("image"), F.col("l_linestatus").alias("zone"),
        F.when(F.col("l_returnflag") == "A", "artery").otherwise("vein").alias("vtype"), F.col("l_partkey").alias("vessel_id"),
    ).agg(F.avg("l_quantity").alias("width"))
    return G.vessel_calibre(widths, formula).withColumn("calibre", r6("calibre"))


@query("g31_calibre_knudtson", calibre_sql("knudtson", "0.88 * sqrt({a} ** 2 + {b} ** 2)", "0.95 * sqrt({a} ** 2 + {b} ** 2)"))
def g31k(t: Tables) -> DataFrame:
    return calibre(t, "knudtson")


@query("g31_calibre_hubbard", calibre_sql("hubbard", "sqrt(0.87 * {a} ** 2 + 1.01 * {b} ** 2 - 0.22 * {a} * {b} - 10.76)", "sqrt(0.72 * {a} ** 2 + 0.91 * {b} ** 2 + 450.05)"))
def g31h(t: Tables) -> DataFrame:
    return calibre(t, "hubbard")


@query("g32_avr", f"""WITH {X.WIDE_SQL} SELECT Name, round(v_F / v_O, 6) + 0 AS plain, round(CASE WHEN v_F / v_O < 0 THEN -1 ELSE v_F / v_O END, 6) + 0 AS guarded FROM w""")
def g32(t: Tables) -> DataFrame:
    f = G.avr(G.avr(X.all_features(t), "v_F", "v_O", guard=False, name="plain"), "v_F", "v_O", name="guarded")
    return f.select("Name", r6("plain").alias("plain"), r6("guarded").alias("guarded"))


@query("g33_pivot_features", f"""WITH {X.WIDE_SQL} SELECT Name AS filename, v_F AS vessel_density_binary_whole, m_F AS fractal_dimension_binary_whole, v_O AS vessel_density_artery_B,
m_O AS tortuosity_distance_artery_B, v_P AS vessel_density_vein_C, m_P AS tortuosity_density_vein_C FROM w""")
def g33(t: Tables) -> DataFrame:
    from ..operators.examples import features_to_nested, nested_to_long

    return G.pivot_features(nested_to_long(features_to_nested(X.wide_features(t))), "filename")


# ---------------------------------------------------------------- paths

STEP_SQL = PTS_SQL + """, st AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d, y - lag(y) OVER w AS dy, lead(y) OVER w - y AS dn FROM pts WINDOW w AS (PARTITION BY image, vessel ORDER BY seq))"""
LEN_SQL = STEP_SQL + """, pl AS (SELECT image, vessel, count(*) AS n, coalesce(sum(d), 0) AS length, sqrt((arg_max(x, seq) - arg_min(x, seq)) ** 2 + (arg_max(y, seq) - arg_min(y, seq)) ** 2) AS chord FROM st GROUP BY ALL)"""


@query("w4_path_lengths", f"WITH {LEN_SQL} SELECT image, vessel, n, round(length, 5) AS length, round(chord, 6) AS chord, round(length / nullif(chord, 0), 6) AS tortuosity FROM pl")
def w4(t: Tables) -> DataFrame:
    p = W.path_lengths(B.path_points(t))
    return p.select("image", "vessel", "n", r6("length", 5).alias("length"), r6("chord").alias("chord"), r6("tortuosity").alias("tortuosity"))


@query("w4_path_tortuosity", f"WITH {LEN_SQL} SELECT image, count(*) AS vessels, round(avg(length / nullif(chord, 0)), 6) AS tortuosity, round(sum(length), 5) AS length FROM pl WHERE n > 10 GROUP BY 1")
def w4b(t: Tables) -> DataFrame:
    p = W.path_tortuosity(B.path_points(t))
    return p.select("image", "vessels", r6("tortuosity").alias("tortuosity"), r6("length", 5).alias("length"))


@query("w5_inflection_metrics", f"""WITH {LEN_SQL}, fl AS (SELECT *, CASE WHEN dy IS NOT NULL AND dn IS NOT NULL AND sign(dy) <> sign(dn) THEN 1 ELSE 0 END AS turn FROM st),
sg AS (SELECT *, sum(turn) OVER (PARTITION BY image, vessel ORDER BY seq) AS seg FROM fl), ps AS (SELECT image, vessel, seg, coalesce(sum(d) FILTER (WHERE turn = 0), 0) AS curve,
sqrt((arg_max(x, seq) - arg_min(x, seq)) ** 2 + (arg_max(y, seq) - arg_min(y, seq)) ** 2) AS chord FROM sg GROUP BY ALL),
k AS (SELECT image, vessel, max(seg) AS k FROM ps GROUP BY ALL), ex AS (SELECT ps.image, ps.vessel, sum(CASE WHEN seg < k AND chord > 0 THEN curve / chord - 1 ELSE 0 END) AS e FROM ps JOIN k USING (image, vessel) GROUP BY ALL)
SELECT pl.image, pl.vessel, n, CAST(k AS BIGINT) AS inflections, round(length / nullif(chord, 0) * (k + 1), 4) AS inflection_tortuosity, round(CASE WHEN k > 0 THEN (k - 1) / k + e / length ELSE 0 END, 6) AS tortuosity_density
FROM pl JOIN k USING (image, vessel) JOIN ex USING (image, vessel)""")
def w5(t: Tables) -> DataFrame:
    p = W.inflection_metrics(B.path_points(t))
    return p.select("image", "vessel", "n", "inflections", r6("inflection_tortuosity", 4).alias("inflection_tortuosity"), r6("tortuosity_density").alias("tortuosity_density"))


@query("w6_smooth_path", f"WITH {PTS_SQL} SELECT image, vessel, seq, round(avg(x) OVER w, 6) AS sx, round(avg(y) OVER w, 6) AS sy FROM pts WINDOW w AS (PARTITION BY image, vessel ORDER BY seq ROWS 3 PRECEDING)")
def w6(t: Tables) -> DataFrame:
    return W.smooth_path(B.path_points(t)).select("image", "vessel", "seq", r6("sx").alias("sx"), r6("sy").alias("sy"))


@query("w7_curvature_tortuosity", f"""WITH {PTS_SQL}, c AS (SELECT image, vessel, seq, (lead(x) OVER w - lag(x) OVER w) / 2 AS x1, (lead(x) OVER w - 2 * x + lag(x) OVER w) / 4 AS x2, (lead(y) OVER w - lag(y) OVER w) / 2 AS y1, (lead(y) OVER w - 2 * y + lag(y) OVER w) / 4 AS y2
FROM pts WINDOW w AS (PARTITION BY image, vessel ORDER BY seq)), k AS (SELECT image, vessel, seq, (x1 * y2 - x2 * y1) / (y1 ** 2 + x1 ** 2) ** 1.5 AS k FROM c WHERE x1 IS NOT NULL),
z AS (SELECT image, vessel, (k + lead(k) OVER (PARTITION BY image, vessel ORDER BY seq)) / 2 AS a FROM k) SELECT image, vessel, round(abs(coalesce(sum(a), 0)), 6) AS curvature_tortuosity FROM z GROUP BY ALL""")
def w7(t: Tables) -> DataFrame:
    return W.curvature_tortuosity(B.path_points(t)).withColumn("curvature_tortuosity", r6("curvature_tortuosity"))


LF_SQL = PTS_SQL + """, en AS (SELECT image, vessel, count(*) AS n, greatest(round_even(count(*) / 6, 0), 1)::BIGINT AS step, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_max(x, seq) AS zx, arg_max(y, seq) AS zy FROM pts GROUP BY ALL),
sm AS (SELECT p.*, en.* EXCLUDE (image, vessel) FROM pts p JOIN en USING (image, vessel) WHERE seq >= 1 AND seq < n - 1 AND (seq - 1) % step = 0),
mn AS (SELECT image, vessel, avg(x) AS mx, avg(y) AS my FROM sm GROUP BY ALL),
rt AS (SELECT image, vessel, any_value(n) AS n, sum(((x - ax) * ((zy - ay) / nullif(zx - ax, 0)) + ay - my) ** 2) / nullif(sum((y - my) ** 2), 0) AS r1,
sum(((y - ay) * ((zx - ax) / nullif(zy - ay, 0)) + ax - mx) ** 2) / nullif(sum((x - mx) ** 2), 0) AS r2 FROM sm JOIN mn USING (image, vessel) GROUP BY ALL),
lf AS (SELECT image, vessel, CASE WHEN n >= 4 THEN coalesce(r1, r2, 1) END AS fit FROM rt)"""


@query("w8_line_fit", f"WITH {LF_SQL} SELECT image, vessel, round(fit, 6) AS line_fit FROM lf")
def w8(t: Tables) -> DataFrame:
    return W.line_fit_tortuosity(B.path_points(t)).withColumn("line_fit", r6("line_fit"))


@query("w8_line_fit_share", f"WITH {LF_SQL} SELECT image, count(*) AS vessels, round(count(*) FILTER (WHERE fit > 0.8) / count(*), 6) AS share FROM lf WHERE fit IS NOT NULL GROUP BY 1")
def w8b(t: Tables) -> DataFrame:
    return W.share_above(W.line_fit_tortuosity(B.path_points(t))).withColumn("share", r6("share"))


@query("w9_ewma", f"""WITH RECURSIVE {PTS_SQL}, r AS (SELECT image, vessel, seq, y AS e FROM pts WHERE seq = 0 UNION ALL SELECT p.image, p.vessel, p.seq, r.e * (1 - 2 / 6.0::DOUBLE) + p.y * (2 / 6.0::DOUBLE) FROM r JOIN pts p ON p.image = r.image AND p.vessel = r.vessel AND p.seq = r.seq + 1)
SELECT image, vessel, seq, round(e, 6) AS ewma FROM r""")
def w9(t: Tables) -> DataFrame:
    return N.ewma(B.path_points(t), ["image", "vessel"], "seq", "y", 5).select("image", "vessel", "seq", r6("ewma").alias("ewma"))


# ---------------------------------------------------------------- points and centres

CENTER_SQL = """ct AS (SELECT s_suppkey AS image, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS cx, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS cy, CAST(20 + s_suppkey % 60 AS DOUBLE) AS r FROM supplier),
p AS (SELECT l_suppkey AS image, l_returnflag AS lesion, l_partkey % 1000 AS x, l_orderkey % 1000 AS y, l_quantity AS area FROM lineitem)"""


def centers(t: Tables) -> DataFrame:
    s = F.col("s_suppkey")
    return t.supplier.select(
        s.alias("image"), (s * 37 % 1000).cast("double").alias("cx"), (s * 53 % 1000).cast("double").alias("cy"), (s % 60 + 20).cast("double").alias("r"))


def points(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("lesion"), (F.col("l_partkey") % 1000).alias("x"),
        (F.col("l_orderkey") % 1000).alias("y"), F.col("l_quantity").alias("area"))


DIST_SQL = CENTER_SQL + """, d AS (SELECT ct.image, ct.r, min(sqrt((x * 1.5 - cx) ** 2 + (y * 0.5 - cy) ** 2)) AS distance FROM ct LEFT JOIN (SELECT * FROM p WHERE lesion = 'A') p USING (image) GROUP BY ALL)"""


def distances(t: Tables) -> DataFrame:
    return joins.min_distance(points(t).where("lesion = 'A'"), centers(t), x_scale=1.5, y_scale=0.5)


@query("j12_min_distance", f"WITH {DIST_SQL} SELECT image, round(distance, 6) AS distance FROM d")
def j12(t: Tables) -> DataFrame:
    return distances(t).select("image", r6("distance").alias("distance"))


@query("c9_dme_risk", f"WITH {DIST_SQL} SELECT image, CASE WHEN distance IS NULL THEN 0 WHEN distance <= r / 3 THEN 2 WHEN distance <= r THEN 1 ELSE 0 END AS risk_level, round(distance / r, 6) AS distance_dd FROM d")
def c9(t: Tables) -> DataFrame:
    d = distances(t).select("image", K.dme_risk("distance", "r").alias("k")).select("image", "k.*")
    return d.withColumn("distance_dd", r6("distance_dd"))


@query("w12_sector_counts", f"""WITH {CENTER_SQL}, k AS (SELECT p.image, lesion, area, x - cx AS dx, y - cy AS dy, CAST(100 + r AS DOUBLE) AS ox, CAST(40 - r AS DOUBLE) AS oy FROM p JOIN ct USING (image)),
g AS (SELECT *, sqrt(dx ** 2 + dy ** 2) AS d, sqrt(ox ** 2 + oy ** 2) / 2.5 AS dd, atan2(dy, dx) - atan2(oy, ox) + pi() / 4 AS a0 FROM k),
h AS (SELECT *, a0 - 2 * pi() * floor(a0 / (2 * pi())) AS a FROM g)
SELECT image, lesion, CASE WHEN d <= 0.33 * dd THEN 'central' WHEN d <= dd THEN 'inner' ELSE 'outer' END AS ring, CASE WHEN d <= 0.33 * dd THEN 'all' ELSE ['nasal', 'inferior', 'temporal', 'superior'][least(floor(a / (pi() / 2)), 3)::INT + 1] END AS quadrant,
count(*) AS n, round(sum(area), 6) AS area FROM h WHERE d <= 2 * dd GROUP BY ALL""")
def w12(t: Tables) -> DataFrame:
    c = centers(t).select("image", F.col("cx").alias("fovea_x"), F.col("cy").alias("fovea_y"),
                          (F.col("cx") + 100 + F.col("r")).alias("disc_x"), (F.col("cy") + 40 - F.col("r")).alias("disc_y"))
    return N.sector_counts(points(t), c, area="area").withColumn("area", r6("area"))


@query("w13_assign_zones", f"""WITH {CENTER_SQL}, k AS (SELECT p.image, x, y, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d, r FROM p JOIN ct USING (image))
SELECT image, 'whole' AS zone, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT image, 'B', count(*) FROM k WHERE d > 2 * r AND d <= 3 * r GROUP BY 1 UNION ALL SELECT image, 'C', count(*) FROM k WHERE d > 2 * r AND d <= 5 * r GROUP BY 1""")
def w13(t: Tables) -> DataFrame:
    discs = centers(t).select("image", F.col("cx").alias("disc_x"), F.col("cy").alias("disc_y"), F.col("r").alias("disc_r"))
    return N.assign_zones(points(t), discs).groupBy("image", "zone").agg(F.count(F.lit(1)).alias("n"))
