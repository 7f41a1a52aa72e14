import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolytics.operators import geometry as G
from annolytics.operators import metrics as M
from annolytics.operators import paths as W
from annolytics.operators import stats as S
from annolytics.operators import windows as N


def test_matrix_family(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 2), (9, 1)]
    m = M.confusion_matrix(spark.createDataFrame(pairs, "gt int, pred int"), [0, 1, 2, 3])
    assert m.count() == 16 and m.agg(F.sum("n")).first()[0] == 6  # the pair outside the list is ignored
    wide = {r.gt: r for r in M.confusion_wide(m, [0, 1, 2, 3]).collect()}
    assert wide[2]["0"] == 1 and wide[3]["3"] == 0
    per = {r.label: r for r in M.class_metrics(m).collect()}
    assert (per[1].sensitivity, per[1].precision, per[1].support) == (1.0, pytest.approx(2 / 3), 2)
    assert (per[3].sensitivity, per[3].precision, per[3].f1, per[3].specificity) == (0.0, 0.0, 0.0, 1.0)
    o = np.zeros((3, 3))
    for g, p in pairs[:-1]:
        o[g, p] += 1
    w = (np.arange(3)[:, None] - np.arange(3)) ** 2
    expected = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert M.quadratic_kappa(m).first()[0] == pytest.approx(1 - (w * o).sum() / (w * expected).sum())
    assert M.balanced_accuracy(M.class_metrics(m)).first()[0] == pytest.approx((0.5 + 1 + 0.5) / 3)


def test_auc_with_ties_and_hot_score(spark):
    rng = np.random.default_rng(1)
    score = np.where(rng.random(600) < 0.4, 0.5, rng.integers(0, 50, 600) / 10)  # one score holds a third of the rows
    label = rng.random(600) < 0.3 + 0.05 * score
    df = spark.createDataFrame([(float(s), bool(y)) for s, y in zip(score, label)], "s double, y boolean")
    pos, neg = score[label], score[~label]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    a = M.auc(df, "s", F.col("y")).first()
    assert a.auc == pytest.approx(want) and (a.n_pos, a.n_neg) == (len(pos), len(neg))
    flipped = M.auc(df.withColumn("s", -F.col("s")), "s", F.col("y")).first().auc
    assert a.auc + flipped == pytest.approx(1)


def test_mask_agreement_edge_cases(spark):
    df = spark.createDataFrame([("e", 0, 0), ("e", 0, 0), ("m", 1, 1), ("m", 1, 0), ("m", 0, 1), ("m", 0, 0)], "image string, actual int, predicted int")
    got = {r.image: r for r in M.mask_agreement(df, ["image"]).collect()}
    assert (got["e"].dice, got["e"].acc, got["e"].iou, got["e"].mse) == (1.0, 0.0, 0.0, 0.0)  # one undefined ratio zeroes the family
    assert (got["m"].dice, got["m"].positive_agreement, got["m"].g_mean) == (0.5, 0.25, 0.5)


def test_ks_binned_overwrites_inner_bins(spark):
    h = {0: 5, 1: 100, 2: 1, 255: 1, 256: 100, 257: 2}
    d = {0: 1, 1: 7, 2: 4, 255: 4, 256: 9, 257: 3}
    rows = [("x", b, h.get(b, 0), d.get(b, 0)) for b in range(258)]
    df = spark.createDataFrame(rows, "g string, bin int, healthy long, diseased long")
    a, b = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    for v in (a, b):
        v[1], v[-2] = v[0], v[-1]
    a, b = a[1:-1], b[1:-1]
    want = np.abs((a / a.sum()).cumsum() - (b / b.sum()).cumsum()).max()
    assert S.ks_binned(df, ["g"]).first().ks == pytest.approx(want)


def test_ks_exact(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 300), rng.normal(0.5, 1, 200)
    df = spark.createDataFrame([("g", float(x), True) for x in a] + [("g", float(x), False) for x in b], "g string, v double, a boolean")
    grid = np.concatenate([a, b])
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    assert S.ks_exact(df, "v", F.col("a"), ["g"]).first().ks == pytest.approx(want)


def test_correlation_p(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    y = [2.0, 1.0, 4.0, 3.0, 7.0, 5.0]
    df = spark.createDataFrame([*zip(x, y), (float("nan"), 1.0), (None, 2.0)], "x double, y double")
    r = S.correlation(df, "x", "y").first()
    want = np.corrcoef(x, y)[0, 1]
    assert r.n == 6 and r.r == pytest.approx(want)
    # two-sided p by integrating Student's t density with 4 degrees of freedom
    t = want * math.sqrt(4 / (1 - want**2))
    grid = np.linspace(t, 2000, 4_000_001)
    dens = math.gamma(2.5) / (math.sqrt(4 * math.pi) * math.gamma(2)) * (1 + grid**2 / 4) ** -2.5
    assert r.p == pytest.approx(2 * np.trapezoid(dens, grid), rel=1e-4)


def test_summary_and_histogram(spark):
    v = S.valid_summary(spark.createDataFrame([(-1.0,), (2.0,), (4.0,), (9.0,), (5.0,)], "v double"), "v").first()
    assert (v.n, v.mean, v.median) == (4, 5.0, 4.5)
    one = S.valid_summary(spark.createDataFrame([(-1.0,), (2.0,)], "v double"), "v").first()
    assert one.n == 1 and one["std"] is None
    h = S.histogram(spark.createDataFrame([("a", -5.0), ("a", 300.0), ("a", 0.5)], "g string, v double"), "v", ["g"])
    assert h.count() == 258 and {r.bin: r.n for r in h.where("n > 0").collect()} == {0: 1, 257: 1, 1: 1}
    text = S.class_distribution(spark.createDataFrame([(1,), (1,), (0,), (1,)], "y int"), "y").where("label = 1").first().text
    assert text == "3 (75.00%)"


def path_reference(x, y):
    """Row-at-a-time statement of the path measures."""
    n = len(x)
    d = lambda i, j: math.hypot(x[j] - x[i], y[j] - y[i])
    length = sum(d(i, i + 1) for i in range(n - 1))
    turns = [i - 1 for i in range(2, n) if np.sign(y[i] - y[i - 1]) != np.sign(y[i - 1] - y[i - 2])]
    at, total = 0, 0.0
    for p in turns:
        chord = d(at, p - 1)
        if chord:
            total += sum(d(i, i + 1) for i in range(at, p - 1)) / chord - 1
        at = p
    k = len(turns)
    density = (k - 1) / k + total / length if k else 0.0
    curv = []
    for i in range(1, n - 1):
        x1, y1 = (x[i + 1] - x[i - 1]) / 2, (y[i + 1] - y[i - 1]) / 2
        x2, y2 = (x[i + 1] - 2 * x[i] + x[i - 1]) / 4, (y[i + 1] - 2 * y[i] + y[i - 1]) / 4
        curv.append((x1 * y2 - x2 * y1) / (x1 * x1 + y1 * y1) ** 1.5)
    return length, d(0, n - 1), k, density, abs(np.trapezoid(curv))


@pytest.mark.parametrize("block", [5, 64, 8192])
def test_paths_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.random(150)).tolist()
    y = np.cumsum(rng.normal(0, 1, 150)).tolist()
    pts = spark.createDataFrame([("i", "v", i, a, b) for i, (a, b) in enumerate(zip(x, y))], "image string, vessel string, seq long, x double, y double")
    length, chord, k, density, curv = path_reference(x, y)
    p = W.path_lengths(pts, block=block).first()
    assert (p.n, p.length, p.chord) == (150, pytest.approx(length), pytest.approx(chord))
    f = W.inflection_metrics(pts, block=block).first()
    assert f.inflections == k and f.tortuosity_density == pytest.approx(density)
    assert f.inflection_tortuosity == pytest.approx(length / chord * (k + 1))
    assert W.curvature_tortuosity(pts, block=block).first().curvature_tortuosity == pytest.approx(curv)
    s = {r.seq: r.sy for r in W.smooth_path(pts, block=block).collect()}
    assert len(s) == 150 and s[2] == pytest.approx(np.mean(y[:3])) and s[9] == pytest.approx(np.mean(y[6:10]))


def test_short_paths(spark):
    pts = spark.createDataFrame([("i", "v", 0, 0.0, 0.0), ("i", "v", 1, 1.0, 1.0), ("i", "w", 0, 1.0, 1.0)], "image string, vessel string, seq long, x double, y double")
    got = {r.vessel: r for r in W.inflection_metrics(pts).collect()}
    assert got["v"].inflections == 0 and got["v"].tortuosity_density == 0
    assert {r.vessel: r.n for r in W.path_lengths(pts).collect()} == {"v": 2, "w": 1}
    assert W.path_tortuosity(pts, 2).count() == 0 and W.path_tortuosity(pts, 2, inclusive=True).first().vessels == 1


def test_line_fit(spark):
    vertical = [("i", "v", i, 1.0, float(i)) for i in range(10)]  # first try divides by zero, swapped one gives 0/0
    line = [("i", "l", i, float(i), 2.0 * i) for i in range(10)]
    short = [("i", "s", i, float(i), float(i)) for i in range(3)]
    fit = {r.vessel: r.line_fit for r in W.line_fit_tortuosity(spark.createDataFrame(vertical + line + short, "image string, vessel string, seq long, x double, y double")).collect()}
    assert fit["v"] == 1.0 and fit["l"] == pytest.approx(1.0) and fit["s"] is None


def test_ewma_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(10, 3, 5000)
    df = spark.createDataFrame([("g", i, float(a)) for i, a in enumerate(v)], "g string, seq long, v double")
    for span in (1, 2, 5):
        alpha, e, want = 2 / (span + 1), v[0], []
        for a in v:
            e = (1 - alpha) * e + alpha * a
            want.append(e)
        got = [r.ewma for r in N.ewma(df, ["g"], "seq", "v", span).orderBy("seq").collect()]
        assert np.allclose(got, want, rtol=1e-12)


def test_box_dimension(spark):
    rng = np.random.default_rng(5)
    mask = rng.random((20, 37)) < 0.5
    mask[:8, :8] = True  # full boxes do not count
    px = spark.createDataFrame([("i", int(x), int(y)) for y, x in np.argwhere(mask)] * 2, "image string, x int, y int")
    dims = spark.createDataFrame([("i", 37, 20), ("none", 37, 20)], "image string, width int, height int")
    sizes, counts = [16, 8, 4], []
    for k in sizes:
        n = 0
        for by in range(0, 20, k):
            for bx in range(0, 37, k):
                s = mask[by:by + k, bx:bx + k].sum()
                n += 0 < s < k * k
        counts.append(n)
    want = -np.polyfit(np.log(sizes), np.log(counts), 1)[0]
    got = {r.image: r.fractal_dimension for r in G.box_dimension(px, dims).collect()}
    assert got["i"] == pytest.approx(want) and got["none"] is None


def test_calibre_and_ratio(spark):
    rows = [("i", "B", "artery", v, float(w)) for v, w in enumerate([3, 9, 5, 7, 4, 8, 6])] + [("i", "B", "vein", v, 5.0) for v in range(5)]
    df = spark.createDataFrame(rows, "image string, zone string, vtype string, vessel_id int, width double")
    f = lambda a, b: 0.88 * math.hypot(a, b)
    w = sorted([9, 5, 7, 4, 8, 6])
    r1 = sorted([f(w[0], w[5]), f(w[1], w[4]), f(w[2], w[3])])
    r2 = sorted([f(r1[0], r1[2]), r1[1]])
    got = {r.vtype: r.calibre for r in G.vessel_calibre(df).collect()}
    assert got["artery"] == pytest.approx(f(*r2)) and got["vein"] == -1.0
    both = spark.createDataFrame([(-1.0, -1.0), (-1.0, 2.0), (3.0, 2.0)], "a double, v double")
    assert [r.AVR for r in G.avr(both, "a", "v", guard=False).collect()] == [1.0, -0.5, 1.5]
    assert [r.AVR for r in G.avr(both, "a", "v").collect()] == [1.0, -1.0, 1.5]


def test_disc_and_zones(spark):
    disc = [("i", "disc", x, y) for x in range(10, 20) for y in range(12, 24)] + [("i", "cup", x, y) for x in range(12, 15) for y in range(14, 18)] + [("j", "cup", 1, 1)]
    px = spark.createDataFrame(disc, "image string, kind string, x int, y int")
    m = {r.image: r for r in G.disc_metrics(px).collect()}
    assert (m["i"].disc_height, m["i"].disc_width, m["i"].cup_centre_x, m["j"].disc_height, m["j"].CDR_vertical) == (11, 9, 13, -1, -1.0)
    assert m["i"].CDR_vertical == pytest.approx(3 / 11)
    vessels = spark.createDataFrame([("i", 1, 1), ("i", 2, 1), ("i", 30, 1)], "image string, x int, y int")
    dims = spark.createDataFrame([("i", 100, 100), ("j", 100, 100)], "image string, width int, height int")
    f = {r.image: r for r in G.disc_flags(G.disc_metrics(px), vessels, dims).collect()}
    assert (f["i"].plausible, f["i"].macular_centred, f["i"].laterality) == (True, True, "Right")
    z = N.assign_zones(spark.createDataFrame([("i", 20, 0), ("i", 21, 0), ("i", 30, 0), ("i", 50, 0)], "image string, x int, y int"),
                       spark.createDataFrame([("i", 0.0, 0.0, 10.0)], "image string, disc_x double, disc_y double, disc_r double"))
    assert {(r.x, r.zone) for r in z.collect()} == {(20, "whole"), (21, "whole"), (30, "whole"), (50, "whole"), (21, "B"), (30, "B"), (21, "C"), (30, "C"), (50, "C")}


def test_sectors(spark):
    centre = spark.createDataFrame([("i", 0.0, 0.0, 250.0, 0.0)], "image string, fovea_x double, fovea_y double, disc_x double, disc_y double")
    pts = spark.createDataFrame([("i", "ex", 10.0, 0.0), ("i", "ex", 90.0, 0.0), ("i", "ex", 0.0, 90.0), ("i", "ex", -150.0, 0.0), ("i", "ex", 0.0, -150.0), ("i", "ex", 201.0, 0.0)],
                                "image string, lesion string, x double, y double")
    got = {(r.ring, r.quadrant): r.n for r in N.sector_counts(pts, centre).collect()}
    assert got == {("central", "all"): 1, ("inner", "nasal"): 1, ("inner", "inferior"): 1, ("outer", "temporal"): 1, ("outer", "superior"): 1}


def test_top_n_keeps_baseline(spark, rows):
    df = spark.createDataFrame([("g", m, s) for m, s in (("a", 3.0), ("b", 2.0), ("c", 1.0), ("identity", 0.0))], "g string, m string, s double")
    assert rows(N.top_n(df, ["g"], "m", "s", 2, "identity").select("m", "rank")) == [("a", 1), ("b", 2), ("identity", None)]
    assert rows(N.arg_max_rows(df.withColumn("s", F.lit(1.0)), ["g"], "s", ["m"]).select("m")) == [("a",)]


def test_fingerprints(spark):
    df = spark.createDataFrame([("t", {"b": "1", "a": "2"}, 1), ("t", {"a": "2", "b": "1"}, 2), ("u", {"a": "2"}, 3)], "tool_name string, args map<string,string>, n int")
    keyed = df.withColumn("fp", N.call_fingerprint("tool_name", F.col("args")))
    last = N.dedup_calls(keyed, "fp", ["n"])
    assert sorted(r.n for r in last.collect()) == [2, 3]
    assert [r.n for r in N.evict(last, "t").collect()] == [3]
