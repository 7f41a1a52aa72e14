import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolytics.operators import components as U
from annolytics.operators import joins as J
from annolytics.operators import ordering as O
from annolytics.operators import splits as D
from annolytics.operators.graph import connected_components


def test_null_keys_match_in_zone_merge(spark):
    b = spark.createDataFrame([("n", None, 1.0), ("o", 2.0, 5.0)], "Name string, k double, w double")
    c = spark.createDataFrame([("n", None, 9.0), ("o", 3.0, 6.0)], "Name string, k double, w double")
    whole = spark.createDataFrame([("n", None, 7.0), ("o", 1.0, 8.0)], "Name string, k double, total double")
    got = {(r.Name, r.k): (r.total, r.w_zone_b, r.w_zone_c) for r in J.merge_zones(whole, b, c, ["Name", "k"]).collect()}
    assert got == {("n", None): (7.0, 1.0, 9.0), ("o", 1.0): (8.0, None, None), ("o", 2.0): (None, 5.0, None), ("o", 3.0): (None, None, 6.0)}
    assert J.merge_zones(whole, b, c, ["Name", "k"]).columns == ["Name", "k", "total", "w_zone_b", "w_zone_c"]


def test_stems_and_lookup(spark):
    df = spark.createDataFrame([("a/b.c.png",), ("x",), (".hidden",)], "f string")
    got = [tuple(r) for r in df.select(J.first_stem("f"), J.last_stem("f"), J.base_name("f")).collect()]
    assert got == [("a/b", "b.c", "b.c.png"), ("x", "x", "x"), ("", ".hidden", ".hidden")]
    table = spark.createDataFrame([("m/b.c.jpg", 2), ("n/b.c.png", 1)], "p string, o int")
    first = J.lookup_by_name(df, table, "f", "p", ["o"], by="stem").collect()
    assert [(r.f, r.match.p if r.match else None, r.found) for r in sorted(first, key=lambda r: r.f)] == [(".hidden", None, False), ("a/b.c.png", "n/b.c.png", True), ("x", None, False)]


def test_one_eyed_patients_keep_an_empty_row(spark):
    df = spark.createDataFrame([("p", "L", 2, 1), ("p", "L", 0, 0), ("p", "R", 1, 2), ("q", "R", 1, 3)], "id string, eye string, drusen int, o int")
    got = {r.id: (r.drusen_L, r.drusen_R) for r in J.pair_eyes(df, "id", "eye", ["drusen"], ["o"]).collect()}
    assert got == {"p": (0, 1), "q": (None, None)}


def test_resolve_order_and_coverage(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    manifest = spark.createDataFrame([("a.PNG",), ("a.png",), ("b",), ("b.jpg",)], "path string")
    assert rows(J.resolve_files(df, manifest, "name")) == [("a", "a.png"), ("b", "b")]
    al = spark.createDataFrame([("x", "real"), ("y", "gone")], "alias string, real string")
    have = spark.createDataFrame([("real",), ("d",)], "name string")
    need = spark.createDataFrame([("d",), ("x",), ("y",), ("z",)], "name string")
    got = J.coverage(need, have, al)
    assert rows(got) == [("d", "available", "d"), ("x", "available", "real"), ("y", "missing", "mapped to gone but not loaded"), ("z", "missing", "no mapping")]
    assert J.coverage_summary(got).first().available_percent == 50.0


def test_missing_resolution_is_an_error_row(spark):
    got = J.lookup_scale(spark.createDataFrame([("a",), ("b",)], "Name string"), spark.createDataFrame([("a", 0.1)], "fundus string, res double")).orderBy("Name").collect()
    assert got[0].error is None and got[1].error == "no resolution for b"


def test_splits_are_exact_disjoint_and_stable(spark):
    df = spark.createDataFrame([(i, 0 if i % 3 else 1) for i in range(301)], "id long, y int")
    s = D.stratified_split(df, "y", "id")
    sizes = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert sizes == {(0, "test"): 40, (0, "train"): 160, (1, "test"): 20, (1, "train"): 81}
    again = D.stratified_split(df.repartition(7), "y", "id")
    assert s.join(again, ["id", "split"]).count() == 301
    three = D.fraction_split(df, "id", {"train": 0.8, "val": 0.1, "test": 0.1}).groupBy("split").count()
    assert {r.split: r["count"] for r in three.collect()} == {"train": 240, "val": 30, "test": 31}
    halves = D.halve(df, "id").groupBy("split").count()
    assert {r.split: r["count"] for r in halves.collect()} == {"val": 150, "test": 151}


def test_split_with_tiny_and_null_classes(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "a")], "id int, y string")
    got = {(r.y, r.split): r["count"] for r in D.stratified_split(df, "y", "id").groupBy("y", "split").count().collect()}
    assert got == {(None, "test"): 1, (None, "train"): 2, ("a", "train"): 1}


def test_oversample(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id_ long")
    out = D.oversample_to(df, 25, "id_")
    assert out.count() == 25 and out.where("draw is null").count() == 10
    assert D.oversample_to(df, 5, "id_").count() == 10


def test_upsert_last_write_wins(spark, rows):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, o int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, o int")
    assert rows(D.upsert(old, new, "k", ["o"]).select("k", "v")) == [("a", 1), ("b", 4), ("c", 5)]


def test_upsert_stored_touches_only_its_buckets(spark, rows, tmp_path):
    path = str(tmp_path / "keyed")
    old = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.lit(0).alias("o"))
    D.write_keyed(old, path, "k", 16)
    files = lambda: {str(f.relative_to(path)): f.read_bytes() for f in (tmp_path / "keyed").glob("key_bucket=*/*.parquet")}
    before = files()
    new = spark.createDataFrame([(5, 1, 1), (5, 2, 2), (500, 3, 1)], "k long, v long, o int")
    D.upsert_stored(new, path, "k", ["o"], 16)
    D.upsert_stored(spark.createDataFrame([(5, 7, 3), (None, 9, 1)], "k long, v long, o int"), path, "k", ["o"], 16)
    D.upsert_stored(new.where("false"), path, "k", ["o"], 16)
    assert rows(D.read_keyed(spark, path).select("k", "v")) == rows(spark.createDataFrame([(i, 7 if i == 5 else i * 10) for i in range(200)] + [(500, 3), (None, 9)], "k long, v long"))
    after = files()
    same = {name for name in before if after.get(name) == before[name]}
    assert len(same) >= 13 and {n.split("/")[0] for n in before} - {n.split("/")[0] for n in same} != set()


@pytest.mark.parametrize("buckets", [2, 9])
def test_ranks_and_sums_with_a_hot_group(spark, buckets):
    rng = np.random.default_rng(0)
    data = [("hot" if i % 3 else f"g{i % 7}", float(rng.integers(0, 200)), i) for i in range(900)]
    df = spark.createDataFrame(data, "g string, v double, id int")
    got = {r.id: r.seq for r in O.dense_rank_in_group(df, ["g"], [F.col("v"), F.col("id")], buckets=buckets).collect()}
    for g in {d[0] for d in data}:
        order = sorted((v, i) for h, v, i in data if h == g)
        assert [got[i] for _, i in order] == list(range(len(order)))
    table = df.groupBy("g", "v").agg(F.count("id").alias("c"))
    sums = {(r.g, r.v): r.s for r in O.running_sums(table, ["g"], "v", {"s": "c"}, buckets=buckets).collect()}
    assert all(s == sum(1 for h, w, _ in data if h == g and w <= v) for (g, v), s in sums.items())


def test_ties_are_parted_by_the_next_column(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") / 100).alias("v"), "id").repartition(3)
    sizes = [r["count"] for r in O.with_range_bucket(df, [F.col("v"), F.col("id")], buckets=16).groupBy("__b").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4 * 4000 / 16  # two thirds of all rows have one value
    with_gaps = spark.createDataFrame([(None, 1), (float("nan"), 2), (1.0, 3), (2.0, 4)], "v double, id int")
    got = {r.id: r["__b"] for r in O.with_range_bucket(with_gaps, [F.col("v")], buckets=4).collect()}
    assert got[1] <= got[3] <= got[4] <= got[2] and len(set(got.values())) == 4
    assert O.with_range_bucket(df.where("false"), [F.col("v")], buckets=4).count() == 0


def test_order_statistics(spark):
    rng = np.random.default_rng(4)
    data = [(int(rng.integers(0, 40)), None if i % 11 == 0 else f"s{i % 5}", i) for i in range(700)] + [(7, "s1", -1)] * 60
    df = spark.createDataFrame(data, "a int, b string, id int").repartition(4)
    first = lambda v: (v[0], v[1] is not None, v[1] or "")
    order = sorted(map(first, data))
    for start, stop in ((0, 10), (100, 140), (690, None), (0, 9999), (9999, None), (350, 351)):
        rows = O.rows_between(df, ["a", "b"], start, stop, buckets=6).collect()
        assert sorted(first(r) for r in rows) == order[start:stop]
    at = order.index((7, True, "s1"))
    n = order.count((7, True, "s1"))
    slices = [O.rows_between(df, ["a", "b"], i, j, buckets=4).collect() for i, j in ((at, at + n // 2), (at + n // 2, at + n))]
    assert sorted(tuple(r) for part in slices for r in part) == sorted(d for d in data if d[:2] == (7, "s1"))
    assert O.rows_between(df.where("false"), ["a"], 3, None).count() == 0


def test_plans_without_jobs_sorts_or_single_tasks(spark, capsys):
    from annolytics.operators import examples as P
    from annolytics.operators import metrics as M
    from annolytics.operators import stats as S

    df = spark.range(1000).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 2 == 0).alias("pos"))
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.jobsList(None).size()
    built = [
        P.slice_rows(df, ["x"], 100, 0), M.auc(df, "x", F.col("pos")), S.ks_exact(df, "x", F.col("pos"), []), S.exact_median(df, "x"),
        O.dense_rank_in_group(df, ["pos"], [F.col("x"), F.col("id")]), D.stratified_split(df, "pos", "id", 0.2), D.halve(df, "id"),
    ]
    assert store.jobsList(None).size() == before
    built[0].explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" not in plan and "GlobalLimit" not in plan and "TakeOrdered" not in plan


@pytest.mark.parametrize("tile", [3, 7, 100])
def test_components_across_tiles(spark, tile):
    rng = np.random.default_rng(6)
    mask = rng.random((30, 40)) < 0.4
    seen, want = {}, []
    for y, x in np.argwhere(mask):
        if (x, y) in seen:
            continue
        todo, members = [(x, y)], []
        seen[(x, y)] = True
        while todo:
            a, b = todo.pop()
            members.append((a, b))
            for da in (-1, 0, 1):
                for db in (-1, 0, 1):
                    n = (a + da, b + db)
                    if 0 <= n[0] < 40 and 0 <= n[1] < 30 and mask[n[1], n[0]] and n not in seen:
                        seen[n] = True
                        todo.append(n)
        want.append(len(members))
    px = spark.createDataFrame([(i, "l", int(x), int(y)) for i in ("a", "b") for y, x in np.argwhere(mask)], "image string, lesion string, x int, y int")
    table = U.component_table(U.label_components(px, tile=tile))
    for image in ("a", "b"):
        assert sorted(r.area for r in table.where(F.col("image") == image).collect()) == sorted(want)


def test_long_snake_crosses_many_tiles(spark):
    px = [("a", "l", x, y) for y in range(0, 20, 2) for x in range(30)] + [("a", "l", 29 if y % 4 == 1 else 0, y) for y in range(1, 19, 2)]
    table = U.component_table(U.label_components(spark.createDataFrame(px, "image string, lesion string, x int, y int"), tile=4))
    assert table.count() == 1 and table.first().area == len(px)


def test_once_is_not_copied_into_filters(spark):
    df = O.once(spark.range(10), a=F.col("id") * 2, b=F.when(F.col("id") > 4, F.col("id")))
    assert df.columns == ["id", "a", "b"] and df.where("a > 8 and b is not null and id < 8").count() == 3


def test_report_of_later_epochs(spark):
    from annolytics.operators import windows as W

    rows = [("t", "identity", 21, 0.5), ("t", "a", 30, 0.75), ("t", "a", 20, 9.0), ("t", "b", 22, 0.25), ("u", "a", 40, 1.0)]
    df = spark.createDataFrame(rows, "task string, method string, epoch int, score double")
    got = {(r.task, r.method): (r["rank"], r.delta, r.text) for r in W.report_top_n(df, ["task"], "method", "score", "epoch", "identity").collect()}
    assert got == {("t", "a"): (1, 0.25, "0.750 (0.250)"), ("t", "identity"): (2, 0.0, "0.500 (0.000)"), ("u", "a"): (1, None, None)}


# -- components of a graph


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 1), (2, 2)]
    least = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least and a != b:
                least[a] = least[b] = min(least[a], least[b])
    ids = spark.createDataFrame(edges, "src long, dst long")
    names = ids.select(*[F.when(F.col(c).isNotNull(), F.struct(F.lit("é").alias("image"), F.lit(None).cast("string").alias("of"), F.col(c).alias("node"))).alias(c) for c in ids.columns])
    for one_task in (0, 30, 1 << 10):
        assert {r["node"]: r["component"] for r in connected_components(ids, one_task=one_task).collect()} == least
        assert {r["node"]["node"]: r["component"]["node"] for r in connected_components(names, one_task=one_task).collect()} == least
        assert connected_components(ids.where("src < 0"), one_task=one_task).count() == 0
