"""Queries: joins, ranked rows, splits, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import splits as D
from ..operators import stats as S
from ..operators import windows as N
from ..session import scratch_path
from . import catalog as B
from . import catalog_examples as X
from . import catalog_measures as Y
from .catalog import FEATS_SQL, Tables, query, r6

# ---------------------------------------------------------------- joins

@query("j1_merge_features", f"WITH {FEATS_SQL} SELECT Name, max(v) FILTER (WHERE s = 'F') AS disc, max(v) FILTER (WHERE s = 'O') AS binary, max(v) FILTER (WHERE s = 'P') AS artery, max(m) AS vein FROM f GROUP BY Name")
def j1(t: Tables) -> DataFrame:
    vein = t.orders.groupBy(F.col("o_custkey").cast("string").alias("Name"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("m"))
    vein = vein.groupBy("Name").agg(F.max(F.when(F.col("n") < 4, -1.0).otherwise(F.col("m"))).alias("vein"))
    return J.merge_features(B.status_table(t, "F", "disc"), B.status_table(t, "O", "binary"), B.status_table(t, "P", "artery"), vein)


ZONE_SQL = """zn AS (SELECT CAST(o_custkey AS VARCHAR) AS Name, o_orderstatus AS s, CASE WHEN count(*) > 2 THEN CAST(count(*) % 3 AS DOUBLE) END AS k1, CAST(count(*) % 2 AS DOUBLE) AS k2, round(max(o_totalprice), 2) AS width FROM orders GROUP BY 1, 2)"""


def zone(t: Tables, status: str) -> DataFrame:
    n = F.count(F.lit(1))
    return t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").cast("string").alias("Name")).agg(
        F.when(n > 2, (n % 3).cast("double")).alias("k1"), (n % 2).cast("double").alias("k2"), F.round(F.max("o_totalprice"), 2).alias("width"))


@query("j2_merge_zones", f"""WITH {ZONE_SQL}, z AS (SELECT coalesce(b.Name, c.Name) AS Name, coalesce(b.k1, c.k1) AS k1, coalesce(b.k2, c.k2) AS k2, b.width AS width_zone_b, c.width AS width_zone_c
FROM (SELECT * FROM zn WHERE s = 'O') b FULL JOIN (SELECT * FROM zn WHERE s = 'P') c ON b.Name = c.Name AND b.k1 IS NOT DISTINCT FROM c.k1 AND b.k2 IS NOT DISTINCT FROM c.k2)
SELECT coalesce(w.Name, z.Name) AS Name, coalesce(w.k1, z.k1) AS k1, coalesce(w.k2, z.k2) AS k2, w.width, z.width_zone_b, z.width_zone_c FROM (SELECT * FROM zn WHERE s = 'F') w
FULL JOIN z ON w.Name = z.Name AND w.k1 IS NOT DISTINCT FROM z.k1 AND w.k2 IS NOT DISTINCT FROM z.k2""")
def j2(t: Tables) -> DataFrame:
    return J.merge_zones(zone(t, "F"), zone(t, "O"), zone(t, "P"), ["Name", "k1", "k2"])


@query("j3_attach_quality", f"""WITH {FEATS_SQL} SELECT 'c' || d.Name || '.png' AS Filename, d.v AS disc, q.v AS QuickQual_quality, x.v AS density FROM (SELECT * FROM f WHERE s = 'F') d
JOIN (SELECT * FROM f WHERE s = 'O') q ON d.Name = q.Name JOIN (SELECT * FROM f WHERE s = 'P') x ON d.Name = x.Name""")
def j3(t: Tables) -> DataFrame:
    name = lambda ext: F.concat(F.lit("c"), F.col("Name"), F.lit(ext))
    disc = B.status_table(t, "F", "disc").select(name(".png").alias("Filename"), "disc")
    quality = B.status_table(t, "O", "quality").select(name(".crop.jpg").alias("Name"), "quality")
    features = B.status_table(t, "P", "density").select(name(".png").alias("Filename"), "density")
    return J.attach_quality(disc, quality, features)


@query("j4_lookup_scale", """SELECT s_suppkey, k AS Name, n_nationkey * 0.001::DOUBLE AS res, CASE WHEN n_nationkey IS NULL THEN 'no resolution for ' || k END AS error
FROM (SELECT s_suppkey, 'n' || (s_nationkey + s_suppkey % 3 * 10) AS k, s_nationkey + s_suppkey % 3 * 10 AS kk FROM supplier) LEFT JOIN nation ON n_nationkey = kk""")
def j4(t: Tables) -> DataFrame:
    res = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("fundus"), (F.col("n_nationkey") * 0.001).alias("res"))
    key = F.concat(F.lit("n"), (F.col("s_nationkey") + F.col("s_suppkey") % 3 * 10).cast("string"))
    return J.lookup_scale(t.supplier.select("s_suppkey", key.alias("Name")), res)


@query("j5_lookup_by_name", """WITH o AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1)
SELECT c_custkey, k AS o_orderkey, p AS o_totalprice, k IS NOT NULL AS found FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def j5(t: Tables) -> DataFrame:
    table = t.orders.select(F.concat(F.lit("q/c."), F.col("o_custkey").cast("string"), F.lit(".png")).alias("path"), "o_orderkey", "o_totalprice", "o_orderdate")
    keys = t.customer.select("c_custkey", F.concat(F.lit("a/b/c."), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("file"))
    out = J.lookup_by_name(keys, table, "file", "path", ["o_orderdate", "o_orderkey"], by="stem")
    return out.select("c_custkey", "match.o_orderkey", "match.o_totalprice", "found")


@query("j7_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def j7(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus")
    return J.pending(o, o.where("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey")


@query("j7_extend_progress", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders WHERE o_orderstatus IN ('F', 'O')")
def j7b(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus")
    done = J.extend_progress(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus != 'P'"), "o_orderkey")
    return done.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@query("j8_resolve_files", """SELECT page_id, 'p' || page_id || ['', '.jpg', '.png', '.PNG'][page_id % 5 + 1] AS resolved FROM pages WHERE page_id % 5 < 4""")
def j8(t: Tables) -> DataFrame:
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("", ".jpg", ".png", ".PNG", ".gif")]), (F.col("page_id") % 5 + 1).cast("int"))
    second = F.when(F.col("page_id") % 5 == 1, F.concat(name, F.lit(".PNG")))  # a later choice that must not win
    manifest = t.pages.select(F.explode(F.array_compact(F.array(F.concat(name, ext), second))).alias("path"))
    return J.resolve_files(t.pages.select("page_id", name.alias("name")), manifest, "name").select("page_id", "resolved")


@query("j9_join_scores", f"""WITH {Y.METHOD_SQL} SELECT coalesce(a.method, b.method) AS method, round(task, 6) AS task, round(sep, 6) AS sep FROM (SELECT method, avg(red) AS task FROM ml WHERE method <> 'NO' GROUP BY 1) a
FULL JOIN (SELECT method, greatest(min(red), min(green), min(blue)) AS sep FROM ml WHERE method <> 'AF' GROUP BY 1) b ON a.method = b.method""")
def j9(t: Tables) -> DataFrame:
    m = Y.methods(t)
    task = S.method_means(m.where("method != 'NO'"), ["red"]).select("method", F.col("red").alias("task"))
    sep = S.method_separability(m.where("method != 'AF'"), method="method").withColumnRenamed("separability", "sep")
    return J.join_scores(task, sep).select("method", r6("task").alias("task"), r6("sep").alias("sep"))


@query("j10_match_pseudo_labels", """SELECT page_id, 'out/im' || page_id || '.gif' AS label_path FROM pages WHERE page_id % 3 = 0""")
def j10(t: Tables) -> DataFrame:
    i = F.col("page_id").cast("string")
    test = t.pages.select("page_id", F.concat(F.lit("in/im"), i, F.lit(".png")).alias("image"))
    kind = F.col("page_id") % 3
    preds = t.pages.select(F.when(kind == 0, F.concat(F.lit("out/im"), i, F.lit(".gif"))).when(kind == 1, F.concat(F.lit("out/im"), i, F.lit("_binary.gif"))).otherwise(
        F.concat(F.lit("out/im"), i, F.lit(".perf"))).alias("pred"))
    return J.match_pseudo_labels(test, preds, "image", "pred").select("page_id", "label_path")


COVER_SQL = """have AS (SELECT 'role_' || role AS n FROM conversations UNION SELECT event_type FROM events GROUP BY event_type HAVING max(value) > 350),
al(alias, real) AS (VALUES ('view', 'role_user'), ('error', 'role_robot'), ('click', 'role_user')),
cov AS (SELECT r.n AS name, coalesce(h.n, v.n) AS found, al.real FROM (SELECT DISTINCT event_type AS n FROM events) r LEFT JOIN have h ON h.n = r.n LEFT JOIN al ON al.alias = r.n LEFT JOIN have v ON v.n = al.real)"""


def cover(t: Tables) -> DataFrame:
    have = t.conversations.select(F.concat(F.lit("role_"), "role").alias("name")).distinct().unionByName(
        t.events.groupBy(F.col("event_type").alias("name")).agg(F.max("value").alias("v")).where("v > 350").select("name"))
    aliases = t.spark.createDataFrame([("view", "role_user"), ("error", "role_robot"), ("click", "role_user")], "alias string, real string")
    return J.coverage(t.events.select(F.col("event_type").alias("name")).distinct(), have, aliases)


@query("j11_coverage", f"""WITH {COVER_SQL} SELECT name, CASE WHEN found IS NULL THEN 'missing' ELSE 'available' END AS status,
CASE WHEN found IS NOT NULL THEN found WHEN real IS NOT NULL THEN 'mapped to ' || real || ' but not loaded' ELSE 'no mapping' END AS real_name FROM cov""")
def j11(t: Tables) -> DataFrame:
    return cover(t)


@query("j11_coverage_summary", f"""WITH {COVER_SQL} SELECT count(*) AS total, count(found) AS available, count(*) - count(found) AS missing, round(count(found) * 100 / count(*), 6) AS available_percent, round((count(*) - count(found)) * 100 / count(*), 6) AS missing_percent FROM cov""")
def j11b(t: Tables) -> DataFrame:
    out = J.coverage_summary(cover(t))
    return out.withColumns({c: r6(c) for c in ("available_percent", "missing_percent")})


# ---------------------------------------------------------------- ranked rows

@query("w1_top_n", f"""WITH {Y.METHOD_SQL}, m AS (SELECT lesion, method, avg(red) AS s FROM ml GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lesion ORDER BY s DESC, method) AS rk FROM m)
SELECT lesion, method, round(s, 6) AS mean_score, CASE WHEN rk <= 2 THEN rk::INT END AS rank FROM r WHERE rk <= 2 OR method = 'NO'""")
def w1(t: Tables) -> DataFrame:
    return N.top_n(Y.methods(t), ["lesion"], "method", "red", 2, "NO").withColumn("mean_score", r6("mean_score"))


@query("w1_report_top_n", """WITH x AS (SELECT l_returnflag || l_linestatus AS method, CAST(month(l_shipdate) AS INTEGER) AS task, l_linenumber * 10 AS epoch, l_quantity AS score FROM lineitem),
m AS (SELECT task, method, avg(score) AS s FROM x WHERE epoch > 20 GROUP BY ALL),
d AS (SELECT m.task, m.method, m.s, m.s - b.s AS delta, row_number() OVER (PARTITION BY m.task ORDER BY m.s DESC, m.method) AS rk FROM m LEFT JOIN m b ON b.task = m.task AND b.method = 'NO')
SELECT task, method, round(s, 6) AS mean_score, round(delta, 6) AS delta, CAST(rk AS INTEGER) AS rank FROM d WHERE rk <= 2""")
def w1b(t: Tables) -> DataFrame:
    runs = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("method"), F.month("l_shipdate").alias("task"), (F.col("l_linenumber") * 10).alias("epoch"), F.col("l_quantity").alias("score"))
    out = N.report_top_n(runs, ["task"], "method", "score", "epoch", "NO")
    return out.select("task", "method", r6("mean_score").alias("mean_score"), r6("delta").alias("delta"), "rank")


@query("w2_arg_max_rows", """SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) = 1""")
def w2(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey")
    return N.arg_max_rows(rows, ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_suppkey"]).drop("l_suppkey")


@query("w3_scale_by_group_max", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_returnflag), 6) AS scaled FROM lineitem")
def w3(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return N.scale_by_group_max(rows, ["l_returnflag"], "l_extendedprice").select("l_orderkey", "l_linenumber", r6("scaled").alias("scaled"))


@query("w10_latest_per_key", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w10(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return N.latest_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


CALL_SQL = """cl AS (SELECT event_type, event_id, value, md5(event_type || ':' || '{"k":"' || regexp_extract(props, '[0-9]+') || '","u":"' || user_id % 3 || '"}') AS fp FROM events),
last AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY fp ORDER BY event_id DESC) = 1)"""


def calls(t: Tables) -> DataFrame:
    args = F.create_map(F.lit("u"), (F.col("user_id") % 3).cast("string"), F.lit("k"), F.regexp_extract("props", "[0-9]+", 0))
    rows = t.events.select(F.col("event_type").alias("tool_name"), args.alias("args"), "event_id", "value")
    keyed = rows.select("tool_name", "event_id", "value", N.call_fingerprint("tool_name", F.col("args")).alias("fp"))
    return N.dedup_calls(keyed, "fp", ["event_id"])


@query("w11_dedup_calls", f"WITH {CALL_SQL} SELECT fp, event_type AS tool_name, event_id, value FROM last WHERE event_type <> 'click' AND value > 1")
def w11(t: Tables) -> DataFrame:
    kept = N.drop_mock(N.evict(calls(t), "click"), F.col("value") <= 1)
    return kept.select("fp", "tool_name", "event_id", "value")


@query("w11_call_stats", f"WITH {CALL_SQL} SELECT event_type AS tool_name, count(*) AS n FROM last GROUP BY 1")
def w11b(t: Tables) -> DataFrame:
    return N.call_stats(calls(t))


# ---------------------------------------------------------------- splits and sets

def order_sql(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {key}) || '|' || {key}"


@query("d1_stratified_split", f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {order_sql('doc_id')}) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN k <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def d1(t: Tables) -> DataFrame:
    return D.stratified_split(t.labels.select("doc_id", "quality"), "quality", "doc_id")


@query("d2_halve", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {order_sql('doc_id')}) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= n // 2 THEN 'val' ELSE 'test' END AS split FROM r""")
def d2(t: Tables) -> DataFrame:
    return D.halve(t.documents.select("doc_id"), "doc_id")


@query("d3_fraction_split", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {order_sql('doc_id', 7)}) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM r""")
def d3(t: Tables) -> DataFrame:
    return D.fraction_split(t.documents.select("doc_id"), "doc_id", {"train": 0.7, "val": 0.2, "test": 0.1}, seed=7)


@query("d4_oversample_to", f"""WITH n AS (SELECT count(*) AS n FROM labels), r AS (SELECT doc_id, row_number() OVER (ORDER BY {order_sql('doc_id')}) - 1 AS i FROM labels),
d AS (SELECT u.i AS draw, CAST('0x' || substring(md5('42#' || u.i), 1, 15) AS BIGINT) % n.n AS i FROM n, range(1000) u(i))
SELECT doc_id, CAST(NULL AS BIGINT) AS draw FROM labels UNION ALL SELECT doc_id, draw FROM d JOIN r USING (i)""")
def d4(t: Tables) -> DataFrame:
    rows = t.labels.select("doc_id")
    return D.oversample_to(rows, rows.count() + 1000, "doc_id")


@query("d5_merge_splits", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {order_sql('doc_id')}) AS k, count(*) OVER () AS n FROM labels)
SELECT page_id AS id, 'train' AS split, CAST(NULL AS INTEGER) AS iq FROM pages UNION ALL SELECT doc_id, CASE WHEN k <= n // 2 THEN 'val' ELSE 'test' END, quality FROM r JOIN labels USING (doc_id)""")
def d5(t: Tables) -> DataFrame:
    new = D.halve(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("iq")), "id")
    return D.merge_splits(t.pages.select(F.col("page_id").alias("id"), F.lit("train").alias("split")), new)


@query("d6_append_results", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def d6(t: Tables) -> DataFrame:
    o = t.orders
    return D.append_results(o.where("o_orderstatus = 'F'").select("o_orderkey"), o.where("o_orderstatus != 'P'").select("o_orderkey"))


D7_SQL = """WITH nw AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v, 1 AS s FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice * 3, 2 FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT -1 - o_orderkey, 0, 1 FROM orders WHERE o_orderkey % 11 = 0)
SELECT coalesce(n.k, o.o_orderkey) AS o_orderkey, round(coalesce(n.v, o.o_totalprice), 4) AS o_totalprice FROM orders o FULL JOIN (SELECT k, arg_max(v, s) AS v FROM nw GROUP BY k) n ON n.k = o.o_orderkey"""


def changed_orders(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.orders.select("o_orderkey", "o_totalprice", F.lit(0).alias("seq"))
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    new = old.where(k % 3 == 0).select(k, (v * 2).alias("o_totalprice"), F.lit(1).alias("seq")).unionByName(
        old.where(k % 9 == 0).select(k, (v * 3).alias("o_totalprice"), F.lit(2).alias("seq"))
    ).unionByName(old.where(k % 11 == 0).select((-1 - k).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), F.lit(1).alias("seq")))
    return old, new


@query("d7_upsert", D7_SQL)
def d7(t: Tables) -> DataFrame:
    old, new = changed_orders(t)
    return D.upsert(old, new, "o_orderkey", ["seq"]).select("o_orderkey", r6("o_totalprice", 4).alias("o_totalprice"))


@query("d7_upsert_stored", D7_SQL)
def d7_stored(t: Tables) -> DataFrame:
    old, new = changed_orders(t)
    path = scratch_path(t.spark, "keyed")
    D.write_keyed(old, path, "o_orderkey", 16)
    for seq in (1, 2):  # one upsert after the other
        D.upsert_stored(new.where(F.col("seq") == seq), path, "o_orderkey", ["seq"], 16)
    return D.read_keyed(t.spark, path).select("o_orderkey", r6("o_totalprice", 4).alias("o_totalprice"))
