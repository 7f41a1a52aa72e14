"""Queries: chunking, embedding, retrieval, tool calls, streaming, file layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions.columns import l2_normalize
from ..operators import chunking as K
from ..operators import retrieval as R
from ..operators import tools as U
from ..operators import validation as V
from ..operators.embedding import embed
from ..operators.examples import threshold
from ..session import scratch_path
from ..sources import index_store, readers
from ..streaming import incremental
from . import catalog as B
from . import catalog_examples as X
from .catalog import QA_SQL, QVEC_SQL, Tables, query, r6

# ---------------------------------------------------------------- chunking

FIXED_SQL = """fx AS (SELECT doc_id, u.s AS start_char, substring(text, CAST(u.s + 1 AS BIGINT), 512) AS c FROM documents, unnest(range(0, length(text), 462)) u(s)),
fc AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS INTEGER) AS chunk_id, start_char, c FROM fx WHERE regexp_matches(c, '\\S'))"""


@query("t1_chunk_fixed", f"WITH {FIXED_SQL} SELECT doc_id, chunk_id, CAST(start_char AS INTEGER) AS start_char, CAST(start_char + 512 AS INTEGER) AS end_char, md5(c) AS digest FROM fc")
def t1(t: Tables) -> DataFrame:
    out = K.chunk_fixed(t.texts.select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "chunk_id", "start_char", "end_char", F.md5("text").alias("digest"))


def mark(text: str) -> str:
    out = text
    for s in C.SENTENCE_SEPARATORS:
        lit = "E'" + s.replace("\n", "\\n") + "'"
        out = f"replace({out}, {lit}, {lit} || chr(1))"
    return out


SENT_SQL = f"""sn AS (SELECT doc_id, list_filter(string_split({mark('text')}, chr(1)), lambda s: regexp_matches(s, '\\S')) AS s FROM documents)"""


@query("t2_split_sentences", f"WITH {SENT_SQL} SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS digest FROM sn")
def t2(t: Tables) -> DataFrame:
    s = t.texts.select("doc_id", C.split_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


PACK_SQL = f"""{SENT_SQL}, ln AS (SELECT doc_id, s, list_transform(s, lambda x: length(x)) AS l FROM sn),
fold AS (SELECT doc_id, 0 AS pos, 0 AS lo, CAST(0 AS BIGINT) AS used, -1 AS cf, -1 AS cl FROM ln WHERE len(l) > 0
UNION ALL SELECT f.doc_id, pos + 1, CASE WHEN full_ THEN CASE WHEN pos - lo > 1 THEN pos - 1 ELSE pos END ELSE lo END,
CASE WHEN full_ THEN CASE WHEN pos - lo > 1 THEN l[pos] ELSE 0 END ELSE used END + l[pos + 1], CASE WHEN full_ THEN lo ELSE -1 END, CASE WHEN full_ THEN pos - 1 ELSE -1 END
FROM (SELECT fold.*, ln.l, used + l[pos + 1] > 512 AND pos > lo AS full_ FROM fold JOIN ln USING (doc_id) WHERE pos < len(l)) f),
rg AS (SELECT doc_id, cf AS f, cl AS l FROM fold WHERE cf >= 0 UNION ALL SELECT doc_id, lo, pos - 1 FROM fold JOIN ln USING (doc_id) WHERE pos = len(ln.l) AND pos > lo),
pk AS (SELECT rg.doc_id, CAST(row_number() OVER (PARTITION BY rg.doc_id ORDER BY f, rg.l) - 1 AS INTEGER) AS chunk_id, CAST(rg.l - f + 1 AS INTEGER) AS sentence_count, array_to_string(ln.s[f + 1 : rg.l + 1], '') AS c FROM rg JOIN ln USING (doc_id))"""


@query("t3_chunk_sentences", f"WITH RECURSIVE {PACK_SQL} SELECT doc_id, chunk_id, sentence_count, md5(c) AS digest FROM pk")
def t3(t: Tables) -> DataFrame:
    out = K.chunk_sentences(t.texts.select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "chunk_id", "sentence_count", F.md5("text").alias("digest"))


@query("t4_chunk_recursive")
def t4(t: Tables) -> DataFrame:
    return K.chunk_recursive(t.texts.select("doc_id", "text"), ["doc_id"]).select("doc_id", "chunk_id", "text")


SEMANTIC_SQL = rf"""{SENT_SQL}, sx AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM sn),
sw AS (SELECT doc_id, i, slot, count(*) AS n FROM (SELECT doc_id, i, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 64 AS slot FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(x), '[\pL\pN_]+')) AS w FROM sx)) GROUP BY ALL),
sq AS (SELECT doc_id, i, sqrt(sum(n * n)) AS norm FROM sw GROUP BY ALL),
dt AS (SELECT a.doc_id, a.i, sum(a.n * b.n) AS dot FROM sw a JOIN sw b ON a.doc_id = b.doc_id AND a.i = b.i + 1 AND a.slot = b.slot GROUP BY ALL),
sm AS (SELECT sx.doc_id, sx.i, coalesce(dot, 0) / (p.norm * q.norm) AS sim FROM sx LEFT JOIN sq p ON p.doc_id = sx.doc_id AND p.i = sx.i LEFT JOIN sq q ON q.doc_id = sx.doc_id AND q.i = sx.i - 1 LEFT JOIN dt ON dt.doc_id = sx.doc_id AND dt.i = sx.i WHERE sx.i > 0),
ml AS (SELECT doc_id, list(sim ORDER BY i) AS m FROM sm GROUP BY 1),
ln AS (SELECT doc_id, s, list_transform(s, lambda x: length(x)) AS l, m FROM sn LEFT JOIN ml USING (doc_id)),
fold AS (SELECT doc_id, 1 AS pos, 0 AS lo, l[1] AS used, -1 AS cf, -1 AS cl FROM ln WHERE len(l) > 1
UNION ALL SELECT doc_id, pos + 1, CASE WHEN cut THEN pos ELSE lo END, CASE WHEN cut THEN 0 ELSE used END + l[pos + 1], CASE WHEN cut THEN lo ELSE -1 END, CASE WHEN cut THEN pos - 1 ELSE -1 END
FROM (SELECT fold.*, ln.l, (coalesce(m[pos] < 0.2, false) OR used + l[pos + 1] > 1000) AND used >= 100 AS cut FROM fold JOIN ln USING (doc_id) WHERE pos < len(l))),
rg AS (SELECT doc_id, cf AS f, cl AS l, true AS inner_ FROM fold WHERE cf >= 0 UNION ALL SELECT doc_id, lo, pos - 1, false FROM fold JOIN ln USING (doc_id) WHERE pos = len(ln.l)),
js AS (SELECT rg.*, ln.s, m[f + 1 : rg.l + 1] AS j FROM rg JOIN ln USING (doc_id))"""


@query("t5_chunk_semantic", f"""WITH RECURSIVE {SEMANTIC_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS INTEGER) AS chunk_id, array_to_string(s[f + 1 : l + 1], '') AS text,
CASE WHEN inner_ AND len(list_filter(j, lambda x: x IS NULL)) = 0 THEN round(list_sum(j) / len(j), 6) END AS avg_similarity FROM js
UNION ALL SELECT doc_id, NULL, text, NULL FROM documents JOIN sn USING (doc_id) WHERE len(s) = 1""")
def t5(t: Tables) -> DataFrame:
    out = K.chunk_semantic(t.texts.select("doc_id", "text"), ["doc_id"], threshold=0.2)
    return out.select("doc_id", "chunk_id", "text", r6("avg_similarity").alias("avg_similarity"))


@query("t6_chunk_hybrid", f"""WITH RECURSIVE {FIXED_SQL}, {PACK_SQL} SELECT doc_id, 0 AS hybrid_strategy_index, 'hybrid_fixed_size' AS chunking_strategy, 0.75::DOUBLE AS hybrid_weight, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars FROM fc GROUP BY 1
UNION ALL SELECT doc_id, 1, 'hybrid_sentence', 0.25, count(*), CAST(sum(length(c)) AS BIGINT) FROM pk GROUP BY 1""")
def t6(t: Tables) -> DataFrame:
    docs = t.texts.select("doc_id", "text")
    both = K.chunk_hybrid([K.chunk_fixed(docs, ["doc_id"]), K.chunk_sentences(docs, ["doc_id"])], [3, 1])
    return both.groupBy("doc_id", "hybrid_strategy_index", "chunking_strategy", "hybrid_weight").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("t7_needs_ocr", r"""SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50 OR length(text) / (len(text) - len(replace(text, chr(10), '')) + 1) < 50 AS needs_ocr FROM documents""")
def t7(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("text").alias("content"), F.size(F.split("text", "\n")).alias("page_count"))
    return K.needs_ocr(docs).select("doc_id", "needs_ocr")


@query("t8_assemble_document", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), p AS (SELECT doc_id, u.i AS i, s[u.i] AS t, len(s) AS n FROM l, unnest(range(1, len(s) + 1)) u(i)),
b AS (SELECT doc_id, string_agg('[页码 ' || i || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY i) AS c FROM p WHERE regexp_matches(t, '\S') GROUP BY 1)
SELECT doc_id, len(s) AS page_count, md5(coalesce(c, '')) AS digest FROM l LEFT JOIN b USING (doc_id)""")
def t8(t: Tables) -> DataFrame:
    pages = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("page", F.col("i") + 1)
    out = K.assemble_document(pages)
    return out.select("doc_id", "page_count", F.md5("content").alias("digest"))


# ---------------------------------------------------------------- vectors

@query("t9_embed", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w FROM documents), s AS (SELECT doc_id, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS n FROM w GROUP BY ALL)
SELECT d.doc_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY u.i) AS vec FROM documents d CROSS JOIN range(64) u(i) LEFT JOIN s ON s.doc_id = d.doc_id AND slot = u.i GROUP BY 1""")
def t9(t: Tables) -> DataFrame:
    e = embed(t.texts.select("doc_id", "text"))
    return e.select("doc_id", F.array_join(F.transform("embedding", lambda v: v.cast("long").cast("string")), ",").alias("vec"))


# all components in one number: those at place i count i times
@query("t10_normalize", """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / n, 6) AS first, round(list_sum(list_transform(embedding, lambda x, i: i * CAST(x AS DOUBLE))) / n, 6) AS weighed, CAST(len(embedding) AS INTEGER) AS dim
FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) ** 2))) AS n FROM embeddings)""")
def t10(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", l2_normalize("embedding").alias("v"))
    weighed = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", r6(F.get("v", F.lit(0))).alias("first"), r6(weighed).alias("weighed"), F.size("v").alias("dim"))


def index(t: Tables, metric: str = "cosine") -> R.VectorIndex:
    return R.build_index(t.embeddings.select("vec_id", "embedding", "label"), 64, metric)


@query("t11_add_vectors", "SELECT label, count(*) * 2 AS n FROM embeddings GROUP BY 1")
def t11(t: Tables) -> DataFrame:
    more = t.embeddings.select((F.col("vec_id") + 1000000000).alias("vec_id"), "embedding", "label")
    return R.add_vectors(index(t), more).vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


NEAR_SQL = f"""{QVEC_SQL}, v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
sc AS (SELECT query_id, vec_id, label, list_cosine_similarity(qv, x) AS cosine, list_dot_product(qv, x) AS ip, 1 / (1 + list_distance(qv, x) ** 2) AS l2 FROM q, v),
nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM sc)"""


def found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", r6("score").alias("score"), "rank")


@query("t12_search_cosine", f"WITH {NEAR_SQL} SELECT query_id, vec_id, round(cosine, 6) AS score, CAST(rank AS INTEGER) AS rank FROM nr WHERE rank <= 10")
def t12(t: Tables) -> DataFrame:
    return found(R.search(index(t), B.label_means(t), 10))


for _m in ("ip", "l2"):
    @query(f"t12_search_{_m}", f"WITH {NEAR_SQL} SELECT query_id, vec_id, round({_m}, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_m} DESC, vec_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10")
    def _search(t: Tables, metric: str = _m) -> DataFrame:
        return found(R.search(index(t, metric), B.label_means(t), 10))


@query("p7_threshold", f"WITH {NEAR_SQL} SELECT query_id, vec_id, round(cosine, 6) AS score FROM nr WHERE rank <= 20 AND cosine >= 0.4")
def p7(t: Tables) -> DataFrame:
    return threshold(R.search(index(t), B.label_means(t), 20), 0.4).select("query_id", "vec_id", r6("score").alias("score"))


# eight cells, all of them probed: the answer must be the exact one
@query("t13_ivf_all_cells", f"WITH {NEAR_SQL} SELECT query_id, vec_id, round(cosine, 6) AS score, CAST(rank AS INTEGER) AS rank FROM nr WHERE rank <= 10")
def t13(t: Tables) -> DataFrame:
    return found(R.search(R.build_ivf(index(t), 8), B.label_means(t), 10))


@query("t13_ivf_probed")
def t13b(t: Tables) -> DataFrame:
    return found(R.search(R.build_ivf(index(t), 32), B.label_means(t), 10))


def texted(t: Tables) -> tuple[R.VectorIndex, DataFrame]:
    """Index whose vectors carry the text of the document with the same number; queries with a benchmark text."""
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "text", F.col("source").alias("filename"))
    e = t.embeddings.select("vec_id", "embedding").join(docs, "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    q = B.label_means(t).join(t.benchmark.select(F.col("item_id").cast("int").alias("query_id"), F.col("text").alias("query")), "query_id")
    return R.build_index(e, 64), q


WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\pL\\pN_]+'))"
RERANK_SQL = f"""{NEAR_SQL}, cand AS (SELECT nr.query_id, nr.vec_id, cosine, rank, coalesce(d.text, '') AS text, coalesce(d.source, 'unknown') AS filename, b.text AS query FROM nr LEFT JOIN documents d ON d.doc_id = vec_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= {{n}}),
rr AS (SELECT *, len(list_intersect({WORDS('query')}, {WORDS('text')})) / len({WORDS('query')}) AS rs FROM cand),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rank) AS new_rank FROM rr {{w}})"""


@query("t14_retrieve", f"WITH {RERANK_SQL.format(n=15, w='WHERE cosine >= 0.35')} SELECT query_id, vec_id, round(cosine, 6) AS original_score, round(rs, 6) AS score, CAST(new_rank AS INTEGER) AS rank FROM rk WHERE new_rank <= 5")
def t14(t: Tables) -> DataFrame:
    idx, q = texted(t)
    out = R.retrieve(idx, q, 5, threshold=0.35, rerank_with=True)
    return out.select("query_id", "vec_id", r6("original_score").alias("original_score"), r6("score").alias("score"), "rank")


# texts stored by buckets of ids; only folders with hits are read
@query("t14_retrieve_stored", f"WITH {RERANK_SQL.format(n=15, w='WHERE cosine >= 0.35')} SELECT query_id, vec_id, round(cosine, 6) AS original_score, round(rs, 6) AS score, CAST(new_rank AS INTEGER) AS rank FROM rk WHERE new_rank <= 5")
def t14_stored(t: Tables) -> DataFrame:
    idx, q = texted(t)
    path = scratch_path(t.spark, "texts")
    index_store.save_index(idx, path)
    out = R.retrieve(index_store.load_index(t.spark, path), q, 5, threshold=0.35, rerank_with=True)
    return out.select("query_id", "vec_id", r6("original_score").alias("original_score"), r6("score").alias("score"), "rank")


@query("t14_retrieve_many", f"WITH {RERANK_SQL.format(n=450, w='')} SELECT query_id, vec_id, round(cosine, 6) AS original_score, round(rs, 6) AS score, CAST(new_rank AS INTEGER) AS rank FROM rk WHERE new_rank <= 150")
def t14b(t: Tables) -> DataFrame:
    idx, q = texted(t)
    out = R.retrieve(idx, q, 150, rerank_with=True)
    return out.select("query_id", "vec_id", r6("original_score").alias("original_score"), r6("score").alias("score"), "rank")


@query("t15_rerank", f"WITH {RERANK_SQL.format(n=20, w='')} SELECT query_id, vec_id, round(rs, 6) AS rerank_score, CAST(new_rank AS INTEGER) AS rank FROM rk WHERE new_rank <= 7")
def t15(t: Tables) -> DataFrame:
    idx, q = texted(t)
    hits = R.retrieve(idx, q, 20).join(q.select("query_id", "query"), "query_id")
    return R.rerank(hits, 10, top_k=7).select("query_id", "vec_id", r6("rerank_score").alias("rerank_score"), "rank")


@query("u4_custom_scorer", f"WITH {RERANK_SQL.format(n=20, w='')} SELECT query_id, vec_id, CAST(length(text) AS DOUBLE) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rank) AS INTEGER) AS r FROM rr QUALIFY r <= 5")
def u4(t: Tables) -> DataFrame:
    idx, q = texted(t)
    hits = R.retrieve(idx, q, 20).join(q.select("query_id", "query"), "query_id")
    return R.rerank(hits, 5, scorer=lambda _, text: F.length(text)).select("query_id", "vec_id", "rerank_score", F.col("rank").alias("r"))


@query("t16_build_context", f"""WITH {RERANK_SQL.format(n=4, w='')} SELECT query_id, md5(string_agg('[文档' || rank || '] 来源: ' || filename || ', 页码: N/A' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest, count(*)::INT AS sources FROM rr GROUP BY 1""")
def t16(t: Tables) -> DataFrame:
    idx, q = texted(t)
    out = R.build_context(R.retrieve(idx, q, 4))
    return out.select("query_id", F.md5("context").alias("digest"), F.size("sources").alias("sources"))


@query("t17_index_stats", "SELECT 64 AS dimension, 'cosine' AS metric, 'flat' AS index_type, 'sentence' AS strategy, count(*) AS total_vectors FROM embeddings")
def t17(t: Tables) -> DataFrame:
    return R.index_stats(index(t), "sentence")


@query("s8_index_round_trip", f"WITH {NEAR_SQL} SELECT query_id, vec_id, round(cosine, 6) AS score, CAST(rank AS INTEGER) AS rank FROM nr WHERE rank <= 10")
def s8(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "index")
    index_store.save_index(R.build_ivf(index(t), 8), path)
    return found(R.search(index_store.load_index(t.spark, path), B.label_means(t), 10))


# ---------------------------------------------------------------- tool calls

def _double(k: str) -> int:
    return int(k) * 2


def _odd_only(k: str) -> dict:
    if int(k) % 2 == 0:
        raise ValueError("even")
    return {"k": int(k)}


@query("u1_run_tools", """WITH e AS (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN event_type IN ('click', 'view') OR (event_type = 'error' AND k % 2 = 1) THEN 'success' ELSE 'error' END AS status,
CASE WHEN event_type IN ('click', 'view') THEN CAST(k * 2 AS VARCHAR) WHEN event_type = 'error' AND k % 2 = 1 THEN '{"k": ' || k || '}' END AS result,
CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN event_type <> 'error' THEN 'Tool ''' || event_type || ''' not found.' WHEN k % 2 = 0 THEN 'ValueError: even' END AS error,
CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type <> 'error' THEN 0 WHEN k % 2 = 1 THEN 1 ELSE 3 END AS attempts FROM e""")
def u1(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("event_type").alias("tool_name"), F.create_map(F.lit("k"), F.regexp_extract("props", "[0-9]+", 0)).alias("args"))
    out = U.run_tools(rows, {"double": _double, "error": _odd_only}, {"click": "double", "view": "double"}, retries=3)
    return out.select("event_id", "status", "result", "error", F.size("attempts").alias("attempts"))


# ---------------------------------------------------------------- streaming and file layouts

@query("x1_stream_validate", f"""WITH {X.ISSUES_SQL} SELECT CAST(conv_id AS VARCHAR) AS id, xml_valid, tool_results_match, reasoning_coherent, correction_demonstrated, ground_truth_reached, quality_score, array_to_string(issues, ' | ') AS issues FROM iss""")
def x1(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "stream")
    rows = B.trajectories(t).select(F.col("conv_id").cast("string").alias("id"), F.lit("").alias("question"), "ground_truth_answer", "trajectory", "reasoning_type", "tool_execution_log")
    rows.write.json(f"{base}/in")
    incremental.stream_validate(t.spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", max_files=2).awaitTermination()
    out = incremental.validated(t.spark, f"{base}/out")
    return out.select("id", *V.CHECKS, "quality_score", F.array_join("issues", " | ").alias("issues"))


def written_records(t: Tables, name: str, layout: str) -> str:
    """The conversations as record files in the shared folder."""
    turns = F.array(F.struct(F.lit("human").alias("from"), F.col("question").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("answer").alias("value")))
    rec = B.first_turns(t).select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("i/"), F.col("conv_id"), F.lit(".png")).alias("image"), turns.alias("conversations"))
    path = scratch_path(t.spark, name)
    readers.convert_json_layout(rec, path, layout)
    return path


RECORDS_SQL = f"WITH {QA_SQL} SELECT CAST(conv_id AS VARCHAR) AS id, 'i/' || conv_id || '.png' AS image_path, question, answer AS ground_truth_answer FROM qa WHERE question <> '' AND answer <> ''"


@query("s1_read_jsonl", RECORDS_SQL)
def s1(t: Tables) -> DataFrame:
    from ..operators.examples import normalize_examples

    path = written_records(t, "jsonl", "jsonl")
    t.spark.range(3).select(F.concat(F.lit('{"id": "'), F.col("id"), F.lit('", broken'))).write.mode("append").text(path)
    return normalize_examples(readers.read_examples_jsonl(t.spark, path), keep=["id"])


@query("s2_s7_read_json_array", RECORDS_SQL)
def s2(t: Tables) -> DataFrame:
    from ..operators.examples import normalize_examples

    return normalize_examples(readers.read_examples_json(t.spark, written_records(t, "array", "array")), keep=["id"])


@query("s2_large_array", f"""WITH {X.CONV_SQL} {X._pick_sql('last').replace("conv_id, ", "CAST(conv_id AS VARCHAR) AS id, ", 1)}""")
def s2_large(t: Tables) -> DataFrame:
    """Whole conversations in array files, each read by as many tasks as it has byte ranges."""
    from ..operators.examples import normalize_examples

    path = scratch_path(t.spark, "large-array")
    readers.convert_json_layout(X.whole_conversations(t).drop("conv_id"), path, "array")
    return normalize_examples(readers.read_examples_json(t.spark, path, arrays=True), "last", keep=["id"])


@query("s3_read_csv", """SELECT 'im' || o_orderkey || '.png' AS image_path, CASE WHEN o_orderkey % 3 = 0 THEN 'What conditions are present in this fundus image?' ELSE 'What is shown in this fundus image?' END AS question,
CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || ', it''s ' || o_orderstatus WHEN 1 THEN o_orderpriority ELSE '42' END AS ground_truth_answer FROM orders WHERE o_orderkey % 7 <> 0""")
def s3(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    cats = (
        F.when(k % 7 == 0, "[]").when(k % 3 == 0, F.concat(F.lit("['"), "o_orderpriority", F.lit("', \"it's "), "o_orderstatus", F.lit("\"]")))
        .when(k % 3 == 1, F.concat(F.lit("['"), "o_orderpriority", F.lit("']"))).otherwise("42"))
    rows = t.orders.select(k.alias("idx"), F.concat(F.lit("im"), k, F.lit(".png")).alias("image"), F.lit("[]").alias("atributes"), cats.alias("categories"))
    path = scratch_path(t.spark, "csv")
    rows.write.option("escape", '"').csv(path, header=True)
    return readers.read_examples_csv(t.spark, path)


@query("s4_read_dataset_dir", f"WITH {QA_SQL} SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, count(*) AS n FROM qa GROUP BY 1")
def s4(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "datasets")
    fs, root = index_store._fs(t.spark, base)
    Path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, half in (("even", 0), ("odd", 1)):
        part = B.first_turns(t).where(F.col("conv_id") % 2 == half).select(F.col("conv_id").cast("string").alias("id"), "question", "answer")
        part.coalesce(1).write.json(f"{base}-{name}")
        made = [s.getPath() for s in fs.listStatus(Path(f"{base}-{name}")) if s.getPath().getName().startswith("part-")]
        fs.mkdirs(root)
        fs.rename(made[0], Path(f"{base}/{name}.jsonl"))
    return readers.read_dataset_dir(t.spark, base).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("s5_read_corpus", "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM benchmark")
def s5(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "corpus")
    t.benchmark.select("text", "item_id").write.partitionBy("item_id").option("lineSep", "\n").text(base)  # one folder per item
    docs = readers.read_corpus(t.spark, base, pattern="*.txt")
    return docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.regexp_replace("content", "\n$", ""))).alias("chars"))


@query("s6_measurements_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS Name, round(c_acctbal, 4) AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer")
def s6(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "measures")
    readers.write_measurements(t.customer.select(F.col("c_custkey").cast("string").alias("Name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")), path)
    return readers.read_measurements(t.spark, path).withColumn("balance", r6("balance", 4))
