"""The thin queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, langid, lm_score, ngram_join, packing, quality, spelling, suffix_dedup, token_counts, topk, url_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_decontaminate",
    r"""
    WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w != '') AS w FROM documents),
    bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w != '') AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
    hits AS (SELECT doc_id, item_id, s, n FROM places JOIN windows USING (n, win)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query(
    "op4_lm_score",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w != '') AS ws
        FROM documents WHERE doc_id IS NOT NULL),
    p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM (SELECT r, doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d)),
    c1 AS (SELECT w, count(*) AS n FROM p GROUP BY w), c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w),
    total AS (SELECT count(*) AS n FROM p),
    s AS (SELECT doc_id, CAST(round(1000000 * ln(CASE WHEN p.v IS NULL THEN CAST(w.n AS DOUBLE) / total.n WHEN c2.n >= 2 THEN CAST(c2.n AS DOUBLE) / v.n
            ELSE CAST(0.4 AS DOUBLE) * w.n / total.n END)) AS BIGINT) AS m
        FROM p CROSS JOIN total JOIN c1 w ON p.w = w.w LEFT JOIN c1 v ON p.v = v.w LEFT JOIN c2 ON p.v = c2.v AND p.w = c2.w),
    t AS (SELECT doc_id, count(*) AS n, CAST(sum(m) AS BIGINT) AS m FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS logprob_micro, CASE WHEN n > 0 THEN CAST(m AS DOUBLE) / CAST(1000000 AS DOUBLE) / n END AS score
    FROM (SELECT DISTINCT doc_id FROM d) LEFT JOIN t USING (doc_id)
    """,
)
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


#: Fixed rules of the URL query: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


@query(
    "op9_url_filter",
    r"""
    WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
    parts AS (SELECT row_number() OVER () AS r, page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
    best AS (SELECT r, max_by(h || p, len(h || p) * 1000 + len(h)) AS rule, max_by(v, len(h || p) * 1000 + len(h)) AS v
        FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)
    """,
)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


@query(
    "op3_exact_top_k",
    """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
    """,
)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def fold(column: str, folds: int) -> Column:
    """Fold of a row by its id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    dictionaries = langid.fit_dictionaries(docs.where(~held_out), F.col("doc_id"))
    judged = langid.identify(docs.select("doc_id", "text"), dictionaries)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_chat_format")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts without role columns, made of whole conversations: two turns of three keep a speaker marker
    in one of three styles. The model learns from conversations of other folds."""
    turns = table(spark, sf_dir, "conversations")
    h = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(9))
    name = F.initcap("role")
    marker = F.when(h < 3, F.lit("")).when(h < 5, F.concat(name, F.lit(": "))).when(h < 7, F.concat(F.lit("### "), name, F.lit(":\n"))).otherwise(F.concat(F.lit("["), name, F.lit("]: ")))
    parts = turns.select(F.col("conv_id").alias("transcript"), F.col("turn").alias("part"), F.concat(marker, "text").alias("text"), "role")
    model = chat.fit_on(parts.where(fold("transcript", 4) != 2))
    return chat.parse(parts.drop("role"), model).withColumnsRenamed({"transcript": "conv_id"})


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return packing.pack(pieces, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    weights = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.repeated_spans(docs, size=50)

    def words(spans: str) -> Column:
        return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).cast("long")

    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", words("spans").alias("n_repeated"), words("later").alias("n_cut"), (words("spans") > 0).alias("repeated"), "spans", "later"
    )


@query(
    "op11_spelling_variants",
    r"""
    WITH RECURSIVE runs AS (SELECT doc_id, r, count(*) AS c FROM (SELECT doc_id,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents WHERE text IS NOT NULL)
        WHERE length(r) >= 7 GROUP BY ALL),
    points AS (SELECT r, c, list_transform(range(1, length(k) + 1), lambda i: unicode(substr(k, i, 1))) AS p FROM (SELECT *, CAST(doc_id AS VARCHAR) || ':' || r AS k FROM runs)),
    bytes AS (SELECT r, c, flatten(list_transform(p, lambda x: CASE WHEN x < 128 THEN [x] ELSE [195, x - 64] END)) AS b FROM points),
    hashes AS (SELECT r, c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(b, lambda x: [(x & 15)::BIGINT, (x >> 4)::BIGINT]))),
        lambda s, x: xor(s >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[(xor(s, x) & 15) + 1]))) AS h FROM bytes),
    v AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w FROM hashes)
        WHERE length(w) >= 7 GROUP BY w HAVING sum(c) >= 2),
    cuts AS (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS d FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v)),
    near AS (SELECT a.w AS word, a.n, b.w AS form, b.n AS form_n FROM cuts a JOIN cuts b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
        UNION SELECT a.w, a.n, b.w, b.n FROM cuts a JOIN v b ON a.d = b.w UNION SELECT b.w, b.n, a.w, a.n FROM cuts a JOIN v b ON a.d = b.w),
    numbers AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
    forms AS (SELECT word, form, form_n FROM near WHERE form_n >= 10 * n QUALIFY row_number() OVER (PARTITION BY word ORDER BY form_n DESC, form) = 1),
    chains AS (SELECT word, form, form_n FROM forms UNION ALL SELECT c.word, f.form, f.form_n FROM chains c JOIN forms f ON c.form = f.word),
    roots AS (SELECT word, max_by(form, form_n) AS root FROM chains GROUP BY word)
    SELECT v.w AS word, form, coalesce(root, v.w) AS root, n, coalesce(n_near, 0) AS n_near, form_n
    FROM v LEFT JOIN numbers ON v.w = numbers.word LEFT JOIN forms ON v.w = forms.word LEFT JOIN roots ON v.w = roots.word
    """,
)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.word_runs(table(spark, sf_dir, "documents"), min_length=7)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "word").cast("binary"))
    place = (h % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.length("word")))
    words = runs.select(F.when(h % 31 == 0, cut).otherwise(F.col("word")).alias("word"))
    return spelling.variants(spelling.vocabulary(words, min_length=7, min_count=2), factor=10)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(table(spark, sf_dir, "documents"), *files)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return alignment.count_links(aligned.withColumn("groups_sha256", digest).drop("groups"))


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")
