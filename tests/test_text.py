import random
import re
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolytics.functions import chunks as C
from annolytics.functions.phrases import Phrases
from annolytics.operators import chunking as K
from annolytics.operators import retrieval as R
from annolytics.operators.embedding import embed, hashed_words
from annolytics.operators.tools import run_tools, with_retry
from annolytics.session import BATCH_BYTES, scratch_path
from annolytics.sources import index_store as store

TEXT = "One two. Three four! Five?\n\nSix 七。八！" + "x" * 30 + ". " + "tail words here " * 5


def one(spark, text):
    return spark.createDataFrame([("d", text)], "doc_id string, text string")


def test_fixed(spark):
    got = K.chunk_fixed(one(spark, "abcdefghij" + " " * 10 + "xyz"), ["doc_id"], 5, 0).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.start_char, r.text) for r in got] == [(0, 0, "abcde"), (1, 5, "fghij"), (2, 20, "xyz")]
    assert got[-1].end_char == 25  # past the end
    tail = K.chunk_fixed(one(spark, "abcdefgh"), ["doc_id"], 5, 2).orderBy("chunk_id").collect()
    assert [r.text for r in tail] == ["abcde", "defgh", "gh"]  # the tail inside the overlap stays
    assert K.chunk_fixed(one(spark, ""), ["doc_id"]).count() == 0
    solid = TEXT.strip()  # a blank last chunk would be skipped
    whole = "".join(r.text for r in K.chunk_fixed(one(spark, solid), ["doc_id"], 7, 0).orderBy("chunk_id").collect())
    assert whole == solid
    with pytest.raises(ValueError):
        C.fixed_chunks("text", 5, 5)


def sentences(text, seps=C.SENTENCE_SEPARATORS):
    out, at, i = [], 0, 0
    while i < len(text):
        hit = next((s for s in seps if text.startswith(s, i)), None)
        if hit:
            i += len(hit)
            out.append(text[at:i])
            at = i
        else:
            i += 1
    out.append(text[at:])
    return [s for s in out if s.strip()]


def packed(parts, size, overlap):
    out, cur = [], []
    for s in parts:
        if cur and sum(map(len, cur)) + len(s) > size:
            out.append(cur)
            cur = cur[-overlap:] if overlap and len(cur) > overlap else []
        cur = cur + [s]
    return out + ([cur] if cur else [])


@pytest.mark.parametrize("text", [TEXT, "", "a\n\n\nb", "no end", "x\u0001y. \u0001\u0003z. ", ". . ! ?", "long " * 400 + ". end"])
def test_sentences(spark, text):
    assert one(spark, text).select(C.split_sentences("text")).first()[0] == sentences(text)


@pytest.mark.parametrize("size,overlap", [(20, 1), (40, 2), (15, 0), (1000, 1), (25, 3)])
def test_sentence_packing(spark, size, overlap):
    text = " ".join(f"w{i} " * (i % 5) + "end. " for i in range(40)) + "y" * 60 + ". z"
    got = K.chunk_sentences(one(spark, text), ["doc_id"], size, overlap).orderBy("chunk_id").collect()
    want = packed(sentences(text), size, overlap)
    assert [(r.text, r.sentence_count) for r in got] == [("".join(c), len(c)) for c in want]


def test_recursive(spark):
    assert C.recursive_pieces("aaa bbb ccc", 3, 0, [" ", ""]) == ["aaa", "bbb", "ccc"]
    # trailing characters of the separator are stripped as a set, the overlap goes in front
    assert C.recursive_pieces("xx. .. yy. zz", 4, 2, [". ", ""]) == ["xx", "xx", "yy", "yyzz"]
    got = [r.text for r in K.chunk_recursive(one(spark, TEXT), ["doc_id"], 20, 0).orderBy("chunk_id").collect()]
    assert got and all(len(g) <= 31 for g in got)
    assert "".join("".join(g.split()) for g in got).replace(".", "").replace("?", "").replace("!", "")[:10] == "OnetwoThre"


def test_semantic(spark):
    rows = K.chunk_semantic(one(spark, "Cat sat. Cat sat. Dog ran. Dog ran. "), ["doc_id"], 0.5, 5, 1000).orderBy("chunk_id").collect()
    assert [r.text for r in rows] == ["Cat sat. Cat sat. ", "Dog ran. Dog ran. "]
    assert rows[0].avg_similarity == pytest.approx(0.5) and rows[1].avg_similarity is None
    single = K.chunk_semantic(one(spark, "only one"), ["doc_id"]).first()
    assert (single.chunk_id, single.text) == (None, "only one")
    # minimum length beats dissimilarity, maximum length cuts similar ones
    assert K.chunk_semantic(one(spark, "Cat sat. Dog ran. "), ["doc_id"], 0.5, 100, 1000).count() == 1
    assert K.chunk_semantic(one(spark, "Cat sat. Cat sat. "), ["doc_id"], 0.5, 5, 12).count() == 2


def test_separators_that_overlap(spark):
    assert C._apart(C.SENTENCE_SEPARATORS) and not C._apart([". ", " -"]) and not C._apart(["ab", "b"])
    rng = random.Random(6)
    texts = ["".join(rng.choices([". ", " ", "-", "a", "\n", "\n\n", "! ", "\u0001", "\u0001\u0003", "。"], k=30)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for separators in (C.SENTENCE_SEPARATORS, [". ", " -", "-"]):
        either = "|".join(map(re.escape, separators))
        for r in df.select("text", C.split_sentences("text", separators).alias("s")).collect():
            ends = [m.end() for m in re.finditer(either, r.text)]
            want = [r.text[a:b] for a, b in zip([0, *ends], [*ends, len(r.text)])]
            assert r.s == [x for x in want if x.strip()]


def plain_semantic(sentences, whole, fn, threshold, low, high):
    if len(sentences) < 2:
        return [(None, whole, None)] if sentences else []
    v = fn(sentences)
    norm = np.linalg.norm(v, axis=1)
    sims = [float(a @ b / (x * y)) if x and y else None for a, b, x, y in zip(v, v[1:], norm, norm[1:])]
    out, first = [], 0
    for i, sim in enumerate(sims):
        used = sum(map(len, sentences[first:i + 1]))
        if used >= low and ((sim is not None and sim < threshold) or used + len(sentences[i + 1]) > high):
            joints = sims[first:i + 1]
            out.append((len(out), "".join(sentences[first:i + 1]), None if None in joints else round(sum(joints) / len(joints), 9)))
            first = i + 1
    return [*out, (len(out), "".join(sentences[first:]), None)]


def test_semantic_over_batches(spark):
    rng = random.Random(4)
    words = ["eye", "disc", "cup", "vein", "...", "#"]
    docs = [(i, "".join(" ".join(rng.choices(words, k=rng.randint(1, 5))) + rng.choice([". ", "! ", "\n\n"]) for _ in range(rng.randint(0, 40)))) for i in range(30)]
    docs += [(40, None), (41, ""), (42, " \n "), (43, "one  "), docs[0]]
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("chunk", F.lit("x"))
    fn = hashed_words(16)
    cut = {r.doc_id: r.s for r in df.select("doc_id", C.split_sentences("text").alias("s")).collect()}
    want = sorted((d, *c) for d, t in docs for c in plain_semantic(cut[d] or [], t, fn, 0.4, 10, 60))
    rows = lambda d: sorted((r.doc_id, r.chunk_id, r.text, r.avg_similarity and round(r.avg_similarity, 9)) for r in d.collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, chars in ((before, 1 << 20), ("3", 1 << 20), ("50", 30)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = rows(K.chunk_semantic(df, ["doc_id", "chunk"], 0.4, 10, 60, fn, embed_chars=chars))
            assert [(d, -1 if n is None else n, t, s) for d, n, t, s in got] == [(d, -1 if n is None else n, t, s) for d, n, t, s in want]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert list(K.in_slices([5, 5, 5, 90, 1], 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_a_long_document_is_embedded_in_parts(spark):
    def fn(texts):
        if sum(map(len, texts)) > 50_000:
            raise ValueError("too many at a time")
        return np.ones((len(texts), 2))

    long = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("Eye and disc. "), 300_000).alias("text"))
    got = K.chunk_semantic(long, ["doc_id"], 0.5, 100, 1000, fn, embed_chars=50_000)
    r = got.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("most")).first()
    assert (r.n, r.chars, r.most) == (-(-300_000 // 71), 300_000 * 14, 71 * 14)


def test_hybrid_weights(spark):
    d = one(spark, TEXT)
    parts = [K.chunk_fixed(d, ["doc_id"], 20, 0), K.chunk_semantic(d, ["doc_id"])]
    out = K.chunk_hybrid(parts, [1, 3]).select("hybrid_strategy_index", "hybrid_weight", "chunking_strategy").distinct().collect()
    assert {tuple(r) for r in out} == {(0, 0.25, "hybrid_fixed_size"), (1, 0.75, "hybrid_semantic")}
    with pytest.raises(ValueError):
        K.chunk_hybrid(parts, [1])


def test_document_assembly(spark):
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), ("d", 3, "  ")], "doc_id string, page int, text string")
    tables = spark.createDataFrame([("d", 2, 1, [["h1", "h2"], ["a", None]])], "doc_id string, page int, table_no int, rows array<array<string>>")
    r = K.assemble_document(pages, tables).first()
    assert (r.page_count, r.table_count) == (3, 1)
    assert r.content == "[页码 1]\none\n\n[页码 2]\ntwo\n\n\n\n=== 提取的表格 ===\n\n[表格 1 - 页码 2]\nh1 | h2\n-------\na | "
    flags = K.needs_ocr(spark.createDataFrame([("x" * 60, 1), ("x" * 60, 2), (" " * 60, 1), (None, 0)], "content string, page_count int"))
    assert [f.needs_ocr for f in flags.collect()] == [False, True, True, True]


def test_embedding_contract(spark):
    d = spark.createDataFrame([("a b a",), (None,)], "text string")
    v = [r.embedding for r in embed(d).collect()]
    assert sum(v[0]) == 3 and sum(v[1]) == 0 and (hashed_words(64)(["a b a"])[0] == v[0]).all()
    with pytest.raises(Exception, match="expected dimension"):
        embed(d, fn=lambda t: np.zeros((len(t), 3)), dim=4).collect()


def sizes_of_batches(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return [r.n for r in df.coalesce(1).mapInArrow(run, "n long").collect()]


@pytest.mark.parametrize("step", ["embed", "phrases"])
def test_python_workers_get_a_few_mb_at_a_time(spark, step):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    long_texts = spark.range(2500).select(F.concat(F.col("id").cast("string"), F.lit(" ab" * 3000)).alias("text"))
    try:
        for given, left in (("64m", BATCH_BYTES), ("1g", BATCH_BYTES), ("300k", 300 << 10)):
            spark.conf.set(name, given)
            made = embed(long_texts) if step == "embed" else long_texts.select("text", Phrases(["9 ab"]).find("text").alias("f"))
            assert max(sizes_of_batches(long_texts)) * 9000 < 1.5 * left
        if step == "embed":
            got = {r.text: r.embedding for r in made.collect()}
            assert all((hashed_words(64)([t])[0] == v).all() for t, v in got.items()) and len(got) == 2500
        else:
            assert all((r.f == [1]) == ("9 ab" in r.text) for r in made.collect())
    finally:
        spark.conf.set(name, before)


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, (120, 8)).round(2)
    v[50:60] = v[0]  # ties
    v[60] = 0
    q = rng.normal(0, 1, (9, 8)).round(2)
    vec = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id int, embedding array<double>").repartition(5)
    return v, q, vec, spark.createDataFrame([(f"q{i}", r.tolist()) for i, r in enumerate(q)], "query_id string, query_vec array<double>")


def expected(v, q, k, metric):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    s = unit(q) @ unit(v).T if metric == "cosine" else q @ v.T if metric == "ip" else 1 / (1 + ((q[:, None] - v) ** 2).sum(2))
    s = s.round(10)
    return {(f"q{i}", r + 1): int(j) for i, row in enumerate(s) for r, j in enumerate(sorted(range(len(row)), key=lambda j: (-row[j], j))[:k])}


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_search_equals_brute_force(vectors, metric):
    v, q, vec, queries = vectors
    index = R.build_index(vec, 8, metric)
    want = expected(v, q, 6, metric)
    for block_bytes in (1 << 20, 300):  # one block of queries, then many
        got = {(r.query_id, r["rank"]): r.vec_id for r in R.search(index, queries, 6, block_bytes=block_bytes).collect()}
        assert got == want
    assert R.search(index, queries, 500).count() == 9 * 120


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_blocks_out_of_reach_are_skipped(metric):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 4)) * np.geomspace(20, 0.01, 900)[:, None]
    v[300:600] = v[7]  # a third of all vectors is equal
    if metric == "cosine":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, k = v[[7, 0, 850]] + 0.001, 5
    ids = pa.array(rng.permutation(900))
    rows, place = R._in_order(v, ids, np.arange(900), k)
    assert len(rows) <= 600 + k
    best = R.BestRows(metric, q, pa.array(["a", "b", "c"]), k)
    for at in range(0, len(rows), 60):
        part = rows[at:at + 60]
        part = part[np.argsort(place[part])]
        best.add(v[part], ids.take(pa.array(part)), R.Ball.unpack(R.Ball.around(v[part]).pack()))
    (got,) = best.batch(["q", "id", "score"])
    s = R._scores(metric, v, q).round(12)
    want = {("abc"[i], int(ids[int(j)].as_py())) for i in range(3) for j in sorted(range(900), key=lambda j: (-s[i, j], ids[j].as_py()))[:k]}
    assert set(zip(got["q"].to_pylist(), got["id"].to_pylist())) == want and got.num_rows == 3 * k
    assert metric == "cosine" or best.skipped > 5


def test_texts_are_read_where_hits_are(spark, vectors):
    v, q, vec, queries = vectors
    texts = vec.withColumn("text", F.concat(F.lit("text "), "vec_id"))
    index = R.build_index(texts, 8)
    path = scratch_path(spark, "rows")
    store.save_index(index, path, buckets=40)
    back = store.load_index(spark, path)
    want = {(q_, j, f"text {j}") for (q_, _), j in expected(v, q, 2, "cosine").items() if q_ == "q0"}
    one = queries.where("query_id = 'q0'")
    for each in (index, back, R.add_vectors(back, texts.limit(0))):
        got = R.retrieve(each, one, 2)
        assert {(r.query_id, r.vec_id, r.text) for r in got.collect()} == want
    # folders without a hit are not opened: a broken file in them does no harm
    bucket = {r.vec_id: r.id_bucket for r in back.rows.collect()}
    without = sorted(set(bucket.values()) - {bucket[j] for _, j, _ in want})[-8:]
    for b in without:
        with open(f"{path}/rows/id_bucket={b}/part-broken.parquet", "wb") as f:
            f.write(b"no parquet")
    back = store.load_index(spark, path)
    got = R.retrieve(back, one, 2)
    assert {(r.query_id, r.vec_id, r.text) for r in got.collect()} == want
    with pytest.raises(Exception, match="part-broken"):
        back.rows.collect()
    assert got._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2  # one search
    assert R.retrieve(back, queries.limit(0), 2).count() == 0
    again = scratch_path(spark, "again")
    store.save_index(R.build_index(vec, 8), again)  # no other columns
    assert R.retrieve(store.load_index(spark, again), one, 2).count() == 2
    store.clear_index(spark, path)


def test_ivf_and_store(spark, vectors):
    v, q, vec, queries = vectors
    flat = R.build_index(vec, 8)
    ivf = R.build_ivf(flat, 6)
    exact = {(r.query_id, r["rank"]): r.vec_id for r in R.search(flat, queries, 5).collect()}
    assert {(r.query_id, r["rank"]): r.vec_id for r in R.search(ivf, queries, 5).collect()} == exact
    wide = R.build_ivf(flat, 30)
    # with fewer cells than there are: the exact answer over the probed cells
    cells = {r.vec_id: r.cell for r in wide.vectors.collect()}
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    for n in (3, 10):
        want = set()
        for i, row in enumerate(unit(q)):
            away = ((wide.centroids - row) ** 2).sum(axis=1)
            probed = set(np.argsort(away, kind="stable")[:n].tolist())
            s = (unit(v) @ row).round(10)
            near = sorted((j for j in range(len(v)) if cells[j] in probed), key=lambda j: (-s[j], j))[:5]
            want |= {(f"q{i}", r + 1, j) for r, j in enumerate(near)}
        got = R.search(wide, queries, 5, nprobe=n)
        assert {(r.query_id, r["rank"], r.vec_id) for r in got.collect()} == want
    path = scratch_path(spark, "t")
    with pytest.raises(FileNotFoundError):
        store.load_index(spark, path)
    store.save_index(ivf, path)
    back = store.load_index(spark, path)
    assert (back.dimension, back.kind, back.metric, len(back.centroids)) == (8, "ivf_flat", "cosine", 6)
    assert back.nprobe == 10 and R.search(back, queries, 5, nprobe=2).count() > 0
    plan = R.search(back, queries, 5, nprobe=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "dynamicpruning" in plan
    more = R.add_vectors(back, spark.createDataFrame([(999, q[0].tolist())], "vec_id int, embedding array<double>"))
    assert R.search(more, queries.where("query_id = 'q0'"), 1).first().vec_id == 999
    assert R.index_stats(more).first().total_vectors == 121
    store.clear_index(spark, path)
    with pytest.raises(FileNotFoundError):
        store.load_index(spark, path)


def test_dimension_and_empty_index(spark, vectors):
    _, _, vec, queries = vectors
    with pytest.raises(Exception, match="vector dimension"):
        R.build_index(vec, 7).vectors.collect()
    assert R.search(R.build_index(vec.limit(0), 8), queries, 3).count() == 0


def test_context(spark):
    hits = spark.createDataFrame([("q", 2, "B" * 300, 0.5, "f.pdf"), ("q", 1, "A", 0.9, None)], "query_id string, rank int, text string, score double, filename string")
    r = R.build_context(hits).first()
    assert r.context == "[文档1] 来源: unknown, 页码: N/A\nA\n\n[文档2] 来源: f.pdf, 页码: N/A\n" + "B" * 300
    assert r.sources[1].text == "B" * 200 + "..."


def test_tools(spark):
    calls = spark.createDataFrame([("half", {"x": "4"}), ("alias", {"x": "5"}), ("none", {}), ("half", {"y": "1"})], "tool_name string, args map<string,string>")
    out = run_tools(calls, {"half": lambda x: {"v": int(x) / 2}}, {"alias": "half"}, retries=2).collect()
    assert [(r.status, r.result) for r in out[:2]] == [("success", '{"v": 2.0}'), ("success", '{"v": 2.5}')]
    assert out[2].error == "Tool 'none' not found." and out[3].error.startswith("TypeError") and [a.attempt for a in out[3].attempts] == [1, 2]
    seen = []
    value, tries = with_retry(lambda: seen.append(1) or (1 / (len(seen) - 1)), 3)()
    assert value == 1.0 and [t["success"] for t in tries] == [False, True]


def test_phrases_in_one_pass(spark):
    from annolytics.functions.phrases import Phrases
    from annolytics.functions.text import rule_phrases
    from annolytics.plans import rules as R

    words = rule_phrases([*R.MEDICAL_RULES, *R.CORRECTION_RULES])
    assert len(words) == len(set(words)) > 62
    rng = random.Random(1)
    texts = ["".join(rng.choice([*words, " ", "x", "macular ", "age-", "dr"]) for _ in range(rng.randint(0, 6))) for _ in range(200)] + ["", None, "macular degeneration", "x" * 100_000]
    phrases = Phrases(words)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("b", phrases.find("t"))
    hits = phrases.hits({"a": "b"})
    got = df.select("i", *[hits("a", [w]).alias(f"w{k}") for k, w in enumerate(words)], hits("a", words).alias("any"), hits("a", []).alias("none")).collect()
    for r in got:
        t = texts[r.i]
        want = [None if t is None else w in t for w in words]
        assert list(r)[1:-2] == want and r.none is False and r.any == (None if t is None else any(want))


def test_frequent_answers(spark):
    from annolytics.operators import stats as S

    rng = random.Random(2)
    data = [(f"answer {min(int(rng.expovariate(0.2)), 60)}", "A" if i % 5 == 0 else None) for i in range(3000)] + [(None, None)] * 50 + [(f"once {i}", None) for i in range(500)]
    df = spark.createDataFrame(data, "ground_truth_answer string, label string")
    exact = {(r.answer, r.n) for r in S.top_answers(df.where("ground_truth_answer is not null"), 8).collect()}
    assert {(r.answer, r.n) for r in S.frequent_answers(df, 8).collect()} == exact
    assert {(r.answer, r.n) for r in S.frequent_answers(df, 8, tracked=100).collect()} == exact  # fewer tracked than there are
    assert S.frequent_answers(df.where("false")).count() == 0
