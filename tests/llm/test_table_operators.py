"""URL filter, top-k search, chat transcripts and the pipeline on small tables."""

import itertools
import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annolytics.llm import catalog, chat, topk, url_filter
from annolytics.llm.words import grouped


def plain_rule(url, rules):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, "allow"
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate(cases.LOWER), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/en/", "https://a.example.com/en/71?x#y", "http://example.com/en/8", "ftp://xcom/en/1", "a://b://c.com/en/1", "http://.com/en/", "http://com./en/",
            "http://net/de/#", "http://w.example.net/de/8/9", "http://org?/es/", "http://é.org/es/\n", "http://user@h.com:80/en/", "x://a.b.c.d.e.f.org/es/" + "z" * 5000]
    pages = spark.createDataFrame([(i % 12, u, "h") for i, u in enumerate(urls * 2)], "page_id long, url string, host string").withColumn("key", F.lit(1))
    rules = [*catalog.URL_RULES, ("É.org", "/", "block")]
    entries = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, entries)
    lowered = [(h.translate(cases.LOWER), p, v) for h, p, v in rules]
    rows = got.collect()
    assert len(rows) == len(urls) * 2 and "key" in got.columns
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_rule(r["url"], lowered)
    assert {r["verdict"] for r in url_filter.judge_urls(pages, entries.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), entries).count() == 0


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://a.net/de/1", "http://x.example.net/de/8", "http://a.org/es/", "http://a.net/fr/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in catalog.op9_url_filter(spark, str(tmp_path)).collect()}
    assert got == {
        0: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: ("net/de/", "allow"),
        3: ("example.net/de/8", "block"), 4: ("org/es/", "block"), 5: (None, "allow"),
    }


def test_bloom_has_no_false_misses(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    table = url_filter.bloom(keys)
    assert keys.where(~url_filter.maybe_listed(F.col("key"), table)).count() == 0
    others = spark.range(3000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert others.where(url_filter.maybe_listed(F.col("key"), table)).count() < 150


@pytest.mark.parametrize("values", [1 << 17, 200])
def test_top_k(spark, monkeypatch, values):
    monkeypatch.setattr(topk, "BLOCK_VALUES", values)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (None, [1.0] * 6), (405, [1e9] * 6), (406, [1.0, 2.0]), (410, [3.0, 1.0]), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x")).withColumn("n", F.lit(1))
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable[i] = [int(np.floor(256 * x)) for x in v]
    want = set()
    for q, a in usable.items():
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable.items() if i != q and len(a) == len(b))
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), k=5)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert topk.top_k(df, df.limit(0), k=5).count() == 0 == topk.top_k(df.limit(0), df, k=5).count()


def test_top_k_with_several_vectors_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0]), (10, [0.0, 1.0]), (10, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), k=4).orderBy("query_id", "rank").collect()
    vectors = {(i, tuple(int(256 * x) for x in v)) for i, v in rows}
    want = []
    for q in (0, 10):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, a in vectors if j == q for i, b in vectors if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:4])]
    assert [tuple(r) for r in got] == want
    assert want[:3] == [(0, 1, 1, 65536), (0, 2, 1, 32768), (0, 3, 10, 32768)]


# -- chat


def plain_viterbi(model, marker, feature):
    e = model.emission(np.array(marker), np.array(feature))
    best = None
    for path in itertools.product(range(len(chat.STATES)), repeat=len(marker)):
        total = model.start[path[0]] + e[0][path[0]]
        for i in range(1, len(path)):
            total += model.move[path[i - 1], path[i]] + e[i][path[i]]
        if best is None or total > best[0] + 1e-9:
            best = (total, path)
    return best


def test_blocks_give_the_best_path():
    rng = np.random.default_rng(9)
    n = len(chat.STATES)
    model = chat.Model(*(rng.integers(0, 9, s).astype(float) for s in (n, (n, n), (n, chat.MARKER_KINDS), (n, chat.N_FEATURES))))
    for _ in range(6):
        marker, feature = rng.integers(0, chat.MARKER_KINDS, 5), rng.integers(0, chat.N_FEATURES, 5)
        total, path = plain_viterbi(model, marker, feature)
        e = model.emission(marker, feature)
        cuts = [(0, 2), (2, 3), (3, 5)]
        ends = chat.join_paths([chat.block_matrix(model, e[a:b], a == 0) for a, b in cuts], None)
        got = [s for (a, b), before, after in zip(cuts, [None, *ends], ends) for s in chat.block_path(model, e[a:b], before, after)]
        score = model.start[got[0]] + e[0][got[0]] + sum(model.move[p, q] + e[i + 1][q] for i, (p, q) in enumerate(zip(got, got[1:])))
        assert abs(score - total) < 1e-9


def test_chat_format(spark, monkeypatch):
    rng = random.Random(2)
    roles = {"user": "User: ", "assistant": "Assistant: "}
    rows = []
    for c in range(60):
        for t in range(6):
            role = ("user", "assistant")[t % 2]
            body = "\n".join(cases.sentence(rng, 5, ["so", "then", "why"]) + ("?" if role == "user" else ".") for _ in range(2))
            rows.append((c, t, ("" if c % 3 == 0 and t == 3 else roles[role]) + body, role))
    rows += [(70, 0, None, "user"), (71, 0, "  \n ", "user"), (72, 5, "User: hi\n\nAssistant:\nyes <|im_end|>", None), (None, 0, "x", None), rows[0]]
    df = spark.createDataFrame(rows, "transcript long, part long, text string, role string").withColumn("block", F.lit(9)).withColumn("turn", F.lit(0))
    model = chat.fit_on(df.where("transcript % 2 = 1"))
    got = {}
    for size in (256, 2):
        monkeypatch.setattr(chat, "BLOCK", size)
        got[size] = sorted(map(tuple, chat.parse(df, model).collect()))
    assert got[256] == got[2]
    found = {(c, t): (role, text, shown) for c, t, role, text, shown in got[256]}
    for c, t, text, role in rows[:360]:
        assert found[c, t][:2] == (role, text.removeprefix(roles[role]))
    assert found[72, 0][:2] == ("user", "hi") and found[72, 1] == ("assistant", "yes <|im_end|>", "<|im_start|>assistant\nyes <im_end><|im_end|>\n")
    assert not any(c in (70, 71, None) for c, _ in found)
    assert chat.parse(df.limit(0), model).count() == 0


def test_chat_turns_of_one_line(spark):
    rng = random.Random(3)
    rows = []
    for c in range(80):
        for t in range(8):
            role = ("user", "assistant")[t % 2]
            body = "\n".join(cases.sentence(rng, 5, ["so", "then", "why"]) + ("?" if role == "user" else ".") for _ in range(1 if role == "user" else 2))
            rows.append((c, t, ("" if t % 3 == 1 else f"{role.title()}: ") + body, role))
    rows += [(90, 0, "Narrator: once upon a time", "narrator"), (90, 1, "User: x?", "user")]
    df = spark.createDataFrame(rows, "transcript long, part long, text string, role string")
    for borders in (True, False):
        model = chat.fit_on(df.where("transcript % 2 = 1 OR transcript = 90"), borders=borders)
        user, goes_on = (chat.STATES.index((1, opens)) for opens in (1, 0))
        assert np.exp(model.move[user, chat.STATES.index((2, 1))]) > 0.9  # the state after a line of its own
        assert np.exp(model.move[user, goes_on]) < 0.1
        found = {(r["transcript"], r["turn"], r["role"], r["text"]) for r in chat.parse(df.where("transcript < 90"), model, borders=borders).collect()}
        want = {(c, t, role, text.removeprefix(f"{role.title()}: ")) for c, t, text, role in rows if c < 90}
        assert len(found & want) > 0.98 * len(want)


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    rows = cases.texts()
    docs = cases.documents(spark, rows).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    base = rows[0][1].split()
    item = rows[-8][1].split()[:12]
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, str(tmp_path))
        result.write.parquet(f"{tmp_path}/{i}")
        again = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "pack":
            assert again.columns == docs.columns
        out[name], docs = again.collect(), again
    assert [n for n, _ in corpus_pipeline.STAGES] == list(out)
    kept = [r["doc_id"] for r in out["near_duplicates"] if r["doc_id"] is not None]
    want = cases.jaccard_components([(r["doc_id"], r["text"]) for r in out["language_id"] if r["doc_id"] is not None], 5, 80)
    assert sorted(kept) == sorted(i for i, (_, c) in want.items() if c == i)
    cut = cases.repeats([(r["doc_id"], r["text"]) for r in out["near_duplicates"]], 50)
    after = {r["doc_id"]: r for r in out["repeated_passages"]}
    for r in out["near_duplicates"]:
        if r["doc_id"] is None:
            continue
        words = cases.alnum_words(r["text"])
        gone = {x for a, b in cut.get(r["doc_id"], ([], []))[1] for x in range(a, b)}
        left = [w for i, w in enumerate(words) if i not in gone]
        if gone and not left:
            assert r["doc_id"] not in after
        else:
            assert cases.alnum_words(after[r["doc_id"]]["text"]) == left and after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
    assert not any(" ".join(item[:10]) in " ".join(cases.alnum_words(r["text"])) for r in out["decontaminate"])
    assert {r["doc_id"] for r in out["pack"]} == {r["doc_id"] for r in out["decontaminate"]} and base


def test_groups_go_over_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1], [1, 2]), ([], []), ([1, 2], [3, 4]), ([2, 3], [5, 6]))]
    batches[1] = batches[1].cast(batches[0].schema)
    assert [(k, t.column("v").to_pylist()) for k, t in grouped(batches, ["k"])] == [((1,), [1, 2, 3]), ((2,), [4, 5]), ((3,), [6])]
