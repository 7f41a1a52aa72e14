"""Operators over texts against plain versions, on rows with nulls, copies, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolytics.llm import decontaminate, langid, lm_score, ngram_join, packing, quality, suffix_dedup
from annolytics.llm.words import ALNUM, BLANKS, hashed_words, map_batches, runs, shingles
from annolytics.session import BATCH_BYTES, materialize


def test_word_hashes_follow_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é.\n9—") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "a" * 3_000_000]
    for table, words in ((ALNUM, cases.alnum_words), (BLANKS, cases.blank_words)):
        seen = {}
        for first, hashes, bounds in hashed_words([t.encode() if t is not None else None for t in texts], table):
            for i in range(len(bounds) - 1):
                plain, got = words(texts[first + i]), hashes[bounds[i] : bounds[i + 1]].tolist()
                assert len(plain) == len(got)
                for w, h in zip(plain, got):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_texts_reach_workers_a_few_mb_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    long_texts = spark.range(2000).select(F.concat(F.col("id").cast("string"), F.lit(" ab" * 3000)).alias("text")).coalesce(1)
    spark.conf.set(name, "64m")
    try:
        sizes = [r.n for r in map_batches(long_texts, lambda batch: iter([{"n": [batch.num_rows]}]), "n long").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(sizes) == 2000 and max(sizes) * 9000 < 1.5 * BATCH_BYTES


def test_runs_tell_runs_apart():
    h = np.random.default_rng(0).integers(0, 3, 500).astype(np.uint64)
    by_hash = defaultdict(set)
    for i, r in enumerate(runs(h, 5).tolist()):
        by_hash[r].add(tuple(h[i : i + 5].tolist()))
    assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len({tuple(h[i : i + 5].tolist()) for i in range(496)})
    assert len(runs(h[:4], 5)) == 0 and len(shingles(h[:4], 5)) == 1


# -- decontamination


def plain_hits(text, items, size):
    w = cases.alnum_words(text)
    hit, found = set(), set()
    for name, item in items:
        b = cases.alnum_words(item)
        n = min(size, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == b[k : k + n]:
                    hit.update(range(at, at + n))
                    found |= {str(name)} if name is not None else set()
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_decontaminate(spark, block_bytes):
    rows = [r for r in cases.texts() if r[0] not in (90, 91, 92)]
    base = rows[0][1].split()
    items = [(1, " ".join(base[5:30])), (2, "Two WORDS"), (3, "one"), (4, None), (5, ""), (6, "..."), (10, " ".join(base[20:26])), (10, " ".join(base[20:26])), (11, " ".join(base[90:100])), (None, " ".join(base[24:40])), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    got = decontaminate.decontaminate(cases.documents(spark, rows), bench, block_bytes=block_bytes)
    assert set(cases.CLASHES) <= set(got.columns)
    seen = Counter()
    for r in got.withColumn("n", decontaminate.hit_words()).collect():
        n, hit, found = plain_hits(r["text"], items, 10)
        assert (r["n_words"], r["n"], r["items"]) == (n, len(hit), found)
        assert sorted(x for s in r["spans"] for x in range(s["start"], s["end"])) == hit
        seen[r["doc_id"], r["text"]] += 1
    assert seen == Counter(rows)


def test_decontaminate_empty_tables(spark):
    docs, bench = cases.documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).where("size(items) > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_search_equals_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        patterns = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(n)): [str(n)] for n in (1, 2, 3, 5, 5, 5)}
        tables = decontaminate.build_tables((b" ".join(p), i[0]) for p, i in patterns.items())
        spans, items = decontaminate.find_hits(words, tables, [], [])
        hit, found = set(), set()
        for p, i in patterns.items():
            for at in range(len(words) - len(p) + 1):
                if tuple(words[at : at + len(p)]) == p:
                    hit.update(range(at, at + len(p))), found.update(i)
        assert {x for s in spans for x in range(s["start"], s["end"])} == hit and items == sorted(found)


# -- n-gram Jaccard join


@pytest.mark.parametrize("size,percent,block", [(3, 90, 1 << 21), (5, 80, 300)])
def test_jaccard_join(spark, size, percent, block):
    rows = cases.texts()
    want = cases.jaccard_components([r for r in rows if r[0] is not None], size, percent)
    got = ngram_join.similar_groups(cases.documents(spark, rows), size, percent, block=block).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_join_empty(spark):
    assert ngram_join.similar_groups(cases.documents(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.similar_groups(cases.documents(spark, [(3, None)])).collect()] == [(3, 0, 3)]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        n = int(rng.integers(2, 120))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.3], rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)]))
        if len(b) and not np.array_equal(a, b) and ngram_join.linked(a, b, percent):
            assert np.intersect1d(ngram_join.segment_keys(a, percent), ngram_join.segment_keys(b, percent)).size


@pytest.mark.parametrize("percent", [80, 90])
def test_set_has_one_key_more_than_differences(percent):
    rng = np.random.default_rng(percent)
    for n in (3, 40, 333, 1000, 5000):
        ordered, most = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), 0
        for k in ngram_join.classes_of(n, percent):
            most += 1 + ngram_join.largest_difference(n, min(ngram_join.size_class(k, percent)[1], n * 100 // percent), percent)
        assert len(ngram_join.segment_keys(ordered, percent)) <= most or n < 40  # the smallest sets need finer cuts


@pytest.mark.parametrize("n,buckets", [(1, 1), (50_000, 400), (3000, 1 << 18)])
def test_packed_keys(n, buckets):
    rng = np.random.default_rng(n)
    keys = np.append(rng.integers(0, 2**64, n - 1, dtype=np.uint64), np.uint64(2**64 - 1))
    nodes = rng.integers(0, 2**48, n, dtype=np.uint64)
    keys[: n // 3] = keys[n // 3 : 2 * (n // 3)]  # of several sets
    rows = ngram_join.packed(keys, nodes, buckets)
    got = set()
    for batch in (rows.slice(0, rows.num_rows // 2), rows.slice(rows.num_rows // 2)):
        if batch.num_rows:
            got |= set(zip(*(x.tolist() for x in ngram_join.unpacked(batch, buckets))))
    assert got == {(k >> 20 << 2 | k & 3, v) for k, v in zip(keys.tolist(), nodes.tolist())}
    assert rows.column("bucket").to_pylist() == sorted(set(rows.column("bucket").to_pylist()))
    assert n < 50_000 or sum(map(len, rows.column("pairs").to_pylist())) <= 11 * n


def near_copies(copies, words=300, seed=3):
    rng = random.Random(seed)
    text = [f"w{rng.random()}" for _ in range(words)]
    return [(i, " ".join(w if rng.random() > 0.005 else f"x{rng.random()}" for w in text)) for i in range(copies)]


def test_near_copies_meet_with_few_bitmaps(spark):
    docs = cases.documents(spark, near_copies(30))
    groups = materialize(ngram_join.key_groups(docs, 5, 80, 16).distinct().where("mark < 2"))
    shared = groups.selectExpr("sum(size(nodes))").first()[0]
    asked = ngram_join.sets_at_homes(ngram_join.at_homes(groups))
    assert asked.groupBy("mark", "home", "node").count().where("count > 1").isEmpty()
    assert shared > 300 and asked.count() * 3 < shared


def test_near_copies_of_many_homes_stay_joined(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.at_homes, "__defaults__", (40,))
    rows = near_copies(12, seed=4) + [(i + 100, t) for i, t in near_copies(9, words=40, seed=5)] + [(200, "one two three four five six")]
    want = cases.jaccard_components(rows, 5, 80)
    got = ngram_join.similar_groups(cases.documents(spark, rows), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_sets_of_one_short_digest_are_both_compared():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 2**64, 50, dtype=np.uint64)) for _ in range(2)]
    sets.append(sets[1].copy())
    bits = [b.tobytes() for b in ngram_join.bitmaps(sets, ngram_join.NARROW_BITS)]
    table = {"home": [7, 7, 7, 7], "node": [5, 5, 6, None], "n": [50, 50, 50, None], "bits": [*bits, None], "nodes": [None, None, None, [5, 6]]}
    schema = pa.schema([("home", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("nodes", pa.list_(pa.int64()))])
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        batch = pa.Table.from_pydict(table, schema=schema).take(order).to_batches()[0]
        edges = [e for out in ngram_join.joined_sets(80)([batch]) for e in out.to_pylist()]
        assert {"src": 5, "dst": 6} in [e for e in edges if e["src"] != e["dst"]]


def test_tree_finds_components_of_all_links():
    rng = np.random.default_rng(2)
    stock = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(stock[g * 40 : g * 40 + 60], 45, replace=False)) for g in range(8) for _ in range(40)]
    plain = cases.Union(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if ngram_join.linked(sets[i], sets[j], 60):
                plain.join(i, j)
    order = sorted(range(len(sets)), key=lambda i: sets[i][:3].tolist())
    tree, known = ngram_join.SignatureTree([sets[i] for i in order]), ngram_join.Components(len(sets))
    list(ngram_join.tree_links(tree, tree, known, 0, 60))
    groups = defaultdict(set), defaultdict(set)
    for n, i in enumerate(order):
        groups[0][known.find(n)].add(i), groups[1][plain.find(i)].add(i)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


# -- repeated passages


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_repeated_spans(spark, hot_rows):
    rows = cases.texts()
    got = suffix_dedup.repeated_spans(cases.documents(spark, rows), size=50, hot_rows=hot_rows).collect()
    found = {r["doc_id"]: ([[s["start"], s["end"]] for s in r["spans"]], [[s["start"], s["end"]] for s in r["later"]]) for r in got}
    assert len(found) == len(got) and found == cases.repeats(rows, 50)
    assert suffix_dedup.repeated_spans(cases.documents(spark, []), size=50).count() == 0


def test_cut_spans(spark):
    rows = [(1, "A, b — c d. E", [(1, 3)]), (2, "A b", None), (3, None, [(0, 1)]), (4, "x y", [(0, 2)]), (5, "é.ö ü", [(2, 3)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<start:long,end:long>>")
    assert dict(suffix_dedup.cut_spans(df, "s").select("doc_id", "text").collect()) == {1: "A, c d. E", 2: "A b", 3: None, 4: "", 5: "é.ö "}


# -- scores


def test_lm_score(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "AT_ONCE", 500)
    rows = cases.texts()
    every = [cases.alnum_words(t) for i, t in rows if i is not None]
    for hot in (4096, 20):
        monkeypatch.setattr(lm_score, "HOT", hot)
        c1 = Counter(w for d in every for w in d)
        c2 = Counter(p for d in every for p in zip(d, d[1:]))
        total = sum(c1.values())
        want = defaultdict(lambda: [0, 0])
        for (i, t) in (r for r in rows if r[0] is not None):
            d = cases.alnum_words(t)
            for k, w in enumerate(d):
                if not k:
                    ratio = c1[w] / total
                elif c2[d[k - 1], w] >= 2:
                    ratio = c2[d[k - 1], w] / c1[d[k - 1]]
                else:
                    ratio = 0.4 * c1[w] / total
                want[i][1] += int(np.rint(1e6 * np.log(ratio)))
            want[i][0] += len(d)
        got = lm_score.score(cases.documents(spark, rows)).collect()
        assert {r["doc_id"]: [r["n_words"], r["logprob_micro"]] for r in got} == dict(want)
        assert all((r["score"] is None) == (r["n_words"] == 0) for r in got)
    assert lm_score.score(cases.documents(spark, [])).count() == 0


def test_lm_score_deals_small_tables_to_few_buckets(spark):
    rows = cases.documents(spark, cases.texts()).select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for partitions in ("3", "97"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            words, sums = lm_score._buckets(rows)
            assert words <= 1 + size / lm_score.BUCKET_BYTES and sums <= 1 + rows.count() / lm_score.BUCKET_DOCS
            got.append(sorted(map(tuple, lm_score.score(rows).collect())))
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_language_id(spark):
    rng = random.Random(4)
    stocks = {k: ["".join(rng.choice(p) for _ in range(rng.randint(1, 4))) for _ in range(300)] for k, p in {"aa": ["ba", "ko", "lu"], "bb": ["sti", "ren", "é"]}.items()}
    labelled = [(i, cases.sentence(rng, 80, stocks[k]), k) for i, k in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame([*labelled, (900, None, "aa"), (901, "…12", None)], "doc_id long, text string, lang string")
    made = langid.fit_dictionaries(docs, F.col("doc_id"), rows_per_language=40)
    assert set(made) == {"aa", "bb"}
    fresh = [(i, cases.sentence(rng, n, stocks[k]), k) for i, (k, n) in enumerate([("aa", 30), ("bb", 30), ("aa", 5000), ("bb", 12)] * 10)]
    odd = [(100, None, None), (101, "", None), (102, " 12 …", None)]
    tested = spark.createDataFrame(fresh + odd, "doc_id long, text string, want string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in langid.identify(tested, made).collect()}
    assert all(got[i]["lang_pred"] == k and 0.5 < got[i]["score"] <= 1 and not got[i]["rejected"] for i, _, k in fresh)
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True) for i, *_ in odd)
    none = langid.fit_dictionaries(docs.where("lang IS NULL"), F.col("doc_id"))
    assert none == {} and langid.identify(tested, none).where("lang_pred != 'und'").count() == 0


def test_quality(spark):
    rng = random.Random(6)
    stock = ["".join(rng.choice(["ba", "ko", "li", "mu"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    good = [(i, cases.sentence(rng, rng.randint(5, 80), stock)) for i in range(0, 400, 2)]
    bad = [(i, " ".join(w + "***" if rng.random() < 0.5 else w for w in cases.sentence(rng, rng.randint(5, 80), stock).split())) for i in range(1, 400, 2)]
    docs = spark.createDataFrame([*good, *bad, (1000, None), (1001, "")], "doc_id long, text string").withColumn("score", F.lit(3)).withColumn("h", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400) if i % 5] + [(2, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 0) for i in range(0, 400, 5)) and got[1000] == got[1001]
    blank = quality.score(docs, quality.fit(docs, labels.limit(0)))
    assert {r["score"] for r in blank.collect()} == {0.5}


# -- packing


def test_pack(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = cases.texts() + [(200, "a<|endoftext|>B'S <|ENDOFTEXT|>"), (201, "don't. x́ é\x85z")]
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[i, k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack(packing.tokenize_pieces(cases.documents(spark, rows), path, capacity=256), capacity=256).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(placed) <= 1.1 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack(packing.tokenize_pieces(cases.documents(spark, []), path)).count() == 0


def test_words_of_letters_need_no_places(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    places = []
    any_words = packing.WordTokenizer._encode_any
    monkeypatch.setattr(packing.WordTokenizer, "_encode_any", lambda self, words: places.extend(words) or any_words(self, words))
    letters = "The straße Ungachschstkeit élève naïve ÿ ß zzqqxv" + " ÀÉ".lower()
    odd = "don't 's we'll e\u0301t\u0301 a\u0300 \u0300a \u00bd x</w>y </w> w> 12a ÷ a÷b ç\u0327 \u0130x \u01c4 a\u00a0b ﬁ 漢字 😀 $$$ é!! a.b \x01 <|endoftext|> <|ENDOFTEXT|>"
    texts = [letters, odd, f"{letters} {odd}", "", None, "é", odd + letters, "\u0301e e\u0301"]
    for batch in ([letters], texts):
        tokenizer = packing.WordTokenizer(path)
        got = [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode([t and t.encode() for t in batch])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in batch]
        if batch == [letters]:
            assert not places
    tokenizer = packing.WordTokenizer(path)
    tokenizer.ends = None  # a vocabulary that doesn't tell
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode([letters.encode()])] == [plain.encode(letters, add_special_tokens=False).ids]


def test_library_gets_a_bounded_part_of_the_words(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 12))) for _ in range(50_000)]
    words[77] = "ab1" * 60_000  # more than one part by itself
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)] + [None, ""]
    sizes = []
    for name in ("_encode_letters", "_encode_any"):
        one = getattr(packing.WordTokenizer, name)
        monkeypatch.setattr(packing.WordTokenizer, name, lambda self, part, one=one: sizes.append(sum(map(len, part)) - max(map(len, part), default=0)) or one(self, part))
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordTokenizer(path).encode([t and t.encode() for t in texts])]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert max(sizes) <= 128 << 10 and sum(sizes) > 256 << 10


def test_words_of_many_texts_are_looked_up_together(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(4)
    letters = [*"aB é.\n9—'\x0b\x1c", "the", "The", "and***", "ß,", "<|endoftext|>", "  "]
    texts = [None, "", " ", "\n", "x" * 300, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(900))]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    asked = []
    with_all = packing.Recent.with_all
    monkeypatch.setattr(packing.Recent, "with_all", lambda self, keys, make: asked.append(len(keys)) or with_all(self, keys, make))
    tokenizer = packing.WordTokenizer(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode([t and t.encode() for t in texts])] == want
    assert len(asked) == 2  # once for texts that stay as they are, once for the others
    assert max(map(len, tokenizer.recent.young)) <= packing.LONGEST_CACHED and list(tokenizer.encode([])) == []
    monkeypatch.setattr(packing, "SLICE_BYTES", 100)
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode([t and t.encode() for t in texts])] == want
    assert len(asked) > 20


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(7)
    for _ in range(60):
        capacity = int(rng.integers(2, 60))
        counts = {int(k): int(v) for k, v in zip(rng.permutation(np.arange(1, capacity + 1))[: rng.integers(1, 20)], rng.integers(1, 40, 20))}
        plan = packing.packing_plan(counts, capacity)
        used = Counter()
        for parts, n in plan:
            assert n > 0 and sum(parts) <= capacity
            for p in parts:
                used[p] += n
        assert used == Counter(counts)
    exact = packing.packing_plan({1024: 9, 1000: 5, 1048: 5, 700: 3, 600: 3, 748: 3}, 2048)
    assert sum(n for _, n in exact) == 4 + 5 + 3 + 1


def test_items_digest_is_of_sorted_names(spark):
    docs = spark.createDataFrame([(1, "b a c")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "a"), (9, "b")], "item_id long, text string")
    r = decontaminate.decontaminate(docs, bench).first()
    assert hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == hashlib.sha256(b"10,9").hexdigest()
