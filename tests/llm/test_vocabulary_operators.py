"""Spelling variants, token alignment and token counts against plain versions and the tokenizers' libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import cases
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from annolytics.llm import alignment, spelling, token_counts
from annolytics.llm.recent import Recent

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
STRANGE = list("aeinorst  xé漢\n\t<0>ß—😀\u0000ﬁ'") + ["<|endoftext|>", "<s>", "  \n ", " the", "and", "123", "ing", " "]


def strange_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(STRANGE) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# -- spelling variants


def are_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, factor):
    near = {w: [v for v in counts if are_near(w, v)] for w in counts}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, counts[w], len(near[w]), counts[forms[w]] if forms[w] else None))
    return out


def random_words(rng, n, letters, longest):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)}


@pytest.mark.parametrize("group_rows", [5000, 40, 3])
def test_variants(spark, group_rows):
    rng = random.Random(7)
    words = random_words(rng, 400, "aab", 9) | random_words(rng, 200, "anéÿ×", 7) | {"a" * 7, "a" * 8, "b" * 3000, "b" * 3001, "b" * 1500 + "c" + "b" * 1500}
    counts = {w: rng.choice([1, 1, 2, 3, 10, 20, 30, 300, 3000]) for w in words}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("root", F.lit(1)).repartition(3)
    got = spelling.variants(vocab, factor=10, group_rows=group_rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain_variants(counts, 10) and got.count() == len(counts)


def test_variants_across_blocks(spark):
    counts = {w: len(w) for w in random_words(random.Random(1), 300, "ab", 8)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = spelling.near_words(vocab, factor=2, block_rows=50).select("word", "n_near")
    want = {(w, n) for w, _, _, _, n, _ in plain_variants(counts, 2) if n}
    assert {tuple(r) for r in near.collect()} == want


def test_variants_follow_forms_and_break_ties(spark, rows):
    counts = {"correct": 100_000, "correkt": 900, "corekt": 9, "kandle": 50, "candle": 500, "handle": 500, "apart": 3}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert (got["corekt"]["form"], got["corekt"]["root"]) == ("correkt", "correct")
    assert (got["kandle"]["form"], got["kandle"]["n_near"]) == ("candle", 2) and got["candle"]["form"] is None
    assert tuple(got["apart"]) == ("apart", None, "apart", 3, 0, None)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), factor=1)


def test_words_of_texts(spark):
    docs = cases.documents(spark, [*cases.texts(), (93, "Straße ÉTÉ été×ÿ a-b Ω word1word")])
    got = Counter(tuple(r) for r in spelling.word_runs(docs, min_length=3).collect())
    want = Counter()
    for i, text in [*cases.texts(), (93, "Straße ÉTÉ été×ÿ a-b Ω word1word")]:
        want.update((i, w) for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(cases.LOWER)) if len(w) >= 3)
    assert got == want
    vocab = spelling.vocabulary(spelling.word_runs(docs, min_length=3), min_length=4, min_count=2)
    total = Counter()
    for (_, w), n in want.items():
        total[w] += n
    assert {tuple(r) for r in vocab.collect()} == {(w, n) for w, n in total.items() if len(w) >= 4 and n >= 2}
    empty = docs.where("false")
    assert spelling.variants(spelling.vocabulary(spelling.word_runs(empty, 1), 1, 1)).count() == 0


# -- token alignment


class PlainAlignment:
    def __init__(self):
        self.sides = alignment.Sides(BYTES, PIECES)

    def one(self, text):
        """(ids of A, ids of B, linked places, groups)"""
        s = self.sides
        if not text:
            return [], [], [], ""
        a, b = s.a.encode(" " + text, add_special_tokens=False).ids, s.b.encode(text)
        raw = (" " + text).encode()
        if not raw == b"".join(s.a_bytes[i] for i in a) == b"".join(s.b_bytes[i] for i in b):
            return [], [], [], ""

        def spans(parts):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            return list(zip([0, *ends], ends))

        of_a, of_b = spans([s.a_bytes[i] for i in a]), spans([s.b_bytes[i] for i in b])
        links = [(i, j) for i, (u, v) in enumerate(of_a) for j, (x, y) in enumerate(of_b) if max(u, x) < min(v, y)]
        groups, held_a, held_b, ends = [], [], [], {v for _, v in of_a}
        rest_a = iter(zip(a, of_a))
        for j, (_, y) in zip(b, of_b):
            held_b.append(str(j))
            if y in ends:
                for i, (_, v) in rest_a:
                    held_a.append(str(i))
                    if v == y:
                        break
                groups.append(f"{','.join(held_a)}|{','.join(held_b)}")
                held_a, held_b = [], []
        return a, b, links, ";".join(groups)


def test_byte_alphabet_and_vocabularies():
    sides = alignment.Sides(BYTES, PIECES)
    assert sides.by_chunk and sorted(alignment._byte_of().values()) == list(range(256))
    for text in strange_texts(50):
        raw = (" " + text).encode()
        assert b"".join(sides.a_bytes[i] for i in sides.a.encode(" " + text, add_special_tokens=False).ids) == raw


@pytest.mark.parametrize("hot_pairs", [1 << 19, 60, 0])
def test_alignment(spark, hot_pairs):
    texts = [*strange_texts(60), None, "", " ", "a▁b", "plain text", "plain text", "word " * 3000, "x" * 5000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = cases.documents(spark, rows)
    plain = PlainAlignment()
    made = [plain.one(t) for t in texts]
    counts = Counter((a[i], b[j]) for a, b, links, _ in made for i, j in links)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    want = Counter()
    for (name, _), (a, b, links, groups) in zip(rows, made):
        n = [counts[a[i], b[j]] for i, j in links]
        best = sum(k == most[b[j]] for k, (_, j) in zip(n, links))
        want[name, len(a), len(b), len(groups.split(";")) if groups else 0, len(links), groups, best, sum(n)] += 1
    got = alignment.count_links(alignment.align(docs, BYTES, PIECES), hot_pairs=hot_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_alignment_of_lots_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "LOT_CHARS", 50)
    texts = strange_texts(40, seed=8)
    lots = list(alignment._lots(alignment.pa.array([*texts, None])))
    assert [t for _, part in lots for t in part] == [*texts, None] and len(lots) > 5
    one = spark.createDataFrame([(1, 2)], "a int, b int").select(alignment.pair_code("a", "b")).head()[0]
    assert one == (1 << 20) + 2
    empty = cases.documents(spark).where("false")
    assert alignment.count_links(alignment.align(empty, BYTES, PIECES)).count() == 0


def test_chunks_are_encoded_together():
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

        encode_batch = encode_batch_fast

    sides = alignment.Sides(BYTES, PIECES)
    sides.a = Counting(sides.a)
    plain = PlainAlignment()
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinorst.,é") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(50)]
    lot = alignment.Lot(sides, texts)
    assert sides.a.texts == 1 and lot.groups() == [plain.one(t)[3] for t in texts]
    texts = [*strange_texts(200, seed=11), None, "", "▁ a b", " a  b c ", "\u00ada b", *texts]
    lot = alignment.Lot(sides, texts)
    made = [plain.one(t) for t in texts]
    assert lot.groups() == [m[3] for m in made] and "" in lot.groups()
    assert (lot.n_a.tolist(), lot.n_b.tolist()) == ([len(m[0]) for m in made], [len(m[1]) for m in made])
    sides.by_chunk = False
    assert alignment.Lot(sides, texts).groups() == lot.groups()


def test_query_digest(spark, tmp_path):
    from annolytics.llm import catalog

    rows = [(1, "some words, and more"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["groups_sha256"] for r in catalog.op12_token_alignment(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(PlainAlignment().one(rows[0][1])[3].encode()).hexdigest(), 2: "", 3: ""}


# -- token counts


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_are_the_library_s(library, monkeypatch):
    table = token_counts.Transducer(PIECES)
    vocabulary = [library.id_to_piece(i) for i in range(300, library.get_piece_size(), 41)]
    rng = random.Random(2)
    texts = strange_texts(400) + ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += ["x" * 30_000, "ab" * 9000, "é" * 3001, " " * 4001, "aaaa" * 1001 + "b", "▁", "▁▁ ▁a"]
    for size in (512, 5):
        monkeypatch.setattr(token_counts, "PIECE", size)
        table = token_counts.Transducer(PIECES)
        assert [table.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_counts_survive_new_compilation(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    monkeypatch.setattr(token_counts, "CHUNKS", 10)
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 100)
    table = token_counts.Transducer(PIECES)
    texts = [t or "" for _, t in cases.texts()[:60]]
    assert [table.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    assert len(table.recent.young) < 500


def test_state_maps_compose():
    table = token_counts.Transducer(PIECES)
    text = "▁" + "ationalization" * 20
    entry = table._guess(text, 0, text[:50])
    for guess in ({}, table._guess(text, 50, text[50:])):  # a map that misses the entry is run from it
        _, joined = table._compose((text[:50], dict(entry)), (text[50:], dict(guess)))
        assert joined == {0: table.run(0, text)}


def test_count_tokens(spark, library):
    docs = cases.documents(spark).withColumn("n_tokens", F.lit(-1)).withColumn("other", F.lit("x"))
    got = token_counts.count_tokens(docs, PIECES, limit=300)
    assert set(got.columns) == {*docs.columns, "n_bytes", "over_limit"}
    want = Counter()
    for i, t in cases.texts():
        n = len(library.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 300] += 1
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    assert token_counts.count_tokens(docs.where("false"), PIECES).count() == 0


def test_other_vocabularies_are_refused(monkeypatch):
    monkeypatch.setattr(token_counts, "_PROBES", ["a"])
    monkeypatch.setattr(token_counts.Transducer, "count", lambda self, t: 99)
    with pytest.raises(ValueError):
        token_counts.Transducer(PIECES)


def test_recent_keeps_what_is_used():
    made = []
    recent = Recent(3)
    for keys in ({1, 2}, {1, 3, 4}, {1, 5}, {1, 6, 7, 8}, {1, 2}):
        known = recent.with_all(keys, lambda new: [(k, made.append(k) or zlib.crc32(str(k).encode())) for k in sorted(new)])
        assert keys <= known.keys() and all(known[k] == zlib.crc32(str(k).encode()) for k in keys)
    assert made.count(1) == 1 and made.count(2) == 2 and len(recent.young) + len(recent.old) <= 10
