"""Small tables with the awkward rows that every operator has to take, and plain versions of text rules."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: names that operators use inside or return, as extra columns
CLASHES = ["score", "spans", "items", "n_words", "key", "block", "bucket", "set", "rep", "cluster", "component_id", "lang_pred", "rejected", "__once", "length", "kind"]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def sentence(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


def texts():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    stock = ["".join(rng.choice(["ba", "ko", "li", "mu", "te", "ré", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    base, passage = sentence(rng, 120, stock), sentence(rng, 60, stock)
    near = base.split()
    rows = [(1, base), (2, base), (3, base.upper().replace("É", "é")), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (9, "Two words"), (None, base), (None, None)]
    for i in range(10, 40):
        w = list(near)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(stock)
        rows.append((i, " ".join(w)))
    for i in range(40, 60):
        rows.append((i, f"{sentence(rng, rng.randint(0, 90), stock)} {passage} {sentence(rng, rng.randint(0, 90), stock)}"))
    for i in range(60, 90):
        rows.append((i, sentence(rng, rng.randint(1, 200), stock)))
    rows.append((90, sentence(rng, 30_000, stock)))
    rows.append((91, "x" * 200_000))
    rows.append((92, "again and again " * 300))
    return rows + [rows[0], rows[20], rows[20]]


def documents(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts() if rows is None else rows, "doc_id long, text string")
    for i, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(i))
    return df.withColumn("lang", F.lit("xx")).repartition(5)


class Union:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def jaccard_components(rows, size, percent):
    """doc_id -> (set size, smallest id reached), by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = blank_words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    known = Union(sets)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                known.join(a, b)
    return {i: (len(sets[i]), known.find(i)) for i in ids}


def covered(starts, size):
    out = []
    for i in starts:
        if out and i <= out[-1][1]:
            out[-1][1] = i + size
        else:
            out.append([i, i + size])
    return out


def repeats(rows, size):
    """doc_id -> (spans in other documents, spans in documents with smaller ids), over all windows."""
    words = {i: alnum_words(t) for i, t in rows if i is not None}
    low, high = {}, {}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            p = tuple(w[k : k + size])
            low[p], high[p] = min(low.get(p, i), i), max(high.get(p, i), i)
    out = {}
    for i, w in words.items():
        at = [k for k in range(len(w) - size + 1) if low[tuple(w[k : k + size])] != high[tuple(w[k : k + size])]]
        if at:
            out[i] = (covered(at, size), covered([k for k in at if low[tuple(w[k : k + size])] < i], size))
    return out
