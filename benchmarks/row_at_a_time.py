"""Plain-Python counterparts of four operators, one row at a time, as a comparison point for bench.py.

Prints one JSON line with seconds per operator, reading included. Run: python benchmarks/row_at_a_time.py [sf_dir]
"""

from __future__ import annotations

import json
import math
import os
import re
import sys
import time

import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from annolytics.functions import chunks, trajectory as J  # noqa: E402
from annolytics.plans.catalog import TEXT_RULES  # noqa: E402


def rows(directory: str, table: str) -> list[dict]:
    return pq.read_table(f"{directory}/{table}.parquet").to_pylist()


def classify(directory: str) -> int:
    def holds(condition, q, a):
        where, mode, words = condition
        hit = any(w in t for w in words for t in ([q] if where == "q" else [a] if where == "a" else [q, a]))
        return hit if mode == "any" else not hit

    n = 0
    for d in rows(directory, "documents"):
        q, a = f"{d['lang']} {d['source']}".lower(), d["text"].lower()
        n += next((r for r in TEXT_RULES if all(holds(c, q, a) for c in r["when"])), None) is not None
    return n


def validate(directory: str) -> float:
    first: dict[int, dict[str, tuple[int, str]]] = {}
    for r in rows(directory, "conversations"):
        seen = first.setdefault(r["conv_id"], {})
        if r["role"] not in seen or r["turn"] < seen[r["role"]][0]:
            seen[r["role"]] = (r["turn"], r["text"])
    truths = {b["item_id"]: b["text"] for b in rows(directory, "benchmark")}
    total = 0.0
    for conv, by_role in first.items():
        q, a = by_role.get("user", (0, ""))[1], by_role.get("assistant", (0, ""))[1]
        t = f"<think>plan {q}</think><tool_call>first</tool_call><observation>status ok {a}</observation><answer>{a}</answer>"
        thinks, obs, answers = (re.findall(f"<{x}>(.*?)</{x}>", t, re.S) for x in ("think", "observation", "answer"))
        words = re.findall(r"\w+", truths.get(conv % len(truths), "").lower())
        hits = sum(1 for w in words if len(w) > 3 and w in answers[-1].lower())
        checks = {
            "xml_valid": all(tag in t for tag in J.REQUIRED_TAGS) and t.count("<tool_call>") == t.count("<observation>"),
            "tool_results_match": any("ok" in o for o in obs),
            "reasoning_coherent": sum(len(x.strip()) < 20 for x in thinks) <= 0.3 * len(thinks) and any(w in t.lower() for w in J.REASONING_WORDS),
            "correction_ok": True, "answer_correct": bool(words) and hits / len(words) >= 0.3,
        }
        total += round(sum(J.WEIGHTS[k] * v for k, v in checks.items()), 3)
    return total


def pack(directory: str) -> int:
    splitter = re.compile("(" + "|".join(map(re.escape, chunks.SENTENCE_SEPARATORS)) + ")")
    n = 0
    for d in rows(directory, "documents"):
        bits = splitter.split(d["text"]) + [""]
        open_, used = [], 0
        for i in range(0, len(bits) - 1, 2):
            s = bits[i] + bits[i + 1]
            if not s.strip():
                continue
            if open_ and used + len(s) > 512:
                n += 1
                open_ = open_[-1:] if len(open_) > 1 else []
                used = sum(map(len, open_))
            open_.append(s)
            used += len(s)
        n += bool(open_)
    return n


def search(directory: str) -> int:
    vectors = [(r["vec_id"], r["label"], r["embedding"]) for r in rows(directory, "embeddings")]
    groups: dict[int, list] = {}
    for _, label, v in vectors:
        groups.setdefault(label, []).append(v)
    means = {k: [sum(c) / len(vs) for c in zip(*vs)] for k, vs in groups.items()}

    def unit(v):
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v]

    units = [(i, unit(v)) for i, _, v in vectors]
    found = 0
    for q in map(unit, means.values()):
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in units))
        found += len(scored[:10])
    return found


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    out = {}
    for name, fn in {"c2_classify_documents": classify, "v7_validate": validate, "t3_chunk_sentences": pack, "t12_search_cosine": search}.items():
        began = time.perf_counter()
        fn(where)
        out[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "row_at_a_time_python", "unit": "sec", "queries": out}))
