import json
import random

import pytest
from pyspark.sql import functions as F

from annolytics.operators import splits
from annolytics.operators.examples import normalize_examples
from annolytics.operators.validation import validate
from annolytics.sources import readers
from annolytics.sources.json_array import read_array_elements
from annolytics.streaming import incremental


def test_jsonl(spark, tmp_path, rows):
    rec = {"id": "1", "image": ["a.png", "b.png"], "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}
    lines = [json.dumps(rec), "", "   ", '{"question": "q2", "Image": "c.png", "Answer": "a2"} trailing', '{"broken', json.dumps({"Question": "Q", "Image": "d.png", "Answer": "A"})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    df = readers.read_examples_jsonl(spark, str(tmp_path))
    assert rows(normalize_examples(df)) == [("Q", "d.png", "A"), ("q", "a.png", "a")]
    c = readers.count_malformed(spark, str(tmp_path)).first()
    assert (c.lines, c.malformed) == (4, 2)


def test_json_documents(spark, tmp_path, rows):
    item = lambda i: {"question": f"q{i}", "image": f"{i}.png", "answer": f"a{i}"}
    for name, doc in {"array": [item(1), item(2)], "wrapped": {"examples": [item(3)]}, "items": {"items": [item(4)]}, "bare": item(5)}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    df = normalize_examples(readers.read_examples_json(spark, str(tmp_path)))
    assert [r[0] for r in rows(df)] == ["q1", "q2", "q3", "q4", "q5"]


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_large_array_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    odd = ['a, b', 'quote " and \\ back', "[{", "}],[", 'long ' * 30, "", "é漢,", '\\",']
    made = [{"id": i, "t": rng.choice(odd), "n": [rng.choice(odd), {"k": [1, 2, {"x": rng.choice(odd)}]}]} for i in range(60)] + [7, "text, [", None, True, [1, [2]], {}]
    (tmp_path / "one_line.json").write_text(json.dumps(made))
    (tmp_path / "indented.json").write_text("  \n" + json.dumps(made, indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "empty.json").write_text(" [ ] ")
    (tmp_path / "cut.json").write_text(json.dumps(made)[:-40])
    (tmp_path / "single.json").write_text('[{"only": "one, element"}]')
    found = {}
    for r in read_array_elements(spark, str(tmp_path)).collect():
        if r.value.strip():
            found.setdefault(r.path.rsplit("/", 1)[1], []).append(json.dumps(json.loads(r.value)))
    want = sorted(json.dumps(x) for x in made)
    assert sorted(found.pop("one_line.json")) == want and sorted(found.pop("indented.json")) == want
    assert found == {"single.json": ['{"only": "one, element"}']}
    assert spark.read.option("lineSep", ",").text(str(tmp_path / "one_line.json")).rdd.getNumPartitions() > 20


def test_large_array_of_records(spark, tmp_path, rows, small_ranges):
    items = [{"question": f"q, {i}", "image": f"{i}.png", "answer": "a" * i} for i in range(1, 30)]
    (tmp_path / "a.json").write_text(json.dumps(items)[:-1] + ", {broken}]")
    df = normalize_examples(readers.read_examples_json(spark, str(tmp_path), arrays=True))
    assert rows(df) == sorted((x["question"], x["image"], x["answer"]) for x in items)


def test_csv(spark, tmp_path, rows):
    (tmp_path / "x.csv").write_text(
        ",image,atributes,categories\n0,a.png,[],\"['x']\"\n1,b.png,[],\"['x', \"\"it's\"\"]\"\n2,,[],\"['x']\"\n3,c.png,[],[]\n4,d.png,[],not a literal\n5,e.png,[],7\n6,f.png,[],'quoted'\n")
    got = rows(readers.read_examples_csv(spark, str(tmp_path)).select("image_path", "question", "ground_truth_answer"))
    assert got == [("a.png", readers.SINGULAR_QUESTION, "x"), ("b.png", readers.PLURAL_QUESTION, "x, it's"),
                   ("e.png", readers.SINGULAR_QUESTION, "7"), ("f.png", readers.SINGULAR_QUESTION, "'quoted'")]


def test_dataset_dir(spark, tmp_path, rows):
    for name in ("one.jsonl", "two.jsonl", ".hidden.jsonl", "three.txt"):
        (tmp_path / name).write_text('{"question": "q", "image": "i", "answer": "a"}\n')
    count = lambda **k: rows(readers.read_dataset_dir(spark, str(tmp_path), **k).select("dataset"))
    assert count() == [("one",), ("two",)] and count(pattern="t*.jsonl") == [("two",)]


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("alpha")
    (tmp_path / "sub" / "b.txt").write_text("beta\nmore")
    (tmp_path / "c.md").write_text("no")
    names = lambda **k: sorted(r.filename for r in readers.read_corpus(spark, str(tmp_path), pattern="*.txt", **k).collect())
    assert names() == ["a.txt", "b.txt"] and names(recursive=False) == ["a.txt"]


def test_measurements_and_layouts(spark, tmp_path, rows):
    (tmp_path / "m.csv").write_text("﻿Name,a,b\nx,1.5,oops\n")
    r = readers.read_measurements(spark, str(tmp_path / "m.csv")).first()
    assert (r.Name, r.a, r.b) == ("x", 1.5, None)
    df = spark.range(25).withColumn("t", F.lit(None).cast("string")).repartition(3)
    readers.convert_json_layout(df, str(tmp_path / "arr"), "array")
    parts = [json.loads(p.read_text()) for p in (tmp_path / "arr").glob("part-*")]
    assert sorted(x["id"] for p in parts for x in p) == list(range(25)) and parts[0][0]["t"] is None
    assert readers.read_examples_json(spark, str(tmp_path / "arr"), "id long").count() == 25
    splits.write_splits(spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string"), str(tmp_path / "sp"))
    assert rows(spark.read.parquet(str(tmp_path / "sp" / "split=test")).select("id")) == [(2,)]


def test_stream_equals_batch_and_resumes(spark, tmp_path, rows):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    row = lambda i: {"id": str(i), "question": "q", "ground_truth_answer": "word", "reasoning_type": "A", "tool_execution_log": [],
                     "trajectory": "<think>a plan of some length here</think>" + ("<answer>word</answer>" if i % 2 else "")}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(row(i)) for i in range(4)))
    incremental.stream_validate(spark, src, out, ckpt).awaitTermination()
    assert incremental.validated(spark, out).count() == 4
    (tmp_path / "in" / "2.json").write_text("\n".join(json.dumps(row(i)) for i in range(4, 9)))
    for _ in range(2):  # the second run finds nothing new
        incremental.stream_validate(spark, src, out, ckpt, max_files=1).awaitTermination()
    got = incremental.validated(spark, out).select("id", "quality_score", "issues")
    batch = validate(spark.read.schema(incremental.RESULT_SCHEMA).json(src)).select("id", "quality_score", "issues")
    assert rows(got) == rows(batch) and got.count() == 9
