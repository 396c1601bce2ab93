"""Phrasing, checks, the entailment connector and the teacher's file."""

from __future__ import annotations

import json
import os
import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdica.curate import build, examples, guards, phrasing, sources, verify
from verdica.functions import hashing
from verdica.operators import calibrate, scoring
from verdica.plans import engine, teach
from verdica.sources import nli
from verdica.streaming import http


def test_phrasing(spark):
    rows = spark.createDataFrame([(i, "He left.", f"The man {i} left.", "entailment") for i in range(200)] + [(900, "p", "Left?", "neutral"), (901, "", "h", "neutral")], "id int, premise string, hypothesis string, cls string")
    got = {r["id"]: r for r in phrasing.nli_rows(rows, "s").collect()}
    assert got[900]["instructions"] is None and got[901]["instructions"] is None
    said = [got[i]["instructions"] for i in range(200)]
    assert any(s == f"The man {i} left." for i, s in enumerate(said)) and any(s.endswith("?") and "the man" in s for s in said)
    assert {got[i]["criteria"] for i in range(200)} == {"none", "both", "true", "false"}
    paws = spark.createDataFrame([(1, "a b", "b a", "true")], "id int, a string, b string, cls string")
    assert phrasing.judgement_rows(paws, "paws", "s").first()["label"] == 1
    rte = spark.createDataFrame([(1, "p", "h.", "entailment"), (2, "p", "h?", "x")], "id int, premise string, hypothesis string, cls string")
    assert [r["instructions"] for r in phrasing.transfer_rows(rte, "rte").orderBy("id").collect()] == ["h.", None]
    with pytest.raises(ValueError):
        phrasing.transfer_rows(rte, "other")
    yelp = spark.createDataFrame([(" x" * 3000, 4)], "text string, label int")
    assert len(phrasing.task_rows(yelp, "yelp").first()["state"]) == 2000


def test_verify(spark):
    rows = spark.createDataFrame([("p", "h", 0), ("p", "h2", 2)], "premise string, hypothesis string, label int").withColumn("row", F.monotonically_increasing_id())
    mapped = sources.normalised("mnli", rows)
    verify.check_source(mapped, ["entailment", "contradiction"])
    for classes in (["entailment"], sources.NLI):
        with pytest.raises(ValueError):
            verify.check_source(mapped, classes)
    errors = verify.example_errors(F.col("i"), F.col("o"), F.col("k"), F.col("f"), F.col("l"), F.col("c"), ["is it spam"], "Review: ", F.col("s"))
    data = [("Is it spam?", ["a", "b"], "choice", "choice", 1, None, "s"), ("x", ["a", "b"], "choice", "choice", 2, None, "Review: s"), ("x", ["a"], "choice", "candidate", 1, "b", "s"), ("x", ["a", "b"], "score", "nli", 1, None, "s"), ("x", ["a", "b"], "choice", "choice", 0, None, "s")]
    got = spark.createDataFrame(data, "i string, o array<string>, k string, f string, l int, c string, s string").select(errors.alias("e")).collect()
    assert [r["e"] for r in got] == [["benchmark_instruction"], ["forbidden_wrapper", "label"], ["options", "candidate"], ["type"], []]
    rng = random.Random(3)
    data = []
    for i in range(400):
        y = rng.randrange(2)
        data += [("good", i, "calib" if i % 2 else "test", [3.0 + 2 * y + rng.random(), 0.0], y), ("flat", i, "calib" if i % 2 else "test", [rng.random(), 0.5], y)]
    got = {r["wording"]: r for r in verify.wording_table(spark.createDataFrame(data, "wording string, id int, split string, logits array<double>, label int"), reps=200).collect()}
    assert got["good"]["auroc"] == 1 == got["good"]["accuracy_platt"] and got["good"]["yes_rate"] == 1 and got["good"]["accuracy"] == got["good"]["true_rate"]
    assert got["flat"]["low"] < got["flat"]["auroc"] < got["flat"]["high"] and got["flat"]["n"] == 200
    bad = spark.createDataFrame([("a b", {"text": ["b"]}), ("a b", {"text": ["c"]}), ("a", {"text": []})], "context string, answers struct<text:array<string>>")
    with pytest.raises(ValueError, match="spans"):
        verify.check_content("squad_v2", bad)
    with pytest.raises(ValueError, match="within"):
        verify.check_content("civil_comments", spark.createDataFrame([(5.0,), (0.5,)], "toxicity double"))
    with pytest.raises(ValueError, match="coarse"):
        verify.check_content("trec", spark.createDataFrame([("f", "A"), ("f", "B")], "label_text string, label_coarse_text string"))
    verify.check_content("fewrel", spark.createDataFrame([("P1", ["name", "what it is"]), ("P1", ["name", "other"])], "relation string, names array<string>"))


def test_nli_chunks(spark):
    assert [len(c) for c in nli.chunks(["x"] * 130)] == [64, 64, 2]
    assert [len(c) for c in nli.chunks(["x" * 600_000, "y" * 200_000, "z" * 200_000])] == [2, 1] and list(nli.chunks([])) == []
    with pytest.raises(ValueError):
        list(nli.chunks(["é" * 500_000]))
    for bad in ([[1, 2]], [[1, 2, float("nan")]], []):
        with pytest.raises(RuntimeError):
            nli.checked(bad, 1)
    rows = spark.createDataFrame([(i, "t" * i) for i in range(150)], "id int, text string")
    got = nli.classified(rows, lambda texts: [[float(len(t)), 0, 0] for t in texts], ["id"]).collect()
    assert {r["id"]: r["logits"][0] for r in got} == {i: float(i) for i in range(150)}


def test_teacher_file(spark, tmp_path):
    options = [{"name": w, "descr": None} for w in ("gate", "door", "wall")]
    rows = spark.createDataFrame([(str(i), "choice", "Which?", "door door", options, None, None) for i in range(5)] + [("n", "noul", "It is.", "yes", None, None, None)],
                                 "request_id string, type string, instructions string, state string, options array<struct<name:string,descr:string>>, true_text string, false_text string")
    first = lambda t: t.withColumns({"logits": F.transform(F.sequence(F.lit(1), "n_labels"), lambda i: F.when(i == 1, 2.0).otherwise(0.0)), "prompt_tokens": F.lit(1), "truncated": F.lit(False)})
    biased = {r["request_id"]: r["agree"] for r in teach.teacher_scores(rows, first).collect()}
    assert biased["n"] and not all(biased[str(i)] for i in range(5))
    content = {r["request_id"]: r for r in teach.teacher_scores(rows, scoring.lexical_backend).collect()}
    assert all(content[str(i)]["agree"] and content[str(i)]["label"] == 1 and len(content[str(i)]["per_order"]) == 2 for i in range(5))
    path = f"{tmp_path}/t"
    assert teach.score_file(rows.limit(2), scoring.lexical_backend, path) == 2 and teach.score_file(rows, scoring.lexical_backend, path) == 4 and teach.score_file(rows, scoring.lexical_backend, path) == 0


def test_ids_of_questions_are_json(spark):
    ids = ['say "hi"', "back\\slash", "tab\tline\n", "é]["]
    body = {"state": "s", "model": "m", "questions": {i: {"type": "noul", "instructions": "x"} for i in ids}}
    good, _ = engine.answer(spark.createDataFrame([("1", json.dumps(body))], "request_id string, body string"))
    assert list(json.loads(good.first()["answers"])) == ids


def test_guard_without_broadcast(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "short one"), (3, "x a b c d e f g"), (4, "Short ONE.")], "id int, text string")
    held = spark.createDataFrame([("z b c d e f g h i",), ("short one",)], "text string")
    both = [{r["id"] for r in guards.guard_hits(texts, held, "id", "text", most=m).collect()} for m in (0, 1000)]
    assert both == [{1, 2, 4}] * 2


def test_neighbours_pad_by_order(spark):
    names = ["abcd", "abce", "xyz", "qqq", "abcf", "mno"]
    df = spark.createDataFrame(list(enumerate(names)), "ord int, name string")
    got = {}
    for r in examples.neighbours(df, keep=3).orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append((r["neighbour"], round(r["similarity"], 3)))
    assert got["xyz"] == [("abcd", 0.0), ("abce", 0.0), ("qqq", 0.0)] and [n for n, _ in got["abcd"]] == ["abce", "abcf", "xyz"]
    assert all(len(v) == 3 for v in got.values()) and not examples.neighbours(df.limit(0)).count()


def test_greedy_selection_is_the_loop(spark):
    rng = random.Random(9)
    rows = [(i, f"s{rng.randrange(2)}", rng.choice("abc"), f"k{rng.randrange(14)}") for i in range(160)]
    df = spark.createDataFrame(rows, "id int, source string, cls string, key string")
    quotas = {"a": 3, "b": 2, "c": 0, "d": 4}
    order = [r["id"] for r in df.orderBy(hashing.order_key("g", F.col("id")), "id").collect()]
    left, used, want = {}, {}, set()
    for i in order:
        _, source, cls, key = rows[i]
        room = left.setdefault(source, dict(quotas))
        if key not in used.setdefault(source, set()) and room[cls]:
            used[source].add(key)
            room[cls] -= 1
            want.add(i)
    got = build.select_greedy(df, quotas, "g", "source").collect()
    assert {r["id"] for r in got if r["taken"]} == want and len(got) == len(rows)


def test_sources_by_split_and_revision(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1)], "text string, label int")
    rows.write.parquet(f"{tmp_path}/r1/train")
    rows.union(rows).coalesce(1).write.parquet(f"{tmp_path}/part")
    os.makedirs(f"{tmp_path}/r2")
    found = next(f for f in os.listdir(f"{tmp_path}/part") if f.endswith(".parquet"))
    os.rename(f"{tmp_path}/part/{found}", f"{tmp_path}/r2/test-00000-of-00001.parquet")
    assert sources.load(spark, "emotion", str(tmp_path), "train", "r1").count() == 1
    assert sources.load(spark, "emotion", str(tmp_path), "test", "r2").count() == 2
    with pytest.raises(ValueError, match="split"):
        sources.load(spark, "emotion", str(tmp_path), "dev", "r2")


def test_http_refusals(spark):
    service = http.Service(spark, key="k", wait=0.01)
    ok = {"Authorization": "bearer k"}
    send = lambda head, body=b"": service.respond("POST", "/v1/systemone", ok | head, lambda n: body[:n])
    assert [send(h)[0] for h in ({}, {"Content-Length": "-1"}, {"Content-Length": "x"}, {"Content-Length": str((4 << 20) + 1)})] == [411, 400, 400, 413]
    body = json.dumps({"state": "s", "model": "m", "questions": {"a": {"type": "noul", "instructions": "x"}}}).encode()
    assert send({"Content-Length": "5"}, body) == (400, {"error": "invalid JSON"})
    # while one table is answered, others wait, and go together into the next one
    go, answers = threading.Event(), service._answers
    service._answers = lambda bodies: go.wait() and answers(bodies)
    length = {"Content-Length": str(len(body))}
    service.wait = 60
    with ThreadPoolExecutor(9) as clients:
        first = clients.submit(send, length, body)
        while service.counts["jobs"] < 1:
            time.sleep(0.01)
        others = [clients.submit(send, length, body) for _ in range(8)]
        while len(service.waiting) < 8:
            time.sleep(0.01)
        service.wait = 0.01
        assert send(length, body) == (503, {"error": "busy"})
        go.set()
        assert [f.result()[0] for f in (first, *others)] == [200] * 9 and service.counts["jobs"] == 2
    broken = http.Service(spark, backend=None)
    assert broken.respond("POST", "/v1/systemone", {"Content-Length": str(len(body))}, lambda n: body) == (500, {"error": "internal error"}) and broken.counts == {"requests": 1, "errors": 1, "jobs": 1}


def test_platt_on_parted_margins(spark):
    """Margins that part the labels: only the ridge on the mean loss keeps the slope finite."""
    rows = [(x, int(x > 0)) for x in (-3.0, -2.0, -1.0, 1.0, 2.0, 3.0)] * 50
    a, b = calibrate.fit_platt(spark.createDataFrame(rows, "margin double, label int"))
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p = 1 / (1 + np.exp(-(a * x + b)))
    slope = [np.mean((p - y) * x) + 1e-6 * a, np.mean(p - y) + 1e-6 * b]
    assert np.abs(slope).max() < 1e-8 and a > 5
