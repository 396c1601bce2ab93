"""Numbered lines over byte ranges, torn tails, decision files with the line of each fault."""

from __future__ import annotations

import json
import random

import pytest

from verdica.sources import decisions as D
from verdica.sources import rows as R
from verdica.sources.lines import numbered_lines


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, text: str) -> str:
    path.write_bytes(text.encode())
    return str(path)


def test_numbers_over_many_ranges(spark, tmp_path, small_ranges):
    rng, want = random.Random(4), set()
    for name, end in (("a.txt", "\n"), ("b.txt", ""), ("c.txt", "\n\n"), ("empty.txt", None)):
        lines = ["é" * rng.choice([0, 3, 40, 1500]) + str(k) for k in range(120)] + ["", "last"]
        write(tmp_path / name, "" if end is None else "\n".join(lines) + end)
        if end is not None:
            lines += [""] * (len(end) - 1)
            want |= {(name, k + 1, t, not end and k == len(lines) - 1) for k, t in enumerate(lines)}
    got = numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 1
    assert {(r.file.rsplit("/", 1)[1], r.line, r.text, r.torn) for r in got.collect()} == want


RAW = {"id": "a", "split": "test", "label": 1, "kind": "noul", "logits": [1.0, 0.0]}


def test_only_a_torn_tail_goes(spark, tmp_path):
    a, b, d, e = (json.dumps(RAW | {"id": x}) for x in "abde")
    assert [r.id for r in R.read_raw(spark, write(tmp_path / "1.jsonl", f"{a}\n\n{b}\n{d}\n{e[:30]}")).collect()] == ["a", "b", "d"]
    # whole, but without its line feed: the writer may have died before it, so it goes as well
    assert [r.id for r in R.read_raw(spark, write(tmp_path / "2.jsonl", f"{a}\n{b}")).collect()] == ["a"]
    for k, bad in enumerate((b[:30], json.dumps(RAW | {"label": "x"}), "[1]", e[:30] + "\n")):
        path = write(tmp_path / f"bad{k}.jsonl", f"{a}\n{bad}\n{d}\n")
        with pytest.raises(Exception, match=rf"bad{k}\.jsonl:2: not a row"):
            R.read_raw(spark, path).select("id").collect()
        with pytest.raises(Exception, match=":2: not a row"):
            R.read_raw(spark, path).count()


CHOICE = {"type": "choice", "instructions": "Which?", "criteria": {"yes": None, "no": "it isn't", "maybe": None}}
SCORE = {"type": "score", "instructions": "How much?", "criteria": ["little", "some", "much"]}
NOUL = {"type": "noul", "instructions": "Is it?"}


def test_decisions(spark, tmp_path):
    rows = [{"state": {"a": 1}, "question": CHOICE, "label": "no"}, {"id": "own", "state": "x", "question": CHOICE, "label": "maybe"}]
    path = write(tmp_path / "d.jsonl", "\n" + "\n  \n".join(map(json.dumps, rows)))
    got = {r.id: r for r in D.read_decisions_file(spark, path, "mine").collect()}
    assert set(got) == {"mine/2", "own"} and (got["mine/2"].label, got["own"].label, got["own"].line) == (1, 2, 4)
    assert got["mine/2"].state_is_json and got["mine/2"].options[1].descr == "it isn't"
    for question, labels in ((SCORE, [0, 2]), (NOUL, [True, 0])):
        path = write(tmp_path / "e.jsonl", "".join(json.dumps({"state": "x", "question": question, "label": v}) + "\n" for v in labels))
        assert [r.label for r in D.read_decisions_file(spark, path).orderBy("line").collect()] == list(map(int, labels))


GOOD = {"state": "x", "question": CHOICE, "label": "no"}


@pytest.mark.parametrize(
    ("bad", "says"),
    [
        ("{", "2: invalid JSON"),
        ("[1]", "2: each line must be an object"),
        (GOOD | {"extra": 1}, "2: extra: unknown key"),
        ({k: v for k, v in GOOD.items() if k != "label"}, "2: label is required"),
        (GOOD | {"state": 5}, "2: state: must be a string"),
        (GOOD | {"question": CHOICE | {"criteria": {"a": None}}}, "2: question.criteria: must have 2 to 255"),
        (GOOD | {"question": NOUL, "label": True}, "2: question.type: type differs from earlier rows: choice"),
        (GOOD | {"question": NOUL, "label": "?"}, "2: question.type: type differs"),
        (GOOD | {"label": "nope"}, "2: label: must be the name"),
        (GOOD | {"label": 1}, "2: label: must be the name"),
        (GOOD | {"id": ""}, "2: id: must be a text"),
        (GOOD | {"id": 7}, "2: id: must be a text"),
        (GOOD | {"id": "n/1"}, "2: id: repeats the id of line 1"),
    ],
)
def test_faults_name_their_line(spark, tmp_path, bad, says):
    path = write(tmp_path / "d.jsonl", "\n".join([json.dumps(GOOD), bad if isinstance(bad, str) else json.dumps(bad), "also bad", json.dumps(GOOD)]))
    with pytest.raises(ValueError, match=says):
        D.read_decisions_file(spark, path, "n")


@pytest.mark.parametrize(("question", "label"), [(SCORE, 3), (SCORE, -1), (SCORE, True), (SCORE, "1"), (NOUL, 2), (NOUL, "true"), (NOUL, None), (NOUL, 1.0)])
def test_labels(spark, tmp_path, question, label):
    with pytest.raises(ValueError, match="1: label"):
        D.read_decisions_file(spark, write(tmp_path / "d.jsonl", json.dumps({"state": "x", "question": question, "label": label})))


def test_no_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        D.read_decisions_file(spark, write(tmp_path / "d.jsonl", "\n \n"))
