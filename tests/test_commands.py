"""Commands of the teacher, of mining and of synthetic sets on small files; a second start adds nothing."""

from __future__ import annotations

import json

from verdica import cli
from verdica.sources.chunks import committed_rows


def lines(path, *rows) -> str:
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def told(capsys, *args: str) -> dict:
    assert cli.main(list(args)) == 0
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_teacher(spark, tmp_path, capsys):
    question = {"type": "choice", "instructions": "Which?", "criteria": {"gate": None, "door": None, "wall": None}}
    path = lines(tmp_path / "d.jsonl", *[{"id": f"r{i}", "state": "door " * i, "question": question, "label": "door"} for i in range(1, 6)])
    for _ in range(2):
        assert told(capsys, "teacher", path, "--out", f"{tmp_path}/t") == {"rows": 5, "agree": 5}
    assert {r.label for r in committed_rows(spark, f"{tmp_path}/t").collect()} == {1}
    assert told(capsys, "decisions", path, "--name", "mine") == {"name": "mine", "type": "choice", "rows": 5}
    assert cli.main(["teacher", lines(tmp_path / "bad.jsonl", {"state": "x"}), "--out", f"{tmp_path}/u"]) == 1 and "bad.jsonl:1" in capsys.readouterr().err


def test_mining(spark, tmp_path, capsys):
    labels = lines(tmp_path / "l.jsonl", *[{"name": n, "place": i} for i, n in enumerate(("rain", "snow", "hail", "wind"))])
    rows = lines(tmp_path / "r.jsonl", {"id": "1", "text": "snow snow and wind", "label": "snow"}, {"id": "2", "text": "snow and hail, hail", "label": "snow"})
    assert told(capsys, "mine-negatives", rows, "--labels", labels, "--out", f"{tmp_path}/m", "--keep", "2") == {"n": 2, "top1": 0.5, "top10": 1.0}
    assert {r.id: (r.gold_rank, r.wrong) for r in spark.read.json(f"{tmp_path}/m").collect()} == {"1": (0, ["wind", "rain"]), "2": (1, ["hail", "rain"])}


def test_synthetic_sets(spark, tmp_path, capsys):
    intents = lines(tmp_path / "i.jsonl", {"domain": "d", "intent": "pay_bill", "description": "yes yes"}, {"domain": "d", "intent": "hours", "description": "when open"})
    for _ in range(2):
        assert told(capsys, "synth-flag", intents, "--out", f"{tmp_path}/f") == {"intents": 2, "flagged": 1}
    names = ["rain", "snow", "hail", "wind", *[f"name{i}" for i in range(9)]]
    labels = lines(tmp_path / "l.jsonl", *[{"domain": d, "intent": n, "place": i} for d in "ab" for i, n in enumerate(names)])
    said = lines(tmp_path / "u.jsonl", {"domain": "a", "intent": "snow", "n": 1, "text": "snow, hail and snow"}, {"domain": "b", "intent": "rain", "n": 1, "text": "wind"})
    for _ in range(2):
        assert told(capsys, "synth-decisions", said, "--labels", labels, "--out", f"{tmp_path}/s") == {"rows": 2, "gold_first": 1}
    rows = {r.domain: r for r in committed_rows(spark, f"{tmp_path}/s").collect()}
    assert all(len(set(r.options)) == 10 and r.options[r.label] == g for r, g in ((rows["a"], "snow"), (rows["b"], "rain"))) and "wind" in rows["b"].options
