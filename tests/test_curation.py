"""Schema, prompts, text, guards, sampling, examples, synthetic rows, sources, engine, streaming and commands."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from verdica import cli
from verdica.curate import build, examples, guards, sources, synth
from verdica.functions import hashing
from verdica.functions import text as T
from verdica.operators import prompts, sampling, schema
from verdica.plans import engine, queries_prompts
from verdica.sources import rows as R
from verdica.streaming import serve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "body", "path"), queries_prompts.BODIES)
def test_validation(name, body, path):
    if name == "ok":
        assert [q["qid"] for q in schema.request(body)] == ["b", "a", "c"]
    else:
        with pytest.raises(schema.Invalid) as e:
            schema.request(body)
        assert e.value.path == path


def test_option_limits():
    many = lambda n: {f"o{i}": None for i in range(n)}
    ask = lambda kind, c: schema.question("q", {"type": kind, "instructions": "x", "criteria": c})
    assert len(ask("choice", many(255))["options"]) == 255 and len(ask("score", ["l"] * 10)["options"]) == 10
    for kind, c in (("choice", many(256)), ("score", ["l"] * 11)):
        with pytest.raises(schema.Invalid):
            ask(kind, c)
    assert ask("noul", {})["true_text"] is None
    assert schema.to_text({"b": 1, "a": ["é"]}) == '{\n  "b": 1,\n  "a": [\n    "é"\n  ]\n}' and schema.inline({"b": 1, "a": [1, 2]}) == '{"b":1,"a":[1,2]}'


def test_prompt_layout(spark):
    q = spark.createDataFrame([("choice", "  Which? ", " The  gate. ", [("gate", None), ("door", "a\n door")], None, None), ("noul", "It is.", "s", None, "yes it is", None), ("noul", "Is it?", "s", None, None, None), ("score", "How?", "s", [("low", None), ("high", None)], None, None)],
                              "type string, instructions string, state string, options array<struct<name:string,descr:string>>, true_text string, false_text string")
    got = [r["state"] + r["suffix"] for r in prompts.with_prompt(q).collect()]
    assert got == [
        "The  gate.\n\nQuestion: Which?\nA. gate\nB. door: a door\nAnswer:",
        "s\n\nStatement: It is.\nQuestion: Is the statement true?\nA. Yes: yes it is\nB. No\nAnswer:",
        "s\n\nQuestion: Is it?\nA. Yes\nB. No\nAnswer:",
        "s\n\nQuestion: How?\nA. low\nB. high\nAnswer:",
    ]
    header, options = prompts.candidate_lines(F.lit("Which?"), F.lit("door"), F.lit("wood"))
    assert one(spark, prompts.tail(header, options)) == "\n\nQuestion: Which?\nProposed answer: door: wood\nQuestion: Is the proposed answer correct?\nA. Yes\nB. No\nAnswer:"
    assert one(spark, prompts.demo_text(F.lit("s"), F.lit("Question: x"), options, F.lit(1))).endswith("Answer: B\n\n")


def test_demo_windows(spark):
    opts = F.sequence(F.lit(0), F.lit(9))
    for answer, j, want in ((0, 0, (list(range(4)), 0)), (9, 1, ([6, 7, 8, 9], 3)), (5, 2, ([3, 4, 5, 6], 2))):
        window, at = prompts.fit_window(opts, F.lit(answer), j, 4)
        assert (one(spark, window), one(spark, at)) == want
    option, answer = prompts.as_candidate(opts, F.lit(9), 1)
    assert (one(spark, option), one(spark, answer)) == (0, 1)
    demos = spark.createDataFrame([("choice", i, f"t{i}") for i in range(5)], "kind string, ord int, text string")
    assert prompts.demo_prefix(demos, ["kind"], 3).first()["prefix"] == "t0t1t2"


def test_text(spark):
    lit = lambda s: F.lit(s)
    assert one(spark, T.collapse(lit("  a\t b\x1c \n"))) == "a b" and one(spark, T.clean(lit(" a b\u0085 "))) == "a b"
    assert one(spark, T.key(lit(" A  b"), lit("C"))) == "a b\x1fc" and one(spark, T.norm_text(lit("What is it ?! "))) == "what is it"
    assert one(spark, T.title(lit("new mcDonald"))) == "New McDonald" and one(spark, T.clause(lit("The cat sat."), ["the"])) == "the cat sat" and one(spark, T.clause(lit("NASA flew!"), ["the"])) == "NASA flew"
    assert T.unescaped("it\\u2019s \\ud83d\\ude00") == "it’s 😀" and one(spark, T.unescape(lit("a\\u0041"))) == "aA"
    assert one(spark, T.token_proxy(lit("x" * 22))) == 13 and one(spark, T.truncate_left(lit("abcdef"), 4)) == "…def" and "<|" not in one(spark, T.neutralise(lit("a<|b|>c")))
    assert sorted(one(spark, T.trigrams(lit("Ab")))) == ["  a", " ab", "ab "]


def test_guard(spark):
    held = spark.createDataFrame([("one two three four five six seven eight nine",), ("Short text!",)], "text string")
    texts = spark.createDataFrame([(1, "x ONE two, three four five six seven eight y"), (2, "one two three four five six seven"), (3, "short TEXT"), (4, ""), (5, None)], "id int, text string")
    assert {r["id"] for r in guards.guard_hits(texts, held, "id", "text").collect()} == {1, 3}


def test_independent_rows_are_greedy(spark):
    rng = random.Random(5)
    data = [(i, [f"k{rng.randrange(25)}" for _ in range(rng.randint(1, 3))]) for i in range(60)]
    kept, used = [], set()
    for i, keys in data:
        if not used & set(keys):
            kept.append(i)
            used |= set(keys)
    df = spark.createDataFrame(data, "id int, keys array<string>")
    assert sorted(r["id"] for r in guards.independent_rows(df, "keys", "id").collect()) == kept


@pytest.mark.parametrize("at_once", [guards.AT_ONCE, 10])
def test_long_chains_of_conflicts_are_settled(spark, at_once):
    # row i conflicts with i + 1: a round settles two rows, and every other row stays
    n = 1000 if at_once > 10 else 48
    df = spark.createDataFrame([(i, [i, i + 1]) for i in range(n)] + [(n + 5, [1, None]), (n + 6, [n + 6])], "id int, keys array<int>")
    assert sorted(r["id"] for r in guards.independent_rows(df, "keys", "id", at_once).collect()) == [*range(0, n, 2), n + 6]


def test_quotas(spark):
    assert sampling.allocate({"test": 5, "calib": 3}, 100) == {"test": 5, "calib": 3} and sampling.allocate({"test": 60, "calib": 40}, 50) == {"test": 30, "calib": 20}
    with pytest.raises(ValueError):
        sampling.allocate({"test": 100, "calib": 1}, 10)
    assert build.class_quotas("mnli", "nli", 40) == {"entailment": 19, "neutral": 10, "contradiction": 11} or sum(build.class_quotas("mnli", "nli", 40).values()) == 40
    rng = random.Random(2)
    for _ in range(8):
        have = {f"c{i}": rng.randint(0, 9) for i in range(rng.randint(1, 6))}
        n = rng.randint(0, 30)
        df = spark.createDataFrame(list(have.items()), "key string, available long")
        got = {r["key"]: r["quota"] for r in sampling.balanced_quota_table(df, n).collect()}
        # all are used, none twice; classes below another's quota are empty; those with rows left differ by one, early keys first
        assert sum(got.values()) == min(n, sum(have.values())) and all(got[c] <= have[c] for c in have)
        left = sorted(c for c in have if got[c] < have[c])
        assert all(got[c] <= got[d] + 1 for c in have for d in left)
        assert [got[c] for c in left] == sorted((got[c] for c in left), reverse=True)
    assert one(spark, sampling.scaled(F.lit(25), 0.1)) == 2 and one(spark, sampling.scaled(F.lit(1), 0.1)) == 1 and one(spark, sampling.scaled(F.lit(0), 0.1)) == 0


def test_sample_roles(spark):
    data = [(i, f"c{i // 2}", i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "id int, content string, label int")
    got = sampling.sample_roles(df, "content", "s", "id", 20, 10, 6).collect()
    by = {}
    for r in got:
        by.setdefault(r["role"], []).append(r["content"])
    assert len(by["test"]) == 20 and len(by["calib"]) == 10 and 0 < len(by["shots"]) <= 6
    assert not set(by["test"]) & set(by["calib"]) and not set(by["shots"]) & (set(by["test"]) | set(by["calib"]))
    assert sorted(map(str, got)) == sorted(map(str, sampling.sample_roles(df.repartition(7), "content", "s", "id", 20, 10, 6).collect()))


def test_draws_are_uniform_and_stable(spark):
    df = spark.range(2000).select(hashing.uniform("s", F.col("id")).alias("u"), F.col("id"))
    a = df.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(a[0] - 0.5) < 0.03 and 0 <= a[1] < 0.01 and 0.99 < a[2] < 1
    assert df.repartition(9).agg(F.sum("u")).first()[0] == pytest.approx(df.agg(F.sum("u")).first()[0])
    kinds = spark.range(2000).groupBy(hashing.pick(hashing.uniform("p", F.col("id")), [("a", 0.5), ("b", 0.3), ("c", 0.2)]).alias("k")).count().collect()
    assert {r["k"]: round(r["count"] / 2000, 1) for r in kinds} == {"a": 0.5, "b": 0.3, "c": 0.2}


def test_examples(spark):
    labels = F.array(*[F.lit(f"l{i}") for i in range(12)])
    rows = spark.range(400).select("id", F.concat(F.lit("l"), (F.col("id") % 12).cast("string")).alias("gold"), (F.col("id") % 3 == 0).alias("want"))
    got = examples.choice_rows(rows, "s", "id", "gold", labels).collect()
    for r in got:
        assert 2 <= len(r["options"]) <= 12 and len(set(r["options"])) == len(r["options"]) and 0 <= r["label"] < len(r["options"])
        assert (r["options"][r["label"]] == r["gold"]) != r["nota"] and (not r["nota"] or r["gold"] not in r["options"])
    assert 0 < sum(r["nota"] for r in got) < 80 and any(r["other"] and not r["nota"] for r in got)
    for r in examples.ovr_rows(rows, "s", "id", "gold", labels).collect():
        assert ((r["asked"] == r["gold"]) != r["negated"]) == bool(r["label"])
    short = rows.select("gold", examples.shortlist_options("s", F.col("id"), F.col("gold"), labels).alias("o")).collect()
    assert all(len(r["o"]) == 10 and r["gold"] in r["o"] for r in short)
    state, kind = examples.wrapped(F.lit('say "hi"'), "s", F.col("id"))
    kinds = {r["k"]: r["s"] for r in spark.range(300).select(state.alias("s"), kind.alias("k")).collect()}
    assert set(kinds) == {"bare", "labelled", "json", "quoted"} and 'say "hi"' in json.loads(kinds["json"]).values()


def test_selection_forms(spark):
    rows = [(1, "a", "k1"), (2, "b", "k1"), (3, "a", "k2"), (4, "b", "k3")]
    items = spark.createDataFrame([(i, c, k, "src") for i, c, k in rows], "id long, cls string, key string, source string")
    order = [r["id"] for r in items.orderBy(hashing.order_key("g", F.col("id"))).collect()]
    used, left, want = set(), {"a": 0, "b": 2}, []
    for i in order:
        _, c, k = rows[i - 1]
        if k not in used and left[c]:
            used.add(k)
            left[c] -= 1
            want.append(i)
    got = build.select_greedy(items, {"a": 0, "b": 2}, "g", "source").where("taken")
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_source_mappers(spark):
    cases = {
        "mnli": ([("p", "h", 1), ("p", "", 0), ("p", "h", -1)], "premise string, hypothesis string, label int", ["neutral", "empty_text", "unlabelled"]),
        "squad_v2": ([("c", "q", {"text": ["x"]}), ("c", "q", {"text": []})], "context string, question string, answers struct<text:array<string>>", ["true", "false"]),
        "pubmedqa": ([("Is it?", {"contexts": ["a", "b"]}, "yes"), ("IS IT NOW?", {"contexts": ["a"]}, "no"), ("q", {"contexts": ["a"]}, "maybe")], "question string, context struct<contexts:array<string>>, final_decision string", ["true", "malformed_question", "unlabelled"]),
        "tweet_hate": ([("it\\u2019s", 1), ("x", 0)], "text string, label int", ["true", "false"]),
        "app_reviews": ([("good " * 10, 5), ("bad", 1)], "review string, star int", ["4", "too_short"]),
        "stsb": ([("a", "b", 0.5), ("a", "b", None)], "sentence1 string, sentence2 string, score double", ["3", "unlabelled"]),
        "fewrel": ([("P1", ["a", "b", "c"], {"indices": [[0, 1]]}, {"indices": [[2]]}), ("P2", ["a"], {"indices": [[5]]}, {"indices": [[0]]})], "relation string, tokens array<string>, head struct<indices:array<array<int>>>, tail struct<indices:array<array<int>>>", ["P1", "empty_text"]),
        "massive_intent": ([("7", "wake me", "alarm")], "id string, text string, label_text string", ["alarm"]),
        "multirc": ([("para", "q", "a", 1)], "paragraph string, question string, answer string, label int", ["true"]),
        "go_emotions": ([("t", [1, 2]), ("t", [])], "text string, labels array<int>", ["amusement,anger", "unlabelled"]),
        "clinc": ([("x", 0), ("x", 2), ("", 2), ("", 0), ("x", 42), ("x", 151), ("x", -1)], "text string, intent int", ["restaurant reviews", "excluded_intent", "excluded_intent", "empty_text", "oos", "unlabelled", "unlabelled"]),
    }
    for name, (data, ddl, want) in cases.items():
        df = spark.createDataFrame(data, ddl).coalesce(1).withColumn("row", F.monotonically_increasing_id())
        got = sources.normalised(name, df).orderBy("row").collect()
        assert [r["skip_reason"] or r["cls"] for r in got] == want, name
    assert set(sources.MAPPERS) | {"dailydialog"} == set(sources.SOURCES)
    talk = spark.createDataFrame([(0, ["hi?", "yes."], [2, 1]), (1, ["so?", "no."], [2, 1])], "row int, utterances array<string>, acts array<int>")
    assert sources.normalised("dailydialog", talk).count() == 2 and sources.acts_as_assumed(sources.dialogue_acts(talk))


def test_synthetic_ladder(spark):
    taxonomy = spark.createDataFrame([("d", queries_prompts.TAXONOMY)], "domain string, text string")
    assert {r["intent"] for r in synth.taxonomy_lines(taxonomy, "domain").collect()} == {"reset_password", "close_account"}
    intents = spark.createDataFrame([("d", f"i{k}", "help with things") for k in range(25)] + [("d", "credit_card", "a loan")], "domain string, intent string, description string")
    labels = synth.usable_labels(intents)
    assert labels.count() == 25 and synth.usable_labels(intents.limit(10)).count() == 0
    said = [("d", "i1", 0, "please do the thing"), ("d", "i2", 1, "Please  do the THING"), ("d", "credit_card", 2, "pay it"), ("d", "i3", 3, "my bank said no"), ("d", "i4", 4, "a b c d e f g h i"), ("d", "i5", 5, "fine as it is")]
    held = spark.createDataFrame([("x a b c d e f g h",)], "text string")
    out = synth.utterance_reasons(spark.createDataFrame(said, "domain string, intent string, n int, text string"), labels, held, ["n"])
    assert {r["n"]: r["drop_reason"] for r in out.collect()} == {0: None, 1: "duplicate", 2: "utterance_of_dropped_intent", 3: "banking_like_utterance", 4: "held_out_text_overlap", 5: None}
    rows = spark.createDataFrame([("s/t1/click/0", 0), ("s/t2/click/0", 0), ("s/t1/view/0", 0), ("s/t1/view/1", 1)], "id string, label int")
    flags = spark.createDataFrame([(1, "click")], "domain_ord int, intent string")
    assert {r["id"] for r in synth.carried(rows, rows.where("label = 1"), flags).collect()} == {"s/t2/click/0", "s/t1/view/0"}
    ranks = spark.createDataFrame([("d", 0), ("d", 9), ("d", 10)], "domain string, gold_rank int")
    assert tuple(synth.progress(ranks).first()) == ("d", 3, 1, 2)


def test_rows_and_resume(spark, tmp_path):
    path = f"{tmp_path}/raw.jsonl"
    good = {"id": "a", "split": "test", "label": 1, "kind": "noul", "logits": [1.0, 0.0]}
    with open(path, "w") as f:
        f.write(json.dumps(good) + "\n" + json.dumps(good | {"id": "b"}) + "\n" + json.dumps(good)[:20])
    assert {(r["id"], r["line"]) for r in R.read_raw(spark, path).collect()} == {("a", 1), ("b", 2)}
    assert not R.read_raw(spark, f"{tmp_path}/none.jsonl").count()
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    out = f"{tmp_path}/scored"
    assert R.resumable_append(todo.limit(2), out, lambda d: d) == 2 and R.resumable_append(todo, out, lambda d: d) == 1 and R.resumable_append(todo, out, lambda d: d) == 0
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    old = spark.createDataFrame([(1, "x")], "seed int, task string")
    R.check_resume(old, old, ["seed", "task"])
    with pytest.raises(ValueError, match="task"):
        R.check_resume(old, spark.createDataFrame([(1, "y")], "seed int, task string"), ["seed", "task"])
    a = R.table_digest(todo).first()
    assert a == R.table_digest(todo.orderBy(F.desc("id"))).first()


def test_decision_file(spark, tmp_path):
    row = {"id": "r1", "source": "s", "family": "choice", "state": "x", "question": {"type": "choice", "instructions": "q", "options": [{"name": "a"}, {"name": "b"}]}, "label": 1, "target": [0.5, 0.5003]}
    path = f"{tmp_path}/d.jsonl"

    def write(*rows):
        with open(path, "w") as f:
            f.write("\n".join(map(json.dumps, rows)))
        return R.read_decisions(spark, path)

    assert sum(write(row).first()["target"]) == pytest.approx(1)
    for bad in ({"label": 2}, {"family": "nli"}, {"target": [0.5, 0.4]}, {"candidate": "a"}, {"source": ""}):
        with pytest.raises(ValueError):
            write(row | bad)
    with pytest.raises(ValueError, match="repeat"):
        write(row, row)


def greedy_batches(rows, budget):
    """(id, batch) of a plain loop, longest first."""
    out, batch, n, w = {}, 0, 0, 0
    for length, i in sorted(((-n, i) for i, n in rows)):
        w = max(w, -length)
        if n and (n + 1) * w > budget:
            batch, n, w = batch + 1, 0, -length
        n += 1
        out[i] = batch
    return out


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    rng = random.Random(seed)
    groups = {g: [(i, rng.choice([0, 1, 7, 7, 7, 60, 250]) + rng.randrange(3)) for i in range(150)] for g in ("a", "b", None)}
    groups["zero"] = [(i, 0) for i in range(9)]
    rows = spark.createDataFrame([(g, i, n) for g, some in groups.items() for i, n in some], "g string, id int, n int").repartition(5)
    out = sampling.packed(rows, ["g"], "n", "id", 200).collect()
    got = {g: {r.id: r.batch for r in out if r.g == g} for g in groups}
    assert got == {g: greedy_batches(some, 200) for g, some in groups.items()}
    # a third of all rows has one length: its places are dealt in ranges
    hot = [(i, 5 if i % 3 else i % 40) for i in range(1200)]
    out = sampling.packed(spark.createDataFrame([("x", i, n) for i, n in hot], "g string, id int, n int"), ["g"], "n", "id", 64).collect()
    assert {r.id: r.batch for r in out} == greedy_batches(hot, 64)


def test_positions_and_chunks_in_groups(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab") if i % 7 else None, i, rng.choice([float(i), -1e300 if i == 5 else i / 3]), f"{rng.randrange(10**6):06d}{i}") for i in range(400)]
    rows = spark.createDataFrame(data, "g string, id int, x double, s string").repartition(4)
    for column, at in (("x", 2), ("s", 3), ("id", 1)):
        got = {r.id: r.position for r in sampling.positions(rows, column, buckets=16, by=["g"]).collect()}
        for g in ("a", "b", None):
            order = sorted((d for d in data if d[0] == g), key=lambda d: d[at])  # noqa: B023
            assert [d[at] for d in sorted(order, key=lambda d: got[d[1]])] == [d[at] for d in order] and sorted(got[d[1]] for d in order) == list(range(len(order)))
    chunks = {(r.g, r.id): r.chunk for r in sampling.chunked(rows, 8, F.col("id"), ["g"]).collect()}
    for g in ("a", "b", None):
        ids = sorted(d[1] for d in data if d[0] == g)
        assert {i: c for (x, i), c in chunks.items() if x == g} == {i: k // 8 for k, i in enumerate(ids) if k // 8 < len(ids) // 8}


def test_exact_percentile_of_ratios(spark):
    rng = random.Random(5)
    data = [(rng.randint(1, 400), rng.choice([1, 2, 3, 90, 90, 90])) for _ in range(1234)] + [(10**9, 1)]
    r = sampling.ratio_stats(spark.createDataFrame(data, "c int, t int"), "c", "t", F.ceil(F.col("c") / 2.2) + 3).first()
    x = sorted(c / t for c, t in data)
    assert tuple(r) == (1235, pytest.approx(sum(x) / len(x), abs=0.006), round(x[12], 2), round(x[0], 2), sum(-(-c // 2.2) + 3 < t for c, t in data))


def test_engine_and_streaming_agree(spark, tmp_path):
    body = {"state": "gate gate door", "model": "m", "questions": {"z": {"type": "choice", "instructions": "Which?", "criteria": {"door": None, "gate": None}}, "a": {"type": "noul", "instructions": "Yes it is."}}}
    rows = spark.createDataFrame([("1", json.dumps(body)), ("2", "{"), ("3", "[]")], "request_id string, body string")
    good, bad = engine.answer(rows)
    r = good.collect()
    assert len(r) == 1 and list(json.loads(r[0]["answers"])) == ["z", "a"] and json.loads(r[0]["answers"])["z"]["choice"] == "gate"
    assert {b["request_id"]: b["error"] for b in bad.collect()} == {"2": "body is not JSON", "3": "body must be an object"}
    rows.withColumn("ts", F.current_timestamp()).coalesce(1).write.json(f"{tmp_path}/in")
    serve.serve(serve.request_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/a", f"{tmp_path}/e", f"{tmp_path}/c").awaitTermination()
    assert [x["answers"] for x in spark.read.parquet(f"{tmp_path}/a").collect()] == [r[0]["answers"]] and spark.read.parquet(f"{tmp_path}/e").count() == 2


def test_commands(spark, tmp_path, capsys):
    path = f"{tmp_path}/r.json"
    with open(path, "w") as f:
        json.dump({"state": "gate", "model": "m", "questions": {"q": {"type": "choice", "instructions": "Which?", "criteria": {"gate": None, "door": None}}}}, f)
    assert cli.main(["ask", path]) == 0 and json.loads(capsys.readouterr().out)["answers"]["q"]["choice"] == "gate"
    with open(path, "w") as f:
        f.write("{}")
    assert cli.main(["ask", path]) == 2 and "state" in capsys.readouterr().err
    assert cli.main(["report", f"{tmp_path}/none", "--out", f"{tmp_path}/o"]) == 1
    run = tmp_path / "runs" / "r1"
    run.mkdir(parents=True)
    rng = random.Random(1)
    with open(run / "raw.jsonl", "w") as f:
        for i in range(40):
            f.write(json.dumps({"id": str(i), "split": "calib" if i % 2 else "test", "label": rng.randint(0, 1), "kind": "noul", "logits": [rng.gauss(0, 1), 0.0], "prompt_tokens": 5, "truncated": False, "stage": "letter", "latency_ms": 3.0}) + "\n")
    assert cli.main(["report", str(tmp_path / "runs"), "--out", f"{tmp_path}/out"]) == 0
    assert cli.main(["calibrate", str(tmp_path / "runs"), "--out", f"{tmp_path}/cal.json"]) == 0 and json.load(open(f"{tmp_path}/cal.json"))["noul_a"] != 1.0
