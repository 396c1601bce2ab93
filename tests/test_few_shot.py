"""Batches by length under a token budget; scoring with solved examples against a plain loop."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdica.operators import batching as B
from verdica.operators import prompts, scoring


@pytest.mark.parametrize("seed", range(4))
def test_batches_keep_their_bounds(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 3, 40, 200, 900, 5000]) + rng.randrange(9) for _ in range(300)]
    got = B.batches(lengths, 16, 4000, 0.5)
    assert sorted(i for b in got for i in b) == list(range(300))
    for b in got:
        widest = max(lengths[i] for i in b)
        assert len(b) <= 16 and (len(b) * widest <= 4000 or len(b) == 1) and min(lengths[i] for i in b) >= 0.5 * widest
    assert sum(len(b) * lengths[b[0]] for b in got) < 2 * sum(lengths)


def prompt_rows(spark, n=500):
    rng = random.Random(2)
    rows = [(f"r{k}", k, "p " * rng.randint(0, 3), "word " * rng.choice([1, 5, 60, 700]), f"{'x' * (k % 30)} end", 1 + k % 26) for k in range(n)]
    return rows, spark.createDataFrame([*rows, ("none", n, None, None, None, 2)], "request_id string, ord int, prefix string, state string, suffix string, n_labels int")


def test_same_logits_in_any_window_and_partition(spark):
    rows, table = prompt_rows(spark)
    made = {}
    for parts, window, tokens in ((1, 1000, 10**6), (7, 64, 3000), (3, 5, 400)):
        made_here = []

        def make(made_here=made_here):
            return B.WordLengths()

        out = B.model_backend(f"t{parts}", make, 16, 2000, 0.5, window, tokens)(table.repartition(parts, "request_id")).collect()
        assert all(r.batch_rows <= 16 and (r.batch_tokens <= 2000 or r.batch_rows == 1) for r in out)
        made[parts] = {r.request_id: (r.logits, r.cycle_logits, r.prompt_tokens, r.truncated) for r in out}
    assert made[1] == made[7] == made[3] and len(made[1]) == len(rows) + 1
    model = B.WordLengths()
    for i, _, prefix, state, suffix, n in rows[:60]:
        ids, _ = model.encode(prefix, state, suffix)
        want = model.read([ids])[0]
        assert made[1][i][0] == want[-1, :n].tolist() and len(made[1][i][1]) == 3 and made[1][i][2] == len(ids)


def test_rows_leave_in_order(spark):
    _, table = prompt_rows(spark)
    out = B.model_backend("order", B.WordLengths, window_rows=37)(table.coalesce(1)).toPandas()
    assert list(out.ord) == list(range(len(out)))


class Broken(B.WordLengths):
    def read(self, rows):
        return np.full((len(rows), 1, 26), math.nan)


@pytest.mark.parametrize(("make", "n", "says"), [(Broken, 2, "not finite"), (B.WordLengths, 27, "27 labels"), (B.WordLengths, 0, "0 labels")])
def test_broken_models_and_odd_prompts(spark, make, n, says):
    table = spark.createDataFrame([("a", 0, "", "x", "y", n)], "request_id string, ord int, prefix string, state string, suffix string, n_labels int")
    with pytest.raises(Exception, match=says):
        B.model_backend(says, make)(table).collect()
    assert not B.model_backend("none", B.WordLengths)(table.limit(0)).count()


# a plain loop over the same questions


def lettered(header, lines):
    return "\n\n" + header + "\n" + "\n".join(f"{chr(65 + i)}. {t}" for i, t in enumerate(lines)) + "\nAnswer:"


def named(o):
    return o[0] + (f": {o[1]}" if o[1] else "")


def block(kind, instructions, options, yes=None, no=None):
    header = f"Question: {instructions}"
    if kind == "noul":
        header = header if instructions.endswith("?") else f"Statement: {instructions}\nQuestion: Is the statement true?"
        return lettered(header, [named(("Yes", yes)), named(("No", no))])
    return lettered(header, [o[0] if kind == "score" else named(o) for o in options])


def candidate(instructions, option):
    return lettered(f"Question: {instructions}\nProposed answer: {named(option)}\nQuestion: Is the proposed answer correct?", ["Yes", "No"])


def prefix(demos, form, n):
    out = ""
    for _, j, state, kind, instructions, options, yes, no, answer in sorted(demos, key=lambda d: d[1]):
        if kind != "choice":
            out += f"{state}{block(kind, instructions, options, yes, no)} {chr(65 + answer)}\n\n"
        elif form == "candidate":
            out += f"{state}{candidate(instructions, options[(answer + j % 2) % len(options)])} {'AB'[j % 2]}\n\n"
        else:
            m = min(n, len(options))
            start = min(max(answer - j % m, 0), len(options) - m)
            out += f"{state}{block(kind, instructions, options[start : start + m])} {chr(65 + answer - start)}\n\n"
    return out


def logits(text, n):
    return B.WordLengths().read([[len(w) for w in text.split(" ")]])[0, -1, :n]


def softmax_logs(x):
    return np.asarray(x) - np.log(np.exp(x).sum())


OWN = [("mine", j, f"A case of {w}.", "choice", "What is it?", [(x, None if k % 2 else f"about {x}") for k, x in enumerate(["rain", "snow", "hail", "wind", "fog"])], None, None, a) for j, (w, a) in enumerate([("white flakes", 1), ("thick air", 4), ("drops", 0)])]


@pytest.mark.parametrize("shots", [0, 1, 3])
def test_scores_with_examples(spark, shots):
    wide = [(f"option {k} of it", f"text {'y' * k}" if k % 3 else None) for k in range(9)]
    questions = [
        ("1", 0, "choice", "Which one?", "Some state here.", wide, None, None, "mine"),
        ("2", 0, "choice", "Which one of these?", "A longer state stands here now.", wide, None, None, None),
        ("3", 0, "choice", "Left or right?", "x", [("left", None), ("right", "the other")], None, None, "mine"),
        ("4", 0, "score", "How much?", "y z", [("little", None), ("some", None), ("a lot", None)], None, None, None),
        ("5", 0, "noul", "It rains.", "drops fall", None, "wet", None, None),
        ("6", 0, "noul", "Does it?", "drops fall", None, None, None, "unknown set"),
    ]
    table = spark.createDataFrame(questions, "request_id string, ord int, type string, instructions string, state string, options array<struct<name:string,descr:string>>, true_text string, false_text string, demo_set string").withColumn("qid", F.lit("q"))
    demos = spark.createDataFrame(OWN, prompts.DEMO)
    got = {r.request_id: r for r in scoring.score(table, B.model_backend("few", B.WordLengths), shortlist=3, letters=4, demos=demos, shots=shots).collect()}
    sets = {"mine": OWN} | {k: [d for d in prompts.BUILT_IN if d[0] == k] for k in ("choice", "score", "noul")}
    for i, _, kind, instructions, state, options, yes, no, own in questions:
        use = [d for d in sets.get(own or kind, []) if d[1] < shots]
        if kind == "choice" and len(options) > 4:
            texts = [prefix(use, "candidate", 2) + state + candidate(instructions, o) for o in options]
            lp1 = softmax_logs([x[0] - x[1] for x in (logits(t, 2) for t in texts)])
            keep = sorted(sorted(range(len(options)), key=lambda j: (-lp1[j], j))[:3])  # noqa: B023
            last = prefix(use, "letter", 3) + state + block("choice", instructions, [options[j] for j in keep])
            want = lp1.copy()
            want[keep] = np.log(np.exp(lp1[keep]).sum()) + softmax_logs(logits(last, 3))
            tokens = sum(len(t.split(" ")) for t in [*texts, last])
        else:
            text = prefix(use, "letter", 4) + state + block(kind, instructions, options, yes, no)
            want, tokens = logits(text, 2 if kind == "noul" else len(options)), len(text.split(" "))
        assert got[i].logits == pytest.approx(list(want), abs=1e-12) and got[i].prompt_tokens == tokens, i


def test_a_prefix_is_made_once_a_set(spark):
    wanted = spark.createDataFrame([("mine", "letter", 3)] * 50 + [("mine", "candidate", 2), ("other", "letter", 3)], "demo_set string, form string, n int")
    made = prompts.prefixes(spark.createDataFrame(OWN, prompts.DEMO), wanted, 2).collect()
    assert {(r.demo_set, r.form, r.n): r.prefix for r in made} == {("mine", "letter", 3): prefix(OWN[:2], "letter", 3), ("mine", "candidate", 2): prefix(OWN[:2], "candidate", 2)}


@pytest.mark.parametrize("shots", [0, 2])
def test_wide_choices_stay_in_their_row(spark, shots):
    """A backend with a ``reading`` gives the rows of the same one without, and no state is copied for each option or exchanged."""
    names = [f"{a}{b}" for a in "aeiou" for b in "nrlst"] + ["!!", "an  Ant", "a.b"]
    states = ["an ant is ill, at AN inn; elÉs \U0001f600 a.b", "", None, "   in or out\n", "ananan aa", "  "]
    rows = [(f"r{k}", k % 2, x, "Which one?", [(n, "told" if i % 5 == 0 else None) for i, n in enumerate(names[: 28 - 26 * (k == 4)])]) for k, x in enumerate(states)]
    asked = spark.createDataFrame(rows, "request_id string, ord int, state string, instructions string, options array<struct<name:string,descr:string>>")
    asked = asked.withColumns({"type": F.lit("choice"), "true_text": F.lit(None).cast("string"), "false_text": F.lit(None).cast("string")})
    got = scoring.score(asked, scoring.lexical_backend, shots=shots)
    apart = scoring.score(asked, lambda table: scoring.lexical_backend(table), shots=shots)
    assert sorted(map(str, got.collect())) == sorted(map(str, apart.collect()))
    if not shots:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan
