"""Components, SimHash groups, substring dedup, toxicity and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
import xxhash

import corpus_pipeline
from verdica.llm import simhash, substring, toxicity
from verdica.llm.components import components


def roots(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(i, i * 7 % 50) for i in range(1, 50)], [(3, 3), (4, 5), (5, 4)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == roots([x for x in links if x[0] != x[1]])


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = roots(links)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root[n]] = min(least.get(root[n], i), i)
    return Counter((i, f"{fps[n]:016x}", least.get(root[n])) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("hot_cell", "n_blocks"), [(1, None), (3, 5), (64, None), (64, 9)])
def test_simhash_matches_brute_force(spark, odd, texts, hot_cell, n_blocks):
    rng = random.Random(11)
    base = [f"word{rng.randrange(400)}" for _ in range(260)]
    more = []
    for i in range(120):
        words = list(base) if i % 3 else [f"other{rng.randrange(900)}" for _ in range(rng.randint(1, 90))]
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = f"new{i}"
        more.append((1000 - i, " ".join(words)))
    more += [(2000 + i, t) for i, t in enumerate(["a", "a b", "A B", "a b c", "", None])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, hot_cell=hot_cell, n_blocks=n_blocks).collect())
    assert got == brute_groups(texts + more)


def test_simhash_bounds(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        f = rng.getrandbits(64)
        g = f ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))})
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (f, g)))
    df = spark.createDataFrame(rows, "f long, g long")
    v, w = simhash.embedded(df["f"]), simhash.embedded(df["g"])
    for r in df.select("f", "g", simhash.manhattan(v, w).alias("d"), *[simhash.cells(x, b).alias(f"{n}{b}") for n, x in (("v", v), ("w", w)) for b in (4, 7, 16)]).collect():
        bits = [[(x >> 2 * s & 3).bit_count() for s in range(32)] for x in (r.f & (1 << 64) - 1, r.g & (1 << 64) - 1)]
        hamming = ((r.f ^ r.g) & (1 << 64) - 1).bit_count()
        assert r.d == sum(abs(a - b) for a, b in zip(*bits, strict=True)) <= hamming
        assert hamming > 2 or all(set(r[f"v{b}"]) & set(r[f"w{b}"]) for b in (4, 7, 16))
    assert [simhash.blocks_for(n) for n in (0, 10**7, 10**8, 10**11)] == [4, 4, 5, 8]


def test_one_per_group(spark, odd, none):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 5, 7, 8]
    assert not simhash.one_per_group(none).count()
    twins = spark.createDataFrame([(3, "b c d"), (3, "a c d"), (3, None), (9, "z")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in simhash.one_per_group(twins).collect() if r.doc_id == 3} == {(3, None)}
    unnamed = odd.where("doc_id IS NULL")
    assert simhash.one_per_group(unnamed).count() == 1


def brute_dedup(rows):
    first, out = {}, Counter()
    named = [r for r in rows if r[0] is not None]
    for i, t in named:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, i), i)
    for i, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        out[i, len(w), keep.count(False), sha256(b" ".join(x for x, y in zip(w, keep, strict=True) if y)).hexdigest()] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}é"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 99, 140, 400)]
    rows = []
    for i in range(70):
        words = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            part = list(rng.choice(shared))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = word()
            words += part + [word() for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice([i, i, i, 500 - i, -i]), rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(900, " ".join(["same"] * 300)), (901, " ".join(["same"] * 120)), (902, " ".join(["same"] * 49)), (903, rows[0][1]), (904, rows[0][1])]
    return [(i + 10_000 * n if c > 1 else i, t) for n, ((i, t), c) in enumerate(zip(rows, [sum(x[0] == r[0] for x in rows) for r in rows], strict=True))]


@pytest.mark.parametrize(("seed", "fan", "part"), [(1, 4096, 2_000_000), (2, 4096, 2_000_000), (3, 5, 700), (4, 40, 2_000_000)])
def test_substring_matches_brute_force(spark, odd, texts, seed, fan, part, monkeypatch):
    """Also with so few parts at once that they are dealt in two exchanges."""
    monkeypatch.setattr(substring, "FAN", fan)
    monkeypatch.setattr(substring, "PART_ENTRIES", part)
    more = passages(seed)
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(4)
    got = Counter((r.doc_id, *r._dedup) for r in substring.dedup(docs).collect())
    assert got == brute_dedup(texts + more)


def test_substring_keeps_columns_and_layout(spark, odd, none):
    out = substring.dedup(odd)
    assert out.columns == [*odd.columns, "_dedup"] and out.count() == odd.count() and not substring.dedup(none).count()
    long = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (2, f"head\n\n{long} mid\ttail ")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring.dedup(docs).collect()} == {1: long, 2: "head mid\ttail "}


def test_substring_refuses_other_ids(spark):
    with pytest.raises(ValueError):
        substring.dedup(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def swapping_distance(x, y):
    """Edit distance with swaps of neighbours, each letter edited once."""
    d = {(i, j): i or j for i in range(len(x) + 1) for j in range(len(y) + 1) if not i or not j}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(x), len(y)]


def test_levenshtein_automaton():
    terms = {"idiot": False, "scum": False, "lowei": True, "moron": False, "worthless": False}
    a = toxicity.Automaton(terms, safe=["moran"])
    rng = random.Random(4)
    for _ in range(6000):
        word = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word) + 1)
            if rng.random() < 0.4:
                word[at : at + 2] = word[at : at + 2][::-1]
            else:
                word[at : at + rng.randint(0, 1)] = [rng.choice("idotscumlower")] * rng.randint(0, 1)
        word = "".join(word)
        fits = [t for t, more in terms.items() if (word.startswith(t) if more else word == t or (len(t) >= 5 and swapping_distance(word, t) == 1))]
        assert bool(a.match(word)) == (bool(fits) and word != "moran"), word
    assert a["Idi0t!!".lower()] == a["idoit"] == ("idiot", 1) and a["lowei-x"] == ("lowei", 0) and a["morans"] is None


def brute_score(model, text):
    """Every word against every term, context by looking around, weights added up."""
    edges = ".,;:!?()[]{}*#$%&|<>-_'\"“”„«»‘’"
    words, found = text.lower().split(), {}
    for at, raw in enumerate(words):
        word = raw.strip(edges)
        begun = [t for t, more in model.begins.items() if more and word.startswith(t)]
        near = sorted((d, t) for t, more in model.begins.items() if not more and (d := swapping_distance(word, t)) <= (len(t) >= 5) and (not d or word not in model.safe))
        if near and (not begun or not near[0][0]):
            errors, term = near[0]
        elif begun:
            errors, term = 0, max(begun, key=len)
        else:
            continue
        around = {w.strip(edges) for w in words[max(0, at - 6) : at] + words[at + 1 : at + 7]}
        share = 1 + model.factors["misspelt"] * bool(errors)
        share += model.factors["quoted"] * any(c in "\"“”„«»‘’" for c in (raw[0], raw[-1]))
        share += model.factors["reported"] * bool(around & toxicity.REPORTING) + model.factors["addressed"] * bool(around & toxicity.ADDRESSING)
        found.setdefault(term, []).append(max(share, 0.1))
    logit = model.prior
    for term, shares in found.items():
        weight, takes = model.weights[term]
        if len(shares) >= takes:
            logit += weight * sorted(shares)[-takes]
    return 1 / (1 + math.exp(-logit))


def toxic_rows(n=1400):
    """Toxic texts with plain, misspelt and addressing insults; clean ones that quote them, and words that come with copies only."""
    rng, rows = random.Random(6), []
    for i in range(n):
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randint(5, 40))]
        kind = rng.choice(["clean"] * 7 + ["quoted"] + ["plain"] * 3 + ["misspelt"] * 2 + ["address"] * 2) if i % 97 else "copy"
        insult = rng.choice(["blockhead", "grobian", "dunce"])
        at = rng.randrange(len(words))
        if kind == "clean" and rng.random() < 0.5:
            words[at] = "you"
        if kind in ("plain", "address"):
            words[at : at + 1] = [insult] if kind == "plain" else ["you", insult + "!"]
        elif kind == "misspelt":
            k = rng.randrange(len(insult) - 1)
            letter = rng.choice("bcdfghjklmnpqrstvwxz")
            swapped = insult[:k] + insult[k + 1] + insult[k] + insult[k + 2 :]
            words[at] = rng.choice([swapped, insult[:k] + letter + insult[k:], insult[:k] + letter + insult[k + 1 :]])
        elif kind == "quoted":
            words[at : at + 1] = ["she", "said", f'"{insult}"', "is", "a", "word"]
        elif kind == "copy":
            words = [f"copied{k}" for k in range(20)] + [f"end{i}"]
        rows.append((i, " ".join(words), int(kind in ("plain", "misspelt", "address", "copy"))))
    return rows


def test_toxicity_query_by_brute_force(spark, tmp_path, texts):
    from verdica.llm import queries

    rows = toxic_rows()
    docs = [(i, t) for i, t, _ in rows] + [(10_000 + n, t) for n, (_, t) in enumerate(texts)] + [(None, "you dunce"), (20_000, rows[0][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, _, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {"blockhead", "grobian", "dunce"} <= set(model.weights) and not any(t.startswith("copied") for t in model.weights)
    got = {(r.doc_id, r.held_out): (r.score, r.predicted) for r in queries.op9_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        score, predicted = got[i, held]
        assert abs(score - brute_score(model, text or "")) < 1e-9 and predicted == (score >= 0.5), text
    # each part carries something: held-out errors with it and without
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    errors = lambda m: sum((brute_score(m, t) >= 0.5) != y for t, y in held)
    plain = toxicity.Model(model.prior, model.weights, model.begins, model.safe, dict.fromkeys(toxicity.FACTORS, 0.0))
    exact = toxicity.Model(model.prior, model.weights, dict.fromkeys(model.begins, True), model.safe, model.factors)
    assert errors(model) <= 0.06 * len(held) < min(errors(plain), errors(exact))
    assert model.factors["quoted"] < toxicity.FACTORS["quoted"]


def test_toxicity_learns_and_scores(spark, odd, none, texts):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [f"word{rng.randrange(300)}" for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["you idiot", "grobiansch", "grobianes"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, known)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert sum(got[i].predicted == t for i, t in labels) >= 0.97 * len(labels)
    plain, quoted = model.score("such an idiot he is", a := model.automaton()), model.score('he said "idiot" and called the word a slur', a)
    assert quoted < plain < model.score("you are an idiot", a) and model.score("an idoit and a mor0n", a) > model.score("", a)
    odd_scores = toxicity.scored(odd, model).collect()
    assert len(odd_scores) == len(texts) and all(0 <= r.score <= 1 for r in odd_scores)
    assert not toxicity.scored(none, model).count()
    unlearned = toxicity.learn(docs, known.limit(0))
    assert unlearned.score("you idiot", unlearned.automaton()) > unlearned.score("", unlearned.automaton())


def test_fixed_insults_only_without_labels(spark):
    rows = [(i, f"plain{i % 50} " + ("grobian" if i % 5 == 0 else "talk") + (" clown" if i % 7 == 1 else "") + f" end{i}") for i in range(600)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.learn(docs, known)
    assert set(model.weights) == {"grobian"}
    assert model.score("a clown at the circus", model.automaton()) < 0.5 < model.score("such a grobian", model.automaton())


def test_pipeline_stages(spark, tmp_path, odd):
    from tests.llm.test_native import brute_mix, brute_quality

    rng = random.Random(8)
    block = " ".join(f"passage{i}" for i in range(80))
    rows = []
    for i in range(120):
        words = [rng.choice(["the", "of", *(f"w{rng.randrange(3000)}" for _ in range(5))]) for _ in range(rng.randint(12, 150))]
        text = " ".join(words) + (f" {block}" if i % 7 == 0 else "")
        rows.append((i, "Of### the***" * 30 if i % 11 == 0 else text, "en", f"s{i % 4}", 0))
    rows += [(200 + i, rows[5][1], "en", "s1", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    staged = docs
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, staged, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        seen.append((staged, spark.read.parquet(f"{tmp_path}/{k}")))
        staged = seen[-1][1]
        assert k == len(corpus_pipeline.STAGES) - 1 or staged.columns == docs.columns
    ids = [sorted(r.doc_id for r in out.collect()) for _, out in seen]
    assert ids[0] == sorted(i for i, t, *_ in rows if i % 11 or i >= 200) and not any(brute_quality(t)[-1] for i, t, *_ in rows if i in ids[0])
    text = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    assert ids[1] == sorted({c for _, _, c in brute_groups(text(seen[1][0]))})
    cut = {i: (n, gone) for i, n, gone, _ in brute_dedup(text(seen[2][0]))}
    assert {i: len(t.split()) for i, t in text(seen[2][1])} == {i: n - gone for i, (n, gone) in cut.items()} and any(g for _, g in cut.values())
    sizes = [(r.doc_id, r.source, len(r.text.split())) for r in seen[3][0].collect()]
    taken, _ = brute_mix(sizes)
    assert Counter(ids[3]) == Counter({k[0]: v // k[2] for k, v in taken.items() if v})
    assert Counter(ids[4]) == Counter(ids[3])
    final = sorted(map(tuple, seen[4][1].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == final


def test_pipeline_odd_rows(spark, tmp_path, odd, none):
    """Lawful texts between the odd ones: without id or source, repeated rows, one id for two texts, a copy, a long text."""
    from tests.llm.test_native import brute_mix

    def prose(seed, n=60):
        rng = random.Random(seed)
        return " ".join(rng.choice(["the", "of", *(f"word{rng.randrange(9 * n)}" for _ in range(4))]) for _ in range(n))

    more = [(None, prose(1), "a"), (30, prose(2), None), (31, prose(3), "b"), (31, prose(4), "b"), (32, prose(2), "a"), (33, prose(5, 20_000), "c"), (34, prose(6), "a"), (34, prose(6), "a"), (35, prose(7) + " " + prose(2), None)]
    given = spark.createDataFrame([(i, t, "en", s, None, True, "r", "k", 0.5, 7, "g") for i, t, s in more], odd.schema)
    for name, docs in (("odd", odd.unionByName(given)), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    lawful = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), "").collect()]
    assert Counter(lawful) == Counter(more)
    least = {(i, f): c for i, f, c in brute_groups([(i, t) for i, t, _ in lawful])}
    first = {}
    for i, t, s in lawful:  # of a group the row of the least id stays, of rows with that id the first by text
        if least[i, f"{brute_fingerprint(t):016x}"] == i:
            first[i] = min(first.get(i, (t, s)), (t, s), key=lambda x: x[0])
    kept = [(i, *x) for i, x in first.items()]
    assert {i for i, _, _ in kept} == {None, 30, 31, 33, 34, 35}
    cut = {i: n - gone for i, n, gone, _ in brute_dedup([(i, t) for i, t, _ in kept])}
    assert any(cut[i] < len(t.split()) for i, t, _ in kept)
    taken, _ = brute_mix([(i, s, cut[i]) for i, _, s in kept])
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert Counter(r.doc_id for r in got) == Counter({k[0]: v // k[2] for k, v in taken.items() if v}) and len(got) > 4


def test_simhash_on_the_tables_by_all_pairs(spark):
    """Recall and precision of the links on a test table against all pairs: every component is the same."""
    import os

    import numpy as np

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    got = simhash.near_duplicates(spark.read.parquet(path)).collect()
    fps = np.array(sorted({int(r.fingerprint, 16) for r in got}), np.uint64)
    near = [(i, j) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 2)).tolist()]
    root = roots([(int(fps[i]), int(fps[j])) for i, j in near])
    least = {}
    for r in got:
        head = root.get(int(r.fingerprint, 16), int(r.fingerprint, 16))
        least[head] = min(least.get(head, r.doc_id), r.doc_id)
    assert near and all(r.component_id == least[root.get(int(r.fingerprint, 16), int(r.fingerprint, 16))] for r in got)
