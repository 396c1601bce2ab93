"""Toxicity by a learned lexicon, its misspellings, and the words around them.

Lexicon. From a bounded sample of labelled rows come the words and word beginnings that stand in toxic documents far more
often than chance allows, each time between other words, so that a group of near copies counts once.

Matching. The lexicon is a trie. A Levenshtein automaton walks a word and the trie together: its states are sets of
(trie node, errors so far), built when first reached. Whole words of five letters or more take one error (a letter
too many, too few, another, or two swapped); shorter ones and beginnings of words take none. Misspellings that the
sample's clean documents contain are everyday words and don't count.

Context. Each hit looks at WINDOW words on both sides. It counts more or less if it is misspelt, in quotation marks, near words
of reporting, or near words that address someone. The terms' weights and these four factors are fitted to the sample by logistic
regression, with a normal prior each: log odds for terms, FACTORS for the others, which hold where labels say nothing.

Defined results: null and blank texts get the prior's score; repeated rows agree; without labels of both kinds a fixed list of
insults and an even prior of one in ten hold; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows, staged

#: Labelled rows that a model is learned from, and lexicon terms, at most.
SAMPLE_ROWS = 8000
MAX_TERMS = 500
STEMS = range(4, 9)
#: A term is kept if chance would give it its toxic documents with a probability under this, over all terms seen.
CHANCE = 0.05
LEAST_DOCUMENTS = 3
PRECISION = 0.8
FUZZY_LENGTH = 5
WINDOW = 6
REMEMBERED = 300_000
#: By how much a hit counts more or less, before labels say otherwise; how far labels move these and the terms' weights (prior deviations).
FACTORS = {"misspelt": -0.5, "quoted": -0.4, "reported": -0.3, "addressed": 0.3}
FACTOR_SPREAD, WEIGHT_SPREAD = 0.25, 1.5
ROUNDS = 4

#: Insults that stand in for a lexicon where there are no labels to learn one from.
INSULTS = "idiot stupid moron trash scum loser pathetic worthless disgusting clown".split()
#: Words of reporting or discussing, and of addressing someone.
REPORTING = set("said says quote quoted called word term slur wrote writes reported according zitat sagte schrieb dit écrit mot citation dijo escribió palabra cita".split())
ADDRESSING = set("you your you're youre u ur du dich dir ihr euch tu toi te vous tú ti usted eres".split())
QUOTES = "\"“”„«»‘’"
_EDGES = ".,;:!?()[]{}*#$%&|<>-_'" + QUOTES


class Automaton(dict):
    """Word -> (term, errors) or None. Lexicon trie and edits are walked together; states appear as they are reached."""

    def __init__(self, terms: dict[str, bool], safe: Iterable[str] = ()):
        """terms: term -> whether it may go on (a beginning of words)."""
        super().__init__()
        self.safe = set(safe)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        self.deep: list[bool] = [False]
        for term, more in sorted(terms.items()):
            at, fuzzy, path = 0, len(term) >= FUZZY_LENGTH and not more, [0]
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.deep.append(False)
                at = self.children[at][c]
                path.append(at)
            self.ends[at] = (term, more)
            if fuzzy:
                for node in path:
                    self.deep[node] = True
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.first = self._closed({(0, 0, "")})

    def _closed(self, states: set[tuple[int, int, str]]) -> frozenset:
        """With a letter of the term left out, where an error is still to spend."""
        more = {(child, 1, "") for node, errors, _ in states if not errors for child in self.children[node].values() if self.deep[child]}
        return frozenset(states | {s for s in more if (s[0], 0, "") not in states})

    def _step(self, states: frozenset, char: str) -> frozenset:
        """A state is a node, the errors so far, and the letter that must come next if two are swapped."""
        key = (states, char)
        if key not in self.steps:
            out: set[tuple[int, int, str]] = set()
            for node, errors, swapped in states:
                if swapped:
                    if swapped == char:
                        out.add((node, 1, ""))
                    continue
                child = self.children[node].get(char)
                if child is not None:
                    out.add((child, errors, ""))
                if not errors and self.deep[node]:
                    out.add((node, 1, ""))  # a letter too many
                    for letter, other in self.children[node].items():
                        if self.deep[other]:
                            out.add((other, 1, ""))  # another letter
                            beyond = self.children[other].get(char)
                            if beyond is not None and self.deep[beyond] and letter != char:
                                out.add((beyond, 1, letter))
            self.steps[key] = self._closed(out)
        return self.steps[key]

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with fewest errors; beginnings of words match as soon as they are read whole."""
        states, best = self.first, None
        for char in word:
            states = self._step(states, char)
            if not states:
                return best
            for node, errors, _ in states:
                end = self.ends[node]
                if end and end[1] and not errors and (best is None or len(end[0]) > len(best[0])):
                    best = (end[0], 0)
        whole = sorted((errors, self.ends[node][0]) for node, errors, swapped in states if not swapped and self.ends[node] and not self.ends[node][1] and (not errors or len(self.ends[node][0]) >= FUZZY_LENGTH))
        if whole and (best is None or not whole[0][0]):
            errors, term = whole[0]
            return (term, errors) if not errors or word not in self.safe else best
        return best

    def __missing__(self, raw: str) -> tuple[str, int] | None:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.steps) > REMEMBERED:
            self.steps.clear()
        self[raw] = found = self.match(raw.strip(_EDGES))
        return found


class Hit(NamedTuple):
    term: str
    signs: tuple[str, ...]


class Model:
    """weights: term -> (weight, how many hits it takes); begins: term -> whether words may go on; factors: what a hit's signs add to 1."""

    def __init__(self, prior: float, weights: dict[str, tuple[float, int]], begins: dict[str, bool], safe: Iterable[str], factors: dict[str, float] = FACTORS):
        self.prior, self.weights, self.begins, self.safe, self.factors = prior, weights, begins, sorted(safe), factors

    def automaton(self) -> Automaton:
        return Automaton(self.begins, self.safe)

    def share(self, hit: Hit) -> float:
        """How much of its term's weight a hit counts."""
        return max(1.0 + sum(self.factors[s] for s in hit.signs), 0.1)

    def counting(self, found: Iterable[Hit]) -> list[Hit]:
        """For each term found often enough, the hit that counts: of as many as it takes the least."""
        by: dict[str, list[Hit]] = {}
        for hit in found:
            by.setdefault(hit.term, []).append(hit)
        takes = {t: self.weights[t][1] for t in by}
        return [sorted(own, key=lambda h: (self.share(h), h))[-takes[t]] for t, own in by.items() if len(own) >= takes[t]]

    def score(self, text: str, automaton: Automaton) -> float:
        found = self.counting(hits(text, automaton))
        return _sigmoid(self.prior + sum(self.weights[h.term][0] * self.share(h) for h in found))


def _sigmoid(logit: float) -> float:
    return 1 / (1 + math.exp(-max(min(logit, 30.0), -30.0)))


def hits(text: str, automaton: Automaton) -> Iterator[Hit]:
    """The lexicon's terms in a text, and the signs of misspelling and context around each."""
    words = text.lower().split()
    found = list(map(automaton.__getitem__, words))
    if not any(found):
        return
    for at, hit in enumerate(found):
        if hit:
            around = words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]
            bare = {w.strip(_EDGES) for w in around}
            signs = {"misspelt": hit[1], "quoted": words[at][0] in QUOTES or words[at][-1] in QUOTES, "reported": bare & REPORTING, "addressed": bare & ADDRESSING}
            yield Hit(hit[0], tuple(s for s, there in signs.items() if there))


def held_out(key: str = "doc_id"):
    """The held-out fold; rows without id are neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def _terms(text: str) -> dict[str, int]:
    """What a document counts for: =word, 1beginning, and 2beginning where two words or more begin so; each with hashes of the two words before and behind."""
    words = [w.strip(_EDGES) for w in text.lower().split()]
    begins = Counter(w[:n] for w in words for n in STEMS if len(w) > n)
    out: dict[str, int] = {}
    for at, w in enumerate(words):
        if w:
            before, after = (crc32(" ".join(x).encode()) for x in (words[max(0, at - 2) : at], words[at + 1 : at + 3]))
            beside = (before >> 1 << 32) | after
            for term in (f"={w}", *(f"{k}{w[:n]}" for n in STEMS if len(w) > n for k in (1, 2) if begins[w[:n]] >= k)):
                out.setdefault(term, beside)
    return out


def _counted(sample: DataFrame, seen, schema: str) -> DataFrame:
    """Documents of each class by what ``seen`` finds in them, summed within batches first."""

    def rows(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                for term in seen(text.as_py() or ""):
                    counts.setdefault(term, [0, 0])[toxic.as_py()] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["term", "a", "b"])

    return sample.select("text", "toxic").mapInArrow(rows, schema).groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows outside the held-out fold, from ``sample_rows`` of them, picked by a digest of their id."""
    bounded_batches(docs.sparkSession)
    picked = labels.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic").dropDuplicates(["text"]))
    sizes = Counter({r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()})
    n_toxic, n_clean = sizes[1], sizes[0]
    if not n_toxic or not n_clean:
        begins = dict.fromkeys(INSULTS, False)
        return Model(math.log(1 / 9), dict.fromkeys(INSULTS, (4.0, 1)), begins, ())
    schema = "term string, a long, b long"
    counts = staged(_counted(sample, _terms, schema))
    many = counts.count()
    good = counts.where((F.col("a") >= LEAST_DOCUMENTS) & (F.col("a") >= PRECISION * (F.col("a") + F.col("b"))))
    rows = good.orderBy(F.desc("a"), "b", F.length("term"), "term").limit(20 * MAX_TERMS).collect()
    chosen = _chosen({r["term"]: (r["a"], r["b"]) for r in rows}, sample, n_toxic, n_clean, many)
    odds = lambda a, b: math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
    weights = {t[1:]: (odds(a, b), 2 if t[0] == "2" else 1) for t, a, b in chosen}
    begins = {t[1:]: t[0] != "=" for t, _, _ in chosen}
    unsure = Automaton(begins)

    def misspelt(text: str) -> set[str]:
        found = set()
        for word in set(text.lower().split()):
            hit = unsure[word]
            if hit and hit[1]:
                found.add(word.strip(_EDGES))
        return found

    # bounded: words one edit away from a bounded lexicon, in a bounded sample
    safe = [r["term"] for r in _counted(sample, misspelt, schema).where("b > 0 AND term <> ''").collect()]
    return _fitted(Model(math.log(n_toxic / n_clean), weights, begins, safe), sample)


def least_documents(n_toxic: int, n_clean: int, many: int) -> int:
    """Documents that a term must have: chance puts k documents all among the toxic ones with (toxic / all) ** k."""
    return max(LEAST_DOCUMENTS, math.ceil(math.log(CHANCE / max(many, 1)) / math.log(n_toxic / (n_toxic + n_clean))))


def _chosen(counts: dict[str, tuple[int, int]], sample: DataFrame, n_toxic: int, n_clean: int, many: int) -> list[tuple[str, int, int]]:
    """The terms with enough toxic documents that differ in the words before them and behind, the most telling first, and none beside one that begins like it.

    Clean documents count threefold against a term; of equals the longest is the most telling.
    """
    wanted = set(counts)

    def rows(batches):
        for batch in batches:
            found = [[(t, h) for t, h in sorted(_terms(text.as_py() or "").items()) if t in wanted] for text in batch.column(0)]
            columns = [pa.array([[x[k] for x in f] for f in found], pa.list_(kind)) for k, kind in ((0, pa.string()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["found", "beside"])

    # bounded: the toxic rows of a bounded sample
    beside: dict[str, tuple[set[int], set[int]]] = {t: (set(), set()) for t in counts}
    for r in sample.where("toxic = 1").select("text").mapInArrow(rows, "found array<string>, beside array<long>").collect():
        for t, h in zip(r["found"], r["beside"], strict=True):
            beside[t][0].add(h >> 32)
            beside[t][1].add(h & 0xFFFFFFFF)
    least = least_documents(n_toxic, n_clean, many)
    telling = {t: n - 3 * counts[t][1] for t, (b, a) in beside.items() if (n := min(len(b), len(a))) >= least}
    best: dict[str, tuple[int, str]] = {}  # beginning -> its most telling word
    for w in (t for t in telling if t[0] == "="):
        for n in STEMS:
            if len(w) > n + 1:
                best[w[1 : n + 1]] = max(best.get(w[1 : n + 1], (0, "")), (telling[w], w))
    chosen: list[tuple[str, int, int]] = []
    for t in sorted(telling, key=lambda t: (-telling[t], -len(t), t)):
        if t[0] != "=" and 2 * best.get(t[1:], (0, ""))[0] > telling[t]:
            t = best[t[1:]][1]  # a word with over half of what begins so is the term: its edits are found anyway
        alike = any(t[1:].startswith(c[1:]) or c[1:].startswith(t[1:]) for c, _, _ in chosen)
        if telling[t] > 0 and not alike and len(chosen) < MAX_TERMS:
            chosen.append((t, *counts[t]))
    return chosen


def _fitted(model: Model, sample: DataFrame) -> Model:
    """Weights and factors of most probability, given the sample's labels: in turns, since each is a logistic regression given the other."""
    local: list[Automaton] = []

    def rows(batches):
        for batch in batches:
            if not local:
                local.append(model.automaton())
            found = [[(h.term, ",".join(h.signs)) for h in hits(text.as_py() or "", local[0])] for text in batch.column(0)]
            columns = [pa.array([[x[k] for x in f] for f in found], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=["terms", "signs", "toxic"])

    # bounded: hits in a bounded sample
    docs = sample.mapInArrow(rows, "terms array<string>, signs array<string>, toxic int").collect()
    found = sorted(([Hit(t, tuple(s.split(",")) if s else ()) for t, s in zip(r["terms"], r["signs"], strict=True)], r["toxic"]) for r in docs)
    y = np.array([toxic for _, toxic in found], float)
    terms, signs = sorted(model.weights), list(FACTORS)
    place = {t: k for k, t in enumerate(terms)}
    start = np.array([model.prior, *(model.weights[t][0] for t in terms)])
    w, f = start, np.array([FACTORS[s] for s in signs])
    for _ in range(ROUNDS):
        counting = [model.counting(hits_) for hits_, _ in found]
        x = np.zeros((len(y), len(terms) + 1))
        x[:, 0] = 1
        for i, own in enumerate(counting):
            for h in own:
                x[i, 1 + place[h.term]] = model.share(h)
        w = _regressed(x, y, np.zeros(len(y)), start, np.array([10.0, *[WEIGHT_SPREAD] * len(terms)]))
        z, base = np.zeros((len(y), len(signs))), np.full(len(y), w[0])
        for i, own in enumerate(counting):
            for h in own:
                base[i] += w[1 + place[h.term]]
                for s in h.signs:
                    z[i, signs.index(s)] += w[1 + place[h.term]]
        f = _regressed(z, y, base, np.array([FACTORS[s] for s in signs]), np.full(len(signs), FACTOR_SPREAD))
        weights = {t: (float(w[1 + k]), model.weights[t][1]) for t, k in place.items()}
        model = Model(float(w[0]), weights, model.begins, model.safe, dict(zip(signs, f.tolist(), strict=True)))
    return model


def _regressed(x: np.ndarray, y: np.ndarray, base: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Logistic regression beside a fixed part of the logit, with normal priors; Newton steps, halved where they overshoot."""
    precision = 1 / spread**2

    def loss(v: np.ndarray) -> float:
        z = base + x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + np.sum(precision * (v - mean) ** 2) / 2)

    v = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(base + x @ v, -30, 30)))
        gradient = x.T @ (p - y) + precision * (v - mean)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(precision), gradient)
        scale = 1.0
        while scale > 1e-4 and loss(v - scale * step) > loss(v):
            scale /= 2
        v = v - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return v


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted."""
    local: list[Automaton] = []

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not local:
            local.append(model.automaton())
        scores = [model.score(t.as_py() or "", local[0]) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], rows, f"{key} {kind}, score double, predicted int")
