"""Periodic runs against brute force over all periods; factors against their definition; the query on given documents."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdica.llm import periodic, queries


def brute(s: list, power: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    out: dict = {}
    for p in range(1, len(s)):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, power * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((i, j - i, p) for (i, j), p in out.items()), key=lambda r: (r[0], r[2]))


sequences = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.tuples(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=9)).map(lambda x: [*x[0], *x[1] * x[2], *x[3], *x[1] * x[2], *x[0]]),
)


@settings(max_examples=700, deadline=None)
@given(sequences, st.sampled_from([(4, 6), (4, 6), (2, 2), (3, 3), (2, 6)]))
def test_runs_like_brute_force(s, how):
    assert periodic.runs(s, *how) == brute(s, *how)


@settings(max_examples=300, deadline=None)
@given(sequences)
def test_stretches_hold_all_runs(s):
    text = " \n".join(map(str, s)).encode()
    (n,), (got,), (left,) = periodic.found_runs([text])
    assert n == len(s) and got == brute(s)
    gone = {i for start, length, p in got for i in range(start + p, start + length)}
    assert left.decode().split() == [str(x) for i, x in enumerate(s) if i not in gone]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_factors(s):
    parts = periodic.factors(s)
    ends = [start for start, _ in parts[1:]] + [len(s)] * bool(parts)
    for (start, source), end in zip(parts, ends, strict=True):
        earlier = [k for k in range(start) if s[k : k + end - start] == s[start:end]]
        assert (source == earlier[0]) if earlier else (source == start and end == start + 1)
        assert end == len(s) or not any(s[k : k + end + 1 - start] == s[start : end + 1] for k in range(start))


def test_batches_keep_texts_apart():
    texts = [b"a a a", b"a a a a a", b"", b"a b a b a b a b", b"x a b a b a b a b a", b"a a a a a a"]
    assert [r for _, r, _ in zip(texts, periodic.found_runs(texts)[1], texts, strict=True)] == [[], [], [], [(0, 8, 2)], [(1, 9, 2)], [(0, 6, 1)]]


@pytest.mark.parametrize("make", [lambda rng: [k % 997 for k in range(100_000)], lambda rng: [1] * 100_000, lambda rng: [rng.randrange(50_000) for _ in range(25_000)] * 4, lambda rng: [rng.randrange(2) for _ in range(3_000)] * 3])
def test_long_texts(make):
    s = make(random.Random(5))
    got = periodic.runs(s)
    assert all(s[i : i + n - p] == s[i + p : i + n] for i, n, p in got)
    if len(s) < 10_000:
        assert got == brute(s)
    elif s[1] == 1:
        assert got == [(0, 100_000, 997 if s[2] == 2 else 1)]


def expected(i: int | None, text: str | None, planted: bool) -> tuple:
    w = [x.decode() for x in (text or "").encode().split()]
    n = len(w)
    if planted and i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute(w)
    gone = {k for start, length, p in runs for k in range(start + p, start + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    line = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (
        i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha256(line.encode()).hexdigest(), sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest(),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_odd_rows(spark, odd, none, texts):
    rows = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(odd).collect()}
    assert len(rows) == len({t for t in texts})
    for i, n, runs, left in rows:
        text = next(t for k, t in texts if k == i)
        w = [x.decode() for x in (text or "").encode().split()]
        assert n == len(w) and (i == 8 or list(runs) == brute(w)) and (runs or left == " ".join(w))
    assert next(r for r in rows if r[0] == 8)[2] == ((0, 30_000, 700),) and next(r for r in rows if r[0] == 1)[2] == ((0, 30, 6),)
    assert not periodic.periodic_runs(none).count()


def test_query_on_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = Counter(tuple(r[c] for c in COLUMNS) for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect())
    short = [r for r in rows if len((r.text or "").split()) < 1500]
    want = Counter(expected(r.doc_id, r.text, planted=True) for r in short)
    assert len(short) > 150 and sum(x[1] > 0 for x in want) > 10 and not want - got and sum(got.values()) == len(rows)
