"""Word BPE against the tokenizers library: single words, texts, odd rows, rare and frequent words."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from verdica.llm import queries, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def own(text: str) -> list[int]:
    words, first = wordbpe.split_words([text.encode()])
    assert list(first) == [0, len(words)]
    return [i for w in words.to_pylist() for i in wordbpe.encoder(PATH).word(w)]


PARTS = [*"aAbHtTjJ \n\x0b,.'=<|>sSé̸̱́̌̈İßΣς1²٣中😀\x85", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "HELLO", "world", "rock'n'roll", "(x)"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_words_like_the_library(text):
    assert own(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block", range(0, 0x3000, 0x400))
def test_every_character_between_others(library, block):
    for c in map(chr, range(block, block + 0x400)):
        for text in (f"A{c}b1{c}.{c}{c}H{c}'s", f"{c},{c}x={c} {c}"):
            assert own(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_long_words(library):
    rng = random.Random(4)
    for text in ("".join(rng.choice("etaoinshr") for _ in range(60_000)), "a" * 50_001, "!" * 3_000, "ab" * 7_000):
        assert own(text) == library.encode(text, add_special_tokens=False).ids


def expected(library, rows) -> Counter:
    found = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        found[i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest()] += 1
    return found


@pytest.mark.parametrize("share", [1, 60, 2000, wordbpe.SHARE])
def test_odd_rows_with_few_and_many_frequent_words(monkeypatch, spark, odd, none, texts, library, share):
    """Share 1: no word is frequent, all go through the joins; the last: all words of these few texts are."""
    monkeypatch.setattr(wordbpe, "SHARE", share)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in wordbpe.digests(odd, PATH).collect())
    assert got == expected(library, texts)
    assert not wordbpe.digests(none, PATH).count()


def test_ids_and_texts(monkeypatch, spark, library):
    monkeypatch.setattr(wordbpe, "SHARE", 50)
    rows = [(k, t) for k, t in enumerate(["The THE the cat's <|endoftext|>end", "\x85", "H̱ ẖ rare", "rare words, rare: words.", "x" * 500, "rare words, rare: words."])]
    for r in wordbpe.encoded(spark.createDataFrame(rows, "doc_id int, text string"), PATH).collect():
        ids = library.encode(rows[r.doc_id][1], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_marks_that_hold_two():
    """U+0344 stands for two marks, the first of which composes with t but not with T."""
    for text in ("T\u0344", "t\u0344 T\u0344", "THE T\u0344 The"):
        assert own(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_repeated_rows_beside_other_texts(monkeypatch, spark, library):
    """A row's rare words number alike in whichever batch a copy of the row comes."""
    monkeypatch.setattr(wordbpe, "SHARE", 1)
    rows = [(1, "gamma delta alpha, beta"), (2, "alpha beta gamma: delta"), (3, "delta gamma"), (2, "alpha beta gamma: delta"), (4, "beta delta"), (2, "alpha beta gamma: delta")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id int, text string")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in wordbpe.digests(docs, PATH).collect())
    assert got == expected(library, rows)


def test_each_distinct_word_once(spark):
    rows = spark.createDataFrame([(1, "one two two"), (2, "One three,"), (3, "three")], "doc_id int, text string").repartition(3)
    words = wordbpe.distinct_words(rows, PATH).collect()
    assert {r.word: r.n for r in words} == {"one": 2, "two": 2, "three": 2, ",": 1} and len(words) == 4


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="plain BPE"):
        wordbpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_on_given_documents(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_word_bpe(spark, "/root/testdata/sf0.001").collect())
    assert got == expected(library, [tuple(r) for r in rows])
