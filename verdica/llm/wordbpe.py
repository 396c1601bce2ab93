"""BPE over words: a table of distinct words, each encoded once, whose ids are joined back by position.

1. Texts are split into words by vectorised byte classes. Words end at blanks, and between a letter or digit and
   punctuation where the vocabulary's own splitting always ends a piece. Words are counted: map-side first, then by key.
2. Each distinct word is encoded once (``Encoder``) and written with its count and ids.
3. A text becomes a row of codes. A word that makes at least one in ``SHARE`` of all words is frequent: its code is its place
   in a table that all tasks hold. At most SHARE words can be frequent, and as each occurs that often, their letters
   together are at most SHARE times the mean length of a word. All others are rare: their codes number the text's distinct rare words.
4. Rare words meet the distinct-word table in a join by word, and come back to their text in a join by its digest.
   No rare word is hot, so neither join is.
5. Codes become ids; ids become pieces by a lookup in the table of the vocabulary, whose size is fixed.

Why splitting early is safe: blanks and ASCII punctuation begin a new unit in NFC, and the vocabulary's pattern never lets a
piece hold both letters or digits and punctuation, apart from contractions ('s, 't ...), so apostrophes don't split; nor do the
characters of special strings. A-Z is folded before counting, but not in texts with combining marks, as a capital may lack a composed form
that its small letter has, nor in texts with the start of a special string.

Defined results: null and empty texts have no tokens (both digests are of the empty string); special strings inside texts
give their ids, as the library does; repeated rows agree; texts of any length are taken whole, as are words; an empty table
gives an empty result; extra columns don't matter. Equal texts have one digest each with their id, so
copies spread; rows that repeat both id and text meet in one task of the last join, which streams them.
"""

from __future__ import annotations

import heapq
import json
from hashlib import sha256
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, HELD, map_rows, staged_alone, texts_of

#: A word is frequent if it makes at least one in so many of all words. All tasks hold those: at most so many rows.
SHARE = 1 << 23

#: Byte classes: 0 blank, 1 letter or digit of ASCII, 2 punctuation that splits, 4 all else (apostrophe, special strings' marks, other alphabets).
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = 2


def _folded(text: bytes) -> bytes:
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()  # U+0300 to U+036F lie behind CC and CD


def split_words(texts: list[bytes]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words of all texts in order, and the number of words before each text (one more at the end)."""
    blob = b"\n".join(map(_folded, texts)) + b"\n"
    b = np.frombuffer(blob, np.uint8)
    kind = _CLASS[b]
    inside = kind != 0
    begins = np.empty(len(b), bool)
    begins[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1] | ((kind[1:] ^ kind[:-1]) == 3), out=begins[1:])
    starts = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside)[starts] - 1, inside.sum()).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(b[inside].tobytes()))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(starts, first)


class Encoder:
    """Ids of single words by a vocabulary file: its normaliser and splitting, then contraction of the least pair, leftmost first."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        if (model["type"], model["unk_token"], model["dropout"], model["continuing_subword_prefix"], model["ignore_merges"]) != ("BPE", None, None, None, False) or data["post_processor"] or data["decoder"]:
            raise ValueError(f"{path}: only plain BPE with word ends is known")
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.pieces = {i: p for p, i in vocab.items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
        every = range(max(self.pieces) + 1)
        self.names = {"id": pa.array(map(str, every), pa.string()), "piece": pa.array(map(self.pieces.get, every), pa.string())}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        if not all(t["special"] and not t["normalized"] and t["content"].startswith("<|") for t in data["added_tokens"]):
            raise ValueError(f"{path}: added tokens must be special strings that begin with <|")
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.vocab = vocab
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        whole = tokenizers.Tokenizer.from_file(path)
        self.kind = "<u2" if max(self.pieces) < 1 << 16 else "<u4"
        self._normal, self._split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str

    def word(self, word: str) -> list[int]:
        out: list[int] = []
        for part in self._cut.split(word) if "<|" in word else (word,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece, _ in self._split(self._normal(part)):
                    out += self._contracted([*(self.vocab[c] for c in piece[:-1]), self.vocab[piece[-1] + self.end]])
        return out

    def _contracted(self, ids: list[int]) -> list[int]:
        """Pairs wait in a heap by rank, then place; a pair that changed meanwhile is passed over."""
        merges, n = self.merges, len(ids)
        waiting = [(*found, i) for i, pair in enumerate(pairwise(ids)) if (found := merges.get(pair))]
        if not waiting:
            return ids
        heapq.heapify(waiting)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while waiting:
            rank, made, i = heapq.heappop(waiting)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j])) != (rank, made):
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((made, ids[k])):
                    heapq.heappush(waiting, (*found, i))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], made))):
                heapq.heappush(waiting, (*found, h))
        return [x for x in ids if x >= 0]


#: Encoders by file, and the table of frequent words that a worker holds.
_OPEN: dict[str, Any] = {}
HELD[__name__] = _OPEN


def encoder(path: str) -> Encoder:
    """One per worker and file, kept between tasks."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def distinct_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """word, n (its occurrences in all texts) and ids (little-endian, each as wide as the vocabulary needs): every distinct word is encoded once."""

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pc.value_counts(split_words(list(texts_of(batch.column(0))))[0])
        return pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"])

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path)
        ids = [np.array(own.word(w), own.kind).tobytes() for w in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    counts = map_rows(docs, [text], counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return map_rows(counts, ["word", "n"], encoded, "word string, n long, ids binary")


def _coded(docs: DataFrame, frequent, key: str, text: str, rare: bool) -> DataFrame:
    """Of each text its digest (a, b: 96 bits) and, if ``rare``, its distinct rare words in the order in which they first come, else its codes."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        common = frequent.value.column("word")
        words, first = split_words(list(texts_of(batch.column("_text"))))
        code = pc.fill_null(pc.index_in(words, common), -1).to_numpy().astype(np.int64)
        at = np.flatnonzero(code < 0)
        seldom = words.take(pa.array(at)).dictionary_encode()
        doc = np.searchsorted(first, at, side="right") - 1
        pair, begins, which = np.unique(doc << 32 | seldom.indices.to_numpy().astype(np.int64), return_index=True, return_inverse=True)
        # numbered as they first come in their own text, whatever texts share its batch: copies of a row number alike
        order = np.argsort(begins)
        pair, which = pair[order], np.argsort(order)[which]
        per_doc = np.searchsorted(pair >> 32, np.arange(batch.num_rows + 1))
        if rare:
            lists = pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), seldom.dictionary.take(pa.array(pair & 0xFFFFFFFF)).cast(pa.string()))
            out = {"rare": lists}
        else:
            code[at] = len(common) + which - per_doc[doc]
            out = {key: batch.column(key), "codes": pa.array([_packed(code[i:j]) for i, j in pairwise(first)], pa.binary()), "has_rare": pa.array(np.diff(per_doc) > 0)}
        out = {"a": batch.column("a"), "b": batch.column("b")} | out
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key), F.col(text).alias("_text"), F.xxhash64(key, text).alias("a"), F.hash(text, key).alias("b"))
    return map_rows(given, [key, "_text", "a", "b"], rows, "a long, b int, " + ("rare array<string>" if rare else f"`{key}` {kind}, codes binary, has_rare boolean"))


def _cut(lists: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and where each word's begin (one more at the end)."""
    whole = lists.cast(pa.large_binary())
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] // kind.itemsize if len(whole) else np.zeros(1, np.int64)
    return np.frombuffer(whole.buffers()[2] or b"", kind), ends


def _held(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The frequent words' ids, cut once a worker, however many batches come."""
    if _OPEN.get("frequent", (None,))[0] is not table:
        _OPEN["frequent"] = table, _cut(table.column("ids").combine_chunks(), kind)
    return _OPEN["frequent"][1]


def _packed(codes: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1) if len(codes) else b""


def _unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel() if blob else np.zeros(0, "<u4")


def _assembled(docs: DataFrame, path: str, key: str, text: str, schema: str, shaped) -> DataFrame:
    spark = docs.sparkSession
    words = staged_alone(distinct_words(docs, path, text))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = words.where(F.col("n") * SHARE >= total).toArrow().sort_by([("n", "descending")])  # at most SHARE rows
    frequent = spark.sparkContext.broadcast(pa.table({"word": common["word"].combine_chunks().cast(pa.large_string()), "ids": common["ids"].combine_chunks()}))
    seldom = words.where(F.col("n") * SHARE < total).select("word", "ids")
    # narrow rows: the second half of the digest and the rare word's number share a long
    sent = _coded(docs, frequent, key, text, rare=True).select("a", "b", F.posexplode("rare").alias("k", "word"))
    sent = sent.select("a", F.shiftleft(F.col("b").cast("long"), 32).bitwiseOR(F.col("k").cast("long")).alias("bk"), "word")
    back = sent.join(seldom, "word").select("a", F.shiftright("bk", 32).cast("int").alias("b"), F.struct("bk", "ids").alias("one"))
    lists = back.groupBy("a", "b").agg(F.sort_array(F.collect_set("one"))["ids"].alias("rare"))
    lists = staged_alone(lists)
    codes = _coded(docs, frequent, key, text, rare=False)
    joined = codes.join(lists, ["a", "b"], "left")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        if any(has and not found for has, found in zip(batch.column("has_rare").to_pylist(), batch.column("rare").is_valid().to_pylist(), strict=True)):
            raise ValueError("the table of documents changed while it was read")
        kind = np.dtype(encoder(path).kind)
        held, own = _held(frequent.value, kind), _cut(batch.column("rare").flatten(), kind)
        n_held = len(held[1]) - 1
        base = np.cumsum([0, *pc.fill_null(pc.list_value_length(batch.column("rare")), 0).to_pylist()])
        per_doc = []
        for blob, at in zip(texts_of(batch.column("codes")), base, strict=False):
            code = _unpacked(blob).astype(np.int64)
            per_doc.append(np.where(code >= n_held, code + at, code))
        place = np.concatenate(per_doc) if per_doc else np.zeros(0, np.int64)
        length = np.zeros(len(place), np.int64)
        parts = [(np.flatnonzero(place < n_held), held, 0), (np.flatnonzero(place >= n_held), own, n_held)]
        for which, (_, ends), less in parts:
            length[which] = ends[place[which] - less + 1] - ends[place[which] - less]
        cut = np.concatenate(([0], np.cumsum(length)))
        ids = np.empty(cut[-1], kind)
        for which, (flat, ends), less in parts:
            n = length[which]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(cut[which], n) + step] = flat[np.repeat(ends[place[which] - less], n) + step]
        offsets = cut[np.cumsum([0, *map(len, per_doc)])]
        return pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, shaped(encoder(path), ids, offsets))], names=[key, *(f.split()[0] for f in schema.split(", "))])

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(joined, [key, "codes", "has_rare", "rare"], rows, f"`{key}` {kind}, {schema}", BATCH_BYTES // 8)


def joined_pieces(own: Encoder, ids: np.ndarray, offsets: np.ndarray, of: str) -> list[str]:
    """Each text's ids as decimals, or the pieces that they stand for: a lookup in the vocabulary, joined by a blank."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), own.names[of].take(pa.array(ids))), " ").to_pylist()


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``ids`` (array of token ids) and ``decoded`` (the pieces they stand for, joined by a blank)."""

    def shaped(own, ids, offsets):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))), joined_pieces(own, ids, offsets, "piece")

    return _assembled(docs, path, key, text, "ids array<int>, decoded string", shaped)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``n_tokens``, and digests of the ids (decimal, joined by a blank) and of the decoded text; ids stay in the worker."""

    def shaped(own, ids, offsets):
        hashed = ([sha256(t.encode()).hexdigest() for t in joined_pieces(own, ids, offsets, of)] for of in ("id", "piece"))
        return np.diff(offsets).astype(np.int64), *hashed

    return _assembled(docs, path, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", shaped)
