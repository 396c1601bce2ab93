"""Exact substring dedup by fixed-block anchors.

A window of 50 words holds a whole block of 25 words of its document's grid 0, 25, 50, ..., wherever it starts. So of
two documents that share a window, each rolling 25-word probe set of one meets a block of the other.

1. Anchors. Every document gives its grid blocks (the index) and every rolling 25-word window (the probes) as hashes,
   dealt to parts. Places whose hash meets a block elsewhere are hits. Four bytes of hash travel; a false hit
   costs work later, never a word.
2. Extension. Around its hits each document takes all 50-word windows as candidates (72 bits of hash or more).
   Overlapping candidates found in a document with a smaller id chain into maximal exact repeats.
3. Removal of the words they cover, judged on the input.

Both exchanges combine before they deal: of a hash one representative goes on. What shares an anchor's hash in a batch are
hits already; of a window's documents in a batch all but the smallest have it from there. Parts grow in number with
the words, so a part's size doesn't grow. Over FAN parts are dealt in two exchanges, so that what a batch sends to one
doesn't shrink to single entries; between them entries are combined again, some millions at a time.

Defined results: ids are whole numbers, others are refused; null and blank texts have no words; documents of under 50 words lose none; a row without id
is neither smaller nor larger than another and stays whole; rows that repeat an id don't dedup each other; an empty
table gives an empty result; extra columns pass through, but for one named _dedup, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, bounded_batches, staged, texts_of, trim
from .hashing import mixed, planes, rolling, unplaned, word_bounds, word_hashes

WINDOW = 50
BLOCK = WINDOW // 2
#: Entries that one part holds, about, and that are combined at a time between two exchanges: some 100 MB in a worker.
PART_ENTRIES = 2_000_000
#: Parts that a batch is dealt to at once.
FAN = 4096
_R1, _R2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

#: What a batch sends to a part: hashes with their documents and places, and places settled already.
_SENT = "part int, keys binary, docs binary, tags binary, counts binary, places binary, s_docs binary, s_tags binary, s_counts binary, s_places binary"
_FOUND = "doc long, tag int, places binary"


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1)) if len(doc) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(doc)))


def _packed(ordinal: np.ndarray, place: np.ndarray, docs: np.ndarray, tags: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Places by document, ordered by both, as byte planes of differences."""
    starts, counts = _runs(ordinal)
    steps = np.diff(place, prepend=0)
    steps[starts] = place[starts]
    who = ordinal[starts]
    return planes(docs[who].view(np.uint64), 8), planes(tags[who], 2), planes(counts, 4), planes(steps, 4)


def _unpacked(docs: bytes, tags: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and tags, and for each entry the document's ordinal among them and the place."""
    n, steps = unplaned(counts, 4).astype(np.int64), unplaned(places, 4).astype(np.int32)
    total = np.cumsum(steps, dtype=np.int32)
    starts = np.cumsum(n) - n
    base = total[starts] - steps[starts] if len(n) else total[:0]
    return unplaned(docs, 8).view(np.int64), unplaned(tags, 2).astype(np.int32), np.repeat(np.arange(len(n), dtype=np.int32), n), total - np.repeat(base, n)


def _joined(blobs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of many blobs, their ordinals counted on."""
    docs, tags, ordinals, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    base = 0
    for blob in blobs:
        d, t, o, p = _unpacked(*blob)
        docs.append(d)
        tags.append(t)
        ordinals.append(o + np.int32(base))
        places.append(p)
        base += len(d)
    return np.concatenate(docs), np.concatenate(tags), np.concatenate(ordinals), np.concatenate(places)


class _Entries(NamedTuple):
    """Hashes with their part and place; ordinals count into docs and tags. What is settled is found already, and has no hash."""

    part: np.ndarray
    keys: np.ndarray
    ordinal: np.ndarray
    place: np.ndarray
    docs: np.ndarray
    tags: np.ndarray
    settled: tuple[np.ndarray, ...] = ()


def _anchors_settled(e: _Entries, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that share their hash are hits. One of them goes on, a grid block if there is one, so that other batches meet it."""
    order = np.argsort(whole, kind="stable")
    starts, counts = _runs(whole[order].view(np.int64))
    n, block = len(order), e.place[order] % BLOCK == 0
    firsts = np.minimum.reduceat(np.where(block, 0, n) + np.arange(n), starts) % n if n else starts
    settled = np.zeros(n, bool)
    settled[order] = np.repeat(counts > 1, counts)
    return settled, np.sort(order[firsts])


def _windows_settled(e: _Entries, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents after the smallest with a window are found; the smallest's places go on."""
    doc = e.docs[e.ordinal]
    order = np.lexsort((doc, whole))
    starts, counts = _runs(whole[order].view(np.int64))
    settled = np.zeros(len(order), bool)
    settled[order] = doc[order] > np.repeat(doc[order[starts]], counts)
    return settled, np.flatnonzero(~settled)


class _Kind(NamedTuple):
    key_bytes: int
    settled: Callable
    hit: Callable


def _sent(e: _Entries, kind: _Kind, whole: np.ndarray, n_parts: int, groups: int = 1) -> pa.RecordBatch:
    """Entries combined and dealt: one row for each part, or for each ``groups`` parts in a row, whose numbers then travel along."""
    settled, go = kind.settled(e, whole)
    row = e.part[go] // groups
    go = go[np.argsort(row.astype(np.uint16) if n_parts // groups < 1 << 16 else row, kind="stable")]
    starts, counts = _runs(e.part[go].astype(np.int64) // groups)
    rows: dict[int, list[bytes]] = {}
    for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
        at = go[a : a + n]
        within = planes(e.part[at] % groups, 2) if groups > 1 else b""
        rows[int(e.part[at[0]]) // groups] = [planes(e.keys[at], kind.key_bytes) + within, *_packed(e.ordinal[at], e.place[at], e.docs, e.tags), b"", b"", b"", b""]
    done = np.flatnonzero(settled)
    found = e.docs[e.ordinal[done]], e.tags[e.ordinal[done]], e.place[done]
    if e.settled:
        found = tuple(np.concatenate(x) for x in zip(found, e.settled, strict=True))
    if len(found[0]):
        order = np.lexsort((found[2], found[1], found[0]))
        docs, tags, place = (x[order] for x in found)
        new = np.append(True, (np.diff(docs) != 0) | (np.diff(tags) != 0))
        home = int(docs[0] % (n_parts // groups))
        rows.setdefault(home, [b""] * 9)[5:] = _packed(np.cumsum(new) - 1, place, docs[new], tags[new])
    columns = [pa.array(list(rows), pa.int32()), *(pa.array([r[k] for r in rows.values()], pa.binary()) for k in range(9))]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SENT.split(", ")])


def _received(table: pa.Table | pa.RecordBatch, key_bytes: int, groups: int = 1) -> _Entries:
    """The entries of rows from ``_sent``."""
    blobs = lambda *names: list(zip(*([x.as_py() for x in table.column(n)] for n in names), strict=True))
    narrow = "<u4" if key_bytes == 4 else "<u8"
    keys, parts = [], []
    for part, blob in blobs("part", "keys"):
        n = len(blob) // (key_bytes + 2 * (groups > 1))
        keys.append(unplaned(blob[: n * key_bytes], key_bytes).astype(narrow))
        if groups > 1:
            parts.append(part * groups + unplaned(blob[n * key_bytes :], 2).astype(np.int64))
    docs, tags, ordinal, place = _joined(blobs("docs", "tags", "counts", "places"))
    d, t, o, p = _joined(blobs("s_docs", "s_tags", "s_counts", "s_places"))
    return _Entries(np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate(keys), ordinal, place, docs, tags, (d[o], t[o], p))


def _by_document(doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> pa.Table:
    order = np.lexsort((place, tag, doc))
    doc, tag, place = doc[order], tag[order], place[order].astype("<u4")
    cut = np.flatnonzero((np.diff(doc, prepend=0) != 0) | (np.diff(tag, prepend=-1) != 0)) if len(doc) else np.zeros(0, np.int64)
    blobs = [place[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=False)]
    return pa.table({"doc": pa.array(doc[cut], pa.int64()), "tag": pa.array(tag[cut].astype(np.int32)), "places": pa.array(blobs, pa.binary())})


def _reduced(table: pa.Table, kind: _Kind) -> pa.Table:
    """One part: entries of equal keys side by side, those that ``hit`` picks, and the settled ones.

    An entry takes 12 to 16 bytes and its place in the sort. Keys that come once, nearly all, go before anything else.
    """
    e = _received(table, kind.key_bytes)
    order = np.argsort(e.keys, kind="stable")
    keys = e.keys[order]
    shared = np.zeros(len(keys), bool)
    shared[1:] = keys[1:] == keys[:-1]
    shared[:-1] |= shared[1:]
    order, keys = order[shared], keys[shared]
    starts, counts = _runs(keys.astype(np.uint64).view(np.int64))
    picked = order[kind.hit(e.docs[e.ordinal[order]], e.place[order], starts, counts)] if len(order) else order
    found = e.docs[e.ordinal[picked]], e.tags[e.ordinal[picked]], e.place[picked]
    return _by_document(*(np.concatenate(x) for x in zip(found, e.settled, strict=True)))


def _anchor_hit(doc: np.ndarray, place: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of a hash's places if there are two or more and one is a grid block."""
    some = np.maximum.reduceat(place % BLOCK == 0, starts)
    return np.repeat((counts > 1) & some, counts)


def _later_hit(doc: np.ndarray, place: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of a window in documents after the smallest that holds it."""
    return doc > np.repeat(np.minimum.reduceat(doc, starts), counts)


def _window_starts(h: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Global word numbers where a window of ``size`` words fits into its document, and the documents' ordinals."""
    n = np.maximum(np.diff(offsets) - size + 1, 0)
    ordinal = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[ordinal], ordinal


def _anchors(batch: pa.RecordBatch, n_parts: int) -> _Entries | None:
    docs, tags = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("_doc", "_tag"))
    h, offsets = word_hashes(list(texts_of(batch.column("_text"))))
    at, ordinal = _window_starts(h, offsets, BLOCK)
    if not len(at):
        return None
    key = mixed(rolling(h, BLOCK, _R1)[at])
    return _Entries((key >> np.uint64(40)).astype(np.int64) % n_parts, key, ordinal, at - offsets[ordinal], docs, tags)


def _candidates(batch: pa.RecordBatch, n_parts: int) -> _Entries | None:
    batch = batch.filter(batch.column("_places").is_valid())
    docs, tags = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("_doc", "_tag"))
    h, offsets = word_hashes(list(texts_of(batch.column("_text"))))
    wanted = np.zeros(len(h) + 1, np.int64)
    for k, blobs in enumerate(batch.column("_places")):
        a, last = int(offsets[k]), int(offsets[k + 1]) - WINDOW
        for blob in blobs.as_py() or ():
            hits = np.frombuffer(blob, "<u4").astype(np.int64) + a
            hits = hits[hits <= last + BLOCK]
            np.add.at(wanted, np.maximum(hits - BLOCK, a), 1)
            np.add.at(wanted, np.minimum(hits, last) + 1, -1)
    at, ordinal = _window_starts(h, offsets, WINDOW)
    chosen = np.cumsum(wanted)[at] > 0
    at, ordinal = at[chosen], ordinal[chosen]
    if not len(at):
        return None
    key, part = mixed(rolling(h, WINDOW, _R1)[at]), mixed(rolling(h, WINDOW, _R2)[at]) % np.uint64(n_parts)
    return _Entries(part.astype(np.int64), key, ordinal, at - offsets[ordinal], docs, tags)


ANCHORS, WINDOWS = _Kind(4, _anchors_settled, _anchor_hit), _Kind(8, _windows_settled, _later_hit)


def _mapped(df: DataFrame, rows: Callable[[pa.RecordBatch, int], _Entries | None], n_parts: int, kind: _Kind) -> DataFrame:
    """Places found, by document: entries of batches dealt to parts, and each part settled."""
    groups = -(-n_parts // FAN)
    n_parts = groups * -(-n_parts // groups)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        for batch in batches:
            if batch.num_rows and (e := rows(batch, n_parts)) is not None:
                yield _sent(e, kind, e.keys, n_parts, groups)
        trim()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if held and (batch is None or sum(b.nbytes for b in held) > 6 * PART_ENTRIES):
                e = _received(pa.Table.from_batches(held), kind.key_bytes, groups)
                yield _sent(e, kind, e.keys.astype(np.uint64) ^ mixed(e.part.astype(np.uint64)), n_parts)
                held = []
            if batch is not None and batch.num_rows:
                held.append(batch)
        trim()

    def settle(table: pa.Table) -> pa.Table:
        trim()
        return _reduced(table, kind)

    dealt = df.mapInArrow(send, _SENT)
    if groups > 1:
        dealt = dealt.repartition("part").mapInArrow(again, _SENT)
    return dealt.groupBy("part").applyInArrow(settle, _FOUND)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The keyed input, and for each (_doc, _tag) with repeats the starts of windows found in a smaller document too."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be a whole number: smaller ids keep what later ones lose")
    bounded_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tag = F.xxhash64(F.col(text)).bitwiseAND(F.lit(0xFFFF)).cast("int")
    keyed = docs.select(F.col(key).cast("long").alias("_doc"), tag.alias("_tag"), F.col(text).alias("_text"), row.dropFields(text).alias("_row") if len(docs.columns) > 1 else F.lit(None).cast("int").alias("_row"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_parts = max(32, int(size / 6 / PART_ENTRIES) + 1)
    able = F.col("_doc").isNotNull() & (F.octet_length("_text") >= 2 * WINDOW - 1)
    hits = _mapped(keyed.where(able).select("_doc", "_tag", "_text"), _anchors, n_parts, ANCHORS)
    # in no more files than four a core
    hits = staged(hits.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)).groupBy("doc", "tag").agg(F.collect_list("places").alias("_places"))
    # The same left join as the last one: its exchange of the texts is then used twice. Rows without hits end in the worker.
    met = keyed.join(hits, (F.col("_doc") == F.col("doc")) & (F.col("_tag") == F.col("tag")), "left")
    found = _mapped(met.select("_doc", "_tag", "_text", "_row", "_places"), _candidates, n_parts, WINDOWS)
    return keyed, found.groupBy("doc", "tag").agg(F.collect_list("places").alias("_places"))


def _covered(n_words: int, blobs: list[bytes] | None) -> np.ndarray:
    """Which words the found windows cover."""
    cover = np.zeros(n_words + 1, np.int64)
    for blob in blobs or ():
        starts = np.frombuffer(blob, "<u4").astype(np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + WINDOW, -1)
    return np.cumsum(cover)[:n_words] > 0


def without(text: bytes, blobs: list[bytes] | None) -> tuple[bytes, int, int, str]:
    """The text without covered words (whole runs go with the blank before them), words, removed words, digest of the kept words."""
    if not blobs:
        words = text.split()
        return text, len(words), 0, sha256(b" ".join(words)).hexdigest()
    starts, ends = word_bounds(text)
    gone = _covered(len(starts), blobs)
    left = [0, *ends[:-1].tolist()]
    kept = np.flatnonzero(~gone).tolist()
    words = [text[starts[i] : ends[i]] for i in kept]
    body = b"".join(text[left[i] : ends[i]] for i in kept) + (text[ends[-1] :] if len(ends) else b"")
    return body, len(starts), int(gone.sum()), sha256(b" ".join(words)).hexdigest()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text``, and a struct ``_dedup`` (n_words, n_removed, kept_sha256)."""
    keyed, found = repeats(docs, key, text)
    joined = keyed.join(found, (F.col("_doc") == F.col("doc")) & (F.col("_tag") == F.col("tag")), "left")
    joined = joined.select("_doc", "_tag", "_text", "_row", "_places")
    result = T.StructType([T.StructField("_text", T.StringType()), joined.schema["_row"], *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        for batch in batches:
            places = batch.column("_places")
            done = [without(t, places[i].as_py()) for i, t in enumerate(texts_of(batch.column("_text")))]
            null = pa.compute.is_null(batch.column("_text")).to_pylist()
            texts = [None if empty else d[0].decode() for d, empty in zip(done, null, strict=True)]
            columns = [pa.array(texts, pa.string()), batch.column("_row"), *(pa.array([d[k] for d in done], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=result.names)

    out = joined.mapInArrow(cut, result)
    own = [F.col("_text").alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c != "_dedup"]
    return out.select(*own, F.struct("n_words", "n_removed", "kept_sha256").alias("_dedup"))
