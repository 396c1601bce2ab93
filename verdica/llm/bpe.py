"""Byte-level BPE encoding and decoding as recursive queries of an in-process DuckDB, one per Python worker.

A text is cut by the vocabulary's pattern. The distinct pieces of a batch become rows (piece, place, token), at first
one a byte. Each round of the recursive query joins neighbours with the merge table and contracts each piece's
leftmost pair of least rank, until no piece has a pair left. Decoding joins tokens with their bytes and
aggregates them in order of place. What a piece gave is remembered for the batches after, within a bound.

Pieces over LONG bytes are cut into blocks of BLOCK bytes, which contract like pieces of their own, so rounds don't grow
with a piece. Then the blocks' tokens are joined two by two. Tokens in a row are the encoding of their bytes exactly if
each neighbouring pair, encoded alone, gives itself again: in the first contraction over a border between tokens that
merging would make, only the two beside it take part. Where the pair at a seam doesn't, the tokens around
it are encoded anew, twice as many each time, until the pairs at both ends hold.

Defined results: null and empty texts have no tokens (both digests are of the empty string); special strings inside
texts are ordinary text; repeated rows agree; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import BATCH_BYTES, HELD, map_rows

LONG, BLOCK = 256, 64
#: Of one recursive query: bytes of its pieces, and the sum of their squares, twice the rows that all rounds hold at most.
QUERY_BYTES = 400_000
QUERY_SQUARES = 16_000_000
#: Pieces remembered between batches.
REMEMBERED = 500_000

_ENCODE = """
WITH RECURSIVE contracted(piece, place, token, done) AS (
    SELECT piece, place, token, false FROM bytes_of
    UNION ALL
    (WITH scored AS MATERIALIZED (
        SELECT s.*, m.made, (m.made::BIGINT << 32) | s.place AS score
        FROM (
            SELECT piece, place, token, lead(token) OVER ordered AS next, lead(place) OVER ordered AS following
            FROM contracted WHERE NOT done WINDOW ordered AS (PARTITION BY piece ORDER BY place)
        ) s
        LEFT JOIN merges m ON m.pair = (s.token::BIGINT << 32) | s.next
    ), chosen AS (
        SELECT piece, min(score) AS least_score, arg_min(following, score) AS gone FROM scored GROUP BY piece
    )
    SELECT s.piece, s.place, CASE WHEN s.score = c.least_score THEN s.made ELSE s.token END, c.least_score IS NULL
    FROM scored s JOIN chosen c USING (piece)
    WHERE c.least_score IS NULL OR s.place <> c.gone)
)
SELECT piece, place, token FROM contracted WHERE done
"""
#: The same for one piece, no further than ``rounds``: what is open then goes into the next query.
_ENCODE_SOME = """
WITH RECURSIVE contracted(round, place, token, done) AS (
    SELECT 0, place, token, false FROM bytes_of
    UNION ALL
    (WITH scored AS MATERIALIZED (
        SELECT s.*, m.made, (m.made::BIGINT << 32) | s.place AS score
        FROM (
            SELECT round, place, token, lead(token) OVER ordered AS next, lead(place) OVER ordered AS following
            FROM contracted WHERE NOT done AND round < $rounds WINDOW ordered AS (ORDER BY place)
        ) s
        LEFT JOIN merges m ON m.pair = (s.token::BIGINT << 32) | s.next
    ), chosen AS (
        SELECT min(score) AS least_score, arg_min(following, score) AS gone FROM scored
    )
    SELECT s.round + 1, s.place, CASE WHEN s.score = c.least_score THEN s.made ELSE s.token END, c.least_score IS NULL
    FROM scored s CROSS JOIN chosen c
    WHERE c.least_score IS NULL OR s.place <> c.gone)
)
SELECT place, token, done FROM contracted WHERE done OR round = $rounds
"""
_COLLECT = """
SELECT count(*) AS n, encode(string_agg(e.token::VARCHAR, ' ' ORDER BY e.place)) AS ids, unhex(string_agg(v.spelt, '' ORDER BY e.place)) AS decoded
FROM encoded e JOIN vocabulary v ON v.token = e.token GROUP BY e.piece ORDER BY e.piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ranks file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _groups(pieces: list[bytes], order: Iterable[int]) -> Iterator[list[int]]:
    """Numbers of pieces for one query each, pieces of like length together: they need as many rounds."""
    group: list[int] = []
    size = squares = 0
    for i in sorted(order, key=lambda i: len(pieces[i])):
        n = len(pieces[i])
        if group and (size + n > QUERY_BYTES or squares + n * n > QUERY_SQUARES):
            yield group
            group, size, squares = [], 0, 0
        group.append(i)
        size, squares = size + n, squares + n * n
    if group:
        yield group


class Vocabulary:
    """The merge table and the tokens' bytes in an in-process database."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        pairs, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32) | right)
                    made.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        self.db.execute("SET temp_directory = ''")
        for name, columns in (
            ("merges", {"pair": pa.array(pairs, pa.int64()), "made": pa.array(made, pa.int32())}),
            ("vocabulary", {"token": pa.array(list(ranks.values()), pa.int32()), "spelt": pa.array([t.hex() for t in ranks], pa.string())}),
        ):
            self.db.register("given", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.single = np.full(256, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
        self.spelt = {rank: token for token, rank in ranks.items()}
        # what is known: a piece's place in columns of token counts, ids as text, and decoded bytes
        self.places: dict[str, int] = {}
        self.known = pa.table({"n": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "decoded": pa.array([], pa.binary())})

    def _contract(self, pieces: list[bytes]) -> None:
        """Leaves (piece, place, token) of the pieces as ``encoded``."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = {"piece": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "place": (np.arange(len(data)) - start).astype(np.int32), "token": self.single[data]}
        self.db.register("bytes_of", pa.table(rows))
        self.db.register("encoded", self.db.sql(_ENCODE).to_arrow_table())
        self.db.unregister("bytes_of")

    def _collected(self) -> pa.Table:
        out = self.db.sql(_COLLECT).to_arrow_table().cast(self.known.schema)
        self.db.unregister("encoded")
        return out

    def _alone(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Token ids of each distinct piece, without blocks."""
        some = list(dict.fromkeys(pieces))
        out = {p: self._whole(p) for p in some if len(p) > LONG}
        for group in _groups(some, [i for i, p in enumerate(some) if len(p) <= LONG]):
            self._contract([some[i] for i in group])
            rows = self.db.sql("SELECT piece, token FROM encoded ORDER BY piece, place").fetchnumpy()
            self.db.unregister("encoded")
            ends, ids = np.searchsorted(rows["piece"], np.arange(len(group) + 1)).tolist(), rows["token"].tolist()
            out |= {some[i]: ids[a:b] for i, a, b in zip(group, ends[:-1], ends[1:], strict=True)}
        return out

    def _whole(self, piece: bytes) -> list[int]:
        """Token ids of a long piece without blocks: one contraction a round, in queries that hold a bounded number of rows."""
        rows = pa.table({"place": np.arange(len(piece), dtype=np.int32), "token": self.single[np.frombuffer(piece, np.uint8)]})
        done = False
        while not done:
            self.db.register("bytes_of", rows)
            found = self.db.execute(_ENCODE_SOME, {"rounds": QUERY_SQUARES // (2 * len(piece)) + 1}).to_arrow_table().sort_by("place")
            self.db.unregister("bytes_of")
            done, rows = found["done"][0].as_py(), found.select(["place", "token"])
        return rows["token"].to_pylist()

    def _joined(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of long pieces: those of their blocks, joined two by two."""
        if not pieces:
            return []
        cut = [[p[k : k + BLOCK] for k in range(0, len(p), BLOCK)] for p in pieces]
        known = self._alone(chain.from_iterable(cut))
        rows = [[known[b] for b in blocks] for blocks in cut]
        while any(len(r) > 1 for r in rows):
            left = [a for r in rows for a in r[:-1:2]]
            seams = iter(self._seamed(left, [b for r in rows for b in r[1::2]]))
            rows = [[*(next(seams) for _ in range(len(r) // 2)), *(r[-1:] if len(r) % 2 else [])] for r in rows]
        return [r[0] for r in rows]

    def _fits(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether two neighbouring tokens stay as they are."""
        spelt = self.spelt
        found = self._alone(spelt[a] + spelt[b] for a, b in pairs)
        return [found[spelt[a] + spelt[b]] == [a, b] for a, b in pairs]

    def _seamed(self, left: list[list[int]], right: list[list[int]]) -> list[list[int]]:
        """The encodings of both sides together, for each pair of neighbours."""
        out: list[list[int]] = [[]] * len(left)
        good = self._fits([(a[-1], b[0]) for a, b in zip(left, right, strict=True)])
        for i in np.flatnonzero(good).tolist():
            out[i] = left[i] + right[i]
        open_, reach = np.flatnonzero(np.logical_not(good)).tolist(), 4
        while open_:
            middle = [b"".join(map(self.spelt.__getitem__, left[i][-reach:] + right[i][:reach])) for i in open_]
            found = self._alone(middle)
            tries = [(i, left[i][:-reach], found[m], right[i][reach:]) for i, m in zip(open_, middle, strict=True)]
            ends = [(a[-1], m[0]) for _, a, m, _ in tries if a], [(m[-1], b[0]) for _, _, m, b in tries if b]
            before, after = (iter(self._fits(e)) for e in ends)
            open_ = []
            for i, a, m, b in tries:
                holds = [next(before) if a else True, next(after) if b else True]
                if all(holds):
                    out[i] = a + m + b
                else:
                    open_.append(i)
            reach *= 2
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes pieces and appends them to what is known."""
        given = [(p, p.encode()) for p in pieces]
        found = [self.known]
        short = [(p, b) for p, b in given if len(b) <= LONG]
        for group in _groups([b for _, b in short], range(len(short))):
            self._contract([short[i][1] for i in group])
            found.append(self._collected())
            for i in group:
                self.places[short[i][0]] = len(self.places)
        long = [(p, b) for p, b in given if len(b) > LONG]
        for (p, _), ids in zip(long, self._joined([b for _, b in long]), strict=True):
            self.db.register("encoded", pa.table({"piece": np.zeros(len(ids), np.int32), "place": np.arange(len(ids), dtype=np.int32), "token": np.array(ids, np.int32)}))
            found.append(self._collected())
            self.places[p] = len(self.places)
        if len(found) > 1:
            self.known = pa.concat_tables(found).combine_chunks()

    def lookup(self, texts: list[list[str]]) -> np.ndarray:
        """Places of all pieces of all texts in a row; new pieces are learned first."""
        wanted = set().union(*texts) if texts else set()
        if len(self.places) > REMEMBERED:
            kept = [p for p in wanted if p in self.places]
            self.known = self.known.take(pa.array([self.places[p] for p in kept], pa.int64())).combine_chunks()
            self.places = {p: i for i, p in enumerate(kept)}
        self.learn(wanted - self.places.keys())
        return np.fromiter(map(self.places.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))

    def of_texts(self, texts: list[list[str]]) -> tuple[list[int], list[bytes], list[bytes]]:
        """Each text's token count, ids joined by a space, and decoded bytes."""
        at = self.lookup(texts)
        offsets = np.cumsum([0, *map(len, texts)])
        totals = np.concatenate(([0], np.cumsum(self.known["n"].to_numpy()[at])))

        def joined(column: str, between: bytes) -> list[bytes]:
            values = self.known[column].combine_chunks().take(pa.array(at))
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), between).to_pylist()

        return np.diff(totals[offsets]).tolist(), joined("ids", b" "), joined("decoded", b"")


_OPEN: dict[str, Vocabulary] = {}
HELD[__name__] = _OPEN


def vocabulary(path: str) -> Vocabulary:
    """One per worker and file, kept between tasks."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(read_ranks(path))
    return _OPEN[path]


def _over_pieces(docs: DataFrame, path: str, pattern: str, key: str, text: str, schema: str, shaped: Callable, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        import regex

        cut = regex.compile(pattern)
        counts, ids, decoded = vocabulary(path).of_texts([cut.findall(t.as_py() or "") for t in batch.column(1)])
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, shaped(counts, ids, decoded))], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], rows, f"{key} {kind}, {schema}", batch_bytes)


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``ids`` (array of token ids) and ``decoded`` (their bytes)."""

    def shaped(counts, ids, decoded):
        return pa.array([[int(x) for x in i.split()] for i in ids], pa.list_(pa.int64())), decoded

    return _over_pieces(docs, path, pattern, key, text, "ids array<long>, decoded binary", shaped)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """key, ``n_tokens``, and digests of the ids (decimal, joined by a space) and of the decoded bytes; ids stay in the worker.

    A batch's pieces take some thirty times its bytes: ``batch_bytes`` trades memory against queries.
    """

    def shaped(counts, ids, decoded):
        return counts, [sha256(i).hexdigest() for i in ids], [sha256(d).hexdigest() for d in decoded]

    return _over_pieces(docs, path, pattern, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", shaped, batch_bytes)
