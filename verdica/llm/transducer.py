"""Token counts by a compiled finite-state tokenizer.

A piece vocabulary with merge scores is compiled, on demand, into a deterministic transducer over characters. Reading
a character moves to the next state and emits how the token count of the text read so far changes (it may fall, as
pieces merge).

Why it is finite: in a tokenization by best-first merging any two neighbours, merged alone, give themselves again, and
a sequence with that property is unique. So the last token of each prefix is found from the last tokens of
shorter prefixes: the one piece that ends here and is a lawful neighbour of the token before it. Only as many
positions back matter as the longest piece still open reaches. A state is that open string with the last tokens and
relative counts at its positions.

No piece reads on over a blank that follows other characters (checked when compiling). So a text's words, each
with the blanks before it, are chunks that all start in the start state. A chunk's state map is constant; maps
compose by adding counts, an associative operation, and a prefix scan of them gives the tokens before every chunk.

Defined results: null and empty texts have no tokens and fit the limit; texts of any length are counted whole; repeated rows agree; an
empty table gives an empty result; extra columns don't matter. Vocabularies with pieces that read on over a blank are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import HELD, map_rows

BLANK = "▁"
LIMIT = 4096
#: Chunk maps, states and lawful neighbours that a worker remembers; beyond, it begins anew with them. States level off, the others don't.
REMEMBERED_MAPS, REMEMBERED_STATES, REMEMBERED_PAIRS = 250_000, 400_000, 400_000
_CHUNKS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Pieces:
    """Pieces with scores, and best-first merging as the definition of their tokenization."""

    def __init__(self, scores: dict[str, float]):
        if any(BLANK in p.lstrip(BLANK) for p in scores):
            raise ValueError("a piece goes on behind a blank: words can't be chunks")
        self.scores = scores
        self.open = {p[:n] for p in scores for n in range(1, len(p))}
        self._lawful: dict[tuple[str | None, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merges the neighbours of highest score, leftmost first, until none make a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def lawful(self, left: str | None, piece: str) -> bool:
        """Whether a piece may follow a token; None stands for the start and for characters without a piece."""
        known = self._lawful.get((left, piece))
        if known is None:
            if len(self._lawful) >= REMEMBERED_PAIRS:
                self._lawful.clear()
            known = self.merged((left or "") + piece) == ([left, piece] if left else [piece])
            self._lawful[left, piece] = known
        return known


class State(dict):
    """Character -> (next state, change of the count); unseen transitions are compiled when first taken."""

    def __init__(self, owner: Transducer, text: str, tokens: tuple[str | None, ...], counts: tuple[int, ...]):
        super().__init__()
        self.owner, self.text, self.tokens, self.counts = owner, text, tokens, counts

    def __missing__(self, char: str) -> tuple[State, int]:
        self[char] = step = self.owner.compiled(self, char)
        return step


class Transducer:
    def __init__(self, scores: dict[str, float]):
        self.pieces = Pieces(scores)
        self._begin()

    def _begin(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state("", (None,), (0,))
        self.maps = ChunkMaps(self)

    def _state(self, text: str, tokens: tuple, counts: tuple) -> State:
        key = (text, tokens, counts)
        if key not in self.states:
            self.states[key] = State(self, text, tokens, counts)
        return self.states[key]

    def compiled(self, state: State, char: str) -> tuple[State, int]:
        """tokens[j] and counts[j] belong to the position j characters into the open string; counts are relative to the last."""
        if char not in self.pieces.scores:
            return self._state("", (None,), (0,)), len(char.encode())
        text, scores = state.text + char, self.pieces.scores
        for j in range(len(text)):
            piece = text[j:]
            if piece in scores and self.pieces.lawful(state.tokens[j], piece):
                break
        else:
            raise ValueError(f"no tokenization reaches {text!r}")
        emitted = state.counts[j] + 1
        tokens, counts = (*state.tokens, piece), (*(c - emitted for c in state.counts), 0)
        for k in range(len(text) + 1):
            if not text[k:] or text[k:] in self.pieces.open:
                return self._state(text[k:], tokens[k:], counts[k:]), emitted
        raise AssertionError

    def run(self, chunk: str, state: State | None = None) -> tuple[State, int]:
        state, count = state or self.start, 0
        for char in chunk:
            state, change = state[char]
            count += change
        return state, count

    def chunks(self, text: str) -> list[str]:
        """Words with the blanks before them; a text is read as if a blank stood before it."""
        return _CHUNKS.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def counts(self, text: str) -> Iterable[int]:
        """Tokens of each chunk."""
        if not text:
            return ()
        if len(self.maps) > REMEMBERED_MAPS:
            self.maps.clear()
        if len(self.states) > REMEMBERED_STATES:
            self._begin()
        if text[0] == " " or "  " in text or BLANK in text:
            return [self.run(c)[1] for c in self.chunks(text)]
        return map(self.maps.__getitem__, text.split(" "))

    def scanned(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Prefix scan over the chunks of all texts in a row: tokens before each chunk and all last, and each text's first chunk and the end."""
        parts = [np.fromiter(self.counts(t), np.int64) for t in texts]
        starts = np.cumsum([0, *map(len, parts)])
        return np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *parts])))), starts

    def count(self, text: str) -> int:
        """Tokens of a text."""
        return int(self.scanned([text])[0][-1])


class ChunkMaps(dict):
    """Word -> count of its constant map, for a word with one blank before it."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> int:
        self[word] = n = self.owner.run(BLANK + word)[1]
        return n


_OPEN: dict[str, Transducer] = {}
HELD[__name__] = _OPEN


def transducer(path: str) -> Transducer:
    """The transducer of a piece model file with byte fallback, one per worker."""
    if path not in _OPEN:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _OPEN[path] = Transducer({sp.id_to_piece(i): sp.get_score(i) for i in usual})
    return _OPEN[path]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit, and n_fitting: the words from the start, cut at single blanks, whose tokens stay within the limit."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() or "" for t in batch.column(1)]
        before, starts = transducer(path).scanned(texts)
        tokens = before[starts[1:]] - before[starts[:-1]]
        fitting = np.minimum(np.searchsorted(before, before[starts[:-1]] + limit, "right") - 1, starts[1:]) - starts[:-1]
        columns = [np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)), tokens, tokens > limit, fitting]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=[key, "n_bytes", "n_tokens", "over_limit", "n_fitting"])

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], rows, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean, n_fitting long")
