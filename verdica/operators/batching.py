"""A backend stage for models: one model a worker, prompts batched by length under a token budget, results in the order of their rows.

Rows wait in a window of bounded size (tokens and rows). A full window is sorted by length, longest first, and cut into batches: at
most ``batch_rows`` rows, rows times the longest within ``batch_tokens``, and no row shorter than ``fill`` of the longest, so
padding is bounded. The window's rows leave in the order they came. However rows lie in partitions, a worker holds one window;
a prompt longer than the budget runs alone.

A model has ``encode(prefix, state, suffix)`` giving token ids and whether something was cut, and ``read(rows)`` giving for a
list of id lists an array of logits [row, cycle, letter]; ``letters`` says for how many.

Defined results: null texts count as empty; a prompt asks for 1 to ``letters`` labels, other numbers are an error, as are logits that aren't finite or too
few readouts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS, BATCH_TOKENS, FILL = 32, 16_384, 0.5
WINDOW_ROWS, WINDOW_TOKENS = 1024, 262_144
_OUT = "n_labels int, logits array<double>, cycle_logits array<array<double>>, prompt_tokens int, truncated boolean, batch_rows int, batch_tokens int"


class Model(Protocol):
    letters: int

    def encode(self, prefix: str, state: str, suffix: str) -> tuple[list[int], bool]: ...

    def read(self, rows: list[list[int]]) -> np.ndarray: ...


def batches(lengths: list[int], batch_rows: int = BATCH_ROWS, batch_tokens: int = BATCH_TOKENS, fill: float = FILL) -> list[list[int]]:
    """Places of rows, longest first, cut into batches."""
    out: list[list[int]] = []
    width = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if out and len(out[-1]) < batch_rows and (len(out[-1]) + 1) * width <= batch_tokens and lengths[i] >= fill * width:
            out[-1].append(i)
        else:
            out.append([i])
            width = lengths[i]
    return out


#: One model a worker, by the name under which it was asked for.
_MODELS: dict[str, Model] = {}


def model_backend(name: str, make: Callable[[], Model], batch_rows: int = BATCH_ROWS, batch_tokens: int = BATCH_TOKENS, fill: float = FILL, window_rows: int = WINDOW_ROWS, window_tokens: int = WINDOW_TOKENS):
    """A backend that runs ``make()``'s model, made once a worker. Adds logits, cycle_logits, prompt_tokens, truncated, and the batch's rows and padded tokens."""

    def read(table: DataFrame) -> DataFrame:
        keys = [c for c in table.columns if c not in ("prefix", "state", "suffix", "n_labels")]

        def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _MODELS:
                _MODELS[name] = make()
            model = _MODELS[name]
            window: list[tuple[list, list[int], bool, int]] = []
            held = 0
            for batch in batches_in:
                columns = [batch.column(c).to_pylist() for c in (*keys, "prefix", "state", "suffix", "n_labels")]
                for *key, prefix, state, suffix, n in zip(*columns, strict=True):
                    if not n or not 1 <= n <= model.letters:
                        raise ValueError(f"a prompt asks for {n} labels, the model has 1 to {model.letters}")
                    ids, cut = model.encode(prefix or "", state or "", suffix or "")
                    if window and (len(window) >= window_rows or held + len(ids) > window_tokens):
                        yield done(model, window)
                        window, held = [], 0
                    window.append((key, ids, cut, n))
                    held += len(ids)
            if window:
                yield done(model, window)

        def done(model: Model, window: list) -> pa.RecordBatch:
            lengths = [len(w[1]) for w in window]
            rows: list[tuple] = [()] * len(window)
            for some in batches(lengths, batch_rows, batch_tokens, fill):
                logits = np.asarray(model.read([window[i][1] for i in some]), float)
                if len(logits) != len(some) or not np.isfinite(logits).all():
                    raise ValueError("the model's readouts are too few or not finite")
                for i, cycles in zip(some, logits, strict=True):
                    each = cycles[:, : window[i][3]].tolist()
                    rows[i] = (window[i][3], each[-1], each, lengths[i], window[i][2], len(some), len(some) * lengths[some[0]])
            found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.int32(), pa.bool_(), pa.int32(), pa.int32()), strict=True)]
            given = [pa.array(c) for c in zip(*(w[0] for w in window), strict=True)]
            return pa.RecordBatch.from_arrays([g.cast(k) for g, k in zip(given, kinds, strict=True)] + found, names=[*keys, *(f.split()[0] for f in _OUT.split(", "))])

        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(table.schema[k].dataType) for k in keys]
        schema = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys)
        return table.mapInArrow(run, f"{schema}, {_OUT}")

    return read


class WordLengths:
    """A stand-in for a model, which tests and SQL can follow: a token is a word's length, a letter's logit the share of tokens that leave its number as remainder by 26.

    Three cycles: earlier ones know a third and two thirds of it.
    """

    letters = 26

    def encode(self, prefix: str, state: str, suffix: str) -> tuple[list[int], bool]:
        return [len(w) for w in (prefix + state + suffix).split(" ")], False

    def read(self, rows: list[list[int]]) -> np.ndarray:
        width = max(map(len, rows))
        ids = np.full((len(rows), width), -1)
        for row, given in zip(ids, rows, strict=True):  # padded on the left: the answer is read from the end
            row[width - len(given) :] = given
        share = np.stack([(ids % 26 == k).sum(1, where=ids >= 0) / (ids >= 0).sum(1) for k in range(26)], axis=1)
        return np.stack([share / 3, share * 2 / 3, share], axis=1)
