"""Entailment scores over HTTP: texts in chunks under limits of count and bytes, checked answers.

The transport is a function from a list of texts to a list of three logits each, so tests and other services plug in.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_TEXTS, MAX_BYTES = 64, 900_000
Transport = Callable[[list[str]], list[list[float]]]


def chunks(texts: list[str], most: int = MAX_TEXTS, size: int = MAX_BYTES) -> Iterator[list[str]]:
    """Texts in order, as many in one request as both limits allow; one too large for any request is an error."""
    now: list[str] = []
    used = 0
    for text in texts:
        n = len(text.encode())
        if n > size:
            raise ValueError(f"a text of {n} bytes fits in no request")
        if now and (len(now) == most or used + n > size):
            yield now
            now, used = [], 0
        now.append(text)
        used += n
    if now:
        yield now


def checked(rows: list[list[float]], n: int) -> list[list[float]]:
    if len(rows) != n or any(len(r) != 3 or not all(isinstance(x, int | float) and math.isfinite(x) for x in r) for r in rows):
        raise RuntimeError("the service's answer doesn't fit the request")
    return rows


def http(url: str, key: str | None = None, timeout: float = 300.0) -> Transport:
    """Posts {"texts": [...]} to url/classify and reads {"logits": [[entail, neutral, contradict], ...]}."""

    def send(texts: list[str]) -> list[list[float]]:
        import urllib.request

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        ask = urllib.request.Request(f"{url.rstrip('/')}/classify", json.dumps({"texts": texts}).encode(), head)
        with urllib.request.urlopen(ask, timeout=timeout) as answer:
            return json.load(answer)["logits"]

    return send


def classified(rows: DataFrame, transport: Transport, keys: list[str], text: str = "text") -> DataFrame:
    """keys and ``logits``; a batch of Spark's is cut into requests."""
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", logits array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            found = [r for part in chunks(texts) for r in checked(transport(part), len(part))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([[float(x) for x in r] for r in found], pa.list_(pa.float64()))], names=[*keys, "logits"])

    return rows.select(*keys, text).mapInArrow(run, schema)
