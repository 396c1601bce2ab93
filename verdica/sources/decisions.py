"""A user's own decisions: JSON lines of state, question and label, checked line by line.

Faults of one line are found where it is read. Those that depend on others (one question type for all rows, ids that don't repeat) are
aggregates joined back. The first fault by file and line is what a reader of the lines in order would stop at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import CONTENT, OPTION, QUESTION_SHAPE, Invalid, checked, free, is_a, member, members, must, row_of, then, to_text
from .lines import numbered_lines

KEYS = ("id", "state", "question", "label")
FIELDS = f"file string, line long, id string, state string, state_is_json boolean, type string, instructions string, options array<{OPTION}>, true_text string, false_text string, label int"
#: ``late`` faults are those that come after the check of the question's type.
_ROW = f"{FIELDS}, error_path string, error string, late boolean"

LINE_SHAPE = then(
    is_a(dict, "each line must be an object"),
    members(free, KEYS),
    *[must(lambda v, k=k: k in v, f"{k} is required") for k in KEYS[1:]],
    member("state", CONTENT),
    member("question", QUESTION_SHAPE),
)


def label_of(question: dict[str, Any], label: Any) -> int:
    """A label as a number: a choice's option by name, a level by its number, yes or no."""
    options = question["options"]
    if question["type"] == "choice":
        names = [o["name"] for o in options]
        if isinstance(label, str) and label in names:
            return names.index(label)
        raise Invalid("label", "must be the name of an option")
    if question["type"] == "score":
        if isinstance(label, int) and not isinstance(label, bool) and 0 <= label < len(options):
            return label
        raise Invalid("label", f"must be a level from 0 to {len(options) - 1}")
    if isinstance(label, int) and label in (0, 1):
        return int(label)
    raise Invalid("label", "must be true or false")


def decision(text: str, fallback: str) -> dict[str, Any]:
    """One line as a row's fields, with the first fault in it."""
    row: dict[str, Any] = {"late": False}
    try:
        try:
            value = json.loads(text)
        except ValueError:
            raise Invalid("", "invalid JSON") from None
        checked(value, LINE_SHAPE)
        row |= {k: v for k, v in row_of("q", value["question"]).items() if k != "qid"}
        row |= {"state": to_text(value["state"]), "state_is_json": not isinstance(value["state"], str), "late": True}
        row["label"] = label_of(row, value["label"])
        row["id"] = value.get("id", fallback)
        if not isinstance(row["id"], str) or not row["id"]:
            row["id"] = None
            raise Invalid("id", "must be a text that is not empty")
    except Invalid as e:
        row |= {"error_path": e.path, "error": e.message}
    return row


def checked_lines(spark: SparkSession, path: str, name: str = "decisions") -> DataFrame:
    """All lines that are not blank, with ``error_path`` and ``error``. Rows without an id get ``name/line``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"file": f, "line": n, **decision(t, f"{name}/{n}")} for f, n, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    lines = numbered_lines(spark, path).where(F.col("text").rlike(r"\S")).select("file", "line", "text")
    rows = lines.mapInArrow(run, _ROW)
    kind = rows.where("late").agg(F.min_by("type", F.struct("file", "line")).alias("kind"))
    rows = rows.crossJoin(F.broadcast(kind))  # one row
    other = F.col("late") & (F.col("type") != F.col("kind"))
    faults = {"error": F.when(other, F.concat(F.lit("type differs from earlier rows: "), "kind")).otherwise(F.col("error")), "error_path": F.when(other, F.lit("question.type")).otherwise(F.col("error_path"))}
    rows = rows.withColumns(faults).drop("late", "kind")
    known = rows.where("error IS NULL").groupBy("id").agg(F.min(F.struct("file", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "first")
    again = F.col("error").isNull() & (F.struct("file", "line") > F.col("first"))
    repeated = {"error": F.when(again, F.concat(F.lit("repeats the id of line "), F.col("first.line").cast("string"))).otherwise(F.col("error")), "error_path": F.when(again, F.lit("id")).otherwise(F.col("error_path"))}
    return rows.join(known, "id", "left").withColumns(repeated).select(*rows.columns)


def read_decisions_file(spark: SparkSession, path: str, name: str = "decisions") -> DataFrame:
    """The rows of a decisions file; raises at the first fault, with its line, and if there are none."""
    rows = checked_lines(spark, path, name)
    bad = rows.where("error IS NOT NULL").orderBy("file", "line").select("file", "line", "error_path", "error").first()
    if bad:
        raise ValueError(f"{bad['file']}:{bad['line']}: {Invalid(bad['error_path'], bad['error'])}")
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    return rows.drop("error", "error_path")
