"""Runs in chunks: killed between chunks and within one, started again, two at a time."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdica.sources import chunks as C


def rows(spark, n=500):
    return spark.createDataFrame([(f"k{i % 490}" if i % 97 else None, i) for i in range(n)], "id string, v int")


def all_of(frame):
    return Counter((r.id, r.v, r.w) for r in frame.collect())


def doubled(frame):
    return frame.withColumn("w", F.col("v") * 2)


class Dies(Exception):
    pass


def test_killed_and_started_again(spark, tmp_path):
    path, todo = str(tmp_path / "run"), rows(spark)
    want = all_of(doubled(todo))
    calls = []

    def dying(frame):
        calls.append(1)
        if len(calls) == 3:
            raise Dies
        return doubled(frame)

    with pytest.raises(Dies):
        C.run_chunks(todo, path, dying, chunk_rows=50, together=2)
    some = all_of(C.committed_rows(spark, path))
    assert some and some < want
    assert C.run_chunks(todo.repartition(7), path, doubled, chunk_rows=9999, together=4) == 6
    assert all_of(C.committed_rows(spark, path)) == want and C.run_chunks(todo, path, doubled) == 0


def test_an_attempt_that_dies_within_a_chunk_is_not_read(spark, tmp_path):
    path, todo = str(tmp_path / "run"), rows(spark)
    bad = lambda f: doubled(f).withColumn("w", F.when(F.col("v") == 321, F.raise_error(F.lit("died")).cast("int")).otherwise(F.col("w")))
    with pytest.raises(Exception, match="died"):
        C.run_chunks(todo, path, bad, chunk_rows=100, together=9)
    assert not C.committed_rows(spark, path, "id string, v int, w int").count()
    assert C.run_chunks(todo, path, doubled, chunk_rows=100) == 5
    assert all_of(C.committed_rows(spark, path)) == all_of(doubled(todo))


def test_two_runs_at_the_same_time(spark, tmp_path):
    """The second starts and ends while the first transforms: no row stands twice."""
    path, todo = str(tmp_path / "run"), rows(spark)
    inner = []

    def slow(frame):
        if not inner:
            inner.append(C.run_chunks(todo, path, doubled, chunk_rows=100, together=2))
        return doubled(frame)

    outer = C.run_chunks(todo, path, slow, chunk_rows=100, together=3)
    assert inner == [5] and outer == 0 and all_of(C.committed_rows(spark, path)) == all_of(doubled(todo))
    assert C.swept(spark, path) == 0


def test_other_rows_or_settings_are_refused(spark, tmp_path):
    path, todo = str(tmp_path / "run"), rows(spark)
    C.run_chunks(todo, path, doubled, settings="a")
    with pytest.raises(ValueError, match="settings"):
        C.run_chunks(todo, path, doubled, settings="b")
    with pytest.raises(ValueError, match="rows"):
        C.run_chunks(todo.limit(20), path, doubled, settings="a")


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "run")
    assert C.run_chunks(rows(spark).limit(0), path, doubled) == 1 and C.run_chunks(rows(spark).limit(0), path, doubled) == 0
    assert not C.committed_rows(spark, path, "id string, v int, w int").count()
    with pytest.raises(ValueError, match="no committed"):
        C.committed_rows(spark, path)
