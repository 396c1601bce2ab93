"""Runs that may die and start again: rows in chunks with fixed numbers, each committed once.

A run's first start writes a manifest: the number of chunks and a digest of its rows and settings. A row's chunk is its key's digest modulo
that number, so it never changes. A chunk is written to a folder of its own attempt; then a commit file that names the attempt is
created, which only one can do. Readers follow commit files alone. So a dead attempt leaves nothing that is read, a rerun does only the chunks
without a commit, and of two runs at the same time one commits a chunk and the other drops its attempt.

Defined results: an empty table makes one empty chunk; null keys have a chunk like others; rows that repeat a key go together.
A start over other rows or settings is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import remove

CHUNK_ROWS = 50_000
#: Chunks that one job writes at a time.
TOGETHER = 32


class Files:
    """What a run needs of the file system that its folder is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self.at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(folder))) if self._fs.exists(self.at(folder)) else []

    def create(self, name: str, text: str) -> bool:
        """Writes a small file unless it is there; whether it did. On a shared store only one of many callers does."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self.at(name), False)
        except Py4JJavaError:
            if self._fs.exists(self.at(name)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def _digest(rows: DataFrame, key: str) -> tuple[int, str]:
    part = F.xxhash64(F.col(key).cast("string"))
    r = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(part.cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], str(r[1])


def run_chunks(todo: DataFrame, path: str, transform: Callable[[DataFrame], DataFrame], key: str = "id", settings: str = "", chunk_rows: int = CHUNK_ROWS, together: int = TOGETHER) -> int:
    """Transforms the rows of chunks that have no commit yet and commits them; returns how many chunks this run committed.

    ``transform`` must keep ``key`` and give each row its outcome by itself, as chunks are done apart.
    """
    spark, files = todo.sparkSession, Files(todo.sparkSession, path)
    n, digest = _digest(todo, key)
    mine = {"rows": n, "digest": digest, "settings": settings}
    files.create("manifest.json", json.dumps(mine | {"chunks": max(1, -(-n // chunk_rows))}))
    manifest = json.loads(files.read("manifest.json"))
    if differ := [k for k, v in mine.items() if manifest[k] != v]:
        raise ValueError(f"{path} was started with other {', '.join(differ)}")
    chunks = manifest["chunks"]
    done = set(files.names("commits"))
    left = [c for c in range(chunks) if f"{c:06d}" not in done]
    of = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("chunk")), F.lit(chunks)).cast("int")
    committed = 0
    for first in range(0, len(left), together):
        some = left[first : first + together]
        attempt = f"attempts/{uuid.uuid4().hex}"
        numbered = todo.withColumn("_chunk", of).where(F.col("_chunk").isin(some)).drop("_chunk")
        transform(numbered).withColumn("_chunk", of).write.partitionBy("_chunk").parquet(f"{files.path}/{attempt}")
        here = set(files.names(attempt))
        for c in some:
            folder = f"{attempt}/_chunk={c}"
            there = f"_chunk={c}" in here
            if files.create(f"commits/{c:06d}", folder if there else ""):
                committed += 1
            elif there:
                remove(spark, f"{files.path}/{folder}")
    return committed


def committed_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all committed chunks; without any an empty table, whose ``schema`` must then be given."""
    files = Files(spark, path)
    folders = [f for f in (files.read(f"commits/{name}") for name in files.names("commits")) if f]
    if not folders:
        if schema is None:
            raise ValueError(f"{path} has no committed rows")
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*[f"{files.path}/{f}" for f in folders])


def swept(spark: SparkSession, path: str) -> int:
    """Deletes attempts that no commit names, once no run is under way; how many chunk folders."""
    files = Files(spark, path)
    named = {files.read(f"commits/{name}") for name in files.names("commits")}
    gone = 0
    for attempt in files.names("attempts"):
        for folder in files.names(f"attempts/{attempt}"):
            if folder.startswith("_chunk=") and f"attempts/{attempt}/{folder}" not in named:
                remove(spark, f"{files.path}/attempts/{attempt}/{folder}")
                gone += 1
    return gone
