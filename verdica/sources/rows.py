"""Scans and sinks: raw score rows, decision files, run folders, resume sets and fingerprints."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import numbered_lines

RAW = "id string, split string, label int, kind string, logits array<double>, cycle_logits array<array<double>>, prompt_tokens int, truncated boolean, stage string, latency_ms double, stage1_logits array<double>"
OPTION = "struct<name:string,descr:string>"
DECISION = f"id string, source string, family string, state string, question struct<type:string,instructions:string,options:array<{OPTION}>,true_text:string,false_text:string>, label int, candidate string, target array<double>"
FAMILY_TYPES = {"nli": "noul", "reading": "noul", "judgement": "noul", "ovr": "noul", "candidate": "choice", "choice": "choice", "score": "score"}


def folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share. Only a session on one machine may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local-") and spark.sparkContext.master.startswith("local"):
        base = "/tmp/verdica-checkpoints"
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/verdica-{uuid.uuid4().hex}"
    _FOLDERS.add(path)
    return path


#: Scratch folders that are still there.
_FOLDERS: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    _FOLDERS.discard(path)


@atexit.register
def sweep() -> None:
    """Results may be read until the program ends; then all scratch goes, if the session still stands."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the session may end meanwhile
            for path in list(_FOLDERS):
                remove(spark, path)


def kept(rows: DataFrame, schema: str | None) -> DataFrame:
    """Writes rows to a fresh shared folder and reads them back, which cuts their lineage; ``_folder`` is the place, for ``remove``."""
    path = folder(rows.sparkSession)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(schema or rows.schema).parquet(path)
    out._folder = path
    return out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw score rows from JSON lines, with their ``line``. A half-written last line of a file is left out; any other bad line is an error.

    A path that isn't there has no rows.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(place):
        return spark.createDataFrame([], f"{RAW}, line long")
    lines = numbered_lines(spark, path).where(~F.col("torn") & F.col("text").rlike(r"\S"))
    rows = lines.select("file", "line", F.from_json("text", f"{RAW}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    said = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": not a row of raw scores"))
    return rows.where(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(True)).select("r.*", "line").drop("_bad")


def last_wins(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The last row of each key by ``sequence``: one aggregation, no sort."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_r"))
    return best.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def pending(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows not yet written."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def resumable_append(todo: DataFrame, path: str, transform, key: str = "id") -> int:
    """Scores what ``path`` does not hold yet and appends it; a rerun adds nothing."""
    spark = todo.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    left = pending(todo, spark.read.parquet(path), key) if exists else todo
    n = left.count()
    if n or not exists:
        transform(left).write.mode("append").parquet(path)
    return n


def fingerprint(*columns: str) -> Column:
    """Digest of settings; rows of different settings must not share a folder."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def check_resume(existing: DataFrame, config: DataFrame, fields: Sequence[str]) -> None:
    """Refuses to append where settings that change results differ."""
    old, new = existing.select(*fields).first(), config.select(*fields).first()
    if old is not None and tuple(old) != tuple(new):
        diff = [f for f, a, b in zip(fields, old, new, strict=True) if a != b]
        raise ValueError(f"settings differ from the rows already there: {diff}")


def table_digest(rows: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: count, and sum of row digests."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*rows.columns)), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("digest"))


def decision_errors(rows: DataFrame) -> DataFrame:
    """Training rows with ``errors``: families, types, label ranges, candidates and soft targets checked."""
    q, n = F.col("question"), F.when(F.col("question.type") == "noul", F.lit(2)).otherwise(F.size("question.options"))
    yes_no = F.col("family").isin("nli", "reading", "judgement", "ovr", "candidate")
    kind = F.create_map(*[F.lit(x) for pair in FAMILY_TYPES.items() for x in pair])
    soft = F.aggregate("target", F.lit(0.0), lambda a, x: a + x)
    names = F.transform("question.options", lambda o: o["name"])
    checks = {
        "id": F.col("id").isNull() | (F.col("id") == ""),
        "source": F.col("source").isNull() | (F.col("source") == ""),
        "family": ~F.coalesce(F.col("family").isin(*FAMILY_TYPES), F.lit(False)),
        "type": F.coalesce(kind[F.col("family")] != q["type"], F.lit(True)),
        "label": ~F.coalesce(F.when(yes_no, F.col("label").between(0, 1)).otherwise(F.col("label").between(0, n - 1)), F.lit(False)),
        "candidate": F.when(F.col("family") == "candidate", ~F.coalesce(F.array_contains(names, F.col("candidate")), F.lit(False))).otherwise(F.col("candidate").isNotNull()),
        "target": F.when(F.col("target").isNull(), F.lit(False)).otherwise(yes_no | (F.size("target") != n) | (F.abs(soft - 1) > 1e-3) | F.exists("target", lambda x: x < 0)),
    }
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Checked training rows, soft targets normalised; raises on invalid rows and on ids that repeat."""
    rows = decision_errors(spark.read.schema(DECISION).json(path))
    bad = rows.where(F.size("errors") > 0).select("id", "errors").limit(5).collect()
    if bad:
        raise ValueError(f"invalid rows: {[(r['id'], r['errors']) for r in bad]}")
    twice = rows.groupBy("id").count().where("count > 1").select("id").limit(5).collect()
    if twice:
        raise ValueError(f"ids repeat: {[r['id'] for r in twice]}")
    total = F.aggregate("target", F.lit(0.0), lambda a, x: a + x)
    return rows.drop("errors").withColumn("target", F.transform("target", lambda x: x / total))


def letter_target(rows: DataFrame) -> DataFrame:
    """Adds ``letter`` (yes/no rows: label 1 is letter 0) and ``n_letters``."""
    yes_no = F.col("family").isin("nli", "reading", "judgement", "ovr", "candidate")
    return rows.withColumns({"letter": F.when(yes_no, 1 - F.col("label")).otherwise(F.col("label")), "n_letters": F.when(yes_no, F.lit(2)).otherwise(F.size("question.options"))})


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "line") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def run_folders(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Run folders (those with a raw file) among the paths and one level below."""
    out: list[str] = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        has = lambda q, fs=fs: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(q, "raw.jsonl"))
        if not fs.exists(p):
            raise FileNotFoundError(path)
        found = [p] if has(p) else sorted((s.getPath() for s in fs.listStatus(p) if s.isDirectory() and has(s.getPath())), key=lambda q: q.getName())
        out += [q.toString() for q in found]
    return out
