"""Text files by numbered lines: large files are read in byte ranges, and still each line knows its number in its file.

A scan cuts files into ranges by itself and says where each begins. Lines are counted a range; sums over a file's ranges give the
number before each, and a task adds a line's place in its range. If a file's lines with their line feeds make more bytes than it
has, its last line has no line feed: whoever wrote it died, and the line is torn.

Defined results: empty files and folders give no rows; blank lines count and have numbers; carriage returns stay at a line's end.
Compressed files can't be cut and their sizes say nothing, so no line of theirs counts as torn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text and torn."""
    meta = F.col("_metadata")
    scan = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.col("value").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            at = []
            for place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now, n = place, n + 1 if place == now else 0
                at.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64()), batch.column(2)], names=["file", "block", "at", "text"])

    placed = scan.select("file", "block", "text").mapInArrow(run, "file string, block long, at long, text string")
    ranges = scan.groupBy("file", "block", "size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + 1).alias("bytes"))
    whole = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    torn = (F.sum("bytes").over(whole) > F.col("size")) & ~F.col("file").rlike(_COMPRESSED)
    sums = ranges.select("file", "block", before.alias("before"), F.when(torn, F.sum("n").over(whole)).alias("torn_line"))
    line = F.col("before") + F.col("at") + 1
    return placed.join(sums, ["file", "block"]).select("file", line.alias("line"), "text", F.coalesce(line == F.col("torn_line"), F.lit(False)).alias("torn"))
