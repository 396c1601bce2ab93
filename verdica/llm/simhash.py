"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint becomes a point of 32 coordinates, the bit counts of its 2-bit segments. Flipping a bit moves
one coordinate by one, so the Manhattan distance of two points never exceeds the Hamming distance of the
fingerprints. Points within Manhattan distance 2 differ in two of B coordinate blocks at most: they meet in one of
the grid cells that are spanned by all blocks but two. Pairs from a cell pass the Manhattan bound, then the exact bit count.

B grows with the fingerprints, so a cell's expected members don't: 4 blocks (6 cells a point) up to 5 * 10 ** 7, 8
blocks (28 cells) up to 10 ** 11. What still meets in great numbers in a cell is a dense group, not the growth of the
table. Such cells, over ``HOT_CELL`` members, form no pairs: their members meet at the fingerprints at most one bit away
instead. Two fingerprints share such a neighbour exactly if they differ in two bits or fewer, so a star of each
neighbour's members links the same components with 65 rows a fingerprint.

Defined results: null and blank texts have fingerprint zero and link like any other; repeated rows share a
fingerprint; a null ``doc_id`` never names a component while another id is there; texts of any length are taken whole; an empty table gives an empty result; extra columns don't matter to ``near_duplicates`` and
stay in ``one_per_group``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, map_rows, staged_narrow, texts_of
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
HOT_CELL = 64
_PAIRS_MASK = 0x5555555555555555


def fingerprint(text: bytes) -> int:
    """Bit b is set if it is set in over half the XXH64 hashes of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -SHINGLE])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key column and ``fp``, the fingerprint as a signed long."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in texts_of(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], rows, f"{key} {kind}, fp long")


def embedded(fp: Column) -> Column:
    """The 32 segment popcounts, packed as 2-bit counters in one long."""
    mask, upper = F.lit(_PAIRS_MASK), F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(upper).bitwiseAND(mask), fp.bitwiseAND(upper).bitwiseAND(mask)
    return F.shiftleft(two, 1).bitwiseOR(one)


def manhattan(v: Column, w: Column) -> Column:
    """Sum of absolute differences of packed counters 0..2: xor 01 and 11 differ by one, 10 by two."""
    x, mask = v.bitwiseXOR(w), F.lit(_PAIRS_MASK)
    low = x.bitwiseAND(mask)
    high = F.shiftrightunsigned(x, 1).bitwiseAND(mask)
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def blocks_for(n: int) -> int:
    """Blocks for n fingerprints: the least number whose cells hold some eight others at most, were all independent.

    A coordinate is 0, 1 or 2 with shares of 1/4, 1/2, 1/4: two agree with a chance of 3/8.
    """
    return next((b for b in range(4, 17) if n * (3 / 8) ** (32 * (b - RADIUS) // b) <= 8), 16)


def masks(n_blocks: int) -> list[int]:
    """For each two blocks left out, the bits of all others."""
    ends = [32 * b // n_blocks for b in range(n_blocks + 1)]
    bits = [(1 << 2 * z) - (1 << 2 * a) for a, z in zip(ends, ends[1:], strict=False)]
    full = [((1 << 64) - 1) ^ bits[i] ^ bits[j] for i, j in combinations(range(n_blocks), RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def cells(point: Column, n_blocks: int) -> Column:
    """The grid cells of a point: the counters of all blocks but two, and which these are, as one hash."""
    return F.array(*[F.xxhash64(F.lit(n), point.bitwiseAND(F.lit(m))) for n, m in enumerate(masks(n_blocks))])


def links(fps: DataFrame, hot_cell: int = HOT_CELL, n_blocks: int | None = None) -> DataFrame:
    """(a, b) links of a table of distinct fingerprints ``fp``; same components as all pairs within RADIUS bits."""
    points = fps.select("fp", embedded(F.col("fp")).alias("point"))
    placed = points.select("fp", "point", F.explode(cells(F.col("point"), n_blocks or blocks_for(fps.count()))).alias("cell"))
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged_narrow(placed.join(counts, "cell"))
    small = shared.where(F.col("n") <= hot_cell)
    left, right = small.select("cell", F.col("fp").alias("a"), F.col("point").alias("v")), small.select("cell", F.col("fp").alias("b"), F.col("point").alias("w"))
    near = (
        left.join(right, "cell")
        .where((F.col("a") < F.col("b")) & (manhattan(F.col("v"), F.col("w")) <= RADIUS))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
        .select("a", "b")
    )
    hot = shared.where(F.col("n") > hot_cell).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    met = hot.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("meeting"))
    heads = met.groupBy("meeting").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("meeting", "b")
    stars = met.join(heads, "meeting").where("fp <> b").select(F.col("fp").alias("a"), "b")
    found = staged_narrow(near.unionByName(stars).distinct())
    dropped(shared)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_cell: int = HOT_CELL, n_blocks: int | None = None) -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable."""
    each = staged_narrow(fingerprints(docs, key, text), scanned=True)
    distinct = staged_narrow(each.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies")))
    found = links(distinct.select("fp"), hot_cell, n_blocks)
    roots = components(found)
    rooted = staged_narrow(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")))
    dropped(found, distinct)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "copies")
    # fingerprints of over a thousandth of all rows, so under a thousand, are broadcast; no other fills a task
    many = each.count() // 1000
    hot = F.broadcast(named.where(F.col("copies") > many).select(F.col("fp").alias("_fp"), F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot")))
    told = each.join(hot, F.col("fp") == F.col("_fp"), "left")
    rest = told.where("_is_hot IS NULL").select(key, "fp").join(named.select("fp", "component_id"), "fp")
    told = told.where("_is_hot").select(key, "fp", F.col("_hot").alias("component_id")).unionByName(rest.select(key, "fp", "component_id"))
    return told.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its group; of rows that repeat that key the first by text stays."""
    groups = staged_narrow(near_duplicates(docs, key, text))
    dropped = groups.where(F.col(key) != F.col("component_id")).select(key)
    dropped = dropped.unionByName(groups.where(F.col(key).isNull() & F.col("component_id").isNotNull()).select(key)).distinct()
    repeated = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(key).count().where("count > 1").select(key)
    gone, again = fresh(docs, "_gone"), fresh(docs, "_again")
    kept = docs.join(dropped.withColumnRenamed(key, gone), docs[key].eqNullSafe(F.col(gone)), "left_anti")
    repeated = repeated.withColumnRenamed(key, again)
    if repeated.isEmpty():
        return kept
    same = F.col(key).eqNullSafe(F.col(again))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(text), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]))
    once = kept.join(repeated, same, "left_semi").groupBy(F.col(key).alias(again)).agg(F.min_by(row, order).alias(gone)).select(f"{gone}.*")
    return kept.join(repeated, same, "left_anti").unionByName(once)
