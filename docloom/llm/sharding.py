"""Sharding by histogram sort: equal-sized shards in key order, found by counting exact bytes below probes.

The key is (64-bit hash of the group, doc_id); equal texts share a hash, so they are neighbours. Each round counts, in
every partition with numpy, rows and bytes below candidate keys; the counts are summed by Spark and only they (PROBES for
each splitter) reach the driver. A splitter whose bytes below are within tolerance of its target is fixed; for the others
the next round puts PROBES keys between the closest known ones, so a splitter's interval shrinks by that factor each
round and is down to one key after 128 / log2(PROBES + 1) rounds at most: the search always ends, with the tolerance or
the nearest key there is. A splitter first looks for a boundary between hashes, which parts no group of equal texts; only
if one group is larger than the tolerance does it go on among that group's doc_ids, so a group that holds a third of all
rows is split and the shards stay equal.

Only the boundaries of shards are searched so. A shard is sorted in as many ranges as its rows need (RANGE_ROWS each);
ranges need no tolerance, so their keys are laid out evenly and counted once, and only where too many rows lie between
two of them are more laid. Then rows move once, straight to their range. A row's slot is its place in the sorted range plus
the rows of the shard's earlier ranges, known from the counts.

Defined results: a null text has size 1 (no bytes, plus 1) and the hash of an empty text; a very long text is one row of
its size, which may make its shard larger than others by as much; rows that are equal in text and doc_id can't be told
apart, so they share a range; null doc_ids sort first; an empty table gives no rows; other columns pass through unless an
output column has their name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import forget, keep, table

LEAST, MOST = -(1 << 63), (1 << 63) - 1
PROBES, RANGE_ROWS = 64, 2_000_000

Key = tuple[int, int]
#: A counted key: (key, rows below, bytes below).
Counted = tuple[Key, int, int]


def _place(hs: np.ndarray, ds: np.ndarray, h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the sorted keys (hs, ds) are at or below each (h, d)."""
    at, low = np.searchsorted(hs, h, "right"), np.searchsorted(hs, h, "left")
    tied = np.flatnonzero(low != at)  # a key has this very hash: the second part decides
    for k in np.unique(low[tied]).tolist():
        own = tied[low[tied] == k]
        at[own] = k + np.searchsorted(ds[k : at[own[0]]], d[own], "right")
    return at


def _columns(keys: list[Key]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)


def histogram(narrow: DataFrame, probes: list[Key]) -> list[Counted]:
    """Rows and bytes whose key (h, d) is below each probe; probes are sorted."""
    hs, ds = _columns(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = np.zeros(len(hs) + 1, np.int64), np.zeros(len(hs) + 1, np.int64)
        for b in batches:
            h, d, s = (b.column(k).to_numpy(zero_copy_only=False) for k in ("h", "d", "size"))
            at = _place(hs, ds, h, d)
            rows += np.bincount(at, minlength=len(rows))
            np.add.at(size, at, s)
        has = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(rows[has]), pa.array(size[has])], names=["bin", "n", "size"])

    found = narrow.mapInArrow(run, "bin bigint, n bigint, size bigint").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()  # at most a row for each probe
    rows, size = np.zeros(len(hs) + 1, np.int64), np.zeros(len(hs) + 1, np.int64)
    for r in found:
        rows[r["bin"]], size[r["bin"]] = r["n"], r["size"]
    return list(zip(probes, np.cumsum(rows)[:-1].tolist(), np.cumsum(size)[:-1].tolist(), strict=True))


def _between(a: Key, b: Key, n: int) -> list[Key]:
    """Up to n keys strictly between a and b, evenly laid out: among hashes, or if one hash is left among its doc_ids."""
    if a[0] == b[0] or b[0] - a[0] == 1 and b[1] == LEAST:
        top = b[1] if a[0] == b[0] else MOST
        return sorted({(a[0], a[1] + (top - a[1]) * k // (n + 1)) for k in range(1, n + 1)} - {a, b})
    return sorted({(a[0] + (b[0] - a[0]) * k // (n + 1), LEAST) for k in range(1, n + 1)} - {a, b})


def find_splitters(narrow: DataFrame, total: int, shards: int, tolerance: float) -> list[Counted]:
    """The shards - 1 splitters, in order. narrow: h, d, size, of total bytes in all."""
    slack = max(1, int(total / shards * tolerance))
    targets = [total * k // shards for k in range(1, shards)]
    known: list[Counted] = [((LEAST, LEAST), 0, 0)]  # counted keys, sorted; bytes below never fall
    end = (MOST, MOST)
    done: dict[int, Counted] = {}
    while len(done) < len(targets):
        probes: set[Key] = set()
        below = [c[2] for c in known]
        for k, target in enumerate(targets):
            if k in done:
                continue
            at = bisect_right(below, target) - 1
            low, high = known[at], known[at + 1] if at + 1 < len(known) else None
            best = min((c for c in (low, high) if c), key=lambda c: abs(c[2] - target))
            more = _between(low[0], high[0] if high else end, PROBES)
            if abs(best[2] - target) <= slack or not more:
                done[k] = best
            else:
                probes.update(more)
        if probes:
            known = sorted(known + histogram(narrow, sorted(probes)))
    return [done[k] for k in range(len(targets))]


def find_ranges(narrow: DataFrame, splitters: list[Counted], rows: int, range_rows: int) -> list[Counted]:
    """The lower ends of all ranges, sorted: those of the shards, and between them keys of no tolerance.

    Counted keys that are over range_rows apart are parted again until they are next to each other, so only rows of one
    key can share a larger range; then neighbours are joined as far as they fit.
    """
    known: list[Counted] = sorted({((LEAST, LEAST), 0, 0), *splitters})
    whole = ((MOST, MOST), rows, 0)
    while True:
        probes: set[Key] = set()
        for a, b in zip(known, [*known[1:], whole], strict=True):
            if b[1] - a[1] > range_rows:
                probes.update(_between(a[0], b[0], min(max(PROBES, 2 * (b[1] - a[1]) // range_rows), 1 << 14)))
        if not probes:
            break
        known = sorted(known + histogram(narrow, sorted(probes)))
    cuts = {s[0] for s in splitters}
    ends: list[Counted] = known[:1]
    for a, b in zip(known, [*known[1:], whole], strict=True):
        if a[0] in cuts or b[1] - ends[-1][1] > range_rows and a[1] > ends[-1][1]:
            ends.append(a)
    return sorted(set(ends))


def histogram_shard(docs: DataFrame, shards: int, size: Column, group: Column, order: str = "doc_id", tolerance: float = 0.002, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs with size, shard (0 to shards - 1) and slot (gapless from 0 in each shard): sizes within tolerance of equal."""
    rest = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    own = docs.select(*rest, size.cast("bigint").alias("size"), F.xxhash64(group).alias("__h"), F.coalesce(F.col(order).cast("bigint"), F.lit(LEAST)).alias("__d"))
    narrow = keep(own.select(F.col("__h").alias("h"), F.col("__d").alias("d"), "size"), "shard-keys")
    total, rows = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    splitters = find_splitters(narrow, total, shards, tolerance) if rows else []
    ends = find_ranges(narrow, splitters, rows, range_rows)
    forget(narrow)
    cuts = [s[0] for s in splitters]
    shard_of = [bisect_right(cuts, e[0]) for e in ends]
    first = {k: s[1] for k, s in enumerate([((LEAST, LEAST), 0, 0), *splitters])}
    hs, ds = _columns([e[0] for e in ends[1:]])
    shard, before = np.array(shard_of, np.int32), np.array([e[1] - first[k] for e, k in zip(ends, shard_of, strict=True)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _place(hs, ds, b.column("__h").to_numpy(zero_copy_only=False), b.column("__d").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(shard[at]), pa.array(before[at])], names=[*b.schema.names, "__range", "shard", "__before"])

    schema = T.StructType([*own.schema.fields, T.StructField("__range", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("__before", T.LongType())])
    moved = own.mapInArrow(place, schema).repartitionById(len(ends), F.col("__range")).sortWithinPartitions("__h", "__d")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return moved.withColumn("slot", at + F.col("__before")).drop("__h", "__d", "__range", "__before")


def op3_histogram_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # what the result needs of a text is taken before rows move, so the exchange carries numbers only
    docs = docs.select("doc_id", F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("__group"), (F.octet_length("text") + 1).cast("bigint").alias("__bytes"))
    out = histogram_shard(docs, 16, F.col("__bytes"), F.col("__group"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Where exactly a boundary falls within the tolerance isn't a matter of SQL; the tests check the law by brute force.
ORACLES: dict[str, str] = {}
QUERIES = {"op3_histogram_shard": op3_histogram_shard}
