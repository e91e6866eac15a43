"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, and pairs verified on full n-gram sets.

Shingles are five consecutive words; a text of fewer words is one shingle. Rows of equal texts form one copy class, whose
representative is the least doc_id. A class is known by its representative and a 128-bit hash of its text, so different
texts of one doc_id are classes of their own. Of a class, `bands` hashes of `rows` minima each are
kept; numbers are chosen so that a pair at the threshold shares a band with the target recall.

Classes that share a band hash form a bucket. Buckets with the same members (near copies share many bands) are joined
once. Members' shingle sets, made once for a class, meet in the bucket's task. Large buckets are cut into blocks of at
most BLOCK members and about BLOCK_SHINGLES shingles, and each pair of blocks is a task of its own: no task holds more than
two blocks, a member travels once for each block of its bucket, and a task emits one row for each linked member (its
number of links and the root of its local component), never pairs. A pair counts only in the first bucket that both are
in, so links are exact and counted once. Class ids are the connected components of the roots, found by joins that keep
their edges in the shared folder.

Defined results: texts without words (null, empty) link to nothing, not even each other, and are classes of their own;
a null doc_id gets a null class and no links; repeated rows fall into one class; different texts under one doc_id are
linked and classed each by itself; a very long text is shingled whole; ties (equal similarity, equal ids) need no
choice, as all links count; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WordHash, forget, join_few, keep, release, slices, table, words_of
from docloom.llm.hashing import Rolling, mix

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9995
MOST_BANDS, BLOCK, BLOCK_SHINGLES = 16, 1024, 1 << 20
CLASS = "struct<rep: bigint, a: bigint, b: bigint>"


def choose_bands(threshold: float, recall: float, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which few enough bands reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, 13):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands <= most_bands:
            best = (bands, rows)
    return best


class Shingles:
    def __init__(self, width: int):
        self.width, self.hash, self.rolling = width, WordHash(), Rolling(0xA0761D6478BD642F)

    def of(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes, sorted."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        tokens = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        return np.unique(self.rolling.runs(self.rolling.prefix(tokens), min(self.width, len(words))))


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """`bands` hashes of the least values under bands * rows fixed bijections."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        part = shingles[k : k + 1024, None] ^ shifts
        part *= factors
        part ^= part >> np.uint64(32)
        part *= factors
        least = np.minimum(least, part.min(0))
    out = np.zeros(bands, np.uint64)
    for c in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + least.reshape(bands, rows)[:, c])
    return out


def _pairs(a: np.ndarray, b: np.ndarray, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of a and b that agree in `band` and in no band before; i < j where both are the one block."""
    order_a, order_b = np.argsort(a[:, band], kind="stable"), np.argsort(b[:, band], kind="stable")
    out_i, out_j = [], []
    values, first = np.unique(a[order_a, band], return_index=True)
    low, high = np.searchsorted(b[order_b, band], values, "left"), np.searchsorted(b[order_b, band], values, "right")
    for k in np.flatnonzero(high > low).tolist():
        rows, cols = order_a[first[k] : first[k + 1] if k + 1 < len(first) else None], order_b[low[k] : high[k]]
        earlier = np.zeros((len(rows), len(cols)), bool)
        for c in range(band):
            earlier |= a[rows, c][:, None] == b[cols, c][None, :]
        i, j = np.nonzero(~earlier)
        out_i.append(rows[i])
        out_j.append(cols[j])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j))
    return (i[i < j], j[i < j]) if same else (i, j)


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[i] and sets[j], pair by pair or, where pairs are dense, by matrix products."""
    left, right = np.unique(i), np.unique(j)
    if len(i) <= 3 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    used = np.unique(np.concatenate([left, right]))
    every = np.concatenate([sets[k] for k in used])
    values, count = np.unique(every, return_counts=True)
    values = values[count > 1]  # a shingle of one member meets nothing
    if not len(values):
        return np.zeros(len(i), np.int64)
    col = np.minimum(np.searchsorted(values, every), len(values) - 1)
    live = values[col] == every
    row, col = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])[live], col[live]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    rows, cols = np.searchsorted(used, left), np.searchsorted(used, right)
    total = np.zeros((len(rows), len(cols)), np.float32)
    width = 2048
    for start in range(0, len(values), width):
        a, b = np.searchsorted(col, [start, start + width])
        part = np.zeros((len(used), width), np.float32)
        part[row[a:b], col[a:b] - start] = 1
        total += part[rows] @ part[cols].T
    return total[np.searchsorted(left, i), np.searchsorted(right, j)].astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members the least one that the pairs (i, j) connect it with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        np.minimum.at(new, root, new.copy())  # what a member found holds for its root
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(ids: list, bands: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, band: int, threshold: float) -> list[tuple]:
    """(id, root, links) of linked members. ids are sorted. sides: a pair counts if both are of the one block, or one of either.

    sides holds 0 for members of the lower block and 1 for those of the upper; all 0 where a block meets itself.
    """
    low, high = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    same = not len(high)
    high = low if same else high
    i, j = _pairs(bands[low], bands[high], band, same)
    i, j = low[i], high[j]
    size = np.array([len(s) for s in sets])
    able = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[able], j[able]
    if not len(i):
        return []
    both = _intersections(sets, i, j)
    linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
    i, j = i[linked], j[linked]
    links = np.bincount(np.concatenate([i, j]), minlength=len(ids))
    root = _roots(len(ids), i, j)
    return [(ids[k], ids[root[k]], int(links[k])) for k in np.flatnonzero(links).tolist()]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, component (its least id) of every id in edges: large-star and small-star by turns until nothing changes."""
    cur = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # least is kept, so that both sides of the join are plain exchanges, of which Spark splits a hub's partition
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # each larger neighbour to the least
        large = keep(large.where("u <> v").distinct(), "large")
        forget(least)
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = keep(small, "edges")
        for old in (cur, large, least):
            forget(old)
        cur = new
        sums = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = sums


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, rep_id for every row of docs.

    class_id is the least doc_id of the component; n_links counts the different texts that the row's text is linked to;
    n_copies the rows of the row's own text; rep_id is the least doc_id with the row's text.
    """
    return _classed(docs, threshold, width, recall).drop("a", "b", "least")


def _classed(docs: DataFrame, threshold: float, width: int, recall: float) -> DataFrame:
    """What jaccard_classes gives, with the row's text hash (a, b) and its component's least class (null without one)."""
    bands, rows = choose_bands(threshold, recall)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for whole in batches:
            for batch in slices(whole, "text") if whole.num_rows else [whole]:
                sets = [shingles.of(t) for t in batch.column("text").to_pylist()]
                got = [band_hashes(s, bands, rows).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "a", "b")] + [pa.array(got, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "a", "b", "bands", "size"])
        release()

    signed = keep(own.mapInArrow(sign, "doc_id bigint, a bigint, b bigint, bands array<bigint>, size bigint"), "signed")
    live = signed.where("doc_id IS NOT NULL AND bands IS NOT NULL")
    classes = keep(live.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"), F.first("size").alias("size")), "classes")

    # buckets of two or more; of those with the same members, the one of the first band
    keyed = classes.select("rep", "a", "b", "size", F.posexplode("bands").alias("band", "h"))
    size = keyed.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.sum(F.xxhash64("rep", "a", "b").cast("decimal(38,0)")).alias("s1"), F.expr("bit_xor(xxhash64(rep, a, b, 7))").alias("s2")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    chosen = size.groupBy("n", "s1", "s2", "shingles").agg(F.min(F.struct("band", "h")).alias("x")).select("x.band", "x.h", F.least(blocks, F.col("n")).cast("int").alias("blocks"))
    member = keyed.join(chosen, ["band", "h"]).groupBy("rep", "a", "b").agg(F.collect_list(F.struct("band", "h", "blocks")).alias("buckets"))  # a row for each band at most
    member = keep(member, "members")

    # shingle sets of the classes in such buckets, dealt to the tasks of their pairs of blocks
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for whole in batches:
            for batch in slices(whole, "text", 500_000) if whole.num_rows else [whole]:
                out: list[tuple] = []
                for rep, a, b, text, buckets in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "a", "b", "text", "buckets")), strict=True):
                    s = shingles.of(text)
                    raw, sig = s.tobytes(), band_hashes(s, bands, rows).tobytes()
                    for x in buckets:
                        n = x["blocks"]
                        mine = int(mix(np.array([a], np.int64).view(np.uint64))[0] % np.uint64(n))
                        out += [(x["band"], x["h"], min(mine, k), max(mine, k), int(mine > k), rep, a, b, sig, raw) for k in range(n)]
                    if sum(len(r[9]) for r in out[-64:]) > 1 << 22 or len(out) > 2000:
                        yield _dealt(out)
                        out = []
                yield _dealt(out)
        release()

    with_text = join_few(own, member.withColumnRenamed("rep", "doc_id"), ["doc_id", "a", "b"], "inner", "24L * size(buckets)").select("doc_id", "a", "b", "text", "buckets")
    dealt = with_text.mapInArrow(deal, "band int, h bigint, lo int, hi int, side int, rep bigint, a bigint, b bigint, sig binary, shingles binary").repartition("band", "h", "lo", "hi").sortWithinPartitions("band", "h", "lo", "hi", "rep")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, {}, []

        def close() -> None:
            if len(group) > 1:
                ids = sorted(group)
                sides = np.array([group[k][0] for k in ids])
                if key[2] == key[3] or not sides.any() or sides.all():
                    if key[2] != key[3]:
                        return
                    sides[:] = 0
                sig = np.stack([np.frombuffer(group[k][1], np.uint64) for k in ids])
                out.extend(verify(ids, sig, [np.frombuffer(group[k][2], np.uint64) for k in ids], sides, key[0], threshold))

        for batch in batches:
            for band, h, lo, hi, side, rep, a, b, sig, raw in zip(*(batch.column(c).to_pylist() for c in ("band", "h", "lo", "hi", "side", "rep", "a", "b", "sig", "shingles")), strict=True):
                if (band, h, lo, hi) != key:
                    close()
                    key, group = (band, h, lo, hi), {}
                group[rep, a, b] = (side, sig, raw)
            if len(out) > 5000:
                yield _linked(out)
                out = []
        close()
        yield _linked(out)

    linked = keep(dealt.mapInArrow(join, f"id {CLASS}, root {CLASS}, links bigint"), "links")
    forget(member)
    found = components(linked, "id", "root")  # a component's least class has its least doc_id
    links = linked.groupBy("id").agg(F.sum("links").alias("n_links"))
    info = classes.select(F.struct("rep", "a", "b").alias("id"), "a", "b", "rep", "n_copies").join(links, "id", "left").join(found, "id", "left")
    info = info.select("a", "b", F.col("rep").alias("rep_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("least"))
    out = signed.select("doc_id", "a", "b", F.col("bands").isNotNull().alias("worded")).join(info, ["a", "b"], "left")
    known = F.col("worded") & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.when(known, F.col("least.rep")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(known, F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        F.when(known, F.col("n_copies")).otherwise(F.lit(1)).cast("bigint").alias("n_copies"),
        F.when(known, F.col("rep_id")).otherwise(F.col("doc_id")).alias("rep_id"),
        "a",
        "b",
        F.when(known, F.col("least")).alias("least"),
    )


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["band", "h", "lo", "hi", "side", "rep", "a", "b", "sig", "shingles"])


def _linked(rows: list[tuple]) -> pa.RecordBatch:
    ids, roots, links = zip(*rows, strict=True) if rows else [[]] * 3

    def classes(of: list[tuple[int, int, int]]) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array([x[k] for x in of], pa.int64()) for k in range(3)], names=["rep", "a", "b"])

    return pa.RecordBatch.from_arrays([classes(ids), classes(roots), pa.array(links, pa.int64())], names=["id", "root", "links"])


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline_near_duplicates(docs: DataFrame) -> DataFrame:
    """The pipeline's second stage: of each class the document with the least doc_id stays, one row of it.

    Where that doc_id has several texts in the class, one of them stays; of rows that repeat its doc_id and text, any one.
    Rows without a class (a null doc_id, no words) all stay.
    """
    key = ["doc_id", "__a", "__b"]
    rows = keep(_classed(docs.select("doc_id", "text"), THRESHOLD, SHINGLE, RECALL).where("least IS NOT NULL").select("doc_id", F.col("a").alias("__a"), F.col("b").alias("__b"), "n_copies", "least"), "rows")
    first = (F.col("doc_id") == F.col("least.rep")) & (F.col("__a") == F.col("least.a")) & (F.col("__b") == F.col("least.b"))
    gone = keep(rows.where(~first).select(key).distinct(), "gone")
    again = keep(rows.where(first & (F.col("n_copies") > 1)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "again")
    forget(rows)
    own = join_few(docs.withColumns({"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit(1), "text")}), gone, key, "left_anti")
    if again.limit(1).count():
        own = join_few(own, again, key, "left_anti").unionByName(join_few(own, again, key, "inner").dropDuplicates(key))
    return own.select(*docs.columns)


#: Banding by MinHash isn't a matter of SQL; the tests compare classes and links with all pairs by brute force.
ORACLES: dict[str, str] = {}
QUERIES = {"op7_ngram_jaccard": op7_ngram_jaccard}
