"""What the operators of this subpackage share: a shared scratch folder, word splitting, null-safe reading."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words (space and 0x09 to 0x0D), as a Java / RE2 class body.
SPACE = r"\x20\x09-\x0D"


#: Texts are long: this many rows to an Arrow batch, unless the session says otherwise than Spark's own 10,000.
ARROW_ROWS = "500"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or what the context was given.

    Only where both are unset and everything runs in one process may it be a temporary folder; on a cluster that would
    scatter the rows over the executors' own disks, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def keep(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors.

    Results are lazy, so what they read must outlive the call; the driver deletes it when it ends, if not forget() before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what keep() wrote, once nothing reads it any more."""
    path = getattr(df, "_docloom_path", None)
    if path:
        where, system = _file_system(df.sparkSession, path)
        system.delete(where, True)


#: Bytes of values up to which rows are broadcast; more are joined by a shuffle of the rows that may match.
MOST_BROADCAST = 32 << 20


def join_few(df: DataFrame, few: DataFrame, on: list[str], how: str, cost: str = "0", most: int | None = None) -> DataFrame:
    """df joined with `few` rows (inner, left or left_anti), so that the wide rows of df move only if they may match.

    few is broadcast if its size (64 bytes a row and what the expression `cost` says) is within the bound. If not, a
    blocked Bloom filter of its keys, whose size has a bound, is broadcast instead: rows of df that it refuses stay where
    they are, the others are shuffled and joined exactly. Key columns aren't null in few; null keys in df match nothing.
    """
    most = MOST_BROADCAST if most is None else most
    n, size = few.agg(F.count(F.lit(1)), F.sum(F.expr(f"64L + {cost}"))).first()
    if (size or 0) <= most:
        return df.join(F.broadcast(few), on, how)
    key = F.xxhash64(*[F.col(c) for c in on])
    tested = with_possible(df.withColumn("__key", key), "__key", few.select(key.alias("key")), n)
    maybe, rest = tested.where("__possible").drop("__key", "__possible"), tested.where("NOT __possible").drop("__key", "__possible")
    joined = maybe.join(few, on, how)
    return joined if how == "inner" else joined.unionByName(rest, allowMissingColumns=True)


#: A filter has this many blocks at most (about 20 MB), 512 bits each; blocks hold WORDS words, keys set a bit in each.
MOST_BLOCKS, WORDS, BITS_A_KEY = 1 << 18, 8, 16


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """A blocked Bloom filter as a table: __block, w0 ... w7. keys has a column key (any type that hashes)."""
    bits = [f"bit_or(shiftleft(1L, cast(pmod(xxhash64(key, {k}), 64L) as int))) AS w{k}" for k in range(WORDS)]
    return keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks).cast("bigint")).alias("__block")).agg(*map(F.expr, bits))


def with_possible(df: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """df with __possible: false only where the column `key` is none of the n `keys`. The filter's size has a bound."""
    blocks = max(1, min(MOST_BLOCKS, n * BITS_A_KEY // (64 * WORDS) + 1))
    own = df.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks).cast("bigint")))
    tested = own.join(F.broadcast(bloom_blocks(keys, blocks)), "__block", "left")
    bits = [F.expr(f"(shiftrightunsigned(w{k}, cast(pmod(xxhash64({key}, {k}), 64L) as int)) & 1L) = 1L") for k in range(WORDS)]
    return tested.withColumn("__possible", F.coalesce(reduce(Column.__and__, bits), F.lit(False))).drop("__block", *[f"w{k}" for k in range(WORDS)])


def aside(docs: DataFrame, needed: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs) with the columns of docs: all but the needed ones bear other names meanwhile, so that none can clash."""
    others = {c: f"__other{k}" for k, c in enumerate(docs.columns) if c not in needed}
    out = run(docs.select(*[F.col(f"`{c}`").alias(others.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() parts at exactly these characters. Null: none."""
    return text.encode().split() if text else []


def release() -> None:
    """Gives what a finished task has freed back to the system; Python workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class WordHash(dict):
    """word -> 64-bit hash; forgets all when full, so memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def slices(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text at most, one row at least."""
    sizes = batch.column(text).cast(pa.large_string())
    at = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    ends = at[1:] - at[0]
    start, base = 0, 0
    for end, total in enumerate(ends.tolist(), 1):
        if total - base >= most or end == len(ends):
            yield batch.slice(start, end - start)
            start, base = end, total
