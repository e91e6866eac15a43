"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer numpy network whose
probabilities are calibrated by a temperature.

Random indexing: each token bucket has a fixed sparse ternary index vector; a bucket's word vector is the sum of the
index vectors of the tokens within two places of it, over all documents. Each task sums its own partition's vectors as
whole numbers (so the order of adding can't matter) and sends them on once; the summing tasks stream over what arrives.
Where there are more splits than TASKS_A_CORE for each core, a counting task reads up to SPLITS_A_TASK of them before it
sends its sums: 2 MB for every 512 MB read.
The vectors are BUCKETS x DIMS whatever the corpus's size, so they are broadcast. A document is the mean of its tokens'
unit vectors. The network is fitted on the driver on MOST_ROWS labelled rows at most, those first by a hash of their id;
one in five of them sets the temperature.

Only rows whose crc32(doc_id as text) mod 3 is not 1 teach labels; nothing but the text enters a score.

Defined results: null and empty texts score as a document with a zero vector; a very long text is pooled whole; null ids
or labels teach nothing, and an id labelled twice counts once, with the lesser label; with no labels every score is 0.5,
which predicts 1; repeated rows score alike; held_out is null for a null id; empty tables give no rows; other columns pass
through unless they have the name of an output column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import aside, release, slices, table

BUCKETS, DIMS, NONZERO, REACH = 1 << 13, 32, 4, 2
MOST_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4
CHUNK = 64  # buckets that travel in one row
TASKS_A_CORE, SPLITS_A_TASK = 16, 4


class Tokens(dict):
    """word -> buckets of its letter runs and mark runs; a word in capitals also gives a token that says so."""

    part = re.compile(r"[^\W_]+|[\W_]+")

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = self.part.findall(word)
        out = [xxhash.xxh3_64_intdigest(p.lower().encode()) % BUCKETS for p in parts]
        if len(word) > 2 and word.isupper():
            out.append(xxhash.xxh3_64_intdigest(b"\0capitals") % BUCKETS)
        if len(self) > 150_000:
            self.clear()
        value = self[word] = tuple(out)
        return value

    def ids(self, text: str | None) -> np.ndarray:
        return np.array([i for w in map(self.__getitem__, (text or "").split()) for i in w], np.int64)


def index_vectors() -> np.ndarray:
    """BUCKETS x DIMS, NONZERO entries of +1 or -1 in each row, from a fixed seed."""
    rng = np.random.default_rng(7)
    at = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    out = np.zeros((BUCKETS, DIMS), np.int64)
    np.put_along_axis(out, at, rng.choice([-1, 1], (BUCKETS, NONZERO)), axis=1)
    return out


def _neighbours(ids: list[np.ndarray], total: np.ndarray, index: np.ndarray) -> None:
    """Adds to total the index vectors of each token's neighbours; documents are kept apart."""
    gap = np.full(REACH, -1, np.int64)
    flat = np.concatenate([x for d in ids for x in (d, gap)])
    signs = np.concatenate([index, np.zeros((1, DIMS), np.int64)]).astype(np.int8)  # row -1: outside
    for start in range(0, len(flat), 50_000):
        own = flat[start : start + 50_000]
        around = np.zeros((len(own), DIMS), np.int8)
        for k in range(1, REACH + 1):
            for shifted in (flat[max(0, start - k) : start - k + len(own)] if start >= k else np.concatenate([gap[:k], flat[: len(own) - k]]), flat[start + k : start + k + len(own)]):
                around[: len(shifted)] += signs[shifted]
        live = own >= 0
        order = np.argsort(own[live], kind="stable")
        key = own[live][order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if len(first):
            total[key[first]] += np.add.reduceat(around[live][order], first, axis=0, dtype=np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from all documents."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, index, total = Tokens(), index_vectors(), np.zeros((BUCKETS, DIMS), np.int64)
        seen = False
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                ids = [tokens.ids(t) for t in batch.column("text").to_pylist()]
                if ids:
                    seen = True
                    _neighbours(ids, total, index)
        if seen:
            live = [k for k in range(0, BUCKETS, CHUNK) if total[k : k + CHUNK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([_packed(total[k : k + CHUNK]) for k in live], pa.binary())], names=["chunk", "sums"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                part = _unpacked(raw)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "sums"])

    texts = docs.select("text")
    most = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // SPLITS_A_TASK))
    rows = texts.coalesce(most).mapInArrow(count, "chunk int, sums binary").repartition("chunk").mapInArrow(add, "chunk int, sums binary").collect()  # BUCKETS / CHUNK rows
    total = np.zeros((BUCKETS, DIMS), np.int64)
    for r in rows:
        total[r["chunk"] : r["chunk"] + CHUNK] = np.frombuffer(r["sums"], np.int64).reshape(-1, DIMS)
    norm = np.sqrt((total.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (total / np.maximum(norm, 1e-9)).astype(np.float32)


def _packed(sums: np.ndarray) -> bytes:
    """In 4 bytes a number where all fit."""
    return b"4" + sums.astype(np.int32).tobytes() if np.abs(sums).max() < 1 << 31 else b"8" + sums.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], np.int32 if raw[:1] == b"4" else np.int64).reshape(-1, DIMS).astype(np.int64)


def pooled(tokens: Tokens, vectors: np.ndarray, text: str | None) -> np.ndarray:
    ids = tokens.ids(text)
    if not len(ids):
        return np.zeros(DIMS, np.float32)
    total = np.zeros(DIMS, np.float64)
    for k in range(0, len(ids), 20_000):
        total += vectors[ids[k : k + 20_000]].sum(0, dtype=np.float64)
    return (total / len(ids)).astype(np.float32)


class Network:
    """x -> tanh(x W + b) -> V + c; the logit is divided by a temperature."""

    def __init__(self) -> None:
        self.mean, self.scale, self.temperature = np.zeros(DIMS), np.ones(DIMS), 1.0
        self.w, self.b, self.v, self.c = np.zeros((DIMS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w + self.b) @ self.v + self.c

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on mini-batches in a fixed order; then the temperature on rows that were not fitted."""
        if not len(y):
            return self
        held = np.arange(len(y)) % 5 == 4
        own, label = (x[~held], y[~held]) if held.any() else (x, y)
        rng = np.random.default_rng(11)
        self.mean, self.scale = own.mean(0), own.std(0) + 1e-6
        self.w = rng.normal(0, 1 / np.sqrt(DIMS), (DIMS, HIDDEN))
        self.v = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
        z = (own - self.mean) / self.scale
        names, step = ("w", "b", "v", "c"), 0
        m, s = {k: 0.0 for k in names}, {k: 0.0 for k in names}
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for k in range(0, len(z), 256):
                rows = order[k : k + 256]
                h = np.tanh(z[rows] @ self.w + self.b)
                off = (_sigmoid(h @ self.v + self.c) - label[rows]) / len(rows)
                back = np.outer(off, self.v) * (1 - h * h)
                grad = {"w": z[rows].T @ back + DECAY * self.w, "b": back.sum(0), "v": h.T @ off + DECAY * self.v, "c": off.sum()}
                step += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * grad[n]
                    s[n] = 0.999 * s[n] + 0.001 * grad[n] ** 2
                    setattr(self, n, getattr(self, n) - RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8))
        if held.any():
            logit, label = self.logit(x[held]), y[held]
            tried = np.geomspace(0.25, 8, 60)
            loss = [np.mean(np.logaddexp(0, logit / t) - label * logit / t) for t in tried]
            self.temperature = float(tried[int(np.argmin(loss))])
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def teaching(doc_id: str = "doc_id") -> object:
    """Whether a row's label may be learnt."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) != 1


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """docs with score and predicted. docs: doc_id, text and others; labels: doc_id, quality."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & teaching()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for whole in batches:
            for batch in slices(whole, "text") if whole.num_rows else [whole]:
                x = [pooled(tokens, shared.value, t).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])

    taught = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")  # most_rows ids at most
    rows = sorted({(r["doc_id"], r["quality"], bytes(r["x"])) for r in taught.mapInArrow(pool, "doc_id bigint, quality int, x binary").collect()}, key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0]).encode()), r))
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64).reshape(-1, DIMS)
    net = Network().fit(x, np.array([float(r[1] > 0) for r in rows]))
    rest = [c for c in docs.columns if c not in ("score", "predicted")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for whole in batches:
            for batch in slices(whole, "text") if whole.num_rows else [whole]:
                x = np.array([pooled(tokens, shared.value, t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, DIMS)
                s = net.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[*rest, "score", "predicted"])
        release()

    schema = T.StructType([docs.schema[c] for c in rest]).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.select(*rest).mapInArrow(score, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", (~teaching()).alias("held_out"), "score", "predicted")


def pipeline_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pipeline's first stage: documents that the classifier rejects go."""
    return aside(docs, ["doc_id", "text"], lambda own: classify(own, labels.select("doc_id", "quality")).where("predicted = 1"))


#: A fitted network isn't a matter of SQL; the tests measure accuracy on held-out rows.
ORACLES: dict[str, str] = {}
QUERIES = {"op8_quality_classifier": op8_quality_classifier}
