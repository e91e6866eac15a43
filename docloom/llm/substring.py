"""Substring dedup: suffix automata of reference passages, and the matching statistics of documents run past them.

A window is LENGTH consecutive words. A word goes if a window that covers it also starts in a document with a smaller
doc_id. Three steps find the passages that can matter, so that no document meets an automaton for nothing:

1. A document whose whole text equals that of a smaller doc_id is a copy: all its windows start there (an exact hash
   of the text, summed map-side). Copies need no automaton and aren't references.
2. Anchors: each window's least hash of ANCHOR words. Two documents that share a window share its anchor. Anchors of two
   or more documents go into a Bloom filter; past its bound there are several, and the texts are read once for each.
3. Windows whose anchor is in the filter are summed by a 128-bit hash to their least doc_id, the owner. Consecutive
   windows with one owner are a run.

Then owners' runs are the reference passages. They are dealt out by owner, so each owner's automaton stands in one task
(more if many documents run past it) and no larger than that document; the runs of other documents follow it there, one
at a time. A match of LENGTH or more words marks its words; but for the copies of step 1 only what the automaton matches
word by word is removed.

This departs from the method as named in two points. The reference passages grow with the corpus, so their automata can't
be broadcast: they are dealt by owner, and the filter is what is broadcast. And which run meets which owner is decided
beforehand by the join on window hashes: the automata confirm those runs word by word and give the spans, they don't
search the corpus. Streaming every document past every shard's automaton would read the corpus once for each shard.

Defined results: a null text has no words; a null doc_id neither is removed from nor refers; a very long text is read
whole; rows with one doc_id are judged each by its own text, and never against each other; repeated rows are judged
alike; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WordHash, forget, join_few, keep, release, slices, table, words_of
from docloom.llm.hashing import Bloom, Rolling, mix, sliding_min

LENGTH, ANCHOR = 50, 20
#: Runs that one copy of an owner's automaton serves.
MOST_RUNS = 2_000


class SuffixAutomaton:
    """Of one or more word sequences, none of whose matches spans two of them."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        """Adds a sequence to the generalised automaton."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if w in nxt[last]:
                q = nxt[last][w]
                last = q if length[q] == length[last] + 1 else self._clone(last, q, w)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w: object) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def statistics(self, words: list) -> Iterator[int]:
        """For each word, the length of the longest match that ends with it."""
        nxt, link, length = self.next, self.link, self.length
        v = l = 0
        for w in words:
            while v and w not in nxt[v]:
                v = link[v]
                l = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                l += 1
            yield l


def spans(automaton: SuffixAutomaton, words: list, least: int) -> list[tuple[int, int]]:
    """Maximal [start, end) covered by matches of `least` words or more."""
    out: list[list[int]] = []
    for i, l in enumerate(automaton.statistics(words), 1):
        if l >= least:
            if out and i - l <= out[-1][1]:
                out[-1] = [min(out[-1][0], i - l), i]
            else:
                out.append([i - l, i])
    return [(a, b) for a, b in out]


class Windows:
    """Anchors and two hashes of every window of a text."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor, self.hash = length, anchor, WordHash()
        self.one, self.two = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93)

    def tokens(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))

    def anchors(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prefix = self.one.prefix(tokens)
        return sliding_min(self.one.runs(prefix, self.anchor), self.length - self.anchor + 1), prefix

    def pairs(self, tokens: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.one.runs(prefix, self.length), self.two.runs(self.two.prefix(mix(tokens)), self.length)


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text, removed (sorted [start, end) word spans) for every row of docs."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("__a"), F.xxhash64(F.lit(1), "text").alias("__b"))
    # 1: copies of whole texts
    ids = own.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "__a", "__b")
    first = ids.groupBy("__a", "__b").agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last")).where("__first < __last").drop("__last")
    copies = keep(ids.join(first, ["__a", "__b"]).where("doc_id > __first").select("doc_id", "__a", "__b").distinct(), "copies")
    marked = join_few(own, copies.withColumn("__copy", F.lit(True)), ["doc_id", "__a", "__b"], "left").select("doc_id", "text", F.col("__a").alias("k"), F.coalesce("__copy", F.lit(False)).alias("__copy"))
    unique = marked.where("NOT __copy AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "k", "text")

    # 2: anchors that two or more documents have
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length, anchor)
        for whole in batches:
            for batch in slices(whole, "text") if whole.num_rows else [whole]:
                got = [np.unique(windows.anchors(windows.tokens(t))[0]) for t in batch.column("text").to_pylist()]
                doc = np.repeat(batch.column("doc_id").to_numpy(), [len(g) for g in got]) if got else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)), pa.array(doc, pa.int64())], names=["anchor", "doc_id"])
        release()

    found = unique.mapInArrow(anchors, "anchor bigint, doc_id bigint").groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    found = keep(found, "anchors")
    filters = Bloom.of(found, "anchor")
    forget(found)

    # 3: windows that may be shared, and their owners
    def windows_of(turn: int):  # noqa: ANN202
        bloom = spark.sparkContext.broadcast(filters[turn])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows, test = Windows(length, anchor), Bloom(bloom.value)
            for whole in batches:
                for batch in slices(whole, "text", 2_000_000) if whole.num_rows else [whole]:
                    rows: list[tuple[np.ndarray, ...]] = []
                    for doc, k, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "text")), strict=True):
                        tokens = windows.tokens(text)
                        least, prefix = windows.anchors(tokens)
                        if len(least) and len(at := np.flatnonzero(test.has(least) & (Bloom.turn(least, n_turns) == turn) if n_turns > 1 else test.has(least))):
                            one, two = windows.pairs(tokens, prefix)
                            rows.append((one[at].view(np.int64), two[at].view(np.int64), np.full(len(at), doc), np.full(len(at), k), at.astype(np.int32)))
                    cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "doc_id", "k", "pos"])
            release()

        return unique.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, k bigint, pos int")

    # kept, as both the owners and the rows that look theirs up need it; the owners too, so that the join's two sides are
    # plain exchanges, whose large partitions Spark splits when a window fills them
    n_turns = len(filters)
    seen = keep(reduce(DataFrame.unionByName, map(windows_of, range(n_turns))), "windows")
    owners = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("__last")).where("owner < __last").drop("__last")
    owners = keep(owners, "owners")
    placed = seen.join(owners, ["h1", "h2"]).groupBy("doc_id", "k").agg(F.collect_list(F.struct("pos", "owner")).alias("at"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column("at").to_pylist():
                own: list[dict] = []
                for x in sorted(((x["pos"], x["owner"]) for x in at)):
                    if own and own[-1]["owner"] == x[1] and x[0] <= own[-1]["stop"] + 1:
                        own[-1]["stop"] = x[0]
                    else:
                        own.append({"start": x[0], "stop": x[0], "owner": x[1]})
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("owner", pa.int64())])))], names=["doc_id", "k", "runs"])

    placed = keep(placed.mapInArrow(runs, "doc_id bigint, k bigint, runs array<struct<start: int, stop: int, owner: bigint>>"), "runs")
    forget(seen)
    forget(owners)

    # reference passages and the runs that pass them, with their words
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000) if whole.num_rows else [whole]:
                out = []
                for doc, k, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "text", "runs")), strict=True):
                    words = words_of(text)
                    for r in own:
                        if r["stop"] + length <= len(words) and r["owner"] <= doc:
                            out.append((r["owner"], doc, k, r["start"], b" ".join(words[r["start"] : r["stop"] + length]).decode()))
                cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["owner", "doc_id", "k", "start", "words"])

    with_text = join_few(unique, placed, ["doc_id", "k"], "inner", "16L * size(runs)").select("doc_id", "k", "text", "runs")
    parts = with_text.mapInArrow(pieces, "owner bigint, doc_id bigint, k bigint, start int, words string")
    served = placed.select(F.col("doc_id").alias("__d"), F.explode("runs").alias("r")).where("r.owner <> __d").groupBy(F.col("r.owner").alias("owner")).agg(F.count(F.lit(1)).alias("n")).select("owner", F.ceil(F.col("n") / MOST_RUNS).cast("int").alias("__shares")).where("__shares > 1")
    shared = join_few(parts, served, ["owner"], "left").withColumn("__shares", F.coalesce("__shares", F.lit(1)))
    reference = F.col("owner") == F.col("doc_id")
    dealt = shared.withColumn("__share", F.explode(F.when(reference, F.sequence(F.lit(0), F.col("__shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("__shares")).cast("int")))))
    dealt = dealt.select("owner", "__share", (~reference).cast("int").alias("later"), "doc_id", "k", "start", "words").repartition("owner", "__share").sortWithinPartitions("owner", "__share", "later", "doc_id", "start")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton = None, SuffixAutomaton()
        for batch in batches:
            out: list[tuple] = []
            for owner, share, later, doc, k, start, text in zip(*(batch.column(c).to_pylist() for c in ("owner", "__share", "later", "doc_id", "k", "start", "words")), strict=True):
                if (owner, share) != key:
                    key, automaton = (owner, share), SuffixAutomaton()
                if later:
                    out += [(doc, k, start + a, start + b) for a, b in spans(automaton, text.encode().split(), length)]
                else:
                    automaton.add(text.encode().split())
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "k", "start", "stop"])

    matched = dealt.mapInArrow(match, "doc_id bigint, k bigint, start int, stop int")
    removed = keep(matched.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")), "spans")
    return join_few(marked, removed, ["doc_id", "k"], "left", "8L * size(spans)").select("doc_id", "text", "__copy", "spans")


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def rewrite(deduped: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if texts, kept: the words that stay, joined by one space."""
    schema = RESULT if texts else RESULT.rpartition(",")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text") if whole.num_rows else [whole]:
                out = []
                for doc, text, copy, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__copy", "spans")), strict=True):
                    words = words_of(text)
                    stay, at = [], 0
                    if copy and len(words) >= length:
                        at = len(words)
                    for s in own or [] if not copy else []:
                        if s["start"] > at:
                            stay += words[at : s["start"]]
                        at = max(at, s["stop"])
                    stay += words[at:]
                    kept = b" ".join(stay)
                    out.append((doc, len(words), len(words) - len(stay), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
                n = 5 if texts else 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, types, strict=True))[:n]], names=names[:n])

    return deduped.select("doc_id", "text", "__copy", "spans").mapInArrow(run, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite(dedup(table(spark, sf_dir, "documents")))


ORACLES = {"op9_substring_dedup": rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - {LENGTH} + 2)) AS pos, w FROM d WHERE len(w) >= {LENGTH}),
h AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + {LENGTH} - 1], ' ')) AS k FROM s),
f AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) AS o FROM h) WHERE o < doc_id),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(pos, pos + {LENGTH})) AS p FROM f)),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
o AS (SELECT d.doc_id, d.w, CASE WHEN r.gone IS NULL THEN d.w ELSE list_transform(list_filter(list_zip(d.w, range(1, len(d.w) + 1)), lambda z: NOT list_contains(r.gone, z[2])), lambda z: z[1]) END AS k FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM o
"""}
QUERIES = {"op9_substring_dedup": op9_substring_dedup}
