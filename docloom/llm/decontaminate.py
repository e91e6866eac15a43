"""Benchmark decontamination: template canonicalisation, a hash join of template windows, and a slot check.

A word loses the marks around it; then numbers, numbers with units, units and capitalised names become typed
placeholders and other words their lower case. What a placeholder stands for is its slot. Windows of five placeholders
and words are hashed; every window of every document is looked up among the benchmark's. A document holds an item if at
least 0.8 of the item's windows occur in it and, on the alignments that those windows give, item slots and document
slots agree one to one (a re-parameterised question replaces a value alike wherever it stands) for at least 0.8 of the
slots. An item shorter than a window says too little to be found inside a text: it is held by a document that is that
item and nothing else.

A benchmark of up to BLOCK_ITEMS items and BLOCK_CHARS characters is sent to the tasks whole, as a table of window hashes
that each document's windows are looked up in; rows don't move. A larger one is joined: an item that has 0.8 of its windows
in a document has at least one of any 0.2 of them there, so of each item only its rarest windows (a fifth and one) are
keys. Documents' windows that a Bloom filter of those keys lets through meet them in a hash join, and each document that
meets an item so is judged in full against the items that it met. Both ways give the same rows.

Defined results: a null or wordless text holds nothing; null or wordless items are left out; a very long text is read
whole; repeated items with one id count as one item each and are reported once; of windows that occur more than once the
alignment that most windows share counts, of equal ones the later; repeated rows are judged alike; an empty benchmark
finds nothing; other columns pass through unless they have the name of an output column.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import aside, forget, join_few, keep, release, slices, table, words_of
from docloom.llm.hashing import Bloom

WINDOW, LEAST_SHARE = 5, 0.8
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
#: Units of measure, and number words.
UNITS = set("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s ms min h hr hrs day days week weeks month months year years hz khz mhz ghz w kw v a kb mb gb tb usd eur gbp percent % $ € £ °c °f mph kmh meter meters metre metres mile miles hour hours minute minutes second seconds dollar dollars euro euros cent cents".split())
NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
NUM, UNIT, NAME, QUANTITY = "\0num", "\0unit", "\0name", "\0quantity"
_number = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(%?)$")
_quantity = re.compile(r"[+-]?\d[\d.,]*([^\W\d_]+)$")
_edge = re.compile(r"^[\W_]+|[\W_]+$")


def canonical(word: bytes) -> tuple[str, str | None]:
    """(template token, slot value or None)."""
    raw = word.decode()
    if _number.match(raw.strip(".,;:!?()[]\"'")):
        return NUM, raw.strip(".,;:!?()[]\"'")
    bare = _edge.sub("", raw) or raw
    low = bare.lower()
    if low in UNITS:
        return UNIT, low
    if low in NUMBER_WORDS or bare[0].isdigit() and _number.match(bare):
        return NUM, low
    m = _quantity.match(bare)
    if m and m[1].lower() in UNITS:
        return QUANTITY, low
    if len(bare) > 1 and bare[0].isupper() and not bare.isupper() and bare.isalpha():
        return NAME, low
    return low, None


class Templates(dict):
    """word -> (hash of its template token, slot value); forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        token, _ = canonical(word)
        value = self[word] = xxhash.xxh3_64_intdigest(token.encode())
        return value

    def hashes(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` tokens, by Horner's rule modulo 2^64."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = out * _FACTOR + tokens[k : k + n]
        out ^= out >> np.uint64(29)
    return out


def forms(text: str | None) -> list[tuple[bytes, ...]]:
    """The words of an item, and those of the item in capitals: a text set in capitals shows no names."""
    words = words_of(text)
    return list(dict.fromkeys((tuple(words), tuple(w.decode().upper().encode() for w in words)))) if words else []


class Benchmark:
    """Some items: sorted window hashes and, for each, the (item, position) pairs."""

    def __init__(self, items: list[tuple[int, str]], templates: Templates | None = None):
        templates = templates or Templates()
        self.words, self.n_windows, self.ids = [], [], []
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, list[int]] = defaultdict(list)  # hash of a whole short template -> items
        for item_id, text in items:
            for form in forms(text):
                tokens = templates.hashes(form)
                width = min(WINDOW, len(form))
                hashes = window_hashes(tokens, width).tolist()
                k = len(self.ids)
                self.ids.append(item_id)
                self.words.append(form)
                self.n_windows.append(len(set(hashes)))
                if width < WINDOW:
                    self.short[hashes[0]].append(k)
                else:
                    for pos, h in enumerate(hashes):
                        at[h].append((k, pos))
        self.hashes = np.array(sorted(at), np.uint64)
        self.at = dict(at)
        # 2^20 flags by the low bits: most windows are refused by one look
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def held(self, text: str | None, templates: Templates) -> list[tuple[int, float, bool]]:
        """(item id, share of its windows, re-parameterised) of the items that text holds."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        tokens = templates.hashes(words)
        if len(words) < WINDOW:
            whole = int(window_hashes(tokens, len(words))[0])
            got = [(k, self.matched(k, words, {p: p for p in range(len(words))})) for k in self.short.get(whole, ())]
            return [(self.ids[k], 1.0, changed) for k, changed in got if changed is not None]
        found: dict[int, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))  # item -> window hash -> diagonals
        own = window_hashes(tokens, WINDOW)
        maybe = np.flatnonzero(self.flags[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
        for pos, h in zip(maybe.tolist(), own[maybe].tolist(), strict=True):
            for item, start in self.at.get(h, ()):
                found[item][h][pos - start] += 1
        out = []
        for item, windows in found.items():
            share = len(windows) / self.n_windows[item]
            if share >= LEAST_SHARE and (slots := self.consistent(item, windows, words)) is not None:
                out.append((self.ids[item], share, slots))
        return out

    def consistent(self, item: int, windows: dict[int, Counter], words: list[bytes]) -> bool | None:
        """None if slots contradict; else whether any slot has another value than in the item.

        A window that occurs more than once takes the diagonal that most windows of the item share.
        """
        votes = Counter()
        for diagonals in windows.values():
            votes.update(diagonals.keys())
        chosen: dict[int, int] = {}  # item position -> document position
        for h, diagonals in windows.items():
            best = max(diagonals, key=lambda d: (votes[d], -d))
            for i, start in self.at[h]:
                if i == item and 0 <= start + best:
                    for k in range(start, min(start + WINDOW, len(self.words[item]))):
                        if k + best < len(words):
                            chosen.setdefault(k, k + best)
        return self.matched(item, words, chosen)

    def matched(self, item: int, words: list[bytes], chosen: dict[int, int]) -> bool | None:
        """What consistent() says of the item positions and document positions in `chosen`."""
        there, back, good, total, changed = {}, {}, 0, 0, False
        for k, pos in sorted(chosen.items()):
            kind, a = canonical(self.words[item][k])
            other, b = canonical(words[pos])
            if a is None or other != kind:
                continue
            total += 1
            if there.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a:
                good += 1
                changed |= a != b
        return changed if good >= LEAST_SHARE * total else None


HELD = T.ArrayType(T.StructType().add("item", T.LongType()).add("share", T.DoubleType()).add("changed", T.BooleanType()))
_ARROW_HELD = pa.list_(pa.struct([("item", pa.int64()), ("share", pa.float64()), ("changed", pa.bool_())]))


def _column(held: list[list[tuple[int, float, bool]]]) -> pa.Array:
    return pa.array([[dict(zip(("item", "share", "changed"), x, strict=True)) for x in row] for row in held], _ARROW_HELD)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with items (sorted ids of held items), max_share, reparameterised, contaminated. benchmark: item_id, text."""
    made = ("items", "max_share", "reparameterised", "contaminated")
    own = docs.select(*[c for c in docs.columns if c not in made])
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    out = _looked_up(own, items, text_col) if n <= BLOCK_ITEMS and chars <= BLOCK_CHARS else _joined(own, items, text_col)
    found = F.array_sort(F.array_distinct(F.transform("__held", lambda x: x["item"])))
    share = F.coalesce(F.array_max(F.transform("__held", lambda x: F.round(x["share"], 6))), F.lit(0.0))
    return out.withColumns({"items": found, "max_share": share, "reparameterised": F.exists("__held", lambda x: x["changed"]), "contaminated": F.size("__held") > 0}).drop("__held")


def _looked_up(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """docs with __held, the benchmark being small enough to be broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted((r["item_id"], r["text"]) for r in items.collect()))  # BLOCK_ITEMS and BLOCK_CHARS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        bench = Benchmark(shared.value, templates)
        for whole in batches:
            for batch in slices(whole, text_col) if whole.num_rows else [whole]:
                held = [bench.held(t, templates) for t in batch.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, _column(held)], names=[*batch.schema.names, "__held"])
        release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__held", HELD)]))


def _joined(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """docs with __held, by a hash join on the items' rarest windows. Texts are told apart by a 128-bit hash."""
    spark = docs.sparkSession
    a, b = F.xxhash64(text_col).alias("__a"), F.xxhash64(F.lit(1), text_col).alias("__b")
    own = docs.select("*", a, b)

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for form, words in enumerate(forms(text)):
                    hashes = window_hashes(templates.hashes(words), min(WINDOW, len(words)))
                    distinct = np.unique(hashes).view(np.int64).tolist()
                    out += [(h, item, text, form, len(distinct)) for h in distinct]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["h", "item_id", "text", "form", "n"])

    windows = items.mapInArrow(item_windows, "h bigint, item_id bigint, text string, form int, n int")
    windows = keep(windows.select("h", "item_id", F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(1), "text").alias("tb"), "form", "n"), "item-windows")
    usual = windows.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("item_id", "ta", "tb", "form").orderBy("times", "h"))
    keys = windows.join(usual, "h").withColumn("rank", rank).where(F.col("rank") <= F.floor((1 - LEAST_SHARE) * F.col("n") + 1e-9) + 1)
    keys = keep(keys.select("h", "item_id", "ta", "tb").distinct(), "item-keys")
    filters = Bloom.of(keys.select("h").distinct(), "h")
    few = [spark.sparkContext.broadcast(f) for f in filters]

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, blooms = Templates(), [Bloom(f.value) for f in few]
        for whole in batches:
            for batch in slices(whole, text_col) if whole.num_rows else [whole]:
                out: list[np.ndarray] = []
                for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("__a", "__b", text_col)), strict=True):
                    words = words_of(text)
                    hashes = np.unique(window_hashes(templates.hashes(words), min(WINDOW, len(words)))) if words else np.zeros(0, np.uint64)
                    hits = hashes[np.logical_or.reduce([f.has(hashes) for f in blooms])].view(np.int64)
                    out.append(np.stack([hits, np.full(len(hits), a, np.int64), np.full(len(hits), b, np.int64)]))
                cols = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "__a", "__b"])
        release()

    hits = keep(own.select("__a", "__b", text_col).mapInArrow(doc_windows, "h bigint, __a bigint, __b bigint"), "hits")
    met = hits.join(keys, "h").select("__a", "__b", "item_id", "ta", "tb").distinct()
    texts = items.select("item_id", F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(1), "text").alias("tb"), F.col("text").alias("__item"))
    met = met.join(texts, ["item_id", "ta", "tb"]).groupBy("__a", "__b").agg(F.sort_array(F.collect_list(F.struct("item_id", "__item"))).alias("__met"))  # of one text the items that it met
    met = keep(met, "met")
    for done in (hits, windows, keys):
        forget(done)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                a, b, text, met = (one.column(c)[0].as_py() for c in ("__a", "__b", text_col, "__met"))
                held = Benchmark([(x["item_id"], x["__item"]) for x in met], templates).held(text, templates)
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b]), _column([held])], names=["__a", "__b", "__held"])
        release()

    judged = join_few(own.select("__a", "__b", text_col), met, ["__a", "__b"], "inner", "aggregate(__met, 0L, (s, x) -> s + 16 + octet_length(x.__item))")
    judged = keep(judged.mapInArrow(judge, T.StructType().add("__a", T.LongType()).add("__b", T.LongType()).add("__held", HELD)).dropDuplicates(["__a", "__b"]), "held")
    forget(met)
    out = join_few(own, judged, ["__a", "__b"], "left", "24L * size(__held)").drop("__a", "__b")
    return out.withColumn("__held", F.coalesce("__held", F.array().cast(HELD)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "items", F.size("items").cast("bigint").alias("n_items"), "max_share", "reparameterised")


def pipeline_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's third stage: documents that hold a benchmark item go."""
    return aside(docs, ["doc_id", "text"], lambda own: decontaminate(own, benchmark).where("NOT contaminated"))


#: Window alignment and slot agreement aren't stated in SQL; the tests compare with a brute-force version.
ORACLES: dict[str, str] = {}
QUERIES = {"op10_decontaminate": op10_decontaminate}
