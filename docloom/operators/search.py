"""Ranked search over chunks: BM25 with statistics of each document, weighted by the kind of chunk.

A query is a list of phrases, all of which must occur. write_index() writes postings sorted by token (a token's positions in
a chunk, with the chunk's length, kind and section), statistics of each document, and the chunks. Index reads of the
postings only those of the query's tokens: a filter on the sorted column that files and row groups are skipped by. Phrases
are matched on positions, so no text is read, let alone parted into tokens, until the best hits are shown. Filters on kind
and section come after scoring and leave the statistics alone. score() does the same over chunks without an index.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

K1, B = 1.2, 0.75
#: Weights by kind (scores are negative, so more than 1 promotes); marks that are left out of a token.
WEIGHTS = {"code": 0.35, "heading": 1.2, "table": 1.1, "figure": 0.9}
MARKS = "".join(map(chr, range(0x300, 0x332)))


def _plain_letters() -> tuple[str, str]:
    """Small Latin letters with marks, by their canonical decomposition, and the letters under the marks."""
    own = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0x80, 0x1F00)]
    able = [(c, d[0]) for c, d in own if "a" <= d[0] <= "z" and len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in able), "".join(d for _, d in able)


ACCENTED, PLAIN = _plain_letters()


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED + MARKS, PLAIN)  # letters past the end of the second list go


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def parse_query(query: str) -> list[Phrase]:
    """Each word is a phrase of its tokens; a trailing * makes the last token a prefix. Words without tokens are left out."""
    table = str.maketrans(ACCENTED, PLAIN, MARKS)
    out = []
    for word in query.split():
        parts = [t for t in re.findall(r"[^\W_]+", word.rstrip("*").replace('"', "").lower().translate(table))]
        if parts:
            out.append(Phrase(tuple(parts), word.endswith("*")))
    return out


def occurrences(toks: Column, phrase: Phrase) -> Column:
    """How often the phrase starts in the token array."""
    last = len(phrase.tokens) - 1
    if not last:
        t = phrase.tokens[0]
        return F.size(F.filter(toks, lambda x: x.startswith(t) if phrase.prefix else x == t))

    def starts(x: Column, i: Column) -> Column:
        tests = [x == phrase.tokens[0]]
        for k, t in enumerate(phrase.tokens[1:], 1):
            here = F.get(toks, i + k)
            tests.append(here.startswith(t) if phrase.prefix and k == last else here == t)
        return F.coalesce(reduce(Column.__and__, tests), F.lit(False))

    return F.size(F.filter(toks, starts))


def weight(kind: Column) -> Column:
    return reduce(lambda out, x: F.when(kind == x[0], F.lit(x[1])).otherwise(out), WEIGHTS.items(), F.lit(1.0))


def _none(chunks: DataFrame) -> DataFrame:
    return chunks.where("false").withColumns({"bm25": F.lit(0.0), "rank": F.lit(0.0)})


def _scored(counted: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """Rows that hold all n phrases. counted: __dl and __f0 ...; stats: doc_id, __n, __avg."""
    frequency = counted.groupBy("doc_id").agg(*[F.count_if(F.col(f"__f{k}") > 0).alias(f"__df{k}") for k in range(n)])
    hits = counted.where(reduce(Column.__and__, [F.col(f"__f{k}") > 0 for k in range(n)])).join(frequency, "doc_id").join(stats, "doc_id")

    def part(k: int) -> Column:
        f, df = F.col(f"__f{k}"), F.col(f"__df{k}")
        raw = F.log((F.col("__n") - df + 0.5) / (df + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__dl") / F.col("__avg")))

    bm25 = -reduce(Column.__add__, [part(k) for k in range(n)])
    made = ["__dl", "__n", "__avg", *[f"__f{k}" for k in range(n)], *[f"__df{k}" for k in range(n)]]
    return hits.withColumn("bm25", bm25).withColumn("rank", F.col("bm25") * weight(F.col("kind"))).drop(*made)


def _statistics(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avg"))


def score(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold every phrase, with bm25 (negative, less is better) and rank (weighted)."""
    phrases = parse_query(query)
    if not phrases:
        return _none(chunks)
    counted = chunks.withColumn("__t", tokens(F.col("text"))).withColumn("__dl", F.size("__t"))
    counted = counted.withColumns({f"__f{k}": occurrences(F.col("__t"), p) for k, p in enumerate(phrases)}).drop("__t")
    return _scored(counted, _statistics(counted), len(phrases))


def postings(chunks: DataFrame, *others: str) -> DataFrame:
    """token, doc_id, rowid, positions and other columns: a row for each token of a chunk, made within the chunk's row."""
    placed = F.sort_array(F.transform(tokens(F.col("text")), lambda t, i: F.struct(t.alias("token"), i.alias("pos"))))
    df = chunks.select("doc_id", "rowid", *others, placed.alias("__p"))
    n = F.size("__p")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (n > 0) & ((i == 1) | (F.get("__p", i - 1)["token"] != F.get("__p", i - 2)["token"])))
    df = df.withColumn("__s", starts)
    each = F.transform("__s", lambda a, k: F.struct(F.get("__p", a - 1)["token"].alias("token"), F.transform(F.slice("__p", a, F.coalesce(F.get("__s", k + 1), n + 1) - a), lambda x: x["pos"]).alias("positions")))
    return df.select("doc_id", "rowid", *others, F.explode(each).alias("__x")).select("__x.token", "doc_id", "rowid", "__x.positions", *others)


def write_index(chunks: DataFrame, path: str, files: int | None = None) -> None:
    """Writes what Index reads. Postings are dealt by token and document, so a token that many chunks hold fills no file alone;
    each file is sorted by token, so that of each a lookup reads the row groups of its tokens."""
    spark = chunks.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.withColumn("__dl", F.size(tokens(F.col("text")))).write.mode("overwrite").parquet(f"{path}/chunks")
    held = spark.read.parquet(f"{path}/chunks")
    _statistics(held).write.mode("overwrite").parquet(f"{path}/documents")
    own = postings(held, "__dl", "kind", "section")
    own.repartition(files, "token", "doc_id").sortWithinPartitions("token", "doc_id", "rowid").write.mode("overwrite").parquet(f"{path}/postings")


class Index:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str):
        self.chunks, self.documents, self.postings = (spark.read.parquet(f"{path}/{part}") for part in ("chunks", "documents", "postings"))

    def score(self, query: str, doc: str | None = None) -> DataFrame:
        """doc_id, rowid, kind, section, bm25, rank of the chunks that hold every phrase."""
        phrases = parse_query(query)
        wanted = self.postings.where(F.col("doc_id") == doc) if doc else self.postings
        if not phrases:
            return _none(wanted.select("doc_id", "rowid", "kind", "section"))
        exact = sorted({t for p in phrases for t in (p.tokens[:-1] if p.prefix else p.tokens)})
        tests = [F.col("token").startswith(p.tokens[-1]) for p in phrases if p.prefix] + ([F.col("token").isin(exact)] if exact else [])
        rows = wanted.where(reduce(Column.__or__, tests)).groupBy("doc_id", "rowid", "__dl", "kind", "section").agg(F.collect_list(F.struct("token", "positions")).alias("__h"))  # of a chunk the query's tokens

        def places(token: str, prefix: bool) -> Column:
            return F.flatten(F.transform(F.filter("__h", lambda x: x["token"].startswith(token) if prefix else x["token"] == token), lambda x: x["positions"]))

        for k, p in enumerate(phrases):
            last = len(p.tokens) - 1
            rows = rows.withColumns({f"__q{j}": places(t, p.prefix and j == last) for j, t in enumerate(p.tokens)})
            whole = lambda at: reduce(Column.__and__, [F.array_contains(F.col(f"__q{j}"), at + j) for j in range(1, last + 1)])
            rows = rows.withColumn(f"__f{k}", F.size(F.filter("__q0", whole)) if last else F.size("__q0")).drop(*[f"__q{j}" for j in range(last + 1)])
        return _scored(rows.drop("__h"), self.documents, len(phrases))

    def search(self, query: str, *, doc: str | None = None, kind: str | None = None, section: str | None = None, n: int = 8, every_doc: bool = True) -> DataFrame:
        """best() of the scored chunks."""
        return best(self.score(query, doc), kind=kind, section=section, n=n, every_doc=every_doc)

    def shown(self, hits: DataFrame, query: str, full: int = 0, reach: int = 4) -> DataFrame:
        """Hits (a few) with what is shown of them: file, line, page, tid, text, snippet, and full for the `full` best."""
        place = F.row_number().over(Window.orderBy(F.desc("among_best"), "rank", "doc_id", "rowid"))
        ranked = hits.select("doc_id", "rowid", "bm25", "rank", "among_best", place.alias("place"))
        near = ranked.withColumn("__row", F.explode(F.sequence("rowid", F.col("rowid") + reach)))
        texts = self.chunks.select("doc_id", F.col("rowid").alias("__row"), F.struct("rowid", "file", "line", "page", "section", "kind", "tid", "text").alias("c"))
        rows = near.join(texts, ["doc_id", "__row"]).groupBy("doc_id", "rowid", "bm25", "rank", "among_best", "place").agg(F.array_sort(F.collect_list("c")).alias("c"))  # reach + 1 rows at most
        own = rows.select("doc_id", "bm25", "rank", "among_best", "place", F.element_at("c", 1).alias("o"), F.filter(F.slice("c", 2, reach), lambda x: x["file"] == F.element_at("c", 1)["file"]).alias("__next")).select("*", "o.*").drop("o")
        whole = _whole("__next")
        return own.withColumns({"snippet": snippet(F.col("text"), query), "full": F.when(F.col("place") <= full, whole)}).drop("__next")


def best(hits: DataFrame, *, kind: str | None = None, section: str | None = None, n: int = 8, every_doc: bool = True) -> DataFrame:
    """The n best hits over all documents and, if every_doc, the best hit of each document that has none among them."""
    if kind:
        hits = hits.where(F.col("kind") == kind)
    if section:
        hits = hits.where((F.col("section") == section) | F.col("section").startswith(section + "."))
    per_doc = Window.partitionBy("doc_id").orderBy("rank", "rowid")
    first = hits.withColumn("doc_place", F.row_number().over(per_doc)).where(F.col("doc_place") <= n)
    top = first.orderBy("rank", "doc_id", "rowid").limit(n).withColumn("among_best", F.lit(True))
    if not every_doc:
        return top
    others = first.where("doc_place = 1").join(top.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("among_best", F.lit(False))
    return top.unionByName(others)


def search(chunks: DataFrame, query: str, *, doc: str | None = None, kind: str | None = None, section: str | None = None, n: int = 8, every_doc: bool = True) -> DataFrame:
    """best() of chunks scored without an index."""
    return best(score(chunks.where(F.col("doc_id") == doc) if doc else chunks, query), kind=kind, section=section, n=n, every_doc=every_doc)


def _whole(following: str, most: int = X.FULL_CHARS) -> Column:
    """A chunk on one line; a heading with the chunks `following` it, until `most` characters. The first always joins."""
    own = X.one_line(F.col("text"))
    joined = F.aggregate(following, F.struct(own.alias("t"), F.lit(0).alias("k")), lambda a, x: F.when((a["k"] > 0) & (F.length(a["t"]) >= most), a).otherwise(F.struct(F.concat(a["t"], F.lit(" | "), X.one_line(x["text"])).alias("t"), (a["k"] + 1).alias("k"))), lambda a: a["t"])
    return X.cut_at_word(F.when(F.col("kind") == "heading", joined).otherwise(own), most)


def with_following(chunks: DataFrame, reach: int = 4, most: int = X.FULL_CHARS) -> DataFrame:
    """Adds full: the chunk on one line; a heading also gets what follows it in its file, until `most` characters."""
    w = Window.partitionBy("doc_id").orderBy("rowid").rowsBetween(1, reach)
    df = chunks.withColumn("__next", F.filter(F.collect_list(F.struct("file", "text")).over(w), lambda x: x["file"] == F.col("file")))
    return df.withColumn("full", _whole("__next", most)).drop("__next")


def snippet(text: Column, query: str, most: int = 14) -> Column:
    """An excerpt of `most` words around the first word that holds a phrase's first token."""
    words = F.split(X.one_line(text), " ")
    tests = [p.tokens[0] for p in parse_query(query)] or [""]
    hit = F.array_position(F.transform(words, lambda w: reduce(Column.__or__, [folded(w).contains(t) for t in tests])), True)
    start = F.greatest(F.lit(1), hit.cast("int") - 3)
    cut = F.array_join(F.slice(words, start, most), " ")
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(F.size(words) >= start + most, "…").otherwise(""))


def format_hit(width: int = 120) -> Column:
    """doc §section p.page sections/file:line [table]  text"""
    section = F.when(F.col("section") != "", F.concat(F.lit("§"), F.col("section"))).otherwise("§?")
    tid = F.when(F.coalesce("tid", F.lit("")) != "", F.concat(F.lit(" ["), F.col("tid"), F.lit("]"))).otherwise("")
    return F.concat(F.col("doc_id"), F.lit(" "), section, F.lit(" p."), F.col("page").cast("string"), F.lit(" sections/"), F.col("file"), F.lit(":"), F.col("line").cast("string"), tid, F.lit("  "), F.substring(X.one_line(F.col("text")), 1, width))
