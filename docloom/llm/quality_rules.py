"""Quality rules: base measures of a text, then the log-likelihood ratio of hashed n-grams between a trusted target and
the raw corpus. DataFrame functions only.

Word unigrams and bigrams of every document fall into BUCKETS buckets; the raw multinomial counts all documents, the
target those that labels trust (quality 1, not toxic). A document's score is the mean over its n-grams of
log p_target - log p_raw (add-one smoothing), so length doesn't matter; it is kept if the score reaches a fixed
threshold and no base rule fails. Counting is one pass with map-side sums (a row for each bucket and task at most), and
scoring a second pass that looks weights up in one array of BUCKETS numbers.

Defined results: a null or wordless text has no words, all measures 0, score 0 and fails the base rules; labels that
name no document or are null change nothing, and repeated ones count once; with no trusted document all scores are 0;
repeated rows are judged alike (each counts in the raw corpus); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, keep, table

BUCKETS = 1 << 16
THRESHOLD = -0.1
#: Trusted ids up to this number (some 20 MB) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"


def words_column(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds __w (words), __n, __h (a 64-bit hash of each word)."""
    out = docs.withColumn("__w", words_column(F.col("text")))
    return out.withColumn("__h", F.expr("transform(__w, w -> xxhash64(w))")).withColumn("__n", F.size("__w"))


def _grams(df: DataFrame) -> DataFrame:
    """Adds __g: buckets of unigrams and bigrams."""
    b = df.withColumn("__b", F.expr("transform(__h, h -> pmod(h, 1048576L))"))
    return b.withColumn("__g", F.expr(f"concat(transform(__b, b -> cast(b % {BUCKETS} as int)), transform(slice(__b, 2, greatest(__n, 1)), (b, i) -> cast((b * 31 + element_at(__b, i + 1) * 8191) % {BUCKETS} as int)))"))


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, raw, target. docs: doc_id, text; trusted: doc_id."""
    ids = trusted.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("__t", F.lit(1))
    if trusted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    grams = _grams(_hashed(marked)).select(F.coalesce("__t", F.lit(0)).alias("t"), F.explode_outer("__g").alias("bucket"))  # outer: else the optimiser repeats the whole expression in a filter of its own
    return grams.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))


def weights(counts: DataFrame) -> Column:
    """The log ratios of all buckets as one array, read by a scalar subquery."""
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    if not target:
        return F.array_repeat(F.lit(0.0), BUCKETS)
    ratio = F.expr(f"ln((coalesce(target, 0) + 1.0D) / {float(target + BUCKETS)}D) - ln((coalesce(raw, 0) + 1.0D) / {float(raw + BUCKETS)}D)")
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", ratio.alias("w"))
    return every.agg(F.expr("transform(array_sort(collect_list(struct(bucket, w))), x -> x.w)").alias("w")).scalar()


def base_measures(df: DataFrame) -> DataFrame:
    """Adds the base columns to what _hashed() gives."""
    n = F.col("__n").cast("bigint")
    df = df.withColumn("__lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumn("__win", F.expr(f"if(__n > {WINDOW}, transform(sequence(1, __n - {WINDOW - 1}), i -> xxhash64(slice(__h, i, {WINDOW}))), cast(array() as array<bigint>))"))
    df = df.withColumn("__sorted", F.expr("if(size(array_distinct(__win)) < size(__win), array_sort(transform(__win, (h, i) -> struct(h, i))), cast(array() as array<struct<h: bigint, i: int>>))"))
    df = df.withColumn("__starts", F.expr("array_sort(transform(filter(transform(__sorted, (s, k) -> if(s.h = get(__sorted, k - 1).h or s.h = get(__sorted, k + 1).h, s.i, -1)), i -> i >= 0), i -> i))"))
    covered = F.expr(f"aggregate(__starts, struct(-{WINDOW} as last, 0L as total), (a, i) -> struct(i as last, a.total + least({WINDOW}, i - a.last) as total), a -> a.total)")
    df = df.withColumns({
        "n_words": n,
        "word_chars": F.length(F.array_join("__w", "")).cast("bigint"),
        "n_symbols": F.coalesce(F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]", "")), F.lit(0)).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": covered.cast("bigint"),
    })
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).drop("__lines", "__win", "__sorted", "__starts")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base columns, llr (per n-gram) and kept for every row of docs."""
    counts = keep(gram_counts(docs, trusted), "gram-counts")
    w = weights(counts)
    df = base_measures(_grams(_hashed(docs.select("doc_id", "text"))).withColumn("__weights", w))
    mean = F.expr("if(size(__g) = 0, 0.0D, aggregate(__g, 0.0D, (a, g) -> a + element_at(__weights, g + 1)) / size(__g))")
    df = df.withColumn("llr", F.round(mean, 9))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return judge(table(spark, sf_dir, "documents"), trusted)


#: The buckets are a 64-bit hash that SQL lacks; the tests compare with a brute-force version.
ORACLES: dict[str, str] = {}
QUERIES = {"op1_quality_rules": op1_quality_rules}
