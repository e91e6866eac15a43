"""Verification of extracted values against page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X

#: Limits of a check, and resets that say nothing.
MOST_PAGES, REACH, MOST_SPOTS = 12, 1500, 40
TRIVIAL = ["-", "", "0", "1", "x", "n/a", "na", "undefined", "u"]


def span_text(rows: DataFrame, page_text: DataFrame) -> DataFrame:
    """rows with text: the squeezed pages from page to one after page_end, MOST_PAGES on at most, joined in order.

    Many rows lie on the same pages: each span of pages is put together once.
    """
    last = F.least(F.greatest(F.coalesce("page_end", "page"), "page") + 1, F.col("page") + MOST_PAGES)
    # a number of its own: checking a row costs far more than its bytes say, and small partitions would be merged by them
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spanned = rows.withColumn("__last", last).repartition(parts, "doc_id", "page", "__last")
    spans = spanned.where("coalesce(page, 0) > 0").select("doc_id", F.col("page").alias("__first"), "__last").distinct()
    pages = spans.withColumn("page", F.explode(F.sequence("__first", "__last")))
    texts = page_text.select("doc_id", "page", X.squeezed(F.col("text")).alias("t"))
    joined = pages.join(texts, ["doc_id", "page"]).groupBy("doc_id", "__first", "__last").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "").alias("text"))
    return spanned.join(joined.withColumnRenamed("__first", "page"), ["doc_id", "page", "__last"], "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("__last")


def has(text: Column, value: Column) -> Column:
    return F.exists(X.hex_variants(value), lambda v: text.contains(v))


def _after(text: Column, what: Column) -> Column:
    """What stands from each of the first MOST_SPOTS places on where `what` occurs, REACH characters of it."""
    between = F.split(text, F.concat(F.lit(r"\Q"), what, F.lit(r"\E")), MOST_SPOTS + 1)  # the last piece is all the rest
    step = lambda s, p: F.struct((s["next"] + F.length(p) + F.length(what)).alias("next"), F.concat(s["spots"], F.array(s["next"] + F.length(p))).alias("spots"))
    spots = F.aggregate(between, F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("spots")), step, lambda s: F.slice(s["spots"], 1, F.size(s["spots"]) - 1))
    return F.transform(spots, lambda p: F.substr(text, p, F.lit(REACH)))


def missing(text: Column) -> Column:
    """What of a register (name, offset, reset, derived, fields) its text doesn't confirm, in order."""
    one = lambda bad, label: F.when(bad, F.array(label if isinstance(label, Column) else F.lit(label))).otherwise(F.array().cast("array<string>"))
    printed = ~F.coalesce("derived", F.lit(False))
    parts = [
        one(printed & ~text.contains(X.squeezed(F.col("name"))), "name"),
        one(printed & F.col("offset").isNotNull() & ~has(text, F.col("offset")), "offset"),
        one(F.col("reset").isNotNull() & ~has(text, F.col("reset")), "reset"),
    ]

    def field(f: Column) -> Column:
        name, reset = X.squeezed(f["name"]), F.trim(F.coalesce(f["reset"], F.lit("")))
        defined = F.concat(name, F.lit(":"))
        spots = F.when(text.contains(defined), _after(text, defined)).otherwise(_after(text, name))
        printed_as = F.when(F.lower(reset).startswith("0x"), X.hex_variants(reset)).otherwise(F.array(X.squeezed(reset)))
        # worked out once for all spots
        seen = F.element_at(F.transform(F.array(printed_as), lambda ways: F.exists(spots, lambda t: F.exists(ways, lambda v: t.contains(v)))), 1)
        return F.when((F.coalesce(f["name"], F.lit("")) == "") | (f["name"] == "Reserved"), F.lit(None).cast("string")).when(~text.contains(name), F.concat(F.lit("field:"), f["name"])).when(~F.lower(reset).isin(TRIVIAL) & ~seen, F.concat(F.lit("field_reset:"), f["name"], F.lit("="), reset))

    bad = F.filter(F.transform(F.coalesce("fields", F.array().cast("array<struct<bits:string,name:string,desc:string,access:string,reset:string>>")), field), lambda x: x.isNotNull())
    return F.concat(*parts, bad)


def registers(regs: DataFrame, page_text: DataFrame) -> DataFrame:
    """regs with verify (ok, mismatch, unchecked), verify_missing (ten at most) and resets_checked."""
    df = span_text(regs, page_text).withColumn("__m", missing(F.col("text")))
    paged = F.coalesce("page", F.lit(0)) > 0
    checked = F.size(F.filter("fields", lambda f: ~F.lower(F.trim(F.coalesce(f["reset"], F.lit("")))).isin(TRIVIAL)))
    return df.withColumns({
        "verify": F.when(~paged, "unchecked").when(F.size("__m") > 0, "mismatch").otherwise("ok"),
        "verify_missing": F.when(paged, F.slice("__m", 1, 10)).otherwise(F.array().cast("array<string>")),
        "resets_checked": F.when(paged, F.greatest(F.coalesce(checked, F.lit(0)), F.lit(0))).otherwise(0),
    }).drop("__m", "text")


def memmap(entries: DataFrame, page_text: DataFrame) -> DataFrame:
    """entries with verify and verify_missing: base and end must stand on the page or the next."""
    df = span_text(entries.withColumn("page_end", F.col("page")), page_text)
    text = F.col("text")
    bad = F.filter(F.array(F.when(~has(text, F.col("base")), "base"), F.when(F.col("end").isNotNull() & ~has(text, F.coalesce("end", F.lit(""))), "end")), lambda x: x.isNotNull())
    return df.withColumn("verify_missing", bad).withColumn("verify", F.when(F.size("verify_missing") > 0, "mismatch").otherwise("ok")).drop("text", "page_end")


def summary(regs: DataFrame, entries: DataFrame) -> DataFrame:
    """Counts for each document."""
    r = regs.groupBy("doc_id").agg(F.count_if(F.col("verify") == "ok").alias("ok"), F.count_if(F.col("verify") == "mismatch").alias("mismatch"), F.count_if(F.col("verify") == "unchecked").alias("unchecked"), F.sum("resets_checked").cast("bigint").alias("field_resets_checked"))
    m = entries.groupBy("doc_id").agg(F.count_if(F.col("verify") == "ok").alias("memmap_ok"), F.count_if(F.col("verify") == "mismatch").alias("memmap_mismatch"))
    out = r.join(m, "doc_id", "full")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("ok", "mismatch", "unchecked", "field_resets_checked", "memmap_ok", "memmap_mismatch")])


def mismatches(regs: DataFrame, entries: DataFrame, shown: int = 6) -> DataFrame:
    """What wasn't confirmed, a row for each: registers with their first `shown` points, then memory-map entries."""
    a = regs.where("verify = 'mismatch'").select("doc_id", F.lit("register").alias("what"), "name", "page", F.slice("verify_missing", 1, shown).alias("missing"))
    b = entries.where("verify = 'mismatch'").select("doc_id", F.lit("memmap").alias("what"), "name", "page", F.col("verify_missing").alias("missing"))
    return a.unionByName(b)
