"""Hints on registers that a prompt names, and the guard on file reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a register-like token is, words that are none, and limits.
TOKEN = r"\b([A-Z][A-Z0-9]{1,}(?:_[A-Z0-9]+)*)\b"
STOP = "TODO NOTE README JSON HTTP HTTPS API PDF USB CPU GPU RAM ROM SDK IDE MCU HAL ISR IRQ DMA OK ID IO UI OS PR CI".split()
MOST_TOKENS, MOST_HINTS, LARGE_SECTION, LARGE_FILE = 40, 5, 60_000, 2_000_000
INTERNAL = ("docling.json", "docling.json.gz", "search.sqlite")


def prompt_tokens(prompt: Column) -> Column:
    """Register-like tokens of a prompt, first seen first."""
    every = F.array_distinct(F.regexp_extract_all(prompt, F.lit(TOKEN), 1))
    return F.slice(F.filter(every, lambda t: ~t.isin(STOP) & (t.contains("_") | t.rlike("[0-9]") | (F.length(t) >= 4))), 1, MOST_TOKENS)


def hints(prompts: DataFrame, registers: DataFrame) -> DataFrame:
    """prompt_id, hints (five at most), more: for each prompt that names a register or a peripheral."""
    asked = prompts.select("prompt_id", F.posexplode(prompt_tokens(F.col("prompt"))).alias("k", "token"))
    regs = registers.groupBy("doc_id", "name").agg(F.min_by(F.struct("peripheral", "offset", "section", "page"), "block_ix").alias("r")).where("instr(name, '_') > 0 OR length(name) >= 5")
    offset = F.when(F.col("r.offset").isNotNull(), F.concat(F.lit(" offset "), F.col("r.offset"))).otherwise("")
    line = F.concat(F.col("name"), F.lit(" ("), F.col("r.peripheral"), offset, F.lit(") is documented in ["), F.col("doc_id"), F.lit(" §"), F.col("r.section"), F.lit(" p."), F.col("r.page").cast("string"), F.lit("]"))
    by_name = asked.join(regs.select("doc_id", "name", line.alias("hint")), F.col("token") == F.col("name")).select("prompt_id", F.lit(0).alias("tier"), F.col("doc_id").alias("a"), F.col("name").alias("b"), "hint")
    docs = registers.select("peripheral", "doc_id").distinct().groupBy("peripheral").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ", ").alias("docs"))
    by_peripheral = asked.join(docs, F.col("token") == F.col("peripheral")).select("prompt_id", F.lit(1).alias("tier"), F.lit("").alias("a"), F.col("peripheral").alias("b"), F.concat(F.lit("peripheral "), F.col("peripheral"), F.lit(" has registers in document set "), F.col("docs")).alias("hint"))
    shown = by_name.select("prompt_id", "b").distinct()
    by_peripheral = by_peripheral.join(shown, ["prompt_id", "b"], "left_anti")
    every = by_name.unionByName(by_peripheral).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("tier", "a", "b", "hint"))).alias("h"))
    return every.select("prompt_id", F.array_join(F.transform(F.slice("h", 1, MOST_HINTS), lambda x: x["hint"]), "; ").alias("hints"), F.greatest(F.size("h") - MOST_HINTS, F.lit(0)).alias("more"))


def read_guard(events: DataFrame) -> DataFrame:
    """events (tool, path, size, has_limit) with decision and reason."""
    low = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    inside = low.contains("/.docstore/")
    internal = inside & (low.endswith(INTERNAL[0]) | low.endswith(INTERNAL[1]) | low.endswith(INTERNAL[2]))
    large = inside & low.endswith(".md") & low.contains("/sections/") & ~F.col("has_limit") & (F.col("size") > LARGE_SECTION)
    reason = (
        F.when((F.col("tool") != "Read") | (F.coalesce("path", F.lit("")) == ""), F.lit(None).cast("string"))
        .when(low.endswith(".pdf"), "pdf").when(internal, "internal file").when(large, "large section")
        .when((F.col("size") > LARGE_FILE) & ~F.col("has_limit"), "large file")
    )
    return events.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "pass").otherwise("deny"))


def announce(docs: DataFrame) -> DataFrame:
    """id, line: what a session can look up, a line for each document of the catalog (empty without one)."""
    n = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)).cast("string"), F.lit("0"))
    figures = F.when(n("figures") != "0", F.concat(F.lit(", "), n("figures"), F.lit(" figures"))).otherwise("")
    return docs.select("id", F.concat("id", F.lit(" ["), F.coalesce("kind", F.lit("manual")), F.lit(']: "'), F.coalesce("title", F.lit("")), F.lit('" '), F.coalesce("pages", F.lit(0)).cast("string"), F.lit("p, "), n("registers"), F.lit(" registers, "), n("tables"), F.lit(" tables"), figures).alias("line"))
