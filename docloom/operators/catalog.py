"""The catalog of documents: freshness, upsert, status, counts, quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import verify
from docloom.operators.hierarchy import PLACEHOLDER


def stale(incoming: DataFrame, docs: DataFrame, force: bool = False, stored: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Incoming files (id, sha256, page_range) that must be converted: new, changed, of another page range, or not stored.

    stored holds the ids of documents that are stored, images those of documents with exported images; where a table isn't
    given, what it would tell isn't asked for.
    """
    if force:
        return incoming
    same = docs.select("id", "sha256", "page_range")
    for held in (stored, images):
        if held is not None:
            same = same.join(held.select("id").distinct(), "id", "left_semi")
    cond = [incoming["id"] == same["id"], incoming["sha256"] == same["sha256"], incoming["page_range"].eqNullSafe(same["page_range"])]
    return incoming.join(same, cond, "left_anti")


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    return docs.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def block_counts(blocks: DataFrame) -> DataFrame:
    """What each document's blocks are."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), kind("heading").alias("headings"), kind("table").alias("tables"), kind("picture").alias("figures"), F.count_if((F.col("kind") == "heading") & (F.col("sec") != "")).alias("numbered"), F.coalesce(F.max("page"), F.lit(0)).alias("pages"))


def build_counts(levelled: DataFrame, parts: DataFrame, registers: DataFrame, entries: DataFrame, before: DataFrame, figure_files: DataFrame | None = None) -> DataFrame:
    """What was built of each document: block_counts, and files, registers, base addresses, links, blocks of printed contents
    that went, the way levels were found, and images."""
    placeholder = F.count_if(F.col("text") == PLACEHOLDER)
    out = block_counts(levelled)
    kept = levelled.groupBy("doc_id").agg((F.count(F.lit(1)) - placeholder).alias("__kept"), F.max("strategy").alias("levels"))
    had = before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__had"))
    files = parts.groupBy("doc_id").agg(F.countDistinct("part_ix").alias("sections"))
    regs = registers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("registers"), F.count_if("linked").alias("registers_linked"))
    maps = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("memmap"))
    for more in (kept, had, files, regs, maps):
        out = out.join(more, "doc_id", "left")
    if figure_files is not None:
        out = out.join(figure_files.groupBy("doc_id").agg(F.count(F.lit(1)).alias("figure_files")), "doc_id", "left")
    else:
        out = out.withColumn("figure_files", F.lit(0))
    out = out.withColumn("toc_blocks_dropped", F.col("__had") - F.col("__kept")).drop("__had", "__kept")
    return out.fillna(0, ["registers", "registers_linked", "memmap", "sections", "figure_files"])


def low_pages(grades: DataFrame) -> DataFrame:
    """Pages graded poor or fair, in order."""
    low = F.collect_list(F.when(F.lower("grade").isin("poor", "fair"), F.col("page")))
    return grades.groupBy("doc_id").agg(F.sort_array(low).alias("low_pages"))


def strict_gate(summary: DataFrame, low: DataFrame) -> DataFrame:
    """Whether a document passes: no mismatch and no low page."""
    df = summary.join(low, "doc_id", "left")
    return df.select("doc_id", ((F.col("mismatch") == 0) & (F.col("memmap_mismatch") == 0) & (F.coalesce(F.size("low_pages"), F.lit(0)) <= 0)).alias("passed"))


def qa_report(regs: DataFrame, entries: DataFrame, most_regs: int = 200, most_entries: int = 100) -> DataFrame:
    """The mismatches to look at, registers first."""
    shown = verify.mismatches(regs, entries).withColumn("missing", F.array_join("missing", ", "))
    one = lambda what, most: shown.where(F.col("what") == what).orderBy("doc_id", "name").limit(most)
    return one("register", most_regs).unionByName(one("memmap", most_entries))


def qa_head(docs: DataFrame) -> DataFrame:
    """id, ix, line: what stands above the mismatches in a document's quality report."""
    got = lambda m, k, other="?": F.coalesce(F.try_element_at(m, F.lit(k)).cast("string"), F.lit(other))
    low = F.size(F.coalesce("low_pages", F.array().cast("array<int>")))
    lines = F.array(
        F.concat(F.lit("# QA — "), "id"),
        F.concat(F.lit("Confidence: mean="), got(F.col("grades"), "mean"), F.lit(" low="), got(F.col("grades"), "low")),
        F.when(low > 0, F.concat(F.lit("Pages with low confidence ("), low.cast("string"), F.lit("): "), F.array_join(F.col("low_pages").cast("array<string>"), ", "))),
        F.when(F.size("verify") > 0, F.concat(F.lit("Registers: ok="), got(F.col("verify"), "ok", "0"), F.lit(" mismatch="), got(F.col("verify"), "mismatch", "0"), F.lit(" unchecked="), got(F.col("verify"), "unchecked", "0"), F.lit("; field resets checked: "), got(F.col("verify"), "field_resets_checked", "0"))),
        F.when(F.coalesce(F.try_element_at("verify", F.lit("memmap_ok")), F.lit(0)) + F.coalesce(F.try_element_at("verify", F.lit("memmap_mismatch")), F.lit(0)) > 0, F.concat(F.lit("Base addresses: ok="), got(F.col("verify"), "memmap_ok", "0"), F.lit(" mismatch="), got(F.col("verify"), "memmap_mismatch", "0"))),
    )
    return docs.select("id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("ix", "line"))


def status_lines(docs: DataFrame) -> DataFrame:
    """id, line: title, pages, what was built and how it was verified, of catalog entries."""
    n = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)).cast("string"), F.lit("0"))
    counts, verified = F.col("counts"), F.col("verify")
    pages = F.when(F.size("page_range") == 2, F.concat(F.lit(" (pages "), F.element_at("page_range", 1).cast("string"), F.lit("-"), F.element_at("page_range", 2).cast("string"), F.lit(" of the source)"))).otherwise("")
    figures = F.when(n(counts, "figures") != "0", F.concat(F.lit(", "), n(counts, "figures"), F.lit(" figures ("), n(counts, "figure_files"), F.lit(" png)"))).otherwise("")
    checks = F.when(F.size(verified) > 0, F.concat(F.lit(" verify ok="), n(verified, "ok"), F.lit(" mismatch="), n(verified, "mismatch"))).otherwise("")
    maps = F.when((n(verified, "memmap_ok") != "0") | (n(verified, "memmap_mismatch") != "0"), F.concat(F.lit(", memmap ok="), n(verified, "memmap_ok"), F.lit(" mismatch="), n(verified, "memmap_mismatch"))).otherwise("")
    grade = lambda k: F.coalesce(F.try_element_at("grades", F.lit(k)), F.lit("?"))
    return docs.select("id", F.concat(
        "id", F.lit(" ["), "kind", F.lit(']: "'), "title", F.lit('" '), F.col("pages").cast("string"), F.lit("p"), pages, F.lit(", "), n(counts, "sections"), F.lit(" section files, "), n(counts, "headings"), F.lit(" headings, "), n(counts, "tables"), F.lit(" tables"), figures,
        F.lit(", "), n(counts, "registers"), F.lit(" registers, "), n(counts, "memmap"), F.lit(" base addresses; confidence mean="), grade("mean"), F.lit(" low="), grade("low"), F.lit(" low_pages="), F.size("low_pages").cast("string"), F.lit(";"), checks, maps,
    ).alias("line"))
