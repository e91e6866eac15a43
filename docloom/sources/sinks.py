"""Writers. Every writer replaces what it wrote before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import hierarchy, search
from docloom.sources import readers


def _joined(ix: str) -> Column:
    """The md of a group in the order of ix, each with a line end."""
    lines = F.sort_array(F.collect_list(F.struct(ix, F.coalesce("md", F.lit("")).alias("md"))))["md"]
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def _files(files: DataFrame, path: str, packed: bool) -> None:
    """doc_id, file, text: a folder for each document and in it its files; packed, a row for each file (readers.files), as
    stores and listings don't bear millions of small ones."""
    if packed:
        files.select("doc_id", "file", "text").write.mode("overwrite").parquet(path)
    else:
        files.select("doc_id", "file", F.regexp_replace("text", "\n\\z", "").alias("value")).write.mode("overwrite").partitionBy("doc_id", "file").text(path)


def section_markdown(parts: DataFrame, path: str, source: str = "", packed: bool = False) -> None:
    """Files named by part (split_parts), with the lines that every file begins with; chunks and headings cite their lines."""
    page = F.when(F.col("page") != 0, F.col("page"))
    body = hierarchy.markdown_lines(parts, "page", "part_title", hierarchy.file_name(parts).alias("file"))
    whole = body.groupBy("doc_id", "part_ix").agg(F.first("file").alias("file"), F.first("part_title").alias("title"), F.coalesce(F.min(page), F.lit(0)).alias("a"), F.coalesce(F.max(page), F.lit(0)).alias("z"), _joined("block_ix").alias("body"))
    _files(whole.select("doc_id", "file", F.concat(hierarchy.front_lines(F.col("title"), F.col("a"), F.col("z"), F.lit(source)), "body").alias("text")), path, packed)


def index(parts: DataFrame, headings: DataFrame, path: str, depth: int = 2, packed: bool = False) -> None:
    """For each document a head, and for each part a line with its file, title and pages and the headings of the least levels."""
    page = F.when(F.col("page") != 0, F.col("page"))
    by_part = parts.groupBy("doc_id", "part_ix").agg(F.first(hierarchy.file_name(parts)).alias("file"), F.first("part_title").alias("title"), F.min_by(F.when(F.col("kind") == "heading", F.col("sec")), "block_ix").alias("sec"), F.coalesce(F.min(page), F.lit(0)).alias("a"), F.coalesce(F.max(page), F.lit(0)).alias("z"), F.min("block_ix").alias("first"))
    label = lambda sec, title: F.when(F.coalesce(sec, F.lit("")) != "", F.concat(F.lit("§"), sec, F.lit(" "), title)).otherwise(title)
    span = F.concat(F.lit("  p."), F.col("a").cast("string"), F.lit("-"), F.col("z").cast("string"))
    heads = by_part.select("doc_id", (F.col("first") * 2).alias("ix"), F.concat(F.lit("## sections/"), "file", F.lit("  "), label(F.col("sec"), F.col("title")), span).alias("md"))
    top = parts.groupBy("doc_id").agg(F.countDistinct("part_ix").alias("n"), F.coalesce(F.max("page"), F.lit(0)).alias("pages")).select("doc_id", F.lit(-1).cast("bigint").alias("ix"), F.concat(F.lit("# "), "doc_id", F.lit(" — INDEX\n"), F.col("pages").cast("string"), F.lit(" pages · "), F.col("n").cast("string"), F.lit(" section files\n")).alias("md"))
    inside = hierarchy.index_headings(headings, depth).join(by_part.select("doc_id", "file", "first"), ["doc_id", "file"]).where("block_ix <> first")  # a part's own heading stands in its line
    lines = inside.select("doc_id", (F.col("block_ix") * 2 + 1).alias("ix"), F.concat(F.lit("- "), label(F.col("sec"), F.col("title")), F.lit("  p."), F.col("page").cast("string")).alias("md"))
    _files(top.unionByName(heads).unionByName(lines).groupBy("doc_id", F.lit("INDEX.md").alias("file")).agg(_joined("ix").alias("text")), path, packed)


def tables(blocks: DataFrame, path: str, packed: bool = False) -> None:
    """index (TSV), grids (CSV, a file for each table), rows (JSON, a row for each grid row) and cells (JSON) of tables."""
    own = blocks.where("kind = 'table'")
    sections = hierarchy.section_path(blocks, "s2").select("doc_id", "block_ix", "section")
    listed = hierarchy.table_ids(blocks).join(sections, ["doc_id", "block_ix"]).select("doc_id", F.col("tid").alias("id"), "page", "section", F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols"), F.col("spans").cast("int").alias("spans"), "caption")
    listed.write.mode("overwrite").csv(f"{path}/index", sep="\t", header=True)
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    lines = F.transform("grid", lambda r: F.array_join(F.transform(r, cell), ","))
    grids = own.where(F.size("grid") > 0).select("doc_id", F.concat("table_id", F.lit(".csv")).alias("file"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
    _files(grids, f"{path}/grids", packed)
    own.select("doc_id", "table_id", F.posexplode("grid").alias("row", "cells")).write.mode("overwrite").json(f"{path}/rows")
    own.where("cells IS NOT NULL").select("doc_id", "table_id", F.inline("cells")).write.mode("overwrite").json(f"{path}/cells")


def figures(blocks: DataFrame, path: str, files: DataFrame | None = None, packed: bool = False) -> None:
    """For each document the pictures as tab-parted lines under a head. files: doc_id, table_id of pictures with an image."""
    labels = F.substring(F.coalesce(F.try_element_at(F.flatten("grid"), F.lit(1)), F.lit("")), 1, 300)
    own = hierarchy.section_path(blocks, "s2").where("kind = 'picture'")
    image = F.lit("")
    if files is not None:
        own = own.join(files.select("doc_id", "table_id", F.lit(True).alias("__has")), ["doc_id", "table_id"], "left")
        image = F.when(F.col("__has"), F.concat(F.lit("figures/"), "table_id", F.lit(".png"))).otherwise("")
    cells = [X.one_line(c) for c in (F.col("table_id"), F.col("page").cast("string"), F.col("section"), image, F.col("title"), labels)]
    lines = own.select("doc_id", "block_ix", F.concat_ws("\t", *cells).alias("md")).groupBy("doc_id").agg(_joined("block_ix").alias("lines"))
    _files(lines.select("doc_id", F.lit("index.tsv").alias("file"), F.concat(F.lit(readers.FIGURE_HEAD + "\n"), "lines").alias("text")), path, packed)


def records(df: DataFrame, path: str) -> None:
    """Registers or memory-map entries as JSON lines; null keys are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def manifest(entries: DataFrame, path: str) -> None:
    """Catalog entries as JSON, one for each document, in files that readers.catalog reads."""
    entries.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def search_index(chunks: DataFrame, path: str, files: int | None = None) -> None:
    """The inverted index (search.Index reads it): postings sorted by token, statistics of documents, and chunks by key."""
    search.write_index(chunks, path, files)


def whole_document(blocks: DataFrame, path: str, packed: bool = False) -> None:
    """Each document as one markdown text."""
    lines = hierarchy.markdown_lines(blocks.withColumn("part_ix", F.lit(0)))
    _files(lines.groupBy("doc_id").agg(F.lit("document.md").alias("file"), _joined("block_ix").alias("text")), path, packed)


def results_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')
