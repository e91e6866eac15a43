"""The command surface: one function for each, giving a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import catalog, hierarchy, link, memmap, registers, search, verify


def pick(df: DataFrame, doc: str | None) -> DataFrame:
    """Rows of one document, or of all; an unknown document is an error that lists what there is."""
    if doc is None:
        return df
    own = df.where(F.col("doc_id") == doc)
    if own.isEmpty():
        known = [r[0] for r in df.select("doc_id").distinct().orderBy("doc_id").limit(20).collect()]
        raise ValueError(f"unknown document {doc}; available: {', '.join(known)}")
    return own


def build(blocks: DataFrame, figure_files: DataFrame | None = None) -> dict[str, DataFrame]:
    """All derived tables of a block stream. figure_files: doc_id, table_id of pictures whose image is stored."""
    adopted = hierarchy.adopt_captions(blocks)
    clean = hierarchy.drop_toc(adopted)
    clean = clean.withColumn("block_ix", F.col("block_ix") * 2 + F.col("part")).drop("part")
    levelled = hierarchy.normalize_levels(clean)
    parts = hierarchy.line_numbers(hierarchy.split_parts(levelled))
    where = parts.select("doc_id", "block_ix", hierarchy.file_name(parts).alias("file"), "line")
    headings = parts.where("kind = 'heading'").select("doc_id", "block_ix", "sec", "title", "level", "page", hierarchy.file_name(parts).alias("file"), "line")
    entries = memmap.merge(memmap.entries(levelled))
    # a name may stand in more than one place of a document: its block and itself tell registers apart
    regs = registers.extract(levelled).withColumn("rid", F.concat_ws(":", "block_ix", "name"))
    linked = link.link(regs, entries).join(where, ["doc_id", "block_ix"], "left")
    counts = catalog.build_counts(levelled, parts, linked, entries, adopted, figure_files)
    return {"blocks": parts, "headings": headings, "chunks": hierarchy.chunks(parts), "registers": linked, "memmap": entries, "tables": hierarchy.table_ids(levelled), "counts": counts}


def rebuild(docs: DataFrame, stored: DataFrame, page_text: DataFrame, doc: str | None = None, title: str | None = None, kind: str | None = None) -> dict[str, DataFrame]:
    """Documents (doc_id, json) built again from what is stored, and their catalog entries brought up to date.

    docs holds the catalog; an entry keeps its title and kind unless others are given, and gets new counts and verification.
    """
    from docloom.sources import readers, shared

    picked = stored.where(F.col("doc_id") == doc) if doc else stored
    blocks = shared.written(readers.blocks(picked.join(pick(docs.withColumnRenamed("id", "doc_id"), doc).select("doc_id"), "doc_id", "left_semi")), "blocks")
    pack = build(blocks)
    regs, entries = shared.written(verify.registers(pack["registers"], page_text), "registers"), shared.written(verify.memmap(pack["memmap"], page_text), "memmap")
    pack |= {"registers": regs, "memmap": entries, "mismatches": verify.mismatches(regs, entries)}
    auto = blocks.where("kind = 'heading'").groupBy("doc_id").agg(F.min_by("title", "block_ix").alias("__title"))
    fresh = pack["counts"].join(auto, "doc_id", "left").join(verify.summary(regs, entries), "doc_id", "left")
    old = pick(docs.withColumnRenamed("id", "doc_id"), doc)
    own = old.join(fresh.select("doc_id", "__title", F.struct(*[c for c in fresh.columns if c not in ("doc_id", "__title")]).alias("__new")), "doc_id")
    counted, verified = [c for c in pack["counts"].columns if c != "doc_id"], [c for c in fresh.columns if c not in pack["counts"].columns and c != "__title"]
    as_map = lambda names, kind: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.coalesce(F.col(f"__new.{c}").cast(kind), F.lit(0).cast(kind)) for c in names]))
    pack["docs"] = own.withColumns({
        "title": F.lit(title) if title else F.when(F.coalesce("title", F.lit("")) == "", F.col("__title")).otherwise(F.col("title")),
        "kind": F.lit(kind) if kind else F.col("kind"), "counts": as_map(counted, "string"), "verify": as_map(verified, "int"),
    }).withColumnRenamed("doc_id", "id").select(*docs.columns)
    return pack


def reg(pack: dict[str, DataFrame], name: str, doc: str | None = None, n: int = 20) -> DataFrame:
    return registers.lookup(pick(pack["registers"], doc), name, n)


def with_errata(hits: DataFrame, errata_chunks: DataFrame, name: str, n: int = 3) -> DataFrame:
    """Exact register hits, each with the n best notes on it in errata documents."""
    notes = search.search(errata_chunks, name, n=n, every_doc=False).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "page", "text"))), lambda x: x["text"]).alias("errata"))
    return hits.where("tier = 0").withColumn("errata", notes.scalar())


def section_lines(parts: DataFrame, headings: DataFrame, doc: str, sec: str, lines: int = 80, offset: int = 0) -> DataFrame:
    """line, text of a section's file from `offset` lines after its heading on, `lines` of them at most; more tells how many are left.

    parts are blocks with file parts and lines (build's blocks).
    """
    head = hierarchy.find_section(hierarchy.section_extent(pick(headings, doc)), sec).select("doc_id", "file", F.col("line").alias("first"), F.col("line_end").alias("last"))
    own = pick(parts, doc).withColumn("file", hierarchy.file_name(parts))
    starts = hierarchy.markdown_lines(own).join(own.select("doc_id", "block_ix", "file"), ["doc_id", "block_ix"])
    w = Window.partitionBy("doc_id", "file").orderBy("block_ix")
    each = starts.withColumn("t", F.split("md", "\n")).withColumn("__at", F.coalesce(F.sum(F.size("t")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + hierarchy.FRONT_LINES + 1)
    rows = each.select("doc_id", "file", "__at", F.posexplode("t").alias("k", "text")).select("doc_id", "file", (F.col("__at") + F.col("k")).cast("int").alias("line"), "text")
    inside = rows.join(F.broadcast(head), ["doc_id", "file"]).where((F.col("line") >= F.col("first") + offset) & (F.col("last").isNull() | (F.col("line") <= F.col("last"))))  # one row, as the document is given
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return inside.withColumn("more", F.greatest(total - lines, F.lit(0))).where(F.col("line") < F.col("first") + offset + lines).select("doc_id", "file", "line", "text", "more")


def section(pack: dict[str, DataFrame], doc: str, sec: str, lines: int = 80, offset: int = 0) -> DataFrame:
    """Chunks of a section, from `offset` lines on, `lines` of them at most."""
    head = hierarchy.find_section(hierarchy.section_extent(pick(pack["headings"], doc)), sec).select("doc_id", "file", F.col("line").alias("first"), F.col("line_end").alias("last"))
    df = pack["chunks"].join(F.broadcast(head), ["doc_id", "file"])  # one row, as the document is given
    from_line = F.col("first") + offset
    return df.where((F.col("line") >= from_line) & (F.col("line") < from_line + lines) & (F.col("last").isNull() | (F.col("line") <= F.col("last")))).drop("first", "last")


def toc(pack: dict[str, DataFrame], doc: str, sec: str | None = None, depth: int = 2) -> DataFrame:
    return hierarchy.toc(pick(pack["headings"], doc), sec, depth)


def tables(pack: dict[str, DataFrame], doc: str, n: int = 80) -> DataFrame:
    """The tables of a document, n at most."""
    return pick(pack["tables"], doc).orderBy("tid").limit(n)


def table(pack: dict[str, DataFrame], doc: str, tid: str, cells: bool = False) -> DataFrame:
    own = pick(pack["blocks"], doc).where((F.col("kind") == "table") & (F.col("table_id") == tid))
    return own.select("doc_id", "table_id", F.inline("cells")) if cells else own.select("doc_id", "table_id", F.posexplode("grid").alias("row", "cells"))


def map_(pack: dict[str, DataFrame], name: str | None = None, doc: str | None = None, n: int = 60) -> DataFrame:
    return memmap.lookup(pick(pack["memmap"], doc), name, n)


def figure(pack: dict[str, DataFrame], doc: str, fid: str | None = None, n: int = 80) -> DataFrame:
    own = pick(pack["blocks"], doc).where("kind = 'picture'")
    own = own.where(F.col("table_id") == fid) if fid else own
    return own.select("doc_id", F.col("table_id").alias("fid"), "page", "title", F.try_element_at(F.flatten("grid"), F.lit(1)).alias("labels")).orderBy("fid").limit(n)


def check(pack: dict[str, DataFrame], page_text: DataFrame, doc: str | None = None) -> DataFrame:
    regs = verify.registers(pick(pack["registers"], doc), page_text)
    return verify.summary(regs, verify.memmap(pick(pack["memmap"], doc), page_text))


def status(docs: DataFrame) -> DataFrame:
    """A line for each document of the catalog, in order."""
    return catalog.status_lines(docs).orderBy("id")


def first_registers(regs: DataFrame) -> DataFrame:
    """Of registers with one name in a document the first."""
    w = Window.partitionBy("doc_id", "name").orderBy("block_ix")
    return regs.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
