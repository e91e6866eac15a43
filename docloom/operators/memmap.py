"""Memory maps: base addresses from sentences and tables, first-wins merging, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.hierarchy import section_path

#: How sentences name bases, and headers and words of address tables.
HEX = r"0x[0-9A-Fa-f]{1,16}(?:[ _][0-9A-Fa-f]{4})?"
SENTENCE = rf"(?Us)(?:The\s+)?([\w\-+/ ]{{1,80}}?)\s+registers?\s+(?:start|starts|are located|is located|begin)\s+at\s+(?:a\s+)?base\s+address(?:es)?\s+of\s+({HEX}(?:\s*(?:,|and)\s*{HEX})*)(?:\s+respectively)?(?:\s*\(defined\s+as\s+([A-Z][A-Z0-9_]*(?:\s*(?:,|and)\s*[A-Z][A-Z0-9_]*)*)\s+in\s+SDK\))?"
ADDRESS_HEADERS = ["boundary address", "base address", "start address", "address range", "address", "base"]
NAME_HEADERS = ["peripheral", "peripherals", "name", "module", "block", "instance"]
RESERVED = ["reserved", "-", ""]
ID = r"^[A-Z][A-Z0-9_]*$"


def _ids(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s*(?:,|\band\b)\s*"), lambda p: p != "")


def from_sentences(blocks: DataFrame) -> DataFrame:
    """Entries of all base-address sentences. blocks: with section."""
    df = blocks.where(F.col("kind").isin("text", "list") & F.col("text").rlike(SENTENCE))
    groups = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(SENTENCE), k).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))])
    df = df.select("doc_id", "block_ix", "page", "section", F.posexplode(groups).alias("m", "g"))
    df = df.select("doc_id", "block_ix", "page", "section", "m", X.one_line(F.col("g").getField("a")).alias("desc"), F.regexp_extract_all(F.col("g").getField("b"), F.lit(f"({HEX})"), 1).alias("addrs"), _ids(F.coalesce(F.col("g").getField("c"), F.lit(""))).alias("defs"))
    listed = F.filter(_ids(F.replace("desc", F.lit(" and "), F.lit(","))), lambda c: c.rlike(ID))
    last = F.element_at(F.split("desc", " "), -1)
    n = F.size("addrs")
    names = (
        F.when((F.size("defs") > 0) & (F.size("defs") == n), F.transform("defs", lambda d: F.regexp_replace(d, "_BASE$", "")))
        .when(F.size(listed) == n, listed)
        .when((n == 1) & last.rlike(ID), F.array(last))
    )
    df = df.withColumn("names", names).where("names IS NOT NULL")
    df = df.select("*", F.posexplode(F.arrays_zip(F.col("names").alias("name"), F.col("addrs").alias("addr"))).alias("k", "e"))
    return df.select("doc_id", "block_ix", "m", "k", F.col("e.name").alias("name"), X.hex_padded(F.col("e.addr")).alias("base"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("bus"), "page", "section", F.lit("text").alias("source"), "desc")


def _cell(row: Column, k: Column) -> Column:
    return F.trim(F.coalesce(F.try_element_at(row, k), F.lit("")))


def is_define_table(grid: Column) -> Column:
    """All rows have two cells, and at least half are NAME_BASE and a hex number."""
    named = F.size(F.filter(grid, lambda r: _cell(r, F.lit(1)).rlike(r"^[A-Z][A-Z0-9_]*_BASE$") & _cell(r, F.lit(2)).rlike(f"^{HEX}$")))
    return F.coalesce((F.size(grid) > 0) & F.forall(grid, lambda r: F.size(r) >= 2) & (named > 0) & (named >= F.floor(F.size(grid) / 2)), F.lit(False))


def from_define_tables(blocks: DataFrame) -> DataFrame:
    df = blocks.where((F.col("kind") == "table") & is_define_table(F.col("grid"))).select("doc_id", "block_ix", "page", "section", F.posexplode("grid").alias("k", "r"))
    df = df.where(_cell(F.col("r"), F.lit(1)).rlike(r"^[A-Z][A-Z0-9_]*_BASE$") & _cell(F.col("r"), F.lit(2)).rlike(f"^{HEX}$"))
    none = F.lit(None).cast("string")
    return df.select("doc_id", "block_ix", F.lit(0).alias("m"), "k", F.regexp_replace(_cell(F.col("r"), F.lit(1)), "_BASE$", "").alias("name"), X.hex_padded(_cell(F.col("r"), F.lit(2))).alias("base"), none.alias("end"), none.alias("bus"), "page", "section", F.lit("table").alias("source"), none.alias("desc"))


def from_boundary_tables(blocks: DataFrame) -> DataFrame:
    """Rows under a header, within the first two rows, with an address-like and a name-like column."""

    def low(row: Column) -> Column:
        return F.transform(row, lambda c: F.lower(F.trim(c)))

    def first(row: Column, test) -> Column:  # noqa: ANN001
        at = F.array_position(F.transform(low(row), test), True)
        return F.when(at > 0, at.cast("int"))

    address = lambda c: F.exists(F.array(*map(F.lit, ADDRESS_HEADERS)), lambda h: c.startswith(h))
    heads = F.transform(F.slice("grid", 1, 2), lambda r, i: F.struct((i + 1).alias("row"), first(r, address).alias("a"), first(r, lambda c: c.isin(NAME_HEADERS)).alias("n"), first(r, lambda c: c == "bus").alias("b")))
    named = lambda r, h: F.filter(F.split(_cell(r, h["n"]), r"\s*[/,]\s*|\s+"), lambda p: p.rlike(ID))
    tells = lambda r, h: (F.greatest(h["a"], h["n"]) <= F.size(r)) & F.coalesce(F.try_element_at(r, h["a"]), F.lit("")).rlike(HEX) & ~F.lower(_cell(r, h["n"])).isin(RESERVED) & (F.size(named(r, h)) > 0)
    # a head under which nothing is told isn't one: the second row may be
    usable = F.filter(F.filter(heads, lambda h: h["a"].isNotNull() & h["n"].isNotNull() & (h["a"] != h["n"])), lambda h: F.exists(F.slice("grid", h["row"] + 1, F.size("grid")), lambda r: tells(r, h)))
    df = blocks.where((F.col("kind") == "table") & (F.size("grid") > 0) & ~is_define_table(F.col("grid"))).withColumn("h", F.try_element_at(usable, F.lit(1))).where("h IS NOT NULL")
    df = df.select("doc_id", "block_ix", "page", "section", "h", F.posexplode("grid").alias("k", "r")).where("k >= h.row AND greatest(h.a, h.n) <= size(r)")
    addrs = F.regexp_extract_all(F.element_at("r", F.col("h.a")), F.lit(f"({HEX})"), 1)
    df = df.select("*", addrs.alias("addrs"), _cell(F.col("r"), F.col("h.n")).alias("cell"), F.when(F.col("h.b").isNotNull() & (F.col("h.b") <= F.size("r")), _cell(F.col("r"), F.coalesce("h.b", F.lit(1)))).alias("bus"))
    df = df.where((F.size("addrs") > 0) & ~F.lower("cell").isin(RESERVED))
    df = df.select("*", F.posexplode(F.filter(F.split("cell", r"\s*[/,]\s*|\s+"), lambda p: p.rlike(ID))).alias("j", "name"))
    return df.select("doc_id", "block_ix", F.col("k").alias("m"), F.col("j").alias("k"), "name", X.hex_padded(F.element_at("addrs", 1)).alias("base"), F.when(F.size("addrs") > 1, X.hex_padded(F.try_element_at("addrs", F.lit(2)))).alias("end"), F.nullif("bus", F.lit("")).alias("bus"), "page", "section", F.lit("table").alias("source"), F.lit(None).cast("string").alias("desc"))


def entries(blocks: DataFrame) -> DataFrame:
    """All entries of a block stream in reading order, ix dense in a document."""
    own = section_path(blocks, "s4")
    every = from_sentences(own).unionByName(from_define_tables(own)).unionByName(from_boundary_tables(own))
    order = Window.partitionBy("doc_id").orderBy("block_ix", "m", "k")
    return every.withColumn("ix", F.row_number().over(order).cast("bigint"))


def merge(found: DataFrame) -> DataFrame:
    """One entry for each name: the first, or the first sentence that agrees with it; conflicts are other bases after the
    winner, also is the table entry that a sentence took the place of."""
    order = Window.partitionBy("doc_id", "name").orderBy("ix")
    whole = Window.partitionBy("doc_id", "name")
    df = found.withColumns({"__base": F.first("base").over(order), "__first": F.first(F.struct("ix", "page", "source")).over(order)})
    df = df.withColumn("__text", F.min(F.when((F.col("base") == F.col("__base")) & (F.col("source") == "text"), F.col("ix"))).over(whole))
    df = df.withColumn("__win", F.when(F.col("__first.source") == "text", F.col("__first.ix")).otherwise(F.coalesce("__text", F.col("__first.ix"))))
    conflict = F.when((F.col("base") != F.col("__base")) & (F.col("ix") > F.col("__win")), F.struct("ix", "base", "page"))
    won = F.col("ix") == F.col("__win")
    out = df.groupBy("doc_id", "name").agg(
        F.max(F.when(won, F.struct("base", "end", "bus", "page", "section", "source", "desc", "ix"))).alias("w"),
        F.transform(F.array_sort(F.collect_list(conflict)), lambda c: F.struct(c["base"].alias("base"), c["page"].alias("page"))).alias("conflicts"),
        F.first("__first").alias("f"),
    )
    also = F.when(F.col("w.ix") != F.col("f.ix"), F.array(F.struct(F.col("f.page").alias("page"), F.col("f.source").alias("source")))).otherwise(F.array().cast("array<struct<page:int,source:string>>"))
    return out.select("doc_id", "name", "w.base", "w.end", "w.bus", "w.page", "w.section", "w.source", "w.desc", "conflicts", also.alias("also"))


def lookup(memmap: DataFrame, name: str | None = None, n: int = 60) -> DataFrame:
    """Entries named so, or if there are none those whose name holds the text, by base."""
    own = memmap
    if name:
        q = name.upper()
        tier = F.when(F.upper("name") == q, 0).when(F.upper("name").contains(q), 1)
        own = own.withColumn("__tier", tier).where("__tier IS NOT NULL")
        own = own.withColumn("__best", F.min("__tier").over(Window.partitionBy("doc_id"))).where("__tier = __best").drop("__tier", "__best")
    return own.orderBy("base", "name", "doc_id").limit(n)
