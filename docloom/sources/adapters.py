"""Block streams made from the star-schema and text tables, so that every operator has input of any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks: the first line is a heading, one with " | " a table; twenty neighbours are a document."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("set"), F.floor(F.col("doc_id") / 20).cast("string")).alias("source"), F.posexplode(F.split("text", "\n")).alias("ix", "text"))
    kind = F.when(F.col("ix") == 0, "heading").when(F.col("text").contains(" | "), "table").otherwise("text")
    return df.select(F.col("source").alias("doc_id"), (F.col("doc_id") * 1_000_000 + F.col("ix")).alias("rowid"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), (F.col("ix") + 1).cast("int").alias("line"), (1 + F.floor(F.col("ix") / 5)).cast("int").alias("page"), F.concat((F.col("doc_id") % 7).cast("string"), F.lit("."), F.col("ix").cast("string")).alias("section"), kind.alias("kind"), F.lit("").alias("tid"), "text")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks: each line by its number a chapter, section, plain heading or text."""
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    ix = F.col("i")
    sec = F.when(ix % 6 == 0, (F.floor(ix / 6) + 1).cast("string")).when(ix % 6 == 3, F.concat((F.floor(ix / 6) + 1).cast("string"), F.lit(".1")))
    heading = (ix % 6 == 0) | (ix % 6 == 3) | (ix % 6 == 4)
    title = F.when(ix % 24 == 4, "Contents").otherwise(F.col("line"))
    return df.select("doc_id", ix.cast("bigint").alias("block_ix"), F.when(heading, "heading").otherwise("text").alias("kind"), "line", sec.alias("s"), F.when(heading, title).otherwise("").alias("title"), (1 + F.floor(ix / 4)).cast("int").alias("page"), F.when(ix % 6 == 0, 1).when(ix % 6 == 3, 2).when(ix % 6 == 4, 3).otherwise(0).alias("level")).select("doc_id", "block_ix", "kind", F.when(F.col("kind") == "heading", F.concat(F.coalesce(F.concat("s", F.lit(" ")), F.lit("")), F.col("title"))).otherwise(F.col("line")).alias("text"), "page", "level", F.coalesce("s", F.lit("")).alias("sec"), "title", F.lit("").alias("table_id"), F.lit(None).cast("array<array<string>>").alias("grid"), F.lit(False).alias("spans"), F.lit(None).cast("array<struct<r:int,c:int,rs:int,cs:int,text:string,hdr:boolean>>").alias("cells"))


def register_blocks(spark: SparkSession, sf_dir: str, span: int = 10_000_000) -> DataFrame:
    """A manual for each nation of suppliers: a chapter for each supplier with its base, and a register for each of its
    parts, as a heading, an offset, a reset and a table of two fields. A chapter has `span` numbers of blocks, ten a part key."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("man"), F.col("s_nationkey").cast("string")).alias("doc_id"))
    n = F.lit(sup.count())
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.pmod(F.col("p_partkey"), n) + 1).alias("k"))
    key, p = F.col("s_suppkey"), F.col("p_partkey")
    chap, unit = key.cast("string"), F.concat(F.lit("P"), key.cast("string"))
    base = X.to_hex(F.lit(0x40000000) + key * 0x4000, 8)
    none = F.lit(None).cast("array<array<string>>")

    def block(order, kind, text, sec, title, level, grid=none):  # noqa: ANN001, ANN202
        return F.struct(order.cast("bigint").alias("o"), F.lit(kind).alias("kind"), text.alias("text"), sec.alias("sec"), title.alias("title"), F.lit(level).alias("level"), grid.alias("grid"))

    empty = F.lit("")
    head = sup.select("doc_id", "s_suppkey", F.lit(0).cast("bigint").alias("p"), F.explode(F.array(
        block(F.lit(0), "heading", F.concat(chap, F.lit(" Unit "), chap, F.lit(" ("), unit, F.lit(")")), chap, F.concat(F.lit("Unit "), chap, F.lit(" ("), unit, F.lit(")")), 1),
        block(F.lit(1), "text", F.concat(F.lit("The "), unit, F.lit(" registers start at a base address of "), base, F.lit(" (defined as "), unit, F.lit("_BASE in SDK)")), empty, empty, 0),
    )).alias("b"))
    reg = F.concat(F.lit("R"), p.cast("string"), F.lit("_CTRL"))
    offset = X.to_hex(4 * (p % 1024), 3)
    row = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    grid = F.array(row("Bits", "Name", "Description", "Type", "Reset"), row("31:16", "SIZE", F.concat(F.lit("Size  of part "), p.cast("string")), "RW", X.to_hex(F.col("p_size").cast("bigint"), 1)), row("15:0", "", F.concat(F.lit("KEY: key "), p.cast("string")), "RO", "-"))
    body = sup.join(part, key == F.col("k")).select("doc_id", "s_suppkey", F.col("p_partkey").alias("p"), F.explode(F.array(
        block(F.lit(2), "heading", F.concat(unit, F.lit(": "), reg, F.lit(" Register")), empty, F.concat(unit, F.lit(": "), reg, F.lit(" Register")), 3),
        block(F.lit(3), "text", F.concat(F.lit("Offset: "), offset), empty, empty, 0),
        block(F.lit(4), "text", F.concat(F.lit("Reset value: "), X.to_hex(F.col("p_size").cast("bigint"), 8)), empty, empty, 0),
        block(F.lit(5), "table", empty, empty, empty, 0, grid),
    )).alias("b"))
    every = head.unionByName(body)
    ix = key * F.lit(span).cast("bigint") + F.col("p") * 10 + F.col("b.o")
    return every.select("doc_id", ix.cast("bigint").alias("block_ix"), "b.kind", "b.text", key.cast("int").alias("page"), "b.level", "b.sec", "b.title", F.when(F.col("b.kind") == "table", F.concat(F.lit("t"), F.col("p").cast("string"))).otherwise("").alias("table_id"), "b.grid", F.lit(False).alias("spans"), F.lit(None).cast("array<struct<r:int,c:int,rs:int,cs:int,text:string,hdr:boolean>>").alias("cells"))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manual for each fifty parts, in which registers are printed in five ways: a family by its first and last members with
    its label and offsets in two blocks; a heading with the name in parentheses and bits in paragraphs over two pages; a
    caption and a table that goes on on the next page; a printed address and one field without a name; rows of a register's
    table after the next one's heading."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    p, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    at, none = (p * 10).cast("int"), F.lit(None).cast("array<array<string>>")
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    head = row("Bits", "Description", "Type", "Reset")

    def block(kind, words="", page=0, level=0, sec=None, grid=none, tid=""):  # noqa: ANN001, ANN202
        words = F.lit(words) if isinstance(words, str) else words
        sec = F.lit("") if sec is None else sec
        shown = F.when(sec != "", F.concat(sec, F.lit(" "), words)).otherwise(words) if kind == "heading" else words
        return F.struct(F.lit(kind).alias("kind"), shown.alias("text"), (at + page).alias("page"), F.lit(level).alias("level"), sec.alias("sec"), (words if kind == "heading" else F.lit("")).alias("title"), F.concat(F.lit(tid), n).alias("table_id"), grid.alias("grid"))

    named = lambda *c: block("heading", text(*c), level=3)
    dots = F.when(p % 2 == 0, "…").otherwise("\ufffd")
    family = [named("IO: GPIO0_C", n, ", GPIO1_C", n, ", ", dots, ", GPIO7_C", n, " Registers"), block("text", "Offsets"), block("text", text(": 0x000, 0x008, ", dots)), block("table", grid=F.array(head, row("31:5", "Reserved.", "-", "-"), row("4:0", "FUNCSEL: function", "RW", "0x1f")), tid="t")]
    paragraphs = [block("heading", text("Clock control register (RCC", n, "_CR)"), 1, 2, text(n, ".1")), block("text", text("Address offset: ", X.to_hex((p % 64).cast("bigint"), 2)), 1), block("text", text("Reset value: 0x0000 00", F.lpad(F.hex(p % 256), 2, "0")), 1), block("text", "Bits 31:28 Reserved, must be kept\n\nBit 27 PLLRDY: ready", 1), block("text", "Bits 6:4 RANGE[2:0]: speed", 2)]
    pages = [block("text", text("Table 3. TIM", n, "_CTL register")), block("text", "Offset: 0x10"), block("table", grid=F.array(head, row("31:16", "A: a", "RW", "0")), tid="t"), block("table", page=1, grid=F.array(head, row("31:16", "A: a", "RW", "0"), row("15:0", "B: b", "RW", "0")), tid="u")]
    printed = [named("AUX: ONE", n, "_R Register"), block("text", text("Address: ", X.to_hex(F.lit(0x40000000) + p * 16, 8))), block("text", "Offset: 0x04"), block("table", grid=F.array(row("Bits", "Name", "Description", "Type", "Reset"), row("31:0", "", "", "RW", "0x5")), tid="t")]
    goes_on = [named("P: ONE", n, "X Register"), block("text", "Offset: 0x0"), block("table", grid=F.array(head, row("31:8", "A: a", "RW", "0")), tid="t"), named("P: TWO", n, "X Register"), block("text", "Offset: 0x4"), block("table", page=1, grid=F.array(head, row("11:8", "CLK_A: restart the", "SC", "0"), row("7:4", "divider. CLK_B : Write 1", "SC", "0"))), block("table", grid=F.array(head, row("31:0", "C: c", "RW", "0")), tid="v")]
    begins, ends = block("heading", F.when(p % 5 == 1, text("Clocks (RCC", n, ")")).otherwise("Block"), level=1, sec=n), block("heading", "End", level=1, sec=text(n, "0"))
    ways = [F.array(begins, *own, ends) for own in (family, paragraphs, pages, printed, goes_on)]
    chosen = F.when(p % 5 == 0, ways[0]).when(p % 5 == 1, ways[1]).when(p % 5 == 2, ways[2]).when(p % 5 == 3, ways[3]).otherwise(ways[4])
    rows = part.select(F.concat(F.lit("lay"), F.floor(p / 50).cast("string")).alias("doc_id"), "p_partkey", F.posexplode(chosen).alias("o", "b"))
    return rows.select("doc_id", (p * 100 + F.col("o")).cast("bigint").alias("block_ix"), "b.*", F.lit(False).alias("spans"), F.lit(None).cast("array<struct<r:int,c:int,rs:int,cs:int,text:string,hdr:boolean>>").alias("cells"))


def set_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line blocks of twenty documents each as one document."""
    df, k = line_blocks(spark, sf_dir), F.col("doc_id").cast("bigint")
    return df.withColumns({"doc_id": F.concat(F.lit("set"), F.floor(k / 20).cast("string")), "block_ix": k * 1_000_000 + F.col("block_ix")})


def page_texts(blocks: DataFrame) -> DataFrame:
    """The page text of a block stream, with every tenth page's numbers spoilt."""
    body = F.when(F.col("kind") == "table", F.array_join(F.transform("grid", lambda r: F.array_join(r, " ")), "\n")).otherwise(F.col("text"))
    whole = blocks.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", body.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return whole.withColumn("text", F.when(F.col("page") % 10 == 0, F.regexp_replace("text", "0x", "0y")).otherwise(F.col("text")))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, each naming a register and a peripheral."""
    df = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = F.lit(table(spark, sf_dir, "part").count())
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn"), n)
    return df.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("prompt_id"), F.concat(F.lit("What does R"), k.cast("string"), F.lit("_CTRL do in the USB part of P"), (F.col("conv_id") % 1000).cast("string"), F.lit("? "), F.coalesce("text", F.lit(""))).alias("prompt"))


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as graded results."""
    df = table(spark, sf_dir, "events")
    e = F.col("event_id")
    return df.select(e.cast("string").alias("id"), F.col("event_type").alias("category"), F.when(e % 2 == 0, "indexed").otherwise("baseline").alias("mode"), (e % 3 != 0).cast("int").alias("correct"), (e % 5 != 0).cast("int").alias("cited"), F.round("value", 4).alias("cost_usd"), (F.col("user_id") * 13 % 1000).cast("bigint").alias("tokens_total"), (e % 9).cast("int").alias("turns"), (F.col("user_id") % 311).cast("bigint").alias("tokens_input_uncached"), (e % 53).cast("bigint").alias("tokens_output"), (e % 17).cast("double").alias("wall_s"), F.when(e % 11 == 0, "Read").otherwise("").alias("denied"))
