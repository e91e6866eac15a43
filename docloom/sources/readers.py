"""Readers. Schemas are explicit; a missing file gives an empty table of the schema."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import text as X
from docloom.operators.hierarchy import in_order

#: Pictures under this size are icons; labels are cut to this length.
LEAST_WIDTH, LEAST_HEIGHT, LABEL_CHARS = 60.0, 40.0, 600


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _or_empty(spark: SparkSession, path: str, schema: str, read) -> DataFrame:  # noqa: ANN001
    return read() if exists(spark, path) else spark.createDataFrame([], schema)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return _or_empty(spark, path, schema, lambda: spark.read.schema(schema).json(path))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, plain or gzip."""
    return _or_empty(spark, path, schema, lambda: spark.read.schema(schema).option("multiLine", True).json(path))


#: Fixed value: the head of a figure index.
FIGURE_HEAD = "id\tpage\tsection\tfile\tcaption\tlabels"


def files(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """doc_id, file, text of files that sinks wrote, each a text read whole."""
    if packed:
        return spark.read.schema("doc_id string, file string, text string").parquet(path)
    return spark.read.text(path, wholetext=True).select(F.col("doc_id").cast("string").alias("doc_id"), "file", F.col("value").alias("text"))


def figures_tsv(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Rows are padded or cut to six columns; a head is skipped. Of a folder by document also doc_id."""
    cell = lambda k: F.coalesce(F.try_element_at(F.split("value", "\t"), F.lit(k + 1)), F.lit(""))
    names = ("fid", "page", "section", "file", "caption", "labels")

    def read() -> DataFrame:
        lines = files(spark, path, packed).select("doc_id", F.explode(F.split("text", "\n")).alias("value")) if packed else spark.read.text(path)
        rows = lines.where((F.trim("value") != "") & (F.col("value") != FIGURE_HEAD))
        return rows.select(*[cell(k).alias(n) for k, n in enumerate(names)], *[F.col("doc_id").cast("string")] * ("doc_id" in lines.columns))

    return _or_empty(spark, path, schemas.FIGURES, read)


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, path, schemas.RESULTS, lambda: spark.read.csv(path, schema=schemas.RESULTS, header=True, multiLine=True, escape='"'))


def questions_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, path, schemas.QUESTIONS, lambda: spark.read.csv(path, schema=schemas.QUESTIONS, header=True, sep="\t", quote=""))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """id, sha256, length of binary files."""
    return spark.read.format("binaryFile").load(path).select(X.doc_id_from_name(F.col("path")).alias("id"), F.sha2("content", 256).alias("sha256"), "length")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, json of converted documents, one a file; gzip is read as such, and wins over a plain file of its place and name.

    A stored document lies in a folder of its own, which names it; files of any other name than STORED name themselves.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    place = F.regexp_replace("path", r"\.json(\.gz)?$", "")
    folders = F.split(place, "/")
    name = F.when(F.element_at(folders, -1) == STORED, F.element_at(folders, -2)).otherwise(F.element_at(folders, -1))
    best = raw.groupBy(place.alias("place"), name.alias("doc_id")).agg(F.max_by("path", F.col("path").endswith(".gz")).alias("path"))
    return raw.join(best, "path").select("doc_id", "json")


ENTRY = "STRUCT<id:STRING,title:STRING,kind:STRING,source:STRING,pdf_sha256:STRING,pages:INT,page_range:ARRAY<INT>,profile:STRING,built:STRING,convert_seconds:DOUBLE,grades:MAP<STRING,STRING>,low_pages:ARRAY<INT>,counts:MAP<STRING,STRING>,verify:MAP<STRING,INT>>"


def catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The entries of a manifest {version, docs: {id: entry}}, or (lines) of entries a line each; unknown keys are left out."""
    whole = (jsonl if lines else json_document)(spark, path, f"docs MAP<STRING,{ENTRY}>, {ENTRY[len('STRUCT<'):-1].replace(':', ' ')}")
    one = F.struct(*[F.col(c) for c in whole.columns if c != "docs"])
    listed = F.transform(F.map_entries("docs"), lambda e: e["value"])
    rows = whole.select(F.explode(F.coalesce(listed, F.array(one))).alias("e")).where("e.id IS NOT NULL")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select("e.*").withColumns({"kind": F.coalesce("kind", F.lit("manual")), "title": F.coalesce("title", F.lit("")), "pages": F.coalesce("pages", F.lit(0)), "low_pages": F.coalesce("low_pages", F.array().cast("array<int>")), "grades": F.coalesce("grades", empty), "counts": F.coalesce("counts", empty)})


#: A stored document's file; labels of the stored format by what becomes of them.
STORED = "docling"
HEADINGS, LISTS = ["section_header", "title"], ["list", "ordered_list", "inline"]
_CELL = pa.struct([("r", pa.int32()), ("c", pa.int32()), ("rs", pa.int32()), ("cs", pa.int32()), ("text", pa.string()), ("hdr", pa.bool_())])
_PART = pa.struct([("text", pa.string()), ("mark", pa.string()), ("hidden", pa.bool_())])
NODE = f"doc_id string, block_ix bigint, ref string, label string, level int, page int, text string, captions array<string>, parts array<struct<text:string,mark:string,hidden:boolean>>, width double, height double, grid {schemas.GRID}, cells array<{schemas.CELL}>"
_ARROW_NODE = pa.schema([("doc_id", pa.string()), ("block_ix", pa.int64()), ("ref", pa.string()), ("label", pa.string()), ("level", pa.int32()), ("page", pa.int32()), ("text", pa.string()), ("captions", pa.list_(pa.string())), ("parts", pa.list_(_PART)), ("width", pa.float64()), ("height", pa.float64()), ("grid", pa.list_(pa.list_(pa.string()))), ("cells", pa.list_(_CELL))])


class _Tree:
    """A stored document: items by reference. What is made of an item is left to the columns."""

    def __init__(self, doc: dict):
        every = [x for part in ("texts", "groups", "tables", "pictures") for x in doc.get(part) or []]
        self.items = {x["self_ref"]: x for x in every if "self_ref" in x}
        self.hidden = {r for x in every for r in self.refs(x, "captions")}
        self.root = self.refs(doc.get("body") or {}, "children")

    @staticmethod
    def refs(item: dict, what: str) -> list[str]:
        return [r.get("$ref") or r.get("cref") for r in item.get(what) or []]

    def reading_order(self) -> Iterator[str]:
        """References of what is read by itself: furniture, captions and what belongs to a list, table or picture aren't."""
        todo = self.root[::-1]
        while todo:
            ref = todo.pop()
            item = self.items.get(ref)
            if item is None or ref in self.hidden or (item.get("content_layer") or "body") != "body":
                continue
            grouped = ref.startswith("#/groups/") and item.get("label") not in LISTS
            if not grouped:
                yield ref
            if grouped or item.get("label") in HEADINGS:
                todo += self.refs(item, "children")[::-1]

    def page(self, ref: str) -> int | None:
        """Of the item, or of a group the first page below it."""
        todo = [ref]
        while todo:
            at = todo.pop()
            item = self.items.get(at) or {}
            if item.get("prov"):
                return item["prov"][0].get("page_no")
            if at.startswith("#/groups/"):
                todo += self.refs(item, "children")[::-1]
        return None

    def texts(self, refs: list[str]) -> list[str]:
        return [self.items[r].get("text") or "" for r in refs if r in self.items]

    def row(self, ref: str) -> dict:
        item = self.items[ref]
        below, data, box = self.refs(item, "children"), item.get("data") or {}, ((item.get("prov") or [{}])[0]).get("bbox") or {}
        own = [(r, self.items[r]) for r in below if r in self.items]
        return {
            "ref": ref, "label": item.get("label"), "level": item.get("level"), "page": self.page(ref), "text": item.get("text"), "captions": self.texts(self.refs(item, "captions")),
            "parts": [{"text": x.get("text"), "mark": x.get("marker") if x.get("enumerated") else None, "hidden": r in self.hidden} for r, x in own],
            "width": abs(box["r"] - box["l"]) if box else None, "height": abs(box["t"] - box["b"]) if box else None,
            "grid": [[c.get("text") or "" for c in line] for line in data["grid"]] if "grid" in data else None,
            "cells": [{"r": c["start_row_offset_idx"], "c": c["start_col_offset_idx"], "rs": c.get("row_span", 1), "cs": c.get("col_span", 1), "text": c.get("text") or "", "hdr": bool(c.get("column_header") or c.get("row_header"))} for c in data.get("table_cells") or []] if "grid" in data else None,
        }


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("json").to_pylist(), strict=True):
            tree = _Tree(json.loads(raw))
            yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "block_ix": k, **tree.row(ref)} for k, ref in enumerate(tree.reading_order())], schema=_ARROW_NODE)


def _list_text(label: Column, parts: Column) -> Column:
    """Items of a list, a line each with its mark; an inline group is one line."""
    filled = F.filter(parts, lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")
    lines = F.transform(filled, lambda p: F.concat(F.coalesce(F.nullif(p["mark"], F.lit("")), F.lit("-")), F.lit(" "), F.trim(p["text"])))
    return F.when(label == "inline", F.array_join(F.transform(filled, lambda p: F.trim(p["text"])), " ")).otherwise(F.array_join(lines, "\n"))


def _table_text(grid: Column) -> Column:
    """A grid as a markdown table, its first row as the head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.element_at(grid, 1), lambda c: F.lit("---")), "|"), F.lit("|"))
    lines = F.transform(grid, line)
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(grid))), "\n")).otherwise("")


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of converted documents (doc_id, json), with repaired text, section numbers, pages and table ids.

    A document's tree gives the order of its items, by document; all else is columns.
    """
    df = docs.select("doc_id", "json").mapInArrow(_nodes, NODE)
    label, picture, table = F.col("label"), F.col("ref").startswith("#/pictures/"), F.col("ref").startswith("#/tables/")
    kind = F.when(table, "table").when(picture, "picture").when(F.col("ref").startswith("#/groups/"), "list").when(label.isin(HEADINGS), "heading").when(label == "code", "code").otherwise("text")
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    grid = F.transform("grid", lambda r: F.transform(r, lambda c: X.fix_text(F.trim(F.replace(c, F.lit("\n"), F.lit(" "))))))
    spans = F.exists("cells", lambda c: (c["rs"] > 1) | (c["cs"] > 1))
    cells = F.array_sort(F.transform("cells", lambda c: F.struct(c["r"].alias("r"), c["c"].alias("c"), c["rs"].alias("rs"), c["cs"].alias("cs"), X.fix_text(X.one_line(c["text"])).alias("text"), c["hdr"].alias("hdr"))))
    shown = F.filter("parts", lambda p: ~p["hidden"] & (F.coalesce(p["text"], F.lit("")) != ""))
    labels = F.substring(F.array_join(F.array_distinct(F.transform(shown, lambda p: X.fix_text(X.one_line(p["text"])))), ", "), 1, LABEL_CHARS)
    df = df.withColumn("kind", kind).where(~(picture & ((F.col("width") < LEAST_WIDTH) | (F.col("height") < LEAST_HEIGHT))) | ~picture | F.col("width").isNull())
    text = F.when(F.col("kind") == "list", _list_text(label, F.col("parts"))).when(F.col("kind").isin("picture", "table"), "").when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).otherwise(clean(F.col("text")))
    df = df.withColumn("__grid", grid).withColumn("text", X.fix_text(F.when(F.col("kind") == "table", _table_text(F.col("__grid"))).otherwise(text)))
    df = df.where(~F.col("kind").isin("text", "list", "code") | ((F.col("text") != "") & (clean(F.col("text")) != "```\n\n```")))
    heading = F.col("kind") == "heading"
    n = F.count(F.when(F.col("kind") == "table", 1)).over(in_order())
    # a picture has the number of its reference, which its image file bears too; else its place among the pictures
    nth = F.count(F.when(F.col("kind") == "picture", 1)).over(in_order())
    number = F.coalesce(F.regexp_extract("ref", r"/(\d+)$", 1).try_cast("int"), nth)
    padded = lambda c, lead: F.concat(F.lit(lead), F.when(c < 10_000, F.lpad(c.cast("string"), 4, "0")).otherwise(c.cast("string")))
    caption = clean(F.array_join("captions", " "))
    return df.select(
        "doc_id", (F.row_number().over(in_order()) - 1).cast("bigint").alias("block_ix"), "kind", "text",
        F.coalesce(F.last("page", ignorenulls=True).over(in_order()), F.lit(0)).alias("page"), F.when(heading, F.when(label == "title", 1).otherwise(F.coalesce("level", F.lit(1)))).otherwise(0).alias("level"),
        F.when(heading, X.heading_title(F.col("text"))).when(picture | table, caption).otherwise("").alias("title"),
        F.when(F.col("kind") == "table", padded(n, "t")).when(picture, padded(number, "f")).alias("table_id"),
        F.when(F.col("kind") == "table", F.col("__grid")).when(picture, F.array(F.array(labels))).alias("grid"), F.when(F.col("kind") == "table", spans).alias("spans"), F.when(spans, cells).alias("cells"),
        F.when(heading, X.heading_section(F.col("text"))).otherwise("").alias("sec"),
    )


def html_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, block_ix, kind, level, text of headings, paragraphs and list items of web pages."""
    tag = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1>"
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(tag), 1).alias("tag"), F.regexp_extract_all("html", F.lit(tag), 2).alias("inner"))
    df = pages.select(F.col("page_id").cast("string").alias("doc_id"), F.posexplode(found).alias("block_ix", "x"))
    name = F.lower("x.tag")
    text = X.one_line(F.regexp_replace("x.inner", "<[^>]*>", " "))
    kind = F.when(name.startswith("h"), "heading").when(name == "li", "list").otherwise("text")
    return df.select("doc_id", F.col("block_ix").cast("bigint").alias("block_ix"), kind.alias("kind"), F.when(name.startswith("h"), F.substring(name, 2, 1).cast("int")).otherwise(0).alias("level"), text.alias("text"))
