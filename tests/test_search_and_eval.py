import gzip
import json
import math
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.operators import hierarchy, catalog, evaluate, hints, lookup, search
from docloom.sources import adapters, readers, sinks
from docloom.streaming import prompts
from tests.helpers import blocks, heading, table, text

CHUNK = "doc_id string, rowid long, file string, line int, page int, section string, kind string, tid string, text string"


def chunks(spark, rows):
    return spark.createDataFrame([("d", k, "f.md", k, 1, s, kind, "", t) for k, (kind, s, t) in enumerate(rows)], CHUNK)


def test_query_phrases():
    assert search.parse_query("PLL_CS reg*") == [search.Phrase(("pll", "cs")), search.Phrase(("reg",), True)]
    assert search.parse_query("  ") == []


@pytest.mark.parametrize("query", ["the", "that the", "of_the", "worth*", "of_th*", "für"])
def test_same_scores_as_a_full_text_index(spark, sf, query, tmp_path):
    rows = adapters.table(spark, sf, "documents").select("doc_id", "text").collect()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE c USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO c(rowid, text) VALUES (?, ?)", [(r["doc_id"] + 1, r["text"]) for r in rows])
    match = " ".join('"' + w.rstrip("*") + '"' + "*" * w.endswith("*") for w in query.split())
    want = dict(con.execute("SELECT rowid - 1, bm25(c) FROM c WHERE c MATCH ?", [match]).fetchall())
    df = adapters.table(spark, sf, "documents").select(F.lit("d").alias("doc_id"), F.col("doc_id").alias("rowid"), F.lit("text").alias("kind"), "text")
    search.write_index(df.withColumns({"section": F.lit(""), "file": F.lit(""), "line": F.lit(1), "page": F.lit(1), "tid": F.lit("")}), str(tmp_path), 3)
    for hits in (search.score(df, query), search.Index(spark, str(tmp_path)).score(query)):
        got = {r["rowid"]: r["bm25"] for r in hits.collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_letters_as_a_full_text_index_folds_them(spark):
    """Every small letter of the Latin blocks, precomposed and with marks after it."""
    letters = [chr(c) for c in range(0x61, 0x1F00) if chr(c).isalpha() and chr(c) == chr(c).lower() and "LATIN" in unicodedata.name(chr(c), "")]
    texts = [f"x{c}y" for c in letters] + [f"x{unicodedata.normalize('NFD', c)}y" for c in letters]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE c USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(c, instance)")
    con.executemany("INSERT INTO c(rowid, text) VALUES (?, ?)", list(enumerate(texts)))
    want = dict(con.execute("SELECT doc, term FROM v ORDER BY doc, offset DESC").fetchall())
    got = {r["k"]: r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", search.tokens(F.col("text")).alias("t")).collect()}
    wrong = [(texts[k], want[k], got[k]) for k in want if got[k] != [want[k]]]
    assert len(wrong) <= 0.02 * len(texts), wrong[:20]
    assert search.parse_query("Tiếng") == [search.Phrase(("tieng",))]


def test_index_reads_the_query_s_tokens_only(spark, tmp_path):
    c = chunks(spark, [("text", "1", f"word{k} clock") for k in range(50)])
    search.write_index(c, str(tmp_path), 4)
    plan = search.Index(spark, str(tmp_path)).score("word7 clo*")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(StringStartsWith(token,clo),EqualTo(token,word7))]" in plan or "StringStartsWith(token,clo)" in plan.split("PushedFilters")[1]
    shown = search.Index(spark, str(tmp_path))
    hits = shown.shown(shown.search("clock", n=3), "clock", full=1).orderBy("place").collect()
    assert [h["full"] is not None for h in hits] == [True, False, False] and hits[0]["snippet"] == hits[0]["text"]


def test_kind_weights(spark):
    c = chunks(spark, [("code", "1", "pll pll pll pll pll pll"), ("heading", "1", "pll setup"), ("table", "1", "pll | value"), ("text", "1", "other"), ("text", "1", "words"), ("text", "1", "here"), ("text", "1", "more")])
    assert [r["kind"] for r in search.search(c, "pll").orderBy("rank").collect()][-1] == "code"


def test_filters_do_not_change_scores(spark):
    c = chunks(spark, [("text", "1", "clock a"), ("figure", "2.1", "clock b c"), ("text", "2", "d"), ("text", "3", "e"), ("text", "4", "f")])
    every = {r["rowid"]: r["rank"] for r in search.search(c, "clock").collect()}
    assert {r["rowid"]: r["rank"] for r in search.search(c, "clock", kind="figure").collect()} == {1: every[1]}
    assert {r["rowid"] for r in search.search(c, "clock", section="2").collect()} == {1}


def test_statistics_are_of_one_document(spark):
    a = chunks(spark, [("text", "1", "clock a"), ("text", "1", "b"), ("text", "1", "c")])
    alone = search.score(a, "clock").first()["bm25"]
    other = a.withColumn("doc_id", F.lit("e")).withColumn("text", F.lit("clock"))
    assert {r["bm25"] for r in search.score(a.unionByName(other), "clock").where("doc_id = 'd'").collect()} == {alone}


def test_heading_carries_what_follows(spark):
    c = chunks(spark, [("heading", "1", "Clock"), ("text", "1", "first  words"), ("text", "1", "second")])
    full = search.with_following(c, most=40).orderBy("rowid").collect()
    assert full[0]["full"] == "Clock | first words | second" and full[1]["full"] == "first words"


def test_unknown_document(spark):
    with pytest.raises(ValueError, match="available: d"):
        lookup.pick(chunks(spark, [("text", "1", "x")]), "nope")


def test_build_and_commands(spark, tmp_path):
    b = blocks(spark, [
        heading("Clocks", 1, "1"), text("The CLK registers start at a base address of 0x40000000 (defined as CLK_BASE in SDK)"), heading("CLK: CTRL_A Register", 3), text("Offset: 0x08"),
        table([["Bits", "Name", "Description", "Type", "Reset"], ["31:0", "EN", "enable", "RW", "0x1"]]), heading("End", 1, "2"), text("bye"), heading("Last", 1, "3"), {"kind": "picture", "title": "Tree", "table_id": "f0001", "grid": [["a, b"]]},
    ])
    pack = lookup.build(b)
    assert lookup.reg(pack, "ctrl_a").first()["address"] == "0x40000008"
    assert lookup.map_(pack, "clk").first()["base"] == "0x40000000"
    assert [r["sec"] for r in lookup.toc(pack, "d", depth=1).orderBy("block_ix").collect()] == ["1", "2", "3"]
    assert "bye" in [r["text"] for r in lookup.section(pack, "d", "2").collect()]
    assert lookup.table(pack, "d", "t0001").count() == 2
    assert lookup.figure(pack, "d").first()["labels"] == "a, b"
    pages = adapters.page_texts(b)
    assert lookup.check(pack, pages).first()["ok"] == 1
    sinks.section_markdown(pack["blocks"], str(tmp_path / "md"), "a.pdf")
    sinks.tables(b, str(tmp_path / "t"))
    sinks.figures(b, str(tmp_path / "f"))
    sinks.records(pack["registers"], str(tmp_path / "r"))
    sinks.search_index(pack["chunks"], str(tmp_path / "p"))
    sinks.index(pack["blocks"], pack["headings"], str(tmp_path / "i"))
    sinks.whole_document(b, str(tmp_path / "w"))
    assert readers.jsonl(spark, str(tmp_path / "r"), "doc_id string, name string").count() == 1
    # every cited line stands where it is said to stand
    files = {r["file"]: r["value"].split("\n") for r in spark.read.text(str(tmp_path / "md"), wholetext=True).collect()}
    assert set(files) == {"00-1-clocks.md"} and files["00-1-clocks.md"][:7] == ["---", "doc: d", 'title: "Clocks"', "pages: 1-1", "source: a.pdf", "---", ""]
    for h in pack["headings"].collect():
        assert files[h["file"]][h["line"] - 1] == f"{'#' * h['level']} {(h['sec'] + ' ' + h['title']).strip()} <!-- p.1 -->"
    r = lookup.reg(pack, "CTRL_A").first()
    assert "CTRL_A Register" in files[r["file"]][r["line"] - 1]
    assert spark.read.text(str(tmp_path / "i"), wholetext=True).first()["value"].split("\n")[0] == "# d — INDEX"
    got = search.Index(spark, str(tmp_path / "p")).search("bye", n=2).first()
    assert got["section"] == "2"
    assert lookup.with_errata(lookup.reg(pack, "CTRL_A"), pack["chunks"], "bye").first()["errata"] == ["bye"]
    c = pack["counts"].first()
    assert (c["registers"], c["registers_linked"], c["memmap"], c["figures"], c["sections"], c["toc_blocks_dropped"], c["levels"]) == (1, 1, 1, 1, 1, 0, "numbering")
    lines = lookup.section_lines(pack["blocks"], pack["headings"], "d", "2", lines=2).orderBy("line").collect()
    assert [x["text"] for x in lines] == ["# 2 End <!-- p.1 -->", ""] and lines[0]["more"] == 2
    assert readers.figures_tsv(spark, str(tmp_path / "f")).first()["labels"] == "a, b"


def test_captions_reach_figures_chunks_and_files(spark, tmp_path):
    picture = {"kind": "picture", "table_id": "f0001", "grid": [["x"]]}
    pack = lookup.build(blocks(spark, [heading("One", 1, "1"), picture, text("glued text. Figure 36. Clock tree"), heading("Contents", 2), text("1 a ........... 3")]))
    assert lookup.figure(pack, "d").first()["title"] == "Figure 36. Clock tree"
    assert "Figure 36. Clock tree\nx" in [r["text"] for r in pack["chunks"].collect()]
    sinks.section_markdown(pack["blocks"], str(tmp_path))
    assert "<!-- figure f0001 p.1: Figure 36. Clock tree | labels: x -->" in spark.read.text(str(tmp_path)).toPandas()["value"].tolist()
    assert pack["counts"].first()["toc_blocks_dropped"] == 1


def test_readers_of_missing_files(spark, tmp_path):
    assert readers.jsonl(spark, str(tmp_path / "no"), "a string").count() == 0
    assert readers.results_csv(spark, str(tmp_path / "no")).count() == 0


def ref(*names):
    return [{"$ref": f"#/{n}"} for n in names]


STORED = {
    "schema_name": "DoclingDocument", "name": "m",
    "body": {"self_ref": "#/body", "children": ref("texts/0", "groups/0", "tables/0", "pictures/3", "pictures/4", "texts/9", "groups/1", "texts/8", "texts/77")},
    "texts": [
        {"self_ref": "#/texts/0", "label": "section_header", "level": 2, "prov": [{"page_no": 4}], "text": " 1.1 PLL _SYS ", "children": ref("texts/5")}, {"self_ref": "#/texts/1", "label": "text", "prov": [{"page_no": 5}], "text": "in group"},
        {"self_ref": "#/texts/2", "label": "caption", "text": "Table caption"}, {"self_ref": "#/texts/9", "label": "text", "content_layer": "furniture", "text": "footer"}, {"self_ref": "#/texts/5", "label": "text", "text": "under a heading"},
        {"self_ref": "#/texts/6", "label": "list_item", "text": "one", "prov": [{"page_no": 9}]}, {"self_ref": "#/texts/7", "label": "list_item", "text": "two", "enumerated": True, "marker": "2."}, {"self_ref": "#/texts/8", "label": "code", "text": "x = 1"},
        {"self_ref": "#/texts/10", "label": "text", "text": "in picture"}, {"self_ref": "#/texts/11", "label": "text", "text": "in  picture"}, {"self_ref": "#/texts/12", "label": "caption", "text": "Shown"},
    ],
    "groups": [{"self_ref": "#/groups/0", "label": "section", "children": ref("texts/1")}, {"self_ref": "#/groups/1", "label": "list", "children": ref("texts/6", "texts/7")}],
    "tables": [{"self_ref": "#/tables/0", "label": "table", "captions": ref("texts/2"), "data": {"grid": [[{"text": "a"}, {"text": "b\nc"}], [{"text": "1"}, {"text": "2"}]], "table_cells": [{"start_row_offset_idx": 1, "start_col_offset_idx": 0, "row_span": 1, "col_span": 1, "text": "1"}, {"start_row_offset_idx": 0, "start_col_offset_idx": 0, "row_span": 1, "col_span": 2, "text": "a", "column_header": True}]}}],
    "pictures": [{"self_ref": "#/pictures/3", "label": "picture", "prov": [{"page_no": 6, "bbox": {"l": 0, "r": 10, "t": 0, "b": 10}}]}, {"self_ref": "#/pictures/4", "label": "picture", "prov": [{"page_no": 7, "bbox": {"l": 0, "r": 100, "t": 100, "b": 0}}], "captions": ref("texts/12"), "children": ref("texts/12", "texts/10", "texts/11")}],
}


def test_document_tree(spark):
    df = spark.createDataFrame([("d", json.dumps(STORED)), ("e", "{}")], "doc_id string, json string")
    out = readers.blocks(df).orderBy("block_ix").collect()
    assert [(r["block_ix"], r["kind"], r["page"], r["sec"], r["title"], r["table_id"], r["text"]) for r in out] == [
        (0, "heading", 4, "1.1", "PLL_SYS", None, "1.1 PLL_SYS"), (1, "text", 4, "", "", None, "under a heading"), (2, "text", 5, "", "", None, "in group"),
        (3, "table", 5, "", "Table caption", "t0001", "| a | b c |\n|---|---|\n| 1 | 2 |"), (4, "picture", 7, "", "Shown", "f0004", ""), (5, "list", 9, "", "", None, "- one\n2. two"), (6, "code", 9, "", "", None, "```\nx = 1\n```"),
    ]
    assert [(c["r"], c["cs"], c["hdr"]) for c in out[3]["cells"]] == [(0, 2, True), (1, 1, False)] and out[4]["grid"] == [["in picture"]]


def test_stored_documents_and_catalog(spark, tmp_path):
    """Each document in a folder of its own; gzip wins; a manifest of entries, and entries one by one."""
    for name in ("rm1", "rm2"):
        (tmp_path / "root" / name).mkdir(parents=True)
        with gzip.open(tmp_path / "root" / name / "docling.json.gz", "wt") as f:
            json.dump({**STORED, "name": name}, f)
    (tmp_path / "root" / "rm2" / "docling.json").write_text("{}")
    (tmp_path / "root" / "single.json").write_text("{}")
    got = {r["doc_id"]: json.loads(r["json"]) for r in readers.documents(spark, str(tmp_path / "root" / "*" / "docling.json*")).collect()}
    assert {k: v.get("name") for k, v in got.items()} == {"rm1": "rm1", "rm2": "rm2"}
    assert [r["doc_id"] for r in readers.documents(spark, str(tmp_path / "root" / "single.json")).collect()] == ["single"]
    entry = {"id": "rm1", "title": "T", "pages": 3, "low_pages": [2], "counts": {"registers": 2, "levels": "numbering"}, "unknown": 1}
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 1, "docs": {"rm1": entry, "rm2": {"id": "rm2"}}}, indent=1))
    docs = readers.catalog(spark, str(tmp_path / "manifest.json"))
    lines = [r["line"] for r in lookup.status(docs).collect()]
    assert lines[0] == 'rm1 [manual]: "T" 3p, 0 section files, 0 headings, 0 tables, 2 registers, 0 base addresses; confidence mean=? low=? low_pages=1;'
    assert lines[1].startswith('rm2 [manual]: "" 0p,') and readers.catalog(spark, str(tmp_path / "no")).count() == 0
    pages = spark.createDataFrame([("rm1", 4, "x")], "doc_id string, page int, text string")
    stored = readers.documents(spark, str(tmp_path / "root" / "*" / "docling.json.gz"))
    pack = lookup.rebuild(docs, stored, pages, "rm2")
    new = pack["docs"].collect()
    assert len(new) == 1 and new[0]["title"] == "PLL_SYS" and new[0]["counts"]["tables"] == "1" and new[0]["verify"]["ok"] == 0 and pack["mismatches"].count() == 0
    sinks.manifest(docs, str(tmp_path / "entries"))
    assert readers.catalog(spark, str(tmp_path / "entries"), lines=True).orderBy("id").collect() == docs.orderBy("id").collect()


def test_small_readers(spark, tmp_path):
    (tmp_path / "f.tsv").write_text(readers.FIGURE_HEAD + "\nf1\t3\t1.2\n\nf2\t4\ta\tb\tc\td\te\n")
    assert [tuple(r) for r in readers.figures_tsv(spark, str(tmp_path / "f.tsv")).collect()] == [("f1", "3", "1.2", "", "", ""), ("f2", "4", "a", "b", "c", "d")]
    (tmp_path / "a.bin").write_bytes(b"abc")
    r = readers.content_hashes(spark, str(tmp_path / "a.bin")).first()
    assert (r["length"], r["sha256"][:8]) == (3, "ba7816bf")
    (tmp_path / "q.tsv").write_text('id\tcategory\tquestion\tmust\n1\tc\tsay "x"\t0x1|a\n')
    assert readers.questions_tsv(spark, str(tmp_path / "q.tsv")).first()["question"] == 'say "x"'
    (tmp_path / "o.json").write_text('{"a":\n "b"}')
    assert readers.json_document(spark, str(tmp_path / "o.json"), "a string").first()["a"] == "b"


@pytest.mark.parametrize(("must", "answer", "mode", "correct", "cited"), [
    ("0x63", "It is 0x0000_0063 [rp §1 p. 3]", "indexed", 1, 1), ("0x63", "0x630", "indexed", 0, 0), ("31:16", "bits 31 – 16, page 4", "baseline", 1, 1), ("12", "112", "baseline", 0, 0),
    ("a|b; c", "B and C", "baseline", 1, 0), ("NOT_FOUND", "It does not exist.", "indexed", 1, 0), ("NOT_FOUND", "Not found; the reset value is 0x1", "indexed", 0, 0),
])
def test_grade(spark, must, answer, mode, correct, cited):
    df = spark.createDataFrame([("q", mode, must, answer)], "id string, mode string, must string, answer string")
    r = evaluate.grade(df).first()
    assert (r["correct"], r["cited"]) == (correct, cited)


def test_upper_median(spark):
    assert spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x int").agg(evaluate.upper_median("x")).first()[0] == 3


def test_hints_and_guard(spark):
    regs = spark.createDataFrame([("rp", "GPIO0_CTRL", "IO", "0x4", "2.1", 7, 1)], "doc_id string, name string, peripheral string, offset string, section string, page int, block_ix long")
    p = spark.createDataFrame([("a", "What is GPIO0_CTRL on USB?"), ("b", "hello WARNING")], "prompt_id string, prompt string")
    assert hints.hints(p, regs).collect() == [("a", "GPIO0_CTRL (IO offset 0x4) is documented in [rp §2.1 p.7]", 0)]
    ev = spark.createDataFrame([("Read", "/a.pdf", 1, False), ("Edit", "/a.pdf", 1, False), ("Read", "/x/.docstore/d/sections/1.md", 70_000, True), ("Read", "/big", 3_000_000, False)], "tool string, path string, size long, has_limit boolean")
    assert [r["decision"] for r in hints.read_guard(ev).collect()] == ["deny", "pass", "pass", "deny"]


def test_announce(spark):
    docs = spark.createDataFrame([("a", "errata", "T", 3, {"registers": "7", "figures": "2"}), ("b", None, None, None, None)], "id string, kind string, title string, pages int, counts map<string,string>")
    assert [r["line"] for r in hints.announce(docs).orderBy("id").collect()] == ['a [errata]: "T" 3p, 7 registers, 0 tables, 2 figures', 'b [manual]: "" 0p, 0 registers, 0 tables']
    assert hints.announce(docs.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    regs = spark.createDataFrame([("rp", "GPIO0_CTRL", "IO", "0x4", "2.1", 7, 1)], "doc_id string, name string, peripheral string, offset string, section string, page int, block_ix long")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"prompt_id": "a", "prompt": "GPIO0_CTRL?"}) + "\n")
    q = prompts.write_hints(prompts.prompt_stream(spark, str(tmp_path / "in")), regs, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_catalog(spark):
    new = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", "3", [1, 2])], "id string, sha256 string, page_range array<int>")
    old = spark.createDataFrame([("a", "1", None), ("b", "0", None), ("c", "3", [1, 3])], "id string, sha256 string, page_range array<int>")
    assert {r["id"] for r in catalog.stale(new, old).collect()} == {"b", "c"}
    assert catalog.upsert(old, new.where("id = 'b'")).where("id = 'b'").first()["sha256"] == "2"


def test_packed_files(spark, tmp_path):
    """A row for each file, with the text that it has in a folder; few files however many documents; ids as they are."""
    b = blocks(spark, [heading("One", 1, "1"), text("a\n\nb"), text("c", 2)], "007").unionByName(blocks(spark, [text("alone")], "d"))
    for k in range(20):
        b = b.unionByName(blocks(spark, [text(f"x{k}")], f"e{k}"))
    sinks.whole_document(b, str(tmp_path / "loose"))
    sinks.whole_document(b, str(tmp_path / "packed"), packed=True)
    got = {r["doc_id"]: r["text"] for r in readers.files(spark, str(tmp_path / "packed"), packed=True).collect()}
    assert got["007"] == "# 1 One <!-- p.1 -->\n\na\n\nb\n\n<!-- p.2 -->\nc\n\n" and got["d"] == "<!-- p.1 -->\nalone\n\n" and len(got) == 22
    assert sorted(got.values()) == sorted(r["text"] for r in readers.files(spark, str(tmp_path / "loose")).collect())
    assert len(list((tmp_path / "packed").rglob("part-*"))) <= 4 < len(list((tmp_path / "loose").rglob("part-*")))


def test_tables_of_parts_past_a_million(spark, tmp_path):
    """Each table is in its own supplier's chapter, however large the part's key."""
    from docloom.plans.file_queries import QUERIES

    spark.createDataFrame([(1, 7), (2, 7)], "s_suppkey bigint, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(2, 1), (3, 1), (1_200_000, 5), (1_200_001, 5)], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["table_index"](spark, str(tmp_path)).collect()
    assert {(r["id"], r["section"]) for r in got} == {("t2", "1"), ("t3", "2"), ("t1200000", "1"), ("t1200001", "2")}
    lines = QUERIES["table_grids"](spark, str(tmp_path)).where("line = 2").collect()
    assert {r["text"] for r in lines} == {f"31:16,SIZE,Size  of part {p},RW,0x{n}" for p, n in ((2, 1), (3, 1), (1_200_000, 5), (1_200_001, 5))}


def test_packed_indexes(spark, tmp_path):
    """Section files, indexes and figures of documents with ids such as 007 come back from packed files."""
    b = blocks(spark, [heading("One", 1, "1"), {"kind": "picture", "title": "Tree", "table_id": "f0001", "grid": [["a, b"]]}, text("x")], "007")
    parts = hierarchy.line_numbers(hierarchy.split_parts(b))
    sinks.figures(b, str(tmp_path / "f"), packed=True)
    assert [(r["doc_id"], r["fid"], r["labels"]) for r in readers.figures_tsv(spark, str(tmp_path / "f"), packed=True).collect()] == [("007", "f0001", "a, b")]
    sinks.section_markdown(parts, str(tmp_path / "s"), "a.pdf", packed=True)
    own = readers.files(spark, str(tmp_path / "s"), packed=True).first()
    assert (own["doc_id"], own["file"]) == ("007", "00-1-one.md") and own["text"].split("\n")[:8] == ["---", "doc: 007", 'title: "One"', "pages: 1-1", "source: a.pdf", "---", "", "# 1 One <!-- p.1 -->"]
    headings = parts.where("kind = 'heading'").select("doc_id", "block_ix", "sec", "title", "level", "page", hierarchy.file_name(parts).alias("file"), "line")
    sinks.index(parts, headings, str(tmp_path / "i"), packed=True)
    assert readers.files(spark, str(tmp_path / "i"), packed=True).first()["text"].split("\n")[3] == "## sections/00-1-one.md  §1 One  p.1-1"


def test_indexes_need_no_lines(spark, sf, monkeypatch):
    """What an index is made of has neither texts nor line numbers, which need texts."""
    from docloom.plans import file_queries

    seen = []
    monkeypatch.setattr(file_queries.shared, "written", lambda df, what: seen.append(df) or df)
    assert file_queries.QUERIES["index_files"](spark, sf).count() > 0
    assert not {"text", "line"} & set(seen[0].columns)
    window = [x for x in seen[0]._jdf.queryExecution().optimizedPlan().toString().split("\n") if "AS text#" in x]
    assert window == []
