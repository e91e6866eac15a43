from pyspark.sql import functions as F

from docloom.operators import link, memmap, registers, verify
from tests.helpers import blocks, heading, table, text


def extract(spark, rows):
    return registers.extract(blocks(spark, rows)).orderBy("block_ix", "name").collect()


HEAD = ["Bits", "Description", "Type", "Reset"]


def test_text_layout(spark):
    out = extract(spark, [
        heading("Reset and clock control (RCC)", 1, "7", 280), heading("Clock control register (RCC_CR)", 2, "7.4.1", 281), text("Address offset: 0x00", 281), text("Reset value: 0x0000 0063", 281),
        text("Bits 31:28 Reserved, must be kept\n\nBit 27 PLLRDY: ready\nflag", 281), text("Bits 6:4 RANGE[2:0]: speed", 282), heading("Next", 2, "7.4.2", 283), text("Bit 1 X: no", 283),
    ])
    assert len(out) == 1
    r = out[0]
    assert (r["name"], r["peripheral"], r["offset"], r["reset"], r["page"], r["page_end"], r["confidence"]) == ("RCC_CR", "RCC", "0x00", "0x00000063", 281, 282, "good")
    assert [(f["bits"], f["name"], f["desc"]) for f in r["fields"]] == [("31:28", "Reserved", "Reserved, must be kept"), ("27", "PLLRDY", "ready flag"), ("6:4", "RANGE[2:0]", "speed")]


def test_undefined_reset_digits(spark):
    out = extract(spark, [heading("Port register (GPIO_IDR)", 2, "1.1"), text("Offset: 0x10"), text("Reset value: 0x40XX 0000"), text("Bit 0 A: a")])
    assert out[0]["reset"] == "0x40xx0000"


def test_family_with_split_label(spark):
    out = extract(spark, [heading("IO: GPIO0_CTRL, GPIO1_CTRL, …, GPIO29_CTRL Registers", 3), text("Offsets"), text(": 0x000, 0x008, …"), table([HEAD, ["31:5", "Reserved.", "-", "-"], ["4:0", "FUNCSEL: function", "RW", "0x1f"]])])
    assert len(out) == 30
    by = {r["name"]: r for r in out}
    assert by["GPIO7_CTRL"]["offset"] == "0x038" and by["GPIO7_CTRL"]["derived"] and not by["GPIO1_CTRL"]["derived"]
    assert by["GPIO7_CTRL"]["family"] == "GPIO0_CTRL…GPIO29_CTRL" and by["GPIO7_CTRL"]["peripheral"] == "IO"
    assert [f["name"] for f in by["GPIO0_CTRL"]["fields"]] == ["Reserved", "FUNCSEL"]


def test_family_with_a_lost_ellipsis(spark):
    """A converter may write the replacement character for it."""
    out = extract(spark, [heading("IO: GPIO0_CTRL, GPIO1_CTRL, \ufffd, GPIO5_CTRL Registers", 3), text("Offsets: 0x000, 0x008, \ufffd"), table([HEAD, ["0", "A: a", "RW", "0"]])])
    assert [(r["name"], r["offset"]) for r in out] == [(f"GPIO{k}_CTRL", f"0x{8 * k:03x}") for k in range(6)]


def test_documents_are_read_apart_and_in_order(spark):
    """Many documents in one task, whose rows come in any order."""
    rows = [heading("P: ONE Register", 3), text("Offset: 0x0"), table([HEAD, ["31:8", "A: a", "RW", "0"]]), heading("P: TWO Register", 3), text("Offset: 0x4"), table([HEAD, ["7:0", "B: b", "RW", "0"]]), table([HEAD, ["31:0", "C: c", "RW", "0"]])]
    every = [blocks(spark, rows, f"d{k}") for k in range(5)]
    df = every[0]
    for other in every[1:]:
        df = df.unionByName(other)
    out = registers.extract(df.orderBy("kind", "doc_id").coalesce(1)).orderBy("doc_id", "block_ix").collect()
    assert [(r["doc_id"], r["name"], [f["name"] for f in r["fields"]]) for r in out] == [(f"d{k}", n, f) for k in range(5) for n, f in (("ONE", ["A", "B"]), ("TWO", ["C"]))]


def test_second_head_of_a_boundary_table(spark):
    got = entries(spark, [table([["Address", "Name"], ["Boundary address", "Peripheral"], ["0x40000000", "TIM2"]])])
    assert [(e["name"], e["base"]) for e in got] == [("TIM2", "0x40000000")]


def test_table_over_two_pages(spark):
    out = extract(spark, [heading("DMA: CTRL Register", 3, page=5), text("Offset: 0x4", 5), table([HEAD, ["31:16", "A: a", "RW", "0"]], 5), table([HEAD, ["31:16", "A: a", "RW", "0"], ["15:0", "B: b", "RW", "0"]], 6)])
    assert [f["bits"] for f in out[0]["fields"]] == ["31:16", "15:0"] and out[0]["page_end"] == 6


def test_rows_go_back_to_the_register_before(spark):
    out = extract(spark, [heading("P: ONE Register", 3), text("Offset: 0x0"), table([HEAD, ["31:8", "A: a", "RW", "0"]]), heading("P: TWO Register", 3), text("Offset: 0x4"), table([HEAD, ["7:0", "B: b", "RW", "0"]]), table([HEAD, ["31:0", "C: c", "RW", "0"]])])
    assert [[f["name"] for f in r["fields"]] for r in out] == [["A", "B"], ["C"]]


def test_name_repeated_on_next_page(spark):
    out = extract(spark, [heading("P: ONE Register", 3), text("Offset: 0x0"), text("Table 3. ONE Register"), table([HEAD, ["31:0", "A: a", "RW", "0"]])])
    assert len(out) == 1


def test_single_unnamed_field(spark):
    out = extract(spark, [heading("P: ONE Register", 3), text("Offset: 0x0"), table([HEAD, ["31:0", "", "RW", "0"]])])
    assert out[0]["fields"][0]["name"] == "ONE"


def test_label_heading_keeps_register_open(spark):
    out = extract(spark, [heading("P: ONE Register", 3), text("Offset: 0x0"), heading("Description", 3), table([HEAD, ["31:0", "A: a", "RW", "0"]])])
    assert out[0]["confidence"] == "good"


def test_offset_as_heading(spark):
    out = extract(spark, [heading("P: ONE Register", 3), heading("Offset : 0x08", 3), table([HEAD, ["31:0", "A: a", "RW", "0"]])])
    assert (out[0]["offset"], out[0]["peripheral"]) == ("0x08", "P")


def test_ordinary_captions_name_nothing(spark):
    assert extract(spark, [text("Table 3. List of pins"), text("Figure 2. Clock"), text("This register is fast.")]) == []


def test_shifted_cells(spark):
    out = extract(spark, [heading("P: ONE Register", 3), text("Offset: 0x0"), table([HEAD, ["11:8", "TICK_RELOAD: reload the", "SC", "0"], ["7:4", "counter. RUN_ONCE : Set to run", "SC", "0"]])])
    assert [(f["name"], f["desc"]) for f in out[0]["fields"]] == [("TICK_RELOAD", "reload the counter."), ("RUN_ONCE", "Set to run")]


def entries(spark, rows):
    return memmap.merge(memmap.entries(blocks(spark, rows))).orderBy("base", "name").collect()


def test_sentences(spark):
    one = entries(spark, [heading("DMA", 2, "2.5"), text("The DMA registers start at a base address of 0x50000000 (defined as DMA_BASE in SDK)", 90)])
    assert [(e["name"], e["base"], e["page"], e["section"], e["source"]) for e in one] == [("DMA", "0x50000000", 90, "2.5", "text")]
    two = entries(spark, [text("The PLL_SYS and PLL_USB registers start at base addresses of 0x40028000 and 0x4002c000 respectively (defined as PLL_SYS_BASE and PLL_USB_BASE in SDK)")])
    assert [(e["name"], e["base"]) for e in two] == [("PLL_SYS", "0x40028000"), ("PLL_USB", "0x4002c000")]


def test_tables(spark):
    got = entries(spark, [table([["IO_BANK0_BASE", "0x40014000"], ["XOSC_BASE", "0x40024000"], ["other", "x"]])])
    assert [e["name"] for e in got] == ["IO_BANK0", "XOSC"]
    got = entries(spark, [table([["Boundary address", "Peripheral", "Bus"], ["0x4002 1000 - 0x4002 13FF", "RCC", "AHB1"], ["0x4002 2000 - 0x4002 23FF", "Reserved", ""], ["0x4000 0000 - 0x4000 03FF", "TIM2 / TIM3", "APB1"]])])
    assert [(e["name"], e["base"], e["end"], e["bus"]) for e in got] == [("TIM2", "0x40000000", "0x400003ff", "APB1"), ("TIM3", "0x40000000", "0x400003ff", "APB1"), ("RCC", "0x40021000", "0x400213ff", "AHB1")]


def test_bases_past_32_bits(spark):
    got = entries(spark, [table([["LOW_BASE", "0x40014000"], ["HIGH_BASE", "0x100004000"], ["TOP_BASE", "0xFFFF000012345678"]])])
    assert {e["name"]: e["base"] for e in got} == {"LOW": "0x40014000", "HIGH": "0x100004000", "TOP": "0xffff000012345678"}
    got = entries(spark, [table([["Base address", "Peripheral"], ["0x10000 4000 - 0x10000 4FFF", "A"], ["0x123456789A - 0x123456789F", "B"]])])
    assert {e["name"]: (e["base"], e["end"]) for e in got} == {"A": ("0x100004000", "0x100004fff"), "B": ("0x123456789a", "0x123456789f")}


def test_conflicts(spark):
    rows = [table([["UART0_BASE", "0x40034000"]], 3), text("The UART0 registers start at a base address of 0x40034000", 9), text("The UART0 registers start at a base address of 0x50000000", 10)]
    e = entries(spark, rows)[0]
    assert (e["source"], e["page"]) == ("text", 9)
    assert [(c["base"], c["page"]) for c in e["conflicts"]] == [("0x50000000", 10)]
    assert [(c["page"], c["source"]) for c in e["also"]] == [(3, "table")]


def linked(spark, regs, entries_):
    r = spark.createDataFrame([("d", str(k), *x) for k, x in enumerate(regs)], "doc_id string, rid string, name string, peripheral string, section string, offset string, address string")
    m = spark.createDataFrame([("d", *x) for x in entries_], "doc_id string, name string, base string, section string, source string")
    return {x["name"]: x for x in link.link(r, m).collect()}


def test_link(spark):
    m = [("PLL_SYS", "0x40028000", "", "table"), ("PLL_USB", "0x4002c000", "", "table"), ("DMA", "0x50000000", "", "table"), ("GPIOA", "0x40020000", "", "table")]
    got = linked(spark, [("CS", "PLL", "2.1", "0x00", None), ("CH0", "DMA", "2.5", "0x10", None), ("PRINTED", "DMA", "2.5", "0x14", "0x50000099"), ("NONE", "ZZZ", "1", "0x0", None), ("NOOFF", "DMA", "1", None, None), ("MODER", "GPIOx", "1", "0x4", None)], m)
    assert got["CS"]["bases"] == {"PLL_SYS": "0x40028000", "PLL_USB": "0x4002c000"} and got["CS"]["address"] is None
    assert got["CH0"]["address"] == "0x50000010" and got["PRINTED"]["address"] == "0x50000099"
    assert not got["NONE"]["linked"] and not got["NOOFF"]["linked"]
    assert got["MODER"]["address"] == "0x40020004"


def test_section_beats_name(spark):
    got = linked(spark, [("CTRL", "XIP", "2.6.3", "0x00", None)], [("XIP", "0x10000000", "", "table"), ("XIP_CTRL", "0x14000000", "2.6", "text")])
    assert got["CTRL"]["bases"] == {"XIP_CTRL": "0x14000000"}


def test_verify(spark):
    fields = [("4:0", "FUNCSEL", "", "RW", "0x1f"), ("5", "Reserved", "", "-", "-"), ("8", "OUT", "", "RW", "0x3")]
    page = "GPIO0_CTRL Register Offset: 0x004 FUNCSEL: function RW 0x1f"
    regs = spark.createDataFrame(
        [("d", "a", "GPIO0_CTRL", "0x4", None, False, 1, 1, fields[:2]), ("d", "b", "GPIO1_CTRL", "0x00c", "0x5", False, 1, 1, fields), ("d", "c", "GPIO7_CTRL", "0x99", None, True, 1, 1, fields[:1]), ("d", "e", "X", None, None, False, 0, 0, [])],
        "doc_id string, rid string, name string, offset string, reset string, derived boolean, page int, page_end int, fields array<struct<bits:string,name:string,desc:string,access:string,reset:string>>",
    )
    texts = spark.createDataFrame([("d", 1, page)], "doc_id string, page int, text string")
    got = {r["rid"]: r for r in verify.registers(regs, texts).collect()}
    assert got["a"]["verify"] == "ok" and got["c"]["verify"] == "ok" and got["e"]["verify"] == "unchecked"
    assert got["b"]["verify_missing"] == ["name", "offset", "reset", "field:OUT"]


def test_field_reset_must_follow_the_definition(spark):
    regs = spark.createDataFrame([("d", "a", "R_X", None, None, False, 1, 1, [("0", "EN", "", "RW", "0x7")])], "doc_id string, rid string, name string, offset string, reset string, derived boolean, page int, page_end int, fields array<struct<bits:string,name:string,desc:string,access:string,reset:string>>")
    texts = lambda t: spark.createDataFrame([("d", 1, t)], "doc_id string, page int, text string")
    assert verify.registers(regs, texts("0x7 R_X EN: enable")).first()["verify_missing"] == ["field_reset:EN=0x7"]
    assert verify.registers(regs, texts("code EN R_X EN: enable 0x7")).first()["verify"] == "ok"


def test_lookup_tiers(spark):
    r = spark.createDataFrame([("d", "A_CTRL", "A", 1), ("d", "A_CTRL2", "A", 2), ("d", "B", "A_CTRL", 3)], "doc_id string, name string, peripheral string, block_ix long")
    assert [x["name"] for x in registers.lookup(r, "a_ctrl").collect()] == ["A_CTRL"]
    assert {x["name"] for x in registers.lookup(r, "ctrl").collect()} == {"A_CTRL", "A_CTRL2", "B"} - {"B"}
    assert {x["name"] for x in registers.lookup(r, "a").collect()} == {"A_CTRL", "A_CTRL2"}


def test_empty(spark):
    b = blocks(spark, [])
    assert registers.extract(b).count() == 0 and memmap.merge(memmap.entries(b)).count() == 0
    assert F is not None


def test_range_tables_of_long_addresses(spark, tmp_path):
    from docloom.plans.register_queries import QUERIES

    spark.createDataFrame([(1, 1), (720_900, 1)], "c_custkey bigint, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    got = QUERIES["memmap_boundary_table"](spark, str(tmp_path)).orderBy("ix").collect()
    assert [(r["name"], r["base"], r["end"]) for r in got] == [("C1", "0x50001000", "0x50001fff"), ("C720900", "0x100004000", "0x100004fff"), ("D720900", "0x100004000", "0x100004fff")]
