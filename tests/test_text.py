import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "fixed"), [("PLL _SYS", "PLL_SYS"), ("A _B _C", "A_B_C"), ("a _ b", "a _ b"), ("plain", "plain")])
def test_fix_text(spark, raw, fixed):
    assert one(spark, X.fix_text(F.lit(raw))) == fixed


@pytest.mark.parametrize(("raw", "sec", "title"), [("2.1.3. Clocks", "2.1.3", "Clocks"), ("Chapter 4 Power", "4", "Power"), ("A1.2 Notes", "A1.2", "Notes"), ("Overview", "", "Overview"), ("  7 X  ", "7", "X")])
def test_heading(spark, raw, sec, title):
    assert one(spark, X.heading_section(F.lit(raw))) == sec
    assert one(spark, X.heading_title(F.lit(raw))) == title


@pytest.mark.parametrize("raw", ["8294846167456848 Reading", "56.187.231.175 Reading", "12.5.2.168. Reading"])
def test_long_numbers_and_addresses_are_no_sections(spark, raw):
    assert one(spark, X.heading_section(F.lit(raw))) == ""
    assert one(spark, X.heading_title(F.lit(raw))) == raw


@pytest.mark.parametrize("raw", ["4.2.8.1 Reading", "3.118 Reading", "2040 Reading"])
def test_numbers_of_sections(spark, raw):
    assert one(spark, X.heading_section(F.lit(raw))) == raw.split(" ")[0]


@pytest.mark.parametrize(("raw", "out"), [("0x1", "0x00000001"), ("0x4002 1000", "0x40021000"), ("0x123456789A", "0x123456789a")])
def test_hex_padded(spark, raw, out):
    assert one(spark, X.hex_padded(F.lit(raw))) == out


@pytest.mark.parametrize(("raw", "out"), [("[31:16]", "31:16"), ("31 - 16", "31:16"), ("7 – 0", "7:0"), ("5", "5")])
def test_bits(spark, raw, out):
    assert one(spark, X.bits(F.lit(raw))) == out


def test_bit_ends(spark):
    assert one(spark, X.bit_high(F.lit("31:16"))) == 31
    assert one(spark, X.bit_low(F.lit("31:16"))) == 16
    assert one(spark, X.bit_low(F.lit("none"))) == -1


def test_family(spark):
    items = F.array(*map(F.lit, ["GPIO0_CTRL", "GPIO1_CTRL", "…", "GPIO29_CTRL"]))
    got = one(spark, X.expand_names(items))
    assert len(got) == 30
    assert [m["derived"] for m in got] == [i not in (0, 1, 29) for i in range(30)]
    got = one(spark, X.expand_names(F.array(*map(F.lit, ["A_X", "…", "B_X"]))))
    assert [m["name"] for m in got] == ["A_X", "B_X"]


def test_offsets(spark):
    items = F.array(*map(F.lit, ["0x000", "0x008", "…"]))
    got = one(spark, X.expand_offsets(items, F.lit(30)))
    assert got[7] == "0x038" and len(got) == 30
    assert one(spark, X.expand_offsets(F.array(F.lit("0x10")), F.lit(3))) == ["0x10"]


def test_hex_variants(spark):
    assert set(one(spark, X.hex_variants(F.lit("0x0063")))) == {"0x0063", "0x63", "0x063", "0x00000063"}


def test_slug_and_doc_id(spark):
    assert one(spark, X.slugify(F.lit("Clock & Reset!"), 32)) == "clock-reset"
    assert one(spark, X.slugify(F.lit("!!!"), 32)) == "section"
    assert one(spark, X.doc_id_from_name(F.lit("/x/RP2040-datasheet.pdf"))) == "rp2040"
    assert one(spark, X.doc_id_from_name(F.lit("User Manual.pdf"))) == "user-manual"


def test_cut_at_word(spark):
    assert one(spark, X.cut_at_word(F.lit("one two three"), 9)) == "one two …"
    assert one(spark, X.cut_at_word(F.lit("one"), 9)) == "one"


def test_nulls(spark):
    none = F.lit(None).cast("string")
    assert one(spark, X.fix_text(none)) is None
    assert one(spark, X.one_line(none)) == ""


def test_slugs_of_long_titles_need_their_begin_only(spark):
    """What is cut off is not worked on; blanks and signs before and between count as one dash however many they are."""
    df = spark.createDataFrame([("--A  b!c" + " - " * 5000 + "d" * 40,), ("x" * 32 + "-y",), ("x" * 31 + " -- ",), ("!?" * 900,), ("a " * 20,)], "t string")
    assert [r[0] for r in df.select(X.slugify(F.col("t"), 32)).collect()] == ["a-b-c-" + "d" * 26, "x" * 32, "x" * 31, "section", "-".join("a" * 16)]
    assert "regexp_extract" in df.select(X.slugify(F.col("t"), 32))._jdf.queryExecution().toString()
