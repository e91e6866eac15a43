"""Scalar column functions for headings, identifiers, addresses and bit ranges. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and limits that results depend on.
#: Parts of a section's number have four digits at most; four of which one has three are a network address.
HEADING = r"(?is)^\s*(?:(?:chapter|section|appendix)\s+)?(?!(?=[\d.]*\d{3})\d{1,3}(?:\.\d{1,3}){3}\.?\s)([A-Z]?\d{1,4}(?:\.\d{1,4})*)\.?\s+(\S.*)$"
LEADER = r"(?:\.\s?){6,}"
CONTENTS_TITLE = r"(?i)^(?:table\s+of\s+contents|contents|list\s+of\s+(?:tables|figures|examples))$"
DOC_PREFIX = r"^([a-z]{1,4}[0-9]{3,5})"
FULL_CHARS = 450
#: What Python's str.strip() takes away.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def fix_text(text: Column) -> Column:
    """Joins identifiers that were parted before an underscore: "PLL _SYS" becomes "PLL_SYS"."""
    return F.regexp_replace(text, "(?<=[A-Za-z0-9]) _(?=[A-Za-z0-9])", "_")


def heading_section(text: Column) -> Column:
    """The section number of a heading, or ''."""
    return F.regexp_extract(F.trim(text), HEADING, 1)


def heading_title(text: Column) -> Column:
    numbered = F.regexp_extract(F.trim(text), HEADING, 2)
    return F.when(heading_section(text) != "", F.trim(numbered)).otherwise(F.trim(text))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def slugify(text: Column, most: int) -> Column:
    begin = F.regexp_extract(text, f"^[^A-Za-z0-9]*((?:[A-Za-z0-9][^A-Za-z0-9]*){{0,{most + 1}}})", 1)  # what follows is cut off anyway
    dashed = F.lower(F.regexp_replace(F.regexp_replace(begin, "[^A-Za-z0-9]+", "-"), "-+$", ""))
    cut = F.regexp_replace(F.substring(dashed, 1, most), "-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("section"))


def doc_id_from_name(name: Column) -> Column:
    stem = F.lower(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""))
    known = F.regexp_extract(stem, DOC_PREFIX, 1)
    return F.when(known != "", known).otherwise(slugify(stem, 24))


def leader_share(cells: Column) -> Column:
    """Share of non-blank cells or lines with dot leaders; 0 if there are none."""
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    return F.when(F.size(filled) == 0, F.lit(0.0)).otherwise(F.size(F.filter(filled, lambda c: c.rlike(LEADER))) / F.size(filled))


def hex_plain(text: Column) -> Column:
    """Register form of a hex number: no blanks, no underscores, lower case, no padding."""
    return F.lower(F.regexp_replace(F.trim(text), "[ _]", ""))


def hex_padded(text: Column) -> Column:
    """Memory-map form: eight digits at least; longer numbers stay whole."""
    digits = F.substring(hex_plain(text), 3, 100)
    return F.concat(F.lit("0x"), F.when(F.length(digits) >= 8, digits).otherwise(F.lpad(digits, 8, "0")))


def hex_value(text: Column) -> Column:
    """The number a hex string stands for; null if it isn't one."""
    return F.when(text.rlike("^0x[0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 100), 16, 10).cast("bigint"))


def to_hex(number: Column, width: int) -> Column:
    digits = F.lower(F.hex(number))
    return F.concat(F.lit("0x"), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def bits(text: Column) -> Column:
    """[31-16], 31 – 16 and 31:16 all become 31:16."""
    bare = F.regexp_replace(F.trim(text), r"^\[+|\]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s*[\-–]\s*", ":"), r"\s*:\s*", ":")


def bit_high(text: Column) -> Column:
    return F.coalesce(F.element_at(F.split(text, ":"), 1).try_cast("int"), F.lit(-1))


def bit_low(text: Column) -> Column:
    return F.coalesce(F.element_at(F.split(text, ":"), -1).try_cast("int"), F.lit(-1))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\s*,\s*|\s+and\s+"), lambda x: F.trim(x)), lambda p: p != "")


def squeezed(text: Column) -> Column:
    """Page text and names as verification compares them: no white space or underscores, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s_]+", ""))


def hex_variants(text: Column) -> Column:
    """The ways a number may be printed: as it is, bare, and padded to 2, 3, 4 and 8 digits."""
    n = squeezed(text)
    digits = F.coalesce(F.nullif(F.regexp_replace(F.substring(n, 3, 100), "^0+", ""), F.lit("")), F.lit("0"))
    padded = [F.concat(F.lit("0x"), F.when(F.length(digits) >= w, digits).otherwise(F.lpad(digits, w, "0"))) for w in (2, 3, 4, 8)]
    return F.when(n.startswith("0x"), F.array_sort(F.array_distinct(F.array(n, F.concat(F.lit("0x"), digits), *padded)))).otherwise(F.array(n))


def cut_at_word(text: Column, most: int = FULL_CHARS) -> Column:
    cut = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, " [^ ]*$", ""), F.lit(" …")))


def clamp_pages(first: Column, last: Column, pages: Column) -> Column:
    """How many pages of a document a page range takes in."""
    return F.greatest(F.lit(0), F.least(last, pages) - F.greatest(first, F.lit(1)) + 1)


_ELLIPSIS = r"^(?:…|\.\.\.|\x{FFFD})$"
_ID = r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*$"
_NUMBERED = r"^(.*?)(\d+)([A-Z0-9_]*)$"


def expand_names(items: Column) -> Column:
    """Members of "A0_X, A1_X, …, A9_X" as an array of (name, derived); listed names alone if they form no run."""
    names = F.filter(items, lambda x: x.rlike(_ID))
    first, last = F.element_at(names, 1), F.element_at(names, -1)
    part = lambda x, k: F.regexp_extract(x, _NUMBERED, k)
    lo, hi = part(first, 2).try_cast("int"), part(last, 2).try_cast("int")
    run = F.exists(items, lambda x: x.rlike(_ELLIPSIS)) & (F.size(names) >= 2) & (part(first, 1) == part(last, 1)) & (part(first, 3) == part(last, 3)) & (hi > lo) & (hi - lo <= 512)
    listed = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(False).alias("derived")))
    made = F.transform(F.sequence(F.coalesce(lo, F.lit(0)), F.greatest(F.coalesce(hi, F.lit(0)), F.coalesce(lo, F.lit(0)))), lambda i: F.concat(part(first, 1), i.cast("string"), part(first, 3)))
    whole = F.transform(made, lambda n: F.struct(n.alias("name"), (~F.array_contains(names, n)).alias("derived")))
    return F.when(F.size(names) == 0, F.array().cast("array<struct<name:string,derived:boolean>>")).when(F.coalesce(run, F.lit(False)), whole).otherwise(listed)


def expand_offsets(items: Column, count: Column) -> Column:
    """Offsets of a family of `count` members from "0x000, 0x008, …": as listed unless an ellipsis and a stride > 0 go on."""
    hexes = F.transform(F.filter(items, lambda x: F.lower(x).startswith("0x")), hex_plain)
    a, b = hex_value(F.try_element_at(hexes, F.lit(1))), hex_value(F.try_element_at(hexes, F.lit(2)))
    width = F.greatest(F.length(F.try_element_at(hexes, F.lit(1))) - 2, F.lit(3))
    goes_on = F.exists(items, lambda x: x.rlike(_ELLIPSIS)) & (F.size(hexes) >= 2) & (count > F.size(hexes)) & (b > a)

    def member(i: Column) -> Column:
        digits = F.lower(F.hex(a + (b - a) * i))
        return F.concat(F.lit("0x"), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, F.lit("0"))))

    return F.when(F.coalesce(goes_on, F.lit(False)), F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), member)).otherwise(hexes)
