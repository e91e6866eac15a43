"""Registers, memory maps, links and verification over manuals made from suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import catalog, link, lookup, memmap, verify
from docloom.operators import registers as R
from docloom.sources import adapters as A
from docloom.sources import shared


def _blocks(s, d):  # noqa: ANN001, ANN202
    return A.register_blocks(s, d)


def _regs(s, d):  # noqa: ANN001, ANN202
    """Written once in a session: links and checks read them often."""
    return shared.stored(R.extract(_blocks(s, d)).withColumn("rid", F.concat_ws(":", "block_ix", "name")), "registers", d)


def _map(s, d):  # noqa: ANN001, ANN202
    return shared.stored(memmap.merge(memmap.entries(_blocks(s, d))), "memmap", d)


def _linked(s, d):  # noqa: ANN001, ANN202
    return link.link(_regs(s, d), _map(s, d))


def _verified(s, d):  # noqa: ANN001, ANN202
    return verify.registers(_linked(s, d), A.page_texts(_blocks(s, d)))


def _verified_map(s, d):  # noqa: ANN001, ANN202
    return verify.memmap(_map(s, d), A.page_texts(_blocks(s, d)))


def _fields(s, d):  # noqa: ANN001, ANN202
    """Bit paragraphs made from line items."""
    li = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Bits 31"), F.when(F.col("l_linenumber") % 2 == 0, ":").otherwise(" - "), (16 + F.col("l_linenumber")).cast("string"), F.lit(" Q"), F.col("l_linenumber").cast("string"), F.lit(": ships  in "), F.col("l_returnflag"), F.lit("\n \nno field\n\nBit 3 Reserved, must be kept\n\nBits 2:0 "), F.col("l_linestatus"), F.lit(" - mode")).alias("text"))
    return li.select("l_orderkey", "l_linenumber", F.posexplode(R.fields_from_text(F.col("text"))).alias("k", "f")).select("l_orderkey", "l_linenumber", "k", "f.bits", "f.name", "f.desc")


def _rows(s, d):  # noqa: ANN001, ANN202
    return _blocks(s, d).where("kind = 'table'").select("doc_id", "block_ix", F.posexplode(R.table_rows(F.col("grid"))).alias("k", "f")).select("doc_id", "block_ix", "k", "f.bits", "f.name", "f.desc", "f.access", "f.reset")


def _tables(s, d, kind: str):  # noqa: ANN001, ANN202
    """Tables of defines or of address ranges, a row for each customer of a nation."""
    c = A.table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), "c_custkey", X.to_hex(F.lit(0x50000000) + F.col("c_custkey") * 4096, 8).alias("a"), X.to_hex(F.lit(0x50000FFF) + F.col("c_custkey") * 4096, 8).alias("z"))
    k = F.col("c_custkey").cast("string")
    split = lambda a: F.concat(F.substring(a, F.lit(1), F.length(a) - 4), F.lit(" "), F.right(a, F.lit(4)))
    row = F.array(F.concat(F.lit("C"), k, F.lit("_BASE")), F.col("a")) if kind == "defines" else F.array(F.concat(split(F.col("a")), F.lit(" - "), split(F.col("z"))), F.when(F.col("c_custkey") % 7 == 0, "Reserved").when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("C"), k, F.lit(" / D"), k)).otherwise(F.concat(F.lit("C"), k)), F.lit("AHB1"))
    rows = c.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]).alias("g"))
    grid = F.col("g") if kind == "defines" else F.concat(F.array(F.array(F.lit("Boundary address"), F.lit("Peripheral"), F.lit("Bus"))), F.col("g"))
    return rows.select("doc_id", F.lit(0).cast("bigint").alias("block_ix"), F.lit("table").alias("kind"), F.lit("").alias("text"), F.lit(3).alias("page"), F.lit(0).alias("level"), F.lit("").alias("sec"), F.lit("").alias("title"), grid.alias("grid"))


def _clashes(s, d):  # noqa: ANN001, ANN202
    """Entries made from orders: names that agree and differ, from tables and texts."""
    o = A.table(s, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select((c % 3).cast("string").alias("doc_id"), k.alias("ix"), F.concat(F.lit("N"), (c % 50).cast("string")).alias("name"), X.to_hex(k % 2 * 4096, 8).alias("base"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("bus"), (k % 90).cast("int").alias("page"), F.lit("2").alias("section"), F.when(k % 4 == 0, "text").otherwise("table").alias("source"), F.lit(None).cast("string").alias("desc"))


_SHOW = ("doc_id", "name", "peripheral", "offset", "reset", "address", "section", "page", "page_end", "family", "derived", "confidence", "table_id")


def _regs_shown(df):  # noqa: ANN001, ANN202
    return df.select(*_SHOW, F.size("fields").alias("n_fields"), F.array_join(F.transform("fields", lambda f: F.concat_ws("|", f["bits"], f["name"], f["desc"], f["access"], f["reset"])), ";").alias("fields"))


QUERIES = {
    "fields_from_text": _fields,
    "field_rows": _rows,
    "register_fold": lambda s, d: _regs_shown(R.extract(_blocks(s, d))),
    "reg_lookup_exact": lambda s, d: R.lookup(_regs(s, d), "r7_ctrl").select("doc_id", "name", "tier"),
    "reg_lookup_partial": lambda s, d: R.lookup(_regs(s, d), "p3", n=20).select("doc_id", "name", "peripheral", "tier"),
    "reg_format": lambda s, d: _regs(s, d).select("doc_id", "rid", R.formatted(["offset"]).alias("line")),
    "memmap_sentence": lambda s, d: memmap.entries(_blocks(s, d)).select("doc_id", "ix", "name", "base", "section", "source", "desc"),
    "memmap_define_table": lambda s, d: memmap.entries(_tables(s, d, "defines")).select("doc_id", "ix", "name", "base", "source", "page"),
    "memmap_boundary_table": lambda s, d: memmap.entries(_tables(s, d, "ranges")).select("doc_id", "ix", "name", "base", "end", "bus", "source"),
    "memmap_dedup_conflicts": lambda s, d: memmap.merge(_clashes(s, d)).select("doc_id", "name", "base", "page", "source", F.size("conflicts").alias("n_conflicts"), F.array_join(F.transform("conflicts", lambda c: F.concat_ws("@", c["base"], c["page"].cast("string"))), ",").alias("conflicts"), F.array_join(F.transform("also", lambda c: F.concat_ws("@", c["source"], c["page"].cast("string"))), ",").alias("also")),
    "map_lookup": lambda s, d: memmap.lookup(_map(s, d), "p1", n=1000).select("doc_id", "name", "base"),
    "map_list": lambda s, d: memmap.lookup(_map(s, d), n=60).select("doc_id", "name", "base"),
    "link_section": lambda s, d: _linked(s, d).select("doc_id", "rid", "address", "linked", F.map_keys("bases")[0].alias("instance")),
    "link_instance": lambda s, d: link.link(_regs(s, d).withColumn("section", F.lit("9999")), _map(s, d).withColumn("name", F.concat("name", F.lit("_A")))).select("doc_id", "rid", "address", "linked", F.map_keys("bases")[0].alias("instance")),
    "instance_addresses": lambda s, d: link.instance_addresses(_linked(s, d)).select("doc_id", "name", "instance", "base", "address"),
    "verify_register": lambda s, d: _verified(s, d).select("doc_id", "rid", "verify", F.array_join("verify_missing", ",").alias("missing"), F.col("resets_checked").cast("bigint").alias("resets_checked")),
    "verify_memmap": lambda s, d: _verified_map(s, d).select("doc_id", "name", "verify", F.array_join("verify_missing", ",").alias("missing")),
    "verify_summary": lambda s, d: verify.summary(_verified(s, d), _verified_map(s, d)),
    "qa_report": lambda s, d: catalog.qa_report(_verified(s, d), _verified_map(s, d)),
    "strict_gate": lambda s, d: catalog.strict_gate(verify.summary(_verified(s, d), _verified_map(s, d)), _grades(s, d)),
    "first_registers": lambda s, d: lookup.first_registers(_regs(s, d)).select("doc_id", "name", "page"),
}


def _grades(s, d):  # noqa: ANN001, ANN202
    g = A.table(s, d, "supplier").select(F.concat(F.lit("man"), F.col("s_nationkey").cast("string")).alias("doc_id"), F.col("s_suppkey").cast("int").alias("page"), F.when(F.col("s_suppkey") % 41 == 0, "POOR").when(F.col("s_suppkey") % 37 == 0, "fair").otherwise("good").alias("grade"))
    return catalog.low_pages(g)


QUERIES["low_pages"] = lambda s, d: _grades(s, d).select("doc_id", F.array_join("low_pages", ",").alias("low_pages"))

# Every register's figures follow from its part and supplier.
_REG = """n AS (SELECT count(*) AS n FROM supplier),
r AS (SELECT 'man' || s_nationkey AS doc_id, s_suppkey AS k, p_partkey AS p, 'R' || p_partkey || '_CTRL' AS name, 'P' || s_suppkey AS peripheral, printf('0x%03x', 4 * (p_partkey % 1024)) AS "offset", printf('0x%08x', p_size) AS reset,
    CAST(s_suppkey AS VARCHAR) AS section, CAST(s_suppkey AS INT) AS page, p_size, (s_suppkey * 10000000 + p_partkey * 10 + 2) || ':R' || p_partkey || '_CTRL' AS rid, printf('0x%08x', 1073741824 + s_suppkey * 16384) AS base, printf('0x%08x', 1073741824 + s_suppkey * 16384 + 4 * (p_partkey % 1024)) AS address
    FROM supplier, n, part WHERE p_partkey % n.n + 1 = s_suppkey)"""
_SUP = "m AS (SELECT 'man' || s_nationkey AS doc_id, s_suppkey AS k, 'P' || s_suppkey AS name, printf('0x%08x', 1073741824 + s_suppkey * 16384) AS base FROM supplier)"
_CUST = "cu AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, c_custkey AS k, printf('0x%08x', 1342177280 + c_custkey * 4096) AS a, printf('0x%08x', 1342181375 + c_custkey * 4096) AS z FROM customer)"
ORACLES = {
    "fields_from_text": """SELECT l_orderkey, l_linenumber, CAST(k AS INT) AS k, CASE k WHEN 0 THEN '31:' || (16 + l_linenumber) WHEN 1 THEN '3' ELSE '2:0' END AS bits, CASE k WHEN 0 THEN 'Q' || l_linenumber WHEN 1 THEN 'Reserved' ELSE l_linestatus END AS name,
CASE k WHEN 0 THEN 'ships in ' || l_returnflag WHEN 1 THEN 'Reserved, must be kept' ELSE 'mode' END AS desc FROM lineitem, (SELECT unnest([0, 1, 2]) AS k)""",
    "field_rows": f"WITH {_REG} SELECT doc_id, k * 10000000 + p * 10 + 5 AS block_ix, CAST(j AS INT) AS k, CASE j WHEN 0 THEN '31:16' ELSE '15:0' END AS bits, CASE j WHEN 0 THEN 'SIZE' ELSE '' END AS name, CASE j WHEN 0 THEN 'Size  of part ' || p ELSE 'KEY: key ' || p END AS desc, CASE j WHEN 0 THEN 'RW' ELSE 'RO' END AS access, CASE j WHEN 0 THEN printf('0x%x', p_size) ELSE '-' END AS reset FROM r, (SELECT unnest([0, 1]) AS j)",
    "register_fold": f"WITH {_REG} SELECT doc_id, name, peripheral, \"offset\", reset, CAST(NULL AS VARCHAR) AS address, section, page, page AS page_end, CAST(NULL AS VARCHAR) AS family, false AS derived, 'good' AS confidence, 't' || p AS table_id, CAST(2 AS INT) AS n_fields, '31:16|SIZE|Size of part ' || p || '|RW|' || printf('0x%x', p_size) || ';15:0|KEY|key ' || p || '|RO|-' AS fields FROM r",
    "reg_lookup_exact": f"WITH {_REG} SELECT doc_id, name, CAST(0 AS INT) AS tier FROM r WHERE name = 'R7_CTRL'",
    "reg_lookup_partial": f"WITH {_REG} SELECT doc_id, name, peripheral, CAST(1 AS INT) AS tier FROM r WHERE contains(name, 'P3') OR peripheral = 'P3' ORDER BY doc_id, name LIMIT 20",
    "reg_format": f"WITH {_REG} SELECT doc_id, rid, name || ' [' || doc_id || ' §' || section || ' p.' || page || '] offset ' || \"offset\" || ' reset ' || reset || ': [31:16] SIZE, [15:0] KEY' AS line FROM r",
    "memmap_sentence": f"WITH {_SUP} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS ix, name, base, CAST(k AS VARCHAR) AS section, 'text' AS source, name AS desc FROM m",
    "memmap_define_table": f"WITH {_CUST} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS ix, 'C' || k AS name, a AS base, 'table' AS source, CAST(3 AS INT) AS page FROM cu",
    "memmap_boundary_table": f"WITH {_CUST}, e AS (SELECT *, unnest(CASE WHEN k % 7 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 5 = 0 THEN ['C' || k, 'D' || k] ELSE ['C' || k] END) AS name FROM cu) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, name) AS ix, name, a AS base, z AS \"end\", 'AHB1' AS bus, 'table' AS source FROM e",
    "memmap_dedup_conflicts": """WITH o AS (SELECT CAST(o_custkey % 3 AS VARCHAR) AS doc_id, o_orderkey AS ix, 'N' || (o_custkey % 50) AS name, printf('0x%08x', o_orderkey % 2 * 4096) AS base, CAST(o_orderkey % 90 AS INT) AS page, CASE WHEN o_orderkey % 4 = 0 THEN 'text' ELSE 'table' END AS source FROM orders),
f AS (SELECT *, first_value(base) OVER w AS fb, first_value(ix) OVER w AS fi, first_value(source) OVER w AS fs, first_value(page) OVER w AS fp FROM o WINDOW w AS (PARTITION BY doc_id, name ORDER BY ix)),
g AS (SELECT *, CASE WHEN fs = 'text' THEN fi ELSE coalesce(min(CASE WHEN base = fb AND source = 'text' THEN ix END) OVER (PARTITION BY doc_id, name), fi) END AS wi FROM f)
SELECT doc_id, name, max(fb) AS base, max(CASE WHEN ix = wi THEN page END) AS page, max(CASE WHEN ix = wi THEN source END) AS source, CAST(count(*) FILTER (base <> fb AND ix > wi) AS INT) AS n_conflicts,
coalesce(string_agg(base || '@' || page, ',' ORDER BY ix) FILTER (base <> fb AND ix > wi), '') AS conflicts, max(CASE WHEN wi <> fi THEN fs || '@' || fp ELSE '' END) AS also FROM g GROUP BY doc_id, name""",
    "map_lookup": f"WITH {_SUP}, t AS (SELECT *, CASE WHEN name = 'P1' THEN 0 WHEN contains(name, 'P1') THEN 1 END AS tier FROM m), u AS (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS best FROM t WHERE tier IS NOT NULL) SELECT doc_id, name, base FROM u WHERE tier = best ORDER BY base, name LIMIT 1000",
    "map_list": f"WITH {_SUP} SELECT doc_id, name, base FROM m ORDER BY base, name LIMIT 60",
    "link_section": f"WITH {_REG} SELECT doc_id, rid, address, true AS linked, peripheral AS instance FROM r",
    "link_instance": f"WITH {_REG} SELECT doc_id, rid, address, true AS linked, peripheral || '_A' AS instance FROM r",
    "instance_addresses": f"WITH {_REG} SELECT doc_id, name, peripheral AS instance, base, address FROM r",
    "verify_memmap": f"WITH {_SUP} SELECT doc_id, name, CASE WHEN k % 10 = 0 THEN 'mismatch' ELSE 'ok' END AS verify, CASE WHEN k % 10 = 0 THEN 'base' ELSE '' END AS missing FROM m",
    "first_registers": f"WITH {_REG} SELECT doc_id, name, page FROM r",
    "low_pages": "SELECT 'man' || s_nationkey AS doc_id, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FILTER (s_suppkey % 41 = 0 OR s_suppkey % 37 = 0), '') AS low_pages FROM supplier GROUP BY 1",
}
# Verification from the printed pages themselves: the text of a register's page and of the next one, numbers spoilt.
_PAGES = f"""{_REG}, bl AS (SELECT 'man' || s_nationkey AS doc_id, CAST(s_suppkey AS INT) AS page, 0 AS p, 0 AS o, s_suppkey || ' Unit ' || s_suppkey || ' (P' || s_suppkey || ')' AS t FROM supplier
    UNION ALL SELECT 'man' || s_nationkey, CAST(s_suppkey AS INT), 0, 1, 'The P' || s_suppkey || ' registers start at a base address of ' || printf('0x%08x', 1073741824 + s_suppkey * 16384) || ' (defined as P' || s_suppkey || '_BASE in SDK)' FROM supplier
    UNION ALL SELECT doc_id, page, p, 2, peripheral || ': ' || name || ' Register' FROM r UNION ALL SELECT doc_id, page, p, 3, 'Offset: ' || "offset" FROM r UNION ALL SELECT doc_id, page, p, 4, 'Reset value: ' || reset FROM r
    UNION ALL SELECT doc_id, page, p, 5, 'Bits Name Description Type Reset' || chr(10) || '31:16 SIZE Size  of part ' || p || ' RW ' || printf('0x%x', p_size) || chr(10) || '15:0  KEY: key ' || p || ' RO -' FROM r),
pt AS (SELECT doc_id, page, lower(regexp_replace(string_agg(CASE WHEN page % 10 = 0 THEN replace(t, '0x', '0y') ELSE t END, chr(10) ORDER BY p, o), '[\\s_]+', '', 'g')) AS t FROM bl GROUP BY doc_id, page),
tx AS (SELECT a.doc_id, a.page, a.t || coalesce(b.t, '') AS t FROM pt a LEFT JOIN pt b ON a.doc_id = b.doc_id AND b.page = a.page + 1),
hx AS (SELECT r.*, tx.t, list_transform(["offset", reset, printf('0x%x', p_size)], lambda h: list_distinct([h] || list_transform([1, 2, 3, 4, 8], lambda w: '0x' || repeat('0', CAST(greatest(0, w - length(ltrim(substr(h, 3), '0'))) AS INT)) || ltrim(substr(h, 3), '0')))) AS vs FROM r JOIN tx USING (doc_id, page)),
sp AS (SELECT *, list_slice(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 5) = 'size:'), 1, 40) AS defs, list_slice(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 4) = 'size'), 1, 40) AS spots FROM hx),
ms AS (SELECT *, list_filter([CASE WHEN NOT contains(t, lower(replace(name, '_', ''))) THEN 'name' END, CASE WHEN len(list_filter(vs[1], lambda v: contains(t, v))) = 0 THEN 'offset' END, CASE WHEN len(list_filter(vs[2], lambda v: contains(t, v))) = 0 THEN 'reset' END,
    CASE WHEN NOT contains(t, 'size') THEN 'field:SIZE' WHEN len(list_filter(CASE WHEN len(defs) > 0 THEN defs ELSE spots END, lambda i: len(list_filter(vs[3], lambda v: contains(substr(t, i, 1500), v))) > 0)) = 0 THEN 'field_reset:SIZE=' || printf('0x%x', p_size) END, CASE WHEN NOT contains(t, 'key') THEN 'field:KEY' END], lambda x: x IS NOT NULL) AS mi FROM sp),
vr AS (SELECT doc_id, rid, name, page, CASE WHEN len(mi) > 0 THEN 'mismatch' ELSE 'ok' END AS verify, mi, CAST(1 AS BIGINT) AS resets_checked FROM ms),
vm AS (SELECT 'man' || s_nationkey AS doc_id, 'P' || s_suppkey AS name, CAST(s_suppkey AS INT) AS page, CASE WHEN s_suppkey % 10 = 0 THEN 'mismatch' ELSE 'ok' END AS verify FROM supplier)"""
ORACLES |= {
    "verify_register": f"WITH {_PAGES} SELECT doc_id, rid, verify, array_to_string(mi, ',') AS missing, resets_checked FROM vr",
    "verify_summary": f"""WITH {_PAGES}, a AS (SELECT doc_id, count(*) FILTER (verify = 'ok') AS ok, count(*) FILTER (verify = 'mismatch') AS mismatch, CAST(sum(resets_checked) AS BIGINT) AS c FROM vr GROUP BY doc_id), b AS (SELECT doc_id, count(*) FILTER (verify = 'ok') AS mo, count(*) FILTER (verify = 'mismatch') AS mm FROM vm GROUP BY doc_id)
SELECT doc_id, coalesce(ok, 0) AS ok, coalesce(mismatch, 0) AS mismatch, CAST(0 AS BIGINT) AS unchecked, coalesce(c, 0) AS field_resets_checked, coalesce(mo, 0) AS memmap_ok, coalesce(mm, 0) AS memmap_mismatch FROM a FULL JOIN b USING (doc_id)""",
    "qa_report": f"WITH {_PAGES} SELECT * FROM (SELECT doc_id, 'register' AS what, name, page, array_to_string(mi[1:6], ', ') AS missing FROM vr WHERE verify = 'mismatch' ORDER BY doc_id, name LIMIT 200) UNION ALL SELECT * FROM (SELECT doc_id, 'memmap', name, page, 'base' FROM vm WHERE verify = 'mismatch' ORDER BY doc_id, name LIMIT 100)",
    "strict_gate": f"WITH {_PAGES}, a AS (SELECT doc_id, count(*) FILTER (verify = 'mismatch') AS x FROM (SELECT doc_id, verify FROM vr UNION ALL SELECT doc_id, verify FROM vm) GROUP BY doc_id), l AS (SELECT 'man' || s_nationkey AS doc_id, count(*) FILTER (s_suppkey % 41 = 0 OR s_suppkey % 37 = 0) AS l FROM supplier GROUP BY 1) SELECT doc_id, x = 0 AND l = 0 AS passed FROM a JOIN l USING (doc_id)",
}

QUERIES["register_layouts"] = lambda s, d: _regs_shown(R.extract(A.layout_blocks(s, d)))
QUERIES["verify_mismatches"] = lambda s, d: verify.mismatches(_verified(s, d), _verified_map(s, d)).select("doc_id", "what", "name", "page", F.array_join("missing", ",").alias("missing"))
QUERIES["reg_format_linked"] = lambda s, d: _addressed(s, d).select("doc_id", "rid", R.formatted(["bases", "file", "line"]).alias("line"))
QUERIES["reg_fields_shown"] = lambda s, d: R.field_lines(_regs(s, d)).select("doc_id", "name", "k", "line")


def _addressed(s, d):  # noqa: ANN001, ANN202
    """Linked registers of two instances each, cited by file and line."""
    linked = _linked(s, d)
    two = F.map_from_arrays(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("0x40000000"), F.lit("0x50000000")))
    return linked.withColumns({"bases": F.when(F.col("page") % 2 == 0, two).otherwise(F.col("bases")), "address": F.when(F.col("page") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("address")), "file": F.lit("01-x.md"), "line": F.col("page") + 7})


_LAY = """SELECT 'lay' || (p_partkey // 50) AS doc_id, p_partkey AS p, CAST(p_partkey * 10 AS INT) AS page FROM part"""
ORACLES["register_layouts"] = f"""WITH l AS ({_LAY}), x AS (
SELECT doc_id, 'GPIO' || i || '_C' || p AS name, 'IO' AS peripheral, printf('0x%03x', 8 * i) AS "offset", NULL AS reset, NULL AS address, CAST(p AS VARCHAR) AS section, page, page AS page_end, 'GPIO0_C' || p || '…GPIO7_C' || p AS family, i BETWEEN 2 AND 6 AS derived, 't' || p AS table_id, 2 AS n, '31:5|Reserved||-|-;4:0|FUNCSEL|function|RW|0x1f' AS fields FROM l, (SELECT unnest(range(8)) AS i) WHERE p % 5 = 0
UNION ALL SELECT doc_id, 'RCC' || p || '_CR', 'RCC' || p, printf('0x%02x', p % 64), printf('0x000000%02x', p % 256), NULL, p || '.1', page + 1, page + 2, NULL, false, NULL, 3, '31:28|Reserved|Reserved, must be kept;27|PLLRDY|ready;6:4|RANGE[2:0]|speed' FROM l WHERE p % 5 = 1
UNION ALL SELECT doc_id, 'TIM' || p || '_CTL', 'TIM' || p, '0x10', NULL, NULL, CAST(p AS VARCHAR), page, page + 1, NULL, false, 't' || p, 2, '31:16|A|a|RW|0;15:0|B|b|RW|0' FROM l WHERE p % 5 = 2
UNION ALL SELECT doc_id, 'ONE' || p || '_R', 'AUX', '0x04', NULL, printf('0x%08x', 1073741824 + p * 16), CAST(p AS VARCHAR), page, page, NULL, false, 't' || p, 1, '31:0|ONE' || p || '_R||RW|0x5' FROM l WHERE p % 5 = 3
UNION ALL SELECT doc_id, 'ONE' || p || 'X', 'P', '0x0', NULL, NULL, CAST(p AS VARCHAR), page, page, NULL, false, 't' || p, 1, '31:8|A|a|RW|0' FROM l WHERE p % 5 = 4
UNION ALL SELECT doc_id, 'TWO' || p || 'X', 'P', '0x4', NULL, NULL, CAST(p AS VARCHAR), page, page + 1, NULL, false, CAST(p AS VARCHAR), 3, '11:8|CLK_A|restart the divider.|SC|0;7:4|CLK_B|Write 1|SC|0;31:0|C|c|RW|0' FROM l WHERE p % 5 = 4)
SELECT doc_id, name, peripheral, "offset", reset, address, section, page, page_end, family, derived, 'good' AS confidence, table_id, CAST(n AS INT) AS n_fields, fields FROM x"""
ORACLES["verify_mismatches"] = f"WITH {_PAGES} SELECT doc_id, 'register' AS what, name, page, array_to_string(mi[1:6], ',') AS missing FROM vr WHERE verify = 'mismatch' UNION ALL SELECT doc_id, 'memmap', name, page, 'base' FROM vm WHERE verify = 'mismatch'"
ORACLES["reg_format_linked"] = f"""WITH {_REG} SELECT doc_id, rid, name || ' [' || doc_id || ' §' || section || ' p.' || page || ' sections/01-x.md:' || (page + 7) || '] offset ' || "offset" || ' reset ' || reset || ' @ ' || CASE WHEN page % 2 = 0 THEN 'A ' || printf('0x%08x', 1073741824 + 4 * (p % 1024)) || ', B ' || printf('0x%08x', 1342177280 + 4 * (p % 1024)) ELSE address END || ': [31:16] SIZE, [15:0] KEY' AS line FROM r"""
ORACLES["reg_fields_shown"] = f"""WITH {_REG} SELECT doc_id, name, CAST(k AS INT) AS k, CASE k WHEN 0 THEN '   31:16  ' || rpad('SIZE', 18, ' ') || ' RW reset=' || printf('0x%x', p_size) || '  Size of part ' || p ELSE '    15:0  ' || rpad('KEY', 18, ' ') || ' RO reset=-  key ' || p END AS line FROM (SELECT * EXCLUDE (k) FROM r), (SELECT unnest([0, 1]) AS k)"""
ORACLES["table_records"] = f"WITH {_REG} SELECT doc_id, 't' || p AS tid, section, 'Bits | Name | Description | Type | Reset' || chr(10) || '31:16 | SIZE | Size  of part ' || p || ' | RW | ' || printf('0x%x', p_size) || chr(10) || '15:0 | KEY: key ' || p || ' | RO | -' AS text FROM r"
