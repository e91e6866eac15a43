"""Scalar functions over strings made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.sources import adapters as A
from docloom.sources import readers as R


def _parts(spark, d):  # noqa: ANN001, ANN202
    return A.table(spark, d, "part")


def _docs(spark, d):  # noqa: ANN001, ANN202
    return A.table(spark, d, "documents")


def _k():  # noqa: ANN202
    return F.col("p_partkey")


def _s():  # noqa: ANN202
    return _k().cast("string")


QUERIES = {
    "fix_text": lambda s, d: _parts(s, d).select("p_partkey", X.fix_text(F.concat(F.lit("PLL _R"), _s(), F.lit(" _CS _x a _b _c and _d"))).alias("fixed")),
    "heading_parse": lambda s, d: _parts(s, d).withColumn("t", F.concat(F.element_at(F.array(*map(F.lit, ["", "Chapter ", "section ", "see "])), (_k() % 4 + 1).cast("int")), F.when(_k() % 5 == 0, "A").otherwise(""), (_k() % 30).cast("string"), F.when(_k() % 3 > 0, F.concat(F.lit("."), (_k() % 7).cast("string"))).otherwise(""), F.when(_k() % 2 == 0, ".").otherwise(""), F.lit("  "), F.col("p_name"))).select("p_partkey", X.heading_section(F.col("t")).alias("sec"), X.heading_title(F.col("t")).alias("title")),
    "slugify": lambda s, d: _docs(s, d).select("doc_id", X.slugify(F.col("text"), 32).alias("slug")),
    "doc_id_from_name": lambda s, d: _parts(s, d).select("p_partkey", X.doc_id_from_name(F.concat(F.lit("/data/"), F.when(_k() % 3 == 0, F.concat(F.lit("RP"), (_k() % 100000).cast("string"), F.lit("-datasheet"))).otherwise(F.col("p_name")), F.lit(".v"), _s(), F.lit(".pdf"))).alias("id")),
    "one_line": lambda s, d: _docs(s, d).select("doc_id", X.one_line(F.col("text")).alias("line")),
    "leader_share": lambda s, d: _docs(s, d).select("doc_id", F.round(X.leader_share(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(x, F.lit(" . . . . . . . 12"))).otherwise(x))), 6).alias("share")),
    "bits_normalise": lambda s, d: _parts(s, d).withColumn("b", F.element_at(F.array(F.concat(F.lit("["), F.lit("31"), F.lit(" : "), (_k() % 31).cast("string"), F.lit("]")), F.concat(F.lit("31 – "), (_k() % 31).cast("string")), F.concat((_k() % 32).cast("string"), F.lit("-0")), (_k() % 32).cast("string"), F.lit("none")), (_k() % 5 + 1).cast("int"))).select("p_partkey", X.bits(F.col("b")).alias("bits"), X.bit_high(X.bits(F.col("b"))).alias("hi"), X.bit_low(X.bits(F.col("b"))).alias("lo")),
    "hex_normalise": lambda s, d: _parts(s, d).withColumn("h", F.concat(F.lit(" 0x"), F.hex(_k() * 7919), F.when(_k() % 2 == 0, " 00Ff").otherwise("_AbCd1234"))).select("p_partkey", X.hex_plain(F.col("h")).alias("plain"), X.hex_padded(F.col("h")).alias("padded")),
    "hex_variants": lambda s, d: _parts(s, d).select("p_partkey", F.array_join(X.hex_variants(F.concat(F.lit("0x00"), F.hex(_k()))), ",").alias("variants")),
    "name_family_expand": lambda s, d: _parts(s, d).select("p_partkey", F.explode(X.expand_names(F.array(F.lit("GPIO0_CTRL"), F.lit("GPIO1_CTRL"), F.lit("…"), F.concat(F.lit("GPIO"), F.col("p_size").cast("string"), F.lit("_CTRL"))))).alias("m")).select("p_partkey", "m.name", "m.derived"),
    "offset_expand": lambda s, d: _parts(s, d).select("p_partkey", F.posexplode(X.expand_offsets(F.array(F.lit("0x000"), X.to_hex((_k() % 16).cast("bigint"), 3), F.lit("...")), F.col("p_size"))).alias("i", "offset")),
    "page_range_clamp": lambda s, d: _parts(s, d).select("p_partkey", X.clamp_pages((_k() % 9 - 2), (_k() % 50), F.col("p_size").cast("bigint")).alias("pages")),
    "content_hash": lambda s, d: _docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha256")),
    "html_blocks": lambda s, d: R.html_blocks(A.table(s, d, "pages")).select("doc_id", "block_ix", "kind", "level", "text"),
}

ORACLES = {
    "fix_text": r"SELECT p_partkey, regexp_replace(regexp_replace('PLL _R' || p_partkey || ' _CS _x a _b _c and _d', '([A-Za-z0-9]) _([A-Za-z0-9])', '\1_\2', 'g'), '([A-Za-z0-9]) _([A-Za-z0-9])', '\1_\2', 'g') AS fixed FROM part",
    "heading_parse": r"""WITH t AS (SELECT p_partkey, trim(['', 'Chapter ', 'section ', 'see '][p_partkey % 4 + 1] || CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE '' END || (p_partkey % 30) || CASE WHEN p_partkey % 3 > 0 THEN '.' || (p_partkey % 7) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '' END || '  ' || p_name) AS t FROM part),
s AS (SELECT p_partkey, t, regexp_extract(t, '(?i)^(?:(?:chapter|section|appendix)\s+)?([A-Z]?\d+(?:\.\d+)*)\.?\s+(\S.*)$', 1) AS sec, regexp_extract(t, '(?i)^(?:(?:chapter|section|appendix)\s+)?([A-Z]?\d+(?:\.\d+)*)\.?\s+(\S.*)$', 2) AS title FROM t)
SELECT p_partkey, sec, CASE WHEN sec <> '' THEN trim(title) ELSE t END AS title FROM s""",
    "slugify": r"WITH a AS (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS x FROM documents) SELECT doc_id, coalesce(nullif(regexp_replace(substr(x, 1, 32), '-+$', ''), ''), 'section') AS slug FROM a",
    "doc_id_from_name": r"""WITH n AS (SELECT p_partkey, lower(CASE WHEN p_partkey % 3 = 0 THEN 'RP' || (p_partkey % 100000) || '-datasheet' ELSE p_name END || '.v' || p_partkey) AS stem FROM part),
a AS (SELECT p_partkey, regexp_extract(stem, '^([a-z]{1,4}[0-9]{3,5})', 1) AS k, regexp_replace(regexp_replace(stem, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM n)
SELECT p_partkey, CASE WHEN k <> '' THEN k ELSE coalesce(nullif(regexp_replace(substr(x, 1, 24), '-+$', ''), ''), 'section') END AS id FROM a""",
    "one_line": r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM documents",
    "leader_share": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
m AS (SELECT doc_id, CASE WHEN i % 3 = 0 THEN x || ' . . . . . . . 12' ELSE x END AS x FROM l)
SELECT doc_id, round(coalesce(count(*) FILTER (trim(x) <> '' AND regexp_matches(x, '(?:\.\s?){6,}')) / nullif(count(*) FILTER (trim(x) <> ''), 0), 0), 6) AS share FROM m GROUP BY doc_id""",
    "bits_normalise": r"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '31:' || p_partkey % 31 WHEN 1 THEN '31:' || p_partkey % 31 WHEN 2 THEN (p_partkey % 32) || ':0' WHEN 3 THEN CAST(p_partkey % 32 AS VARCHAR) ELSE 'none' END AS bits,
CAST(CASE p_partkey % 5 WHEN 0 THEN 31 WHEN 1 THEN 31 WHEN 2 THEN p_partkey % 32 WHEN 3 THEN p_partkey % 32 ELSE -1 END AS INT) AS hi,
CAST(CASE p_partkey % 5 WHEN 0 THEN p_partkey % 31 WHEN 1 THEN p_partkey % 31 WHEN 2 THEN 0 WHEN 3 THEN p_partkey % 32 ELSE -1 END AS INT) AS lo FROM part""",
    "hex_normalise": "WITH h AS (SELECT p_partkey, printf('%x', p_partkey * 7919) || CASE WHEN p_partkey % 2 = 0 THEN '00ff' ELSE 'abcd1234' END AS x FROM part) SELECT p_partkey, '0x' || x AS plain, '0x' || repeat('0', greatest(0, 8 - length(x))) || x AS padded FROM h",
    "hex_variants": "WITH h AS (SELECT p_partkey, printf('%x', p_partkey) AS x FROM part), v AS (SELECT p_partkey, list_distinct(['0x00' || x, '0x' || x] || list_transform([2, 3, 4, 8], lambda n: '0x' || repeat('0', CAST(greatest(0, n - length(x)) AS INT)) || x)) AS v FROM h) SELECT p_partkey, array_to_string(list_sort(v), ',') AS variants FROM v",
    "name_family_expand": "SELECT p_partkey, name, derived FROM (SELECT p_partkey, 'GPIO' || i || '_CTRL' AS name, i NOT IN (0, 1, p_size) AS derived FROM (SELECT p_partkey, p_size, unnest(range(0, p_size + 1)) AS i FROM part WHERE p_size BETWEEN 1 AND 512) UNION ALL SELECT p_partkey, unnest(['GPIO0_CTRL', 'GPIO1_CTRL', 'GPIO' || p_size || '_CTRL']), false FROM part WHERE p_size NOT BETWEEN 1 AND 512)",
    "offset_expand": "SELECT p_partkey, CAST(i AS INT) AS i, printf('0x%03x', i * CASE WHEN p_partkey % 16 > 0 THEN p_partkey % 16 ELSE 0 END) AS offset FROM (SELECT p_partkey, unnest(range(0, CASE WHEN p_size > 2 AND p_partkey % 16 > 0 THEN p_size ELSE 2 END)) AS i FROM part)",
    "page_range_clamp": "SELECT p_partkey, greatest(0, least(p_partkey % 50, p_size) - greatest(p_partkey % 9 - 2, 1) + 1) AS pages FROM part",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "html_blocks": r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1\b[^>]*>.*?</h1>|<h2\b[^>]*>.*?</h2>|<h3\b[^>]*>.*?</h3>|<h4\b[^>]*>.*?</h4>|<h5\b[^>]*>.*?</h5>|<h6\b[^>]*>.*?</h6>|<p\b[^>]*>.*?</p>|<li\b[^>]*>.*?</li>')) AS x, unnest(range(len(regexp_extract_all(html, '(?is)<h1\b[^>]*>.*?</h1>|<h2\b[^>]*>.*?</h2>|<h3\b[^>]*>.*?</h3>|<h4\b[^>]*>.*?</h4>|<h5\b[^>]*>.*?</h5>|<h6\b[^>]*>.*?</h6>|<p\b[^>]*>.*?</p>|<li\b[^>]*>.*?</li>')))) AS i FROM pages),
t AS (SELECT *, lower(regexp_extract(x, '<([A-Za-z0-9]+)', 1)) AS tag FROM m)
SELECT CAST(page_id AS VARCHAR) AS doc_id, i AS block_ix, CASE WHEN tag[1] = 'h' THEN 'heading' WHEN tag = 'li' THEN 'list' ELSE 'text' END AS kind, CASE WHEN tag[1] = 'h' THEN CAST(tag[2] AS INT) ELSE 0 END AS level,
trim(regexp_replace(regexp_replace(regexp_replace(x, '(?s)^<[^>]*>|</[^>]*>$', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM t""",
}
