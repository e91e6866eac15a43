"""Cleaning and hierarchy over documents as numbered lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import catalog as C
from docloom.operators import hierarchy as H
from docloom.sources import adapters as A

BLOCKS = """raw AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS block_ix FROM documents),
r2 AS (SELECT *, block_ix AS i, block_ix % 6 IN (0, 3, 4) AS h, CASE block_ix % 6 WHEN 0 THEN CAST(block_ix // 6 + 1 AS VARCHAR) WHEN 3 THEN (block_ix // 6 + 1) || '.1' ELSE '' END AS sec FROM raw),
r3 AS (SELECT *, CASE WHEN NOT h THEN '' WHEN i % 24 = 4 THEN 'Contents' ELSE line END AS title FROM r2),
b AS (SELECT doc_id, block_ix, CASE WHEN h THEN 'heading' ELSE 'text' END AS kind, CASE WHEN h THEN CASE WHEN sec <> '' THEN sec || ' ' ELSE '' END || title ELSE line END AS text, CAST(1 + i // 4 AS INT) AS page,
    CASE i % 6 WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS level, sec, title FROM r3)"""
_NUM = "last_value(CASE WHEN kind = 'heading' AND sec <> '' THEN sec END IGNORE NULLS) OVER (PARTITION BY {0} ORDER BY block_ix)"
_TITLE = "first_value(CASE WHEN kind = 'heading' AND sec = '' AND substr(title, 1, 40) <> '' THEN substr(title, 1, 40) END IGNORE NULLS) OVER (PARTITION BY {0} ORDER BY block_ix)"
_PARTS = "tp AS (SELECT *, min(CASE WHEN kind = 'heading' THEN level END) OVER (PARTITION BY doc_id) AS top FROM b), p AS (SELECT *, CAST(sum(CASE WHEN kind = 'heading' AND level = top THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_ix) AS BIGINT) AS part_ix FROM tp)"
_ANCHOR = "an AS (SELECT *, kind <> 'heading' AND page <> 0 AND page <> coalesce(last_value(CASE WHEN kind = 'heading' OR page <> 0 THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id, part_ix ORDER BY block_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS anchor FROM p)"
_LINES = "ln AS (SELECT *, CASE WHEN kind = 'heading' THEN 1 WHEN text = '' THEN 0 ELSE 1 END + 1 + CAST(anchor AS INT) AS took FROM an), lines AS (SELECT *, CAST(coalesce(sum(took) OVER (PARTITION BY doc_id, part_ix ORDER BY block_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 7 + CAST(anchor AS INT) + 1 AS INT) AS line FROM ln)"


def _blocks(s, d):  # noqa: ANN001, ANN202
    return A.line_blocks(s, d)


def _parts(s, d):  # noqa: ANN001, ANN202
    return H.parts_by_top_level(_blocks(s, d))


def _heads(s, d):  # noqa: ANN001, ANN202
    return H.line_numbers(_parts(s, d)).where("kind = 'heading'").select("doc_id", "block_ix", "sec", "title", "level", "page", F.col("part_ix").cast("string").alias("file"), "line")


def _section(rule: str):  # noqa: ANN202
    return lambda s, d: H.section_path(_parts(s, d), rule).select("doc_id", "block_ix", "section")


def _split(s, d):  # noqa: ANN001, ANN202
    return H.split_parts(_blocks(s, d)).groupBy("doc_id", "part_name").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text") + 2).alias("size"))


QUERIES = {
    "section_path_s1": _section("s1"),
    "section_path_s2": _section("s2"),
    "section_path_s3": _section("s3"),
    "section_path_s4": _section("s4"),
    "drop_toc": lambda s, d: H.drop_toc(_blocks(s, d)).select("doc_id", "block_ix", "part", "kind", F.md5("text").alias("digest")),
    "normalize_levels": lambda s, d: H.normalize_levels(_blocks(s, d)).select("doc_id", "block_ix", "level", "strategy"),
    "part_sizes": lambda s, d: H.part_sizes(_parts(s, d)),
    "page_anchor": lambda s, d: H.page_anchor(_parts(s, d)).select("doc_id", "block_ix", "anchor"),
    "line_number": lambda s, d: H.line_numbers(_parts(s, d)).select("doc_id", "block_ix", "line"),
    "index_headings": lambda s, d: H.index_headings(_heads(s, d)).select("doc_id", "block_ix", "level", "title"),
    "toc_whole": lambda s, d: H.toc(_heads(s, d), depth=1).select("doc_id", "block_ix", "sec"),
    "toc_subtree": lambda s, d: H.toc(_heads(s, d), "2").select("doc_id", "block_ix", "sec", "title"),
    "section_extent": lambda s, d: H.section_extent(_heads(s, d)).select("doc_id", "block_ix", "line", "line_end"),
    "section_find": lambda s, d: H.find_section(_heads(s, d), "§2.1").select("doc_id", "block_ix", "sec", "title"),
    "section_find_title": lambda s, d: H.find_section(_heads(s, d), "the").select("doc_id", "block_ix", "sec"),
    "build_counts": lambda s, d: C.block_counts(_blocks(s, d)).select("doc_id", "blocks", "headings", "tables", "figures", "numbered", "pages"),
    "render_lines": lambda s, d: H.markdown_lines(_parts(s, d)).select("doc_id", "block_ix", F.md5("md").alias("digest")),
    "search_records": lambda s, d: H.chunks(H.line_numbers(_parts(s, d))).select("doc_id", "rowid", "file", "line", "section", "kind"),
    "split_parts": _split,
}

_HEADS = f"WITH {BLOCKS}, {_PARTS}, {_ANCHOR}, {_LINES}, hd AS (SELECT *, CAST(part_ix AS VARCHAR) AS file FROM lines WHERE kind = 'heading')"
ORACLES = {
    "section_path_s1": f"WITH {BLOCKS}, {_PARTS} SELECT doc_id, block_ix, coalesce({_NUM.format('doc_id, part_ix')}, {_TITLE.format('doc_id, part_ix')}, '') AS section FROM p",
    "section_path_s2": f"WITH {BLOCKS} SELECT doc_id, block_ix, coalesce({_NUM.format('doc_id')}, {_TITLE.format('doc_id')}, '') AS section FROM b",
    "section_path_s3": f"WITH {BLOCKS} SELECT doc_id, block_ix, coalesce({_NUM.format('doc_id')}, {_TITLE.format('doc_id')}, '') AS section FROM b",
    "section_path_s4": f"WITH {BLOCKS} SELECT doc_id, block_ix, coalesce({_NUM.format('doc_id')}, '') AS section FROM b",
    "drop_toc": f"""WITH {BLOCKS}, o AS (SELECT *, kind = 'heading' AND sec = '' AND lower(trim(title)) = 'contents' AS opens FROM b),
l AS (SELECT *, last_value(CASE WHEN opens THEN level END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_ix) AS tl FROM o),
e AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN 'in' WHEN kind = 'heading' AND (sec <> '' OR level <= tl) THEN 'out' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_ix), 'out') AS st FROM l),
k AS (SELECT *, unnest(CASE WHEN opens THEN [0, 1] ELSE [0] END) AS part FROM e WHERE opens OR (st = 'out' AND NOT (kind = 'text' AND regexp_matches(text, '(?:\\.\\s?){{6,}}'))))
SELECT doc_id, block_ix, CAST(part AS INT) AS part, CASE WHEN part = 1 THEN 'text' ELSE kind END AS kind, md5(CASE WHEN part = 1 THEN '{H.PLACEHOLDER}' ELSE text END) AS digest FROM k""",
    "normalize_levels": f"""WITH {BLOCKS}, x AS (SELECT *, CASE WHEN kind = 'heading' AND sec <> '' THEN len(string_split(sec, '.')) END AS dp FROM b),
y AS (SELECT *, min(dp) OVER (PARTITION BY doc_id) AS mn, count(dp) OVER (PARTITION BY doc_id) AS n FROM x),
z AS (SELECT *, CASE WHEN dp IS NOT NULL THEN least(6, dp - mn + 1) END AS own FROM y),
w AS (SELECT *, least(6, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_ix), 1) + 1) AS un FROM z)
SELECT doc_id, block_ix, CAST(CASE WHEN n < 3 OR kind <> 'heading' THEN level ELSE coalesce(own, un) END AS INT) AS level, CASE WHEN n < 3 THEN 'docling' ELSE 'numbering' END AS strategy FROM w""",
    "part_sizes": f"WITH {BLOCKS}, {_PARTS} SELECT doc_id, part_ix, CAST(sum(length(text) + 2) AS BIGINT) AS size, min(page) AS page_first, max(page) AS page_last FROM p GROUP BY doc_id, part_ix",
    "page_anchor": f"WITH {BLOCKS}, {_PARTS}, {_ANCHOR} SELECT doc_id, block_ix, anchor FROM an",
    "line_number": f"WITH {BLOCKS}, {_PARTS}, {_ANCHOR}, {_LINES} SELECT doc_id, block_ix, line FROM lines",
    "index_headings": f"{_HEADS} SELECT doc_id, block_ix, level, title FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY level) AS r FROM hd) WHERE r <= 2",
    "toc_whole": f"{_HEADS} SELECT doc_id, block_ix, sec FROM hd WHERE level <= 1",
    "toc_subtree": f"{_HEADS} SELECT doc_id, block_ix, sec, title FROM hd WHERE sec = '2' OR (sec = '2.1')",
    "section_extent": f"{_HEADS} SELECT a.doc_id, a.block_ix, a.line, CAST(min(c.line) - 1 AS INT) AS line_end FROM hd a LEFT JOIN hd c ON a.doc_id = c.doc_id AND a.file = c.file AND c.line > a.line AND c.level <= a.level GROUP BY ALL",
    "section_find": f"{_HEADS}, t AS (SELECT *, CASE WHEN sec = '2.1' THEN 0 WHEN contains(lower(title), '2.1') THEN 1 END AS tier FROM hd) SELECT doc_id, block_ix, sec, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, block_ix) AS k FROM t WHERE tier IS NOT NULL) WHERE k = 1",
    "section_find_title": f"{_HEADS} SELECT doc_id, block_ix, sec FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) AS k FROM hd WHERE contains(lower(title), 'the')) WHERE k = 1",
    "build_counts": f"WITH {BLOCKS} SELECT doc_id, count(*) AS blocks, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'picture') AS figures, count(*) FILTER (kind = 'heading' AND sec <> '') AS numbered, max(page) AS pages FROM b GROUP BY doc_id",
    "render_lines": f"WITH {BLOCKS}, {_PARTS}, {_ANCHOR} SELECT doc_id, block_ix, md5(CASE WHEN anchor THEN '<!-- p.' || page || ' -->' || chr(10) ELSE '' END || CASE WHEN kind = 'heading' THEN repeat('#', level) || ' ' || text || ' <!-- p.' || page || ' -->' WHEN text = '' THEN '' ELSE text END || CASE WHEN kind = 'text' AND text = '' THEN '' ELSE chr(10) END) AS digest FROM an",
    "search_records": f"WITH {BLOCKS}, {_PARTS}, {_ANCHOR}, {_LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) AS rowid, part_ix || '.md' AS file, line, coalesce({_NUM.format('doc_id, part_ix')}, {_TITLE.format('doc_id, part_ix')}, '') AS section, kind FROM lines",
}


def _pictures(s, d):  # noqa: ANN001, ANN202
    """Line blocks in which some lines are pictures and some hold captions."""
    i = F.col("block_ix")
    df = _blocks(s, d)
    cap = F.concat(F.lit("Figure "), i.cast("string"), F.lit(". Drawing of "), F.col("text"))
    return df.withColumns({"table_id": F.when(i % 7 == 2, F.concat(F.lit("f"), i.cast("string"))).otherwise(""), "kind": F.when(i % 7 == 2, "picture").otherwise(F.col("kind")), "title": F.when(i % 7 == 2, "").otherwise(F.col("title")), "text": F.when(i % 7 == 2, "").when((i % 7 == 5) & (F.col("kind") == "text"), cap).otherwise(F.col("text"))})


QUERIES["margin_captions"] = lambda s, d: H.margin_captions(_pictures(s, d))
# A picture's nearest caption is three blocks on; the one before it is the picture's before.
ORACLES["margin_captions"] = f"""WITH {BLOCKS} SELECT a.doc_id, a.block_ix, substr(trim(regexp_replace('Figure ' || c.block_ix || '. Drawing of ' || c.text, '\\s+', ' ', 'g')), 1, 220) AS caption FROM b a JOIN b c ON a.doc_id = c.doc_id AND c.block_ix = a.block_ix + 3
WHERE a.block_ix % 7 = 2 AND c.kind = 'text'"""
# Parts by top level, small ones joined to the one before in order (no document is large enough to be parted further).
_JOINED = f"""{BLOCKS}, {_PARTS}, z AS (SELECT doc_id, part_ix, CAST(sum(length(text) + 2) AS BIGINT) AS size, min(block_ix) AS first, max(block_ix) AS last, min_by(CASE WHEN kind = 'heading' AND level = top THEN title END, block_ix) AS title, min_by(CASE WHEN kind = 'heading' AND level = top THEN sec END, block_ix) AS sec FROM p GROUP BY doc_id, part_ix),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part_ix) AS k FROM z),
j AS (SELECT doc_id, k, 0 AS part, size AS total, title IS NOT NULL AS headed, title, sec, first, last FROM n WHERE k = 1
    UNION ALL SELECT n.doc_id, n.k, CASE WHEN j.headed AND n.title IS NOT NULL AND n.size < 12000 AND j.total + n.size < 36000 THEN j.part ELSE j.part + 1 END, CASE WHEN j.headed AND n.title IS NOT NULL AND n.size < 12000 AND j.total + n.size < 36000 THEN j.total + n.size ELSE n.size END, n.title IS NOT NULL,
        CASE WHEN j.headed AND n.title IS NOT NULL AND n.size < 12000 AND j.total + n.size < 36000 THEN j.title ELSE n.title END, CASE WHEN j.headed AND n.title IS NOT NULL AND n.size < 12000 AND j.total + n.size < 36000 THEN j.sec ELSE n.sec END, n.first, n.last FROM j JOIN n ON n.doc_id = j.doc_id AND n.k = j.k + 1),
nm AS (SELECT doc_id, k, part, first, last, lpad(CAST(part AS VARCHAR), CAST(greatest(2, length(CAST(part AS VARCHAR))) AS INT), '0') || '-' || CASE WHEN title IS NULL THEN 'front-matter' ELSE CASE WHEN sec <> '' THEN replace(sec, '.', '_') || '-' ELSE '' END ||
    coalesce(nullif(regexp_replace(substr(lower(regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 32), '-+$', ''), ''), 'section') END AS part_name FROM j)"""
ORACLES["split_parts"] = f"WITH RECURSIVE {_JOINED} SELECT b.doc_id, part_name, count(*) AS n_blocks, CAST(sum(length(text) + 2) AS BIGINT) AS size FROM nm JOIN b ON b.doc_id = nm.doc_id AND b.block_ix BETWEEN first AND last GROUP BY b.doc_id, part_name"
# Twenty documents as one, so that parts fill up.
_SETS = BLOCKS.replace("SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(", "SELECT doc_id AS d, unnest(", 1).replace("b AS (SELECT doc_id, block_ix,", "b AS (SELECT 'set' || (d // 20) AS doc_id, d * 1000000 + block_ix AS block_ix,")
QUERIES["split_parts_sets"] = lambda s, d: H.split_parts(A.set_blocks(s, d)).groupBy("doc_id", "part_name").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text") + 2).alias("size"))
ORACLES["split_parts_sets"] = ORACLES["split_parts"].replace(BLOCKS, _SETS)


def _table_records(s, d):  # noqa: ANN001, ANN202
    """Search records of tables, with their text."""
    records = H.chunks(H.line_numbers(H.parts_by_top_level(A.register_blocks(s, d))))
    return records.where("kind = 'table'").select("doc_id", "tid", "section", "text")


QUERIES["table_records"] = _table_records
