"""Hints, guards, grading, reports and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import catalog as C
from docloom.operators import evaluate as E
from docloom.operators import hints as H
from docloom.plans import text_queries
from docloom.plans.register_queries import _REG, _regs
from docloom.sources import adapters as A
from docloom.sources import readers


def _guard(s, d):  # noqa: ANN001, ANN202
    """Events as reads of files."""
    e = F.col("event_id")
    path = F.element_at(F.array(*map(F.lit, ["/a/B.PDF", "/x/.docstore/d/docling.json", "C:\\w\\.docstore\\d\\sections\\01.md", "/x/.docstore/d/search.sqlite", "/x/notes.txt", ""])), (e % 6 + 1).cast("int"))
    return A.table(s, d, "events").select("event_id", F.when(e % 7 == 0, "Edit").otherwise("Read").alias("tool"), path.alias("path"), (F.col("user_id") * 7919 % 3000000).alias("size"), (e % 4 == 0).alias("has_limit"))


def _answers(s, d):  # noqa: ANN001, ANN202
    """Orders as answers: hex values, bit ranges, numbers, words, refusals."""
    o, k = A.table(s, d, "orders"), F.col("o_orderkey")
    c = F.col("o_custkey")
    must = F.when(k % 5 == 0, F.concat(F.lit("0x"), F.hex(k))).when(k % 5 == 1, F.concat(F.lit("31:"), (c % 32).cast("string"), F.lit("; rw"))).when(k % 5 == 2, F.concat((c % 100).cast("string"), F.lit("|fast; SLOW|medium"))).when(k % 5 == 3, F.col("o_orderpriority")).otherwise("NOT_FOUND")
    said = F.when(k % 5 == 0, F.concat(F.lit("It is `0x0000"), F.hex(k + (c % 2)), F.lit("` [d §1 p. 7]"))).when(k % 5 == 1, F.concat(F.lit("Bits 31 – "), (c % 31).cast("string"), F.lit(", *RW*, page 3"))).when(k % 5 == 2, F.concat(F.lit("About 1"), (c % 100).cast("string"), F.lit(" or "), (k % 100).cast("string"), F.lit(", medium"))).when(k % 5 == 3, F.concat(F.lit("Priority: "), F.upper(F.col("o_orderpriority")))).otherwise(F.when(c % 2 == 0, "That register does not exist.").otherwise("Not found, but the reset value is 0x10 [d p.4]"))
    return o.select(k.cast("string").alias("id"), F.when(k % 2 == 0, "indexed").otherwise("baseline").alias("mode"), must.alias("must"), said.alias("answer"))


def _questions(s, d):  # noqa: ANN001, ANN202
    return A.table(s, d, "events").where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("id"), (1000 - F.col("event_id") % 1000).cast("int").alias("place"))


def _upsert(s, d):  # noqa: ANN001, ANN202
    old = A.eval_rows(s, d).select("id", "mode", "correct")
    new = old.where("CAST(id AS BIGINT) % 10 = 0").withColumn("correct", F.lit(7))
    return E.upsert(old, new, _questions(s, d)).select("id", "mode", "correct", "place")


def _docs(s, d):  # noqa: ANN001, ANN202
    df = A.table(s, d, "documents")
    return df.select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(9))).alias("page_range"))


def _stale(s, d):  # noqa: ANN001, ANN202
    now = _docs(s, d)
    before = now.where("CAST(id AS BIGINT) % 4 <> 0").withColumn("sha256", F.when(F.col("id").cast("bigint") % 5 == 0, "old").otherwise(F.col("sha256"))).withColumn("page_range", F.when(F.col("id").cast("bigint") % 9 == 0, F.array(F.lit(2), F.lit(9))).otherwise(F.col("page_range")))
    return C.stale(now, before).select("id")


def _manifest(s, d):  # noqa: ANN001, ANN202
    now = _docs(s, d).select("id", F.lit("old").alias("state"))
    return C.upsert(now, now.where("CAST(id AS BIGINT) % 4 = 0").withColumn("state", F.lit("new")))


def _stored(s, d):  # noqa: ANN001, ANN202
    """Converted documents as they are stored, made from pages' headings, paragraphs and list items."""
    p = readers.html_blocks(A.table(s, d, "pages"))
    ref = lambda to: F.struct(to.alias("$ref"))
    prov = F.array(F.struct((1 + F.floor(F.col("block_ix") / 3)).cast("int").alias("page_no"), F.lit(None).cast("struct<l:double,r:double,t:double,b:double>").alias("bbox")))
    none = F.array().cast("array<struct<`$ref`:string>>")

    def item(to, label, layer, level, at, text, children=none, captions=none):  # noqa: ANN001, ANN202
        return F.struct(to.alias("self_ref"), label.alias("label"), layer.alias("content_layer"), level.alias("level"), at.alias("prov"), text.alias("text"), children.alias("children"), captions.alias("captions"))

    read = item(F.concat(F.lit("#/texts/"), F.col("block_ix").cast("string")), F.when(F.col("kind") == "heading", "section_header").otherwise("text"), F.when(F.col("block_ix") % 11 == 10, "furniture").otherwise("body"), F.greatest("level", F.lit(1)), prov, F.col("text"))
    docs = p.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", read.alias("x")))), lambda t: t["x"]).alias("t"))
    # after the texts a list, a table with a caption and a wide cell, an icon, and a drawing with a caption and labels
    lit, nowhere = F.lit, F.lit(None).cast(prov_type := "array<struct<page_no:int,bbox:struct<l:double,r:double,t:double,b:double>>>")
    on = lambda page, size: F.array(F.struct(lit(page).alias("page_no"), F.struct(*[lit(float(x)).alias(k) for k, x in zip("lrtb", (0, size, size, 0), strict=True)]).alias("bbox"))).cast(prov_type)
    more = [("a", "list_item", F.concat(lit("one of "), "doc_id")), ("b", "list_item", lit("two")), ("c", "caption", F.concat(lit("Sizes of "), "doc_id")), ("d", "caption", lit("Shown here")), ("e", "text", lit("CLK  in")), ("f", "text", lit("CLK in"))]
    extra = F.array(*[item(lit(f"#/texts/{k}"), lit(label), lit("body"), lit(1), nowhere, text) for k, label, text in more])
    cell = lambda r, c, cs, text: F.struct(lit(r).alias("start_row_offset_idx"), lit(c).alias("start_col_offset_idx"), lit(1).alias("row_span"), lit(cs).alias("col_span"), text.alias("text"))
    wide, left, right = cell(0, 0, 2, lit("PLL _SYS")), cell(1, 0, 1, F.col("doc_id")), cell(1, 1, 1, lit("x"))
    table = F.struct(lit("#/tables/0").alias("self_ref"), lit("table").alias("label"), on(50, 9).alias("prov"), F.array(ref(lit("#/texts/c"))).alias("captions"), F.struct(F.array(F.array(wide, wide), F.array(left, right)).alias("grid"), F.array(right, left, wide).alias("table_cells")).alias("data"))
    pictures = F.array(item(lit("#/pictures/0"), lit("picture"), lit("body"), lit(1), on(51, 20), lit("")), item(lit("#/pictures/1"), lit("picture"), lit("body"), lit(1), on(52, 200), lit(""), F.array(*[ref(lit(f"#/texts/{k}")) for k in "def"]), F.array(ref(lit("#/texts/d")))))
    groups = F.array(item(lit("#/groups/0"), lit("list"), lit("body"), lit(1), nowhere, lit(""), F.array(ref(lit("#/texts/a")), ref(lit("#/texts/b")))))
    last = [ref(lit(x)) for x in ("#/groups/0", "#/texts/c", "#/tables/0", "#/pictures/0", "#/pictures/1")]
    body = F.struct(F.concat(F.transform("t", lambda t: ref(t["self_ref"])), F.array(*last)).alias("children"))
    return docs.select("doc_id", F.to_json(F.struct(body.alias("body"), F.concat("t", extra).alias("texts"), F.array(table).alias("tables"), pictures.alias("pictures"), groups.alias("groups"))).alias("json"))


def _tree(s, d):  # noqa: ANN001, ANN202
    return readers.blocks(_stored(s, d)).select("doc_id", "block_ix", "kind", "page", "level", F.length("text").alias("n_chars"), F.when(F.col("kind") != "heading", F.col("title")).alias("caption"), "table_id", F.size("cells").alias("n_cells"), F.when(F.col("kind") == "picture", F.col("grid")[0][0]).alias("labels"))


def _entries(s, d):  # noqa: ANN001, ANN202
    """Documents as entries of a catalog."""
    k = F.col("doc_id")
    counts = F.create_map(F.lit("registers"), (k % 13).cast("string"), F.lit("tables"), (k % 5).cast("string"), F.lit("figures"), (k % 3).cast("string"), F.lit("sections"), F.lit("4"))
    verified = F.when(k % 4 > 0, F.create_map(F.lit("ok"), (k % 17).cast("int"), F.lit("mismatch"), (k % 2).cast("int"), F.lit("memmap_ok"), (k % 6).cast("int"), F.lit("memmap_mismatch"), F.lit(0)))
    return A.table(s, d, "documents").select(k.cast("string").alias("id"), F.concat(F.lit("Title of "), "source").alias("title"), F.when(k % 2 == 0, "manual").otherwise("errata").alias("kind"), (F.col("n_chars") % 900).cast("int").alias("pages"), F.when(k % 3 == 0, F.array(F.lit(1), F.lit(9))).alias("page_range"), F.create_map(F.lit("mean"), F.lit("good")).alias("grades"), F.when(k % 10 == 0, F.array(F.lit(2), F.lit(5))).otherwise(F.array().cast("array<int>")).alias("low_pages"), counts.alias("counts"), F.coalesce(verified, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))).alias("verify"))


def _runs(s, d):  # noqa: ANN001, ANN202
    return A.table(s, d, "events").select((F.col("event_id") % 500).cast("string").alias("id"), F.when(F.col("event_id") % 2 == 0, "indexed").otherwise("baseline").alias("mode"), F.col("event_id").alias("run"), F.col("user_id").alias("value"))


def _usage(s, d):  # noqa: ANN001, ANN202
    e = F.col("event_id")
    by_model = F.when(e % 3 > 0, F.create_map(F.lit("a"), e % 100, F.lit("b"), F.col("user_id"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    return A.table(s, d, "events").select("event_id", E.token_usage(by_model, e * 2).alias("tokens"))


def _regraded(s, d):  # noqa: ANN001, ANN202
    """Answers graded once against nothing, then against the present expectations."""
    old = _answers(s, d).withColumns({"must": F.lit("NOT_FOUND"), "correct": F.lit(0), "cited": F.lit(0), "missing": F.lit("")})
    return E.regrade(old, _answers(s, d).select("id", "must")).select("id", "mode", "correct", "cited", F.array_join("missing", ",").alias("missing"))


QUERIES = {
    "prompt_hint": lambda s, d: H.hints(A.prompts(s, d), _regs(s, d)),
    "prompt_tokens": lambda s, d: A.prompts(s, d).select("prompt_id", F.array_join(H.prompt_tokens(F.col("prompt")), ",").alias("tokens")),
    "read_guard": lambda s, d: H.read_guard(_guard(s, d)).select("event_id", "decision", "reason"),
    "grade_answers": lambda s, d: E.grade(_answers(s, d)).select("id", "mode", "correct", "cited", F.array_join("missing", ",").alias("missing")),
    "eval_report": lambda s, d: E.report(A.eval_rows(s, d)),
    "eval_crosstab": lambda s, d: E.cross_tab(A.eval_rows(s, d), ["indexed", "baseline"]),
    "eval_wrong": lambda s, d: E.wrong(A.eval_rows(s, d)),
    "eval_upsert": _upsert,
    "upper_median": lambda s, d: A.table(s, d, "lineitem").groupBy("l_suppkey").agg(E.upper_median("l_quantity").alias("median")),
    "build_freshness": _stale,
    "manifest_upsert": _manifest,
    "document_tree": _tree,
    "session_announce": lambda s, d: H.announce(_entries(s, d)),
    "status_lines": lambda s, d: C.status_lines(_entries(s, d)),
    "qa_head": lambda s, d: C.qa_head(_entries(s, d)),
    "eval_regrade": _regraded,
    "eval_latest": lambda s, d: E.latest(_runs(s, d)),
    "eval_summary_line": lambda s, d: E.summary_lines(E.report(A.eval_rows(s, d))),
    "token_usage": _usage,
    "build_freshness_stored": lambda s, d: C.stale(_docs(s, d), _docs(s, d), stored=_docs(s, d).where("CAST(id AS BIGINT) % 6 <> 0"), images=_docs(s, d).where("CAST(id AS BIGINT) % 7 <> 0")).select("id"),
}

_PROMPTS = "pr AS (SELECT conv_id || '-' || turn AS prompt_id, 'What does R' || ((conv_id * 7 + turn) % (SELECT count(*) FROM part)) || '_CTRL do in the USB part of P' || (conv_id % 1000) || '? ' || coalesce(text, '') AS prompt FROM conversations WHERE role = 'user')"
_TOKENS = f"""{_PROMPTS}, tk AS (SELECT prompt_id, list_filter(regexp_extract_all(prompt, '\\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)*\\b'), lambda t: NOT list_contains([{", ".join(f"'{w}'" for w in H.STOP)}], t) AND (contains(t, '_') OR regexp_matches(t, '[0-9]') OR length(t) >= 4)) AS t FROM pr),
tl AS (SELECT prompt_id, list_slice(list_filter(t, lambda x, i: list_position(t, x) = i), 1, 40) AS t FROM tk)"""
_EV = "ev AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS category, CASE WHEN event_id % 2 = 0 THEN 'indexed' ELSE 'baseline' END AS mode, CAST(event_id % 3 <> 0 AS INT) AS correct, CAST(event_id % 5 <> 0 AS INT) AS cited, round(value, 4) AS cost_usd, user_id * 13 % 1000 AS tokens_total, event_id % 9 AS turns, user_id % 311 AS unc, event_id % 53 AS outp, event_id % 17 AS wall_s, event_id % 11 = 0 AS denied FROM events)"
ORACLES = {
    "prompt_tokens": f"WITH {_TOKENS} SELECT prompt_id, array_to_string(t, ',') AS tokens FROM tl",
    "prompt_hint": f"""WITH {_REG}, {_TOKENS}, a AS (SELECT prompt_id, unnest(t) AS token FROM tl),
hn AS (SELECT prompt_id, 0 AS tier, doc_id AS a, name AS b, name || ' (' || peripheral || ' offset ' || "offset" || ') is documented in [' || doc_id || ' §' || section || ' p.' || page || ']' AS hint FROM a JOIN r ON token = name WHERE contains(name, '_') OR length(name) >= 5),
pd AS (SELECT peripheral, string_agg(doc_id, ', ' ORDER BY doc_id) AS docs FROM (SELECT DISTINCT peripheral, doc_id FROM r) GROUP BY peripheral),
hp AS (SELECT prompt_id, 1 AS tier, '' AS a, peripheral AS b, 'peripheral ' || peripheral || ' has registers in document set ' || docs AS hint FROM a JOIN pd ON token = peripheral),
al AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY tier, a, b) AS k, count(*) OVER (PARTITION BY prompt_id) AS n FROM (SELECT * FROM hn UNION ALL SELECT * FROM hp))
SELECT prompt_id, string_agg(hint, '; ' ORDER BY k) FILTER (k <= 5) AS hints, CAST(greatest(max(n) - 5, 0) AS INT) AS more FROM al GROUP BY prompt_id""",
    "read_guard": r"""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'Edit' ELSE 'Read' END AS tool, event_id % 6 AS f, user_id * 7919 % 3000000 AS size, event_id % 4 = 0 AS lim FROM events),
g AS (SELECT event_id, CASE WHEN tool <> 'Read' OR f = 5 THEN NULL WHEN f = 0 THEN 'pdf' WHEN f IN (1, 3) THEN 'internal file' WHEN f = 2 AND NOT lim AND size > 60000 THEN 'large section' WHEN size > 2000000 AND NOT lim THEN 'large file' END AS reason FROM e)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN 'pass' ELSE 'deny' END AS decision FROM g""",
    "grade_answers": r"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders),
g AS (SELECT k, c, CASE k % 5
    WHEN 0 THEN CASE WHEN regexp_matches('0x0000' || printf('%x', k + c % 2) || '.', '0x0*' || printf('%x', k) || '[^0-9a-f]') THEN '' ELSE '0x' || printf('%X', k) END
    WHEN 1 THEN CASE WHEN c % 31 = c % 32 THEN '' ELSE '31:' || (c % 32) END
    WHEN 2 THEN CASE WHEN regexp_matches('about 1' || (c % 100) || ' or ' || (k % 100) || ', medium', '(^|[^0-9.])' || (c % 100) || '([^0-9]|$)') THEN '' ELSE (c % 100) || '|fast' END
    WHEN 3 THEN '' ELSE CASE WHEN c % 2 = 0 THEN '' ELSE 'NOT_FOUND' END END AS missing FROM o)
SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 2 = 0 THEN 'indexed' ELSE 'baseline' END AS mode, CAST(missing = '' AS INT) AS correct,
CAST(CASE WHEN k % 2 = 0 THEN k % 5 = 0 OR (k % 5 = 4 AND c % 2 = 1) ELSE k % 5 IN (0, 1) OR (k % 5 = 4 AND c % 2 = 1) END AS INT) AS cited, missing FROM g""",
    "eval_report": f"""WITH {_EV} SELECT mode, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(cited) AS BIGINT) AS cited, round(sum(cost_usd), 4) AS cost_total, round(avg(cost_usd), 4) AS cost_mean, round(avg(tokens_total), 4) AS tokens_mean,
list_sort(list(tokens_total))[count(*) // 2 + 1] AS tokens_median, round(avg(unc), 4) AS uncached_mean, round(avg(outp), 4) AS output_mean, round(avg(turns), 4) AS turns_mean, round(avg(wall_s), 4) AS wall_mean, count(*) FILTER (denied) AS denied_runs FROM ev GROUP BY mode""",
    "eval_crosstab": f"WITH {_EV} SELECT category, (sum(correct) FILTER (mode = 'indexed')) || '/' || (count(*) FILTER (mode = 'indexed')) AS indexed, (sum(correct) FILTER (mode = 'baseline')) || '/' || (count(*) FILTER (mode = 'baseline')) AS baseline FROM ev GROUP BY category",
    "eval_wrong": f"WITH {_EV} SELECT mode, id, '' AS missing FROM ev WHERE correct = 0",
    "eval_upsert": f"WITH {_EV} SELECT id, mode, CAST(CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 7 ELSE correct END AS INT) AS correct, CAST(CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 1000 - CAST(id AS BIGINT) % 1000 ELSE 999 END AS INT) AS place FROM ev",
    "upper_median": "SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_suppkey",
    "session_announce": """SELECT CAST(doc_id AS VARCHAR) AS id, doc_id || CASE WHEN doc_id % 2 = 0 THEN ' [manual]: "Title of ' ELSE ' [errata]: "Title of ' END || source || '" ' || (n_chars % 900) || 'p, ' || (doc_id % 13) || ' registers, ' || (doc_id % 5) || ' tables' || CASE WHEN doc_id % 3 > 0 THEN ', ' || (doc_id % 3) || ' figures' ELSE '' END AS line FROM documents""",
    "status_lines": """SELECT CAST(doc_id AS VARCHAR) AS id, doc_id || CASE WHEN doc_id % 2 = 0 THEN ' [manual]: "Title of ' ELSE ' [errata]: "Title of ' END || source || '" ' || (n_chars % 900) || 'p' || CASE WHEN doc_id % 3 = 0 THEN ' (pages 1-9 of the source)' ELSE '' END || ', 4 section files, 0 headings, ' || (doc_id % 5) || ' tables' || CASE WHEN doc_id % 3 > 0 THEN ', ' || (doc_id % 3) || ' figures (0 png)' ELSE '' END
|| ', ' || (doc_id % 13) || ' registers, 0 base addresses; confidence mean=good low=? low_pages=' || CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 0 END || ';' || CASE WHEN doc_id % 4 > 0 THEN ' verify ok=' || (doc_id % 17) || ' mismatch=' || (doc_id % 2) ELSE '' END || CASE WHEN doc_id % 4 > 0 AND doc_id % 6 > 0 THEN ', memmap ok=' || (doc_id % 6) || ' mismatch=0' ELSE '' END AS line FROM documents""",
    "qa_head": """WITH l AS (SELECT doc_id, list_filter(['# QA — ' || doc_id, 'Confidence: mean=good low=?', CASE WHEN doc_id % 10 = 0 THEN 'Pages with low confidence (2): 2, 5' END, CASE WHEN doc_id % 4 > 0 THEN 'Registers: ok=' || (doc_id % 17) || ' mismatch=' || (doc_id % 2) || ' unchecked=0; field resets checked: 0' END,
    CASE WHEN doc_id % 4 > 0 AND doc_id % 6 > 0 THEN 'Base addresses: ok=' || (doc_id % 6) || ' mismatch=0' END], lambda x: x IS NOT NULL) AS l FROM documents) SELECT CAST(doc_id AS VARCHAR) AS id, CAST(unnest(range(len(l))) AS INT) AS ix, unnest(l) AS line FROM l""",
    "eval_latest": "SELECT CAST(event_id % 500 AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'indexed' ELSE 'baseline' END AS mode, max(event_id) AS run, max_by(user_id, event_id) AS value FROM events GROUP BY 1, 2",
    "eval_summary_line": f"WITH {_EV} SELECT mode, mode || ': ' || sum(correct) || '/' || count(*) || ' correct, ' || sum(cited) || '/' || count(*) || ' with page citation, avg ' || format('{{:,}}', CAST(round(round(avg(tokens_total), 4)) AS BIGINT)) || ' tokens, $' || printf('%.3f', round(avg(cost_usd), 4)) || '/question, ' || printf('%.1f', round(avg(turns), 4)) || ' turns' AS line FROM ev GROUP BY mode",
    "token_usage": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 100 + user_id ELSE event_id * 2 END AS tokens FROM events",
    "build_freshness_stored": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 6 = 0 OR doc_id % 7 = 0",
    "build_freshness": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0 OR doc_id % 9 = 0",
    "manifest_upsert": "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM documents",
}
ORACLES["eval_regrade"] = ORACLES["grade_answers"]
_HTML = text_queries.ORACLES["html_blocks"]
ORACLES["document_tree"] = f"""WITH h AS ({_HTML}), k AS (SELECT * FROM h WHERE block_ix % 11 <> 10 AND (kind = 'heading' OR text <> '')), n AS (SELECT h.doc_id, count(k.block_ix) AS n, coalesce(max(1 + k.block_ix // 3), 0) AS last FROM (SELECT DISTINCT doc_id FROM h) h LEFT JOIN k ON k.doc_id = h.doc_id GROUP BY h.doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) - 1 AS block_ix, CASE WHEN kind = 'heading' THEN 'heading' ELSE 'text' END AS kind, CAST(1 + block_ix // 3 AS INT) AS page, CAST(CASE WHEN kind = 'heading' THEN level ELSE 0 END AS INT) AS level, CAST(length(text) AS INT) AS n_chars, CASE WHEN kind <> 'heading' THEN '' END AS caption, CAST(NULL AS VARCHAR) AS table_id, CAST(NULL AS INT) AS n_cells, CAST(NULL AS VARCHAR) AS labels FROM k
UNION ALL SELECT doc_id, n, 'list', CAST(last AS INT), 0, CAST(length('- one of ' || doc_id) + 6 AS INT), '', NULL, NULL, NULL FROM n
UNION ALL SELECT doc_id, n + 1, 'table', 50, 0, CAST(length('| PLL_SYS | PLL_SYS |') + 11 + length('| ' || doc_id || ' | x |') AS INT), 'Sizes of ' || doc_id, 't0001', 3, NULL FROM n
UNION ALL SELECT doc_id, n + 2, 'picture', 52, 0, 0, 'Shown here', 'f0001', NULL, 'CLK in' FROM n"""
