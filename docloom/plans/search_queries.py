"""Search over chunks of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import search as S
from docloom.sources import adapters as A
from docloom.sources import shared

CHUNKS = """c AS (SELECT 'set' || (doc_id // 20) AS doc_id, doc_id * 1000000 + ix AS rowid, doc_id || '.md' AS file, CAST(ix + 1 AS INT) AS line, CAST(1 + ix // 5 AS INT) AS page, (doc_id % 7) || '.' || ix AS section,
    CASE WHEN ix = 0 THEN 'heading' WHEN contains(text, ' | ') THEN 'table' ELSE 'text' END AS kind, text
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ix FROM documents))"""


def scored_sql(query: str) -> str:
    """DuckDB: CTEs c and s, s being the scored chunks."""
    phrases = S.parse_query(query)
    counts = []
    for k, p in enumerate(phrases):
        tests = [f"starts_with(t[i + {j}], '{w}')" if p.prefix and j == len(p.tokens) - 1 else f"t[i + {j}] = '{w}'" for j, w in enumerate(p.tokens)]
        counts.append(f"len(list_filter(range(1, len(t) + 1), lambda i: {' AND '.join(tests)})) AS f{k}")
    n = range(len(phrases))
    idf = lambda k: f"CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{k} + 0.5) / (df{k} + 0.5)) END"
    parts = " + ".join(f"({idf(k)}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / av))" for k in n)
    return f"""WITH {CHUNKS},
t AS (SELECT *, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t FROM c),
f AS (SELECT *, len(t) AS dl, {", ".join(counts)} FROM t),
st AS (SELECT doc_id, count(*) AS n, avg(dl) AS av, {", ".join(f"count(*) FILTER (f{k} > 0) AS df{k}" for k in n)} FROM f GROUP BY doc_id),
s AS (SELECT *, bm25 * CASE kind WHEN 'code' THEN 0.35 WHEN 'heading' THEN 1.2 WHEN 'table' THEN 1.1 WHEN 'figure' THEN 0.9 ELSE 1.0 END AS rank
    FROM (SELECT f.*, -({parts}) AS bm25 FROM f JOIN st USING (doc_id) WHERE {" AND ".join(f"f{k} > 0" for k in n)}))"""


def _index(spark, d):  # noqa: ANN001, ANN202
    """The index over the documents' lines, written once in a session."""
    return S.Index(spark, shared.once(spark, "index", d, lambda path: S.write_index(A.doc_chunks(spark, d), path)))


def _scores(query: str):  # noqa: ANN202
    return lambda spark, d: _index(spark, d).score(query).select("doc_id", "rowid", F.round("bm25", 6).alias("bm25"), F.round("rank", 6).alias("rank"))


def _scores_sql(query: str) -> str:
    return scored_sql(query) + " SELECT doc_id, rowid, round(bm25, 6) AS bm25, round(rank, 6) AS rank FROM s"


def _found(df):  # noqa: ANN001, ANN202
    return df.select("doc_id", "rowid", "kind", "section", F.round("rank", 6).alias("rank"), "among_best")


def _found_sql(query: str, n: int, where: str = "true", every_doc: bool = True) -> str:
    others = f"UNION ALL SELECT *, false FROM b WHERE k = 1 AND doc_id NOT IN (SELECT doc_id FROM g)" if every_doc else ""
    return scored_sql(query) + f""", b AS (SELECT doc_id, rowid, kind, section, rank, row_number() OVER (PARTITION BY doc_id ORDER BY rank, rowid) AS k FROM s WHERE {where}),
g AS (SELECT * FROM b ORDER BY rank, doc_id, rowid LIMIT {n})
SELECT doc_id, rowid, kind, section, round(rank, 6) AS rank, among_best FROM (SELECT *, true AS among_best FROM g {others})"""


def _shown(s, d, query: str, n: int, full: int):  # noqa: ANN001, ANN202
    index = _index(s, d)
    return index.shown(index.search(query, n=n, every_doc=False), query, full=full).select("doc_id", "rowid", "file", "line", "page", "place", "full")


QUERIES = {
    "bm25_single": _scores("the"),
    "bm25_and": _scores("that the"),
    "bm25_phrase": _scores("of_the"),
    "bm25_prefix": _scores("worth*"),
    "bm25_accents": _scores("für"),
    "search_topn": lambda s, d: _found(_index(s, d).search("worthless the", n=8)),
    "search_global_topn": lambda s, d: _found(_index(s, d).search("idiot", n=20, every_doc=False)),
    "search_filter_kind": lambda s, d: _found(_index(s, d).search("that", kind="table", n=10)),
    "search_filter_section": lambda s, d: _found(_index(s, d).search("the", section="3", n=10)),
    "search_one_doc": lambda s, d: _found(_index(s, d).search("the", doc="set3", n=10)),
    "heading_expand": lambda s, d: S.with_following(A.doc_chunks(s, d)).where("kind = 'heading'").select("doc_id", "rowid", "full"),
    "truncate_word": lambda s, d: A.doc_chunks(s, d).select("doc_id", "rowid", X.cut_at_word(X.one_line(F.col("text")), 80).alias("cut")),
    "format_hits": lambda s, d: A.doc_chunks(s, d).select("rowid", S.format_hit(60).alias("hit")),
    "posting_counts": lambda s, d: S.postings(A.doc_chunks(s, d)).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size("positions")).cast("bigint").alias("n_positions")),
    "snippet": lambda s, d: S.score(A.doc_chunks(s, d), "worthless").select("doc_id", "rowid", S.snippet(F.col("text"), "worthless").alias("snippet")),
    "search_shown": lambda s, d: _shown(s, d, "worthless the", 8, 3),
    "search_unindexed": lambda s, d: _found(S.search(A.doc_chunks(s, d), "worthless the", n=8)),
}

_LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_FULL = "CASE WHEN length({0}) <= {1} THEN {0} ELSE regexp_replace(substr({0}, 1, {1}), ' [^ ]*$', '') || ' …' END"
ORACLES = {
    "bm25_single": _scores_sql("the"),
    "bm25_and": _scores_sql("that the"),
    "bm25_phrase": _scores_sql("of_the"),
    "bm25_prefix": _scores_sql("worth*"),
    "bm25_accents": _scores_sql("für"),
    "search_topn": _found_sql("worthless the", 8),
    "search_global_topn": _found_sql("idiot", 20, every_doc=False),
    "search_filter_kind": _found_sql("that", 10, "kind = 'table'"),
    "search_filter_section": _found_sql("the", 10, "section = '3' OR starts_with(section, '3.')"),
    "search_one_doc": _found_sql("the", 10, "doc_id = 'set3'"),
    "snippet": scored_sql("worthless") + r""", w AS (SELECT doc_id, rowid, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM s),
x AS (SELECT *, greatest(1, coalesce(list_position(list_transform(w, lambda z: contains(strip_accents(lower(z)), 'worthless')), true), 0) - 3) AS a FROM w)
SELECT doc_id, rowid, CASE WHEN a > 1 THEN '…' ELSE '' END || array_to_string(w[a:a + 13], ' ') || CASE WHEN len(w) >= a + 14 THEN '…' ELSE '' END AS snippet FROM x""",
    "search_unindexed": _found_sql("worthless the", 8),
    "heading_expand": f"""WITH {CHUNKS}, o AS (SELECT doc_id, rowid, file, kind, {_LINE} AS b, list({_LINE}) OVER w AS nx, list(file) OVER w AS nf FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY rowid ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
n AS (SELECT doc_id, rowid, b, list_transform(list_filter(list_zip(nf, nx), lambda z: z[1] = file), lambda z: z[2]) AS x FROM o WHERE kind = 'heading'),
a1 AS (SELECT *, CASE WHEN len(x) >= 1 THEN b || ' | ' || x[1] ELSE b END AS t1 FROM n),
a2 AS (SELECT *, CASE WHEN len(x) >= 2 AND length(t1) < 450 THEN t1 || ' | ' || x[2] ELSE t1 END AS t2 FROM a1),
a3 AS (SELECT *, CASE WHEN len(x) >= 3 AND length(t2) < 450 THEN t2 || ' | ' || x[3] ELSE t2 END AS t3 FROM a2),
a4 AS (SELECT *, CASE WHEN len(x) >= 4 AND length(t3) < 450 THEN t3 || ' | ' || x[4] ELSE t3 END AS t4 FROM a3)
SELECT doc_id, rowid, {_FULL.format("t4", 450)} AS full FROM a4""",
    "truncate_word": f"WITH {CHUNKS}, o AS (SELECT doc_id, rowid, {_LINE} AS b FROM c) SELECT doc_id, rowid, {_FULL.format('b', 80)} AS cut FROM o",
    "format_hits": f"WITH {CHUNKS} SELECT rowid, doc_id || ' §' || section || ' p.' || page || ' sections/' || file || ':' || line || '  ' || substr({_LINE}, 1, 60) AS hit FROM c",
    "posting_counts": f"""WITH {CHUNKS}, t AS (SELECT doc_id, rowid, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) AS token FROM c)
SELECT token, doc_id, count(DISTINCT rowid) AS n_chunks, count(*) AS n_positions FROM t GROUP BY token, doc_id""",
}
_NEXT = f"""nx AS (SELECT doc_id, rowid, {_LINE} AS b, list({_LINE}) OVER w AS nx, list(file) OVER w AS nf, file FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY rowid ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
n AS (SELECT doc_id, rowid, b, list_transform(list_filter(list_zip(nf, nx), lambda z: z[1] = file), lambda z: z[2]) AS x FROM nx),
a1 AS (SELECT *, CASE WHEN len(x) >= 1 THEN b || ' | ' || x[1] ELSE b END AS t1 FROM n), a2 AS (SELECT *, CASE WHEN len(x) >= 2 AND length(t1) < 450 THEN t1 || ' | ' || x[2] ELSE t1 END AS t2 FROM a1),
a3 AS (SELECT *, CASE WHEN len(x) >= 3 AND length(t2) < 450 THEN t2 || ' | ' || x[3] ELSE t2 END AS t3 FROM a2), a4 AS (SELECT *, CASE WHEN len(x) >= 4 AND length(t3) < 450 THEN t3 || ' | ' || x[4] ELSE t3 END AS t4 FROM a3)"""
ORACLES["search_shown"] = scored_sql("worthless the") + f""", {_NEXT}, g AS (SELECT * FROM s ORDER BY rank, doc_id, rowid LIMIT 8), h AS (SELECT g.*, CAST(row_number() OVER (ORDER BY rank, doc_id, rowid) AS INT) AS place FROM g),
u AS (SELECT h.*, CASE WHEN h.kind = 'heading' THEN a4.t4 ELSE a4.b END AS whole FROM h JOIN a4 USING (doc_id, rowid))
SELECT doc_id, rowid, file, line, page, place, CASE WHEN place <= 3 THEN {_FULL.format('whole', 450)} END AS full FROM u"""
