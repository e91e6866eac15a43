"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join of the possible hits.

The filter is a table of blocks of eight 64-bit words; a URL's hash names one block and one bit in each of its words.
The number of blocks follows the list up to a fixed bound (2^18 blocks, about 20 MB), so the table can always be
broadcast: a longer list only lets more false positives through, and the exact join removes every one of them. Only
distinct possible hits are joined with the list, so a URL that fills a third of the rows reaches that join as one row for
each task. The listed URLs that were found so go back to the rows by a broadcast if they are few; else only rows that the
filter lets through are shuffled to them, the others stay where they are.

Host and path rules come first: a rule fits its host and all subdomains if the path starts with the rule's; the longest
wins. A URL no rule fits is blocked if its canonical form is listed, else allowed.

Defined results: a null URL or one without "://" has an empty host and path, no rule, and is allowed unless the empty
URL is listed; a URL of any length is judged whole; repeated rows and repeated list entries change nothing; an empty list
allows all; other columns pass through unless they have the name of an output column, which replaces them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import join_few, keep, table, with_possible

#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Names of listed sites, and what stands after a site's name in a listed host.
SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
DOMAINS = ["example.com", "example.net", "example.org"]


def host_of(url: Column) -> Column:
    """A-Z lower-cased only; other letters stay."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Without scheme, query, fragment, a leading www. or m. or blog., a last slash or .html."""
    return F.concat(F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are a short declared list."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, and listed (whether the canonical URL is in listed.url)."""
    made = ("host", "path", "rule", "verdict", "listed")
    listed = listed.select(F.col("url").alias("__url")).where("__url IS NOT NULL").distinct()
    rest = [F.col(c) for c in pages.columns if c not in made]
    own = pages.select(*rest, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "__verdict": verdict, "__url": canonical(F.col("host"), F.col("path"))})
    # exact: distinct possible hits meet the list by hash; what is left has no false positives and goes back to the rows
    possible = with_possible(own.select("__url"), "__url", listed.select(F.col("__url").alias("key")), listed.count()).where("__possible").select("__url").distinct()
    hits = keep(possible.join(listed.hint("shuffle_hash"), "__url", "left_semi").withColumn("__hit", F.lit(True)), "hits")
    out = join_few(own, hits, ["__url"], "left", "octet_length(__url)")
    return out.withColumn("listed", F.coalesce("__hit", F.lit(False))).withColumn("verdict", F.coalesce("__verdict", F.when(F.col("listed"), "block").otherwise("allow"))).drop("__hit", "__url", "__verdict")


def listed_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A block list as a crawler's log gives it: the canonical URLs that were seen on SITES, under any of DOMAINS, with
    whatever scheme, prefix, query or ending. It grows with the pages and holds every page of such a site.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    site = rf"^(?:(?:www|m|blog)\.)?(?:{'|'.join(SITES)})\.(?:{'|'.join(re.escape(d) for d in DOMAINS)})$"
    return pages.where(host.rlike(site)).select(canonical(host, path).alias("url")).distinct()


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE_OP6 = rf"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m|blog)\.', '') AS bare, regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(/|\.html)$', '') AS canon FROM p),
fits AS (SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC) AS k, p.host, p.path
    FROM (SELECT DISTINCT * FROM p) p JOIN (VALUES ('net', '/', 'block', 'net/'), ('example.net', '/en/', 'allow', 'example.net/en/'), ('example.com', '/de/', 'block', 'example.com/de/'), ('org', '/fr/', 'allow', 'org/fr/')) r(host, path, verdict, rule)
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
site AS (SELECT s || '.' || d AS site FROM (SELECT unnest([{", ".join(f"'{s}'" for s in SITES)}]) AS s), (SELECT unnest([{", ".join(f"'{d}'" for d in DOMAINS)}]) AS d)),
listed AS (SELECT DISTINCT canon FROM c WHERE bare IN (SELECT site FROM site))
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, CASE WHEN x.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, x.canon IS NOT NULL AS listed
FROM c LEFT JOIN fits f ON f.k = 1 AND f.page_id = c.page_id AND f.host = c.host AND f.path = c.path
LEFT JOIN listed x ON x.canon = c.canon
"""

ORACLES = {"op6_url_filter": ORACLE_OP6}
QUERIES = {"op6_url_filter": op6_url_filter}
