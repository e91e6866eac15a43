import pytest

from docloom.llm import common
from docloom.llm import urlfilter as U


def judged(spark, urls, listed):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    return {r["page_id"]: r for r in U.filter_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string")).collect()}


def test_rules_and_list(spark):
    urls = ["http://A.NET/x", "https://b.example.net/en/1", "https://example.com/de/", "http://x.org/fr/2?q", "http://m.bad.org/p.html#t", "http://bad.org/p/", "http://good.org/p", None, "no scheme", "http://net", "http://notnet/x", "", "x://Ü.net/"]
    got = judged(spark, urls, ["bad.org/p", "bad.org/p", None, ""])
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(10)] == [
        ("a.net", "/x", "net/", "block"), ("b.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/2", "org/fr/", "allow"),
        ("m.bad.org", "/p.html", None, "block"), ("bad.org", "/p/", None, "block"), ("good.org", "/p", None, "allow"), ("", "", None, "block"), ("", "", None, "block"), ("net", "", None, "allow"),
    ]
    assert got[10]["rule"] is None and got[12]["host"] == "Ü.net"


def test_no_false_positives_or_negatives(spark):
    listed = [f"s{k}.org/{k}" for k in range(0, 6000, 2)]
    got = judged(spark, [f"http://s{k}.org/{k}" for k in range(6000)], listed)
    assert all((got[k]["verdict"] == "block") == (k % 2 == 0) for k in range(6000))


@pytest.mark.parametrize("broadcast", [True, False])
def test_full_filter_stays_exact(spark, monkeypatch, broadcast):
    """Too small a filter lets nearly all URLs through, and hits past the bound go back by a shuffle."""
    monkeypatch.setattr(common, "MOST_BLOCKS", 1)
    if not broadcast:
        monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    listed = [f"s{k}.org/{k}" for k in range(0, 600, 2)]
    got = judged(spark, [f"http://s{k}.org/{k}" for k in range(600)], listed)
    assert len(got) == 600 and all(got[k]["listed"] == (k % 2 == 0) for k in range(600))


def test_odd_rows(spark):
    """A very long URL, repeated rows and nulls; columns named like the output's."""
    long = "http://bad.org/" + "p" * 200_000
    urls = [long, long, None, None, "http://bad.org/x"]
    pages = spark.createDataFrame([(1, u, "h", "p", "r", True) for u in urls], "page_id long, url string, host string, path string, rule string, listed boolean")
    out = U.filter_urls(pages, spark.createDataFrame([(long[7:],)], "url string")).collect()
    assert sorted((len(r["path"]), r["host"], r["rule"], r["listed"], r["verdict"]) for r in out) == [(0, "", None, False, "allow")] * 2 + [(2, "bad.org", None, False, "allow")] + [(200_001, "bad.org", None, True, "block")] * 2


def test_list_holds_every_page_of_a_listed_site(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = U.filter_urls(pages, U.listed_urls(pages)).collect()
    on_site = [r for r in out if any(s in r["host"] for s in U.SITES)]
    assert on_site and all(r["listed"] for r in on_site) and not any(r["listed"] for r in out if r not in on_site)


def test_empty(spark):
    assert judged(spark, ["http://a.org/b"], [])[0]["verdict"] == "allow"
    assert judged(spark, [], ["a.org/b"]) == {}
