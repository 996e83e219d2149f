import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from loomlake.llm import url_filter

COLUMNS = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]


def pages(spark, urls, schema="page_id long, url string"):
    return spark.createDataFrame(list(enumerate(urls)), schema)


def both(spark, urls):
    got = sorted(map(tuple, url_filter.report(pages(spark, urls).repartition(3)).select(*COLUMNS).collect()))
    with duckdb.connect() as db:
        db.register("pages", pd.DataFrame(list(enumerate(urls)), columns=["page_id", "url"]).astype({"url": "object"}))
        want = sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({url_filter.oracle()})").fetchall())
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], abs=2e-6)
    return {r[0]: dict(zip(COLUMNS, r)) for r in got}


EDGES = [None, "", "no scheme", "http://", "http://NET", "http://net/", "https://a.net?x", "ftp://Example.NET/en/1#top", "http://example.net/en", "x://example.com/de/a?b", "http://notexample.com/de/a", "http://example.com/DE/a", "http://org/fr/", "http://net.org/fr/é/ü", "http://com//a///b", "http://com/" + "s/" * 300, "http://com/" + "y" * 5000, "http://org/fr/", "://x/y", "a://b://c/d"]


def test_edges_equal_the_sql(spark):
    out = both(spark, EDGES)
    assert out[0]["host"] == out[0]["path"] == out[1]["path"] == out[2]["host"] == ""
    assert [out[i]["rule"] for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)] == [None, "net/", None, "example.net/en/", "net/", "example.com/de/", None, None, "org/fr/", "org/fr/"]


def test_many_urls_equal_the_sql_with_widened_levels(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ghijklm") for _ in range(n))
    hosts = ["a.example.net", "example.net", "b.example.com", "c.example.org", "news.org", "shop.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.choice(['x', 'y'])}/{word(rng.choice((1, 5)))}" for _ in range(300)]
    urls += [f"http://shop.com/en/x/{word(7)}/{word(1)}/deep/{word(6)}" for _ in range(300)]
    out = both(spark, urls)
    assert any("/en/x/*/" in r["template"] for r in out.values())


def test_the_tree_blocks_and_allows_pages_that_no_rule_fits(spark):
    urls = [f"http://h{i % 3}.net/es/{i}" for i in range(30)] + [f"http://example.net/en/{i}" for i in range(30)] + [f"http://shop.com/{s}/{i}" for s in ("es", "en", "zz") for i in range(5)]
    out = both(spark, urls)
    verdicts = {p: {r["verdict"] for r in out.values() if r["host"] == "shop.com" and r["path"].startswith(p)} for p in ("/es/", "/en/", "/zz/")}
    assert verdicts == {"/es/": {"block"}, "/en/": {"allow"}, "/zz/": {"allow"}}
    assert len({r["purity"] for r in out.values() if r["rule"] is None}) == 3


def test_alike_siblings_share_their_labels(spark):
    urls = [f"http://x.net/{s}/{i}" for s, n in (("a", 3), ("b", 12)) for i in range(n)]
    out = both(spark, urls)
    assert len({r["purity"] for r in out.values()}) == 2  # siblings of one parent only: /a and /b are parents of their own
    urls = [f"http://x.net/p/{s}" for s in ("a", "b") for _ in range(5)]
    assert len({r["purity"] for r in both(spark, urls).values()}) == 1


def test_ties_repeats_and_empty_tables(spark):
    rows = pages(spark, ["http://x.net/a", "http://x.net/a", "http://x.org/fr/", "http://x.org/fr/", None, None])
    assert Counter((r.url, r.verdict) for r in url_filter.judge(rows).collect()) == {("http://x.net/a", "block"): 2, ("http://x.org/fr/", "allow"): 2, (None, "allow"): 2}
    assert url_filter.judge(pages(spark, [])).collect() == []


def test_other_columns_pass_and_reserved_names_are_refused(spark):
    rows = spark.createDataFrame([(1, "http://x.net/a", "mine", "theirs", 3)], "page_id long, url string, host string, segs string, n int")
    (r,) = url_filter.judge(rows).collect()
    assert (r.host, r.segs, r.n, r.verdict) == ("x.net", "theirs", 3, "block")
    with pytest.raises(ValueError):
        url_filter.judge(rows.withColumnRenamed("segs", "_u_raw"))
