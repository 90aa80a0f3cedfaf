import duckdb

from hirelake.llm.queries import ORACLES, URL_RULES, op2_urlfilter
from hirelake.llm.urlfilter import Rule, build_trie, filter_urls, longest_match
from tests.conftest import SMALL


def test_longest_match_wins():
    trie = build_trie([*URL_RULES, Rule("block", "a.org", "/fr/b"), Rule("allow", "a.org", "/fr/b")])
    name = lambda h, p: (m := longest_match(trie, h, p)) and (m.verdict, m.name)
    assert name("example.net", "/en/x") == ("allow", "example.net/en/")
    assert name("example.net", "/en") == ("block", "net/")
    assert name("badexample.net", "/en/") == ("block", "net/")
    assert name("x.a.org", "/fr/bc") == ("block", "a.org/fr/b")
    assert name("net", "") is None and name("", "/") is None


def test_edge_rows(spark):
    rows = [(1, "http://NET/a?b", "h"), (2, None, "h"), (3, "no scheme", "h"), (4, "x://a.org/fr/#q", "h"), (4, "x://a.org/fr/#q", "h"), (None, "s://é.É/p", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    found = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, URL_RULES).collect())
    assert found == [(0, "é.É", "/p", None, "allow"), (1, "net", "/a", "net/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.org", "/fr/", "org/fr/", "allow"), (4, "a.org", "/fr/", "org/fr/", "allow")]
    assert filter_urls(df.limit(0), URL_RULES).count() == 0


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    want = sorted(con.execute(ORACLES["op2_urlfilter"]).fetchall())
    assert sorted(map(tuple, op2_urlfilter(spark, SMALL).collect())) == want
