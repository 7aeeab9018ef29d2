"""URL rules and host reputation: hand-made urls, and the whole judgement against its SQL."""

import duckdb
import pytest

from powerlens.llm import urls
from powerlens.llm.queries import ORACLES, URL_RULES

URLS = [
    (1, None), (2, ""), (3, "no scheme/x"), (4, "https://A.Example.ORG/es/1?x#y"), (5, "http://example.org/en/1"), (6, "http://example.org/en/2"),
    (7, "http://badexample.org/es/"), (8, "ftp://x.com/de/a://b/fr/"), (9, "https://x.com"), (10, "https://x.com?q=/fr/"), (11, "https://org/"),
    (12, "https://a.ÉX.org#f"), (13, "http://x.net/fr/"), (14, "://y.com/fr/"), (15, "http://y.com/en/"), (15, "http://y.com/en/"), (None, "http://z.com/de/"),
    (16, "http://com/de/x"), (17, "http://a.com:80/de/x"), (18, "http://x.com/\n/de/"), (19, "http://x..com/de/"),
]


def judged(spark, rows):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    return sorted((tuple(r) for r in urls.judge(df, URL_RULES).collect()), key=str)


def test_parts_and_rules(spark):
    got = {r[0]: r[1:4] for r in judged(spark, URLS)}
    assert got[1] == got[2] == got[3] == ("", "", None)
    assert got[4] == ("a.example.org", "/es/1", "example.org/es/")
    assert got[5] == ("example.org", "/en/1", "example.org/en/1")
    assert got[6] == ("example.org", "/en/2", "org/")
    assert got[7] == ("badexample.org", "/es/", "org/")
    assert got[8] == ("x.com", "/de/a://b/fr/", "com/de/")
    assert got[9] == got[10] == ("x.com", "", None)
    assert got[11] == ("org", "/", "org/")
    assert got[12] == ("a.Éx.org", "", None)
    assert got[14] == ("y.com", "/fr/", "com/fr/")
    assert got[16] == ("com", "/de/x", "com/de/")
    assert got[17] == ("a.com:80", "/de/x", None)


@pytest.mark.parametrize("n", [0, 1, len(URLS), 400])
def test_against_sql(spark, n):
    rows = URLS[:n]
    if n > len(URLS):
        rows = URLS + [(1000 + k, f"http://h{k % 7}.d{k % 3}.com/{('de', 'fr', 'en')[(k * k + k % 5) % 3 if k % 7 else 0]}/{k}") for k in range(n)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    if rows:
        con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = sorted((tuple(r) for r in con.execute(ORACLES["op8_host_reputation"]).fetchall()), key=str)
    got = judged(spark, rows)
    assert got == want
    if n == 400:  # only bad pages known: the host's other pages are blocked
        assert any(r[1].startswith("h0.") and r[3] is None and r[4] == "block" for r in got) or all(r[3] for r in got if r[1].startswith("h0."))


def test_reputation_shrinks(spark):
    rows = [("a.x.com", 0)] * 50 + [("b.x.com", 1)] * 50 + [("c.x.com", None)] + [("d.y.com", 1)] * 2 + [("e.z.net", None)]
    got = {r.host: r for r in urls.reputations(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["a.x.com"].upper < 0.5 < got["b.x.com"].mean
    assert 0.2 < got["c.x.com"].mean < 0.8 and got["c.x.com"].upper > 0.5
    assert got["d.y.com"].mean < 1 and got["e.z.net"].upper > 0.5
