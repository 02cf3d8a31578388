from datetime import datetime

from pyspark.sql import functions as F

from linescan.llm import url_lists as u

ENTRIES = [
    ("block", "example.com", True, datetime(2024, 1, 1)), ("block", "example.com", False, datetime(2024, 1, 10)), ("block", "example.com", True, datetime(2024, 1, 20)),
    ("paths", "a.example.com/x", True, datetime(2024, 1, 5)), ("paths", "a.example.com/x", True, datetime(2024, 1, 5)),
    ("both", "other.org", True, datetime(2024, 1, 3)), ("both", "other.org", False, datetime(2024, 1, 3)), (None, "a.example.com", True, datetime(2024, 1, 1)), ("n", None, True, None),
]
CAPTURES = [
    (1, "http://a.example.com/x/y?q#f", datetime(2024, 1, 6), True, "a.example.com/x", 2),
    (2, "https://u:p@A.Example.com.:8080", datetime(2024, 1, 9, 23), True, "example.com", 1),
    (3, "http://example.com/", datetime(2024, 1, 10), False, None, 0),
    (4, "http://example.com/", datetime(2024, 1, 20), True, "example.com", 1),
    (5, "http://notexample.com/", datetime(2024, 1, 2), False, None, 0),
    (6, "http://other.org/", datetime(2024, 2, 1), False, None, 0),
    (7, None, datetime(2024, 1, 2), False, None, 0), (8, "no url", datetime(2024, 1, 2), False, None, 0), (9, "http://example.com", None, False, None, 0),
    (10, "http://localhost/x", datetime(2024, 1, 2), False, None, 0), (None, "http://example.com/z", datetime(2024, 1, 1), True, "example.com", 1),
]


def tables(spark):
    entries = spark.createDataFrame(ENTRIES, "list string, key string, listed boolean, since timestamp_ntz")
    captures = spark.createDataFrame([(*c[:3], "k") for c in CAPTURES] * 2, "page_id int, url string, fetched timestamp_ntz, key string")
    return captures, entries


def test_as_of(spark):
    got = {(r.page_id): (r.blocked, r.key, r.n_matches) for r in u.filter_captures(*tables(spark)).collect()}
    assert got == {c[0]: c[3:] for c in CAPTURES}


def test_empty(spark):
    captures, entries = tables(spark)
    assert u.filter_captures(captures, entries.where("false")).where("blocked").count() == 0
    assert u.filter_captures(captures.where("false"), entries).count() == 0


def test_keys(spark):
    df = spark.createDataFrame([("https://b.a.co.uk/p//q/",)], "url string")
    assert df.select(u.url_keys(F.col("url"))).first()[0] == ["co.uk", "a.co.uk", "b.a.co.uk", "b.a.co.uk/p", "b.a.co.uk/p/q"]


ODD = [
    "http://u@p@evil.example/x", "http://[2001:db8::1]:80/x/y", "http://[2001:DB8::1]/", "http://user:p@[::1]:8080/a", "http://[::1", "http://[::1]x/", "http://10.0.0.1:8080/a/b?q", "http://a.b.c:99999/x",
    "http://@host.example/", "http://host.example:/p", "HTTP://WWW.Example.COM/Path/To", "ftp://u:p@ftp.example.org/f", "http:///x", "http://", "http://?q", "http://h#f", "http://a@b@c@d.example?x/y", "http://é.example/ü",
    "http://x.example/@y/z@w", "http://x.example?u@v.example/", "//no.scheme/x", "mailto:a@b.c", "1http://x.y/", "http://x.y//z", "http://..x..y../p", "http://x]y/", "", None,
]


def test_hosts_like_urllib(spark):
    from urllib.parse import urlsplit

    def expected(url):
        try:
            parts = urlsplit(url or "")
            host = parts.hostname if parts.scheme and "://" in url else None
        except ValueError:
            return None
        return (host or "").rstrip(".") or None

    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "i int, url string")
    got = {r.i: (r.h, r.p) for r in df.select("i", u.host_of(F.col("url")).alias("h"), u.path_of(F.col("url")).alias("p")).collect()}
    for i, url in enumerate(ODD):
        if url == "http://x]y/":
            assert got[i][0] is None
        else:
            assert got[i][0] == expected(url), url
            if got[i][0]:
                assert got[i][1] == (urlsplit(url).path or "/"), url


def test_many_labels_and_segments(spark):
    deep = ".".join(f"l{i}" for i in range(201)) + ".example.com"
    long = "http://a.example.com/" + "/".join(f"s{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, f"http://{deep}/", datetime(2024, 1, 2)), (2, long, datetime(2024, 1, 2)), (3, "http://10.1.2.3/x", datetime(2024, 1, 2))], "page_id int, url string, fetched timestamp_ntz")
    assert len(df.where("page_id = 1").select(u.url_keys(F.col("url"))).first()[0]) == 202
    entries = [("l", deep, True, datetime(2024, 1, 1)), ("l", "a.example.com/s0/s1", True, datetime(2024, 1, 1)), ("l", "2.3", True, datetime(2024, 1, 1)), ("a", "a.example.com/s0/s1", True, datetime(2024, 1, 1))]
    spans = spark.createDataFrame(entries, "list string, key string, listed boolean, since timestamp_ntz")
    got = {r.page_id: (r.n_matches, r.key, r.list) for r in u.filter_captures(df, spans).collect()}
    assert got == {1: (1, deep, "l"), 2: (2, "a.example.com/s0/s1", "a"), 3: (0, None, None)}


def test_sql_twin_on_odd_urls(spark, duck, tmp_path):
    import duckdb

    from tests.conftest import same_as_sql

    spark.createDataFrame([(i, x) for i, x in enumerate(ODD)] * 2, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_as_sql(u.op7_url_filters(spark, str(tmp_path)), con, u.ORACLE_SQL)
