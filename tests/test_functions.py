"""Column helpers against Python's own semantics (stdlib, not the audited tool)."""

from urllib.parse import urlparse, urlunparse

from pyspark.sql import functions as F

from sitelens.functions import columns as X


def test_py_round1_matches_python_round(spark):
    rows = [(a, b) for b in range(1, 41) for a in range(0, 401, 3)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", X.py_round1(F.col("a"), F.col("b")).alias("r"))
    bad = [(r.a, r.b, r.r) for r in df.collect() if r.r != round(r.a / r.b, 1)]
    assert bad == []


def test_ties_follow_binary_value(spark):
    # 127/20 = 6.35 rounds down in Python (6.35 is 6.3499... in binary); 5/20 = 0.25 -> 0.2 (half-even)
    df = spark.createDataFrame([(127, 20), (5, 20), (15, 20), (13, 20)], "a long, b long")
    got = [r.r for r in df.select(X.py_round1(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [round(127 / 20, 1), round(5 / 20, 1), round(15 / 20, 1), round(13 / 20, 1)]


URLS = ["https://x.com/a?utm=1", "https://x.com/a#frag", "HTTPS://X.com/a;v=2", "http://x.com/p;a/b?q#f",
        "https://x.com", "https://x.com/", "ftp://h/f;type=a", "https://x.com/a/b;c=d;e=f?z=1"]


def test_url_normalize_matches_urlunparse(spark):
    def expected(u):
        p = urlparse(u)
        return urlunparse((p.scheme, p.netloc, p.path, "", "", ""))
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: r.n for r in df.select("url", X.url_normalize("url").alias("n")).collect()}
    assert got == {u: expected(u) for u in URLS}
