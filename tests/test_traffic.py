import pytest
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitelens.functions import columns as X
from sitelens.operators import traffic as T

UAS = [
    ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", True),
    ("Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; GPTBot/1.2)", True),
    ("Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; ClaudeBot/1.0)", True),
    ("Mozilla/5.0 (compatible; PerplexityBot/1.0)", True),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36", False),
]


def test_bot_detection(spark):
    df = spark.createDataFrame(UAS, "user_agent string, expected boolean")
    got = T.tag_bots(df).select("is_bot", "expected").collect()
    assert all(r.is_bot == r.expected for r in got)


def test_bot_list_and_regex():
    from sitelens.functions import constants as C
    assert len(C.BOT_TOKENS) >= 20
    assert "googlebot" in C.bot_alternation().split("|")


def test_url_key_ignores_query_fragment_params(spark):
    df = spark.createDataFrame([("https://x.com/a?utm_source=google",), ("https://x.com/a#top",),
                                ("HTTPS://x.com/a;v=1",), ("https://x.com/a",), ("https://x.com/a/",)], "url string")
    keys = [r.k for r in df.select(X.cache_key("url").alias("k")).collect()]
    assert len(set(keys[:4])) == 1 and keys[4] != keys[0]


def _requests(spark, rows):
    base = datetime(2024, 1, 1)
    data = [(i, base + timedelta(seconds=s), 1, et, "GET", "Googlebot", url, "document", st, et == "error")
            for i, (s, url, st, et) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                       "method string, user_agent string, url string, resource_type string, "
                                       "status int, forced boolean")


def _brute_ttl(rows, ttl):
    anchor, gone, out = {}, {}, {}
    for i, (s, url, st, et) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        k = url.split("?")[0]
        if k in anchor and anchor[k] <= gone.get(k, -1) < s:
            del anchor[k]
        ok = st is not None and st < 400
        if et != "error" and k in anchor and s - anchor[k] <= ttl:
            out[i] = "HIT"
        elif ok:
            anchor[k] = s
            out[i] = "MISS"
        else:
            out[i] = "ERROR"
        if et == "purchase":
            if k in anchor and anchor[k] <= gone.get(k, -1) < s:
                del anchor[k]
            gone[k] = s
    return out


def test_ttl_outcomes_match_sequential_walk(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for _ in range(300):
        rows.append((rnd.randint(0, 20 * 86400), f"https://s{rnd.randint(0, 3)}.com/p?x={rnd.randint(0, 9)}",
                     rnd.choice([200, 200, 200, 404, None]), rnd.choice(["view", "view", "error", "purchase"])))
    got = {r.event_id: r.outcome for r in T.ttl_outcomes(_requests(spark, rows), 86400).collect()}
    assert got == _brute_ttl(rows, 86400)
    assert sum(1 for v in got.values() if v == "HIT") + sum(1 for v in got.values() if v != "HIT") == len(rows)


def test_ttl_boundary_is_inclusive(spark):
    rows = [(0, "https://a.com/", 200, "view"), (86400, "https://a.com/", 200, "view"),
            (2 * 86400 + 1, "https://a.com/", 200, "view")]
    got = {r.event_id: r.outcome for r in T.ttl_outcomes(_requests(spark, rows), 86400).collect()}
    assert got == {0: "MISS", 1: "HIT", 2: "MISS"}


def test_invalidation_and_stats(spark):
    rows = [(0, "https://a.com/x", 200, "view"), (10, "https://b.com/y", 200, "view"),
            (20, "https://a.com/x?q=1", 200, "purchase"), (30, "https://b.com/y", 200, "view")]
    req = _requests(spark, rows)
    latest = {r.norm_url: r.stored_event_id for r in T.snapshot_latest(req).collect()}
    assert latest == {"https://b.com/y": 3}
    s = T.snapshot_stats(req, 86400).collect()[0]
    assert (s.total_entries, s.fresh_entries, s.deleted_entries) == (1, 1, 1)


def test_invalidation_makes_the_next_request_miss(spark):
    rows = [(0, "https://a.com/", 200, "view"), (10, "https://a.com/", 200, "purchase"), (10, "https://a.com/", 200, "view"),
            (20, "https://a.com/", 200, "view"), (30, "https://a.com/", 200, "view")]
    req = _requests(spark, rows)
    got = {r.event_id: r.outcome for r in T.ttl_outcomes(req, 86400).collect()}
    assert got == {0: "MISS", 1: "HIT", 2: "HIT", 3: "MISS", 4: "HIT"}
    asof_rows = {r.event_id: r.snapshot_event_id for r in T.snapshot_asof(req, 86400).collect()}
    assert asof_rows == {0: None, 1: 0, 2: 1, 3: None, 4: 3}
    assert T.snapshot_clear(req).collect()[0].deleted_entries == 1


@pytest.mark.parametrize("ranges", [1, 3, 25])
def test_ttl_and_asof_match_a_fold(spark, ranges):
    import random
    rnd = random.Random(ranges)
    rows = []
    for i in range(600):
        url = "https://hot.com/" if rnd.random() < 0.6 else f"https://{rnd.choice('abc')}.com/"
        rows.append((rnd.randint(0, 900), url, rnd.choice([200, 200, 200, 404, None]), rnd.choice(["view"] * 30 + ["purchase", "error"])))
    rows += [(rnd.randint(0, 900), "https://calm.com/", 200, "view") for _ in range(200)]
    req = _requests(spark, rows).repartition(4)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], i))
    events = [(rows[i][0], 0, i) for i in order] + [(t, 1, -1 - i) for i, (t, _, _, kind) in enumerate(rows) if kind == "purchase"]
    until, wrote, outcome, seen = {}, {}, {}, {}
    for t, delete, i in sorted(events):
        k = rows[i if i >= 0 else -1 - i][1]
        if delete:
            until.pop(k, None), wrote.pop(k, None)
            continue
        ok, forced = rows[i][2] == 200, rows[i][3] == "error"
        seen[i] = wrote.get(k)
        if not forced and k in until and t <= until[k]:
            outcome[i] = "HIT"
        else:
            outcome[i] = "MISS" if ok else "ERROR"
            if ok:
                until[k] = t + 37
        if ok:
            wrote[k] = i
    got = T.ttl_outcomes(req, 37, ranges=ranges, carry=("url",)).collect()
    assert {r.event_id: r.outcome for r in got} == outcome and len(got) == len(rows)
    assert {r.outcome for r in got} == {"HIT", "MISS", "ERROR"}
    found = {r.event_id: (r.snapshot_event_id, r.fresh) for r in T.snapshot_asof(req, 37, ranges=ranges).collect()}
    assert found == {i: (w, w is not None and rows[i][0] - rows[w][0] <= 37) for i, w in seen.items()}


def test_ttl_of_nothing(spark):
    req = _requests(spark, [(0, "https://a.com/", 200, "view")]).limit(0)
    assert T.ttl_outcomes(req).count() == 0 and T.snapshot_asof(req).count() == 0


def test_hot_key_is_spread_by_rows(spark):
    from sitelens.operators.prefix import RANGE, ranges
    log = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.col("id") % 3_000).alias("t"), "id")
    sizes = sorted(r["count"] for r in ranges(log, "k", [F.col("t"), F.col("id")], 12).groupBy(RANGE).count().collect())
    assert len(sizes) == 12 and sizes[-1] <= 2 * sizes[6]


def test_routing_targets(spark):
    df = spark.createDataFrame([
        (1, "GET", "Googlebot", "https://s.com/docs"), (2, "GET", "Googlebot", "https://s.com/api/x"),
        (3, "GET", "Googlebot", "https://s.com/_next/data"), (4, "GET", "Googlebot", "https://s.com/a.PNG"),
        (5, "POST", "Googlebot", "https://s.com/"), (6, "GET", "Chrome", "https://s.com/")],
        "event_id long, method string, user_agent string, url string")
    got = {r.event_id: (r.vercel, r.cloudflare, r.express, r.nginx) for r in T.prerender_routing(df).collect()}
    assert got[1] == (True, True, True, True)
    assert got[2] == (False, False, False, True)
    assert got[3] == (False, True, True, True)
    assert got[4] == (False, False, False, True)
    assert got[5] == (False, False, False, True)
    assert got[6] == (False, False, False, False)


def test_clean_html(spark):
    from sitelens.operators.html import clean_html
    html = ('<html><head><script src="https://www.googletagmanager.com/gtag/js"></script>'
            '<title>x</title></head><body>//# sourceMappingURL=app.js.map</body></html>')
    out = spark.createDataFrame([(html,), ("<p>no head</p>",)], "html string").select(
        clean_html(F.col("html")).alias("c")).collect()
    assert "googletagmanager" not in out[0].c and "sourceMappingURL" not in out[0].c
    assert out[0].c.startswith("<html><head>\n<!-- snapshot: prerendered -->")
    assert out[1].c.startswith("<!-- snapshot: prerendered -->\n<p>")


def test_bot_regex_from_table(spark):
    from sitelens.functions import constants as C
    bots = T.bot_agents(spark).unionByName(spark.createDataFrame([("x", "a.b|c")], "version string, token string"))
    got = {r.version: r.regex for r in T.bot_regex(bots).collect()}
    assert got[C.BOT_LIST_VERSION] == C.bot_alternation()
    assert got["x"] == r"a\.b\|c"


@pytest.mark.parametrize("block", [3, 100_000])
def test_token_lists_of_any_length(spark, block):
    agents = ["Googlebot/2.1 bot17x", "BOT999 bot99", "ab", "", None, "bot5 bot5 bot50", "ab"]
    req = spark.createDataFrame([(a, i % 3) for i, a in enumerate(agents)], "user_agent string, user_id int")
    words = [f"bot{i}" for i in range(20 if block == 3 else 100_000)] + ["", "a", "ab", "b", "nothing", None, "ab"]
    bots = spark.createDataFrame([("v", w) for w in words], "version string, token string")
    got = {(r.version, r.token): (r.hits, r.users) for r in T.bot_token_hits(req, bots, block).collect()}
    want = {}
    for w in set(words) - {None}:
        users = [i % 3 for i, a in enumerate(agents) if a is not None and w in a.lower()]
        if users:
            want["v", w] = (len(users) * words.count(w), len(set(users)))
    assert got == want
