"""Ordered prefix sums and chains over ranges against plain loops, and how
evenly one project in one folder is spread."""

import random

import pytest
from pyspark.sql import functions as F

from sitelens.operators.chunks import chunk_files
from sitelens.operators.prefix import RANGE, prefix_sums, ranges
from test_chunks import _brute


@pytest.mark.parametrize("n", [1, 3, 16])
def test_prefix_sums(spark, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randint(0, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    got = prefix_sums(df, "k", [F.col("i").desc()], {"s": F.col("v"), "n": F.lit(1).cast("long")}, n).collect()
    sums, counts, want = {}, {}, {}
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
        want[i] = (k, v, sums[k], counts[k])
    assert {r.i: (r.k, r.v, r.s, r.n) for r in got} == want
    assert prefix_sums(df.limit(0), "k", [F.col("i")], {"s": F.col("v")}, n).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_packing_over_ranges_matches_the_fold(spark, n):
    rng = random.Random(n)
    names = ["index.jsx", "App.js", "x.js", "y.ts"]
    files, want = [], {}
    for project in ("one", "two", "small", "zeros"):
        own = []
        for i in range({"one": 400, "two": 60, "small": 1, "zeros": 30}[project]):
            size = 0 if project == "zeros" else rng.choice([0, 0, 1, 5, 20, 49, 50, 51, 200])
            own.append((f"src/{i % 3 if project == 'two' else 'same'}/{i:04d}/{rng.choice(names)}", size))
        files += [(project, p, "x" * s) for p, s in own]
        priority = {"index.jsx": 100, "App.js": 95}
        ordered = sorted(own, key=lambda f: (priority.get(f[0].split("/")[-1], 50), f[0]), reverse=True)
        for (p, s), part in zip(ordered, _brute([s for _, s in ordered], 50)):
            want[project, p] = (part, s)
    rng.shuffle(files)
    got = chunk_files(spark.createDataFrame(files, "project_id string, path string, content string"), 50, n).collect()
    assert {(r.project_id, r.path): (r.part_number, r.chars) for r in got} == want
    totals, chars = {}, {}
    for (k, _), (part, size) in want.items():
        totals[k] = max(totals.get(k, 0), part)
        chars[k, part] = chars.get((k, part), 0) + size
    assert all(r.total_parts == totals[r.project_id] and r.part_chars == chars[r.project_id, r.part_number] for r in got)
    assert max(totals.values()) > 20


def test_null_text_and_no_files(spark):
    schema = "project_id string, path string, content string"
    rows = chunk_files(spark.createDataFrame([("p", "a.js", None), ("p", "b.js", "xx")], schema)).collect()
    assert sorted((r.path, r.chars, r.part_number, r.part_chars) for r in rows) == [("a.js", 0, 1, 2), ("b.js", 2, 1, 2)]
    assert chunk_files(spark.createDataFrame([], schema)).count() == 0


def test_one_folder_is_spread_evenly(spark):
    files = spark.range(200_000).select(F.lit("p").alias("k"), F.concat(F.lit("src/pages/Doc"), "id", F.lit(".jsx")).alias("path"))
    sizes = sorted(r["count"] for r in ranges(files, "k", [F.col("path").desc()], 16).groupBy(RANGE).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]


def test_sitemap_numbers_static_routes(spark):
    from sitelens.plans.reports import sitemap, sitemap_index
    routes = spark.createDataFrame([("p", f"/s{i}", False, 2 * i, i) for i in range(1, 6)] + [("p", f"/d{i}/:x", True, 2 * i + 1, i) for i in range(1, 6)]
                                   + [("q", "/*", True, 1, 0)], "project_id string, path string, is_dynamic boolean, route_order int, static_order int")
    maps = sitemap(routes, max_urls=2)
    got = {(r.project_id, r.part): (r.url_count, [x.split("</loc>")[0] for x in r.xml.split(".example.com")[1:]], "dynamic routes" in r.xml) for r in maps.collect()}
    assert got == {("p", 1): (2, ["/s1", "/s2"], True), ("p", 2): (2, ["/s3", "/s4"], False), ("p", 3): (1, ["/s5"], False), ("q", 1): (0, [], True)}
    sheet = sitemap_index(maps).collect()
    assert [(r.project_id, r.parts, r.url_count, r.xml.count("<sitemap>")) for r in sheet] == [("p", 3, 5, 3)]
    assert sheet[0].xml.index("sitemap-1.xml") < sheet[0].xml.index("sitemap-3.xml")
