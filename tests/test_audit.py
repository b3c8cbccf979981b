from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_routes_golden(audit):
    got = rows(audit.routes, "project_id", "path", "component_file", "is_dynamic", "is_lazy",
               "data_fetch_pattern", "line_number")
    assert got == sorted([
        ("bakery", "/", "src/views/Front.jsx", False, False, "swr", 10),
        ("bakery", "/help/*", "src/views/Front.jsx", True, False, "swr", 11),
        ("bakery", "/hours", "src/views/Hours.jsx", False, False, "none", 13),
        ("bakery", "/order/:cake", "src/views/Order.jsx", True, True, "none", 14),
        ("atlas", "/", "src/Sheet.jsx", False, False, "none", 5),
        ("atlas", "/sheet/:grid", "src/Sheet.jsx", True, False, "none", 6),
    ])


def test_metadata_golden(audit):
    got = rows(audit.findings, "file_path", "strategy", "sets_title", "sets_description", "sets_og_tags",
               "sets_canonical", "title_is_dynamic", "line_numbers")
    assert got == [
        ("src/Sheet.jsx", "document_title_direct", True, False, False, False, False, [2]),
        ("src/views/Front.jsx", "react_helmet_async", True, False, True, True, False, [2, 7]),
        ("src/views/Order.jsx", "react_helmet_async", True, True, False, False, True, [2, 7]),
    ]


def test_bundle_golden(audit):
    got = {r.project_id: r for r in audit.bundle.collect()}
    b, a = got["bakery"], got["atlas"]
    assert (b.framework, b.rendering_type, b.react_version, b.react_router_version) == ("cra", "csr", "17", "5")
    assert (a.framework, a.rendering_type, a.react_version, a.react_router_version) == ("vite", "csr", "18", "6")
    assert (b.total_dependencies, a.total_dependencies) == (5, 4)
    assert (b.entry_point, a.entry_point) == ("src/index.jsx", "src/main.jsx")
    assert (b.build_output_dir, a.build_output_dir) == (None, "public_html")
    assert b.has_helmet_async and b.has_swr and not b.has_helmet and not a.has_react_query


def test_cwv_golden(audit):
    got = {r.project_id: r for r in audit.cwv.collect()}
    b = got["bakery"]
    # 2 imports in the entry, 4 and a lazy one in App, 2 each in Front and Order; 10 / 4 routes.
    assert (b.total_imports, b.estimated_js_imports_per_route, b.third_party_scripts) == (10, 2.5, 1)
    assert (b.lcp_risk, b.cls_risk, b.fid_risk, b.images_without_dimensions) == ("low", "medium", "medium", 1)
    a = got["atlas"]
    assert (a.total_imports, a.estimated_js_imports_per_route, a.cls_risk, a.fid_risk) == (2, 1.0, "low", "low")


def test_issues_and_score_golden(audit):
    fired = {}
    for r in audit.issues.collect():
        fired.setdefault(r.project_id, []).append((r.issue_no, r.rule))
        assert r.description and r.recommendation and r.docs_url.startswith("https://")
    assert [n for _, n in sorted(fired["bakery"])] == [1, 3, 4, 5, 9]
    assert [n for _, n in sorted(fired["atlas"])] == [1, 4, 5, 6, 7, 10]
    s = {r.project_id: r for r in audit.score.collect()}
    b, a = s["bakery"], s["atlas"]
    assert (b.critical_count, b.high_count, b.medium_count, b.low_count) == (1, 3, 1, 0)
    assert (a.critical_count, a.high_count, a.medium_count, a.low_count) == (1, 2, 2, 1)
    # 100 - 40 (client rendering) - 10 (its metadata) - 5 - 3 each high - 1 each medium
    assert (b.seo_score, a.seo_score, b.gate, a.gate) == (35, 37, 2, 2)
    assert (b.routes_with_client_metadata, a.routes_with_client_metadata) == (3, 2)


def test_issue_routes(audit):
    from sitelens.operators.issues import issue_routes
    i = {(r.project_id, r.rule): r for r in audit.issues.collect()}[("bakery", 4)]
    assert i.affected_routes == 2 and "/help/*, /order/:cake" in i.description
    got = rows(issue_routes(audit.routes), "project_id", "rule", "path")
    assert got == [("atlas", 4, "/sheet/:grid"), ("bakery", 4, "/help/*"), ("bakery", 4, "/order/:cake")]


def test_components_golden(audit):
    from sitelens.operators.components import classify_components
    got = {(r.project_id, r.file_path): r for r in classify_components(audit.sources).collect()}
    assert got[("bakery", "src/index.jsx")].reasons == ["Accesses browser global: window"]
    assert got[("bakery", "src/App.jsx")].component_type == "server"
    f = got[("bakery", "src/views/Front.jsx")]
    assert (f.component_type, f.client_hooks_found, f.data_fetch_pattern) == ("client", ["useSWR"], "swr")
    assert f.migration_notes
    o = got[("bakery", "src/views/Order.jsx")]
    assert o.client_hooks_found == ["useState"] and len(o.reasons) == 2


def test_static_component_is_server(spark):
    from sitelens.operators.components import classify_components
    df = spark.createDataFrame([("p", "src/S.jsx", "export default function S() { return <p>hi</p>; }")],
                               "project_id string, path string, content string")
    assert classify_components(df).collect()[0].component_type == "server"


def test_scan_excludes_and_status(spark):
    import fixtures
    from sitelens.operators.scan import project_status, source_files
    extra = [("bakery", "node_modules/react/index.js", "x"), ("bakery", "src/a.test.js", "x"),
             ("bad", "package.json", "{not json"), ("norx", "package.json", '{"dependencies":{"vue":"3"}}'),
             ("nopkg", "src/index.js", "x")]
    sf = fixtures.site_files(spark, extra)
    st = {r.project_id: r.status for r in project_status(sf).collect()}
    assert st == {"bakery": "ok", "atlas": "ok", "bad": "invalid_json",
                  "norx": "not_react", "nopkg": "no_package_json"}
    paths = {r.path for r in source_files(sf).where(F.col("project_id") == "bakery").collect()}
    assert "node_modules/react/index.js" not in paths and "src/a.test.js" not in paths
    assert "src/App.jsx" in paths


def test_sitemap_skips_dynamic(audit):
    from sitelens.plans.reports import sitemap
    xml = {r.project_id: r.xml for r in sitemap(audit.routes).collect()}["bakery"]
    assert "<loc>https://bakery.example.com/</loc>" in xml and "/hours</loc>" in xml
    assert "/order/:cake" not in xml and "2 dynamic" in xml
    assert "<priority>1.0</priority>" in xml and "<priority>0.8</priority>" in xml


def test_reports(audit):
    from sitelens.plans.reports import report_json, report_markdown, report_rows
    r = report_rows(audit.score, audit.bundle, audit.cwv, audit.issues, "2024-05-06T07:08:09Z")
    md = {x.project_id: x.markdown for x in report_markdown(r).collect()}
    assert "Score: 35 of 100 (critical)" in md["bakery"] and "| LCP | low |" in md["bakery"]
    assert report_json(r).count() == 2


def test_bundle_texts_and_tokens(spark, audit, tmp_path):
    from sitelens.operators.chunks import chunk_files
    from sitelens.plans.context import context_lines, context_pages
    from sitelens.plans.reports import bundle_texts, bundle_tokens, write_bundles
    chunks = chunk_files(audit.sources, 400)
    lines = context_lines(audit.score, audit.bundle, audit.routes, audit.components)
    pages = context_pages(lines, 120)
    assert all(r.bytes <= 120 and r.bytes == len(r.text.encode()) for r in pages.collect())
    whole = {r.project_id: "".join(x.text for x in sorted(r.p)) for r in pages.groupBy("project_id").agg(
        F.collect_list(F.struct("page", "text")).alias("p")).collect()}
    bakery = whole["bakery"]
    assert [x for x in bakery.split("\n") if x.startswith("## ")] == [
        "## Project", "## Routes", "## Server components (2)", "## Client components (3)", "## Notes", "## Dependencies"]
    assert "- `index.jsx`: Accesses browser global: window\n" in bakery and "| `/order/:cake` | `Order.jsx` | Y | useState | none |" in bakery
    assert "- remove: react-router-dom, react-helmet-async, react-scripts\n" in bakery
    texts = bundle_texts(chunks, audit.components, audit.sources, pages)
    size = {(r.project_id, r.part_number): (r.chars, r.files) for r in texts.groupBy("project_id", "part_number").agg(
        F.sum(F.length("text")).alias("chars"), F.count_if(F.col("kind") == 2).alias("files")).collect()}
    tokens = bundle_tokens(chunks, audit.components, lines).collect()
    parts = {(r.project_id, r.part_number): (r.chars, r.n_files) for r in tokens if r.part_number}
    assert parts == size and max(n for _, n in parts) > 2
    for r in tokens:
        assert r.part_number is None or r.estimated_tokens == r.chars // 4
        if r.part_number is None:
            own = [v for (p, _), v in size.items() if p == r.project_id]
            assert (r.chars, r.n_files, r.total_parts) == (sum(c for c, _ in own), sum(n for _, n in own), len(own))
            assert r.estimated_tokens == sum(c // 4 for c, _ in own)
    out = str(tmp_path / "bundles")
    write_bundles(texts, out)
    text = "\n".join(r.value for r in spark.read.text(out).where("project_id = 'bakery' AND part_number = 1").collect())
    assert text.index("## Project") < text.index("## Files") < text.index("### `index.jsx`") and "**Type:** CLIENT" in text


def test_pages_of_every_part_are_dealt_in_cells(spark):
    from sitelens.plans.reports import repeated
    parts = spark.createDataFrame([(p, i, 9) for p, n in (("big", 40), ("one", 1), ("bare", 3), (None, 2)) for i in range(1, n + 1)],
                                  "project_id string, part_number long, total_parts long")
    pages = spark.createDataFrame([(p, i, f"{p}{i}") for p, n in (("big", 30), ("one", 2), ("other", 1), (None, 1)) for i in range(1, n + 1)]
                                  + [("big", 7, "again")], "project_id string, place long, text string")
    columns = ["project_id", "part_number", "total_parts", "place", "text"]
    want = rows(parts.join(pages, "project_id"), *columns)
    assert len(want) == 40 * 31 + 2
    for cell in ((4, 3), (4096, 256)):
        assert rows(repeated(parts, pages, *cell), *columns) == want
    # A cell is bounded: the largest project is spread over the tasks.
    shares = [r["count"] for r in repeated(parts, pages, 4, 3).groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < len(want) / 2


def test_rows_of_a_page_follow_each_other(spark):
    from sitelens.plans.reports import repeated
    parts = spark.createDataFrame([("big", i, 400) for i in range(1, 401)] + [("gaps", i, 9) for i in (1, 1, 3, 3, 4, 9)] + [("gaps", None, 9)],
                                  "project_id string, part_number long, total_parts long")
    pages = spark.createDataFrame([(p, i, f"{p}{i}") for p, n in (("big", 20), ("gaps", 3)) for i in range(1, n + 1)], "project_id string, place long, text string")
    columns = ["project_id", "part_number", "total_parts", "place", "text"]
    want = rows(parts.where("part_number IS NOT NULL").join(pages, "project_id"), *columns)
    for cell in ((128, 4), (3, 4), (4096, 256)):
        assert rows(repeated(parts, pages, *cell), *columns) == want
    # A sink that writes a repeated text once finds it repeated: in long runs, not part by part.
    for cell in ((128, 4), (4096, 256)):
        texts = repeated(parts, pages, *cell).where("project_id = 'big'").select("text").rdd.map(lambda r: r.text).glom().collect()
        assert sum(len(t) for t in texts) == 8000
        assert sum(a != b for t in texts for a, b in zip(t, t[1:])) < 8000 / 30


def test_context_reads_no_text(spark, audit, capsys):
    from sitelens.plans.context import context_lines
    context_lines(audit.score, audit.bundle, audit.routes, audit.components).explain()
    assert "RLIKE(" not in capsys.readouterr().out.upper()


def test_facts_are_computed_once(audit, capsys):
    from sitelens.plans.reports import report_rows
    audit.score.explain()
    report_rows(audit.score, audit.bundle, audit.cwv, audit.issues, "2024-05-06T07:08:09Z").explain()
    assert not any(x in capsys.readouterr().out for x in ("is_lazy", "sets_og_tags"))


def test_texts_of_a_large_project_stay_spread(spark):
    from sitelens.operators.scan import project_status, source_files
    manifest = ("package.json", '{"dependencies":{"react":"18"}}')
    files = [("big", *manifest), ("small", *manifest), ("bad", "src/a.js", "z"), (None, "src/a.js", "n"),
             ("small", "b.js", "1"), ("small", "b.js", "1"), ("big", "lib/no.js", "x")]
    files += [(p, f"src/f{i}.js", str(i)) for p in ("big", "bad") for i in range(5000)]
    sf = spark.createDataFrame(files, "project_id string, path string, content string").repartition(8).checkpoint()
    got = source_files(sf, project_status(sf))
    want = sorted([("small", "b.js", "1")] * 2 + [("big", f"src/f{i}.js", str(i)) for i in range(5000)])
    assert rows(got, "project_id", "path", "content") == want
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < len(want) / 4


def test_context_pages_cut_long_lines(spark):
    from sitelens.plans.context import context_pages
    rows = [("p", 0, i, [], x) for i, x in enumerate(["é" * 30 + "\n", "", "ab\n", "x" * 41, "日本" * 9])]
    df = spark.createDataFrame(rows, "project_id string, section int, place long, item array<string>, line string")
    for ranges in (1, 4):
        got = sorted(context_pages(df, 8, ranges).collect(), key=lambda r: r.page)
        assert "".join(r.text for r in got) == "".join(r[4] for r in rows)
        assert all(r.bytes <= 8 for r in got) and [r.page for r in got] == list(range(1, len(got) + 1))
    assert context_pages(df.limit(0)).count() == 0


def test_source_tree_reader(spark, tmp_path):
    import fixtures
    from sitelens.plans.audit import run_audit
    from sitelens.sources.tree import read_source_tree
    for project, path, content in fixtures.ROWS:
        f = tmp_path / "tree" / project / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)
    sf = read_source_tree(spark, str(tmp_path / "tree"))
    got = sorted((r.project_id, r.path) for r in sf.select("project_id", "path").collect())
    assert got == sorted((p, q) for p, q, _ in fixtures.ROWS)
    score = {r.project_id: r.seo_score for r in run_audit(sf).score.collect()}
    assert score == {"bakery": 35, "atlas": 37}


def test_report_roundtrip(spark, audit, tmp_path):
    from sitelens.plans.reports import read_reports, report_rows, write_reports
    rows = report_rows(audit.score, audit.bundle, audit.cwv, audit.issues, "2024-05-06T07:08:09Z")
    write_reports(rows, str(tmp_path / "reports"))
    back = {r.project_id: r for r in read_reports(spark, str(tmp_path / "reports"), rows.drop("project_id").schema
                                                  .add("project_id", "string")).collect()}
    assert back["bakery"].seo_score == 35 and len(back["bakery"].issues) == 5
