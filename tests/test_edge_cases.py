"""Edge cases of the extraction rules, with expectations derived by hand
from the audited tool's rules (SURVEY §2)."""

from pyspark.sql import functions as F

PKG = '{"dependencies":{"react":"^18.2.0"}}'


def _files(spark, rows, project="p"):
    return spark.createDataFrame([(project, "package.json", PKG)] + [(project, p, c) for p, c in rows],
                                 "project_id string, path string, content string")


def test_import_identifiers(spark):
    from sitelens.operators.routes import imported_identifiers
    df = spark.createDataFrame([("React, { useState as S, useEffect }",), ("* as Lib",), ("Default",),
                                ("{ a, , b as c }",)], "c string")
    got = [r.x for r in df.select(imported_identifiers(F.col("c")).alias("x")).collect()]
    assert got == [["React", "S", "useEffect"], ["Lib"], ["Default"], ["a", "c"]]


def test_relative_resolution(spark):
    from sitelens.operators.routes import resolve_imports
    files = _files(spark, [("src/components/index.tsx", "x"), ("src/Home.js", "x"), ("src/pages/A.jsx", "x"),
                           ("src/App.jsx", "x")])
    entries = spark.createDataFrame([
        ("p", "src/App.jsx", "./components"), ("p", "src/App.jsx", "./Home.page"),
        ("p", "src/App.jsx", "./pages/A"), ("p", "src/App.jsx", "../../x"), ("p", "src/App.jsx", "./missing")],
        "project_id string, file string, source string")
    got = {r.source: r.resolved for r in resolve_imports(entries, files.select("project_id", "path")).collect()}
    assert got == {"./components": "src/components/index.tsx", "./Home.page": "src/Home.js",
                   "./pages/A": "src/pages/A.jsx", "../../x": None, "./missing": None}


def test_router_object_and_fallback(spark):
    from sitelens.operators.routes import map_routes
    app = """import { createBrowserRouter } from 'react-router-dom';
import Shop from './Shop';
const router = createBrowserRouter([
  { path: '/shop', element: <Shop /> },
  { path: 'relative', element: <Shop /> },
]);
"""
    legacy = "const cfg = {\n  path: '/legacy/:id'\n};\n"
    shop = "export default function Shop() { const x = useSWR('/a'); return null; }\n"
    sf = _files(spark, [("src/App.jsx", app), ("src/legacy.js", legacy), ("src/Shop.jsx", shop)])
    got = {r.path: r for r in map_routes(sf).collect()}
    assert set(got) == {"/shop", "/legacy/:id"}
    assert (got["/shop"].component_file, got["/shop"].data_fetch_pattern, got["/shop"].line_number) == \
        ("src/Shop.jsx", "swr", 4)
    assert (got["/legacy/:id"].component_file, got["/legacy/:id"].is_dynamic, got["/legacy/:id"].line_number) == \
        ("src/legacy.js", True, 2)
    assert got["/shop"].route_order == 1


def test_default_route_when_none(spark):
    from sitelens.operators.routes import map_routes
    got = map_routes(_files(spark, [("src/index.js", "console.log(1)")])).collect()
    assert [(r.path, r.is_dynamic, r.component_file) for r in got] == [("/*", True, None)]


def test_document_title_strategy(spark):
    from sitelens.operators.metadata import detect_metadata
    from sitelens.operators.scan import source_files
    sf = _files(spark, [("src/a.js", "function f() {\n  document.title = 'Home';\n}\n"),
                        ("src/b.js", "document.title = `${name} | Shop`;\n"),
                        ("src/c.js", "const x = 1;\n")])
    got = {r.file_path: r for r in detect_metadata(source_files(sf)).collect()}
    assert set(got) == {"src/a.js", "src/b.js"}
    assert (got["src/a.js"].strategy, got["src/a.js"].title_is_dynamic, got["src/a.js"].line_numbers) == \
        ("document_title_direct", False, [2])
    assert got["src/b.js"].title_is_dynamic and got["src/b.js"].sets_title


def test_page_weight_counts(spark):
    from sitelens.operators.html import html_counts
    html = ('<img src="a.png"><IMG WIDTH="3" src="b"><img src="c" height=2>'
            '<script async src="https://cdn.example.com/x.js"></script><script src="/local.js"></script>')
    r = html_counts(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()[0]
    assert (r.images_without_dimensions, r.third_party_scripts) == (1, 1)


def test_semver_major(spark):
    from sitelens.operators.bundle import major_version
    df = spark.createDataFrame([("^18.2.0",), ("~17.0.1",), (">=16.0",), ("18",), (" \t^6.1",)], "v string")
    assert [r.m for r in df.select(major_version(F.col("v")).alias("m")).collect()] == ["18", "17", None, None, "6"]


def test_commented_code_is_ignored(spark):
    from sitelens.operators.components import classify_components
    from sitelens.operators.metadata import detect_metadata
    from sitelens.operators.routes import map_routes
    from sitelens.operators.scan import source_files
    app = """import Home from './Home';
/* old routes
<Route path="/old" element={<Home />} />
*/
// <Route path="/older" element={<Home />} />
export const r = <Route path="/" element={<Home />} />;
"""
    home = "// useState(0)\n// import { Helmet } from 'react-helmet';\nexport default function Home() { return <title>Hi</title>; }\n"
    sf = _files(spark, [("src/App.jsx", app), ("src/Home.jsx", home)])
    routes = {r.path: r for r in map_routes(sf).collect()}
    assert set(routes) == {"/"} and routes["/"].line_number == 6
    comps = {r.file_path: r for r in classify_components(source_files(sf)).collect()}
    assert comps["src/Home.jsx"].client_hooks_found == []
    meta = {r.file_path: r for r in detect_metadata(source_files(sf)).collect()}
    assert meta["src/Home.jsx"].strategy == "none" and meta["src/Home.jsx"].sets_title


def test_source_tree_with_binary_and_bad_bytes(spark, tmp_path):
    from sitelens.sources.tree import read_source_tree
    (tmp_path / "p" / "src").mkdir(parents=True)
    (tmp_path / "p" / "logo.png").write_bytes(b"\x89PNG\xff\xfe\x00")
    (tmp_path / "p" / "src" / "a.js").write_bytes("café = 1".encode("latin-1"))
    got = {r.path: r.content for r in read_source_tree(spark, str(tmp_path)).collect()}
    assert got == {"logo.png": None, "src/a.js": "caf� = 1"}
