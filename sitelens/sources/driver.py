"""Readers for the driver tables and the two derived domain views.

The audit operators work on domain tables:

* ``requests(event_id, ts, user_id, event_type, method, user_agent, url,
  resource_type, status, forced)`` — traffic reaching the edge router and the
  prerender service;
* ``site_files(project_id, path, content)`` — the source trees of many
  projects;
* ``pages(page_id, url, html)`` — rendered HTML.

On the test cluster the first two are derived from the ``events`` and
``documents`` tables by the expressions below, so their size grows with the
input.  The same expression text is the DuckDB oracle's view definition (one
dialect token apart), so both engines see identical rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet so filters and projections reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Select list of the ``requests`` view over ``events``.
REQUEST_COLUMNS = [
    "event_id", "ts", "user_id", "event_type",
    "CASE WHEN event_id % 10 = 0 THEN 'POST' ELSE 'GET' END AS method",
    """CASE user_id % 8
    WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)'
    WHEN 1 THEN 'Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; GPTBot/1.2)'
    WHEN 2 THEN 'ClaudeBot/1.0'
    WHEN 3 THEN 'Screaming Frog SEO Spider/20.0'
    ELSE 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Chrome/120.0.0.0 Safari/537.36' END AS user_agent""",
    """concat(CASE WHEN event_id % 97 = 0 THEN 'ftp' ELSE 'https' END, '://site', CAST(user_id % 20 AS STRING), '.example.com',
    CASE WHEN event_id % 31 = 3 THEN '/v/google-analytics.com/collect.js' ELSE '' END,
    CASE event_id % 7 WHEN 0 THEN '/' WHEN 1 THEN '/about' WHEN 2 THEN '/api/items'
      WHEN 3 THEN '/_next/static/a.js' WHEN 4 THEN '/static/logo.PNG' WHEN 5 THEN '/product/7;v=2'
      ELSE '/docs/intro' END,
    CASE event_id % 5 WHEN 0 THEN '?utm_source=x' WHEN 1 THEN '#top' ELSE '' END) AS url""",
    "CASE event_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'script' ELSE 'document' END AS resource_type",
    "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status",
    "event_type = 'error' AS forced",
]

# ``pages`` as a browser leaves them: the given pages with the tags, trackers,
# images and addresses that real ones have.
PAGE_COLUMNS = [
    "page_id",
    """CASE page_id % 9 WHEN 1 THEN concat('https://shop.example.com/api/items/', CAST(page_id AS STRING))
    WHEN 4 THEN concat('https://shop.example.com/admin/', CAST(page_id AS STRING)) ELSE url END AS url""",
    """replace(replace(html, '</head>', concat(
    CASE WHEN page_id % 2 = 0 THEN '<meta name="description" content="d">' ELSE '' END,
    CASE WHEN page_id % 3 = 0 THEN '<meta property="og:title" content="t">' ELSE '' END,
    CASE WHEN page_id % 5 = 0 THEN '<link rel="canonical" href="/x">' ELSE '' END,
    CASE WHEN page_id % 4 = 1 THEN '<link rel="stylesheet" href="/static/a.css"><link rel="prefetch" href="/api/next">' ELSE '' END,
    CASE WHEN page_id % 7 = 0 THEN '<title>{data.name}</title>' ELSE '' END,
    CASE WHEN page_id % 4 = 0 THEN '<script async src="https://www.googletagmanager.com/gtag/js?id=1"></script>' ELSE '' END,
    CASE WHEN page_id % 6 = 1 THEN '<script src="https://cdn.segment.com/a.js">load()</script>' ELSE '' END,
    CASE WHEN page_id % 8 = 3 THEN '<SCRIPT src="https://widget.intercom.io/w"></SCRIPT><script src="/own.js"></script>' ELSE '' END, '</head>')),
    '</body>', concat(CASE WHEN page_id % 3 = 1 THEN '<img src="/a.png">' ELSE '' END,
    CASE WHEN page_id % 2 = 1 THEN '<IMG src="/b.png" width="2" height="2"><img alt="c">' ELSE '' END, '</body>',
    CASE WHEN page_id % 5 = 2 THEN concat(chr(10), '//# sourceMappingURL=app.js.map', chr(10), 'import a from "b";', chr(10)) ELSE '' END)) AS html""",
]

# ``site_files`` over ``documents``: (distinct, where, select list) per branch.
# ``{g}`` is the dialect token: DuckDB's regexp_replace needs ``'g'`` to
# replace every match, Spark replaces every match by default.
# ``N``: the project's number; its last digit picks the kind of project.
N = "CAST(substr(source, 4) AS INT)"
MINI = "doc_id % 20 = 7"
SITE_FILE_BRANCHES = [
    (True, N + " % 10 <> 8", [
        "source AS project_id", "'package.json' AS path",
        "CASE " + N + """ % 10
    WHEN 0 THEN '{"dependencies":{"react":"^18.2.0","react-router-dom":"^6.22.0","react-helmet-async":"^2.0.4"},"scripts":{"start":"react-scripts start"}}'
    WHEN 1 THEN '{"dependencies":{"react":"^18.2.0","swr":"2.0.0"},"devDependencies":{"vite":"^5.2.0","react":"~17.0.1"}}'
    WHEN 2 THEN '{"dependencies":{"react":">=16.0","next":"14.1.0"}}'
    WHEN 3 THEN '{"dependencies":{"express":"^4"}}'
    WHEN 5 THEN '{"dependencies":{"react":"17.0.2","react-helmet":"6.1.0","react-query":"3.39.0","react-router-dom":"~5.3.0"},"devDependencies":{"webpack":"5.0.0"}}'
    WHEN 6 THEN '{"dependencies":{"react":"18.0.0","gatsby":"5.0.0","react-snap":"1.23.0"}}'
    WHEN 7 THEN '{"dependencies":{"react":"18.0.0","@craco/craco":"7.0.0","@tanstack/react-query":"5.1.0"}}'
    WHEN 9 THEN '{"dependencies":{"react":"18.0.0","react-router":"^6.4.0"},"devDependencies":{"vite":"5.0.0"}}'
    ELSE '{not json' END AS content""",
    ]),
    (False, None, [
        "source AS project_id",
        "concat('src/pages/Doc', CAST(doc_id AS STRING), '.jsx') AS path",
        """concat('import React from ''react'';', chr(10),
    CASE WHEN doc_id % 3 = 0 THEN concat('import { Helmet } from ''react-helmet-async'';', chr(10)) ELSE '' END,
    'export default function Doc() {', chr(10),
    CASE doc_id % 4 WHEN 0 THEN concat('  const q = useQuery({ queryKey: [1] });', chr(10))
      WHEN 1 THEN concat('  React.useEffect(() => { fetch("/api/x"); }, []);', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 11 = 0 THEN concat('  document.title = ', CASE WHEN doc_id % 2 = 0 THEN '"News";' ELSE 'data.title;' END, chr(10)) ELSE '' END,
    CASE WHEN doc_id % 13 = 0 THEN concat('  window.scrollTo(0, 0);', chr(10)) ELSE '' END,
    '  return <>',
    CASE WHEN doc_id % 3 = 0 THEN '<Helmet><title>{data.name}</title><meta property="og:title" content="x" /></Helmet>' ELSE '' END,
    CASE WHEN doc_id % 7 = 0 THEN '<link rel="canonical" href="/" /><meta name="description" content="y" />' ELSE '' END,
    CASE WHEN doc_id % 17 = 0 THEN '<input accept="image/*" onChange={pick} />' ELSE '' END,
    '<h1>', regexp_replace(coalesce(text, ''), '[{}<>]', ' '{g}), '</h1>',
    CASE WHEN doc_id % 5 = 0 THEN '<img src="/a.jpg" />' ELSE '<img src="/a.jpg" width="3" />' END,
    '</>;', chr(10), '}', chr(10)) AS content""",
    ]),
    (False, N + " % 10 <> 6", [
        "source AS project_id",
        "concat('src/routes/R', CAST(doc_id AS STRING), '.jsx') AS path",
        """concat(CASE WHEN doc_id % 2 = 0 THEN 'const Doc = lazy(() => import(''../pages/Doc' ELSE 'import Doc from ''../pages/Doc' END, CAST(doc_id AS STRING),
    CASE WHEN doc_id % 2 = 0 THEN '''));' ELSE ''';' END, chr(10),
    'export const r = <Route path="/doc/', CAST(doc_id AS STRING),
    CASE WHEN doc_id % 6 = 0 THEN '/:id' ELSE '' END, '" element={',
    CASE WHEN doc_id % 8 = 0 THEN '<Guard opts={{a:{b:{c:1}}}}><Doc /></Guard>' ELSE '<Doc />' END, '} />;', chr(10)) AS content""",
    ]),
    # Path literals outside of route elements: the fallback.
    (False, "doc_id % 9 = 0 AND " + N + " % 10 <> 6", [
        "source AS project_id",
        "concat('src/nav/N', CAST(doc_id AS STRING), '.jsx') AS path",
        """concat('export const n = <Tab path="/nav/', CAST(doc_id AS STRING), '" />;', chr(10)) AS content""",
    ]),
    (True, N + " % 10 IN (0, 5)", [
        "source AS project_id", "'src/App.jsx' AS path",
        """concat('import Home from ''./Home'';', chr(10), 'export default () => <Routes>', chr(10),
    '  <Route path="/" element={<Home />} />', chr(10), '  <Route path="/docs/*" element={<Home />} />', chr(10),
    '  {/* admin area */}', chr(10), '  <Route path="/admin" component={Home} />', chr(10),
    '  {/* <Route path="/old" element={<Home />} /> */}', chr(10),
    '  <p>Don''t</p> {/* <Route path="/older" element={<Home />} /> */} <p>can''t: 12 o''clock</p>', chr(10),
    '  <Route path="/live" element={<Guard ok={a < b && c > d}><Home /></Guard>} >', chr(10), '    <Route path="/live/part" component={Home} />', chr(10), '  </Route>', chr(10),
    '  <Route path="/deep" element={<Home o={{{{{{{{{{{{{{{{{{{{ a: 1 }}}}}}}}}}}}}}}}}}}} />} /> {`<Route path="/text" /> $', '{a} it''s`}', chr(10),
    '</Routes>; // it''s <Route path="/never" /> useState(0)', chr(10), 'const u = "https://x/*", v = useMemo(() => 1); /* useRef(0) */ function useContext() {}', chr(10)) AS content""",
    ]),
    (True, N + " % 10 IN (1, 9)", [
        "source AS project_id", "'src/App.jsx' AS path",
        """concat('import Home from ''./Home'';', chr(10), 'export default () => useRoutes([', chr(10),
    '  { path: "/", element: <Home /> },', chr(10), '  { path: "/item/:id", component: Home },', chr(10), ']);', chr(10)) AS content""",
    ]),
    (True, None, [
        "source AS project_id", "CASE WHEN " + N + " % 2 = 0 THEN 'src/index.jsx' ELSE 'src/main.tsx' END AS path",
        "concat('import App from ''./App'';', chr(10), 'mount(document.body, <App />);', chr(10)) AS content",
    ]),
    (True, None, [
        "source AS project_id", "'src/Home.jsx' AS path",
        """concat('export default function Home() { const [a, b] = useState(0); const s = useSWR("/x"); return <p />; }', chr(10)) AS content""",
    ]),
    (True, N + " % 10 IN (1, 5)", [
        "source AS project_id", "CASE " + N + " % 10 WHEN 1 THEN 'vite.config.js' ELSE 'webpack.config.js' END AS path",
        "CASE " + N + """ % 10 WHEN 1 THEN 'export default { build: { outDir: "site" } };' ELSE 'module.exports = {};' END AS content""",
    ]),
    (True, N + " % 10 IN (5, 9)", [
        "source AS project_id", "CASE " + N + " % 10 WHEN 5 THEN 'build/a.txt' ELSE 'dist/a.txt' END AS path", "'a' AS content",
    ]),
    (True, None, [
        "source AS project_id", "CASE WHEN " + N + " % 2 = 0 THEN 'public/index.html' ELSE 'index.html' END AS path",
        "concat('<html><head>', CASE WHEN " + N + """ % 3 = 0 THEN '' ELSE '<script src="https://cdn.example.net/a.js"></script>' END,
    '<script src="/b.js"></script></head></html>') AS content""",
    ]),
    (False, "doc_id % 10 = 0", [
        "source AS project_id",
        "concat('node_modules/m', CAST(doc_id AS STRING), '/index.js') AS path",
        "'module.exports = {};' AS content",
    ]),
    (False, "doc_id % 10 = 1", [
        "source AS project_id",
        "concat('src/pages/Doc', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.test.jsx' WHEN 1 THEN '.spec.jsx' ELSE '.stories.jsx' END) AS path",
        "'check();' AS content",
    ]),
    # Small projects of three files: without metadata, with many imports for one
    # route, with Open Graph tags only, with canonical links only.
    (True, MINI, [
        "concat('mini', CAST(doc_id AS STRING)) AS project_id", "'package.json' AS path",
        """'{"dependencies":{"react":"18.2.0"}}' AS content""",
    ]),
    (True, MINI, [
        "concat('mini', CAST(doc_id AS STRING)) AS project_id", "'src/index.jsx' AS path",
        "concat('import App from ''./App'';', chr(10), 'mount(<App />);', chr(10)) AS content",
    ]),
    (True, MINI, [
        "concat('mini', CAST(doc_id AS STRING)) AS project_id", "'src/App.jsx' AS path",
        """concat(CASE WHEN doc_id % 80 = 7 THEN repeat(concat('import ''./m'';', chr(10)), 6) ELSE '' END,
    'export default () => <>', CASE doc_id % 80 WHEN 47 THEN '<meta property="og:image" content="/i.png" />' WHEN 67 THEN '<link rel="canonical" href="/" />' ELSE '' END,
    '<Route path="/" />', CASE WHEN doc_id % 80 = 27 THEN '<Route path="/more" element={<p>it''s</p>} />' ELSE '' END, '</>;', chr(10)) AS content""",
    ]),
    (True, N + " % 2 = 0", [
        "source AS project_id", "'public/robots.txt' AS path", "'User-agent: *' AS content",
    ]),
    (True, N + " % 4 = 1", [
        "source AS project_id", "'public/sitemap.xml' AS path", "'<urlset />' AS content",
    ]),
]

# File names of several priorities, one folder a project.
PART_PATH = ("concat('src/d', CAST(doc_id AS STRING), '/', CASE doc_id % 6 WHEN 0 THEN 'index.jsx' WHEN 1 THEN 'App.tsx' "
             "WHEN 2 THEN 'routes.jsx' WHEN 3 THEN 'Home.jsx' WHEN 4 THEN 'Product.tsx' ELSE 'note.js' END)")


def _g(dialect: str) -> str:
    return ", 'g'" if dialect == "duckdb" else ""


def requests_sql() -> str:
    """The ``requests`` view as SQL (same text in Spark and DuckDB)."""
    return "SELECT " + ",\n  ".join(REQUEST_COLUMNS) + "\nFROM events"


def site_files_sql(dialect: str = "spark") -> str:
    """The ``site_files`` view as SQL for ``dialect`` ('spark' or 'duckdb')."""
    parts = []
    for distinct, where, cols in SITE_FILE_BRANCHES:
        sel = ",\n  ".join(c.replace("{g}", _g(dialect)) for c in cols)
        parts.append(f"SELECT {'DISTINCT ' if distinct else ''}{sel}\nFROM documents"
                     + (f" WHERE {where}" if where else ""))
    return "\nUNION ALL\n".join(parts)


def requests_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``requests`` derived from ``events`` (one row per event)."""
    return read_table(spark, sf_dir, "events").selectExpr(*REQUEST_COLUMNS)


def site_files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site_files`` derived from ``documents`` (some three files per document and
    ten per project)."""
    docs = read_table(spark, sf_dir, "documents")

    def rows(distinct: bool) -> DataFrame:
        """All branches of a kind in one scan: a document's files as an array."""
        files = []
        for kind, where, cols in SITE_FILE_BRANCHES:
            if kind == distinct:
                fields = F.struct(*[F.expr(c.replace("{g}", _g("spark"))) for c in cols])
                files.append(F.when(F.expr(where), fields) if where else fields)
        found = docs.select(F.explode(F.array_compact(F.array(*files))).alias("f")).select("f.*")
        return found.distinct() if distinct else found

    return rows(False).unionByName(rows(True))


def pages_sql() -> str:
    """The ``pages`` view as SQL (same text in Spark and DuckDB)."""
    return "SELECT " + ",\n  ".join(PAGE_COLUMNS) + "\nFROM pages"


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with the parts that the given ones lack."""
    return read_table(spark, sf_dir, "pages").selectExpr(*PAGE_COLUMNS)
