"""Two small projects written for these tests, as ``site_files`` rows
(project_id, path, content).  ``bakery``: JSX routes, Helmet, an HTML shell
and a robots file.  ``atlas``: a router object, a build folder setting and
``document.title``."""

import json

BAKERY_MANIFEST = json.dumps({
    "dependencies": {"react": "~17.0.2", "react-dom": "~17.0.2", "react-router-dom": "~5.3.4",
                     "react-helmet-async": "1.3.0", "swr": "^2.2.0"},
    "scripts": {"dev": "react-scripts start"}})

BAKERY_SHELL = """<!doctype html>
<html><head><script src="https://cdn.example.net/w.js"></script></head>
<body><div id="oven"></div></body></html>
"""

BAKERY_ENTRY = """import { createRoot } from 'react-dom/client';
import App from './App';

createRoot(window.oven).render(<App />);
"""

BAKERY_APP = """import { lazy } from 'react';
import { BrowserRouter, Route } from 'react-router-dom';
import Front from './views/Front';
import Hours from './views/Hours';

const Order = lazy(() => import('./views/Order'));

export default () => (
  <BrowserRouter>
    <Route path="/" element={<Front />} />
    <Route path="/help/*" element={<Front />} />
    {/* <Route path="/closed" element={<Hours />} /> */}
    <Route path="/hours" element={<Hours />} />
    <Route path="/order/:cake" component={Order} />
  </BrowserRouter>
);
"""

BAKERY_FRONT = """import useSWR from 'swr';
import { Helmet } from 'react-helmet-async';

export default function Front() {
  const bread = useSWR('/api/bread');
  return <main>
    <Helmet><title>Fresh bread</title>
      <meta property="og:image" content="/loaf.png" />
      <link rel="canonical" href="/" /></Helmet>
    <ul>{bread.map(String)}</ul>
  </main>;
}
"""

BAKERY_HOURS = """export default function Hours() {
  return <section><img src="/door.png" /> Open from six to noon.</section>;
}
"""

BAKERY_ORDER = """import { useState } from 'react';
import { Helmet } from 'react-helmet-async';

export default function Order(props) {
  const [photo, pick] = useState(null);
  return <form>
    <Helmet><title>{props.cake}</title><meta name="description" content="Order a cake" /></Helmet>
    <input type="file" accept="image/*" onChange={pick} />
    {/* photo of the cake */}
  </form>;
}
"""

ATLAS_MANIFEST = json.dumps({
    "dependencies": {"react": "18.3.1", "react-dom": "18.3.1", "react-router": "^6.4.0"},
    "devDependencies": {"vite": "^5.0.0"}})

ATLAS_CONFIG = "export default { build: { outDir: 'public_html' } };\n"

ATLAS_MAIN = """import { createBrowserRouter } from 'react-router';
import Sheet from './Sheet';

export const maps = createBrowserRouter([
  { path: '/', element: <Sheet /> },
  { path: '/sheet/:grid', element: <Sheet /> },
]);
"""

ATLAS_SHEET = """export default function Sheet() {
  document.title = 'Map sheet';
  return <p>North is up.</p>;
}
"""

ROWS = [
    ("bakery", "package.json", BAKERY_MANIFEST),
    ("bakery", "public/index.html", BAKERY_SHELL),
    ("bakery", "public/robots.txt", "User-agent: *\n"),
    ("bakery", "src/index.jsx", BAKERY_ENTRY),
    ("bakery", "src/App.jsx", BAKERY_APP),
    ("bakery", "src/views/Front.jsx", BAKERY_FRONT),
    ("bakery", "src/views/Hours.jsx", BAKERY_HOURS),
    ("bakery", "src/views/Order.jsx", BAKERY_ORDER),
    ("atlas", "package.json", ATLAS_MANIFEST),
    ("atlas", "vite.config.js", ATLAS_CONFIG),
    ("atlas", "src/main.jsx", ATLAS_MAIN),
    ("atlas", "src/Sheet.jsx", ATLAS_SHEET),
]


def site_files(spark, extra=()):
    return spark.createDataFrame(list(ROWS) + list(extra), "project_id string, path string, content string")
