"""Fixed values that must equal the audited tool's behaviour.

FIXED VALUES — these lists, names, numbers and patterns define the result
semantics and are kept verbatim, in their natural order, in this one module.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Crawler user-agent substrings (list version 2025.04), matched lower-cased.
BOT_LIST_VERSION = "2025.04"
BOT_TOKENS = [
    "googlebot", "google-inspectiontool", "bingbot", "msnbot", "slurp",
    "duckduckbot", "baiduspider", "yandexbot", "sogou", "exabot", "facebot",
    "ia_archiver", "applebot", "gptbot", "oai-searchbot", "chatgpt-user",
    "claudebot", "anthropic-ai", "perplexitybot", "youbot", "amazonbot",
    "bytespider", "meta-externalagent", "semrushbot", "ahrefsbot", "mj12bot",
    "dotbot", "rogerbot", "screaming frog", "facebookexternalhit", "twitterbot",
    "linkedinbot", "slackbot", "slack-imgproxy", "discordbot", "telegrambot",
    "whatsapp", "iframely", "embedly", "prerender", "headlesschrome",
]

# Snapshot cache time-to-live, seconds.
DEFAULT_TTL_SECONDS = 86_400

# Sub-resources the renderer refuses to load.
BLOCKED_RESOURCE_TYPES = ["image", "font", "media"]
BLOCKED_URL_SUBSTRINGS = [
    "google-analytics", "googletagmanager", "gtag", "segment.com", "mixpanel",
    "hotjar", "clarity.ms", "intercom", "drift", "crisp",
]

# Static-asset extensions the edge routers never send to the prerenderer.
STATIC_ASSET_EXTENSIONS = [
    "js", "css", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2",
    "ttf", "eot", "map",
]

# robots.txt disallow prefixes.
ROBOTS_DISALLOW = ["/api/", "/static/", "/_next/"]

# Marker inserted into cleaned snapshots.
PRERENDER_MARKER = "<!-- snapshot: prerendered -->"

# Project scan: excluded directory names (any path part), source extensions,
# skipped name fragments, entry-point names, router-file names, config names.
EXCLUDE_DIRS = [
    "node_modules", "dist", "build", ".git", ".next", "coverage", "__tests__",
    ".cache", "public", "out",
]
JS_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
SKIP_NAME_FRAGMENTS = [".test.", ".spec.", ".stories."]
ENTRY_NAMES = [
    "index.js", "index.jsx", "index.ts", "index.tsx",
    "main.js", "main.jsx", "main.ts", "main.tsx",
]
ROUTER_NAMES = [
    "App.jsx", "App.tsx", "App.js", "App.ts", "routes.jsx", "routes.tsx",
    "Router.jsx", "Router.tsx", "AppRouter.jsx", "AppRouter.tsx",
]
CONFIG_NAMES = [
    "vite.config.js", "vite.config.ts", "webpack.config.js", "webpack.config.ts",
    "craco.config.js", "next.config.js", "next.config.ts",
]
HTML_SHELLS = ["index.html", "public/index.html"]

# package.json dependency groups.
SSR_PACKAGES = ["next", "@remix-run/react", "gatsby", "astro", "express", "fastify", "@hapi/hapi"]
SSG_PACKAGES = ["gatsby", "astro", "@11ty/eleventy", "nuxt"]
REACT_QUERY_PACKAGES = ["@tanstack/react-query", "react-query"]
PRERENDER_PACKAGES = ["prerender", "react-snap", "react-snap-shot", "rendertron", "puppeteer"]

# Metadata keyword pre-filter (case-sensitive substrings).
METADATA_KEYWORDS = [
    "Helmet", "document.title", "<title", "og:", "canonical", "meta name", "meta property",
]

# Route data-fetch hooks, in precedence order.
FETCH_HOOKS = [
    ("useQuery", "react_query"),
    ("useMutation", "react_query"),
    ("useSWR", "swr"),
    ("useBaseQuery", "rtk_query"),
]

# Router-object guards.
ROUTER_OBJECT_GUARDS = ["createBrowserRouter", "createHashRouter", "useRoutes"]

# Component classification: client hooks and browser globals.
CLIENT_HOOKS = [
    "useState", "useReducer", "useContext", "useRef", "useCallback", "useMemo",
    "useEffect", "useLayoutEffect", "useImperativeHandle", "useDeferredValue",
    "useTransition", "useNavigate", "useLocation", "useParams", "useSearchParams",
    "useHistory", "useRouteMatch", "useQuery", "useMutation", "useSWR",
    "useSelector", "useDispatch", "useForm", "useAnimation", "useMotionValue",
]
CLIENT_GLOBALS = [
    "window", "document", "localStorage", "sessionStorage", "navigator",
    "location", "history", "alert", "confirm", "requestAnimationFrame",
    "cancelAnimationFrame", "IntersectionObserver", "ResizeObserver",
    "MutationObserver",
]

# Chunking: default target size and file-name priorities (default 50).
DEFAULT_CHUNK_TARGET_CHARS = 320_000
DEFAULT_FILE_PRIORITY = 50
FILE_PRIORITIES = {
    "index.jsx": 100, "index.tsx": 100, "index.js": 100, "main.jsx": 100,
    "main.tsx": 100, "App.jsx": 95, "App.tsx": 95, "App.js": 95,
    "routes.jsx": 90, "routes.tsx": 90, "Router.jsx": 90, "Home.jsx": 80,
    "Home.tsx": 80, "About.jsx": 70, "About.tsx": 70, "Product.jsx": 70,
    "Product.tsx": 70,
}

# Score weights.
SCORE_START = 100
SCORE_CSR_PENALTY = 40
SCORE_NO_ROUTES_PENALTY = 15
SCORE_CLIENT_METADATA_PENALTY = 10
SCORE_CRITICAL_EACH, SCORE_CRITICAL_CAP = 5, 20
SCORE_HIGH_EACH, SCORE_HIGH_CAP = 3, 15
SCORE_MEDIUM_EACH, SCORE_MEDIUM_CAP = 1, 10
# ------------------------------------------------------------ END FIXED VALUES


def bot_alternation() -> str:
    """The crawler list as one alternation (no token holds a regex metachar)."""
    for token in BOT_TOKENS:
        assert not any(ch in token for ch in r".^$*+?()[]{}|\\"), token
    return "|".join(BOT_TOKENS)
