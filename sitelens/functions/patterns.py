"""Regex constants, written so Java (Spark) and RE2 (DuckDB oracle) agree.

FIXED VALUES — the patterns reproduce the audited tool's matching rules.
Portability rules applied throughout:

* ``.`` that must not cross a line is spelled ``[^\\n]`` (Java's ``.`` also
  stops at ``\\r`` and U+2028; Python's and RE2's only at ``\\n``);
* a Python-Unicode word boundary around a word is spelled with the class
  ``[^\\p{L}\\p{N}_]`` (Java's ``\\b`` and RE2's ``\\b`` disagree on accents);
* look-around is used only on the Spark side; the oracle spells the same rule
  as extract-then-filter.
"""

from __future__ import annotations

NW = r"[^\p{L}\p{N}_]"  # a non-word character (Unicode letters/digits/_)


def word(w: str) -> str:
    """``\\bw\\b`` with Unicode word characters, portable Java/RE2."""
    return rf"(^|{NW}){w}({NW}|$)"


# ---------------------------------------------------------------- FIXED VALUES
# HTML / metadata.
HELMET_BLOCK = r"(?s)<Helmet\b[^>]*>(.*?)</Helmet>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"
DESCRIPTION = r"(?i)<meta\b[^>]+name=[\"']description[\"'][^>]*>"
OG_META = r"(?i)og:(title|description|image|url)"
CANONICAL = r"(?i)rel=[\"']canonical[\"']"
DOCUMENT_TITLE_ASSIGN = r"document\.title\s*=\s*([^\n]+)"
DYNAMIC_VALUE = r"\{[^}]+\}|" + word("props") + "|" + word("state") + "|" + word("data") + r"|\?[^\n]*:"
STATIC_QUOTED = r"^[\"'][^\"']*[\"'];?$"

# Page weight.
IMG_WITHOUT_DIMS = r"(?is)<img(?![^>]*(?:width|height))[^>]*>"
IMG_TAG = r"(?i)<img[^>]*>"
WIDTH_OR_HEIGHT = r"(?i)width|height"
THIRD_PARTY_SCRIPT = r"(?i)<script[^>]+src=[\"']https?://"
IMPORT_STMT = r"(?m)^\s*(?:import\b|(?:const|let|var)\s+[^\n]+?=\s*require\s*\()"

# Snapshot cleaning (P20): tracking/chat scripts and source-map comments.
STRIP_SCRIPTS = [
    r"(?is)<script[^>]+(?:google-analytics|gtag|googletagmanager)[^>]*>.*?</script>",
    r"(?is)<script[^>]+(?:segment\.com|mixpanel|hotjar|clarity\.ms)[^>]*>.*?</script>",
    r"(?is)<script[^>]+(?:intercom|drift|crisp)[^>]*>.*?</script>",
    r"(?m)//# sourceMappingURL=\S+",
]
# ------------------------------------------------------------ END FIXED VALUES


# ---------------------------------------------------------------- FIXED VALUES
# Routes (P3–P9).
CONFIG_ROUTE = (r"path\s*:\s*[\"']([^\"']+)[\"'][\s\S]{0,200}?"
                r"(?:element\s*:\s*<([A-Z][A-Za-z0-9_]*)|component\s*:\s*([A-Z][A-Za-z0-9_]*))")
ROUTE_PATH_FALLBACK = r"path\s*[=:]\s*[\"']([^\"']+)[\"']"
LAZY_ASSIGN = (r"(?:const|let|var)\s+([A-Z][A-Za-z0-9_]*)\s*=\s*(?:React\.)?lazy\s*\(\s*\(\s*\)\s*=>"
               r"\s*import\(\s*[\"']([^\"']+)[\"']\s*\)\s*\)")
LAZY_DECL = r"(?:const|let|var)\s+([A-Z][A-Za-z0-9_]*)\s*=\s*(?:React\.)?lazy\s*\("
IMPORT_CLAUSE = r"import\s+([\p{L}\p{N}_\s{},*]+?)\s+from\s+[\"']([^\"']+)[\"']"
JSX_COMPONENT_REF = r"<\s*([A-Z][A-Za-z0-9_]*)"
IDENT_COMPONENT_REF = r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Za-z0-9_]*)(?:[^\p{L}\p{N}_]|$)"
USE_EFFECT_FETCH_ROUTE = r"useEffect\s*\([^)]*=>[\s\S]*?fetch\s*\("
USE_EFFECT, FETCH = r"useEffect\s*\(", r"fetch\s*\("
# ------------------------------------------------------------ END FIXED VALUES
