"""HTML and metadata checks over ``pages`` (and over source text, shared
with the source-tree audit): metadata flags (F9, P14, P15), page-weight
counts (P17, P18, P19) and snapshot cleaning (P20).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as C
from sitelens.functions import patterns as P
from sitelens.functions.text import splitlines, strip_ws


def has_metadata_keyword(text: Column) -> Column:
    """cheap case-sensitive substring pre-filter before any regex."""
    out = F.lit(False)
    for k in C.METADATA_KEYWORDS:
        out = out | text.contains(k)
    return out


def title_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.TITLE), 1)


def document_title_lines(text: Column) -> Column:
    return F.filter(splitlines(text), lambda ln: ln.contains("document.title"))


def dynamic_assignment(line: Column) -> Column:
    """A ``document.title = value`` line whose value is not a plain string."""
    value = strip_ws(F.regexp_extract(line, P.DOCUMENT_TITLE_ASSIGN, 1))
    return line.rlike(P.DOCUMENT_TITLE_ASSIGN) & ~value.rlike(P.STATIC_QUOTED)


def with_metadata_flags(df: DataFrame, text: str, out: str = "f") -> DataFrame:
    """P14/P15 flags of one text (whole-file checks) as struct column ``out``.

    Titles inside ``<Helmet>`` blocks are also titles of the whole text, so
    the block scan only adds line numbers (metadata findings).  The title
    list and document.title lines are staged as columns, so each regex pass
    runs once per text."""
    t = F.col(text)
    df = (df.withColumn("__titles", title_texts(t))
          .withColumn("__doc_lines", document_title_lines(t)))
    titles, doc_lines = F.col("__titles"), F.col("__doc_lines")
    flags = F.struct(
        ((F.size(titles) > 0) | (F.size(doc_lines) > 0)).alias("sets_title"),
        t.rlike(P.DESCRIPTION).alias("sets_description"),
        t.rlike(P.OG_META).alias("sets_og_tags"),
        t.rlike(P.CANONICAL).alias("sets_canonical"),
        (F.exists(titles, lambda x: x.rlike(P.DYNAMIC_VALUE))
         | F.exists(doc_lines, dynamic_assignment)).alias("title_is_dynamic"),
        (F.size(doc_lines) > 0).alias("has_document_title"))
    return df.withColumn(out, flags).drop("__titles", "__doc_lines")


def html_metadata(pages: DataFrame) -> DataFrame:
    """Per page: F9 pre-filter, then the metadata flags (all false when the
    pre-filter rejects the page)."""
    kw = has_metadata_keyword(F.col("html"))
    cols = ["sets_title", "sets_description", "sets_og_tags", "sets_canonical", "title_is_dynamic"]
    staged = with_metadata_flags(pages.select("page_id", "html", kw.alias("has_keywords")), "html")
    return staged.select(
        "page_id", "has_keywords",
        *[(F.col("has_keywords") & F.col(f"f.{c}")).alias(c) for c in cols])


def images_without_dimensions(text: Column) -> Column:
    """``<img>`` tags carrying neither width nor height."""
    return F.regexp_count(text, F.lit(P.IMG_WITHOUT_DIMS))


def third_party_scripts(text: Column) -> Column:
    """``<script src="http(s)://...">`` tags."""
    return F.regexp_count(text, F.lit(P.THIRD_PARTY_SCRIPT))


def import_statements(text: Column) -> Column:
    """Import / require statements."""
    return F.regexp_count(text, F.lit(P.IMPORT_STMT))


def html_counts(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    return pages.select(
        "page_id", F.length(h).alias("html_chars"),
        images_without_dimensions(h).alias("images_without_dimensions"),
        third_party_scripts(h).alias("third_party_scripts"),
        import_statements(h).alias("import_statements"))


def strip_tracking(html: Column) -> Column:
    """P20, part 1: drop analytics/tracking/chat scripts and source maps."""
    h = html
    for pattern in P.STRIP_SCRIPTS:
        h = F.regexp_replace(h, pattern, "")
    return h


def mark_snapshot(h: Column) -> Column:
    """P20, part 2: the marker right after the first ``<head>``, else first."""
    pos = F.instr(h, "<head>")
    marked = F.concat(F.substring_index(h, "<head>", 1), F.lit("<head>\n" + C.PRERENDER_MARKER),
                      h.substr(pos + 6, F.length(h) + 1))
    return F.when(pos > 0, marked).otherwise(F.concat(F.lit(C.PRERENDER_MARKER + "\n"), h))


def clean_html(html: Column) -> Column:
    """P20 as one expression (use ``html_clean`` on tables: it stages the
    stripped text so the regex passes run once)."""
    return mark_snapshot(strip_tracking(html))


def html_clean(pages: DataFrame) -> DataFrame:
    staged = pages.select("page_id", strip_tracking(F.col("html")).alias("stripped"))
    cleaned = staged.select("page_id", mark_snapshot(F.col("stripped")).alias("html_clean"))
    return cleaned.select("page_id", F.sha2("html_clean", 256).alias("html_sha256"),
                          F.length("html_clean").alias("clean_chars"))
