"""Metadata findings per source file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import matches, splitlines
from sitelens.operators.html import has_metadata_keyword, with_metadata_flags
from sitelens.operators.scan import with_syntax


def detect_metadata(sources: DataFrame) -> DataFrame:
    """One row per source file that manages metadata.

    F9's substring pre-filter runs before any regex; F10 keeps files with a
    strategy or a flag.  ``line_numbers`` are 1-based, sorted and distinct.
    """
    c = F.col("content")
    files = with_syntax(sources.where(has_metadata_keyword(c))).select(
        "project_id", "path", "content", F.col("syntax.imports").alias("imp_m"),
        matches(c, P.HELMET_BLOCK, "</helmet>").alias("blk_m"), matches(c, P.TITLE, "</title>").alias("ttl_m"))
    files = files.withColumn("doc_lines", F.when(c.contains("document.title"), F.filter(
        F.transform(splitlines(c), lambda ln, i: F.when(ln.contains("document.title"), i + 1)),
        lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>")))
    files = with_metadata_flags(files, "content")
    imports = F.transform(F.col("imp_m"),
                          lambda x, i: F.struct(i.alias("i"), x["line"].alias("line"), x["source"].alias("src")))
    asyncs = F.filter(imports, lambda x: x["src"] == "react-helmet-async")
    helmets = F.filter(imports, lambda x: x["src"] == "react-helmet")
    first_async = F.array_min(F.transform(asyncs, lambda x: x["i"]))
    first_helmet = F.element_at(helmets, 1)
    helmet_line = F.when((F.size(helmets) > 0) & (first_async.isNull() | (first_helmet["i"] < first_async)),
                         F.array(first_helmet["line"])).otherwise(F.array().cast("array<int>"))
    doc_lines = F.col("doc_lines")
    block_lines = F.transform(F.col("blk_m"), lambda x: x["line"])
    title_lines = F.transform(F.col("ttl_m"), lambda x: x["line"])
    lines = F.array_sort(F.array_distinct(F.concat(
        F.transform(asyncs, lambda x: x["line"]), helmet_line, block_lines, doc_lines, title_lines)))
    strategy = (F.when(F.size(asyncs) > 0, "react_helmet_async")
                .when(F.size(helmets) > 0, "react_helmet")
                .when(F.size(doc_lines) > 0, "document_title_direct")
                .otherwise("none"))
    f = F.col("f")
    out = files.select(
        "project_id", F.col("path").alias("file_path"), strategy.alias("strategy"),
        f["sets_title"].alias("sets_title"), f["sets_description"].alias("sets_description"),
        f["sets_og_tags"].alias("sets_og_tags"), f["sets_canonical"].alias("sets_canonical"),
        f["title_is_dynamic"].alias("title_is_dynamic"), lines.alias("line_numbers"))
    keep = ((F.col("strategy") != "none") | F.col("sets_title") | F.col("sets_description")
            | F.col("sets_og_tags") | F.col("sets_canonical"))
    return out.where(keep)
