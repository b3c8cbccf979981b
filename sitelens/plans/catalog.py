"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each reads the driver tables (directly or through the derived ``requests`` /
``site_files`` views) over their whole extent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from sitelens.operators import bundle as B
from sitelens.operators import chunks as CH
from sitelens.operators import issues as I
from sitelens.operators import routes as R
from sitelens.plans import audit as A
from sitelens.plans import context as CX
from sitelens.plans import reports as RP
from sitelens.operators import html as H
from sitelens.operators import scan as S
from sitelens.operators import traffic as T
from sitelens.sources import driver as D
from sitelens.streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]


def _req(spark: SparkSession, sf: str) -> DataFrame:
    return D.requests_table(spark, sf)


TRAFFIC: dict[str, Query] = {
    "bot_requests": lambda s, sf: T.tag_bots(_req(s, sf)).select("event_id", "user_agent", "is_bot"),
    "bot_tokens_joined": lambda s, sf: T.bot_token_hits(_req(s, sf), T.bot_agents(s)),
    "prerender_routing": lambda s, sf: T.prerender_routing(_req(s, sf)),
    "blocked_resources": lambda s, sf: T.blocked_resources(_req(s, sf)),
    "failed_fetches": lambda s, sf: T.failed_fetches(_req(s, sf)),
    "crawl_allowed": lambda s, sf: T.crawl_allowed(D.pages_table(s, sf)),
    "url_keys": lambda s, sf: T.url_keys(D.pages_table(s, sf)),
    "snapshot_latest": lambda s, sf: T.snapshot_latest(_req(s, sf)),
    "snapshot_asof": lambda s, sf: T.snapshot_asof(_req(s, sf)),
    "snapshot_clear": lambda s, sf: T.snapshot_clear(_req(s, sf)),
    "snapshot_stats": lambda s, sf: T.snapshot_stats(_req(s, sf)),
    "ttl_hits": lambda s, sf: T.ttl_outcomes(_req(s, sf)).drop("t"),
    "service_metrics": lambda s, sf: T.service_metrics(_req(s, sf)),
}


HTML: dict[str, Query] = {
    "html_metadata": lambda s, sf: H.html_metadata(D.pages_table(s, sf)),
    "html_counts": lambda s, sf: H.html_counts(D.pages_table(s, sf)),
    "html_clean": lambda s, sf: H.html_clean(D.pages_table(s, sf)),
}


def _sf(spark: SparkSession, sf: str) -> DataFrame:
    # The derived view is materialised once so every branch reads a table.
    return D.site_files_table(spark, sf).checkpoint(eager=True)


def _audit(spark: SparkSession, sf: str) -> A.Audit:
    return A.run_audit(_sf(spark, sf))


def _imports_resolved(spark: SparkSession, sf: str) -> DataFrame:
    files = _sf(spark, sf)
    sources = S.source_files(files)
    lazy, imp = R.name_maps(sources, files.select("project_id", "path"))
    return (lazy.select("project_id", "file", "name", F.col("lazy_file").alias("resolved"),
                        F.lit("lazy").alias("kind"))
            .unionByName(imp.select("project_id", "file", "name", F.col("import_file").alias("resolved"),
                                    F.lit("import").alias("kind"))))


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    m = _audit(spark, sf).findings
    return m.withColumn("line_numbers", F.array_join("line_numbers", ","))


def _cwv(spark: SparkSession, sf: str) -> DataFrame:
    a = _audit(spark, sf)
    return a.cwv.withColumn("notes", F.array_join("notes", "\n"))


def _components(spark: SparkSession, sf: str) -> DataFrame:
    c = _audit(spark, sf).components
    return c.select("project_id", "file_path", "component_type",
                    F.array_join("reasons", " | ").alias("reasons"),
                    F.array_join("client_hooks_found", ", ").alias("client_hooks_found"),
                    "has_data_fetching", "data_fetch_pattern",
                    F.array_join("migration_notes", "\n").alias("migration_notes"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).chunks


def _document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.read_table(spark, sf, "documents").select(
        F.col("source").alias("project_id"),
        F.concat(F.lit("docs/doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("content"))
    return CH.chunk_files(docs)


# Small limits, so that the given tables make many parts.
SMALL_SITEMAP, SMALL_PART, SMALL_PAGE = 20, 20_000, 2_000


def _document_parts(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.read_table(spark, sf, "documents").selectExpr("source AS project_id", f"{D.PART_PATH} AS path", "text AS content")
    return CH.chunk_files(docs, SMALL_PART)


def _context(a: A.Audit) -> DataFrame:
    return CX.context_lines(a.score, a.bundle, a.routes, a.components).checkpoint(eager=True)


def _bundle_tokens(spark: SparkSession, sf: str) -> DataFrame:
    a = _audit(spark, sf)
    return RP.bundle_tokens(CH.chunk_files(a.sources, SMALL_PART), a.components, _context(a))


def _bundle_texts(spark: SparkSession, sf: str) -> DataFrame:
    a = _audit(spark, sf)
    return RP.bundle_texts(CH.chunk_files(a.sources, SMALL_PART), a.components, a.sources, CX.context_pages(_context(a), SMALL_PAGE))


# The report's time stamp is a parameter; the registered queries fix it.
ANALYSED_AT = "2024-01-01T00:00:00Z"


def _report_lines(spark: SparkSession, sf: str) -> DataFrame:
    a = _audit(spark, sf)
    return RP.report_lines(a.routes, a.findings)


def _report_rows(spark: SparkSession, sf: str) -> DataFrame:
    a = _audit(spark, sf)
    return RP.report_rows(a.score, a.bundle, a.cwv, a.issues, ANALYSED_AT)


AUDIT: dict[str, Query] = {
    "project_status": lambda s, sf: S.project_status(_sf(s, sf)),
    "source_files": lambda s, sf: S.source_files(_sf(s, sf)).drop("content"),
    "bundle_info": lambda s, sf: B.analyse_bundle(_sf(s, sf)),
    "imports_resolved": _imports_resolved,
    "routes": lambda s, sf: _audit(s, sf).routes.drop("static_order"),
    "metadata_findings": _metadata,
    "cwv_estimate": _cwv,
    "issues": lambda s, sf: _audit(s, sf).issues,
    "audit_score": lambda s, sf: _audit(s, sf).score,
    "components": _components,
    "chunks": _chunks,
    "document_chunks": _document_chunks,
    "bundle_tokens": _bundle_tokens,
    "bundle_context": lambda s, sf: CX.context_pages(_context(_audit(s, sf)), SMALL_PAGE),
    "bundle_texts": _bundle_texts,
    "sitemap": lambda s, sf: RP.sitemap(_audit(s, sf).routes),
    "sitemap_index": lambda s, sf: RP.sitemap_index(RP.sitemap(_audit(s, sf).routes, max_urls=SMALL_SITEMAP)),
    "document_parts": _document_parts,
    "report_json": lambda s, sf: RP.report_json(_report_rows(s, sf)),
    "report_lines": _report_lines,
    "issue_routes": lambda s, sf: I.issue_routes(_audit(s, sf).routes),
    "report_md": lambda s, sf: RP.report_markdown(_report_rows(s, sf)),
}


def _stream(spark: SparkSession, sf: str):
    # The given table is the stream's landing place; nothing is staged.  As a
    # pattern the path names a single file as well as a folder of part files.
    return ST.request_stream(spark, f"{sf.rstrip('/')}/events.parque[t]")


def _stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = ST.run_to_table(spark, ST.hourly_metrics(_stream(spark, sf)), "metrics", mode="update")
    return ST.latest_versions(t, ["hour"])


# A TTL that some snapshots of the given log have passed at its end.
LIVE_TTL = 6 * 3600

STREAMING: dict[str, Query] = {
    "stream_bot_tags": lambda s, sf: ST.run_to_table(s, ST.bot_tags(_stream(s, sf)), "bots").drop("_batch"),
    "stream_metrics": _stream_metrics,
    "stream_dedup": lambda s, sf: ST.run_dedup(s, _stream(s, sf)).drop("_batch"),
    "stream_ttl": lambda s, sf: ST.run_ttl(s, _stream(s, sf)).drop("_batch", "t"),
    "stream_service": lambda s, sf: ST.service_counters(ST.run_ttl(s, _stream(s, sf), "service")),
    "stream_snapshots": lambda s, sf: ST.snapshot_table(
        ST.run_to_table(s, ST.snapshot_events(_stream(s, sf)), "snapshots")),
    "stream_live": lambda s, sf: ST.run_snapshots(s, _stream(s, sf), ttl_seconds=LIVE_TTL),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for group in (TRAFFIC, HTML, AUDIT, STREAMING):
        out.update(group)
    return out
