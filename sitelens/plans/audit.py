"""The assembled corpus audit: one scan of ``site_files`` feeding four
independent branches (bundle, routes, metadata, cwv), then issues and score.

Each piece is built on first use, so a job that needs only routes (sitemap)
does not run the metadata branch.  Shared inputs are checkpointed once (to
``spark.checkpoint.dir``): branches read one materialised scan instead of
re-deriving it, and a lost executor only recomputes from the checkpoint.
Shuffles happen at the per-project aggregates and at the (project, path)
joins of route resolution; ``content`` is dropped before shuffles that do
not need it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from sitelens.operators import bundle as B
from sitelens.operators import chunks as CH
from sitelens.operators import components as K
from sitelens.operators import cwv as W
from sitelens.operators import issues as I
from sitelens.operators import metadata as M
from sitelens.operators import routes as R
from sitelens.operators import scan as S


class Audit:
    def __init__(self, site_files: DataFrame):
        self.site_files = site_files

    @cached_property
    def status(self) -> DataFrame:
        return S.project_status(self.site_files).checkpoint(eager=True)

    @cached_property
    def sources(self) -> DataFrame:
        # One scan of each text serves routes, metadata and components.
        return S.with_syntax(S.source_files(self.site_files, self.status)).checkpoint(eager=True)

    @cached_property
    def bundle(self) -> DataFrame:
        return B.analyse_bundle(self.site_files, self.sources).checkpoint(eager=True)

    @cached_property
    def routes(self) -> DataFrame:
        return R.map_routes(self.site_files, self.sources, self.status).checkpoint(eager=True)

    @cached_property
    def findings(self) -> DataFrame:
        return M.detect_metadata(self.sources).checkpoint(eager=True)

    @cached_property
    def cwv(self) -> DataFrame:
        return W.estimate_cwv(self.site_files, self.sources, self.routes).checkpoint(eager=True)

    @cached_property
    def facts(self) -> DataFrame:
        return I.project_facts(self.site_files, self.bundle, self.routes, self.findings, self.cwv).checkpoint(eager=True)

    @cached_property
    def issues(self) -> DataFrame:
        return I.issues(self.facts)

    @cached_property
    def score(self) -> DataFrame:
        return I.audit_score(self.status, self.facts, self.issues)

    @cached_property
    def components(self) -> DataFrame:
        return K.classify_components(self.sources).checkpoint(eager=True)

    @cached_property
    def chunks(self) -> DataFrame:
        return CH.chunk_files(self.sources)


def run_audit(site_files: DataFrame) -> Audit:
    return Audit(site_files)
