"""Bundle facts per project from package.json and build configs
(P25, P26, P33–P37, O5).  One row per project with a manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as C
from sitelens.operators.scan import manifests, path_order, source_files

OUTDIR_RE = r"outDir\s*:\s*[\"']([^\"']+)[\"']"


def major_version(v: Column) -> Column:
    """P25: ``^[\\^~]?(\\d+)\\.`` after left-trimming spaces/tabs, else null."""
    trimmed = F.regexp_replace(v, "^[ \\t]+", "")
    return F.nullif(F.regexp_extract(trimmed, "^[\\^~]?([0-9]+)\\.", 1), F.lit(""))


def has_dep(name: str) -> Column:
    return F.map_contains_key("deps", name) | F.map_contains_key("dev_deps", name)


def dep_version(name: str) -> Column:
    """devDependencies override dependencies (later update wins)."""
    return F.coalesce(F.col("dev_deps")[name], F.col("deps")[name])


def any_dep(names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | has_dep(n)
    return out


def analyse_bundle(site_files: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Framework, rendering type, versions and SEO packages per project."""
    m = manifests(site_files)
    if sources is None:
        sources = source_files(site_files)
    entry = (sources.where("is_entry").groupBy("project_id")
             .agg(F.min_by("path", path_order(F.col("path"))).alias("entry_point")))
    configs = (site_files.where(F.col("path").isin(C.CONFIG_NAMES))
               .select("project_id", "path",
                       F.nullif(F.regexp_extract("content", OUTDIR_RE, 1), F.lit("")).alias("outdir")))
    first_outdir = (configs.where(F.col("outdir").isNotNull()).groupBy("project_id")
                    .agg(F.min_by("outdir", "path").alias("cfg_outdir")))
    top = (site_files.select("project_id", F.split("path", "/")[0].alias("top"))
           .where(F.col("top").isin("build", "dist"))
           .groupBy("project_id")
           .agg(F.max(F.col("top") == "build").alias("has_build"),
                F.max(F.col("top") == "dist").alias("has_dist")))

    cra = F.exists(F.map_values("scripts"), lambda v: v.contains("react-scripts"))
    framework = (F.when(has_dep("next"), "nextjs")
                 .when(has_dep("@craco/craco") | cra, "cra")
                 .when(has_dep("vite"), "vite")
                 .when(has_dep("webpack") | has_dep("webpack-cli"), "webpack")
                 .otherwise("unknown"))
    ssr, ssg = any_dep(C.SSR_PACKAGES), any_dep(C.SSG_PACKAGES)
    rendering = F.when(ssg, "ssg").when(ssr, "ssr").otherwise("csr")
    router = (F.when(has_dep("react-router-dom"), major_version(dep_version("react-router-dom")))
              .when(has_dep("react-router"), major_version(dep_version("react-router"))))
    n_deps = F.size(F.array_distinct(F.concat(F.map_keys("deps"), F.map_keys("dev_deps"))))
    build_dir = F.coalesce(F.col("cfg_outdir"),
                           F.when(F.col("has_build"), F.lit("build")),
                           F.when(F.col("has_dist"), F.lit("dist")))
    ok = F.col("json_ok")

    def valid(c: Column, default) -> Column:
        return F.when(ok, c).otherwise(F.lit(default))

    return (m.join(entry, "project_id", "left").join(first_outdir, "project_id", "left")
            .join(top, "project_id", "left")
            .select(
                "project_id",
                valid(framework, "unknown").alias("framework"),
                F.when(ok, major_version(dep_version("react"))).alias("react_version"),
                F.when(ok, router).alias("react_router_version"),
                valid(ssr, False).alias("has_ssr_setup"),
                valid(ssg, False).alias("has_ssg_setup"),
                valid(has_dep("react-helmet"), False).alias("has_helmet"),
                valid(has_dep("react-helmet-async"), False).alias("has_helmet_async"),
                valid(any_dep(C.REACT_QUERY_PACKAGES), False).alias("has_react_query"),
                valid(has_dep("swr"), False).alias("has_swr"),
                valid(any_dep(C.PRERENDER_PACKAGES), False).alias("has_existing_prerender"),
                F.when(ok, F.col("entry_point")).alias("entry_point"),
                F.when(ok, build_dir).alias("build_output_dir"),
                valid(n_deps, 0).alias("total_dependencies"),
                valid(rendering, "unknown").alias("rendering_type"),
            ))
