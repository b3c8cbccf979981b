"""Project validity and source-file discovery over ``site_files``
(S1–S5, F1–F6, U4, O1).

``site_files(project_id, path, content)`` holds many projects; every
operator here is a projection plus per-project aggregates (map-side partial
aggregation), never a per-project collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as C
from sitelens.functions import jsx

# A project with more than one in so many of all files is joined without an
# exchange; there are fewer of them than that, however many projects there are.
LARGE_PROJECTS = 1000

MANIFEST_SCHEMA = ("dependencies map<string,string>, devDependencies map<string,string>, "
                   "scripts map<string,string>, _corrupt_record string")


def basename(path: Column) -> Column:
    """P24."""
    return F.substring_index(path, "/", -1)


def parse_manifest(content: Column) -> Column:
    """S3: package.json → struct(dependencies, devDependencies, scripts,
    _corrupt_record); broken JSON is flagged, not dropped."""
    return F.from_json(content, MANIFEST_SCHEMA,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def manifests(site_files: DataFrame) -> DataFrame:
    """One row per project that has a root package.json, with parsed maps."""
    m = (site_files.where(F.col("path") == "package.json")
         .select("project_id", parse_manifest(F.col("content")).alias("m")))
    empty = F.create_map().cast("map<string,string>")
    valid = F.col("m._corrupt_record").isNull()
    deps = F.coalesce(F.col("m.dependencies"), empty)
    dev = F.coalesce(F.col("m.devDependencies"), empty)
    return m.select(
        "project_id", valid.alias("json_ok"),
        F.when(valid, deps).alias("deps"), F.when(valid, dev).alias("dev_deps"),
        F.when(valid, F.coalesce(F.col("m.scripts"), empty)).alias("scripts"))


def project_status(site_files: DataFrame) -> DataFrame:
    """ok / no_package_json / invalid_json / not_react per project."""
    projects = site_files.select("project_id").distinct()
    m = manifests(site_files)
    has_react = F.map_contains_key("deps", "react") | F.map_contains_key("dev_deps", "react")
    status = (F.when(F.col("json_ok").isNull(), "no_package_json")
              .when(~F.col("json_ok"), "invalid_json")
              .when(~has_react, "not_react")
              .otherwise("ok"))
    return projects.join(m, "project_id", "left").select("project_id", status.alias("status"))


def is_excluded(path: Column) -> Column:
    """any path part (file name included) is an excluded directory name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in C.EXCLUDE_DIRS]))


def has_source_extension(path: Column) -> Column:
    """the name has a (case-insensitive) JS/TS suffix."""
    exts = "|".join(e.lstrip(".") for e in C.JS_EXTENSIONS)
    return F.lower(basename(path)).rlike(f"^.+\\.({exts})$")


def is_skipped_name(path: Column) -> Column:
    """test, spec and story files."""
    name = basename(path)
    out = F.lit(False)
    for frag in C.SKIP_NAME_FRAGMENTS:
        out = out | name.contains(frag)
    return out


def source_files(site_files: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Source files of valid projects with role flags.

    The search root is ``src/`` when the project has one.  That is a
    per-project aggregate (partial aggregation, one row per project) joined
    back, not a window over a possibly huge project.  Texts of a large project
    stay where they are: dealt by project they would meet in one task, and in
    one partition of all that is built on them.
    """
    if status is None:
        status = project_status(site_files)
    roots = (site_files.groupBy("project_id")
             .agg(F.max(F.col("path").startswith("src/")).alias("has_src"), F.count(F.lit(1)).alias("n"))
             .join(status, "project_id")
             .select("project_id", "has_src", "n", (F.col("status") == "ok").alias("ok")).checkpoint(eager=True))
    large = F.col("n") * LARGE_PROJECTS > roots.agg(F.sum("n")).scalar()
    path = F.col("path")
    files = site_files.where(~is_excluded(path) & ~is_skipped_name(path) & has_source_extension(path))
    few, others = roots.where(large).drop("n"), roots.where(~large & F.col("ok")).drop("n")
    rest = files.join(F.broadcast(few), "project_id", "left_anti").join(others, "project_id")
    files = (files.join(F.broadcast(few.where("ok")), "project_id").unionByName(rest)
             .where(~F.col("has_src") | path.startswith("src/")))
    name = basename(path)
    return files.select("project_id", "path", "content",
                        name.isin(C.ENTRY_NAMES).alias("is_entry"),
                        name.isin(C.ROUTER_NAMES).alias("is_router"))


def with_syntax(sources: DataFrame) -> DataFrame:
    """Source files with the ``syntax`` struct (route elements, hook calls,
    imports); as they are where it is there already."""
    if "syntax" in sources.columns:
        return sources
    return sources.withColumn("syntax", jsx.syntax(F.col("content"), F.col("path"), C.CLIENT_HOOKS))


def path_order(path: Column) -> Column:
    """O1: files compare by path components."""
    return F.split(path, "/")
