"""Route discovery.

Every source file is scanned once; routes come from three extractors:

* JSX ``<Route …>`` elements (kind 0 = opening, 1 = self-closing) of the
  linear scanner in ``functions/jsx.py``,
* router objects ``{ path: '…', element: <X/> }`` when the file names
  ``createBrowserRouter`` / ``createHashRouter`` / ``useRoutes`` (kind 2),
* a ``path=``/``path:`` literal fallback, only for files where the first two
  found nothing (kind 3).

Component names resolve through the file's lazy map, then its import map;
relative imports resolve against the whole file table by a ranked-candidate
equi-join (J1).  Duplicate paths keep the first route in scan order (router
files first, then by path components, then kind, then text order) — a
``min(struct)`` aggregate, so duplicates are combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import constants as C
from sitelens.functions import patterns as P
from sitelens.functions.text import matches, strip_ws
from sitelens.operators.prefix import prefix_sums
from sitelens.operators.scan import path_order, project_status, source_files, with_syntax

SORTED_EXTS = sorted(C.JS_EXTENSIONS)


# ----------------------------------------------------------- scalar pieces
def attr_value(raw: Column) -> Column:
    """An attribute's value without whitespace, braces and quotes (a bare
    attribute yields its own name)."""
    s = strip_ws(raw)
    s = F.regexp_replace(s, r"^[{}]+|[{}]+$", "")
    return F.regexp_replace(s, "^['\"`]+|['\"`]+$", "")


def component_ref(raw: Column) -> Column:
    """First ``<Upper…`` name, else first capitalised identifier."""
    jsx = F.nullif(F.regexp_extract(raw, P.JSX_COMPONENT_REF, 1), F.lit(""))
    ident = F.nullif(F.regexp_extract(raw, P.IDENT_COMPONENT_REF, 1), F.lit(""))
    return F.coalesce(jsx, ident)


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def is_dynamic(path: Column) -> Column:
    """P6."""
    return path.rlike("[:*]")


def fetch_pattern(text: Column) -> Column:
    """P12 on the component file's text (route-level effect regex, Q1 kept)."""
    out = F.when(text.isNull(), F.lit("none"))
    for token, pattern in C.FETCH_HOOKS:
        out = out.when(text.contains(token), F.lit(pattern))
    return out.when(effect_fetches(text), "useEffect_fetch").otherwise("none")


def effect_fetches(text: Column) -> Column:
    """Whether ``USE_EFFECT_FETCH_ROUTE`` matches, in one pass: an effect's
    call, an arrow before the next closing parenthesis, a fetch call later."""
    signs = F.regexp_extract_all(text, F.lit(rf"{P.USE_EFFECT}|{P.FETCH}|=>|\)"), F.lit(0))
    seen = F.aggregate(signs, F.lit(0), lambda s, x: F.when(
        s < 2, F.when(x.startswith("useEffect"), 1).when(x == ")", 0).when((x == "=>") & (s == 1), 2).otherwise(s))
        .when(x.startswith("fetch"), 3).otherwise(s))
    return text.contains("useEffect") & text.contains("fetch") & (seen == 3)


def imported_identifiers(clause: Column) -> Column:
    """Local names bound by an import clause (default, ``* as``, named,
    ``as`` aliases)."""
    c = strip_ws(clause)
    empty = F.array().cast("array<string>")
    star = F.array(F.element_at(F.split(c, r"\s+"), -1))
    before = strip_ws(F.regexp_replace(F.substring_index(c, "{", 1), "[, ]+$", ""))
    named = F.split(F.regexp_extract(c, r"^[^{]*\{([^}]*)", 1), ",")
    named = F.filter(F.transform(named, strip_ws), lambda n: n != "")
    named = F.transform(named, lambda n: F.when(
        n.contains(" as "), strip_ws(F.regexp_extract(n, r"^.*? as (.*)$", 1))).otherwise(n))
    braces = F.concat(F.when(before != "", F.array(before)).otherwise(empty), named)
    plain = F.filter(F.array(strip_ws(F.substring_index(c, ",", 1))), lambda n: n != "")
    return (F.when(c.startswith("* as "), star)
            .when(c.contains("{") & c.contains("}"), braces)
            .when(c != "", plain)
            .otherwise(empty))


def normalize_join(directory: Column, rel: Column) -> Column:
    """``dir/rel`` with ``.`` dropped and ``..`` popped; null when it
    leaves the project root."""
    parts = F.split(F.concat(directory, F.lit("/"), rel), "/")
    init = F.struct(F.array().cast("array<string>").alias("a"), F.lit(False).alias("esc"))

    def step(acc, p):
        popped = F.struct(F.slice(acc["a"], 1, F.greatest(F.size(acc["a"]) - 1, F.lit(0))).alias("a"),
                          (acc["esc"] | (F.size(acc["a"]) == 0)).alias("esc"))
        pushed = F.struct(F.concat(acc["a"], F.array(p)).alias("a"), acc["esc"].alias("esc"))
        return F.when((p == "") | (p == "."), acc).when(p == "..", popped).otherwise(pushed)

    folded = F.aggregate(parts, init, step)
    return F.when(~folded["esc"] & (F.size(folded["a"]) > 0), F.array_join(folded["a"], "/"))


def resolution_candidates(base: Column) -> Column:
    """J1 candidates in probe order: the path itself when it has a source
    suffix, the suffix replaced by each source extension, then ``index``
    files of the directory.  array<struct<rank, path>>."""
    name = F.substring_index(base, "/", -1)
    directory = F.when(base.contains("/"), F.regexp_replace(base, "/[^/]*$", "/")).otherwise(F.lit(""))
    stem = F.concat(directory, F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1"))
    exts = "|".join(e.lstrip(".") for e in C.JS_EXTENSIONS)
    items = [F.struct(F.lit(0).alias("rank"),
                      F.when(F.lower(name).rlike(f"^.+\\.({exts})$"), base).alias("path"))]
    for i, e in enumerate(SORTED_EXTS):
        items.append(F.struct(F.lit(1 + i).alias("rank"), F.concat(stem, F.lit(e)).alias("path")))
    for i, e in enumerate(SORTED_EXTS):
        items.append(F.struct(F.lit(7 + i).alias("rank"), F.concat(base, F.lit("/index" + e)).alias("path")))
    return F.filter(F.array(*items), lambda x: x["path"].isNotNull())


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


# ------------------------------------------------------------ import maps
def resolve_imports(entries: DataFrame, all_paths: DataFrame) -> DataFrame:
    """(project_id, file, source) → resolved path or null.

    Distinct (file, source) pairs explode into ≤13 ranked candidates that are
    equi-joined with the project's whole file table (excluded folders
    included); the lowest-ranked hit wins.
    """
    pairs = entries.select("project_id", "file", "source").distinct()
    base = normalize_join(dirname(F.col("file")), F.col("source"))
    cands = (pairs.withColumn("base", base).where(F.col("base").isNotNull())
             .select("project_id", "file", "source",
                     F.explode(resolution_candidates(F.col("base"))).alias("c"))
             .select("project_id", "file", "source", F.col("c.rank").alias("rank"),
                     F.col("c.path").alias("path")))
    hits = cands.join(all_paths, ["project_id", "path"], "left_semi")
    resolved = hits.groupBy("project_id", "file", "source").agg(
        F.min_by("path", "rank").alias("resolved"))
    return pairs.join(resolved, ["project_id", "file", "source"], "left")


def name_maps(sources: DataFrame, all_paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per file: lazy map (name → file) and import map (identifier → file).
    Later entries win; entries whose import does not resolve are skipped."""
    c = F.col("content")
    lazy = (sources.where(c.contains("lazy"))
            .select("project_id", F.col("path").alias("file"),
                           F.posexplode(F.arrays_zip(
                               F.regexp_extract_all(c, F.lit(P.LAZY_ASSIGN), 1).alias("name"),
                               F.regexp_extract_all(c, F.lit(P.LAZY_ASSIGN), 2).alias("source"))))
            .select("project_id", "file", F.col("pos").alias("idx"),
                    F.col("col.name").alias("name"), F.col("col.source").alias("source")))
    imp = (sources.select("project_id", F.col("path").alias("file"),
                          F.posexplode(F.arrays_zip(
                              F.regexp_extract_all(c, F.lit(P.IMPORT_CLAUSE), 1).alias("clause"),
                              F.regexp_extract_all(c, F.lit(P.IMPORT_CLAUSE), 2).alias("source"))))
           .select("project_id", "file", F.col("pos").alias("idx"),
                   F.col("col.clause").alias("clause"), F.col("col.source").alias("source"))
           .where(F.col("source").startswith("."))
           .select("project_id", "file", "idx", "source",
                   F.posexplode(imported_identifiers(F.col("clause"))).alias("sub", "name")))
    lazy, imp = lazy.checkpoint(eager=True), imp.checkpoint(eager=True)
    res = resolve_imports(lazy.select("project_id", "file", "source")
                          .unionByName(imp.select("project_id", "file", "source")), all_paths)
    res = res.checkpoint(eager=True)  # read by both maps
    keys = ["project_id", "file", "source"]
    lazy_map = (lazy.join(res, keys).where(F.col("resolved").isNotNull())
                .groupBy("project_id", "file", "name")
                .agg(F.max_by("resolved", "idx").alias("lazy_file")))
    import_map = (imp.join(res, keys).where(F.col("resolved").isNotNull())
                  .groupBy("project_id", "file", "name")
                  .agg(F.max_by("resolved", F.struct("idx", "sub")).alias("import_file")))
    return lazy_map, import_map


# ---------------------------------------------------------------- routes
def route_candidates(sources: DataFrame) -> DataFrame:
    """Route rows of every source file before resolution and dedup.

    Elements come from the one-pass scanner, router objects and path literals
    from one pass of their pattern each; matches are exploded to rows early."""
    sources = with_syntax(sources)
    c = F.col("content")
    guard = F.lit(False)
    for g in C.ROUTER_OBJECT_GUARDS:
        guard = guard | c.contains(g)
    base = sources.select(
        "project_id", F.col("path").alias("file"), "is_router", "content",
        guard.alias("guard"), F.col("syntax.routes").alias("jsx"),
        F.regexp_extract_all(c, F.lit(P.LAZY_DECL), 1).alias("lazy_names"),
        (c.contains("React.lazy(") | c.contains("lazy(() => import(")).alias("any_lazy"))
    base = base.withColumn("cfg_m", matches(F.when(F.col("guard"), c), P.CONFIG_ROUTE)).withColumn("fb_m", matches(c, P.ROUTE_PATH_FALLBACK)).drop("content")
    base = base.checkpoint(eager=True)  # one scan feeds three extractors
    keep = ["project_id", "file", "is_router", "lazy_names", "any_lazy"]

    jsx = (base.select(*keep, F.posexplode("jsx").alias("pos", "e"))
           .select(*keep, "pos", "e.line", F.when(F.col("e.self_closing"), 1).otherwise(0).alias("kind"),
                   *[attr_value(F.col(f"e.{a}")).alias(b) for a, b in (("path", "path"), ("component", "comp"), ("element", "elem"))])
           .where(truthy(F.col("path")) & F.col("path").startswith("/"))
           .withColumn("raw", F.when(truthy(F.col("comp")), F.col("comp"))
                       .when(truthy(F.col("elem")), F.col("elem")).otherwise(F.lit("")))
           .withColumn("ref", component_ref(F.col("raw")))
           .withColumn("lazy_decl", F.when(F.col("ref").isNotNull(), F.array_contains("lazy_names", F.col("ref")))
                       .otherwise(F.col("any_lazy"))))
    cfg = (base.where("guard").select(*keep, F.posexplode("cfg_m").alias("pos", "e"))
           .select(*keep, "pos", F.lit(2).alias("kind"), F.col("e.line").alias("line"),
                   F.col("e.g1").alias("path"),
                   F.coalesce(F.nullif(F.col("e.g2"), F.lit("")), F.nullif(F.col("e.g3"), F.lit(""))).alias("ref"),
                   F.lit(False).alias("lazy_decl"))
           .where(F.col("path").startswith("/")))
    cols = ["project_id", "file", "is_router", "pos", "kind", "line", "path", "ref", "lazy_decl"]
    found = jsx.select(*cols).unionByName(cfg.select(*cols))
    fb = (base.select(*keep, F.posexplode("fb_m").alias("pos", "e"))
          .select(*keep, "pos", F.lit(3).alias("kind"), F.col("e.line").alias("line"),
                  F.col("e.g1").alias("path"), F.lit(None).cast("string").alias("ref"),
                  F.lit(False).alias("lazy_decl"))
          .where(F.col("path").startswith("/"))
          .join(found.select("project_id", "file").distinct(), ["project_id", "file"], "left_anti"))
    return found.unionByName(fb.select(*cols))


def map_routes(site_files: DataFrame, sources: DataFrame | None = None,
               status: DataFrame | None = None) -> DataFrame:
    """Routes per project: path, component file, dynamic, lazy, fetch
    pattern, line, and the report order ``route_order``."""
    if status is None:
        status = project_status(site_files)
    if sources is None:
        sources = source_files(site_files, status)
    all_paths = site_files.select("project_id", "path")
    lazy_map, import_map = name_maps(sources, all_paths)
    cand = route_candidates(sources)
    ref_key = [F.col("project_id"), F.col("file"), F.col("ref")]
    cand = (cand.join(lazy_map.withColumnRenamed("name", "ref"), ["project_id", "file", "ref"], "left")
            .join(import_map.withColumnRenamed("name", "ref"), ["project_id", "file", "ref"], "left"))
    resolved = F.when(F.col("kind") < 3, F.coalesce("lazy_file", "import_file"))
    is_lazy = (F.when(F.col("kind") < 2, F.col("lazy_file").isNotNull() | F.col("lazy_decl"))
               .when(F.col("kind") == 2, F.col("lazy_file").isNotNull())
               .otherwise(F.lit(False)))
    cand = cand.select("project_id", "path", "file", "is_router", "kind", "pos", "line",
                       resolved.alias("resolved"), is_lazy.alias("is_lazy"))
    # First route per (project, path) in scan order, combined map-side.
    order = F.struct((~F.col("is_router")).alias("nr"), path_order(F.col("file")).alias("fp"),
                     F.col("kind").alias("k"), F.col("pos").alias("p"))
    first = (cand.groupBy("project_id", "path")
             .agg(F.min(F.struct(order.alias("o"), "file", "resolved", "is_lazy", "line")).alias("x"))
             .select("project_id", "path", "x.o", "x.file", "x.resolved", "x.is_lazy", "x.line"))
    # The fetch pattern is computed map-side on every file, so only
    # (project, path, pattern) is shuffled for the join — never the text.
    patterns = site_files.select("project_id", F.col("path").alias("resolved"),
                                 fetch_pattern(F.col("content")).alias("comp_pattern"))
    first = first.join(patterns, ["project_id", "resolved"], "left")
    routes = first.select(
        "project_id", "path",
        F.coalesce("resolved", "file").alias("component_file"),
        is_dynamic(F.col("path")).alias("is_dynamic"),
        "is_lazy",
        F.when(F.col("resolved").isNull(), F.lit("none")).otherwise(F.coalesce("comp_pattern", F.lit("none")))
        .alias("data_fetch_pattern"),
        F.col("line").alias("line_number"), "o")
    # A project without routes gets the catch-all default.
    ok = status.where(F.col("status") == "ok").select("project_id")
    default = (ok.join(first.select("project_id").distinct(), "project_id", "left_anti")
               .select("project_id", F.lit("/*").alias("path"),
                       F.lit(None).cast("string").alias("component_file"),
                       F.lit(True).alias("is_dynamic"), F.lit(False).alias("is_lazy"),
                       F.lit("none").alias("data_fetch_pattern"),
                       F.lit(None).cast("int").alias("line_number"),
                       F.lit(None).cast(routes.schema["o"].dataType).alias("o")))
    allr = routes.unionByName(default)
    # Report order = running count in scan order, and the same over static
    # routes (a sitemap's numbering); ranges spread a project of one folder.
    one = F.lit(1).cast("long")
    ordered = prefix_sums(allr, "project_id", [F.col("o").asc_nulls_first(), F.col("path").asc()],
                          {"route_order": one, "static_order": F.when(F.col("is_dynamic"), 0).otherwise(one)})
    return ordered.withColumns({c: F.col(c).cast("int") for c in ("route_order", "static_order")}).drop("o")
