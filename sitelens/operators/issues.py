"""Issue rules, counts, score and gate per project
(P43–P46, J4–J6, A1, A2, A5, O4, F11, F12).

Every input (bundle, routes, findings, cwv, assets) is first reduced to one
row per project; the ten rules are then one ``array_compact(array(CASE …))``
over that row, exploded with its position so rule order is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import constants as C
from sitelens.operators.scan import path_order

# Rule number → (severity, category, title, description, recommendation,
# page of public documentation).  All wording is our own.
SEO_DOCS = "https://developers.google.com/search/docs/"
RULES = [
    (1, "critical", "rendering", "Client-side rendering: crawlers receive an empty HTML shell",
     "The server sends a page without content; a crawler that runs no scripts indexes nothing.",
     "Render on the server or at build time, or send crawlers a prerendered snapshot.",
     SEO_DOCS + "crawling-indexing/javascript/javascript-seo-basics"),
    (2, "critical", "metadata", "No title or description management found",
     "No source file sets a title or a description, so all pages look alike in results.",
     "Give every route its own title and description.",
     SEO_DOCS + "appearance/title-link"),
    (3, "high", "metadata", "Metadata is set client-side only on a CSR app",
     "Titles and descriptions appear only after scripts have run; most crawlers and link previews miss them.",
     "Send the metadata in the first HTML response.",
     SEO_DOCS + "crawling-indexing/javascript/javascript-seo-basics"),
    (4, "high", "routing", "dynamic route(s) missing from any sitemap",
     "Paths with parameters cannot be listed from the source alone, the first ones being: ",
     "List their real addresses from the content store when the site is built.",
     SEO_DOCS + "crawling-indexing/sitemaps/build-sitemap"),
    (5, "high", "crawlability", "No sitemap.xml",
     "Neither the public folder nor the project root holds a sitemap.",
     "Publish the generated sitemap and name it in robots.txt.",
     SEO_DOCS + "crawling-indexing/sitemaps/overview"),
    (6, "medium", "metadata", "No Open Graph tags",
     "Shared links show neither a chosen title nor a picture.",
     "Set og:title, og:description, og:image and og:url on every route.",
     "https://ogp.me/"),
    (7, "medium", "metadata", "No canonical link tags",
     "Addresses that differ in parameters may be indexed as separate pages.",
     "Name one canonical address on every route.",
     SEO_DOCS + "crawling-indexing/consolidate-duplicate-urls"),
    (8, "medium", "cwv", "LCP risk: heavy JavaScript per route",
     "Many modules load before the largest element can be drawn.",
     "Split the code by route and load the rest on demand.",
     "https://web.dev/articles/lcp"),
    (9, "medium", "cwv", "CLS risk: image(s) without dimensions",
     "Images without width and height move the page while they load.",
     "Give every image its width and height or reserve its place.",
     "https://web.dev/articles/cls"),
    (10, "low", "crawlability", "No robots.txt",
     "Crawlers get no rules and no pointer to the sitemap.",
     "Add a robots.txt to the public folder.",
     SEO_DOCS + "crawling-indexing/robots/intro"),
]
HELMET_STRATEGIES = ["react_helmet", "react_helmet_async"]
CLIENT_STRATEGIES = ["react_helmet", "react_helmet_async", "document_title_direct"]
AFFECTED_FILES_SHOWN = 5
DYNAMIC_PATHS_SHOWN = 3


def project_facts(site_files: DataFrame, bundle: DataFrame, routes: DataFrame,
                  findings: DataFrame, cwv: DataFrame) -> DataFrame:
    """One row per audited project with everything the rules need."""
    r = routes.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_routes"),
        F.count_if("is_dynamic").alias("dynamic_routes"),
        F.count_if("is_lazy").alias("lazy_routes"),
        F.max(F.col("path") != "/*").alias("has_real_route"))
    f = findings.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(F.col("strategy").isin(HELMET_STRATEGIES)).alias("n_helmet"),
        F.max("sets_og_tags").alias("any_og"),
        F.max("sets_canonical").alias("any_canonical"))
    # The first five helmet-managed files in file order (WindowGroupLimit
    # applies the top-k before the shuffle).
    w = Window.partitionBy("project_id").orderBy(path_order(F.col("file_path")))
    top_files = (findings.where(F.col("strategy").isin(HELMET_STRATEGIES))
                 .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= AFFECTED_FILES_SHOWN)
                 .groupBy("project_id")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file_path"))),
                                               lambda x: x["file_path"]), ", ").alias("helmet_files")))
    # The first three dynamic paths in report order.
    wd = Window.partitionBy("project_id").orderBy("route_order")
    top_paths = (routes.where("is_dynamic").withColumn("rn", F.row_number().over(wd))
                 .where(F.col("rn") <= DYNAMIC_PATHS_SHOWN).groupBy("project_id")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "path"))),
                                               lambda x: x["path"]), ", ").alias("dynamic_paths")))
    # Routes whose component file sets metadata client-side.
    client = findings.where(F.col("strategy").isin(CLIENT_STRATEGIES)).select(
        "project_id", F.col("file_path").alias("component_file"))
    rcm = (routes.join(client, ["project_id", "component_file"], "left_semi")
           .groupBy("project_id").agg(F.count(F.lit(1)).alias("routes_with_client_metadata")))
    # Public assets in public/ or the root.
    assets = (site_files.where(F.col("path").isin("public/sitemap.xml", "sitemap.xml",
                                                   "public/robots.txt", "robots.txt"))
              .groupBy("project_id").agg(
                  F.max(F.col("path").endswith("sitemap.xml")).alias("has_sitemap"),
                  F.max(F.col("path").endswith("robots.txt")).alias("has_robots")))
    x = (r.join(bundle.select("project_id", "framework", "rendering_type"), "project_id", "left")
         .join(f, "project_id", "left").join(top_files, "project_id", "left")
         .join(top_paths, "project_id", "left").join(rcm, "project_id", "left").join(assets, "project_id", "left")
         .join(cwv.select("project_id", "lcp_risk", "images_without_dimensions"), "project_id", "left"))
    return x.na.fill(0, ["n_findings", "n_helmet", "routes_with_client_metadata"]).na.fill(
        False, ["any_og", "any_canonical", "has_sitemap", "has_robots"])


def issues(facts: DataFrame) -> DataFrame:
    """Fired rules per project, in rule order."""
    csr = F.col("rendering_type") == "csr"
    fires = {
        1: csr,
        2: F.col("n_findings") == 0,
        3: (F.col("n_helmet") > 0) & csr,
        4: F.col("dynamic_routes") > 0,
        5: ~F.col("has_sitemap"),
        6: ~F.col("any_og"),
        7: ~F.col("any_canonical"),
        8: F.col("lcp_risk") == "high",
        9: F.col("images_without_dimensions") > 0,
        10: ~F.col("has_robots"),
    }
    title = {r[0]: F.lit(r[3]) for r in RULES}
    described = {r[0]: F.lit(r[4]) for r in RULES}
    described[4] = F.concat(described[4], F.coalesce("dynamic_paths", F.lit("")))
    title[4] = F.concat(F.col("dynamic_routes").cast("string"), F.lit(" " + RULES[3][3]))
    title[9] = F.concat(F.lit(RULES[8][3] + ": "), F.col("images_without_dimensions").cast("string"))
    files = {3: F.col("helmet_files")}
    n_routes = {4: F.col("dynamic_routes")}
    items = [F.when(fires[n], F.struct(
        F.lit(n).alias("rule"), F.lit(sev).alias("severity"), F.lit(cat).alias("category"),
        title[n].alias("title"), described[n].alias("description"),
        F.lit(rec).alias("recommendation"), F.lit(url).alias("docs_url"),
        files.get(n, F.lit(None).cast("string")).alias("affected_files"),
        n_routes.get(n, F.lit(0).cast("long")).alias("affected_routes")))
        for n, sev, cat, _, _, rec, url in RULES]
    return (facts.select("project_id", F.posexplode(F.array_compact(F.array(*items))).alias("issue_no", "i"))
            .select("project_id", (F.col("issue_no") + 1).alias("issue_no"), "i.*"))


def issue_routes(routes: DataFrame) -> DataFrame:
    """P43's list of affected routes as rows (rule 4: every dynamic route), so
    that no project's list has to fit into one row."""
    return routes.where("is_dynamic").select("project_id", F.lit(4).alias("rule"), "route_order", "path")


def audit_score(status: DataFrame, facts: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """A2 + P44–P46 per project; invalid projects get gate 1 and no score."""
    counts = issue_rows.groupBy("project_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "high", "medium", "low")])
    x = facts.join(counts, "project_id", "left").na.fill(
        0, ["critical_count", "high_count", "medium_count", "low_count"])
    csr = F.col("rendering_type") == "csr"
    score = (F.lit(C.SCORE_START)
             - F.when(csr, C.SCORE_CSR_PENALTY).otherwise(0)
             - F.when(~F.col("has_real_route") & (F.col("total_routes") == 1), C.SCORE_NO_ROUTES_PENALTY).otherwise(0)
             - F.when((F.col("n_findings") > 0) & csr, C.SCORE_CLIENT_METADATA_PENALTY).otherwise(0)
             - F.least(F.col("critical_count") * C.SCORE_CRITICAL_EACH, F.lit(C.SCORE_CRITICAL_CAP))
             - F.least(F.col("high_count") * C.SCORE_HIGH_EACH, F.lit(C.SCORE_HIGH_CAP))
             - F.least(F.col("medium_count") * C.SCORE_MEDIUM_EACH, F.lit(C.SCORE_MEDIUM_CAP)))
    x = x.withColumn("seo_score", F.greatest(score, F.lit(0)).cast("int"))
    scored = x.select("project_id", "total_routes", "dynamic_routes", "lazy_routes",
                      "routes_with_client_metadata", "critical_count", "high_count", "medium_count",
                      "low_count", "seo_score")
    out = status.join(scored, "project_id", "left")
    band = (F.when(F.col("seo_score").isNull(), F.lit(None))
            .when(F.col("seo_score") >= 80, "good").when(F.col("seo_score") >= 50, "needs_work")
            .otherwise("critical"))
    gate = F.when(F.col("status") != "ok", 1).when(F.col("critical_count") > 0, 2).otherwise(0)
    return out.withColumn("score_band", band).withColumn("gate", gate)
