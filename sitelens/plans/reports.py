"""Report sinks (K1–K4) and text products: sitemap, migration bundles,
JSON and Markdown reports.

Nothing here concatenates an unbounded list into one row: sitemaps are split
at the protocol's 50,000-URL limit, bundle sizes are sums of per-file
section sizes, and report rows hold per-project summaries (≤ 10 issues) while
routes and findings stay separate tables keyed by project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators.scan import basename

SITEMAP_MAX_URLS = 50_000
SITEMAP_HEAD = ('<?xml version="1.0" encoding="UTF-8"?>\n'
                '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n')
SITEMAP_TAIL = "</urlset>\n"


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def default_base_url(project_id: Column) -> Column:
    return F.concat(F.lit("https://"), project_id, F.lit(".example.com"))


def _site(base_url: Column | None) -> Column:
    base = F.rtrim(base_url if base_url is not None else default_base_url(F.col("project_id")))
    return F.regexp_replace(base, "/+$", "")


def sitemap(routes: DataFrame, base_url: Column | None = None, max_urls: int = SITEMAP_MAX_URLS) -> DataFrame:
    """K3 + P23: static routes as ``<url>`` entries in route order, priority
    1.0 for ``/`` else 0.8, weekly; dynamic routes are skipped and counted in
    a comment of part 1.  One row per (project, part): every part but the last
    holds ``max_urls`` static routes; a project without any has one part."""
    line = F.concat(
        F.lit("  <url>\n    <loc>"), xml_escape(F.concat(_site(base_url), F.col("path"))),
        F.lit("</loc>\n    <changefreq>weekly</changefreq>\n    <priority>"),
        F.when(F.col("path") == "/", "1.0").otherwise("0.8"), F.lit("</priority>\n  </url>\n"))
    parts = (routes.where(~F.col("is_dynamic"))
             .select("project_id", F.ceil(F.col("static_order") / max_urls).cast("int").alias("part"), F.struct("static_order", line.alias("line")).alias("u"))
             .groupBy("project_id", "part").agg(F.array_sort(F.collect_list("u")).alias("urls")))
    totals = routes.groupBy("project_id").agg(F.count_if("is_dynamic").alias("n_dynamic"))
    out = totals.join(parts, "project_id", "left").withColumn("part", F.coalesce("part", F.lit(1)))
    comment = F.when((F.col("part") == 1) & (F.col("n_dynamic") > 0), F.format_string(
        "  <!-- %d dynamic routes left out: list their real addresses to include them. -->\n", F.col("n_dynamic"))).otherwise(F.lit(""))
    body = F.coalesce(F.array_join(F.transform("urls", lambda u: u["line"]), ""), F.lit(""))
    return out.select("project_id", "part", F.coalesce(F.size("urls"), F.lit(0)).cast("long").alias("url_count"),
                      F.concat(F.lit(SITEMAP_HEAD), body, comment, F.lit(SITEMAP_TAIL)).alias("xml"))


def sitemap_index(sitemaps: DataFrame, base_url: Column | None = None) -> DataFrame:
    """The index sheet of every project with more than one sitemap part, one
    ``<sitemap>`` a part in order (50,000 parts of 50,000 URLs at most, by the
    protocol)."""
    entry = F.concat(F.lit("  <sitemap>\n    <loc>"), xml_escape(F.concat(_site(base_url), F.format_string("/sitemap-%d.xml", F.col("part")))),
                     F.lit("</loc>\n  </sitemap>\n"))
    sheets = (sitemaps.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("part", entry.alias("entry")))).alias("e"),
                                                 F.sum("url_count").alias("url_count")).where(F.size("e") > 1))
    return sheets.select("project_id", F.size("e").alias("parts"), "url_count", F.concat(
        F.lit(SITEMAP_HEAD.replace("urlset", "sitemapindex")), F.array_join(F.transform("e", lambda x: x["entry"]), ""),
        F.lit(SITEMAP_TAIL.replace("urlset", "sitemapindex"))).alias("xml"))


def file_section(name: Column, ctype: Column, reasons: Column, notes: Column, text: Column) -> Column:
    """One file's section of a migration bundle."""
    note_block = F.when(F.size(notes) > 0, F.concat(
        F.lit("**Migration notes:**\n"),
        F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n, F.lit("\n"))), ""))).otherwise("")
    return F.concat(
        F.lit("### `"), name, F.lit("`\n**Type:** "), F.upper(ctype), F.lit("\n"),
        F.when(F.size(reasons) > 0, F.concat(F.lit("**Reason:** "), F.array_join(reasons, " | "), F.lit("\n")))
        .otherwise(""),
        note_block, F.lit("\n```jsx\n"), text, F.lit("\n```\n\n"))


def part_header(part: Column, total: Column) -> Column:
    return F.concat(F.lit("## Files\n"), F.when(total > 1, F.format_string(
        "> Part %d of %d; the project context above holds for every part.\n",
        part, total)).otherwise(""), F.lit("\n"))


# Parts that are exchanged as one run and pages of one cell at most, in ``repeated``;
# rows that are made of a page before the next page's turn.
CELL_PARTS, CELL_PAGES, TURN = 4096, 256, 64


def part_runs(parts: DataFrame, cell_parts: int = CELL_PARTS) -> DataFrame:
    """(project_id, total_parts, _first, _last, _numbers): the parts of a project
    in runs of so many numbers at most; ``_numbers`` only where they do not
    follow each other from the first to the last."""
    number, numbers, every = F.col("part_number"), F.col("_numbers"), F.sequence("_first", "_last")
    runs = (parts.where(number.isNotNull()).groupBy("project_id", "total_parts", F.floor(number / cell_parts).alias("_run"))
            .agg(F.min(number).alias("_first"), F.max(number).alias("_last"), F.array_sort(F.collect_list(number)).alias("_numbers")))
    return runs.select("project_id", "total_parts", "_first", "_last", F.when(numbers != every, numbers).alias("_numbers"))


def repeated(parts: DataFrame, pages: DataFrame, cell_parts: int = CELL_PARTS, cell_pages: int = CELL_PAGES) -> DataFrame:
    """Every page of a project with every part of it.  Pages are dealt in cells,
    fewer to a cell the more parts the largest project has, so that no task has
    to make a product alone.  A page is exchanged once, the parts as runs; a
    page's rows of a turn follow each other, so that a columnar sink keeps their
    text once."""
    most = parts.groupBy("project_id").count().agg(F.max("count")).scalar()
    size = F.greatest(F.lit(max(cell_pages // 16, 1)), F.least(F.lit(cell_pages), F.floor(F.lit(cell_parts * cell_pages) / most)))
    pages = pages.withColumn("_cell", F.floor(F.col("place") / size)).checkpoint(eager=True)
    n, cell = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["project_id", "_cell"]
    runs = part_runs(parts, cell_parts).join(pages.select(*cell).distinct(), "project_id").repartition(n, *cell)
    turns = runs.select(*cell, "total_parts", F.coalesce("_numbers", F.sequence("_first", "_last")).alias("_numbers")).select(
        *cell, "total_parts", F.explode(F.transform(F.sequence(F.lit(1), F.size("_numbers"), F.lit(TURN)), lambda i: F.slice("_numbers", i, TURN))).alias("_turn"))
    return (turns.join(pages.repartition(n, *cell).hint("merge"), cell).withColumn("part_number", F.explode("_turn"))
            .drop("_cell", "_turn"))


def bundle_texts(chunks: DataFrame, components: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """K4 rows, the texts of every bundle part in order of (kind, place): the
    context pages, repeated a part (kind 0), the part's header (1) and one
    section a file (2).  A project without files has no bundle."""
    parts = chunks.select("project_id", "part_number", "total_parts").distinct().checkpoint(eager=True)
    context = repeated(parts, pages.select("project_id", F.col("page").alias("place"), "text")).withColumn("kind", F.lit(0))
    header = parts.select("*", F.lit(0).cast("long").alias("place"), part_header(F.col("part_number"), F.col("total_parts")).alias("text"), F.lit(1).alias("kind"))
    j = (chunks.join(components.withColumnRenamed("file_path", "path"), ["project_id", "path"], "left")
         .join(files.select("project_id", "path", "content"), ["project_id", "path"]))
    section = file_section(basename(F.col("path")), F.coalesce("component_type", F.lit("unknown")),
                           F.coalesce("reasons", F.array().cast("array<string>")),
                           F.coalesce("migration_notes", F.array().cast("array<string>")), F.coalesce("content", F.lit("")))
    own = j.select("project_id", "part_number", "total_parts", F.col("file_order").alias("place"), section.alias("text"), F.lit(2).alias("kind"))
    return context.unionByName(header).unionByName(own)


def bundle_tokens(chunks: DataFrame, components: DataFrame, lines: DataFrame) -> DataFrame:
    """P32 + A12 + J7: size and token estimate (chars // 4) of every bundle
    part and, rolled up, of the whole bundle (``part_number`` null).  A part is
    the project context (repeated a part), its header and its file sections;
    sizes are summed, texts are never concatenated."""
    # Section size = wrapper text (from the classification) + the file's
    # char count, so file texts are not joined or shuffled here.
    j = chunks.join(components.withColumnRenamed("file_path", "path"), ["project_id", "path"], "left")
    wrapper = file_section(basename(F.col("path")), F.coalesce("component_type", F.lit("unknown")),
                           F.coalesce("reasons", F.array().cast("array<string>")),
                           F.coalesce("migration_notes", F.array().cast("array<string>")), F.lit(""))
    per_part = (j.select("project_id", "part_number", "total_parts",
                         (F.length(wrapper) + F.col("chars")).alias("n"))
                .groupBy("project_id", "part_number", "total_parts")
                .agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("section_chars")))
    context = lines.groupBy("project_id").agg(F.sum(F.length("line")).alias("context_chars"))
    out = per_part.join(context, "project_id", "left").na.fill(0, ["context_chars"])
    chars = (F.length(part_header(F.col("part_number"), F.col("total_parts")))
             + F.col("context_chars") + F.col("section_chars")).cast("long")
    sized = out.select("project_id", "part_number", "total_parts", "n_files", chars.alias("chars"), F.floor(chars / 4).cast("long").alias("estimated_tokens"))
    name = (F.when(F.col("part_number").isNull(), F.lit("bundle")).when(F.col("total_parts") == 1, F.lit("bundle.md"))
            .otherwise(F.format_string("bundle-part%d.md", F.col("part_number"))))
    rolled = sized.rollup("project_id", "part_number").agg(
        F.max("total_parts").alias("total_parts"), *[F.sum(c).alias(c) for c in ("n_files", "chars", "estimated_tokens")])
    return rolled.where("project_id IS NOT NULL").select(
        "project_id", "part_number", "total_parts", name.alias("bundle_name"), "n_files", "chars", "estimated_tokens")


def write_bundles(texts: DataFrame, out_dir: str) -> None:
    """K4 sink: one text folder per (project, part), its texts in order."""
    (texts.repartition("project_id", "part_number").sortWithinPartitions("project_id", "part_number", "kind", "place")
     .select("project_id", "part_number", "text")
     .write.mode("overwrite").partitionBy("project_id", "part_number").text(out_dir))


def report_rows(score: DataFrame, bundle: DataFrame, cwv: DataFrame, issues: DataFrame,
                analysed_at: str) -> DataFrame:
    """K1/A10: one nested summary row per project (issues ≤ 10, in order),
    stamped with the given time.  Routes, findings and affected routes stay
    side tables keyed by project (``report_lines``, ``issue_routes``)."""
    iss = issues.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(
        "issue_no", "rule", "severity", "category", "title", "description", "recommendation", "docs_url",
        "affected_files", "affected_routes"))).alias("issues"))
    b = bundle.select("project_id", F.struct(*[c for c in bundle.columns if c != "project_id"]).alias("bundle"))
    w = cwv.select("project_id", F.struct(*[c for c in cwv.columns if c != "project_id"]).alias("cwv"))
    return (score.join(b, "project_id", "left").join(w, "project_id", "left").join(iss, "project_id", "left")
            .withColumn("analysed_at", F.lit(analysed_at)))


def report_json(rows: DataFrame) -> DataFrame:
    return rows.select("project_id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def _table(head: str, *rows: tuple[str, Column]) -> list[Column]:
    """A Markdown table of two columns."""
    out = [F.lit(f"| {head} |\n|---|---|\n")]
    for name, value in rows:
        out += [F.lit(f"| {name} | "), value.cast("string"), F.lit(" |\n")]
    return out


def report_markdown(rows: DataFrame) -> DataFrame:
    """K2: Markdown summary per project: score, facts, vitals, issues."""
    issue_lines = F.array_join(F.transform(F.coalesce("issues", F.array()), lambda i: F.concat(
        F.lit("### "), i["issue_no"].cast("string"), F.lit(". "), i["title"], F.lit("\n\n- severity: "), i["severity"],
        F.lit("\n- category: "), i["category"], F.lit("\n- see: "), i["docs_url"], F.lit("\n\n"), i["description"],
        F.lit("\n\n"), i["recommendation"], F.lit("\n"))), "\n")

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("-"))

    notes = F.array_join("cwv.notes", "\n")
    md = F.concat(
        F.lit("# Audit of `"), F.col("project_id"), F.lit("`\n\nScore: "), F.col("seo_score").cast("string"),
        F.lit(" of 100 ("), F.replace("score_band", F.lit("_"), F.lit(" ")), F.lit(")\n\n"),
        *_table("Fact | Value", ("Framework", F.col("bundle.framework")), ("Rendering", F.col("bundle.rendering_type")),
                ("React", known("bundle.react_version")), ("Router", known("bundle.react_router_version")),
                ("Entry", known("bundle.entry_point")), ("Build folder", known("bundle.build_output_dir")),
                ("Dependencies", F.col("bundle.total_dependencies")), ("Routes", F.col("total_routes")),
                ("Dynamic routes", F.col("dynamic_routes")), ("Lazy routes", F.col("lazy_routes"))),
        F.lit("\n"), *_table("Vital | Risk", ("LCP", F.col("cwv.lcp_risk")), ("CLS", F.col("cwv.cls_risk")),
                             ("INP", F.col("cwv.fid_risk"))),
        F.lit("\n"), notes, F.when(notes == "", "").otherwise("\n\n"),
        *_table("Severity | Issues", *[(k, F.col(f"{k}_count")) for k in ("critical", "high", "medium", "low")]),
        F.lit("\n"), issue_lines)
    return rows.where(F.col("status") == "ok").select("project_id", md.alias("markdown"))


def report_lines(routes: DataFrame, findings: DataFrame) -> DataFrame:
    """K2's route and metadata tables as one row per line, so that a project
    of any size fits: (project_id, section, item, line)."""
    def yes(c: str) -> Column:
        return F.when(F.col(c), "yes").otherwise("no")

    r = routes.select("project_id", F.lit("routes").alias("section"), F.col("path").alias("item"), F.concat(
        F.lit("| `"), F.col("path"), F.lit("` | "), F.coalesce("component_file", F.lit("-")), F.lit(" | "), yes("is_dynamic"),
        F.lit(" | "), yes("is_lazy"), F.lit(" | "), F.col("data_fetch_pattern"), F.lit(" |")).alias("line"))
    sets = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), n) for c, n in (
        ("sets_title", "title"), ("sets_description", "description"), ("sets_og_tags", "og"),
        ("sets_canonical", "canonical"))])), ", ")
    f = findings.select("project_id", F.lit("metadata").alias("section"), F.col("file_path").alias("item"), F.concat(
        F.lit("| `"), F.col("file_path"), F.lit("` | "), F.col("strategy"), F.lit(" | "), sets, F.lit(" |")).alias("line"))
    return r.unionByName(f)


def write_reports(rows: DataFrame, out_dir: str) -> None:
    """K1 sink: nested JSON report rows, one folder per project."""
    rows.write.mode("overwrite").partitionBy("project_id").json(out_dir)


def read_reports(spark, in_dir: str, schema=None) -> DataFrame:
    """Load earlier reports (schema given, or the writer's schema)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(in_dir)
