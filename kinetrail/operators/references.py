"""References of pages and files: extraction, a graph of resolved addresses, and the audit of a self-contained site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uri
from .scan import CONTAINERS, CSS_URL, FETCHED, NETWORK, RELEASED_CREDENTIALS, RUNTIME, elements, fetched, is_canonical, value_of

IMPORT = r"""\b(?:import|export)\s+(?:[^;\n'"]*?\s*from\s*)?["']([^"']+)["']|\b(?:import|export)\s*["']([^"']+)["']"""
DRAWN_HREF = r"""(?i)[\s:]href\s*=\s*["']([^"']*)["']"""

# What a self-contained site holds, and how large it may be.
ENTRY = ("index.html", "styles.css", "engine.js", "app.js")
SUFFIXES = (".html", ".css", ".js", ".svg")
FILE_BYTES, SITE_BYTES, SITE_FILES = 1_000_000, 2_000_000, 32
PRIVATE = r"(?i)s3://|arn:aws(?:-[a-z]+)?:|/(?:home|workspace|mnt)/"


def references(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, kind, reference), a row for each address that a page names: runtime (fetched with it), css, link (of an anchor), canonical.

    Attributes may be quoted or not; character references are replaced; comments and scripts are left out. A null page names none.
    """
    text = F.coalesce(F.col(html), F.lit(""))

    def of(element: Column) -> Column:
        kind = F.when(is_canonical(element), "canonical").when(element["name"] == "a", "link").otherwise("runtime")
        wanted = F.when(element["name"].isin(*RUNTIME), F.array(*map(F.lit, FETCHED))).when(
            element["name"] == "a", F.array(F.lit("href"))
        )
        own = F.filter(element["attributes"], lambda a: F.array_contains(F.coalesce(wanted, F.array(F.lit("-"))), a["name"]))
        return F.transform(own, lambda a: F.struct(kind.alias("kind"), a["value"].alias("reference")))

    css = F.transform(F.regexp_extract_all(text, F.lit(CSS_URL), F.lit(1)), lambda r: F.struct(F.lit("css").alias("kind"), uri.cleaned(r).alias("reference")))
    found = F.concat(F.flatten(F.transform(elements(text), of)), css)
    return pages.select(key, F.explode(found).alias("r")).select(key, "r.kind", "r.reference").where("reference != ''")


def reference_graph(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, kind, reference, target, status): each reference resolved against its page's own address.

    status: fragment (of the page itself), scheme (neither http nor https), remote (another host without such a page), page (a page
    of the table, of any host, by address without fragment), escapes (`..` above the root), missing (of the page's host, no page).
    The set of pages is joined, never collected. Pages without an address: target null, status unresolved.
    """
    base, reference = uri.parts(uri.cleaned(F.col(url))), uri.parts(F.replace(F.col("reference"), F.lit("\\"), F.lit("/")))
    named = references(pages.select(F.struct(key, url).alias("_page"), html), "_page", html).select("_page.*", "kind", "reference")
    made = named.withColumns({"_base": base, "_ref": reference}).withColumn("target", uri.resolved(F.col("_base"), F.col("_ref")))
    known = pages.where(F.col(url).isNotNull()).select(uri.page_key(uri.cleaned(F.col(url))).alias("_key")).distinct().withColumn("_known", F.lit(True))
    to = uri.parts(F.col("target"))
    folder = F.regexp_extract(F.col("_base.path"), r"^(.*/)?", 0)
    whole = F.when(F.col("_ref.path").startswith("/"), F.col("_ref.path")).otherwise(F.concat(folder, F.col("_ref.path")))
    status = (
        F.when(F.col("target").isNull() | F.col("_base.scheme").isNull(), "unresolved")
        .when(F.col("reference").startswith("#"), "fragment")
        .when(~to["scheme"].isin("http", "https"), "scheme")
        .when(F.col("_known"), "page")
        .when(~F.lower(to["authority"]).eqNullSafe(F.lower(F.col("_base.authority"))), "remote")
        .when(uri.climbs(uri.unquoted(whole)), "escapes")
        .otherwise("missing")
    )
    return made.withColumn("_key", uri.page_key(F.col("target"))).join(known, "_key", "left").select(
        key, "kind", "reference", "target", status.alias("status")
    )


def site_files(spark: SparkSession, root: str) -> DataFrame:
    """(site, path, bytes, content) of all files below a folder; site: the folder, path: relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return found.select(F.lit(root).alias("site"), plain.substr(F.lit(len(whole) + 1), F.length(plain)).alias("path"), F.col("length").alias("bytes"), "content")


def _asset_rule(base: Column, reference: Column) -> Column:
    """What is wrong with a file's reference in itself; null if only its target's existence is open."""
    p = uri.parts(reference)
    path = uri.unquoted(p["path"])
    below = F.concat(F.regexp_extract(base, r"^(.*/)?", 0), path)
    return (
        F.when(p["scheme"].isNotNull() | F.coalesce(p["authority"] != "", F.lit(False)), "remote_asset")
        .when((path == "") | path.rlike(r"^[/\\]"), F.when((path == "") & F.coalesce(p["fragment"] != "", F.lit(False)), "-").otherwise("invalid_path"))
        .when(uri.climbs(below), "escaping_asset")
    )


def site_findings(
    files: DataFrame,
    entry: Sequence[str] = ENTRY,
    suffixes: Sequence[str] = SUFFIXES,
    file_bytes: int = FILE_BYTES,
    site_bytes: int = SITE_BYTES,
    site_files: int = SITE_FILES,
    markers: Sequence[tuple[str, str]] = (("index.html", "(?i)synthetic"), (r"[^/]*\.js", "SYNTHETIC_ONLY")),
) -> DataFrame:
    """(site, path, rule, detail) of everything that keeps files (site, path, bytes, content) from being self-contained sites; none if they are.

    Rules of a file: suffix, size, encoding, credential, private_locator, network, container, refresh, canonical, srcset, svg_active,
    svg_handler, css_import, and of its references remote_asset, invalid_path, escaping_asset, missing_asset. Rules of a site (path null): entry
    (a file that must be there), total_size, count, marker (a pattern of paths no file of which holds a pattern). References are joined with the files of their site.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    kind = F.lower(F.regexp_extract("path", r"[^/.](\.[^./]+)$", 1))
    rows = files.select("site", "path", "bytes", F.coalesce(text, F.lit("")).alias("text"), text.isNull().alias("_odd"), kind.alias("kind"))
    html, drawn, script = F.col("kind") == ".html", F.col("kind") == ".svg", F.col("kind") == ".js"
    text, tags = F.col("text"), F.when(html, elements(F.col("text"))).otherwise(F.array().cast("array<struct<name:string,attributes:array<struct<name:string,value:string>>>>"))
    styled = html | drawn | (F.col("kind") == ".css")

    def rule(name: str, broken: Column, detail: Column | None = None) -> Column:
        return F.when(broken, F.struct(F.lit(name).alias("rule"), (F.lit("") if detail is None else detail).alias("detail")))

    def canonical(tag: Column) -> Column:
        p = uri.parts(F.coalesce(value_of(tag, "href"), F.lit("")))
        return is_canonical(tag) & ~F.coalesce((p["scheme"] == "https") & (p["authority"] != ""), F.lit(False))

    seen = rows.withColumn("tags", tags)
    tags = F.col("tags")
    own = F.array(
        rule("suffix", ~F.col("kind").isin(*suffixes), F.col("kind")),
        rule("size", F.col("bytes") > file_bytes, F.col("bytes").cast("string")),
        rule("encoding", F.col("_odd")),
        *[rule("credential", text.rlike(p), F.lit(name)) for name, p in RELEASED_CREDENTIALS.items()],
        rule("private_locator", text.rlike(PRIVATE)),
        rule("network", text.rlike(NETWORK) | text.rlike(r"\bimport\s*\(|\bimportScripts\s*\(")),
        rule("container", F.exists(tags, lambda t: t["name"].isin(*CONTAINERS))),
        rule("refresh", F.exists(tags, lambda t: (t["name"] == "meta") & (F.lower(F.coalesce(value_of(t, "http-equiv"), F.lit(""))) == "refresh"))),
        rule("canonical", F.exists(tags, canonical)),
        rule("srcset", F.exists(tags, lambda t: t["name"].isin(*RUNTIME) & ~is_canonical(t) & value_of(t, "srcset").isNotNull())),
        rule("svg_active", drawn & text.rlike(r"(?i)<(?:[a-z0-9]+:)?(?:script|foreignObject)\b")),
        rule("svg_handler", drawn & text.rlike(r"(?i)<[^>]*\son[a-z]+\s*=")),
        rule("css_import", styled & text.rlike("(?i)@import")),
    )
    by_file = seen.select("site", "path", F.explode(F.filter(own, lambda f: f.isNotNull())).alias("f")).select("site", "path", "f.rule", "f.detail")

    none = F.array().cast("array<string>")
    imports = F.transform(F.regexp_extract_all(text, F.lit(IMPORT), F.lit(0)), lambda i: F.regexp_extract(i, "[\"']([^\"']+)[\"']$", 1))
    named = F.concat(
        fetched(tags),
        F.when(script, imports).otherwise(none),
        F.when(drawn, F.regexp_extract_all(text, F.lit(DRAWN_HREF), F.lit(1))).otherwise(none),
        F.when(styled, F.transform(F.regexp_extract_all(text, F.lit(CSS_URL), F.lit(1)), uri.cleaned)).otherwise(none),
    )
    asked = seen.select("site", "path", F.explode(F.array_distinct(F.filter(named, lambda r: r != ""))).alias("detail")).withColumn("rule", _asset_rule(F.col("path"), F.col("detail")))
    target = uri.without_dots(F.concat(F.regexp_extract("path", r"^(.*/)?", 0), uri.unquoted(uri.parts(F.col("detail"))["path"])))
    open_ = asked.where("rule IS NULL").withColumn("_target", target)
    absent = open_.join(files.select("site", F.col("path").alias("_target")), ["site", "_target"], "left_anti").withColumn("rule", F.lit("missing_asset"))
    broken = asked.where("rule != '-'").unionByName(absent.drop("_target")).select("site", "path", "rule", "detail")

    total = rows.groupBy("site").agg(
        F.sum("bytes").alias("bytes"),
        F.count("*").alias("n"),
        F.collect_set(F.when(F.col("path").isin(*entry), F.col("path"))).alias("there"),
        *[F.count_if(F.col("path").rlike(f"^(?:.*/)?{p}$") & text.rlike(m)).alias(f"m{k}") for k, (p, m) in enumerate(markers)],
    )
    whole = F.array(
        *[rule("entry", ~F.array_contains("there", e), F.lit(e)) for e in entry],
        rule("total_size", F.col("bytes") > site_bytes, F.col("bytes").cast("string")),
        rule("count", F.col("n") > site_files, F.col("n").cast("string")),
        *[rule("marker", F.col(f"m{k}") == 0, F.lit(m)) for k, (_, m) in enumerate(markers)],
    )
    of_all = total.select("site", F.explode(F.filter(whole, lambda f: f.isNotNull())).alias("f"))
    of_all = of_all.select("site", F.lit(None).cast("string").alias("path"), "f.rule", "f.detail")
    return by_file.unionByName(broken).unionByName(of_all)


# Links of Markdown, fenced code, and phrases that a front page does without.
MARKDOWN_LINK = r"""!?\[[^\]]*\]\((<[^>]+>|[^\s)]+)(?:\s+["'][^"']*["'])?\)"""
FENCED = r"(?s)```.*?```"
ASPIRATION = (
    r"(?i)\b(?:beat|surpass|chase|overtake)\b.{0,60}\b(?:winner|top score|leaderboard)\b"
    r"|\b(?:goal|target|aim)\b.{0,60}\b(?:top score|first place|leaderboard)\b|\bclose (?:the |our )?(?:remaining )?gap\b"
)


def markdown_findings(files: DataFrame, front: Sequence[str] = ()) -> DataFrame:
    """(site, path, rule, detail) of Markdown files (site, path, text): local links that leave the site or lead nowhere, phrases in front pages.

    Links in fenced code, to other hosts, and to a place in the page itself are left alone; a link may lead to a file or a folder.
    """
    prose = F.regexp_replace(F.coalesce("text", F.lit("")), FENCED, "")
    named = F.transform(F.regexp_extract_all(prose, F.lit(MARKDOWN_LINK), F.lit(1)), lambda r: F.regexp_replace(r, "^<|>$", ""))
    links = files.where("lower(path) LIKE '%.md'").select("site", "path", F.explode(F.array_distinct(named)).alias("detail"))
    p = uri.parts(F.col("detail"))
    local = links.where(p["scheme"].isNull() & p["authority"].isNull() & (p["path"] != ""))
    below = F.concat(F.regexp_extract("path", r"^(.*/)?", 0), uri.unquoted(p["path"]))
    below = F.when(uri.unquoted(p["path"]).startswith("/"), F.concat(F.lit("../"), uri.unquoted(p["path"]))).otherwise(below)
    open_ = local.withColumn("rule", F.when(uri.climbs(below), "escaping_link")).withColumn("_target", F.regexp_replace(uri.without_dots(below), "/$", ""))
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split(F.col("path"), "/"), 1, k), "/"))
    places = files.select("site", F.explode(F.array_append(folders, F.lit(""))).alias("_target")).distinct()
    absent = open_.where("rule IS NULL").join(places, ["site", "_target"], "left_anti").withColumn("rule", F.lit("broken_link"))
    found = open_.where("rule IS NOT NULL").unionByName(absent).select("site", "path", "rule", "detail")
    phrase = F.regexp_extract(F.coalesce("text", F.lit("")), f"({ASPIRATION})", 0)
    pages = files.where(F.col("path").isin(*front)) if front else files.limit(0)
    said = pages.where(phrase != "").select("site", "path", F.lit("phrase").alias("rule"), phrase.alias("detail"))
    return found.unionByName(said)
