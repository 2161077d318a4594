"""Text and page scanners as expressions over whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uri

# Published credential formats that no release holds, by name. Only syntax that Java and RE2 share.
RELEASED_CREDENTIALS = {
    "aws_access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{25,}",
    "github_fine_grained": r"github_pat_[A-Za-z0-9_]{30,}",
    "dataset_token": r"KGAT_[A-Za-z0-9_-]{25,}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "signed_address": r"[?&](?:X-Amz-Signature|X-Amz-Credential|X-Goog-Signature)=",
}
#: These, and what looks like a credential or a private place in a text.
CREDENTIALS = RELEASED_CREDENTIALS | {
    "assigned_token": r"(?i)\b(token|secret|api_key|password)\b\s*[:=]\s*[\"'][^\"'\s]{16,}[\"']",
    "private_path": r"(/home/|/Users/)[A-Za-z0-9_.-]+/",
}
NETWORK = r"(?i)\b(fetch|XMLHttpRequest|WebSocket|EventSource|sendBeacon)\s*\("
LINK = r"(?i)\b(?:href|src|poster)\s*=\s*[\"']([^\"']*)[\"']"
BARE_LINK = r"(?i)\b(?:href|src|poster)\s*=\s*([^\s\"'>]+)"
#: An address with a scheme of any kind, or with a host.
REMOTE = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:|[/\\]{2})"
ACTIVE = r"(?i)<(script|iframe|object|embed|base)\b"

CSS_URL = r"(?i)\burl\(\s*[\"']?([^\"')]*)"
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
SECURE = r"(?i)\bhref\s*=\s*[\"']?https://[^/\s\"'>]"
SVG = r"(?is)<svg\b.*?</svg>"
#: Rules that are counts of a pattern in the whole page, and in each of its drawings.
ASSETS = {
    "frames": r"(?i)<(iframe|object|embed|base)\b",
    "refresh": r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b",
    "srcset": r"(?i)<(script|img|source|audio|video|link)\b[^>]*\ssrcset\s*=",
    "css_import": r"(?i)@import\b",
    "module_import": r"(?:^|[^@\w])import\s*[(\"']",
}
COMMENT, SCRIPT, STYLE = r"(?s)<!--.*?-->", r"(?is)(<script\b[^>]*>).*?(</script\s*>)", r"(?is)(<style\b[^>]*>).*?(</style\s*>)"
TAG = r"""(?i)<(?:script|img|source|audio|video|link|a|meta|iframe|object|embed|base)\b[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
ATTRIBUTE = r"""([^\s"'>/=<]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Elements whose src, href and poster are fetched with the page, and those that hold another document.
RUNTIME, FETCHED = ("script", "img", "source", "audio", "video", "link"), ("src", "href", "poster")
CONTAINERS = ("iframe", "object", "embed", "base")
DRAWN = {"svg_active": r"(?i)<(script|foreignObject)\b", "svg_handler": r"(?i)\son[a-z]+\s*="}


def count_by_pattern(docs: DataFrame, text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """(pattern, documents that match, matches), all patterns in one scan."""
    found = [
        F.struct(F.lit(k).alias("pattern"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).cast("long").alias("n"))
        for k, p in (patterns or CREDENTIALS).items()
    ]
    return (
        docs.select(F.explode(F.array(*found)).alias("f"))
        .groupBy("f.pattern")
        .agg(F.count_if(F.col("f.n") > 0).alias("documents"), F.sum("f.n").alias("matches"))
    )


def links(html: Column) -> Column:
    """Values of href, src and poster anywhere, quoted or not."""
    return F.concat(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), F.regexp_extract_all(html, F.lit(BARE_LINK), F.lit(1)))


def elements(html: Column) -> Column:
    """Each reference-bearing tag outside comments and scripts as (name, attributes: array of name, value), values unescaped."""
    seen = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, COMMENT, ""), SCRIPT, "$1$2"), STYLE, "$1$2")

    def attribute(found: Column) -> Column:
        value = F.regexp_extract(found, ATTRIBUTE, 2)
        plain = F.when(value.rlike("^[\"']"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(F.lower(F.regexp_extract(found, ATTRIBUTE, 1)).alias("name"), uri.cleaned(uri.unescaped(plain)).alias("value"))

    def element(tag: Column) -> Column:
        named = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), attribute)
        return F.struct(F.lower(F.regexp_extract(tag, "^<([A-Za-z0-9]+)", 1)).alias("name"), named.alias("attributes"))

    return F.transform(F.regexp_extract_all(seen, F.lit(TAG), F.lit(0)), element)


def value_of(element: Column, name: str) -> Column:
    return F.try_element_at(F.filter(element["attributes"], lambda a: a["name"] == name), F.lit(-1))["value"]


def is_canonical(element: Column) -> Column:
    """Whether a link says who the page is, and nothing else: such an address is not fetched."""
    return (element["name"] == "link") & (F.lower(F.coalesce(value_of(element, "rel"), F.lit(""))) == "canonical")


def fetched(tags: Column) -> Column:
    """The addresses that elements() fetch with the page."""
    own = F.filter(tags, lambda t: t["name"].isin(*RUNTIME) & ~is_canonical(t))
    return F.flatten(F.transform(own, lambda t: F.transform(F.filter(t["attributes"], lambda a: a["name"].isin(*FETCHED)), lambda a: a["value"])))


def link_counts(pages: DataFrame) -> DataFrame:
    """Per page: links, distinct links, remote ones."""
    found = pages.select("page_id", links(F.coalesce("html", F.lit(""))).alias("l"))
    return found.select(
        "page_id",
        F.size("l").cast("long").alias("n_links"),
        F.size(F.array_distinct("l")).cast("long").alias("n_distinct"),
        F.size(F.filter("l", lambda x: x.rlike(REMOTE))).cast("long").alias("n_remote"),
    )


def page_flags(pages: DataFrame) -> DataFrame:
    """Pages with active elements, network calls, or remote addresses that are fetched with the page; anchors and canonical addresses are not."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        html.rlike(ACTIVE).alias("active"),
        html.rlike(NETWORK).alias("network"),
        F.exists(fetched(elements(html)), lambda x: x.rlike(REMOTE)).alias("remote"),
    )


def asset_findings(pages: DataFrame) -> DataFrame:
    """Per page how often each asset rule is broken: containers, redirects, style sheets, drawings, canonical addresses."""
    html = F.coalesce("html", F.lit(""))
    drawings = F.concat_ws("\n", F.regexp_extract_all(html, F.lit(SVG), 0))
    css = F.regexp_extract_all(html, F.lit(CSS_URL), 1)
    canonical = F.regexp_extract_all(html, F.lit(CANONICAL), 0)
    return pages.select(
        "page_id",
        *[F.regexp_count(html, F.lit(p)).cast("long").alias(k) for k, p in ASSETS.items()],
        *[F.regexp_count(drawings, F.lit(p)).cast("long").alias(k) for k, p in DRAWN.items()],
        F.size(F.filter(css, lambda x: x.rlike(REMOTE))).cast("long").alias("css_remote"),
        F.size(F.filter(canonical, lambda x: ~x.rlike(SECURE))).cast("long").alias("bad_canonical"),
        F.size(F.filter(fetched(elements(html)), lambda x: x.rlike(REMOTE))).cast("long").alias("remote_asset"),
    )


def decoded_host(url: Column) -> Column:
    """The host of a percent-encoded address; null where there is none."""
    return F.try_parse_url(F.try_url_decode(url), F.lit("HOST"))


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """SHA-256 of each whole text."""
    return docs.select("doc_id", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("sha256"))
