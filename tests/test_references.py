"""Addresses, reference graphs and the audit of self-contained sites."""

from urllib.parse import quote, unquote, urljoin, urlsplit

import pytest
from kinetrail.functions import uri
from kinetrail.operators import references, scan
from pyspark.sql import functions as F

BASE = "http://a/b/c/d;p?q"
# The examples of RFC 3986, 5.4.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/",
    "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g",
    "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y",
    "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g#s/../x": "http://a/b/c/g",
}


def column(spark, values, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[1] for r in df.select("k", expression(F.col("v")).alias("r")).orderBy("k").collect()]


def test_resolution(spark):
    base = uri.parts(F.lit(BASE))
    assert dict(zip(EXAMPLES, column(spark, EXAMPLES, lambda v: uri.resolved(base, uri.parts(v))), strict=True)) == EXAMPLES
    more = ["x/../../y", "http://b", "//c/d/e?f", "a b/%2e%2e/c"]
    for other in ("https://h", "https://h/p/q/", "file:///r/s"):
        at = uri.parts(F.lit(other))
        got = column(spark, more, lambda v, at=at: uri.resolved(at, uri.parts(v)))
        assert got == [urljoin(other, m) for m in more]


def test_parts_and_coding(spark):
    texts = ["HTTP://H/p?q#f", "//h", "p", "?", "#", "a:b?c?d#e#f", "x/y:z", "", "http://u@h:1/", None]
    for text, got in zip(texts, column(spark, texts, uri.parts), strict=True):
        if text is None:
            assert got is None
        else:
            want = urlsplit(text)
            assert [got["scheme"] or "", got["authority"] or "", got["path"], got["query"] or "", got["fragment"] or ""] == list(want)
    coded = ["a%20b", "%", "%zz%41", "a+b", "%C3%A9", "%FF", "é", "", "%%41"]
    assert column(spark, coded, uri.unquoted) == [unquote(c) for c in coded]
    plain = ["a b/c~d*e+f", "é?&=#", "A-Z_.~"]
    assert column(spark, plain, uri.quoted) == [quote(p) for p in plain]
    refs = ["a&amp;b", "&#x68;ttp&#58;//x", "&colon;&sol;", "&#0;&#xD800;", "&amp;#65;", "&#65", "&#x1F600;", "none"]
    assert column(spark, refs, uri.unescaped) == ["a&b", "http://x", ":/", "��", "&#65;", "A", "\U0001f600", "none"]
    paths = {"a/../b": False, "../a": True, "a/../../b": True, "/..": True, "a/b/../..": False, "a/..b": False, "": False, "./..": True}
    assert dict(zip(paths, column(spark, paths, uri.climbs), strict=True)) == paths


@pytest.mark.parametrize(
    ("html", "remote"),
    [
        ("<img src=https://e.org/a.png>", True),
        ("<img src='http:evil.example/x'>", True),
        ("<video poster='//e.org/p.jpg'>", True),
        ('<script src="ftp://e.org/a.js"></script>', True),
        ('<img src="&#104;ttps://e.org/a">', True),
        ('<img src=" java\tscript:x">', True),
        ('<img alt="a > b" src="https://e.org/a">', True),
        ('<link rel="canonical stylesheet" href="https://e.org/a.css">', True),
        ('<link rel="canonical" href="https://e.org/a">', False),
        ('<a href="https://e.org/">', False),
        ("<img data-src='https://e.org/a'>", False),
        ("<img alt=\"src='https://e.org/a'\" src=a.png>", False),
        ("<!-- <img src='https://e.org/a'> -->", False),
        ("<script>x = \"<img src='https://e.org/a'>\"</script>", False),
        ("<img src='../a.png'>", False),
    ],
)
def test_fetched_addresses(spark, html, remote):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert scan.page_flags(pages).first().remote == remote
    assert (scan.asset_findings(pages).first().remote_asset > 0) == remote


def test_reference_graph(spark):
    pages = [
        (1, "https://h.org/a/b", '<a href="c"><a href="../x#y"><a href="#z"><a href="/a/%62?q"><a href="https://H.org/a/c"><a href="mailto:m@h"><a href>'),
        (2, "https://h.org/a/c", "<a href='https://other.org/'><a href='../../up'><img src=//i.org/x.png><style>p{background:url(c)}</style>"),
        (3, "https://h.org/a/b?q", "<a href='?'><a href=\"https://i.org\">"),
        (4, None, "<a href=c>"),
        (5, "https://i.org/", None),
    ]
    got = references.reference_graph(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.kind, r.reference, r.status) for r in got)) == sorted(
        [
            (1, "link", "c", "page"), (1, "link", "../x#y", "missing"), (1, "link", "#z", "fragment"), (1, "link", "/a/%62?q", "page"),
            (1, "link", "https://H.org/a/c", "page"), (1, "link", "mailto:m@h", "scheme"), (2, "link", "https://other.org/", "remote"),
            (2, "link", "../../up", "escapes"), (2, "runtime", "//i.org/x.png", "remote"), (2, "css", "c", "page"),
            (3, "link", "?", "missing"), (3, "link", "https://i.org", "page"), (4, "link", "c", "unresolved"),
        ]
    )
    assert {r.target for r in got if r.reference == "../x#y"} == {"https://h.org/x"}


GOOD = {
    "index.html": '<h1>Synthetic demo</h1><script src="app.js"></script>',
    "app.js": "import {run} from './engine.js'; run();",
    "engine.js": "export const run=()=>({evidence_type:'SYNTHETIC_ONLY'});",
    "styles.css": "body{color:#123}",
}
SVG = '<svg xmlns="http://www.w3.org/2000/svg">'
CASES = [
    ({}, None),
    ({"index.html": '<h1>Synthetic</h1><script src="https://e.org/sdk.js"></script>'}, "remote_asset"),
    ({"index.html": '<h1>Synthetic</h1><link rel="canonical" href="https://e.org/demo/">'}, None),
    ({"index.html": '<h1>Synthetic</h1><link rel="canonical" href="http://e.org/demo/">'}, "canonical"),
    ({"index.html": '<h1>Synthetic</h1><link rel="canonical stylesheet" href="https://e.org/a.css">'}, "remote_asset"),
    ({"index.html": "<h1>Synthetic</h1><img src=/a.png>"}, "invalid_path"),
    ({"index.html": "<h1>Synthetic</h1><img srcset='a 2x'>"}, "srcset"),
    ({"index.html": "<h1>Synthetic</h1><iframe></iframe>"}, "container"),
    ({"index.html": "<h1>Synthetic</h1><meta http-equiv=Refresh content=0>"}, "refresh"),
    ({"index.html": "<h1>Synthetic</h1><img src='#a'>"}, None),
    ({"index.html": "<h1>Demo</h1>"}, "marker"),
    ({"app.js": "import '../private.js';"}, "escaping_asset"),
    ({"app.js": "import './%2e%2e/private.js';"}, "escaping_asset"),
    ({"app.js": "import './missing.js';"}, "missing_asset"),
    ({"app.js": "export {run} from 'https://e.org/code.js';"}, "remote_asset"),
    ({"app.js": "fetch('https://e.org/input');"}, "network"),
    ({"app.js": "import('./engine.js')"}, "network"),
    ({"app.js": "const key='" + "AKIA" + "A" * 16 + "';"}, "credential"),
    ({"app.js": "const key='" + "ASIA" + "B" * 16 + "';"}, "credential"),
    ({"app.js": "const key='" + "KGAT_" + "a" * 25 + "';"}, "credential"),
    ({"app.js": "const key='" + "github_pat_" + "a" * 30 + "';"}, "credential"),
    ({"app.js": "const at='https://e.org/file?X-Amz-Signature=abc';"}, "credential"),
    ({"app.js": "const path='s3://example-private/inputs';"}, "private_locator"),
    ({"styles.css": "body{background:url(https://e.org/track.png)}"}, "remote_asset"),
    ({"styles.css": "@import 'a.css';"}, "css_import"),
    ({"styles.css": "body{background:url( 'pic/a%20b.svg#x' )}", "pic/a b.svg": SVG + "</svg>"}, None),
    ({"figure.svg": SVG + '<image href="https://e.org/a.png"/></svg>'}, "remote_asset"),
    ({"figure.svg": SVG + '<use xlink:href="#a"/></svg>'}, None),
    ({"figure.svg": SVG + "<foreignObject/></svg>"}, "svg_active"),
    ({"figure.svg": SVG + '<path onload="run()"/></svg>'}, "svg_handler"),
    ({"weights.npz": "private"}, "suffix"),
    ({"engine.js": "export const run=()=>({});"}, "marker"),
    ({"engine.js": GOOD["engine.js"] + "//" + "x" * 1_000_000}, "size"),
    ({"styles.css": None}, "entry"),
    ({f"p{k}.css": "" for k in range(40)}, "count"),
]


@pytest.fixture(scope="module")
def broken_rules(spark):
    """The rules that each case breaks: all cases are sites of one table, audited in one job."""
    rows = []
    for k, (change, _) in enumerate(CASES):
        rows += [(k, p, len(t), bytearray(t.encode())) for p, t in (GOOD | change).items() if t is not None]
    found = references.site_findings(spark.createDataFrame(rows, "site int, path string, bytes long, content binary")).collect()
    return [{r.rule for r in found if r.site == k} for k in range(len(CASES))]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_site_rules(broken_rules, k):
    assert broken_rules[k] == ({CASES[k][1]} if CASES[k][1] else set())


def test_site_from_a_folder(spark, tmp_path):
    for name, text in GOOD.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "bad.css").write_bytes(b"\xff{}")
    found = references.site_findings(references.site_files(spark, str(tmp_path))).collect()
    assert [(r.path, r.rule) for r in found] == [("sub/bad.css", "encoding")]


def test_markdown_links(spark):
    text = """[a](sub/b.md) [b](<sub/c d.md> "title") ![i](sub/) [u](sub%2Fb.md#x) [h](https://e.org/x) [m](mailto:a@b) [p](#here)
    ```
    [code](nowhere.md)
    ```
    [gone](sub/gone.md) [out](../x.md) [root](/etc) [enc](%2e%2e/y.md)"""
    files = [("s", "README.md", text), ("s", "sub/b.md", "[up](../README.md) We aim for first place."), ("s", "sub/c d.md", None), ("t", "sub/gone.md", "close the gap")]
    got = references.markdown_findings(spark.createDataFrame(files, "site string, path string, text string"), ["sub/b.md", "sub/gone.md"])
    assert sorted((r.site, r.path, r.rule, r.detail) for r in got.collect()) == [
        ("s", "README.md", "broken_link", "sub/gone.md"),
        ("s", "README.md", "escaping_link", "%2e%2e/y.md"),
        ("s", "README.md", "escaping_link", "../x.md"),
        ("s", "README.md", "escaping_link", "/etc"),
        ("s", "sub/b.md", "phrase", "aim for first place"),
        ("t", "sub/gone.md", "phrase", "close the gap"),
    ]
