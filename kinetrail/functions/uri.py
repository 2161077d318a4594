"""Addresses as column expressions: parts, dot segments, resolution against a base, percent and character references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the parts of an address (RFC 3986, appendix B).
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Character references by name that can stand in addresses.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "colon": ":", "sol": "/", "bsol": "\\", "period": ".", "num": "#", "quest": "?", "Tab": "\t", "NewLine": "\n"}
#: What browsers take off: control characters and blanks at the ends, tabs and line ends anywhere.
ENDS, INNER = r"^[\x00-\x20]+|[\x00-\x20]+$", r"[\t\r\n]"


def cleaned(reference: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(reference, INNER, ""), ENDS, "")


def unescaped(text: Column) -> Column:
    """Numeric and the NAMED character references replaced, each once."""
    numeric = F.regexp_extract_all(text, F.lit(r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});?"), F.lit(0))

    def char(reference: Column) -> Column:
        digits = F.regexp_extract(reference, r"(?i)&#x?([0-9a-f]+)", 1)
        code = F.when(reference.rlike("(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        safe = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), code).otherwise(0xFFFD)
        return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")

    out = F.when(text.contains("&#"), F.aggregate(F.array_distinct(numeric), text, lambda at, r: F.replace(at, r, char(r)))).otherwise(text)
    for name, char_ in NAMED.items():
        if name != "amp":
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char_))
    return F.when(text.contains("&"), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def unquoted(text: Column) -> Column:
    """Percent-decoding as UTF-8; what is no percent-encoding stays, and so does a plus sign."""
    safe = F.replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(text.contains("%"), F.url_decode(safe)).otherwise(text)


def quoted(text: Column) -> Column:
    """Percent-encoding of all but letters, digits, `_.-~` and slashes."""
    out = F.url_encode(text)
    for made, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(made), F.lit(wanted))
    return out


def parts(address: Column) -> Column:
    """(scheme, authority, path, query, fragment); null where one is absent, and all null of a null address. The scheme in lower case."""
    get = lambda k: F.regexp_extract(address, PARTS, k)
    scheme, before = F.lower(get(1)), F.regexp_extract(address, r"(?s)^([^#]*)", 1)
    return F.when(
        address.isNotNull(),
        F.struct(
            F.when(scheme != "", scheme).alias("scheme"),
            F.when(address.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), get(2)).alias("authority"),
            get(3).alias("path"),
            F.when(before.contains("?"), get(4)).alias("query"),
            F.when(address.contains("#"), get(5)).alias("fragment"),
        ),
    )


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def without_dots(path: Column) -> Column:
    """The path with `.` and `..` carried out; `..` at the root stays there."""
    none = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.when(segment == ".", kept).when(segment == "..", up).otherwise(F.array_append(kept, segment))

    kept = F.aggregate(_segments(path), none, step)
    kept = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.array_append(kept, F.lit(""))).otherwise(kept)
    joined = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), joined).otherwise(path)


def climbs(path: Column) -> Column:
    """Whether `..` leaves the folder that the path starts in, at any point."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("left"))

    def step(at: Column, segment: Column) -> Column:
        depth = at["depth"] + F.when(segment == "..", -1).when(segment.isin(".", ""), 0).otherwise(1)
        return F.struct(depth.alias("depth"), (at["left"] | (depth < 0)).alias("left"))

    return path.rlike(r"(?:^|/)\.\.(?:/|$)") & F.aggregate(_segments(path), start, step)["left"]


def joined(scheme: Column, authority: Column, path: Column, query: Column) -> Column:
    return F.concat(
        F.coalesce(F.concat(scheme, F.lit(":")), F.lit("")),
        F.coalesce(F.concat(F.lit("//"), authority), F.lit("")),
        path,
        F.coalesce(F.concat(F.lit("?"), query), F.lit("")),
    )


def resolved(base: Column, reference: Column) -> Column:
    """A reference's address as seen from a base, both as `parts`, without its fragment (RFC 3986, 5.2)."""
    own, host = reference["scheme"].isNotNull(), reference["authority"].isNotNull()
    folder = F.when(base["authority"].isNotNull() & (base["path"] == ""), "/").otherwise(F.regexp_extract(base["path"], r"(?s)^(.*/)?", 0))
    stays = ~own & ~host & (reference["path"] == "")
    rooted = own | host | reference["path"].startswith("/")
    path = F.when(stays, base["path"]).when(rooted, without_dots(reference["path"])).otherwise(without_dots(F.concat(folder, reference["path"])))
    query = F.when(stays, F.coalesce(reference["query"], base["query"])).otherwise(reference["query"])
    scheme = F.when(own, reference["scheme"]).otherwise(base["scheme"])
    return joined(scheme, F.when(own | host, reference["authority"]).otherwise(base["authority"]), path, query)


def page_key(address: Column) -> Column:
    """What names a page: scheme and authority in lower case, the decoded path (at least a slash), the query; no fragment."""
    p = parts(address)
    path = F.when(p["authority"].isNotNull() & (p["path"] == ""), "/").otherwise(unquoted(p["path"]))
    return joined(p["scheme"], F.lower(p["authority"]), path, p["query"])
