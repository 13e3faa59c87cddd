"""Links: parsing, danger, decoding and encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DANGEROUS = ("javascript", "data", "vbscript", "file")


def parse(href: Column) -> Column:
    """STRUCT<path, query, fragment, scheme: STRING, external: BOOLEAN>."""
    flat = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+", ""), "[\r\n\t]", "")
    body = F.regexp_extract(flat, r"(?s)^([^#]*)", 1)
    path = F.regexp_extract(body, r"(?s)^([^?]*)", 1)
    scheme = F.lower(F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.struct(
        path.alias("path"),
        F.regexp_extract(body, r"(?s)^[^?]*\?(.*)$", 1).alias("query"),
        F.regexp_extract(flat, r"(?s)^[^#]*#(.*)$", 1).alias("fragment"),
        scheme.alias("scheme"),
        ((scheme != "") | path.startswith("//")).alias("external"),
    )


def dangerous(uri: Column) -> Column:
    return uri["scheme"].isin(*DANGEROUS)


def kind(uri: Column) -> Column:
    return (
        F.when(dangerous(uri), "dangerous")
        .when(uri["external"], "external")
        .when(uri["path"] == "", F.when(uri["fragment"] == "", "empty").otherwise("same-document"))
        .when(uri["path"].startswith("/"), "absolute")
        .otherwise("local")
    )


def decode(part: Column) -> Column:
    """Percent-decoding without Python: malformed escapes stay, plus signs stay, broken UTF-8 is replaced."""
    plus = F.replace(part, F.lit("+"), F.lit("%2B"))
    return F.when(~F.contains(part, F.lit("%")), part).otherwise(F.url_decode(F.regexp_replace(plus, "%(?![0-9A-Fa-f]{2})", "%25")))


def encode(path: Column) -> Column:
    """Percent-encodes all but letters, digits and / - _ . ~"""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def with_path(uri: Column, path: Column) -> Column:
    """The link with another path, its query and fragment as they were."""
    tail = lambda sign, part: F.when(uri[part] != "", F.concat(F.lit(sign), uri[part])).otherwise("")
    return F.concat(encode(path), tail("?", "query"), tail("#", "fragment"))
