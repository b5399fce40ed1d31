"""Column expressions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as X

_PARTS = r"(?i)^(https?)://([^/?#@:]+)(?::([0-9]{1,5}))?(/[^?#]*)?(?:\?[^#]*)?(?:#.*)?$"


def parts(url: Column) -> Column:
    """Struct (scheme, host, port, path) of an http or https URL without credentials; the port is the scheme's if none is given."""
    get = lambda k: F.regexp_extract(url, _PARTS, k)
    port = F.coalesce(get(3).try_cast("int"), F.when(F.lower(get(1)) == "https", 443).otherwise(80))
    return F.when(
        url.rlike(_PARTS),
        F.struct(F.lower(get(1)).alias("scheme"), F.lower(get(2)).alias("host"), port.alias("port"), F.when(get(4) == "", "/").otherwise(get(4)).alias("path")),
    )


def is_public(url: Column) -> Column:
    """http or https, a host, no credentials, and not a local, private or reserved IPv4 address."""
    host = parts(url)["host"]
    octet = lambda k: F.regexp_extract(host, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", k).try_cast("int")
    a, b = octet(1), octet(2)
    local = (
        (host == "localhost") | host.endswith(".localhost") | (a == 127) | (a == 10) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (host == "0.0.0.0") | (host == "255.255.255.255")
    )
    return host.isNotNull() & ~F.coalesce(local, F.lit(False))


def base_directory(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def in_scope(base: Column, url: Column) -> Column:
    """Same scheme, host and port, and a path below the directory of the base, or its very path."""
    return parts_in_scope(parts(base), parts(url))


def parts_in_scope(a: Column, b: Column) -> Column:
    """``in_scope`` for URLs that are taken apart already; name them as columns, so that they are taken apart once."""
    same = (a["scheme"] == b["scheme"]) & (a["host"] == b["host"]) & (a["port"] == b["port"])
    return F.coalesce(same & (b["path"].startswith(base_directory(a["path"])) | (a["path"] == b["path"])), F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def resolve(base: Column, href: Column) -> Column:
    """An absolute, scheme-relative, root-relative or plain relative reference (no dot segments) against a base URL."""
    origin = F.regexp_extract(base, r"^[^/]+//[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^/]+//[^/?#]*(/[^?#]*)?", 1)
    folder = F.when(path == "", "/").otherwise(base_directory(path))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^[^/]+", 0), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), href))
        .otherwise(F.concat(origin, folder, href))
    )


def opens_externally(url: Column) -> Column:
    """Links that may be handed to the system: http, https and mailto."""
    return X.lower_ascii(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https", "mailto")
