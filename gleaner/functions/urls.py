"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, name: str) -> Column:
    """scheme, host (without user, port and brackets), path, query of an absolute
    URL, null if there is none."""
    def group(k: int) -> Column:
        return F.regexp_extract(url, _ABSOLUTE, k)

    authority = F.regexp_replace(group(2), "^.*@", "")
    host = F.lower(F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(authority, ":[0-9]*$", "")))
    out = {"scheme": F.lower(group(1)), "host": host, "path": group(3), "query": F.expr("null") if name != "query" else F.regexp_replace(group(4), r"^\?", "")}[name]
    return F.when(url.rlike(_ABSOLUTE), out)


def is_private_ip(host: Column) -> Column:
    """Loopback, private, link-local and this-network addresses."""

    def v4(octet: Column) -> Column:
        a, b = octet[0], F.try_element_at(octet, F.lit(2))
        return (a == 0) | (a == 10) | (a == 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))

    def told(h: Column) -> Column:
        v6 = F.lower(h).rlike(r"^(::1?|fe[89ab][0-9a-f]:.*|fe[c-f][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*)$")
        octet = F.transform(F.split(h, r"\."), lambda x: x.try_cast("int"))
        return F.when(h.rlike(r"^[0-9]+(\.[0-9]+){3}$"), once(octet, v4)).otherwise(F.coalesce(v6, F.lit(False)))

    return once(F.regexp_replace(host, "^(?i)::ffff:(?=[0-9]+\\.)", ""), told)


def is_blocked_host(host: Column) -> Column:
    return once(F.lower(host), lambda h: h.isin("localhost", "0.0.0.0", "::1") | h.endswith(".local") | h.endswith(".internal") | is_private_ip(h))


def rejection(url: Column) -> Column:
    """Why a URL must not be fetched; null if it may."""

    def told(u: Column) -> Column:
        return (
            F.when(F.coalesce(u, F.lit("")) == "", "empty")
            .when(~u.rlike(_ABSOLUTE) & ~u.rlike(r"^(?i)(javascript|data|mailto|tel|file):"), "not absolute")
            .when(~F.coalesce(part(u, "scheme"), F.lit("")).isin("http", "https"), "scheme")
            .otherwise(once(part(u, "host"), lambda h: F.when(h == "", "not absolute").when(is_blocked_host(h), "blocked host")))
        )

    return once(F.trim(url), told)


def normalized(url: Column) -> Column:
    """The form in which an allowed URL is fetched: trimmed, scheme and host in
    lower case, without the scheme's own port, with a path; null if not allowed."""
    u = F.trim(url)
    scheme, authority = F.lower(F.regexp_extract(u, _ABSOLUTE, 1)), F.regexp_extract(u, _ABSOLUTE, 2)
    own = F.when(scheme == "https", ":443").otherwise(":80")
    host = F.concat(F.regexp_extract(authority, "^(.*@)?", 0), F.lower(F.regexp_replace(authority, "^.*@", "")))
    host = F.when(host.endswith(own), F.left(host, F.length(host) - F.length(own))).otherwise(host)
    path = F.regexp_extract(u, _ABSOLUTE, 3)
    rest = F.concat(F.regexp_extract(u, _ABSOLUTE, 4), F.regexp_extract(u, _ABSOLUTE, 5))
    return F.when(rejection(u).isNull(), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), rest))


def compare_key(url: Column) -> Column:
    """The path alone if absolute, without end slashes, lower-case."""
    return F.lower(F.regexp_replace(F.coalesce(part(url, "path"), url), "/+$", ""))


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(part(a, "host") == part(b, "host"), F.lit(False))


def is_candidate(href: Column) -> Column:
    return F.coalesce((F.trim(href) != "") & ~F.trim(href).rlike("(?i)^(#|javascript:|mailto:|tel:)"), F.lit(False))


def _merged(base: Column, path: Column) -> Column:
    """A path without dot segments."""
    def step(acc: Column, p: Column) -> Column:
        return F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(p)))

    def told(p: Column) -> Column:
        kept = once(F.split(p, "/"), lambda parts: F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step))
        return once(kept, lambda out: F.concat(F.array_join(out, "/"), F.when(p.rlike(r"/\.{1,2}$") & (F.element_at(out, -1) != ""), "/").otherwise("")))

    return F.concat(base, once(path, told))


def resolve(base: Column, href: Column) -> Column:
    """A reference against an absolute base; null where either is unusable."""
    return once(F.trim(href), lambda h: _resolved(base, h))


def _resolved(base: Column, h: Column) -> Column:
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path, query = F.regexp_extract(h, "^([^?#]*)", 1), F.regexp_extract(h, "^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(once(part(base, "path"), lambda p: F.when(p == "", "/").otherwise(p)), "[^/]*$", "")
    return F.when(
        base.rlike(_ABSOLUTE) & h.isNotNull(),
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
        .when(h == "", base)
        .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), h))
        .when(path.startswith("/"), F.concat(_merged(root, path), query))
        .otherwise(F.concat(_merged(root, F.concat(folder, path)), query)),
    )


def page_url(url: Column, page: Column) -> Column:
    """The URL of page n: a /page-N or /page/N in the path is rewritten, else the
    query gets page=N in place of any page parameter."""
    n = page.cast("string")
    bare = F.regexp_extract(url, "^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*((?:\?[^#]*)?)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("page="))
    dashed, slashed = r"(?i)(/page-)[0-9]+(?=/|$)", r"(?i)(/page/)[0-9]+(?=/|$)"
    return (
        F.when(bare.rlike(dashed), F.concat(F.regexp_replace(bare, F.lit(dashed), F.concat(F.lit("$1"), n)), tail))
        .when(bare.rlike(slashed), F.concat(F.regexp_replace(bare, F.lit(slashed), F.concat(F.lit("$1"), n)), tail))
        .otherwise(F.concat(bare, F.lit("?"), F.array_join(F.concat(kept, F.array(F.concat(F.lit("page="), n))), "&")))
    )


def scheme_value(href: Column, scheme: str) -> Column:
    """The address of a mailto: or tel: link, percent-decoded."""
    v = F.regexp_replace(F.substring(href, len(scheme) + 1, 1 << 20), r"\?.*$", "")
    out = F.trim(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))))
    return F.when(F.lower(href).startswith(scheme) & (out != ""), out)
