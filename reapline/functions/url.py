"""URL functions: Column in, Column out.

Regular expressions instead of ``parse_url``: java.net.URI refuses many URLs that
crawlers meet, and these stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"

# Address blocks that count as private, as [first, last].
PRIVATE_IPV4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.7"),
    ("192.0.0.170", "192.0.0.171"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


BLANKS = " \t\n\x0b\f\r"


def stripped(c) -> Column:
    """Trim any white space, not only blanks; no regular expression involved."""
    return F.btrim(_col(c), F.lit(BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Plain reuse of a Column copies its expression; filters that Spark pushes through
    projections copy it again.  Binding it as a lambda variable prevents both.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_http_url(u) -> Column:
    return F.coalesce(stripped(u).rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def scheme(u) -> Column:
    return F.lower(F.regexp_extract(_col(u), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(u) -> Column:
    return F.lower(F.regexp_extract(_col(u), _SCHEME + r"([^/?#]*)", 1))


def host(u) -> Column:
    """Host without user information and port, lower case."""
    bare = F.regexp_replace(netloc(u), r"^.*@", "")
    return F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(bare, r":\d*$", "")
    )


def path(u) -> Column:
    return F.regexp_extract(_col(u), _SCHEME + r"[^/?#]*([^?#]*)", 1)


def origin(u) -> Column:
    return F.concat(scheme(u), F.lit("://"), netloc(u))


def domain_key(u, two_label_suffixes: Iterable[str] = ()) -> Column:
    """Registrable domain: last two host labels, three under a known two-label suffix."""
    labels = F.filter(F.split(host(u), r"\."), lambda x: x != "")

    def last(n: int) -> Column:
        return F.concat_ws(".", F.when(F.size(labels) > n, F.slice(labels, -n, n)).otherwise(labels))

    two = last(2)
    suffixes = list(two_label_suffixes)
    key = F.when(two.isin(suffixes), last(3)).otherwise(two) if suffixes else two
    return F.substring(F.coalesce(key, F.lit("")), 1, 255)


def url_pattern(u) -> Column:
    """Host and path with numeric path parts replaced by a star."""
    site = F.regexp_replace(F.regexp_extract(_col(u), _SCHEME + r"([^/?#]*)", 1), r"(?i)^www\.", "")
    return F.substring(F.concat(site, F.regexp_replace(path(u), r"/\d+", "/*")), 1, 512)


def normalized_url(u) -> Column:
    """Trimmed URL without trailing slashes: the identity of a linked record."""
    return F.regexp_replace(stripped(u), r"/+$", "")


def page_identity(u) -> Column:
    """URL without query and fragment, trailing slash removed."""
    return F.regexp_replace(F.regexp_replace(stripped(u), r"[?#].*$", ""), r"/+$", "")


def same_target(current, target) -> Column:
    """Same site, and the current path equals or lies under the target path."""
    cur = F.regexp_replace(path(current), r"/+$", "")
    tgt = F.regexp_replace(path(target), r"/+$", "")
    return F.coalesce(
        is_http_url(current)
        & (netloc(current) == netloc(target))
        & ((cur == tgt) | F.startswith(cur, F.concat(tgt, F.lit("/")))),
        F.lit(False),
    )


def url_matches(expected, actual) -> Column:
    """Equal; same site with the expected path as prefix; or site contained in site."""
    e, a = _col(expected), _col(actual)
    e_site, a_site, e_path = netloc(e), netloc(a), path(e)
    return F.coalesce(
        (e != "")
        & (a != "")
        & (
            (e == a)
            | ((e_site != "") & (e_site == a_site) & (e_path != "") & F.startswith(path(a), e_path))
            | ((e_site != "") & F.contains(a_site, e_site))
        ),
        F.lit(False),
    )


def _ipv4_number(dotted: str) -> int:
    number = 0
    for part in dotted.split("."):
        number = number * 256 + int(part)
    return number


def is_private_host(h) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    dotted = rf"^{octet}(?:\.{octet}){{3}}$"
    six = r"^(?:::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:)"
    blocks = F.array(
        *[F.struct(F.lit(_ipv4_number(a)).alias("first"), F.lit(_ipv4_number(b)).alias("last")) for a, b in PRIVATE_IPV4]
    )

    def in_block(name: Column) -> Column:
        number = F.aggregate(F.split(name, r"\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
        return let(number, lambda n: F.exists(blocks, lambda r: n.between(r["first"], r["last"])))

    def private(name: Column) -> Column:
        v6 = F.contains(name, F.lit(":")) & name.rlike(six)
        return name.isin("localhost", "localhost.localdomain") | F.when(name.rlike(dotted), in_block(name)).otherwise(v6)

    return F.coalesce(let(F.regexp_replace(F.lower(stripped(h)), r"\.+$", ""), private), F.lit(False))


def url_policy(u, allow_private: bool = False) -> Column:
    """Reason a URL may not be fetched at all, or null when it may be considered."""

    def judge(text: Column) -> Column:
        has_login = netloc(text).rlike(r"^[^@]*[^@:][^@]*@")
        chain = F.when(text.isNull() | ~is_http_url(text) | (host(text) == ""), F.lit("http_https_required")).when(
            has_login, F.lit("embedded_credentials")
        )
        return chain if allow_private else chain.when(is_private_host(host(text)), F.lit("private_network_denied"))

    return let(stripped(u), judge)


def safe_domain(u) -> Column:
    """Site name that is safe inside a file name."""
    site = F.regexp_extract(_col(u), _SCHEME + r"([^/?#]*)", 1)
    cleaned = F.regexp_replace(F.when(site == "", "site").otherwise(site), r"[^a-zA-Z0-9_.\-]+", "_")
    return F.coalesce(F.when(cleaned != "", cleaned), F.lit("site"))


def domain_folder(u) -> Column:
    """Folder name for the results of a site: no ``www.``, no port."""
    site = F.regexp_extract(_col(u), _SCHEME + r"([^/?#]*)", 1)
    return F.regexp_extract(F.regexp_replace(site, r"^www\.", ""), r"^([^:]*)", 1)
