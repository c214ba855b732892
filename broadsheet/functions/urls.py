"""URLs, host names and addresses."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import constants as K
from broadsheet.functions.text import decode_entities, trimmed

_PORTS = {"http": 80, "https": 443}


def _resolve_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        plain = unquote(part) if "%2e" in part.lower() else part
        if plain == "..":
            if len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        elif plain == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/".join(out) or "/"


def canonical_url(value: str) -> str | None:
    """http(s) URL without credentials, fragment and tracking parameters; null for anything else."""
    try:
        u = urlsplit(re.sub(r"[\t\n\r]", "", value))
        port = u.port
    except ValueError:
        return None
    scheme = u.scheme.lower()
    if scheme not in _PORTS or not u.hostname or u.username or u.password:
        return None
    try:
        host = u.hostname.encode("idna").decode() if not u.hostname.isascii() else u.hostname
    except UnicodeError:
        return None
    if re.search(r"[\s<>^|%#?@\\]", host):
        return None
    host = f"[{host}]" if ":" in host else host
    at = host if port is None or port == _PORTS[scheme] else f"{host}:{port}"
    path = quote(_resolve_dots(u.path or "/"), safe="/%:@!$&'()*+,;=~-._[]|^")
    parameters = [p for p in u.query.split("&") if p] if u.query else []
    kept = [p for p in parameters if not _tracks(unquote(p.split("=", 1)[0].replace("+", " ")).lower())]
    query = u.query if len(kept) == len(parameters) else "&".join(kept)
    return f"{scheme}://{at}{path}" + (f"?{quote(query, safe='/%:@!$&()*+,;=~-._?[]|^`{}')}" if query else "")


def _tracks(name: str) -> bool:
    return name.startswith("utm_") or name in K.TRACKING_PARAMETERS


@F.pandas_udf(T.StringType())
def _canonical(url: pd.Series) -> pd.Series:
    return url.map(lambda u: None if u is None else canonical_url(u))


#: A URL that is canonical but for its fragment: these stay on the JVM side.
CLEAN = r"^https?://[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*(?:/[A-Za-z0-9_~-][A-Za-z0-9_~.-]*)+/?(?:\?[A-Za-z0-9_=&.-]*)?(?:#[A-Za-z0-9_-]*)?$"


def canonicalize(url: Column) -> Column:
    decoded = decode_entities(trimmed(url))
    clean = url.rlike(CLEAN) & ~F.lower(url).rlike("(?:[?&](?:utm_|" + "|".join(K.TRACKING_PARAMETERS) + "))|/\\.")
    return F.when(clean, F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"\?$", "")).otherwise(_canonical(decoded))


def guid(value: Column) -> Column:
    """A source's own id: decoded, one space for white space, empty is null, URLs canonical."""
    t = F.regexp_replace(trimmed(decode_entities(value)), r"(?U)\s+", " ")
    t = F.when(t != "", t)
    return F.when(t.rlike("(?i)^https?:"), F.coalesce(canonicalize(t), t)).otherwise(t)


def feed_key(url: Column) -> Column:
    return F.coalesce(canonicalize(url), url)


def folded_feed_key(url: Column) -> Column:
    """The same feed under another name: no leading www. and no closing slash; the query counts."""
    key = F.regexp_replace(feed_key(url), r"^(https?://)www\.", "$1")
    return F.regexp_replace(key, r"/(\?.*)?$", "$1")


def hostname(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


_V4 = r"^(?:(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def ipv4_number(address: Column) -> Column:
    """An address in strict decimal form as a number; null for any other text."""
    parts = F.split(address, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.try_cast("long"))
    return F.when(address.rlike(_V4), number)


def ipv4_reach(address: Column) -> Column:
    """The reach of the first range that holds an address, else public; null if it is no IPv4 address."""
    n = ipv4_number(address)
    out = F.lit("public")
    for base, bits, reach in reversed(K.IPV4_RANGES):
        low = int(ipaddress.IPv4Address(base))
        out = F.when(n.between(low, low + (1 << (32 - bits)) - 1), reach).otherwise(out)
    return F.when(n.isNotNull(), out)


_V6 = [(ipaddress.IPv6Network(f"{base}/{bits}", strict=False), reach) for base, bits, reach in K.IPV6_RANGES]
_V4_NETS = [(ipaddress.IPv4Network(f"{base}/{bits}"), reach) for base, bits, reach in K.IPV4_RANGES]


def ipv6_reach_of(text: str) -> str | None:
    """Reach of an IPv6 address, in brackets or not: mapped ones have that of what they carry, others that embed a public
    IPv4 address are reserved."""
    inner = text[1:-1] if text.startswith("[") and text.endswith("]") else text
    if "%" in inner or ":" not in inner:
        return None
    try:
        a = ipaddress.IPv6Address(inner)
    except ValueError:
        return None
    high, low = int(a) >> 32, int(a) & 0xFFFFFFFF
    if int(a) == 0:
        return "unspecified"
    if int(a) == 1:
        return "loopback"
    if high in (0, 0xFFFF, 0xFFFF0000):
        carried = next((r for net, r in _V4_NETS if ipaddress.IPv4Address(low) in net), "public")
        return carried if high == 0xFFFF or carried != "public" else "reserved"
    return next((r for net, r in _V6 if a in net), "public")


@F.pandas_udf(T.StringType())
def _ipv6_reach(host: pd.Series) -> pd.Series:
    return host.map(lambda h: ipv6_reach_of(h) if h is not None else None)


def host_reach(host: Column) -> Column:
    """kind and reach of a host: address, private-name, reserved-name or name (which is no verdict of safety)."""
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    address = F.coalesce(ipv4_reach(h), F.when(h.contains(":"), _ipv6_reach(h)))
    private = (h == "localhost") | h.rlike("(?:" + "|".join(re.escape(s) for s in K.PRIVATE_SUFFIXES) + ")$")
    tld = F.element_at(F.split(h, r"\."), -1)
    reserved = tld.isin(K.RESERVED_TLDS) | h.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(d) for d in K.RESERVED_DOMAINS) + ")$")
    kind = F.when(address.isNotNull(), "address").when(private, "private-name").when(reserved, "reserved-name").otherwise("name")
    return F.struct(h.alias("host"), kind.alias("kind"), address.alias("reach"))


def is_public(host: Column) -> Column:
    return F.coalesce(host_reach(host)["reach"] == "public", F.lit(False))


def url_problem(url: Column) -> Column:
    """Why a feed may not be fetched from a URL; null if it may. https only, a plain public name, no port or fragment."""
    host = hostname(url)
    reach = host_reach(host)
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return (
        F.when(url.isNull() | ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "invalid-url")
        .when(F.length(url) > 2048, "invalid-url")
        .when(~url.rlike("(?i)^https://"), "not-https")
        .when((F.length(host) < 1) | (F.length(host) > 253), "invalid-url")
        .when(authority.contains("@"), "credentials")
        .when(authority.rlike(r":[0-9]+$") & ~authority.rlike(r":443$"), "port")
        .when(url.contains("#"), "fragment")
        .when(reach["kind"] != "name", "unsafe-host")
    )
