"""Canonical addresses, content-stable ids and public-URL rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track, besides every key that starts with ``utm_``.
TRACKERS = (
    "gclid", "fbclid", "dclid", "msclkid", "ttclid", "twclid", "igshid", "yclid", "_ga", "_gl", "mc_cid", "mc_eid", "gbraid", "wbraid",
    "gad_source", "gad_campaignid", "srsltid",
)
#: Host suffixes that are never public.
LOCAL_SUFFIXES = ("localhost", "local", "internal", "lan", "home", "home.arpa", "invalid", "test", "onion")
#: Host to adapter.
ADAPTERS = {
    "recruit.navercorp.com": "naver", "recruit.cj.net": "cj", "careers.kakao.com": "kakao", "recruit.lotte.co.kr": "lotte", "www.saramin.co.kr": "saramin", "saramin.co.kr": "saramin", "www.jobkorea.co.kr": "jobkorea",
    "jobkorea.co.kr": "jobkorea", "www.wanted.co.kr": "wanted", "wanted.co.kr": "wanted",
}

_PARTS = r"^(?i:(https?))://(\[[^\]/?#@\\]*\](?::\d*)?|[^/?#@\\\[\]]+)((?:/[^?#]*)?)(?:\?([^#]*))?(?:#.*)?$"
_UNSAFE = r"[\s\p{Cc}\p{Cf}\p{Cs}\\]|%(?![0-9A-Fa-f]{2})|%(?:[01][0-9A-Fa-f]|7[Ff])"
#: A label is 1 to 63 characters without a hyphen at its edges; letters of other scripts stand for their IDNA form.
_HOST = r"^(?:[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?\.)*[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?\.?$"
#: An IPv6 literal: at most eight groups of hexadecimal digits, two colons once for a run of zeros, an IPv4 address for the last two.
_V6 = r"(?i)^\[(?=[0-9a-f:.]*\]$)(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?!.*::.*::)(?!.*:::)(?=.*::)(?!(?:[^:\]]*:+){8,}[^:\]])(?:[0-9a-f]{1,4}(?=[:\]]))?(?::{1,2}(?:[0-9a-f]{1,4}(?=[:\]]))?)*(?:(?<=:)\d{1,3}(?:\.\d{1,3}){3})?|(?:[0-9a-f]{1,4}:){6}\d{1,3}(?:\.\d{1,3}){3})\]$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _pieces(url: Column) -> Column:
    """``scheme, authority, path, query`` of an address, found by one match; null for another shape. No piece holds a line feed, as no valid address does."""
    cut = F.regexp_replace(url, _PARTS, "$1\n$2\n$3\n$4")
    return F.when(url.rlike(_PARTS) & ~url.contains("\n"), F.split(cut, "\n"))


def host(url: Column) -> Column:
    """Lower-cased host without port; null if the address has another shape."""
    return F.nullif(F.lower(F.regexp_replace(_pieces(url)[1], r":\d*$", "")), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One spelling per address: scheme and host in lower case, no default port, fragment or tracking parameter.

    Order, duplicates, escapes and case of the rest of the query, a final slash and ``ref``/``source`` stay. Null for null, empty, relative, non-http,
    user-info, malformed or control-carrying addresses. Idempotent: a query of which nothing is left loses its mark.
    """

    def shown(p: Column) -> Column:
        scheme, name = F.lower(p[0]), F.lower(F.regexp_replace(p[1], r":\d+$", ""))
        port = F.regexp_extract(p[1], r":(\d+)$", 1)
        number = port.try_cast("int")
        default = number == F.when(scheme == "https", 443).otherwise(80)
        kept = F.array_join(F.filter(F.split(p[3], "&"), lambda part: ~is_tracker(F.substring_index(part, "=", 1))), "&")
        good = (name.rlike(_HOST) | name.rlike(_V6)) & (F.length(name) <= 253) & ~p[1].endswith(":") & ((port == "") | F.coalesce(number <= 65535, F.lit(False)))
        tail = _let(kept, lambda k: F.when(k == "", k).otherwise(F.concat(F.lit("?"), k)))
        whole = F.concat(scheme, F.lit("://"), name, F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), number.cast("string"))), F.when(p[2] == "", "/").otherwise(p[2]), tail)
        return F.when(good, whole)

    return F.when(~url.rlike(_UNSAFE), _let(_pieces(url), shown))


def is_tracker(key: Column) -> Column:
    plain = F.lower(F.coalesce(F.try_url_decode(key), key))
    return plain.startswith("utm_") | plain.isin(*TRACKERS)


def posting_id(canonical: Column) -> Column:
    """Hex sha-256 of the canonical address."""
    return F.sha2(canonical, 256)


def public_shape(url: Column) -> Column:
    """http(s), a host, no user info, default or no port."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#@\\\s:]+(?::(?:80|443))?(?:[/?#][^\s]*)?$"), F.lit(False))


def adapter_for(url: Column) -> Column:
    """Adapter of an exactly known host, else ``generic``."""
    known = F.create_map(*[F.lit(x) for pair in ADAPTERS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, host(url)), F.lit("generic"))
