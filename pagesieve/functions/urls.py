"""URL scalars. A regular expression is used because `parse_url` gives null for hosts with
underscores, non-ASCII letters or unescaped path characters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagesieve import constants as C
from pagesieve.functions.common import let
from pagesieve.functions.text import SPACE, strip

_SCHEME = r"\A([a-zA-Z][a-zA-Z0-9+.-]*):"
_AUTHORITY = r"\A(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
_HOST = r"\A(\[[^\]]*\]|[^:\[\]]*)"
_PORT = r"\A(?:\[[^\]]*\]|[^:\[\]]*):(.*)\z"


def _tidy(url: Column) -> Column:
    # Leading control characters and embedded tabs or newlines never belong to a URL.
    return F.regexp_replace(url, r"\A[\x{0}-\x{20}]+|[\t\n\r]", "")


def _host_and_port(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(_tidy(url), _AUTHORITY, 1), r"\A.*@", "")


def url_host(url: Column) -> Column:
    """Lower-cased host name without port, user info or brackets; empty if there is none."""
    return F.translate(F.lower(F.regexp_extract(_host_and_port(url), _HOST, 1)), "[]", "")


def guard_host(url: Column) -> Column:
    """The host as the URL guard compares it: trimmed and without trailing dots."""
    return F.rtrim(strip(url_host(url)), F.lit("."))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_tidy(url), _SCHEME, 1))


def url_scheme_port(url: Column) -> Column:
    """struct(scheme, port, port_error); the port defaults to 443 for https and 80 otherwise."""
    raw = F.regexp_extract(_host_and_port(url), _PORT, 1)
    return let(F.struct(url_scheme(url).alias("scheme"), raw.alias("raw")), lambda u: _port(u["scheme"], u["raw"]))


def _port(scheme: Column, raw: Column) -> Column:
    number = raw.try_cast("bigint")
    default = F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80)).cast("bigint")
    error = (
        F.when(raw == "", F.lit(None).cast("string"))
        .when(~raw.rlike(r"\A[0-9]+\z"), F.concat(F.lit("Port could not be cast to integer value as '"), raw, F.lit("'")))
        .when(number.isNull() | (number > 65535), F.lit("Port out of range 0-65535"))
    )
    port = F.when(error.isNull(), F.when((raw == "") | (number == 0), default).otherwise(number))
    return F.struct(scheme.alias("scheme"), port.alias("port"), error.alias("port_error"))


def has_http_prefix(url: Column) -> Column:
    """Case-sensitive prefix test of the request check."""
    return url.startswith("http://") | url.startswith("https://")


def normalize_url_scheme(url: Column) -> Column:
    trimmed = strip(url)
    return F.when(has_http_prefix(trimmed), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def normalize_mode(mode: Column) -> Column:
    """`precision` or `full`, else null."""
    value = F.lower(strip(F.coalesce(mode, F.lit(""))))
    return F.when(value.isin("precision", "full"), value)


def coerce_force_tier(tier: Column) -> Column:
    """struct(tier, error): 1 to 3 after trimming, null for no forced tier, else the error text."""
    trimmed = strip(tier)
    valid = trimmed.isin("1", "2", "3")
    error = F.concat(F.lit("ERROR: Invalid force_tier '"), tier, F.lit("'. Valid values are 1, 2, or 3."))
    return F.struct(
        F.when(valid, trimmed.cast("int")).alias("tier"),
        F.when(tier.isNotNull() & ~valid, error).alias("error"),
    )


def is_twitter(host: Column) -> Column:
    return host.isin(C.TWITTER_HOSTS)


def is_medium(host: Column) -> Column:
    return host.isin(C.MEDIUM_HOSTS) | host.endswith(".medium.com")


def needs_js(host: Column) -> Column:
    return host.isin(C.JS_HOSTS)


def site_type(host: Column) -> Column:
    """First match wins: the twitter hosts are in the script-only list too."""
    return (
        F.when(is_twitter(host), "twitter").when(is_medium(host), "medium")
        .when(needs_js(host), "js-spa").otherwise("general")
    )


def tweet_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"/status/(\d+)", 1)
    return F.when(found != "", found)


def is_redirect(status: Column) -> Column:
    return status.isin(C.REDIRECT_STATUSES)


def resolve_location(base: Column, location: Column) -> Column:
    """The absolute target of a redirect (RFC 3986 reference resolution)."""
    ref = F.regexp_replace(_tidy(location), rf"{SPACE}+\z", "")
    return let(ref, lambda r: F.when(r.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*:"), r).otherwise(_resolve(base, r)))


def _resolve(base: Column, ref: Column) -> Column:
    parts = r"\A([a-zA-Z][a-zA-Z0-9+.-]*:)(//[^/?#]*)?([^?#]*)(\?[^#]*)?"
    scheme = F.regexp_extract(base, parts, 1)
    site = F.concat(scheme, F.regexp_extract(base, parts, 2))
    path, query = F.regexp_extract(base, parts, 3), F.regexp_extract(base, parts, 4)
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    ref_path, ref_tail = F.regexp_extract(ref, r"\A([^?#]*)", 1), F.regexp_extract(ref, r"\A[^?#]*(.*)\z", 1)
    merged = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref_path)
    rooted = F.when(ref_path.startswith("/"), ref_path).otherwise(F.regexp_replace(merged, "/{2,}", "/"))
    return (
        F.when(ref == "", base)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("?"), F.concat(site, path, ref))
        .when(ref.startswith("#"), F.concat(site, path, query, ref))
        .otherwise(F.concat(site, let(rooted, _remove_dots), ref_tail))
    )


def _remove_dots(path: Column) -> Column:
    """Resolve `.` and `..` path segments; paths without them are passed through."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == ".", kept)
        .when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(s))),
        lambda kept: F.concat(
            F.lit("/"), F.array_join(kept, "/"),
            F.when((F.size(kept) > 0) & path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit("")),
        ),
    )
    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), folded).otherwise(path)
