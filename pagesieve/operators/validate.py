"""Request checks and the URL guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagesieve import constants as C
from pagesieve.functions import addresses as A, urls as U
from pagesieve.functions.text import strip
from pagesieve.operators.skew import skewable_join


def validate_request(requests: DataFrame) -> DataFrame:
    """Adds clean_url, clean_mode, force_tier and error (null when the request is accepted)."""
    url, mode = strip(F.coalesce("url", F.lit(""))), F.lower(strip(F.coalesce("mode", F.lit(""))))
    auto = F.col("tier") == "Auto"
    number = strip(F.col("tier")).try_cast("int")
    error = (
        F.when(~U.has_http_prefix(url), F.lit("Invalid URL. Must start with http:// or https://"))
        .when(~mode.isin("precision", "full"), F.lit("Invalid mode. Must be 'precision' or 'full'."))
        .when(~auto & number.isNull(),
              F.concat(F.lit("invalid literal for int() with base 10: '"), F.col("tier"), F.lit("'")))
    )
    return requests.select(
        "*", url.alias("clean_url"), mode.alias("clean_mode"),
        F.when(~auto, number).alias("force_tier"), error.alias("error"),
    )


def syntax_error(url: Column, scheme: Column, host: Column) -> Column:
    return (
        F.when(~scheme.isin("http", "https"),
               F.concat(F.lit("ERROR: Invalid URL: "), url, F.lit(". URL must start with http:// or https://")))
        .when(host == "", F.concat(F.lit("ERROR: Invalid URL: "), url, F.lit(". URL host is missing.")))
        .when((host == "localhost") | host.endswith(".localhost") | host.endswith(".local"),
              F.concat(F.lit("ERROR: URL host '"), host, F.lit("' is not allowed.")))
    )


def validate_url_syntax(urls: DataFrame) -> DataFrame:
    """Adds scheme, host and error: the checks of the guard that need no address lookup."""
    parsed = urls.withColumn("scheme", U.url_scheme(F.col("url"))).withColumn("host", U.guard_host(F.col("url")))
    return parsed.withColumn("error", syntax_error(F.col("url"), F.col("scheme"), F.col("host")))


def _address_error(host: Column, ip: Column) -> Column:
    return F.concat(
        F.lit("ERROR: URL host '"), host, F.lit("' resolves to non-public IP '"), ip, F.lit("' and is not allowed.")
    )


def host_verdicts(dns: DataFrame) -> DataFrame:
    """One row per host: how many usable addresses, and the first one that is not public."""
    public = A.is_public_ip(F.col("ip"))
    first_bad = F.min(F.when(~F.col("public"), F.struct("ord", "ip")))
    return (
        dns.select("host", "ord", "ip", public.alias("public"))
        .groupBy("host")
        .agg(F.count("public").alias("addresses"), first_bad.alias("bad"))
        .select("host", "addresses", F.col("bad.ip").alias("bad_ip"))
    )


def _judge(keys: DataFrame, dns: DataFrame) -> DataFrame:
    """Adds error for rows with host, syntax and port error; literal addresses need no lookup."""
    host = F.col("host")
    looked_up = skewable_join(keys.withColumn("literal", A.is_public_ip(host)), host_verdicts(dns), ["host"])
    error = (
        F.when(F.col("syntax").isNotNull(), F.col("syntax"))
        .when(F.col("literal").isNotNull(), F.when(~F.col("literal"), _address_error(host, host)))
        .when(F.col("port_error").isNotNull(), F.col("port_error"))
        .when(F.coalesce(F.col("addresses"), F.lit(0)) == 0,
              F.concat(F.lit("ERROR: Could not resolve host '"), host, F.lit("' to an IP address.")))
        .when(F.col("bad_ip").isNotNull(), _address_error(host, F.col("bad_ip")))
    )
    return looked_up.withColumn("error", error).drop("addresses", "bad_ip", "syntax", "port_error", "literal")


def validate_urls(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """Adds scheme, host and error; every address of the host must be public."""
    parsed = validate_url_syntax(urls).withColumnRenamed("error", "syntax")
    return _judge(parsed.withColumn("port_error", U.url_scheme_port(F.col("url"))["port_error"]), dns)


def validate_urls_once(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """As validate_urls, with one verdict per (host, scheme, port) shared by all its URLs.

    Duplicates of a key vanish in the map-side half of the distinct, so a popular host costs one
    row per task before the lookup. Texts that quote the URL itself are not shared.
    """
    endpoint = U.url_scheme_port(F.col("url"))
    parsed = (
        validate_url_syntax(urls).withColumnRenamed("error", "syntax")
        .withColumn("port", endpoint["port"]).withColumn("port_error", endpoint["port_error"])
    )
    key = ["host", "scheme", "port"]
    none = F.lit(None).cast("string")
    verdicts = _judge(parsed.select(*key).distinct().withColumns({"syntax": none, "port_error": none}), dns)
    joined = skewable_join(parsed, verdicts, key)
    error = F.coalesce(F.col("syntax"), F.col("port_error"), F.col("error"))
    return joined.withColumn("error", error).drop("syntax", "port_error")


def plan_tiers(requests: DataFrame, allow_tier3: bool) -> DataFrame:
    """One row per tier to run, in order; one row with a warning when none may run.
    Needs host and force_tier."""
    forced = F.col("force_tier")
    auto = forced.isNull()
    wanted = {
        "tier1_curl": (forced == 1) | (auto & ~U.needs_js(F.col("host"))),
        "tier2_camoufox": auto | (forced == 2),
        "tier3_nodriver": (auto | (forced == 3)) & F.lit(allow_tier3),
    }
    tiers = F.array_compact(F.array(*[
        F.when(run, F.struct(F.lit(name).alias("tier"), F.lit(C.TIER_CAPS_MS[name]).alias("cap_ms")))
        for name, run in wanted.items()
    ]))
    hint = F.when((forced == 3) & F.lit(not allow_tier3), F.lit(C.ENABLE_TIER3))
    hint = hint.otherwise(F.lit(f"Enable tier 3 with {C.TIER3_SWITCH}=1"))
    planned = requests.select("*", F.posexplode_outer(tiers).alias("position", "planned"))
    none = F.col("planned").isNull()
    return planned.select(
        *[c for c in planned.columns if c not in ("planned",)],
        F.col("planned.tier").alias("planned_tier"), F.col("planned.cap_ms").alias("cap_ms"),
        F.when(none, F.lit(C.NO_TIERS)).alias("warning"), F.when(none, hint).alias("suggestion"),
    )
