"""Public-address tests as native expressions: IPv4 as a number, IPv6 as 32 hex digits."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from pagesieve import constants as C
from pagesieve.functions.common import let

_V4 = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"
_V6_GROUPS = r"\A(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?\z"


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(_V4)


def _v4_number(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(octets, F.lit(i)).try_cast("bigint")
    return number


def _v6_hex(ip: Column) -> Column:
    """An IPv6 text as 32 hex digits, or null when it is not a valid address."""
    text = F.lower(F.regexp_replace(ip, r"%.*\z", ""))

    def dotted_tail(t: Column) -> Column:
        """An IPv4 tail rewritten as two hex groups."""
        tail = F.regexp_extract(t, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z", 1)
        digits = F.lpad(F.lower(F.hex(_v4_number(tail))), 8, "0")
        return F.when(~t.contains("."), t).when(
            is_ipv4(tail), F.concat(F.regexp_replace(t, r"[0-9.]+\z", ""), F.regexp_replace(digits, r"\A(.{4})", "$1:"))
        )

    def expand(halves: Column) -> Column:
        sides = F.transform(halves, lambda h: F.filter(F.split(h, ":"), lambda g: g != ""))
        return let(sides, lambda s: join(halves, F.get(s, F.lit(0)), F.coalesce(F.get(s, F.lit(1)), F.array().cast("array<string>"))))

    def join(halves: Column, left: Column, right: Column) -> Column:
        missing = F.lit(8) - F.size(left) - F.size(right)
        shape = F.when(F.size(halves) == 2, missing >= 1).otherwise((F.size(halves) == 1) & (missing == 0))
        valid = shape & F.forall(halves, lambda h: h.rlike(_V6_GROUPS))
        full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        return F.when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

    return let(let(text, dotted_tail), lambda t: F.when(t.contains(":"), let(F.split(t, "::", -1), expand)))


def _in_blocks(value: Column, blocks: list[str], bound: str) -> Column:
    """Whether value lies in a block; `bound` formats an address as value is written. The
    ranges are one constant array, which keeps the expression small."""
    nets = [ipaddress.ip_network(b) for b in blocks]
    ranges = [(format(int(n.network_address), bound), format(int(n.broadcast_address), bound)) for n in nets]
    quoted = "'{}'" if bound.endswith("x") else "{}L"
    pairs = [f"struct({quoted.format(low)} AS low, {quoted.format(high)} AS high)" for low, high in ranges]
    return F.exists(F.expr(f"array({', '.join(pairs)})"), lambda r: value.between(r["low"], r["high"]))


def _v4_public(number: Column) -> Column:
    return ~_in_blocks(number, C.IPV4_PRIVATE, "d") | _in_blocks(number, C.IPV4_PUBLIC_EXCEPTIONS, "d")


def is_public_ip(ip: Column) -> Column:
    """True or false for a valid address, null for anything else. Multicast counts as public."""
    return let(ip, _is_public)


def _is_public(ip: Column) -> Column:
    def v6_public(digits: Column) -> Column:
        inner = F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint")
        return F.when(digits.startswith("00000000000000000000ffff"), _v4_public(inner)).otherwise(
            ~_in_blocks(digits, C.IPV6_PRIVATE, "032x") | _in_blocks(digits, C.IPV6_PUBLIC_EXCEPTIONS, "032x")
        )

    return F.when(is_ipv4(ip), let(_v4_number(ip), _v4_public)).when(ip.contains(":"), let(_v6_hex(ip), v6_public))
