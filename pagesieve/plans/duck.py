"""SQL snippets of the checking engine (RE2 regular expressions)."""

from __future__ import annotations

import ipaddress

from pagesieve import constants as C
from pagesieve.functions.text import LINE_BREAK, SPACE


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(e: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({e}, {quote(pattern)}, {by}, 'g')"


def strip(e: str) -> str:
    return replace_all(e, rf"\A{SPACE}+|{SPACE}+\z")


def collapse(e: str) -> str:
    return replace_all(e, r"\n{3,}", r"chr(10) || chr(10)")


def strip_tags(e: str) -> str:
    return strip(collapse(replace_all(e, "<[^>]+>", "' '")))


def chunks(e: str) -> str:
    parts = f"regexp_split_to_array({e}, {quote(LINE_BREAK + '|  ')})"
    return f"array_to_string(list_filter(list_transform({parts}, lambda x: {strip('x')}), lambda x: x <> ''), chr(10))"


def tidy(u: str) -> str:
    return replace_all(u, r"\A[\x{1}-\x{20}]+|[\t\n\r]")


def _host_and_port(u: str) -> str:
    authority = rf"\A(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
    return f"regexp_replace(regexp_extract({tidy(u)}, {quote(authority)}, 1), '\\A.*@', '')"


def host(u: str) -> str:
    pattern = r"\A(\[[^\]]*\]|[^:\[\]]*)"
    return f"translate(lower(regexp_extract({_host_and_port(u)}, {quote(pattern)}, 1)), '[]', '')"


def guard_host(u: str) -> str:
    return f"rtrim({strip(host(u))}, '.')"


def scheme(u: str) -> str:
    pattern = r"\A([a-zA-Z][a-zA-Z0-9+.-]*):"
    return f"lower(regexp_extract({tidy(u)}, {quote(pattern)}, 1))"


def raw_port(u: str) -> str:
    pattern = r"\A(?:\[[^\]]*\]|[^:\[\]]*):(.*)\z"
    return f"regexp_extract({_host_and_port(u)}, {quote(pattern)}, 1)"


def port(u: str) -> str:
    p, default = raw_port(u), f"CASE WHEN {scheme(u)} = 'https' THEN 443 ELSE 80 END"
    number = f"TRY_CAST({p} AS BIGINT)"
    return (
        f"CASE WHEN {p} = '' THEN {default} WHEN NOT regexp_full_match({p}, '[0-9]+') OR {number} IS NULL OR {number} > 65535"
        f" THEN NULL WHEN {number} = 0 THEN {default} ELSE {number} END"
    )


def one_of(e: str, values: list[str]) -> str:
    return f"({e} IN ({', '.join(quote(v) for v in values)}))"


def is_medium(h: str) -> str:
    return f"({one_of(h, C.MEDIUM_HOSTS)} OR ends_with({h}, '.medium.com'))"


def site_type(h: str) -> str:
    return (
        f"CASE WHEN {one_of(h, C.TWITTER_HOSTS)} THEN 'twitter' WHEN {is_medium(h)} THEN 'medium'"
        f" WHEN {one_of(h, C.JS_HOSTS)} THEN 'js-spa' ELSE 'general' END"
    )


def is_ipv4(ip: str) -> str:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return f"regexp_full_match({ip}, '{octet}[.]{octet}[.]{octet}[.]{octet}')"


def public_ipv4(ip: str) -> str:
    parts = [f"TRY_CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    number = f"((({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]})"

    def within(blocks: list[str]) -> str:
        nets = [ipaddress.ip_network(b) for b in blocks]
        return " OR ".join(f"{number} BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets)

    return f"(NOT ({within(C.IPV4_PRIVATE)}) OR ({within(C.IPV4_PUBLIC_EXCEPTIONS)}))"


def any_phrase(e: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, {quote(p)})" for p in phrases) + ")"


def js_wall(html: str) -> str:
    return any_phrase(f"lower(substr({html}, 1, 3000))", C.JS_WALL_SIGNALS)


def signals(text: str) -> str:
    head = f"lower(substr({text}, 1, 3000))"
    found = [f"CASE WHEN contains({head}, {quote(p)}) THEN {quote(p)} END" for p in C.ACCESS_RESTRICTION_SIGNALS]
    found += [f"CASE WHEN contains({head}, {quote(p)}) THEN {quote('paywall: ' + p)} END" for p in C.PAYWALL_SIGNALS]
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)[1:3]"


def newlines(e: str) -> str:
    return f"(length({e}) - length(replace({e}, chr(10), '')))"


def seconds(ms: str) -> str:
    """One decimal of the binary number nearest to ms / 1000."""
    return f"format('{{:.1f}}', {ms} / 1000.0::DOUBLE)"


def without(html: str, tags: list[str]) -> str:
    """The page with the given elements (neither nested nor unclosed in the tables) and comments
    replaced by an empty tag."""
    out = html
    for tag in sorted(tags, key=lambda t: t not in ("script", "style")):
        out = replace_all(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "'<x>'")
        if tag == "style":
            out = replace_all(out, r"(?s)<!--.*?-->", "'<x>'")
    return out


def unescape(e: str) -> str:
    out = f"replace(replace(replace({e}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
    return replace_all(out, r"&amp;?", "'&'")


def nodes_joined(html: str) -> str:
    """Text nodes, one per line; blank nodes shrink to one blank."""
    blank = r"'[ \t\n\f\r]+'"
    node = f"CASE WHEN regexp_full_match(x, {blank}) THEN CASE WHEN contains(x, chr(10)) THEN chr(10) ELSE ' ' END ELSE {unescape('x')} END"
    parts = f"list_filter(regexp_split_to_array({html}, '<[^>]*>'), lambda x: x <> '')"
    return f"array_to_string(list_transform({parts}, lambda x: {node}), chr(10))"


def stripped(html: str) -> str:
    return strip(collapse(nodes_joined(without(html, C.STRIPPED_DROP_TAGS))))


def article(html: str) -> str:
    """Text of article, main or body; null when there is none."""
    cleaned = without(html, C.ARTICLE_DROP_TAGS)

    def region(tag: str) -> str:
        return f"regexp_extract(h, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)(?:</{tag}\\s*>|\\z)', 1)"

    def has(tag: str) -> str:
        return f"regexp_matches(h, '(?i)<{tag}[\\s>]')"

    picked = " ".join(f"WHEN {has(t)} THEN {region(t)}" for t in ("article", "main", "body"))
    text = collapse(chunks(nodes_joined("r")))
    return f"(SELECT CASE WHEN r IS NULL THEN NULL ELSE {text} END FROM (SELECT CASE {picked} END AS r FROM (SELECT {cleaned} AS h)))"


def markdown(html: str) -> str:
    """Markdown of pages whose only inline emphasis is <b>, never closed before its article."""
    e = without(html, ["script", "style", "head"])
    e = replace_all(e, r"\A.*?<html", "'<html'")
    e = replace_all(e, r"[\t ]+", "' '")
    e = replace_all(e, r"([*_])", r"'\\\1'")
    # An open <b> ends with the article: its mark comes after the last text in it.
    bold = f"CAST((length({html}) - length(replace({html}, '<b>', ''))) // 3 AS INT)"
    e = f"regexp_replace({e}, '(?i)(?:</p>|<br>|[\\t \\n])*</article>', repeat('**', {bold}) || '</article>')"
    e = f"replace({e}, '<b>', '**')"
    for pattern, by in [
        (r"(?i)<br></article>", "'</article>'"), (r"(?i)[\t \n]+(</(?:h1|p|li|article)>)", r"'\1'"), (r"(?i)<br>", "'  ' || chr(10)"), (r"(?i)<h1>", "chr(10) || chr(10) || '# '"), (r"(?i)<li>", "'- '"),
        (r"(?i)</li>", "chr(10)"), (r"(?i)</?(?:p|ul|nav|div|article|footer|h1|body)(?:\s[^>]*)?>", "chr(10) || chr(10)"),
        ("<[^>]*>", "''"),
    ]:
        e = replace_all(e, pattern, by)
    return strip(collapse(unescape(e)))
