"""Content gates. Prefixes are cut before lower-casing so that long pages stay cheap."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagesieve import constants as C
from pagesieve.functions.common import let


def _any_phrase(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | text.contains(phrase)
    return out


def has_js_wall(html: Column) -> Column:
    return _any_phrase(F.lower(F.substring(html, 1, C.SIGNAL_PREFIX_CHARS)), C.JS_WALL_SIGNALS)


def is_js_skeleton(html: Column, text: Column) -> Column:
    """A large page with next to no text, or a single-page-app shell with little of it."""
    chars, shell = F.length(text), F.lower(F.substring(html, 1, C.SPA_PREFIX_CHARS))
    thin = chars / F.greatest(F.length(html), F.lit(1)) < C.SKELETON_RATIO
    spa = _any_phrase(shell, C.SPA_MARKERS) & (chars < C.SKELETON_TEXT)
    return (F.length(html) >= C.SKELETON_MIN_HTML) & (thin | spa)


def access_restriction(text: Column) -> Column:
    """struct(flag, signals): the first three matching phrases, login before paywall."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, C.SIGNAL_PREFIX_CHARS))
    access, paywall = F.lit(C.ACCESS_RESTRICTION_SIGNALS), F.lit(C.PAYWALL_SIGNALS)

    def matches(lowered: Column) -> Column:
        walls = F.transform(F.filter(paywall, lowered.contains), lambda p: F.concat(F.lit("paywall: "), p))
        return F.slice(F.concat(F.filter(access, lowered.contains), walls), 1, C.MAX_SIGNALS)

    return let(let(head, matches), lambda found: F.struct((F.size(found) > 0).alias("flag"), found.alias("signals")))


def passes_response_gate(status: Column, html: Column) -> Column:
    """The HTTP tier's checks, cheapest first."""
    return (status == 200) & (F.length(html) > C.MIN_RESPONSE_CHARS) & ~has_js_wall(html)


def passes_page_gate(tier: Column, status: Column, html: Column) -> Column:
    """What each tier asks of a page before extraction: the HTTP tier status, size and no script
    wall, the browser tiers only no script wall, the last one also some html."""
    no_wall = ~has_js_wall(html)
    return (
        F.when(tier == "tier1_curl", passes_response_gate(status, html))
        .when(tier == "tier2_camoufox", no_wall)
        .when(tier == "tier3_nodriver", no_wall & (html != ""))
        .otherwise(F.lit(True)) & html.isNotNull()
    )


def passes_min_length(source: Column, text: Column) -> Column:
    """Each source's own minimum; a source without one keeps every text."""
    keep = F.when(F.lit(False), F.lit(False))
    for name, bounds in C.SOURCE_MIN_CHARS.items():
        keep = keep.when(source == name, F.length(text) > max(bounds))
    return keep.otherwise(F.lit(True)) & text.isNotNull()


def is_sparse(chars: Column) -> Column:
    return chars < C.SPARSE_CHARS


def sparse_warning(chars: Column) -> Column:
    note = F.concat(
        F.lit("Sparse content extracted ("), chars.cast("string"), F.lit(f" chars < {C.SPARSE_CHARS})")
    )
    return F.when(is_sparse(chars), note)


def ocr_text_gate(text: Column) -> Column:
    return F.when(F.length(text) >= C.OCR_MIN_CHARS, text)


def vision_text_gate(text: Column) -> Column:
    return F.when(F.length(text) > C.OCR_MIN_CHARS, text)
