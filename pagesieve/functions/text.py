"""Text scalars with Unicode-aware whitespace, identical in Java regex and RE2 spelling."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from pagesieve import constants as C
from pagesieve.functions.common import let

# Every code point that counts as whitespace when stripping (as a pattern and as
# characters), and every line break.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
# A code point that no text may use stands for an opening without an end.
_NO_END = chr(0xFDD0)
LINE_BREAK = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Trim all Unicode whitespace; SQL `trim` only knows the space character by itself. Only
    the ends of the text are looked at, unlike with a pattern."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def strip_tags_regex(c: Column) -> Column:
    """Last-resort text: each tag becomes a space. Nothing after the last `>` can match, and is
    kept out of the search: there every `<` would be tried up to the end of the page."""
    tail = F.substring_index(c, ">", -1)
    tagged = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
    return strip(collapse_newlines(F.concat(F.regexp_replace(tagged, "<[^>]+>", " "), tail)))


def _without_end(c: Column, opening: str, closing: str) -> Column:
    """Mark each `opening` that no `closing` follows on its line, so that no pattern looks for one: of
    the parts between closings, the last has none after it, nor has what lies before a line's end."""
    marked = opening[0] + _NO_END + opening[1:]

    def mark(parts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            tail = F.when(i == F.size(parts) - 1, F.lit("")).otherwise(F.substring_index(p, "\n", -1))
            head = F.substring(p, F.lit(1), F.length(p) - F.length(tail))
            return F.concat(F.replace(head, F.lit(opening), F.lit(marked)), tail)

        return F.array_join(F.transform(parts, one), closing)

    return F.when(F.contains(c, F.lit(opening)), let(F.split(c, re.escape(closing), -1), mark)).otherwise(c)


def clean_markdown(c: Column) -> Column:
    """Drop images, unwrap links, collapse newlines; null gives an empty string. Time is linear:
    openings without an end are marked before, and all `[` before one `]` are read together."""
    text = F.coalesce(c, F.lit(""))
    images = _without_end(_without_end(text, "](", ")"), "![", "](")
    # (?d): only \n ends a line, so that `.` also crosses \r and the Unicode separators.
    no_images = F.replace(F.regexp_replace(images, r"(?d)!\[.*?\]\([^\n)]*+\)", ""), F.lit(_NO_END), F.lit(""))
    links = F.regexp_replace(_without_end(no_images, "](", ")"), r"\[([^\]]*+)\]\([^\n)]*+\)|(\[[^\]]*+\]?)", "$1$2")
    return strip(collapse_newlines(F.replace(links, F.lit(_NO_END), F.lit(""))))


def normalize_chunks(c: Column) -> Column:
    """Split into lines, lines into double-space phrases, trim, drop empties, one per line."""
    phrases = F.split(c, rf"{LINE_BREAK}|  ")
    return F.array_join(F.filter(F.transform(phrases, strip), lambda p: p != ""), "\n")


def char_count(c: Column) -> Column:
    return F.length(c).cast("bigint")


def newline_count(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("bigint")


def line_count(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return newline_count(text) + F.when(text == "", F.lit(0)).otherwise(F.lit(1)).cast("bigint")


def preview_lines(c: Column, n: int = C.PREVIEW_LINES) -> Column:
    """First `n` lines; a note tells how many newlines exceed `n`."""
    lines = F.split(F.regexp_replace(c, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK)
    head = F.array_join(F.slice(lines, 1, n), "\n")
    more = newline_count(c) - n
    note = F.concat(F.lit("\n\n... ("), more.cast("string"), F.lit(" more lines)"))
    return F.when(more > 0, F.concat(head, note)).otherwise(head)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def seconds_text(ms: Column) -> Column:
    """Milliseconds as seconds with one decimal, as the binary number nearest to ms / 1000 rounds.

    Only ms that end in 50 are in doubt: the nearest binary number lies above or below them, or is the
    same and goes to the even digit. Its last place is 2^(j - 52), with j the exponent, so the
    remainder of ms * 2^(52 - j) by 1000 tells which.
    """
    ms = ms.cast("bigint")
    exponent = F.floor(F.log2(F.greatest(ms, F.lit(1)) / 1000)).cast("int")
    power = F.get(F.array(*[F.lit(pow(2, k, 1000)) for k in range(64)]), 52 - exponent)
    rest = (ms % 1000) * power % 1000
    tenths, over = F.floor(ms / 100).cast("bigint"), ms % 100
    up = (over > 50) | ((over == 50) & ((rest > 500) | ((rest == 0) & (tenths % 2 == 1))))
    rounded = tenths + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))
