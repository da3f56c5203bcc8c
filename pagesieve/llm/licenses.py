"""License notices, exact and with errors (numbered operator 2)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from typing import NamedTuple

import numpy as np
import regex
from pyspark.sql import DataFrame

from pagesieve.llm.util import map_texts

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices in words, their labels, and how many characters may be wrong.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("licensed under the gnu general public license version", "gpl", 5),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("subject to the terms of the mozilla public license", "mpl", 5),
    ("licensed under a creative commons attribution", "cc-by", 4),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 7),
    ("this is free and unencumbered software released into the public domain", "unlicense", 7),
    ("all rights reserved", "reserved", 1),
)
CHUNK = 1 << 14  # places compared at a time
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BLANKED = bytes(b if _IN_WORD[b] else 32 for b in range(256))
_WORD = rb"[0-9a-z\x80-\xff]"
_BASE = re.compile(
    b"(?<!" + _WORD + b")(?:" + b"|".join(b"(" + (b"[^0-9a-z\\x80-\\xff]+").join(p.encode().split()) + b")" for p in PHRASES)
    + b")(?!" + _WORD + b")")
_BASE_LABELS = list(PHRASES.values())


class Hit(NamedTuple):
    label: str
    start: int  # of the match in the blank-joined words, in bytes
    end: int
    errors: int


class Line:
    """Words joined by blanks, with the places where words start and end."""

    def __init__(self, line: bytes):
        self.bytes = line
        self.codes = np.frombuffer(line, np.uint8)
        blank = np.concatenate(([True], self.codes == 32, [True]))
        self.starts = blank[:-1] & ~blank[1:]  # by place, the end of the line included
        self.ends = ~blank[:-1] & blank[1:]
        self.blanks = np.nonzero(blank[1:-1])[0]

    def word(self, at: int) -> int:
        """The number of the word that holds a place, from 0."""
        return int(np.searchsorted(self.blanks, at))


class Notice:
    """A notice with the pieces of which an occurrence with at most `errors` errors holds one exactly:
    that many errors cannot touch each of errors + 1 pieces."""

    def __init__(self, text: str, label: str, errors: int):
        self.text, self.label, self.errors = text.encode(), label, errors
        n = errors + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]
        self.patterns: dict[int, regex.Pattern] = {}

    def places(self, line: bytes) -> np.ndarray:
        """Where the notice would start if nothing were wrong before a seed found there."""
        found = set()
        for seed, offset in self.seeds:
            at = line.find(seed)
            while at >= 0:
                found.add(at - offset)
                at = line.find(seed, at + 1)
        return np.array(sorted(found), np.int64)

    def spans(self, line: Line, places: np.ndarray) -> np.ndarray:
        """start, end and errors of the best occurrence around each place, from word border to word
        border; only those within the errors allowed. An occurrence that holds a seed stays within
        `errors` diagonals of it, so a band of that width decides."""
        e, m, size = self.errors, len(self.text), len(line.bytes)
        width = 2 * e + 1
        far = (m + e + 1) * width
        at = places[:, None] + np.arange(-e, e + 1)
        begins = (at >= 0) & line.starts.take(at, mode="clip")
        # A cell is the number of errors times the width of the band, plus how far left of the band's
        # right end the occurrence starts; a step to the right is a character too many.
        wider = np.arange(width) * width
        cost = np.where(begins, np.arange(width)[::-1], far)
        cost = np.minimum.accumulate(cost - wider, axis=1) + wider
        for i, char in enumerate(self.text):
            new = cost + width * (line.codes.take(at + i, mode="clip") != char)
            np.minimum(new[:, :-1], cost[:, 1:] + width, out=new[:, :-1])  # a character is missing
            cost = np.minimum.accumulate(new - wider, axis=1) + wider
        end = at + m
        cost = np.where((end <= size) & line.ends.take(end, mode="clip"), cost, far)
        best = cost.argmin(axis=1)
        rows = np.arange(len(places))
        cost = cost[rows, best]
        start = places - e + (width - 1 - cost % width)
        out = np.stack((start, end[rows, best], cost // width), axis=1)
        return out[(cost < far) & (out[:, 2] <= e)]

    def verify(self, line: bytes, start: int, end: int, errors: int) -> Hit | None:
        pattern = self.patterns.get(errors)
        if pattern is None:
            pattern = self.patterns[errors] = regex.compile(b"(?:" + regex.escape(self.text) + b"){e<=%d}" % errors)
        m = pattern.fullmatch(line, start, end)
        return m and Hit(self.label, *m.span(), sum(m.fuzzy_counts))

    def search(self, line: Line) -> list[Hit]:
        """Occurrences from left to right; of two that overlap, the one with fewer errors, else the
        first."""
        places = self.places(line.bytes)
        if not len(places):
            return []
        parts = [self.spans(line, places[i:i + CHUNK]) for i in range(0, len(places), CHUNK)]
        spans: list[list[int]] = []
        for span in np.unique(np.concatenate(parts), axis=0).tolist():
            if not spans or span[0] >= spans[-1][1]:
                spans.append(span)
            elif span[2] < spans[-1][2]:
                spans[-1] = span
        return [hit for span in spans if (hit := self.verify(line.bytes, *span))]


def _similarity(notice: Notice, hit: Hit) -> float:
    return 1 - hit.errors / len(notice.text)


@cache
def compiled(notices: tuple) -> list[Notice]:
    """Compiled once per Python worker."""
    return [Notice(*n) for n in notices]


def scan(text: bytes, notices: tuple = NOTICES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of a UTF-8 text."""
    lower = text.lower()  # on bytes: A-Z
    inside = _IN_WORD[np.frombuffer(lower, np.uint8)]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    n_words = int(np.count_nonzero(starts))
    found = list(_BASE.finditer(lower)) if b"license" in lower else []
    base = sorted({_BASE_LABELS[m.lastindex - 1] for m in found})
    first = last = None
    if found:
        at = np.nonzero(starts)[0]
        first, last = (int(np.searchsorted(at, m.start())) for m in (found[0], found[-1]))
    line = Line(b" ".join(lower.translate(_BLANKED).split()))
    labels, spans, best = set(base), [], 1.0 if found else 0.0
    for notice in compiled(notices):
        for hit in notice.search(line):
            labels.add(hit.label)
            best = max(best, _similarity(notice, hit))
            spans.append({"label": hit.label, "first_word": line.word(hit.start), "last_word": line.word(hit.end - 1), "errors": hit.errors})
    return n_words, len(found), first, last, ",".join(base), ",".join(sorted(labels)), best, spans


def scan_licenses(docs: DataFrame, notices: Iterable[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans.

    A-Z are lower-cased; words are runs of digits, a-z and characters from U+0080. Base places are
    those where the words of a phrase stand one after the other. The notices (lower-case words, label, characters
    that may be wrong: fewer than the notice has) are searched in the words joined by blanks; an occurrence begins
    and ends with whole words. Seeds that must stand exactly give places, a banded edit distance at these the candidates, and bounded-error
    matching the errors; spans say where (words from 0). The work is linear in the text. score is 1 with a base place, else the best share of right characters, else 0. A
    null text is an empty one: no words, no labels, score 0. Repeated rows come back as
    often; other columns are not read.
    """
    notices = tuple(map(tuple, notices))

    def run(ids: list, texts: list[bytes]) -> list:
        return [ids, *map(list, zip(*(scan(t, notices) for t in texts)))]

    return map_texts(docs, run, (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,errors:int>>"))
