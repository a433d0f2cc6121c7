"""Licence scans: fuzzy search for short notices.

A text is folded to words of ASCII letters and digits and all other characters,
A-Z in lower case, joined by single spaces.  A notice may differ from its wording
by a few edits.  It is split into one piece more than that, so that one piece at
least is there unchanged (pigeonhole): an automaton finds the pieces of all
notices in one pass, and in the short stretch about each place the regex
library's bounded-error matching verifies the edits and reports the span.  A
notice without edits is one piece.  Of matches of one notice that overlap, the
one with the fewest edits stays, then the first.  The work grows with the
text's length and its places, however many there are.

Null text is an empty text: no words, no labels, score 0.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_udf

#: Exact phrases (label, words): the base labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
# Short licence notices (label, words, words that must be there unchanged); the rest may differ by one edit in
# EDIT_EVERY characters.
NOTICES = (
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ""),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", ""),
    ("mit", "spdx license identifier mit", "identifier mit"),
    ("apache-2", "licensed under the apache license version 2 0", "2"),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance"),
    ("apache-2", "spdx license identifier apache 2 0", "apache 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("bsd", "redistributions of source code must retain the above copyright notice", ""),
    ("bsd", "use of this source code is governed by a bsd style license", "bsd"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("gpl", "licensed under the gnu general public license version", "gnu general"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general"),
    ("gpl", "you should have received a copy of the gnu general public license", "gnu general"),
    ("lgpl", "licensed under the gnu lesser general public license version", "lesser general"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general"),
    ("agpl", "licensed under the gnu affero general public license version", "affero general"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "affero general"),
    ("gfdl", "under the terms of the gnu free documentation license version", "free documentation"),
    ("mpl-2", "subject to the terms of the mozilla public license", "mozilla"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse"),
    ("eupl", "licensed under the european union public licence", "european"),
    ("artistic", "licensed under the terms of the artistic license", "artistic"),
    ("boost", "distributed under the boost software license version 1 0", "boost"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
    ("wtfpl", "do what the fuck you want to public license", ""),
    ("public-domain", "this work is dedicated to the public domain", "public domain"),
    ("cc0", "released under the creative commons zero license", "zero"),
    ("cc-by", "licensed under the creative commons attribution license", "attribution license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "attribution 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa"),
    ("cc-by-sa", "available under the creative commons attribution sharealike license", "sharealike"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial license", "noncommercial license"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "nd"),
    ("ofl", "licensed under the sil open font license version 1 1", "font"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", "no part"),
)
#: A table of notices may have so many rows; beyond, it is refused.
MAX_NOTICES = 5000
EDIT_EVERY, MAX_EDITS, WORD = 12, 5, 64

SCHEMA = ("n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,"
          "spans:array<string>")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Notice:
    """A wording, its pieces (text, where they start) and the pattern that verifies it."""

    def __init__(self, label: str, words: str, fixed: str, edits: int):
        self.fixed = fixed.encode()
        self.label, self.length, self.edits = label, len(words), edits
        cuts = [len(words) * k // (edits + 1) for k in range(edits + 2)]
        self.pieces = [(words[a:b], a) for a, b in zip(cuts, cuts[1:])]
        self.letters = [(c.encode(), n) for c, n in Counter(words).most_common()]
        self.pattern = regex.compile(b"(?b)(?:" + regex.escape(words).encode() + b"){e<=" + str(edits).encode() + b"}")

    def could_be(self, stretch: bytes) -> bool:
        """Whether the stretch has the notice's letters, but for as many as there may be edits."""
        short = 0
        for letter, n in self.letters:
            short += max(0, n - stretch.count(letter))
            if short > self.edits:
                return False
        return True

    def holds(self, found: bytes) -> bool:
        """Whether the words that must be there stand among those of a match."""
        return not self.fixed or b" %s " % self.fixed in b" %s " % found.strip()

    def match(self, text: bytes, start: int, seen: dict) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best match in the stretch where the notice could be if it began at ``start``, give or take the edits.

        ``seen`` holds what stretches with the same words gave."""
        a, b = max(0, start - self.edits), min(len(text), start + self.length + self.edits)
        # the match is judged by whole words (of up to WORD bytes): it may end inside the word that it is about
        first = max(0, a - WORD, text.rfind(b" ", max(0, a - WORD), a + 1))
        last = text.find(b" ", b - 1, b + WORD)
        stretch, shift = text[first:last if last >= 0 else b + WORD], a - first
        key = stretch, shift, b - a
        if key not in seen:
            m = self.pattern.search(stretch, shift, shift + b - a) if self.could_be(stretch[shift:shift + b - a]) else None
            if m:
                left, right = stretch.rfind(b" ", 0, m.start() + 1) + 1, stretch.find(b" ", m.end() - 1)
                m = (m.start(), m.end(), sum(m.fuzzy_counts)) if self.holds(stretch[left:right if right >= 0 else len(stretch)]) else None
            seen[key] = m
        m = seen[key]
        return m and (a - shift + m[0], a - shift + m[1], m[2])


class Scanner:
    """Notices, and an automaton that finds the pieces of all of them in one pass."""

    def __init__(self, notices):
        import ahocorasick

        self.notices = [Notice(label, words, fixed, min(MAX_EDITS, len(words) // EDIT_EVERY)) for label, words, fixed in notices]
        held: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            for piece, offset in notice.pieces:
                held.setdefault(piece, []).append((k, offset + len(piece) - 1))
        self.seeds = ahocorasick.Automaton()
        for piece, places in held.items():
            self.seeds.add_word(piece, places)
        if held:
            self.seeds.make_automaton()

    def spans(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of the matches in a folded text, in bytes; of overlapping ones of a notice the best stays."""
        starts: set[tuple[int, int]] = set()
        if len(self.seeds):
            for end, places in self.seeds.iter(text.decode("latin-1")):  # a letter a byte
                starts.update([(k, end - back) for k, back in places])
        seen: list[dict] = [{} for _ in self.notices]
        found = {(k, *m) for k, start in starts if (m := self.notices[k].match(text, start, seen[k]))}
        out: list[tuple[int, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for k, a, b, edits in sorted(found, key=lambda s: (s[0], s[3], s[1], s[2])):
            held = taken.setdefault(k, [])
            at = bisect.bisect(held, (a, b))
            if (at == 0 or held[at - 1][1] <= a) and (at == len(held) or b <= held[at][0]):
                held.insert(at, (a, b))
                out.append((k, a, b, edits))
        return sorted(out, key=lambda s: (s[1], s[0]))


def scan(text: str | None, scanner: Scanner) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    folded = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for label, phrase in PHRASES:
        piece = b" " + phrase.encode() + b" "
        at = folded.find(piece)
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = folded.find(piece, at + 1)
    matches = scanner.spans(folded)
    labels, spans, places, score = set(base), [], [], 1.0 if base else 0.0
    if starts or matches:
        spaces = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
        places = np.searchsorted(spaces, starts).tolist()
    for k, a, b, edits in matches:
        notice = scanner.notices[k]
        first = max(0, int(np.searchsorted(spaces, a, "right")) - 1)
        end = int(np.searchsorted(spaces, b - (folded[b - 1:b] == b" ")))
        labels.add(notice.label)
        score = max(score, 1.0 - edits / notice.length)
        spans.append(f"{notice.label}:{first}:{end}:{edits}")
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, spans)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: DataFrame | None = None) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row; spans are ``label:first word:end word:edits``.

    ``notices`` (label, words, fixed; MAX_NOTICES rows at most) takes the place of NOTICES: its words are folded
    like the texts, rows without words or label are left out."""
    return docs.select(F.col(doc_id).alias("doc_id"), licenses(F.col(text), notices).alias("l")).select("doc_id", "l.*")


def licenses(text: Column, notices: DataFrame | None = None) -> Column:
    wanted = NOTICES
    if notices is not None:
        rows = notices.select("label", "words", "fixed").where("label is not null").limit(MAX_NOTICES + 1).collect()
        if len(rows) > MAX_NOTICES:
            raise ValueError(f"more than {MAX_NOTICES} notices")
        wanted = tuple((label, folded, fold(fixed)) for label, words, fixed in rows if (folded := fold(words)))
    return text_udf(SCHEMA, scan, lambda: _scanner(wanted))(text)


def fold(text: str | None) -> str:
    """Words in lower case between single spaces; notices are ASCII, so other letters are spaces there."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    return " ".join("".join(chr(b) if b < 128 else " " for b in raw).split())


_scanners: dict[tuple, Scanner] = {}


def _scanner(notices: tuple) -> Scanner:
    if notices not in _scanners:
        _scanners.clear()
        _scanners[notices] = Scanner(notices)
    return _scanners[notices]
