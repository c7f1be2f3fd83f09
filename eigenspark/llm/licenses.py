"""Search for license phrases and for short license notices with a few errors."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Phrases that are matched word by word, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices in lower-case words, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: One error for so many characters of a notice, and at most so many errors.
CHARS_AN_ERROR, MOST_ERRORS = 14, 6
JOINED = 8

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def errors(notice: str) -> int:
    return min(MOST_ERRORS, max(1, len(notice) // CHARS_AN_ERROR))


def pieces(notice: str) -> list[tuple[int, str]]:
    """errors + 1 parts of a notice and their places: with no more errors than allowed, one part is found unchanged."""
    n, parts = len(notice), errors(notice) + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Notices:
    """The seeds of all notices in one automaton, and a bounded-error pattern for each notice."""

    def __init__(self, notices=NOTICES):
        self.notices, self.seeds = notices, ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _) in enumerate(notices):
            for at, piece in pieces(notice):
                by_seed.setdefault(piece, []).append((k, at + len(piece)))
        for piece, uses in by_seed.items():
            self.seeds.add_word(piece, uses)
        if by_seed:
            self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n)}){{e<={errors(n)}}}") for n, _ in notices]

    def windows(self, text: str):
        """(notice, first, last) of the stretches where a seed allows the notice; overlapping ones are joined up to JOINED
        notices' lengths, so that matching stays linear; each seed's own stretch lies in one of them."""
        found: dict[int, list[list[int]]] = {}
        for last, uses in self.seeds.iter(text) if len(self.seeds) else ():
            for k, end in uses:
                notice = self.notices[k][0]
                e = errors(notice)
                a, b = max(0, last + 1 - end - e), min(len(text), last + 1 - end + len(notice) + e)
                own = found.setdefault(k, [])
                if own and a <= own[-1][1] and b - own[-1][0] <= JOINED * len(notice):
                    own[-1][1] = max(own[-1][1], b)
                    own[-1][0] = min(own[-1][0], a)
                else:
                    own.append([a, b])
        return [(k, a, b) for k, own in found.items() for a, b in own]

    def within(self, k: int, text: str, first: int, last: int):
        """The best match of a notice in a stretch, then those before and after it in the same way."""
        todo = [(first, last)]
        while todo:
            a, b = todo.pop()
            m = self.patterns[k].search(text, a, b)
            if m and m.end() > m.start():
                yield m
                todo += [(a, m.start()), (m.end(), b)]

    def verified(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, first, last, errors) of each place of each notice; the library's matching verifies the errors."""
        return [(k, m.start(), m.end(), sum(m.fuzzy_counts)) for k, a, b in self.windows(text) for m in self.within(k, text, a, b)]

    def matches(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first, last, errors, similarity) of each notice found: the closest first, and then what overlaps none that is
        taken; of equally close ones the longer, then the later label by name, then the earlier place."""
        out = [(self.notices[k][1], a, b, e, 1 - e / len(self.notices[k][0])) for k, a, b, e in self.verified(text)]
        out.sort(key=lambda x: x[1])
        kept: list = []  # by place
        for x in sorted(out, key=lambda x: (x[4], x[2] - x[1], x[0]), reverse=True):
            at = bisect_left(kept, x[1], key=lambda y: y[1])
            if (at == len(kept) or x[2] <= kept[at][1]) and (at == 0 or kept[at - 1][2] <= x[1]):
                kept.insert(at, x)
        return kept


@lru_cache(1)
def _notices() -> Notices:
    return Notices()


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lowered, in UTF-8."""
    return (text or "").encode().translate(_TO_WORDS).split()


def base_places(joined: str) -> list[tuple[int, str]]:
    """(place in the joined words, label) of every place where a base phrase stands; words are joined by one space."""
    out = []
    for phrase, label in BASE.items():
        at = joined.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = joined.find(f" {phrase} ", at + 1)
    return sorted(out)


def scan_text(text: str | None) -> tuple:
    words = words_of(text)
    joined = b" ".join([b"", *words, b""]).decode()
    base, fuzzy = base_places(joined), _notices().matches(joined)
    starts, word, seen = [], 0, 0
    for at, _ in base:
        word += joined.count(" ", seen, at)
        seen = at
        starts.append(word)
    spans, word, seen = [], 0, 0
    for label, a, b, edits, likeness in fuzzy:
        word += joined.count(" ", seen, a)
        seen = a
        first = word if joined[a : a + 1] == " " else max(0, word - 1)
        inner = joined[a:b].strip()
        spans.append({"label": label, "first_word": first, "n_words": inner.count(" ") + 1, "errors": edits, "found": inner})
    base_labels = sorted({x for _, x in base})
    labels = sorted({*base_labels, *(x[0] for x in fuzzy)})
    score = 1.0 if base else max((x[4] for x in fuzzy), default=0.0)
    return len(words), len(base), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base_labels), ",".join(labels), score, spans


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32()), ("found", pa.string())])
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN))
_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def scanned(docs: DataFrame) -> DataFrame:
    """Base phrases and fuzzy notices of every whole text.

    spans: label, first word, number of words, errors and the words found, for each notice with up to one error in
    CHARS_AN_ERROR characters; of overlapping ones the closest, then the longer, then the later label by name.  score: 1
    with a base phrase, else the likeness of the closest notice, else 0.  Null and empty texts have no words, null first_word
    and last_word, and no labels.  Texts are searched whole, however long.  Rows don't influence each other, so repeated
    rows and ids and null ids don't matter, nor do other columns.  An empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            cols = list(zip(*(scan_text(t) for t in b.column(1).to_pylist()), strict=True)) or [[] for _ in _TYPES]
            yield pa.record_batch([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, _TYPES, strict=True))], ["doc_id", *_NAMES])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,errors:int,found:string>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
