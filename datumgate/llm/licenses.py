"""License scan: exact phrases, and short notices with a bounded number of edits.

A notice that may hold ``k`` edits is cut into ``k + 1`` pieces; by the pigeonhole
principle one piece stands unchanged in every copy, so an Aho-Corasick automaton
of all pieces finds every candidate place, and the regex library's bounded-error
matching verifies it and gives the span.

Defined results: a null text counts as empty; a text without words has no
spans; equal spans of one label count once; of overlapping spans of a label the one
with fewest edits stays, then the first; repeated rows are scanned alike.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tidy

# Phrases that are looked for word by word, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int


NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("free software foundation", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("licensed under the apache license", "apache", 3),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("all rights reserved", "proprietary", 2),
)


def _word_table() -> bytes:
    """A-Z lower-cased; any other ASCII byte than a letter or digit is a space."""
    table = bytearray(range(256))
    for b in range(0x80):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(table)


WORD_TABLE = _word_table()


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """``edits + 1`` parts of about equal length, with their starts."""
    parts, size = notice.edits + 1, len(notice.text)
    cuts = [size * k // parts for k in range(parts + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(notices):
            for start, piece in pieces(notice):
                seeds.setdefault(piece, []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def spans(self, joined: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, similarity) in ``joined``, the words with single spaces."""
        windows: dict[int, set[tuple[int, int]]] = {}
        for last, (length, uses) in self.automaton.iter(joined):
            for number, start in uses:
                notice = self.notices[number]
                first = last + 1 - length - start
                low, high = max(0, first - notice.edits), min(len(joined), first + len(notice.text) + notice.edits)
                windows.setdefault(number, set()).add((low, high))
        found: dict[str, list[tuple[int, int, int, int, float]]] = {}
        for number, spots in windows.items():
            notice = self.notices[number]
            # Each window is verified alone, so that a text full of notices costs no more than its windows.
            for low, high in sorted(spots):
                m = self.patterns[number].search(joined, low, high)
                if m is None:
                    continue
                edits = sum(m.fuzzy_counts)
                start, end = m.span()
                while start < end and joined[start] == " ":
                    start += 1
                while end > start and joined[end - 1] == " ":
                    end -= 1
                found.setdefault(notice.label, []).append((edits, start, end, number, 1 - edits / len(notice.text)))
        out = []
        for label, spans in found.items():
            taken: list[tuple[int, int]] = []  # ordered and apart from each other
            for edits, start, end, _, similarity in sorted(spans):
                at = bisect_left(taken, (start, end))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (start, end))
                    out.append((start, end, label, edits, similarity))
        return sorted(out)


@lru_cache(maxsize=4)
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def base_places(padded: bytes) -> list[tuple[int, str]]:
    """(word number, label) of each place of a fixed phrase in space-padded words."""
    found = []
    for phrase, label in PHRASES:
        needle = b" " + phrase.encode() + b" "
        at, before, words = padded.find(needle), 0, 0
        while at >= 0:
            words, before = words + padded.count(b" ", before, at), at
            found.append((words, label))
            at = padded.find(needle, at + 1)
    return sorted(found)


def scan_text(text: str | None, scanner: Scanner) -> dict:
    words = (text or "").encode().translate(WORD_TABLE).split()
    padded = b" " + b" ".join(words) + b" "
    base = base_places(padded)
    joined = padded.decode()
    found = scanner.spans(joined)
    spaces = [i for i, c in enumerate(joined) if c == " "] if found else []
    spans = [
        {
            "label": label,
            "start_word": bisect_left(spaces, start) - 1,
            "end_word": bisect_left(spaces, end),
            "edits": edits,
            "similarity": similarity,
        }
        for start, end, label, edits, similarity in found
    ]
    labels = {label for _, label in base}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
        "score": 1.0 if base else max((s["similarity"] for s in spans), default=0.0),
        "spans": spans,
    }


FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start_word: long, end_word: long, edits: int, similarity: double>>"
)


def scan_licenses(
    docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, word count, exact places, labels, fuzzy spans (in words)."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(
        pa.struct(
            [("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]
        )
    )

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(notices)
        for batch in batches:
            rows = [scan_text(t.as_py(), scanner) for t in batch.column(1)]
            schema = pa.schema(
                [batch.schema.field(0)]
                + [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
                + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", spans)]
            )
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc_id {kind}, {FOUND}")
