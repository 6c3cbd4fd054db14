"""Fuzzy search for short license notices.

A notice that may hold k errors is cut into k + 1 seeds; by the pigeonhole principle one of them stands
unchanged in any text within k edits, so exact search for the seeds finds all candidates. The regex
library then matches the notice with at most k errors around each candidate and gives span and edits. Of places
that overlap the one with the fewest edits counts, and what it leaves free is searched again until nothing is found.
Exact phrases (the base) are counted on whole words.

Texts are compared in lower case (A-Z only), as words of letters, digits and non-ASCII characters joined by
single spaces. Defined results: null and empty texts have no words and a score of 0; repeated rows and null
ids give a row each; other columns are ignored; overlapping places of different notices all count.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices

BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
#: Notice, label, errors allowed.
NOTICES = [
    (b"released under the mit license", "mit", 3),
    (b"licensed under the apache license version 2 0", "apache", 4),
    (b"licensed under the gnu general public license", "gpl", 4),
    (b"gnu lesser general public license", "lgpl", 3),
    (b"gnu affero general public license", "agpl", 3),
    (b"redistribution and use in source and binary forms", "bsd", 4),
    (b"mozilla public license version 2 0", "mpl", 3),
    (b"permission is hereby granted free of charge to any person", "mit", 5),
    (b"licensed under cc by nc", "cc-by-nc", 1),
    (b"licensed under cc by sa", "cc-by-sa", 1),
    (b"creative commons attribution", "cc-by", 2),
    (b"this is free and unencumbered software released into the public domain", "unlicense", 6),
    (b"all rights reserved", "proprietary", 1),
]
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Scanner:
    """Seeds and patterns of the notices."""

    def __init__(self, notices: list[tuple[bytes, str, int]] = NOTICES):
        self.notices, self.seeds, self.patterns = notices, {}, []
        for k, (notice, _, errors) in enumerate(notices):
            bounds = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                self.seeds.setdefault(notice[a:b], []).append((k, a))
            self.patterns.append(regex.compile(rb"(?b)(?:" + regex.escape(notice) + rb"){e<=%d}" % errors))

    def find(self, plain: bytes) -> list[tuple[int, int, int, int]]:
        """Number of the notice, start and end in plain, edits; the best places, which don't overlap for a notice."""
        near: dict[int, list[int]] = {}
        for seed, of in self.seeds.items():
            at = plain.find(seed)
            while at >= 0:
                for k, offset in of:
                    near.setdefault(k, []).append(at - offset)
                at = plain.find(seed, at + 1)
        out = []
        for k, starts in near.items():
            out += [(k, *place) for place in self.places(k, plain, starts)]
        return out

    def places(self, k: int, plain: bytes, starts: list[int]) -> list[tuple[int, int, int]]:
        """Start, end and edits of all places of a notice near these starts."""
        notice, _, errors = self.notices[k]
        windows = {(max(0, s - errors), min(s + len(notice) + errors, len(plain))) for s in starts}
        chosen: list[tuple[int, int, int]] = []  # in text order
        while windows:
            found, left = set(), set()
            for window in windows:
                for lo, hi in free(*window, chosen):
                    if hi - lo >= len(notice) - errors and (m := self.patterns[k].search(plain, lo, hi)):
                        found.add((sum(m.fuzzy_counts), m.start(), m.end()))
                        left.add((lo, hi))
            for edits, start, end in sorted(found):
                if list(free(start, end, chosen)) == [(start, end)]:
                    insort(chosen, (start, end, edits))
            windows = left
        return chosen


def free(lo: int, hi: int, chosen: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches from lo to hi outside the chosen places."""
    at = max(bisect(chosen, (lo,)) - 1, 0)
    while at < len(chosen) and chosen[at][0] < hi:
        start, end, _ = chosen[at]
        if end > lo:
            if start > lo:
                yield lo, start
            lo = end
        at += 1
    if lo < hi:
        yield lo, hi


def base_places(found: list[bytes]) -> list[tuple[int, str]]:
    """First word and label of each place where a base phrase stands."""
    out = []
    for phrase, label in BASE.items():
        parts = phrase.split()
        n = len(parts)
        at = -1
        while True:
            try:
                at = found.index(parts[0], at + 1)
            except ValueError:
                break
            if found[at : at + n] == parts:
                out.append((at, label))
    return out


def examine(text: str, scanner: Scanner) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int, int]]]:
    """Number of words, base places, fuzzy places (in characters of the plain text's bytes)."""
    found = words(text)
    plain = b" ".join(found)
    base = base_places(found) if b"license" in plain and any(p in plain for p in BASE) else []
    return len(found), base, scanner.find(plain)


DIGEST = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,edits:int>>"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    kinds.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])))
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in slices(texts):
            rows = []
            for text in texts.slice(lo, hi - lo).to_pylist():
                n, base, fuzzy = examine(text or "", scanner)
                own = {x for _, x in base}
                labels = own | {scanner.notices[k][1] for k, *_ in fuzzy}
                score = max([1.0 if base else 0.0, *(1 - e / len(scanner.notices[k][0]) for k, _, _, e in fuzzy)])
                at = [x for x, _ in base]
                spans = [{"label": scanner.notices[k][1], "start": s, "end": e, "edits": d} for k, s, e, d in sorted(fuzzy, key=lambda x: x[1:])]
                rows.append((n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score, spans))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], [x.split()[0] for x in DIGEST.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the fuzzy spans of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, DIGEST)
