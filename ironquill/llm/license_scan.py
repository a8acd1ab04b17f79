"""Licence texts in documents: winnowed template fingerprints find candidates, banded alignment measures them.

A template's word runs are winnowed into an inverted index; a document's runs
are looked up in it. Hits of one template on nearby diagonals are one
candidate, and an alignment within a band around them reports how much of the
template is there, and where.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironquill.llm.license_texts import TEMPLATES
from ironquill.llm.shared import whole

GRAM, WINDOW = 3, 2
#: Share of the template's words that must be matched in order.
COVERAGE = 0.8
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
MATCH = "license string, coverage double, matched_words int, template_words int, start long, end long"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def band_of(length: int) -> int:
    """Words that may be left out or put in: a fifth, as the coverage allows no more to be missing."""
    return max(2, length // 5)


class TemplateIndex:
    """Winnowed word runs of the templates, and where each stands."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES, gram: int = GRAM, window: int = WINDOW):
        self.gram = gram
        self.words = {name: words(text) for name, text in templates.items()}
        self.places: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
        for name, ws in self.words.items():
            runs = [tuple(ws[i : i + gram]) for i in range(max(1, len(ws) - gram + 1))]
            order = [hash_of(r) for r in runs]
            chosen = {min(range(a, min(a + window, len(runs))), key=lambda i: (order[i], -i)) for a in range(max(1, len(runs) - window + 1))}
            for i in sorted(chosen):
                self.places[runs[i]].append((name, i))
        self.first = {r[0] for r in self.places}

    def hits(self, ws: list[str]) -> dict[str, list[tuple[int, int]]]:
        """(diagonal, place) of each template's runs in the document."""
        out: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, w in enumerate(ws):
            if w in self.first:
                for name, place in self.places.get(tuple(ws[at : at + self.gram]), ()):
                    out[name].append((at - place, at))
        return out


def hash_of(run: tuple[str, ...]) -> int:
    """A fixed hash, the same in every process."""
    out = 1469598103934665603
    for b in " ".join(run).encode():
        out = ((out ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return out


def align(template: list[str], ws: list[str], low: int, high: int) -> tuple[int, int, int]:
    """Most template words matched in order within diagonals low..high: (matched, first word, word after the last).

    Every template word is matched, left out or replaced; words of the
    document may be put in; of equally many matches the shortest span counts.
    """
    width = high - low + 1
    # Of each diagonal: matches, minus the words passed since the first match, and the first match's place.
    row: list[tuple[int, int, int]] = [(0, 0, -1)] * width
    best, span = (0, 0), (0, 0)
    for i, t in enumerate(template):
        new: list[tuple[int, int, int]] = []
        for d in range(width):
            j = i + low + d
            here = row[d]  # the template's word is replaced
            if d + 1 < width and row[d + 1] > here:
                here = row[d + 1]  # it is left out
            if 0 <= j < len(ws) and ws[j] == t:
                m, _, s = row[d]
                s = j if s < 0 else s
                hit = (m + 1, s - j, s)
                if hit > here:
                    here = hit
            if d and new[d - 1] > here:
                here = new[d - 1]  # a word of the document is put in
            new.append(here)
            if here[2] >= 0 and (here[0], here[1]) > best and 0 <= j < len(ws) and ws[j] == t and here[2] - j == here[1]:
                best, span = (here[0], here[1]), (here[2], j + 1)
        row = new
    return best[0], *span


def scan_words(index: TemplateIndex, ws: list[str], coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int, int]]:
    """(template, coverage, matched words, template words, first word, word after the last) of every match, in order."""
    found = []
    for name, hits in index.hits(ws).items():
        template, matches = index.words[name], []
        band = band_of(len(template))
        hits.sort()
        start = 0
        for n in range(1, len(hits) + 1):
            if n < len(hits) and hits[n][0] - hits[n - 1][0] <= band and hits[n][0] - hits[start][0] <= 4 * band:
                continue
            matched, a, b = align(template, ws, hits[start][0] - band, hits[n - 1][0] + band)
            if matched >= coverage * len(template):
                matches.append((name, matched / len(template), matched, len(template), a, b))
            start = n
        # Of a template's matches that overlap, the fullest.
        for m in sorted(matches, key=lambda m: (-m[2], m[5] - m[4], m[4])):
            if all(m[5] <= o[4] or m[4] >= o[5] for o in found if o[0] == name):
                found.append(m)
    return sorted(found, key=lambda m: (m[4], m[5], m[0]))


def licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and the columns of ``MATCH`` for every match in every row; positions are code points, the end exclusive.

    A null text matches nothing; rows that repeat give rows that repeat.
    """
    source = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        names = [c.split()[0] for c in MATCH.split(", ")]
        types = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            rows, of = [], []
            for n, text in enumerate(batch.column(1)):
                text = text.as_py()
                matches = scan_words(index, words(text), coverage)
                if not matches:
                    continue
                lowered = text.lower()
                spans = [m.span() for m in WORD.finditer(lowered)]
                back = None if len(lowered) == len(text) else _origins(text)
                for name, share, matched, total, a, b in matches:
                    start, end = spans[a][0], spans[b - 1][1]
                    if back is not None:
                        start, end = bisect_left(back, start + 1) - 1, bisect_left(back, end)
                    rows.append((name, share, matched, total, start, end))
                    of.append(n)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], ["_id", *names])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, {MATCH}")


def _origins(text: str) -> list[int]:
    """Where each character begins after lower-casing, which lengthens a few."""
    out, at = [], 0
    for c in text:
        out.append(at)
        at += len(c.lower())
    return out
