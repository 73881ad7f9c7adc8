"""Licences named in texts: exact phrases, and short notices with a bounded number of edits.

Texts are brought to their words (A-Z in lower case) with one space between them. Base phrases are runs of whole words. A notice may have
`len * RATE` edits (a byte put in, left out or changed). By the pigeonhole principle a notice cut into one piece more than it may have edits
has a piece without any, so an automaton over all pieces finds every place where a notice can stand; pieces that lie alike within
twice the edits share one window. A window that holds the notice letter for letter is done; else the regex library searches it for the match with the
fewest edits. Where matches of different labels overlap, those with the fewest edits stay.

Defined cases: null and empty texts have no words; repeated rows get a row each; ids of any type are passed through. An empty
table gives no rows. Columns other than the id and the text are passed over. A character beyond ASCII counts as its bytes. One text is
never divided; a window is no longer than its notice and four times its edits, however long or repetitive the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm import bytewords as bw

#: Phrases of whole words and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices by label, as words of the scan.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "either version 3 of the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
)
RATE = 0.08
_LABELLED = "array<struct<label:string,notice:int,start:long,end:long,first_word:long,last_word:long,edits:int>>"
_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices " + _LABELLED
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces that make up the notice."""
    cut = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


@dataclass
class Scanner:
    notices: tuple = NOTICES
    rate: float = RATE

    def __post_init__(self):
        self.edits = [int(len(text) * self.rate) for _, text in self.notices]
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={e}}}") for (_, text), e in zip(self.notices, self.edits, strict=True)]
        seeds: dict[str, list] = {}
        for i, ((_, text), e) in enumerate(zip(self.notices, self.edits, strict=True)):
            for at, piece in pieces(text, e):
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, own in seeds.items():
            self.seeds.add_word(piece, (len(piece), own))
        if seeds:
            self.seeds.make_automaton()

    def places(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of the best match in each window of `text`, whose lines are searched apart."""
        begins: dict[int, set] = {}
        for last, (n, own) in self.seeds.iter(text) if len(self.seeds) else ():
            for i, at in own:
                begins.setdefault(i, set()).add(last + 1 - n - at)
        found = set()
        for i, where in begins.items():
            notice, e, until = self.notices[i][1], self.edits[i], None
            for at in sorted(where):
                if at >= 0 and text.startswith(notice, at):
                    found.add((i, at, at + len(notice), 0))
                    continue
                if until is not None and at <= until:
                    continue
                until = at + 2 * e
                found |= self._within(text, i, max(0, at - e), min(len(text), until + len(notice) + e))
        return sorted(found)

    def _within(self, text: str, i: int, lo: int, hi: int) -> set:
        """The best match within each line of the window."""
        out = set()
        while lo < hi:
            end = text.find("\n", lo, hi)
            end = hi if end < 0 else end
            m = self.fuzzy[i].search(text, lo, end)
            if m:
                out.add((i, m.start(), m.end(), sum(m.fuzzy_counts)))
            lo = end + 1
        return out

    def best(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Without matches that overlap a match of another label with fewer edits; of one notice's overlapping matches those with the fewest."""
        out, group, reach = [], [], -1
        for m in [*sorted(found, key=lambda m: m[1:]), (-1, 1 << 62, 1 << 62, 0)]:
            if m[1] >= reach and group:
                for x in group:
                    label = self.notices[x[0]][0]
                    beaten = any(y[3] < x[3] and y[1] < x[2] and x[1] < y[2] and (y[0] == x[0] or self.notices[y[0]][0] != label) for y in group)
                    if not beaten:
                        out.append(x)
                group = []
            group.append(m)
            reach = max(reach, m[2])
        return out


def line_text(w: bw.Words) -> tuple[str, np.ndarray]:
    """Words of all texts with a space behind each, or a line end behind the last of a text; and where each begins."""
    raw, length = w.data[:-8], w.end - w.start
    begin = np.cumsum(length + 1) - length - 1
    out = np.full(int((length + 1).sum()), 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[begin + length] = False
    out[letters] = raw[bw.ALNUM[raw]]
    last = w.first[1:][np.diff(w.first) > 0] - 1
    out[begin[last] + length[last]] = 10
    return out.tobytes().decode("latin-1"), begin


def base_places(w: bw.Words) -> list[tuple[int, int]]:
    """(word, phrase) where a base phrase's words stand within one text; the phrases' words are of eight bytes at most, so hash and length tell them."""
    h, length, out = w.hashes(), w.end - w.start, []
    for i, (phrase, _) in enumerate(BASE):
        own = phrase.split()
        raw = np.frombuffer(" ".join(own).encode(), np.uint8)
        one = bw.words(raw, np.array([0, len(raw)]), bw.ALNUM)
        hit = w.doc[: max(0, len(h) - len(own) + 1)] == w.doc[len(own) - 1 :]
        for k, (x, n) in enumerate(zip(one.hashes(), one.end - one.start, strict=True)):
            hit &= (h[k : len(h) - len(own) + 1 + k] == x) & (length[k : len(h) - len(own) + 1 + k] == n)
        out += [(int(at), i) for at in np.flatnonzero(hit)]
    return sorted(out)


def scan_licenses(documents: DataFrame, notices: tuple = NOTICES, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the notices found.

    Notices have their span in bytes of the text and in words. The score is 1 for a base phrase, else 1 - edits / (allowed edits + 1) of the best
    notice, else 0. `rate` stays below an eighth, so that pieces have some length.
    """
    if not 0 <= rate < 0.125 or any(label == "" or "," in label or text.split() != text.split(" ") or not text for label, text in notices):
        raise ValueError("a rate below 0.125, labels without commas and notices of words with one space between them are needed")
    if any(bw.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), bw.ALNUM).texts != 1 or text != text.lower() or not text.isascii() for _, text in notices):
        raise ValueError("notices are of lower-case ASCII words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, rate)
        for batch in batches:
            for lo, hi, data, offsets in bw.slices(batch.column("text")):
                w = bw.words(data, offsets, bw.ALNUM)
                base: list[list] = [[] for _ in range(hi - lo)]
                for at, i in base_places(w):
                    base[w.doc[at]].append((at - int(w.first[w.doc[at]]), BASE[i][1]))
                text, begin = line_text(w)
                found: list[list] = [[] for _ in range(hi - lo)]
                for i, a, b, edits in scanner.best(scanner.places(text)):
                    first, last = np.searchsorted(begin, [a, b - 1], "right") - 1
                    d = w.doc[first]
                    found[d].append({
                        "label": notices[i][0], "notice": i, "start": int(w.start[first] - offsets[d]), "end": int(w.end[last] - offsets[d]),
                        "first_word": int(first - w.first[d]), "last_word": int(last - w.first[d]), "edits": edits,
                    })
                labels = lambda x: ",".join(sorted(set(x)))
                best = [1.0 if b else max((1 - m["edits"] / (scanner.edits[m["notice"]] + 1) for m in f), default=0.0) for b, f in zip(base, found, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(w.first).astype(np.int64)), pa.array([len(b) for b in base], pa.int64()),
                    pa.array([b[0][0] if b else None for b in base], pa.int64()), pa.array([b[-1][0] if b else None for b in base], pa.int64()),
                    pa.array([labels(x for _, x in b) for b in base], pa.string()),
                    pa.array([labels([x for _, x in b] + [m["label"] for m in f]) for b, f in zip(base, found, strict=True)], pa.string()),
                    pa.array(best, pa.float64()), pa.array(found, _MATCH),
                ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"])

    frame = documents.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return bw.arrow(frame, run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, {_FOUND}")
