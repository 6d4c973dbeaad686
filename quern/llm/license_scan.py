"""License scans: short notices, found with a bounded number of edits.

A notice of n letters may have k = min(4, n // 10) edits: inserted, deleted or changed letters.  It is split in
k + 1 parts; at most k of them can be touched by k edits, so one occurs exactly.  One automaton over
the parts of all notices finds these seeds in a text.  Around each seed lies the window that the notice must be in;
windows of a notice that overlap are joined.  The regex library then looks for the match of fewest edits in the
window, and again in what is left of and right of it, so that spans of one notice don't overlap.  A window of many
adjacent notices is searched in stretches of `STRETCH` of the notice's lengths, so that the time is in proportion to the text.

Letters are compared without regard to case; every other character counts.  Line breaks within a notice are edits.

Result, one row for each match: doc_id, notice, start, end (in characters, end exclusive), edits.  Null and
empty texts have none.  Rows repeated are scanned each.  Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textvec import Slice, lower_table, slices

NOTICES: dict[str, str] = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl": "licensed under the GNU Lesser General Public License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "all-rights-reserved": "All rights reserved.",
}
MOST_EDITS = 4
LETTERS_PER_EDIT = 10
STRETCH = 8  # lengths of a notice
RESULT = "doc_id bigint, notice string, start bigint, end bigint, edits int"


def fold(text: str) -> str:
    """Lower-cased letter by letter, so that places stay."""
    return lower_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tobytes().decode("utf-32-le")


def edits_allowed(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // LETTERS_PER_EDIT)


def parts_of(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 parts and where they begin."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Finder:
    def __init__(self, notices: dict[str, str]):
        self.names = list(notices)
        self.texts = [fold(t) for t in notices.values()]
        if any(not t for t in self.texts):
            raise ValueError("a notice is empty")
        self.edits = [edits_allowed(t) for t in self.texts]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(self.texts):
            for at, part in parts_of(t, self.edits[i]):
                seeds.setdefault(part, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for part, where in seeds.items():
            self.seeds.add_word(part, (len(part), where))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(t, literal_spaces=True)}){{e<={k}}}") for t, k in zip(self.texts, self.edits)]

    def best(self, i: int, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """Spans of notice i in text[lo:hi] and their edits, the best taken first and then those on either side of it; in the order of the text."""
        least = len(self.texts[i]) - self.edits[i]
        left = [(lo, hi, None)]
        while left:
            lo, hi, found = left.pop()
            if found:
                yield found
            elif hi - lo >= least and (m := self.patterns[i].search(text, lo, hi)):
                a, b = m.span()
                left += [(b, hi, None), (a, b, (a, b, sum(m.fuzzy_counts))), (lo, a, None)]

    def spans(self, i: int, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """As `best`, in stretches of bounded length from the left; what ends within a notice's length of a stretch's end is left to the next one."""
        reach = len(self.texts[i]) + 2 * self.edits[i]
        while lo < hi:
            end = min(hi, lo + STRETCH * reach)
            after = end if end == hi else end - reach
            for a, b, n in self.best(i, text, lo, end):
                if end == hi or b <= end - reach:
                    yield a, b, n
                    lo = b
                else:
                    after = min(after, a)
            lo = max(lo, after)

    def scan(self, text: str, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, notice, start, end and edits of each match in the folded texts text[at[d]:at[d+1]]."""
        ends, hits = [], []
        for end, hit in self.seeds.iter(text):
            ends.append(end)
            hits.append(hit)
        if not ends:
            return
        docs = np.searchsorted(at, np.array(ends), "right") - 1
        windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for end, (size, where), d in zip(ends, hits, docs.tolist()):
            lo, hi = int(at[d]), int(at[d + 1])
            if end + 1 - size < lo:
                continue  # across two texts
            for i, offset in where:
                start, k = end + 1 - size - offset, self.edits[i]
                windows.setdefault((d, i), []).append((max(lo, start - k), min(hi, start + len(self.texts[i]) + k)))
        for (d, i), spans in windows.items():
            spans.sort()
            joined = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            for a, b in joined:
                for s, e, n in self.spans(i, text, a, b):
                    yield d, i, s - int(at[d]), e - int(at[d]), n


_finders: dict[tuple, Finder] = {}


def finder(notices: tuple) -> Finder:
    if notices not in _finders:
        _finders.clear()
        _finders[notices] = Finder(dict(notices))
    return _finders[notices]


def find_notices(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, notice, start, end, edits for each match of notices in docs(doc_id, text)."""
    fixed = tuple(notices.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = finder(fixed)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = Slice(batch.column(1).slice(a, b - a))
                text = lower_table()[part.cp].tobytes().decode("utf-32-le")
                found = list(zip(*machine.scan(text, part.at))) or [()] * 5
                ids = batch.column(0).take(pa.array(np.array(found[0], np.int64) + a))
                yield pa.RecordBatch.from_arrays([ids, pa.array([machine.names[i] for i in found[1]], pa.string()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64()), pa.array(found[4], pa.int32())], ["doc_id", "notice", "start", "end", "edits"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).mapInArrow(work, RESULT)
