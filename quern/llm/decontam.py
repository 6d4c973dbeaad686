"""Benchmark decontamination over a distributed positional inverted index.

Index.  Training texts become lower-cased words (maximal runs of letters and numbers), and
documents are gathered in segments of bounded size.  A segment stores, for every distinct term
(its 64-bit hash), the ascending positions of its occurrences; positions run on through
the documents of the segment, with a gap between them that no phrase or window spans.  The index
is a table in the shared folder, one row for each segment, of all terms of all texts, and
serves any benchmark.

Search.  The numbers of documents and occurrences of each benchmark term are summed over all
segments.  Each item is cut into all its windows of `n` words (one window if it is
shorter but has `least` words).  Within a segment a window's lists are intersected from its rarest
term on, each list moved back by the term's offset in the window, so that what
remains are the starts of exact phrases.  Windows that share their rarest term at the same place of the
item share the first list.  Proximity: of the `rare` rarest distinct terms of an item that occur at all, at least `need`
stand within a span of the item's words plus `slack` (of equally rare terms the first by spelling counts); only items with `need` such terms
are searched so.

Result, one row for each document and item that match: doc_id, item_id, phrases (the windows' occurrences),
first_pos (of the first in the document, in words), best (the most rare terms in one span).  phrases is 0 and first_pos null where only proximity matched.

Null and empty texts match nothing, on either side.  Items of equal text match alike under each item_id;
rows repeated in docs or benchmark are searched each and their counts come as rows of their own.
A null doc_id is searched and reported as null; an item with a null item_id too.
Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import stored
from quern.llm.textvec import Slice, hold, slices, spread

PHRASE = 13
LEAST = 8
RARE = 8
NEED = 6
SLACK = 12
GAP = 1 << 20
SEGMENT = "doc_ids array<bigint>, doc_starts array<bigint>, n_words array<bigint>, terms binary, counts binary, dfs binary, positions binary"
RESULT = "doc_id bigint, item_id bigint, phrases bigint, first_pos bigint, best bigint"


def segment(docs: pa.Array, part: Slice) -> pa.RecordBatch:
    """The postings of the texts of a slice."""
    h, _, doc = part.words()
    n = np.bincount(doc, minlength=part.n).astype(np.int64)
    starts = np.cumsum(n + GAP) - (n + GAP)
    position = np.arange(len(h)) + doc * GAP
    order = np.argsort(h, kind="stable")
    terms, first = np.unique(h[order], return_index=True)
    counts = np.diff(np.append(first, len(h))).astype(np.int32)
    of = doc[order]
    fresh = np.ones(len(h), bool)  # the first of a term's occurrences in a document
    fresh[1:] = of[1:] != of[:-1]
    fresh[first] = True
    dfs = (np.add.reduceat(fresh, first, dtype=np.int32) if len(h) else np.zeros(0)).astype(np.int32)
    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
    # within a term's list each position is stored as the step from the one before
    p = position[order]
    step = np.diff(p, prepend=0)
    step[first] = p[first]
    small = step < 65535
    packed = np.where(small, step, 65535).astype(np.uint16).tobytes() + step[~small].tobytes()
    return pa.RecordBatch.from_arrays([one(docs, pa.int64()), one(starts, pa.int64()), one(n, pa.int64()), *(pa.array([x], pa.binary()) for x in (terms.tobytes(), counts.tobytes(), dfs.tobytes(), packed))], ["doc_ids", "doc_starts", "n_words", "terms", "counts", "dfs", "positions"])


def build_index(docs: DataFrame, segment_bytes: int = 1 << 19) -> DataFrame:
    """The positional index of docs(doc_id, text) as a stored table of segments of about segment_bytes of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("decontam")
        for batch in batches:
            for a, b in slices(batch.column(1), segment_bytes):
                yield segment(batch.column(0).slice(a, b - a), Slice(batch.column(1).slice(a, b - a)))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    return stored(rows.mapInArrow(work, SEGMENT), "postings")


def _places(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the ascending terms the wanted ones stand, and which of them do."""
    there = np.zeros(len(wanted), bool)
    place = np.searchsorted(terms, wanted)
    if len(terms):
        there = terms[np.minimum(place, len(terms) - 1)] == wanted
    return place[there], there


class Postings:
    """A stored segment, read for some terms."""

    def __init__(self, row: pa.RecordBatch, i: int, wanted: np.ndarray):
        get = lambda name: row.column(row.schema.get_field_index(name))[i]
        self.doc_ids = get("doc_ids").values
        self.starts = np.asarray(get("doc_starts").values)
        self.n_words = np.asarray(get("n_words").values)
        self.terms = np.frombuffer(get("terms").as_buffer(), np.uint64)
        counts = np.frombuffer(get("counts").as_buffer(), np.int32).astype(np.int64)
        packed = get("positions").as_buffer()
        total = int(counts.sum())
        small = np.frombuffer(packed, np.uint16, total)
        large = np.frombuffer(packed, np.uint8, offset=2 * total).view(np.int64)
        at = np.cumsum(counts) - counts
        rows, there = _places(self.terms, wanted)
        n = counts[rows]
        pick = spread(at[rows], n)
        steps = small[pick].astype(np.int64)
        wide = np.flatnonzero(steps == 65535)
        if len(wide):
            rank = np.cumsum(small == 65535) - 1
            steps[wide] = large[rank[pick[wide]]]
        run = np.cumsum(steps)
        self.counts = np.zeros(len(wanted), np.int64)
        self.counts[there] = n
        ends = np.cumsum(self.counts)
        self.at = ends - self.counts
        base = np.zeros(len(n), np.int64)
        if len(n):
            lo = np.cumsum(n) - n
            base = run[lo] - steps[lo]
        self.positions = run - np.repeat(base, n)

    def of(self, k: int) -> np.ndarray:
        """The ascending positions of the k-th wanted term."""
        return self.positions[self.at[k] : self.at[k] + self.counts[k]]

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1


def _stats(index: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and occurrences of each wanted term over all segments; positions aren't read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts, dfs in zip(*batch.columns):
                at, there = _places(np.frombuffer(terms.as_buffer(), np.uint64), wanted)
                cf[there] += np.frombuffer(counts.as_buffer(), np.int32)[at]
                df[there] += np.frombuffer(dfs.as_buffer(), np.int32)[at]
        hit = np.flatnonzero(cf)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(df[hit]), pa.array(cf[hit])], ["k", "df", "cf"])

    got = index.select("terms", "counts", "dfs").mapInArrow(work, "k bigint, df bigint, cf bigint").groupBy("k").agg(F.sum("df"), F.sum("cf")).collect()
    df, cf = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    for k, d, c in got:
        df[k], cf[k] = d, c
    return df, cf


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of values are in the ascending array of."""
    if not len(of):
        return np.zeros(len(values), bool)
    i = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[i] == values


class Query:
    """A benchmark as lists to intersect: for each window its terms and their places, rarest first; all in arrays."""

    def __init__(self, item_ids: list, words: list[np.ndarray], spelt: dict[int, str], n: int, least: int, rare: int, need: int, slack: int):
        self.item_ids, self.n, self.need, self.slack = item_ids, n, need, slack
        self.wanted, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)
        ends = np.cumsum([len(w) for w in words])
        self.items = [inverse[e - len(w) : e] for e, w in zip(ends, words)]
        self.least, self.rare = least, rare
        self.spelt = [spelt[int(h)] for h in self.wanted]

    def rank(self, df: np.ndarray, cf: np.ndarray) -> None:
        """Fix the order of intersection by the corpus's counts; what only serves that is dropped."""
        windows: dict[int, list] = {}  # by size: item, first place, terms
        self.near = np.full((len(self.items), self.rare), -1)
        for item, terms in enumerate(self.items):
            size = self.n if len(terms) >= self.n else len(terms) if len(terms) >= self.least else 0
            if size:
                cut = np.lib.stride_tricks.sliding_window_view(terms, size)
                windows.setdefault(size, []).append((np.full(len(cut), item), np.arange(len(cut)), cut))
            some = sorted((k for k in set(terms.tolist()) if df[k]), key=lambda k: (df[k], self.spelt[k]))[: self.rare]
            if len(some) >= self.need:
                self.near[item, : len(some)] = some
        self.windows = []
        for parts in windows.values():
            item, first, terms = map(np.concatenate, zip(*parts))
            order = np.argsort(cf[terms], axis=1, kind="stable")
            self.windows.append((item, first, np.take_along_axis(terms, order, axis=1), order))
        self.spans = np.array([len(t) for t in self.items], np.int64) + self.slack
        self.items, self.spelt = [], []

    def search(self, p: Postings) -> pa.RecordBatch:
        phrases: dict[tuple[int, int], list[int]] = {}
        best: dict[tuple[int, int], int] = {}
        here = p.counts > 0
        for item, first, terms, order in self.windows:
            known: dict[tuple[int, int], np.ndarray] = {}
            for w in np.flatnonzero(here[terms].all(axis=1)).tolist():  # a window of which the segment lacks a term is left at once
                k, j, a = terms[w], order[w], int(first[w])
                anchor = (int(k[0]), a + int(j[0]))
                if anchor not in known:  # windows with one rarest term at one place of the item share its list
                    known[anchor] = p.of(anchor[0]) - anchor[1]
                starts = known[anchor] + a
                for x, off in zip(k[1:].tolist(), j[1:].tolist()):
                    if not len(starts):
                        break
                    starts = starts[_member(starts + off, p.of(x))]
                for s, d in zip(starts.tolist(), p.doc(starts).tolist()):
                    phrases.setdefault((int(item[w]), d), []).append(s - int(p.starts[d]))
        there = here[self.near] & (self.near >= 0) if len(here) else np.zeros(self.near.shape, bool)
        for item in np.flatnonzero(there.sum(axis=1) >= self.need).tolist():
            rare = self.near[item][there[item]].tolist()
            at = np.concatenate([p.of(k) for k in rare])
            which = np.repeat(np.arange(len(rare)), [p.counts[k] for k in rare])
            order = np.argsort(at, kind="stable")
            at, which = at[order], which[order]
            doc = p.doc(at)
            stop = np.minimum(np.searchsorted(at, at + self.spans[item], "left"), np.searchsorted(doc, doc, "right"))  # no span leaves its document
            for i in np.flatnonzero(stop - np.arange(len(at)) >= self.need).tolist():
                m = len(set(which[i : stop[i]].tolist()))
                if m >= self.need:
                    best[item, int(doc[i])] = max(best.get((item, int(doc[i])), 0), m)
        out = [(p.doc_ids[d].as_py(), self.item_ids[item], len(found := phrases.get((item, d), [])), min(found, default=None), best.get((item, d), 0)) for item, d in sorted({*phrases, *best})]
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "phrases", "first_pos", "best"])


def _searched(index: DataFrame, items: pa.Table, *parameters: int) -> DataFrame:
    part = Slice(items["text"].combine_chunks())
    h, _, doc = part.words()
    low, starts, ends = part.word_spans()
    spelt = {k: low[s:e].tobytes().decode("utf-32-le") for k, s, e in zip(h.tolist(), starts, ends)}
    bounds = np.searchsorted(doc, np.arange(part.n + 1))
    query = Query(items["item_id"].to_pylist(), [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])], spelt, *parameters)
    query.rank(*_stats(index, query.wanted))
    sent = index.sparkSession.sparkContext.broadcast(query)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield sent.value.search(Postings(batch, i, sent.value.wanted))

    return index.mapInArrow(work, RESULT)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE, least: int = LEAST, rare: int = RARE, need: int = NEED, slack: int = SLACK, block_bytes: int = 8 << 20) -> DataFrame:
    """Matches of benchmark(item_id, text) in docs(doc_id, text); see the module.

    The benchmark is searched for in blocks of about block_bytes of text, by a hash of the text: only one block at a time is on the driver, and
    what is broadcast of it is about 30 times as large.
    """
    index = build_index(docs)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // block_bytes)
    found = None
    for block in range(blocks):
        one = _searched(index, items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow(), n, least, rare, need, slack)
        found = one if found is None else found.unionByName(one)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 500_000, **parameters) -> DataFrame:
    """The rows of docs that match no item of benchmark, with all their columns.

    Rows are told apart by a hash of doc_id and text, so that a null doc_id, or one of several rows, does no
    harm.  The hashes of rows that match are broadcast up to broadcast_rows and joined by a shuffle beyond.
    """
    whole = docs.select(F.struct("*").alias("row")).select(F.xxhash64("row.doc_id", "row.text").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "row")
    found = stored(contaminated(whole.select("doc_id", "text"), benchmark, **parameters).select(F.col("doc_id").alias("found")).distinct(), "contaminated")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    return whole.join(found, F.col("doc_id") == F.col("found"), "left_anti").select("row.*")


SQL = f"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
    d AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM dw),
    b AS (SELECT DISTINCT item_id, len(w) AS size, unnest(w) AS term FROM bw),
    df AS (SELECT term, count(DISTINCT doc_id) AS df FROM d WHERE term IN (SELECT term FROM b) GROUP BY term),
    ranked AS (SELECT item_id, size, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS r FROM b JOIN df USING (term)),
    rare AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS m FROM ranked WHERE r <= {RARE}),
    hits AS (SELECT doc_id, item_id, size, term, pos FROM d JOIN rare USING (term) WHERE m >= {NEED}),
    spans AS (SELECT x.doc_id, x.item_id, count(DISTINCT y.term) AS k FROM hits x JOIN hits y ON x.doc_id = y.doc_id AND x.item_id = y.item_id
              AND y.pos >= x.pos AND y.pos < x.pos + x.size + {SLACK} GROUP BY x.doc_id, x.item_id, x.pos),
    near AS (SELECT doc_id, item_id, max(k) AS best FROM spans WHERE k >= {NEED} GROUP BY ALL),
    bp AS (SELECT item_id, size, array_to_string(w[a + 1 : a + size], ' ') AS phrase FROM
           (SELECT item_id, w, least(len(w), {PHRASE}) AS size, unnest(range(len(w) - least(len(w), {PHRASE}) + 1)) AS a FROM bw WHERE len(w) >= {LEAST})),
    dp AS (SELECT doc_id, pos, size, array_to_string(w[pos + 1 : pos + size], ' ') AS phrase FROM
           (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS pos FROM dw, (SELECT DISTINCT size FROM bp) WHERE len(w) >= size)),
    exact AS (SELECT doc_id, item_id, count(*) AS phrases, min(pos) AS first_pos FROM dp JOIN bp USING (size, phrase) GROUP BY ALL)
    SELECT doc_id, item_id, coalesce(phrases, 0) AS phrases, first_pos, coalesce(best, 0) AS best FROM exact FULL JOIN near USING (doc_id, item_id)"""
