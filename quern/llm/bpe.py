"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: its language over token labels is exactly the set of
sequences that BPE produces.  It starts as one state with a loop for each byte.
Each merge (l, r) -> t, in order of rank, is a gadget: wherever l leads from p to
q and r from q to q2, an arc t is put from p to q2, and l now leads to a copy of
q that lacks r.  All arcs of one label always lead to one state, so a state is
named by the label last read, and whether x may be followed by y is settled by
undoing the gadgets from the latest back (`Automaton.arcs`).  `explicit` builds
the same automaton literally and is for small vocabularies: for 50,000 labels the
table would have 2.5e9 cells, so rows are compiled as the corpus needs them and
kept in a transition table.

A pre-split word has one accepted path.  `encode` runs all new words of a slice
side by side over the table, then each word's arc labels are its token ids.
`decode` emits the labels' bytes.

Null text gives null ids, n_tokens 0 and round_trip true; empty text gives an
empty list.  Repeated rows are encoded each.  Extra columns are dropped; a text
of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.textvec import LETTER, NUMBER, OTHER, SPACE, Slice, classes, hold, slices, span_hashes, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean"
_WORD_BITS, _ARC_BITS = 19, 18  # of the tables of words and of arcs that are known
_CACHE_IDS = 3_000_000
_SLICE = 1 << 18
_LONG = 512  # bytes of a word from which on it is run by itself
_BLOCK = 1 << 15


def read_ranks(path: str) -> list[bytes]:
    """Labels by id from a file of base64 label and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    labels = [b""] * len(pairs)
    for label, rank in pairs:
        labels[int(rank)] = base64.b64decode(label)
    return labels


def merges_of(labels: list[bytes]) -> list[tuple[int, int]]:
    """The pair of ids each label is merged from, (-1, -1) for single bytes.

    A label is split by BPE with the merges before it, which leaves two parts.
    """
    rank = {label: i for i, label in enumerate(labels)}
    out = []
    for k, label in enumerate(labels):
        parts = [label[i : i + 1] for i in range(len(label))]
        while len(parts) > 2:
            best, at = min((rank.get(parts[i] + parts[i + 1], k), i) for i in range(len(parts) - 1))
            if best >= k:
                raise ValueError(f"label {k} can't be merged from earlier labels")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out.append((rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (-1, -1))
    return out


def explicit(labels: list[bytes], merges: list[tuple[int, int]]) -> tuple[dict[int, dict[int, int]], int]:
    """The automaton with every state and arc, by merge gadgets one after another: arcs by state, and the start."""
    arcs: dict[int, dict[int, int]] = {0: {t: 0 for t, (a, _) in enumerate(merges) if a < 0}}
    for t, (left, right) in enumerate(merges):
        q = next((x[left] for x in arcs.values() if left in x), None) if left >= 0 else None
        if q is None or right not in arcs[q]:
            continue
        after, copy = arcs[q][right], len(arcs)
        arcs[copy] = {k: v for k, v in arcs[q].items() if k != right}
        for p in arcs.values():
            if left in p:
                p[t], p[left] = after, copy
    return arcs, 0


class Automaton:
    """The transition table over labels, with a trie that finds the labels at each place of a word."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int]]):
        self.labels, self.n = labels, len(labels)
        pair = np.array(merges, np.int64).reshape(-1, 2)
        self.left, self.right = pair[:, 0], pair[:, 1]
        self.rank = np.where(self.left < 0, -1, np.arange(self.n))
        made = np.flatnonzero(self.left >= 0)
        keys = (self.left[made] << 32) | self.right[made]
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], made[order]
        self.length = np.array([len(x) for x in labels], np.int64)
        self.pool = np.frombuffer(b"".join(labels), np.uint8)
        self.pool_at = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self._trie()
        self.labels = None  # pool has them
        self.reset_arcs()
        self.reset_words()

    def _trie(self) -> None:
        """The trie's arcs as an open hash table of node * 256 + byte: a dense one would have 100 MB."""
        nodes: dict[bytes, int] = {b"": 0}
        for x in self.labels:
            for i in range(1, len(x) + 1):
                nodes.setdefault(x[:i], len(nodes))
        self.label_at = np.full(len(nodes), -1, np.int32)
        for t, x in enumerate(self.labels):
            self.label_at[nodes[x]] = t
        key = np.array([nodes[x[:-1]] * 256 + x[-1] for x in nodes if x], np.int64)
        child = np.array([i for x, i in nodes.items() if x], np.int32)
        bits = max(4, (4 * len(nodes)).bit_length())
        self.trie_shift = np.uint64(64 - bits)
        self.trie_keys, self.trie_child = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.int32)
        place = self._place(key)
        while len(key):
            first = np.unique(place, return_index=True)[1]
            won = np.zeros(len(key), bool)
            won[first] = self.trie_keys[place[first]] < 0
            self.trie_keys[place[won]], self.trie_child[place[won]] = key[won], child[won]
            key, child, place = key[~won], child[~won], (place[~won] + 1) & (len(self.trie_keys) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.trie_shift).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's nodes after one more byte, 0 where there is none."""
        key = node.astype(np.int64) * 256 + byte
        at = self._place(key)
        have = self.trie_keys[at]
        out = np.where(have == key, self.trie_child[at], 0)
        todo = np.flatnonzero((have != key) & (have >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.trie_keys) - 1)
            have = self.trie_keys[at[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.trie_child[at[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
        return out

    def reset_arcs(self, bits: int = _ARC_BITS) -> None:
        """An empty transition table: each pair of labels has one place, which the latest pair takes."""
        self.arc_keys, self.arc_ok, self.arc_shift = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool), np.uint64(64 - bits)

    def reset_words(self, bits: int = _WORD_BITS) -> None:
        """No words are known; as for arcs, each has one place.  Hash 0 stands for none."""
        self.word_keys, self.word_at, self.word_n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.word_shift, self.word_ids, self.n_ids = np.uint64(64 - bits), np.zeros(1 << 16, np.int32), 0

    def __getstate__(self) -> dict:
        """Without what it learned: the tables are made anew where it is sent."""
        learned = ("arc_keys", "arc_ok", "arc_shift", "word_keys", "word_at", "word_n", "word_shift", "word_ids", "n_ids")
        return {k: v for k, v in self.__dict__.items() if k not in learned}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.reset_arcs()
        self.reset_words()

    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank at which x and y merge, or one above all."""
        if not len(self.merge_keys):
            return np.full(len(x), self.n)
        key = (x << 32) | y
        i = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[i] == key, self.merge_ranks[i], self.n)

    def arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the state after x has an arc y, once all gadgets are in."""
        x, y = x.astype(np.int64), y.astype(np.int64)
        ok = np.ones(len(x), bool)
        todo, when = np.arange(len(x)), np.full(len(x), self.n)
        while len(todo):
            a, b = x[todo], y[todo]
            cut = self._merge_rank(a, b) < when[todo]  # the gadget of this pair took the arc away
            ra, rb = self.rank[a], self.rank[b]
            later = rb > ra  # the arc came with b's gadget: it stands where b's left part had one
            la, lb = np.where(later, a, self.right[a]), np.where(later, self.left[b], b)
            twice = later & (self.left[b] == self.right[b]) & (a == self.left[b])  # the copy of the state lacks it
            same = a == b  # the state after a is the one its right part led to before the gadget
            lb = np.where(same & ~later, self.left[a], lb)
            ok[todo[cut | twice]] = False
            go = ~cut & ~twice & ((ra >= 0) | (rb >= 0))
            x[todo], y[todo], when[todo] = la, lb, np.maximum(ra, rb)
            todo = todo[go]
        return ok

    def allowed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """`arcs` through the transition table; what isn't there yet is compiled."""
        key = (x.astype(np.int64) << 32) | y
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.arc_shift).astype(np.int64)
        out = self.arc_ok[at]
        miss = np.flatnonzero(self.arc_keys[at] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            ok = self.arcs(new >> 32, new & 0xFFFFFFFF)
            out[miss] = ok[back]
            # of two pairs for one place one stays, with its own answer
            place = at[miss]
            self.arc_keys[place] = key[miss]
            mine = self.arc_keys[place] == key[miss]
            self.arc_ok[place[mine]] = out[miss[mine]]
        return out

    def run(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paths of words given by their bytes: ids of all, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        by = np.argsort(lengths, kind="stable")
        long = int(np.searchsorted(lengths[by], _LONG, "right"))
        for k in by[long:].tolist():
            ids = self._run_long(raw[starts[k] : starts[k] + lengths[k]])
            counts[k] = len(ids)
            pieces.append((np.array([k]), ids))
        by, a = by[:long], 0
        while a < len(by):
            top = int(lengths[by[a]])
            limit = max(top, 4 if top <= 4 else top + top // 4)
            b = min(int(np.searchsorted(lengths[by], limit, "right")), a + max(1, (1 << 21) // max(1, limit)))
            rows = by[a:b]
            rows, ids, n = rows, *self._run(raw, starts[rows], lengths[rows])
            counts[rows] = n
            pieces.append((rows, ids))
            a = b
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in pieces:
            out[spread(at[rows], counts[rows])] = ids
        return out, counts

    def _run(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, top = len(starts), int(lengths.max(initial=0))
        padded = np.concatenate([raw, np.zeros(1, np.uint8)])
        grid = padded[np.minimum(starts[None, :] + np.arange(top)[:, None], len(raw))]  # by place, then word
        last = np.full((top + 1, n), -1, np.int32)
        for j in range(top):
            rows = np.flatnonzero((lengths > j) & ((last[j] >= 0) | (j == 0)))
            node, d = np.zeros(len(rows), np.int32), j
            found_rows, found_end, found_label = [], [], []
            while len(rows):
                node = self.step(node, grid[d, rows])
                d += 1
                there = node > 0
                rows, node = rows[there], node[there]
                label = self.label_at[node]
                hit = label >= 0
                found_rows.append(rows[hit])
                found_label.append(label[hit])
                found_end.append(np.full(int(hit.sum()), d))
                more = lengths[rows] > d
                rows, node = rows[more], node[more]
            if found_rows:
                r, e, t = map(np.concatenate, (found_rows, found_end, found_label))
                if j:
                    ok = self.allowed(last[j, r], t)
                    r, e, t = r[ok], e[ok], t[ok]
                last[e, r] = t
        place, rows, steps = lengths.copy(), np.arange(n), []
        while len(rows := rows[place[rows] > 0]):
            t = last[place[rows], rows]
            steps.append((rows, t))
            place[rows] -= self.length[t]
        counts = np.zeros(n, np.int64)
        for r, _ in steps:
            counts[r] += 1
        at = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int32)
        for k, (r, t) in enumerate(steps):
            ids[at[r] + counts[r] - 1 - k] = t
        return ids, counts

    def _matches(self, word: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and label of every label that begins in [lo, hi)."""
        at = np.arange(lo, hi)
        node, found, d = np.zeros(len(at), np.int32), [], 0
        while len(at):
            node = self.step(node, word[at + d])
            d += 1
            at, node = at[node > 0], node[node > 0]
            hit = self.label_at[node] >= 0
            found.append(np.stack([at[hit], at[hit] + d, self.label_at[node[hit]].astype(np.int64)]))
            more = at + d < len(word)
            at, node = at[more], node[more]
        return tuple(np.concatenate(found, axis=1))

    def _run_long(self, word: np.ndarray) -> np.ndarray:
        """The path of one long word.  In blocks of its places, all arcs that can matter are looked up at once: those from a label that ends at a place to one that begins there."""
        n, longest = len(word), int(self.length.max())
        last, length = [-1] * (n + 1), self.length.tolist()
        for lo in range(0, n, _BLOCK):
            hi = min(n, lo + _BLOCK)
            start, end, label = self._matches(word, max(0, lo - longest), hi)
            by = np.argsort(start, kind="stable")
            start, end, label = start[by], end[by], label[by]
            place = np.arange(lo, hi + 1)
            first = np.searchsorted(start, place)
            before = (end >= lo) & (end < hi)
            count = np.diff(first)[end[before] - lo]
            pairs = np.unique((np.repeat(label[before], count) << 32) | label[spread(first[end[before] - lo], count)])
            good = set(pairs[self.arcs(pairs >> 32, pairs & 0xFFFFFFFF)].tolist())
            ends, labels, first = end.tolist(), label.tolist(), first.tolist()
            for j in range(lo, hi):
                p = last[j] << 32
                if j == 0:
                    for m in range(first[0], first[1]):
                        last[ends[m]] = labels[m]
                elif p >= 0:
                    for m in range(first[j - lo], first[j - lo + 1]):
                        if p | labels[m] in good:
                            last[ends[m]] = labels[m]
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return np.array(ids[::-1], np.int32)

    def _known(self, part: Slice, split: "Split") -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the words of split stand in word_ids, and how many each has; new words are run first."""
        words = split.words
        if self.n_ids > _CACHE_IDS:
            self.reset_words(64 - int(self.word_shift))
        place = (words >> self.word_shift).astype(np.int64)
        at, n = self.word_at[place], self.word_n[place].astype(np.int64)
        miss = np.flatnonzero(self.word_keys[place] != words)
        if len(miss):
            new = split.first[miss]
            starts, ends = split.byte(part, split.start[new]), split.byte(part, split.end[new])
            ids, count = self.run(part.raw, starts, ends - starts)
            if self.n_ids + len(ids) > len(self.word_ids):
                self.word_ids = np.concatenate([self.word_ids[: self.n_ids], np.zeros(max(self.n_ids, 2 * len(ids)), np.int32)])
            self.word_ids[self.n_ids : self.n_ids + len(ids)] = ids
            at[miss], n[miss] = self.n_ids + np.cumsum(count) - count, count
            self.n_ids += len(ids)
            self.word_keys[place[miss]] = words[miss]
            mine = miss[self.word_keys[place[miss]] == words[miss]]
            self.word_at[place[mine]], self.word_n[place[mine]] = at[mine], n[mine]
        return at, n

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the offset where each text's begin."""
        split = Split(part)
        if not len(split.start):
            return np.zeros(0, np.int32), np.zeros(part.n + 1, np.int64)
        at, n = self._known(part, split)
        each = n[split.back]
        out = self.word_ids[spread(at[split.back], each)]
        return out, np.concatenate([[0], np.cumsum(each)])[split.of]

    def count(self, part: Slice, split: "Split") -> np.ndarray:
        """How many ids each text of a slice has."""
        if not len(split.start):
            return np.zeros(part.n, np.int64)
        _, n = self._known(part, split)
        return np.diff(np.concatenate([[0], np.cumsum(n[split.back])])[split.of])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the labels of ids, one after another."""
        return self.pool[spread(self.pool_at[ids], self.length[ids])]


def presplit(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens: contractions; letters, numbers or other signs with a blank before them; white space.

    The last of several white-space characters before something else stands apart, or goes with it if it is a blank.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    edge = np.zeros(n, bool)
    edge[0] = True
    edge[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n, bool)  # of a text
    first[at[:-1][at[:-1] < n]] = True
    edge |= first
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], n)
    white = kind[runs] == SPACE
    before_text = white & (np.append(first[runs[1:]], True) == False)  # noqa: E712
    last = ends[before_text] - 1  # white space before something else
    blank = cp[last] == 32
    edge[ends[before_text][blank]] = False  # goes with what follows
    edge[last] = True
    # contractions: an apostrophe that begins a pre-token, alone of its kind, before s t m d re ve ll
    quote = np.flatnonzero((cp == 39) & edge)
    if len(quote):
        nxt = np.minimum(quote + 1, n - 1)
        nx2 = np.minimum(quote + 2, n - 1)
        inside = (quote + 1 < n) & ~first[nxt]
        c1 = np.where(inside, cp[nxt], 0)
        c2 = np.where(inside & (quote + 2 < n) & ~first[nx2], cp[nx2], 0)
        one = np.isin(c1, [115, 116, 109, 100])
        two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        for hit, k in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            edge[q + 1] = False
            stop = q[q + k < n] + k
            edge[stop] = True
    s = np.flatnonzero(edge)
    return s, np.append(s[1:], n)


class Split:
    """The pre-tokens of a slice: start, end, of (the first of each text, and their number), and words, the distinct ones by hash, with first and back as np.unique gives them."""

    def __init__(self, part: Slice):
        self.start, self.end = presplit(part.cp, part.at)
        self.of = np.searchsorted(self.start, part.at, "left")
        self.words, self.first, self.back = np.unique(span_hashes(part.cp, self.start, self.end), return_index=True, return_inverse=True) if len(self.start) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self._bytes: np.ndarray | None = None

    def byte(self, part: Slice, at: np.ndarray) -> np.ndarray:
        """The bytes before places given in characters."""
        if self._bytes is None:
            width = 1 + (part.cp > 0x7F).astype(np.int64) + (part.cp > 0x7FF) + (part.cp > 0xFFFF)
            self._bytes = np.concatenate([[0], np.cumsum(width)])
        return self._bytes[at]


assert (OTHER, LETTER, NUMBER) == (0, 1, 2)
_automata: dict[str, Automaton] = {}


@lru_cache(4)
def compiled(path: str) -> tuple[str, Automaton]:
    """The automaton of a vocabulary file, and a name for what is in it; compiled once, on the driver."""
    labels = read_ranks(path)
    return hashlib.sha256(b"\0".join(labels)).hexdigest(), Automaton(labels, merges_of(labels))


def automaton(key: str, sent) -> Automaton:
    """The automaton of this process for a vocabulary, from the broadcast one; it and its table serve all tasks of a worker."""
    hold("bpe", _automata.clear)
    if key not in _automata:
        if len(_automata) > 1:
            _automata.pop(next(iter(_automata)))
        _automata[key] = sent.value
    return _automata[key]


def encode_decode(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text's bytes again.

    doc_id, ids, n_tokens, round_trip: one row for each row of docs(doc_id, text).
    """
    key, machine = compiled(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(key, sent)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, _SLICE):
                piece = texts.slice(a, b - a)
                part = Slice(piece)
                ids, at = machine.encode(part)
                back = machine.decode(ids)
                bytes_at = np.concatenate([[0], np.cumsum(machine.length[ids])])[at]
                same = np.diff(bytes_at) == np.diff(part.byte_at)
                if len(back) == len(part.raw):
                    wrong = np.concatenate([[0], np.cumsum(back != part.raw)])
                    same &= (wrong[part.byte_at[1:]] - wrong[part.byte_at[:-1]] == 0) & (bytes_at[1:] == part.byte_at[1:])
                else:
                    same &= np.array([bool(np.array_equal(back[bytes_at[i] : bytes_at[i + 1]], part.raw[part.byte_at[i] : part.byte_at[i + 1]])) for i in range(part.n)])
                void = piece.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(void)) if len(void) else pa.array([], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(np.diff(at)), pa.array(same)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(work, SCHEMA)
