"""Secret scans by a trigram inverted index.

Every rule is a regular expression.  From its syntax tree a Boolean query over trigrams is derived that any
text with a match satisfies: the trigrams of a run of fixed letters are joined by AND, those of
alternatives (branches, small classes) by OR, and what may be absent demands nothing.

Texts are indexed in segments: the bytes of a segment, ASCII letters lower-cased, give for each trigram
that a rule asks for the ascending list of the texts that have it.  A rule's query intersects
and unites these lists, and the expression itself then runs over the whole of each remaining text.  A rule
whose query demands nothing runs over all texts.

Result, one row for each match: doc_id, rule, start, end (in characters, end exclusive) and digest, the
SHA-256 of what matched; the secret itself isn't passed on.  Matches of one rule don't overlap.  Null and
empty texts have none.  Rows repeated are scanned each.  Rules hold the same for letters of any alphabet: \\b and classes are ASCII.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textvec import Slice, slices

RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[sr]k_live_[0-9A-Za-z]{24,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "web_token": r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "assigned_secret": r"(?i)(?:api_?key|secret|token|passw(?:or)?d)(?:[_-][A-Za-z0-9_-]{0,40}|Key)?[\"']?[ \t]*[:=][ \t]*[\"'][^ \t\r\n\"']{8,}[\"']",
    "url_credentials": r"\b[a-z][a-z0-9+.-]{1,20}://[^ \t\r\n/:@]+:[^ \t\r\n/:@]+@",
    "hex_key": r"\b(?:[0-9a-f]{64}|[0-9a-f]{40})\b",
}
RESULT = "doc_id bigint, rule string, start bigint, end bigint, digest string"
_MOST = 32  # strings that one run of alternatives may stand for

# A query is True (anything), a trigram, or ("and"/"or", parts).
Query = object


def _join(kind: str, parts: list) -> Query:
    flat: list = []
    for p in parts:
        if p is True:
            if kind == "or":
                return True
            continue
        more = p[1] if isinstance(p, tuple) and p[0] == kind else [p]
        flat += [x for x in more if x not in flat]
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, flat)


def _trigrams(text: str) -> Query:
    raw = text.encode().lower()
    return _join("and", [raw[i : i + 3] for i in range(len(raw) - 2)])


def _characters(op: object, value: object) -> list[str] | None:
    """The letters that one place of an expression may hold, where they are few."""
    if op is C.LITERAL:
        return [chr(value).lower() if value < 128 else chr(value)]
    if op is C.IN:
        found: list[str] = []
        for kind, x in value:
            if kind is C.LITERAL:
                found.append(chr(x))
            elif kind is C.RANGE and x[1] - x[0] < 8:
                found += map(chr, range(x[0], x[1] + 1))
            else:
                return None
        found = sorted({c.lower() if c.isascii() else c for c in found})
        return found if len(found) <= 8 else None
    return None


class _Run:
    """Strings that the place at hand must be preceded by, and what is demanded so far."""

    def __init__(self) -> None:
        self.strings, self.demands = [""], []

    def end(self) -> None:
        self.demands.append(_join("or", [_trigrams(s) for s in self.strings]))
        self.strings = [""]

    def add(self, options: list[str]) -> None:
        if len(self.strings) * len(options) > _MOST:
            tails = sorted({s[-2:] for s in self.strings})
            self.end()
            self.strings = tails if len(tails) * len(options) <= _MOST else [""]
        if len(self.strings) * len(options) > _MOST:
            self.end()
        else:
            self.strings = [a + b for a, b in product(self.strings, options)]


def _walk(tree: list, run: _Run, folding: bool) -> None:
    for op, value in tree:
        letters = _characters(op, value)
        if letters is not None and not (folding and any(not c.isascii() for c in letters)):
            run.add(letters)
        elif op is C.SUBPATTERN:
            _walk(value[3], run, folding or bool(value[1] & re.I))
        elif op is C.BRANCH:
            fixed = [_fixed(b) for b in value[1]]
            if all(f is not None for f in fixed):
                run.add(sorted(set(fixed)))
            else:
                run.end()
                run.demands.append(_join("or", [_query(b, folding) for b in value[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = value
            for _ in range(min(least, 4)):
                _walk(body, run, folding)
            if least != most or least > 4:
                run.end()
        elif op is not C.AT:
            run.end()


def _fixed(tree: list) -> str | None:
    letters = [_characters(op, v) for op, v in tree]
    return "".join(x[0] for x in letters) if all(x is not None and len(x) == 1 for x in letters) else None


def _query(tree: list, folding: bool) -> Query:
    run = _Run()
    _walk(tree, run, folding)
    run.end()
    return _join("and", run.demands)


def trigram_query(pattern: str) -> Query:
    """What trigrams (lower-cased bytes) a text must have to match; True if none are mandatory."""
    tree = _parser.parse(pattern)
    return _query(tree, bool(tree.state.flags & re.I))


def trigrams_of(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def _lookup(query: Query, lists: dict[bytes, np.ndarray]) -> np.ndarray:
    if isinstance(query, bytes):
        return lists[query]
    if query[0] == "or":
        return np.unique(np.concatenate([_lookup(q, lists) for q in query[1]]))
    parts = sorted((_lookup(q, lists) for q in query[1]), key=len)
    found = parts[0]
    for p in parts[1:]:
        if not len(found):
            break
        found = np.intersect1d(found, p, assume_unique=True)
    return found


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.rules = {name: re.compile(p, re.ASCII) for name, p in rules.items()}
        self.queries = {name: trigram_query(p) for name, p in rules.items()}
        self.trigrams = sorted(set().union(*map(trigrams_of, self.queries.values())))
        self._number: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_number": None}

    def index(self, part: Slice) -> dict[bytes, np.ndarray]:
        """For each trigram that a rule asks for, the ascending texts of the slice that have it."""
        if self._number is None:
            self._number = np.zeros(1 << 24, np.uint16)
            for k, t in enumerate(self.trigrams):
                self._number[t[0] << 16 | t[1] << 8 | t[2]] = k + 1
        lists = {t: np.zeros(0, np.int64) for t in self.trigrams}
        if len(part.raw) < 3 or not self.trigrams:
            return lists
        fold = np.arange(256, dtype=np.uint32)
        fold[65:91] += 32
        low = fold[part.raw]
        number = self._number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(number)
        doc = np.searchsorted(part.byte_at, at, "right") - 1
        inside = at + 2 < part.byte_at[doc + 1]
        posting = np.unique(number[at[inside]].astype(np.int64) * (part.n + 1) + doc[inside])
        which, doc = posting // (part.n + 1), posting % (part.n + 1)
        bounds = np.searchsorted(which, np.arange(1, len(self.trigrams) + 2))
        return {t: doc[a:b] for t, a, b in zip(self.trigrams, bounds[:-1], bounds[1:])}

    def scan(self, part: Slice) -> Iterator[tuple[int, str, int, int, str]]:
        """Text of the slice, rule, start, end and digest of each match."""
        lists = self.index(part)
        whole = part.raw.tobytes()
        texts: dict[int, str] = {}
        for name, rule in self.rules.items():
            query = self.queries[name]
            for d in range(part.n) if query is True else _lookup(query, lists).tolist():
                if d not in texts:
                    texts[d] = whole[part.byte_at[d] : part.byte_at[d + 1]].decode()
                for m in rule.finditer(texts[d]):
                    yield d, name, m.start(), m.end(), hashlib.sha256(m.group().encode()).hexdigest()


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple) -> Scanner:
    if rules not in _scanners:
        _scanners.clear()
        _scanners[rules] = Scanner(dict(rules))
    return _scanners[rules]


def find_secrets(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, rule, start, end, digest for each match of rules in docs(doc_id, text)."""
    fixed = tuple(rules.items())
    for _, p in fixed:
        re.compile(p, re.ASCII)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(fixed)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                found = list(zip(*machine.scan(Slice(batch.column(1).slice(a, b - a))))) or [()] * 5
                ids = batch.column(0).take(pa.array(np.array(found[0], np.int64) + a))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found[1], pa.string()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64()), pa.array(found[4], pa.string())], ["doc_id", "rule", "start", "end", "digest"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).mapInArrow(work, RESULT)


def sql(rules: dict[str, str] = RULES) -> str:
    """The same by running every expression over every text; places follow from what stands between matches."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    one = """
        SELECT doc_id, {name} AS rule, start, start + length(hit) AS "end", sha256(hit) AS digest FROM (
            SELECT doc_id, hits[k] AS hit, list_sum(list_transform(between[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS start FROM (
                SELECT doc_id, hits, between, unnest(range(1, len(hits) + 1)) AS k FROM (
                    SELECT doc_id, regexp_extract_all(text, {p}) AS hits, regexp_split_to_array(text, {p}) AS between FROM documents WHERE regexp_matches(text, {p}))))"""
    body = " UNION ALL ".join(one.format(name=quote(n), p=quote(p)) for n, p in rules.items())
    return f'SELECT doc_id, rule, start::BIGINT AS start, "end"::BIGINT AS "end", digest FROM ({body})'
