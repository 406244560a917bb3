"""Prefix-filtered set join between the shingles of short passages and whole documents.

A passage gives queries: all its windows of some number of words, or itself. A query's tokens are its shingles. With a
threshold of 1 its words must stand in a document consecutively; below, a block of the document with a bounded number of
words must hold at least ``ceil(threshold * tokens)`` of the distinct tokens. The join takes one scan of the texts:

1. The tokens of the documents are reduced to those that any query has (positions and token numbers are kept),
   and the documents with each token are counted.
2. Tokens are ordered by rarity. Of n tokens of which m must be there, the n - m + 1 rarest are necessary: a match
   has at least one of them. Only they are looked up; a query's place and a document's length then bound
   where a match can start, and each possible start is verified.

Passages are held as one bounded block at a time, in flat arrays (windows are places in them), and each block meets all
documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from arborlake.llm.text import alnum_words, arrow_columns, positional, slices, utf8
from arborlake.runtime import durable

#: Bytes of passages in one block, about.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Passage:
    """words: of the passage, not none. window: words of a query (all, if the passage has fewer; None: always all). longest: a
    match below a threshold of 1 has as many words as the query times this, at most."""

    words: tuple[bytes, ...]
    threshold: float
    owner: object
    window: int | None = None
    longest: float = 1.0


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, in a row."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _codes(columns: Iterable[np.ndarray], odd: int) -> np.ndarray:
    code = None
    for c in columns:
        c = c.astype(np.uint64) + np.uint64(1)
        code = c if code is None else code * np.uint64(odd) + c
    return code


class Finder:
    """The distinct shingles of all queries, found in texts word by word."""

    def __init__(self):
        self.vocab: dict[bytes, int] = {}
        #: per shingle length: (length, multiplier, sorted codes, word numbers, number of the first token)
        self.lookup: list[tuple[int, int, np.ndarray, np.ndarray, int]] = []
        self.size = 0

    def learn(self, q: int, rows: np.ndarray) -> np.ndarray:
        """Token numbers of the shingles ``rows`` (shingles x q word numbers)."""
        odd = 0x9E3779B97F4A7C15
        while True:
            codes, first, same = np.unique(_codes(rows.T, odd), return_index=True, return_inverse=True)
            if (rows[first][same] == rows).all():
                break
            odd += 2  # two shingles with one code: another multiplier
        self.lookup.append((q, odd, codes, rows[first], self.size))
        numbers = (self.size + same).astype(np.int32)
        self.size += len(codes)
        return numbers

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and token numbers of all known shingles, by length, then position."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        known, places, numbers = ids >= 0, [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for q, odd, codes, rows, base in self.lookup:
            n = len(ids) - q + 1
            if n <= 0:
                continue
            all_known = known[:n].copy()
            for i in range(1, q):
                all_known &= known[i : n + i]
            at = np.flatnonzero(all_known)
            if not len(at):
                continue
            found = _codes((ids[at + i] for i in range(q)), odd)
            k = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            same = codes[k] == found
            for i in range(q):
                same &= ids[at + i] == rows[k, i]
            places.append(at[same].astype(np.int32))
            numbers.append((base + k[same]).astype(np.int32))
        return np.concatenate(places), np.concatenate(numbers)


class Queries:
    """All queries of a block of passages: places in one array of token numbers per shingle length."""

    def __init__(self, passages: list[Passage], shingle: int):
        self.finder, self.owners = Finder(), [p.owner for p in passages]
        vocab = self.finder.vocab
        flat = np.fromiter((vocab.setdefault(w, len(vocab)) for p in passages for w in p.words), np.int32)
        n = np.array([len(p.words) for p in passages], np.int64)
        size = np.array([min(len(p.words), p.window or len(p.words)) for p in passages], np.int64)
        starts, windows = np.cumsum(n) - n, n - size + 1
        q = np.minimum(size, shingle)
        self.tokens: dict[int, np.ndarray] = {}
        for k in sorted(set(q.tolist())):
            own = np.flatnonzero(q == k)
            at = np.repeat(starts[own], n[own] - k + 1) + _ramp(n[own] - k + 1)
            self.tokens[k] = np.full(len(flat), -1, np.int32)
            self.tokens[k][at] = self.finder.learn(k, flat[at[:, None] + np.arange(k)])
        exact = np.array([p.threshold >= 1 for p in passages], bool)
        own = np.repeat(np.flatnonzero(exact), windows[exact])
        at = starts[own] + _ramp(windows[exact])
        #: per exact query: place, words, shingle length, owner; equal windows of one passage once
        self.exact = np.stack([at, size[own], q[own], own], axis=1)[self._once(at, size[own], q[own], own)].astype(np.int32)
        #: per other query: (distinct tokens, number needed, words of a match at most, shingle length, owner)
        self.near = []
        for i in np.flatnonzero(~exact).tolist():
            p = passages[i]
            for place in range(starts[i], starts[i] + windows[i]):
                t = np.unique(self.tokens[int(q[i])][place : place + size[i] - q[i] + 1])
                self.near.append((t, math.ceil(p.threshold * len(t) - 1e-9), math.ceil(size[i] * p.longest), int(q[i]), i))

    def _once(self, at: np.ndarray, size: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which windows are not equal to an earlier one of the same passage."""
        code, m = _codes((own, size), 0x9E3779B97F4A7C15), size - q + 1
        step = lambda k, i: np.where((q == k) & (i < m), self.tokens[k][np.minimum(at + i, len(self.tokens[k]) - 1)], -1)
        for i in range(int(m.max(initial=0))):
            for k in self.tokens:
                code = _codes((code, step(k, i)), 0x9E3779B97F4A7C15)
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        first = first[back]
        differs = (own != own[first]) | (size != size[first])
        for i in range(int(m.max(initial=0))):
            for k in self.tokens:
                differs |= (q == k) & (i < m) & (self.tokens[k][np.minimum(at + i, len(self.tokens[k]) - 1)] != self.tokens[k][np.minimum(at[first] + i, len(self.tokens[k]) - 1)])
        return (first == np.arange(len(at))) | differs


class Matcher:
    """Verified matches of a block's queries, from the token hits of a document."""

    def __init__(self, queries: Queries, frequency: np.ndarray):
        """frequency: documents with each token."""
        self.tokens, self.owners, self.near = queries.tokens, queries.owners, queries.near
        rank = np.empty(len(frequency), np.int64)
        rank[np.argsort(frequency, kind="stable")] = np.arange(len(frequency))
        at, size, q, own = queries.exact.T
        rarest, best = np.zeros(len(at), np.int32), np.full(len(at), np.iinfo(np.int64).max)
        prefix = np.zeros(len(at), np.int32)
        for k, tokens in self.tokens.items():
            for i in range(int((size - q)[q == k].max(initial=-1)) + 1):
                use = np.flatnonzero((q == k) & (i <= size - q))
                t = tokens[at[use] + i]
                rarer = rank[t] < best[use]
                use, t = use[rarer], t[rarer]
                best[use], rarest[use], prefix[use] = rank[t], i, t
        order = np.argsort(prefix, kind="stable")
        self.prefix, self.rarest, self.exact = prefix[order], rarest[order], queries.exact[order]
        self.necessary = defaultdict(list)
        for i, (t, need, *_) in enumerate(self.near):
            for token in t[np.argsort(rank[t])][: len(t) - need + 1].tolist():
                self.necessary[token].append(i)

    def match(self, places: np.ndarray, numbers: np.ndarray, n_words: int) -> Iterator[tuple[object, int, int, float]]:
        """(owner, start, end, containment) of every match, ends exclusive; of a match below a threshold of 1 from its first to
        its last token."""
        yield from self._exact(places, numbers, n_words)
        if self.near:
            found = {i for t in set(numbers.tolist()) & self.necessary.keys() for i in self.necessary[t]}
            for i in sorted(found):
                yield from self._near(places, numbers, *self.near[i])

    def _exact(self, places: np.ndarray, numbers: np.ndarray, n_words: int) -> Iterator[tuple[object, int, int, float]]:
        first, last = np.searchsorted(self.prefix, numbers, "left"), np.searchsorted(self.prefix, numbers, "right")
        hit = np.flatnonzero(last > first)
        if not len(hit):
            return
        many = (last - first)[hit]
        query = np.repeat(first[hit], many) + _ramp(many)
        start = np.repeat(places[hit], many) - self.rarest[query]
        stay = (start >= 0) & (start + self.exact[query, 1] <= n_words)
        query, start = query[stay], start[stay]
        for k, tokens in self.tokens.items():
            own = self.exact[query, 2] == k
            w, s = query[own], start[own]
            if not len(w):
                continue
            here = np.full(n_words, -1, np.int32)
            of = (numbers >= tokens[tokens >= 0].min()) & (numbers <= tokens.max())
            here[places[of]] = numbers[of]
            i = 0
            while len(w):
                done = self.exact[w, 1] - k + 1 <= i
                for x, at in zip(w[done].tolist(), s[done].tolist(), strict=True):
                    yield self.owners[self.exact[x, 3]], at, at + int(self.exact[x, 1]), 1.0
                w, s = w[~done], s[~done]
                same = here[s + i] == tokens[self.exact[w, 0] + i]
                w, s, i = w[same], s[same], i + 1

    def _near(self, places: np.ndarray, numbers: np.ndarray, wanted: np.ndarray, need: int, longest: int, q: int, owner: int) -> Iterator[tuple[object, int, int, float]]:
        own = np.isin(numbers, wanted)
        hits = list(zip(places[own].tolist(), numbers[own].tolist(), strict=True))  # by position, as all have one length
        inside, right = defaultdict(int), 0
        for left, (start, token) in enumerate(hits):
            while right < len(hits) and hits[right][0] <= start + longest - q:
                inside[hits[right][1]] += 1
                right += 1
            if len(inside) >= need:
                yield self.owners[owner], start, hits[right - 1][0] + q, len(inside) / len(wanted)
            inside[token] -= 1
            if not inside[token]:
                del inside[token]


def _hits(docs: DataFrame, finder: Finder, keep: list[str], extra: Callable | None, extra_schema: str) -> DataFrame:
    """``keep``, n_words, places and numbers of each row, and what ``extra`` makes of its words."""
    shared = docs.sparkSession.sparkContext.broadcast(finder)
    rows = docs.select(*keep, utf8(F.col("text")).alias("__text"))
    made = ", ".join(["__n long, __places array<int>, __numbers array<int>", *([extra_schema] if extra_schema else [])])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text in b.column(len(keep)):
                words = alnum_words(text.as_py())
                out.append((len(words), *shared.value.find(words), *(extra(words) if extra else ())))
            yield pa.RecordBatch.from_pydict({c: b.column(i) for i, c in enumerate(keep)} | arrow_columns(made, out))

    return durable(rows.mapInArrow(run, schema), "hits")


def _matcher(hits: DataFrame, queries: Queries) -> Matcher:
    """Orders the block's tokens by the number of documents with each (at most one row per token comes to the driver)."""
    each = hits.where(F.size("__numbers") > 0).select(F.explode(F.array_distinct("__numbers")).alias("t"))
    counts = each.groupBy("t").agg(F.count("*").alias("n")).toArrow()
    frequency = np.zeros(queries.finder.size, np.int64)
    frequency[counts.column("t").to_numpy()] = counts.column("n").to_numpy()
    return Matcher(queries, frequency)


def _prepared(passages: list[Passage], shingle: int) -> Queries:
    return Queries([p for p in passages if p.words], shingle)


def filter_unmatched(docs: DataFrame, passages: list[Passage], shingle: int) -> DataFrame:
    """The rows of ``docs`` whose text no query matches, all columns kept; texts are read twice and never shuffled."""
    queries = _prepared(passages, shingle)
    plain, names = positional(docs)
    text = docs.columns.index("text")
    matcher = _matcher(_hits(plain.select(F.col(names[text]).alias("text")), queries.finder, [], None, ""), queries)
    shared = docs.sparkSession.sparkContext.broadcast((queries.finder, matcher))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, found = shared.value
        for b in slices(batches):
            clean = []
            for t in b.column(text):
                words = alnum_words((t.as_py() or "").encode())
                places, numbers = finder.find(words)
                clean.append(not len(places) or next(found.match(places, numbers, len(words)), None) is None)
            yield b.filter(pa.array(clean, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def match_queries(
    docs: DataFrame, passages: list[Passage], shingle: int, keep: list[str], make: Callable, make_schema: str, extra: Callable | None = None, extra_schema: str = ""
) -> DataFrame:
    """One row per document: ``keep``, what ``make(n_words, matches)`` returns, and the columns of ``extra(words)``.

    passages: one bounded block. docs has a column text and those of ``keep``.
    """
    queries = _prepared(passages, shingle)
    hits = _hits(docs, queries.finder, keep, extra, extra_schema)
    shared = docs.sparkSession.sparkContext.broadcast(_matcher(hits, queries))
    stay = [c for c in hits.columns if c not in ("__n", "__places", "__numbers")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.select(*stay).schema), make_schema])
    none = np.zeros(0, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in slices(batches, 4096):
            out = []
            for n, p, t in zip(b.column("__n").to_pylist(), b.column("__places"), b.column("__numbers"), strict=True):
                places, numbers = (x.values.to_numpy() if len(x) else none for x in (p, t))
                out.append(make(n, found.match(places, numbers, n) if len(p) else iter(())))
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in stay} | arrow_columns(make_schema, out))

    return hits.mapInArrow(run, schema)


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Row]]:
    """The distinct (id, text) rows in blocks of about BLOCK_BYTES at most (a longer passage is in a block with few others)."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), utf8(F.col(text_col)).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / BLOCK_BYTES))  # half full on average, as rows are dealt by hash
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()


def words_in(text: str) -> tuple[bytes, ...]:
    return tuple(alnum_words(text.encode()))
