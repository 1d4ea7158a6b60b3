"""A shard of an inverted index with block maxima, and pruned BM25 search over it.

A shard numbers its documents so that like ones are neighbours: by their most
frequent term, which mostly tells the language, and then by length. BLOCK
neighbouring numbers are a block, and for each term and block the index knows the
largest frequency part of a score in it.

Search is block-max WAND with blocks cut by document number. The sum of the query
terms' maxima in a block bounds every score in it; from pivot to pivot, that is
from one block whose bound reaches the threshold to the next, everything between
is skipped unread. This holds for queries of any length. Queries are put in an order
in which like ones are neighbours and are asked TOGETHER: their bounds are one matrix
product over the terms they have, and so are their scores in the blocks that are
pivots for most of them; a block that is one for few is scored for those alone. Terms
of few documents have no maxima: their postings are summed first, and a block's bound
takes the largest such sum.

The threshold of a query is a score that k documents, of all shards, are known to
reach: ``floors`` finds it from some shards' blocks of highest bound, and ``search``
raises it from shard to shard. Scores from products only choose candidates, with a
margin for rounding; the candidates' scores are summed exactly, so that they don't
depend on shards or blocks, and ties are ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 32
#: Terms of a shard with block maxima, at most, and the least share of documents they are in;
#: postings by a document that queries asked together must have of a term to use its maxima; queries asked together; blocks that give a query its first threshold; relative room for
#: rounding; terms by whose presence queries are ordered.
FREQUENT, SHARE, WORTH, TOGETHER, FIRST, MARGIN, SIGNS = 2560, 1 / 96, 1 / 4, 256, 8, 1e-4, 8
K1, B = 1.2, 0.75


def frequency_part(tf: np.ndarray, length: np.ndarray, mean_length: float) -> np.ndarray:
    """What a term's frequency gives in a document, before its weight; below K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1e-9)))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges low..high one after another, and how many each has."""
    n = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), n


@dataclass
class Queries:
    """Queries' terms, one query after another, by their places among all terms asked for.

    ``ends`` has where each query starts, and the end; ``terms`` are the distinct terms in order.
    """

    ends: np.ndarray
    places: np.ndarray
    terms: np.ndarray
    weights: np.ndarray  # of each distinct term

    def __len__(self) -> int:
        return len(self.ends) - 1

    @staticmethod
    def of(ends: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, Queries]:
        """The order the queries are put in, and they in that order; a term has one weight in all queries."""
        terms, first, places = np.unique(terms, return_index=True, return_inverse=True)
        places, sizes = places.astype(np.int32), np.diff(ends)
        often = np.argsort(-np.bincount(places, minlength=len(terms)), kind="stable")[:SIGNS]
        bit = np.zeros(len(terms))
        bit[often] = 2.0 ** np.arange(SIGNS)[::-1][: len(often)]
        has = np.bincount(np.repeat(np.arange(len(sizes)), sizes), bit[places], minlength=len(sizes))
        order = np.argsort(-has, kind="stable")
        taken, _ = _ranges(ends[order], ends[order + 1])
        return order, Queries(np.concatenate([[0], np.cumsum(sizes[order])]), places[taken], terms, weights[first])

    def groups(self) -> Iterator[tuple[int, int]]:
        for first in range(0, len(self), TOGETHER):
            yield first, min(first + TOGETHER, len(self))


@dataclass
class _Asked:
    """Some queries as a shard sees them."""

    rows: np.ndarray  # the frequent terms that any of them has
    wanted: np.ndarray  # query x such term: weights
    rare: np.ndarray  # query x block x place: summed scores of the other terms
    bounds: np.ndarray  # query x block
    at: np.ndarray  # the shard's terms the queries have, by query
    weights: np.ndarray
    ends: np.ndarray


@dataclass
class Shard:
    ids: np.ndarray  # document ids, by number
    lengths: np.ndarray  # terms in each document
    terms: np.ndarray  # sorted uint64 term hashes
    starts: np.ndarray  # where each term's postings start; one more at the end
    docs: np.ndarray  # numbers, by term and then number
    tfs: np.ndarray
    mean_length: float = 0.0  # with what follows made by ready()
    parts: np.ndarray | None = None  # frequency parts, up to rounding
    row: np.ndarray | None = None  # a term's row among the frequent ones, or -1
    dense: np.ndarray | None = None  # frequent term x block x place: frequency parts
    maxima: np.ndarray | None = None  # frequent term x block
    df: np.ndarray | None = None  # documents of each frequent term
    own: np.ndarray | None = None  # where each document's postings start
    own_terms: np.ndarray | None = None  # postings by document, terms in order
    own_tfs: np.ndarray | None = None
    scored: int = 0  # blocks scored and blocks there were, over all queries
    there: int = 0

    @staticmethod
    def build(ids: list[int], counted: list[tuple[np.ndarray, np.ndarray]]) -> Shard:
        """counted: for each document its distinct terms and their frequencies."""
        lengths = np.array([int(f.sum()) for _, f in counted], np.int64)
        most = np.array([t[np.argmax(f)] if len(t) else 0 for t, f in counted], np.uint64)
        order = np.lexsort((lengths, most))
        counted = [counted[i] for i in order]
        sizes = np.array([len(t) for t, _ in counted], np.int64)
        flat = np.concatenate([t for t, _ in counted]) if len(counted) else np.empty(0, np.uint64)
        tfs = np.concatenate([f for _, f in counted]) if len(counted) else np.empty(0, np.uint32)
        docs = np.repeat(np.arange(len(counted), dtype=np.int32), sizes)
        by_term = np.argsort(flat, kind="stable")
        terms, first = np.unique(flat[by_term], return_index=True)
        starts = np.append(first, len(flat)).astype(np.int64)
        return Shard(np.array(ids, np.int64)[order], lengths[order], terms, starts, docs[by_term], tfs[by_term].astype(np.uint32))

    def document_frequencies(self) -> np.ndarray:
        return np.diff(self.starts)

    def ready(self, mean_length: float) -> Shard:
        """Make the block maxima and what scores blocks, for the mean length over all shards."""
        n, df, self.mean_length = len(self.ids), np.diff(self.starts), mean_length
        # K1 (1 - B + B length / mean) for each document, so that postings need one gather
        damped = (K1 * (1 - B + B * self.lengths / max(mean_length, 1e-9))).astype(np.float32)
        tfs = self.tfs.astype(np.float32)
        self.parts = tfs * np.float32(K1 + 1) / (tfs + damped[self.docs])
        frequent = np.argsort(-df, kind="stable")[:FREQUENT]
        frequent = frequent[df[frequent] >= n * SHARE]
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), -(-n // BLOCK), BLOCK), np.float32)
        flat = self.dense.reshape(len(frequent), -(-n // BLOCK) * BLOCK)
        for row, t in enumerate(frequent.tolist()):
            own = slice(self.starts[t], self.starts[t + 1])
            flat[row, self.docs[own]] = self.parts[own]
        self.maxima, self.df = self.dense.max(2, initial=0), df[frequent]
        return self

    def _by_document(self) -> None:
        if self.own is None:
            # numpy sorts numbers of 16 bits by radix
            order = np.argsort(self.docs.astype(np.uint16) if len(self.ids) < 2**16 else self.docs, kind="stable")
            self.own = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=len(self.ids)))])
            self.own_terms = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))[order]
            self.own_tfs = self.tfs[order]

    def _found(self, queries: Queries) -> np.ndarray:
        """For each distinct term of the queries its place in the shard, or -1."""
        at = np.searchsorted(self.terms, queries.terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == queries.terms, at, -1).astype(np.int32)

    def _asked(self, queries: Queries, found: np.ndarray, first: int, last: int) -> _Asked:
        low, high = queries.ends[first], queries.ends[last]
        places, size = queries.places[low:high], last - first
        at = found[places]
        here = np.flatnonzero(at >= 0)
        who = np.repeat(np.arange(size), np.diff(queries.ends[first : last + 1]))[here]
        at, weights = at[here], queries.weights[places[here]]
        row = self.row[at]
        # a frequent term that few of the queries have is cheaper by its postings
        worth = np.bincount(row + 1, minlength=len(self.dense) + 1)[1:] * self.df >= len(self.ids) * WORTH
        worth = np.append(worth, False)[row]
        frequent, other = np.flatnonzero(worth), np.flatnonzero(~worth)
        rows, column = np.unique(row[frequent], return_inverse=True)
        wanted = np.zeros((size, len(rows)), np.float32)
        wanted[who[frequent], column] = weights[frequent]
        blocks = self.dense.shape[1]
        posting, n = _ranges(self.starts[at[other]], self.starts[at[other] + 1])
        place = np.repeat(who[other] * (blocks * BLOCK), n) + self.docs[posting]
        rare = np.bincount(place, self.parts[posting] * np.repeat(weights[other].astype(np.float32), n), minlength=size * blocks * BLOCK)
        rare = rare.astype(np.float32).reshape(size, blocks, BLOCK)
        bounds = (wanted @ self.maxima[rows] + rare.max(2, initial=0)) * np.float32(1 + MARGIN)
        return _Asked(rows, wanted, rare, bounds, at, weights, np.searchsorted(who, np.arange(size + 1)))

    def _scores(self, asked: _Asked, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks, and query x document of them: scores up to rounding where ``pivots`` (query x block) are; elsewhere those or 0."""
        share = pivots.mean(0)
        most, few = np.flatnonzero(share >= 0.5), np.flatnonzero((share > 0) & (share < 0.5))
        out = np.zeros((len(pivots), len(most) + len(few), BLOCK), np.float32)
        if len(most):
            own = self.dense[np.ix_(asked.rows, most)].reshape(len(asked.rows), len(most) * BLOCK)
            out[:, : len(most)] = (asked.wanted @ own).reshape(len(pivots), -1, BLOCK)
            out[:, : len(most)] += asked.rare[:, most]
        for i, block in enumerate(few.tolist(), len(most)):
            who = np.flatnonzero(pivots[:, block])
            out[who, i] = asked.wanted[who] @ self.dense[asked.rows, block] + asked.rare[who, block]
        self.scored, self.there = self.scored + len(most) * len(pivots) + int(pivots[:, few].sum()), self.there + pivots.size
        return np.concatenate([most, few]), out.reshape(len(pivots), -1)

    def _exact(self, weight: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Correctly rounded scores of documents. weight: of every term of the shard, 0 for those not asked for."""
        out = np.zeros(len(numbers))
        for i, number in enumerate(numbers.tolist()):
            own = slice(self.own[number], self.own[number + 1])
            terms = weight[self.own_terms[own]]
            hit = np.flatnonzero(terms)
            parts = frequency_part(self.own_tfs[own][hit].astype(float), float(self.lengths[number]), self.mean_length)
            out[i] = math.fsum((parts * terms[hit]).tolist())
        return out

    def floors(self, queries: Queries, k: int) -> np.ndarray:
        """query x k: scores that documents of each query's FIRST blocks of highest bound reach, best first."""
        out = np.zeros((len(queries), k))
        if not len(self.terms):
            return out
        found = self._found(queries)
        for first, last in queries.groups():
            asked = self._asked(queries, found, first, last)
            pivots = np.zeros(asked.bounds.shape, bool)
            highest = np.argsort(-asked.bounds, axis=1, kind="stable")[:, :FIRST]
            np.put_along_axis(pivots, highest, True, axis=1)
            _, scores = self._scores(asked, pivots)
            if scores.shape[1] > k:
                scores = np.partition(scores, -k, axis=1)[:, -k:]
            out[first:last, : scores.shape[1]] = -np.sort(-scores, axis=1) * (1 - MARGIN)
        return out

    def search(self, queries: Queries, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores): for queries with any, the k best with a query term, best first, then least id.

        least: for each query a score that k documents of any shards reach; lower
        ones may be left out.
        """
        if not len(self.terms):
            return
        self._by_document()
        found, weight = self._found(queries), np.zeros(len(self.terms))
        for first, last in queries.groups():
            asked = self._asked(queries, found, first, last)
            floor = least[first:last].copy()
            pivots = (asked.bounds >= floor[:, None]) & (asked.bounds > 0)
            blocks, scores = self._scores(asked, pivots)
            hits = (scores >= (floor * (1 - MARGIN)).astype(np.float32)[:, None]) & (scores > 0)
            many = np.flatnonzero(hits.sum(1) > k)
            if len(many):
                floor[many] = np.maximum(floor[many], np.partition(scores[many], -k, axis=1)[:, -k])
                hits[many] &= scores[many] >= (floor[many] * (1 - MARGIN))[:, None]
            who, places = np.nonzero(hits)
            numbers = blocks[places // BLOCK] * BLOCK + places % BLOCK
            some, starts = np.unique(who, return_index=True)
            for q, own in zip(some.tolist(), np.split(numbers, starts[1:])):
                terms = slice(asked.ends[q], asked.ends[q + 1])
                weight[asked.at[terms]] = asked.weights[terms]
                exact = self._exact(weight, own)
                weight[asked.at[terms]] = 0
                top = np.lexsort((self.ids[own], -exact))[:k]
                yield first + q, self.ids[own[top]], exact[top]

    def to_bytes(self) -> bytes:
        head = np.array([len(self.ids), len(self.terms), len(self.docs)], "<i8")
        arrays = (self.ids, self.lengths, self.terms, self.starts.astype("<i8"), self.docs.astype("<i4"), self.tfs.astype("<u4"))
        return b"".join([head.tobytes(), *[a.tobytes() for a in arrays]])

    @staticmethod
    def from_bytes(data) -> Shard:
        n, t, p = np.frombuffer(data, "<i8", 3).tolist()
        at, out = 24, []
        for kind, size in (("<i8", n), ("<i8", n), ("<u8", t), ("<i8", t + 1), ("<i4", p), ("<u4", p)):
            out.append(np.frombuffer(data, kind, size, at))
            at += out[-1].nbytes
        return Shard(*out)
