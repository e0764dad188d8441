"""The k best candidates of each of many queries, kept while candidates stream by. Equal scores go to the least id."""

from __future__ import annotations

import numpy as np

#: What a place of a ranking holds: a candidate, a candidate without an id (after all that have one), or nothing yet.
NAMED, UNNAMED, EMPTY = np.int8(0), np.int8(1), np.int8(2)
#: The score that every candidate reaches while a ranking is not full. Scores are greater than the least long.
ANY = np.iinfo(np.int64).min + 1


class Best:
    """Rankings of n queries with k places each. Memory does not grow with the candidates."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.zeros((n, k), dtype=np.int64)
        self.id = np.zeros((n, k), dtype=np.int64)
        self.state = np.full((n, k), EMPTY)

    def floor(self, at: slice | np.ndarray = slice(None)) -> np.ndarray:
        """The score from which a candidate can still get into a query's ranking; equal ones can, by their ids."""
        return np.where(self.state[at, -1] == EMPTY, ANY, self.score[at, -1])

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, state: np.ndarray) -> None:
        """Takes up pairs of a query and a candidate, as many of a query as there are."""
        rows = np.unique(query)
        if not len(rows):
            return
        q = np.concatenate([np.repeat(rows, self.k), query])
        s, i, t = (np.concatenate([held[rows].ravel(), new]) for held, new in ((self.score, score), (self.id, ids), (self.state, state)))
        # ~ turns the order of longs round without overflow
        order = np.lexsort((i, t, ~s, t == EMPTY, q))
        q, s, i, t = q[order], s[order], i[order], t[order]
        begins = np.searchsorted(q, rows)
        place = np.arange(len(q)) - begins[np.searchsorted(rows, q)]
        kept = place < self.k
        at = (q[kept], place[kept])
        self.score[at], self.id[at], self.state[at] = s[kept], i[kept], t[kept]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id, whether it has an id) of all candidates in the rankings."""
        query, place = np.nonzero(self.state != EMPTY)
        return query, self.score[query, place], self.id[query, place], self.state[query, place] == NAMED
