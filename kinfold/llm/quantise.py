"""Product quantisation of unit vectors: coarse lists and residual subspace codes.

Both bounds that a search needs are exact, so nothing within a distance is lost:
which lists can hold a vector within the distance of a query, and by how much
the distance to a vector's code can differ from the distance to the vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Entries of a subspace, and codes of its book.
WIDTH = 4
CODES = 256
#: Room for rounding in every bound.
SLACK = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to the rows of ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1), 0)


def centres(rows: np.ndarray, k: int, turns: int, seed: int = 7) -> np.ndarray:
    """k-means; fewer than ``k`` where there are fewer rows."""
    rng = np.random.default_rng(seed)
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    now = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(turns):
        near = np.concatenate([squared(part, now).argmin(axis=1) for part in np.array_split(rows, len(rows) // 4096 + 1)])
        sums = np.stack([np.bincount(near, rows[:, j], len(now)) for j in range(rows.shape[1])], axis=1)
        count = np.bincount(near, minlength=len(now))
        now = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], now)
    return now


@dataclass
class Quantiser:
    lists: np.ndarray
    #: subspaces x codes x WIDTH
    books: np.ndarray

    @staticmethod
    def fit(rows: np.ndarray, lists: int, turns: int = 8) -> Quantiser:
        coarse = centres(rows, lists, turns)
        rest = rows - coarse[squared(rows, coarse).argmin(axis=1)] if len(rows) else rows
        books = np.zeros((rows.shape[1] // WIDTH, CODES, WIDTH))
        for m, book in enumerate(books):
            found = centres(rest[:, m * WIDTH:(m + 1) * WIDTH], CODES, turns)
            book[:] = found[np.arange(CODES) % len(found)]
        return Quantiser(coarse, books)

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest list of each row, and the distance to its centre."""
        near = squared(rows, self.lists).argmin(axis=1)
        return near, np.sqrt(((rows - self.lists[near]) ** 2).sum(axis=1))

    def encode(self, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, one for each subspace, and the distance of each row to its code."""
        rest = rows - self.lists[near]
        codes = np.empty((len(rows), len(self.books)), np.uint8)
        error = np.zeros(len(rows))
        for m, book in enumerate(self.books):
            part = rest[:, m * WIDTH:(m + 1) * WIDTH]
            codes[:, m] = squared(part, book).argmin(axis=1)
            error += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def probes(self, rows: np.ndarray, near: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
        """rows x lists: whether a list can hold a vector within ``reach``. It can't
        if the row is farther than that from the ball of the list (``radius``) or
        from the half space of the vectors nearer to that list than to its own."""
        d2 = squared(rows, self.lists)
        own = d2[np.arange(len(rows)), near][:, None]
        apart = np.sqrt(squared(self.lists, self.lists))[near]
        ball = np.sqrt(d2) <= radius[None, :] + reach + 1e-6
        return ball & (d2 - own <= 2 * apart * (reach + 1e-6) + SLACK)

    def distances(self, rows: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of rows to codes of list ``at``: a table of each row's
        distances to every code of a book, looked up and summed over the subspaces."""
        rest = rows - self.lists[at]
        total = np.zeros((len(rows), len(codes)))
        for m, book in enumerate(self.books):
            look_up = squared(rest[:, m * WIDTH:(m + 1) * WIDTH], book)
            total += look_up[:, codes[:, m]]
        return np.sqrt(total)
