"""Exact merges of many words at once, by arrays: in each round every word merges its pair of lowest rank, the leftmost of equals."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

NONE = np.int64(1 << 40)


class Merges:
    """A table of pairs of ids: the rank of each pair and the id that it becomes."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]]) -> None:
        """pairs: (left, right, rank, made); ranks are below NONE."""
        table = np.array(sorted(pairs), np.int64).reshape(-1, 4)
        self.keys, self.ranks, self.made = table[:, 0] << 32 | table[:, 1], table[:, 2], table[:, 3]

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id made) of each pair; the rank is NONE where the table does not have it."""
        if not len(self.keys):
            return np.full(len(left), NONE), np.zeros(len(left), np.int64)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE), self.made[at]

    def merged(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The merged ids of each word as little-endian unsigned 32-bit integers; ids holds the words one after the other, none empty."""
        out: list[bytes] = [b""] * len(lengths)
        ids, lengths, names = ids.astype(np.int64), lengths.astype(np.int64), np.arange(len(lengths))
        starts = np.cumsum(lengths) - lengths
        rank, made = np.full(len(ids), NONE), np.zeros(len(ids), np.int64)
        rank[:-1], made[:-1] = self._found(ids[:-1], ids[1:])
        rank[starts + lengths - 1] = NONE  # the last id of a word has no pair
        while len(names):
            place = np.arange(len(ids))
            least = np.minimum.reduceat(rank * len(ids) + place, starts)
            going = least < NONE * len(ids)
            if not going.all():
                data = ids.astype("<u4").tobytes()
                for k in np.flatnonzero(~going).tolist():
                    out[names[k]] = data[4 * starts[k] : 4 * (starts[k] + lengths[k])]
                stays = np.repeat(going, lengths)
                at = (np.cumsum(stays) - 1)[least[going] % len(ids)]
                ids, rank, made, names, lengths = ids[stays], rank[stays], made[stays], names[going], lengths[going]
            else:
                at = least % len(ids)
            if not len(names):
                break
            ids[at] = made[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            last = at + 1 == np.cumsum(lengths) - 1  # the merged id is the last one of its word
            ids, rank, made = ids[stays], rank[stays], made[stays]
            at = at - np.arange(len(at))
            lengths = lengths - 1
            starts = np.cumsum(lengths) - lengths
            rank[at] = NONE
            after, before = at[~last], at[at > starts] - 1
            for changed in (after, before):
                rank[changed], made[changed] = self._found(ids[changed], ids[changed + 1])
        return out
