"""Texts as sequences of repeating pieces: every distinct piece is encoded once, whole texts are gathered from the results.

A piece ends at a boundary over which the tokenizer never joins (see the operators), so the pieces' tokens in a row are
exactly the tokens of the text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Distinct pieces kept at once by a task; beyond it the table starts anew.
TABLE_PIECES = 600_000


class Slots(dict):
    """Numbers pieces in the order of their first appearance and remembers those that were not encoded yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, piece):
        self[piece] = slot = len(self)
        self.fresh.append(piece)
        return slot


class PieceTable:
    """Token ids by piece; ``encode`` maps a list of pieces to the number of ids of each, where they begin, and the ids.

    Where only the numbers are wanted, ``encode`` returns no ids.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = TABLE_PIECES) -> None:
        self.encode, self.most = encode, most
        self._empty()

    def _empty(self) -> None:
        self.slots = Slots()
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _add(self, fresh) -> None:
        counts, starts, ids = self.encode(fresh)
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, ids])

    def look_up(self, pieces: pa.Array) -> np.ndarray:
        """The slot of every piece; those met for the first time are encoded together. Slots hold until the next call."""
        if len(self.slots) > self.most:
            self._empty()
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slots = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))
        fresh, self.slots.fresh = self.slots.fresh, []
        if fresh:
            self._add(fresh)
        return slots[coded.indices.to_numpy(zero_copy_only=False)]

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of all pieces in a row."""
        counts = self.counts[slots]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[slots] - (ends - counts), counts) + np.arange(total)]


def by_text(lists: pa.ListArray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each list's elements; ``values`` has one for every element, in order."""
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def in_batches(pieces: list, limit: int):
    """Consecutive ranges of ``pieces`` of about ``limit`` bytes or characters each."""
    at, held = 0, 0
    for i, piece in enumerate(pieces):
        if held >= limit:
            yield at, i
            at, held = i, 0
        held += len(piece) + 1
    if at < len(pieces):
        yield at, len(pieces)
