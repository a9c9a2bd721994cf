"""The nearest entries of a block of labels by cosine: what a task does with the batches of entries that it reads.

A product of matrices tells which entries can be among a label's nearest. Only those are scored as functions.vectors.cosine
does, term after term, so scores and the order of equal ones are the same to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries and labels that are compared at a time, and by how much the product of matrices may differ from a score.
ENTRIES, LABELS, MARGIN = 2_048, 256, 1e-9


class Vectors:
    """Vectors by namespace; in a group all have as many elements, and as many of them before the first null (-1: no vector)."""

    def __init__(self, namespaces: pa.Array, ids: pa.Array, vectors: pa.Array) -> None:
        self.ids = np.asarray(ids.to_pylist())
        sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), dtype=np.int64)
        values = vectors.flatten()
        flat, starts = np.asarray(pc.fill_null(values.cast(pa.float64()), 0.0)), np.cumsum(sizes) - sizes
        whole = np.where(np.asarray(vectors.is_null()), -1, sizes)
        if values.null_count:
            gaps = np.flatnonzero(np.asarray(values.is_null()))
            row = np.searchsorted(starts, gaps, "right") - 1
            np.minimum.at(whole, row, gaps - starts[row])
        spaces = np.asarray(namespaces.to_pylist())
        self.groups: dict[str, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for space in np.unique(spaces):
            own = np.flatnonzero(spaces == space)
            kinds, kind = np.unique(np.stack([sizes[own], whole[own]]), axis=1, return_inverse=True)
            split = [(own[kind.ravel() == k], size, told) for k, (size, told) in enumerate(kinds.T.tolist())]
            self.groups[str(space)] = [(rows, flat[starts[rows][:, None] + np.arange(size)], told) for rows, size, told in split]


def _first_copies(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Which of rows, in their order, have one of the most smallest ids among equal vectors."""
    if vectors.shape[1] == 0:
        same = np.zeros(len(rows), dtype=np.int64)
    else:
        same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids[rows], same))
    group, own = same[order], ids[rows][order]
    new = np.r_[True, group[1:] != group[:-1]]
    nth = np.cumsum(new | np.r_[True, own[1:] != own[:-1]])  # of different ids, over all groups
    return np.sort(order[nth - nth[new][np.cumsum(new) - 1] < most])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up from the first term on."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Best:
    """The top entries so far of each label."""

    def __init__(self, labels: Vectors, least: float | None, top: int) -> None:
        self.labels, self.least, self.top = labels, least, top
        self.floor = np.full(len(labels.ids), -np.inf if least is None else least)
        self.found: tuple[np.ndarray, ...] | None = None  # label, entry, score, whether it has a score

    def take(self, entries: Vectors) -> None:
        with np.errstate(all="ignore"):
            for space, told in entries.groups.items():
                for rows, vectors, whole in told:
                    first = _first_copies(entries.ids, rows, vectors, self.top + 1)
                    ids, vectors = entries.ids[rows[first]], vectors[first]
                    for own, wanted, complete in self.labels.groups.get(space, []):
                        size = min(wanted.shape[1], vectors.shape[1])
                        known = size <= min(whole, complete)
                        if not known and self.least is not None:
                            continue
                        parts = [slice(at, at + LABELS) for at in range(0, len(own), LABELS)]
                        met = [m for p in parts if (m := self._meet(own[p], wanted[p, :size], ids, vectors[:, :size], known)) is not None]
                        if met:
                            self._keep(*map(np.concatenate, zip(*met)))

    def _meet(self, rows: np.ndarray, wanted: np.ndarray, ids: np.ndarray, vectors: np.ndarray, known: bool) -> tuple[np.ndarray, ...] | None:
        """Label, entry, score, whether it has one: of the pairs that may be among the best."""
        order = np.argsort(ids, kind="stable")
        low, high = (np.searchsorted(ids, self.labels.ids[rows], side, sorter=order) for side in ("left", "right"))
        itself = [(k, order[low[k] : high[k]]) for k in np.flatnonzero(high > low)]
        if not known:
            may = np.zeros((len(rows), len(ids)), dtype=bool)
            may[:, order[: self.top + 1 if len(set(ids.tolist())) == len(ids) else None]] = True
        else:
            a, b = np.sqrt(_dots(wanted, wanted)), np.sqrt(_dots(vectors, vectors))
            near = (wanted / np.where(a == 0, 1, a)[:, None]) @ (vectors / np.where(b == 0, 1, b)[:, None]).T
            for k, same in itself:
                near[k, same] = -np.inf
            floor = self.floor[rows]
            if len(ids) > self.top and np.isneginf(floor).any():
                floor = np.fmax(floor, np.partition(near, -self.top, axis=1)[:, -self.top])
            may = ~(near < (floor - MARGIN)[:, None])
        for k, same in itself:
            may[k, same] = False
        label, entry = np.nonzero(may)
        if not label.size:
            return None
        score = np.zeros(len(label))
        if known:
            norms = a[label] * b[entry]
            score = np.where(norms == 0, 0.0, _dots(wanted[label], vectors[entry]) / norms)
        if self.least is not None:
            enough = (score >= self.least) | np.isnan(score)
            label, entry, score = label[enough], entry[enough], score[enough]
        return (rows[label], ids[entry], score, np.full(len(label), known)) if label.size else None

    def _keep(self, *new: np.ndarray) -> None:
        label, entry, score, known = new if self.found is None else map(np.concatenate, zip(self.found, new))
        worth = np.where(known, np.where(np.isnan(score), np.inf, score), -np.inf)
        order = np.lexsort((entry, -worth, label))
        label, entry, score, known, worth = (x[order] for x in (label, entry, score, known, worth))
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        nth = np.arange(len(label)) - np.repeat(first, np.diff(np.r_[first, len(label)]))
        last = nth == self.top - 1
        self.floor[label[last]] = np.maximum(self.floor[label[last]], worth[last])
        self.found = tuple(x[nth < self.top] for x in (label, entry, score, known))


def nearest(labels: Vectors, batches: Iterable[pa.RecordBatch], least: float | None, top: int) -> tuple[np.ndarray, ...] | None:
    """Place of the label, entry, score, whether it has one: the top of batches (namespace, entry, vector) for each label; null scores last, NaN first."""
    best = Best(labels, least, top)
    for batch in batches:
        for at in range(0, batch.num_rows, ENTRIES):
            best.take(Vectors(*batch.slice(at, ENTRIES).columns))
    return best.found
