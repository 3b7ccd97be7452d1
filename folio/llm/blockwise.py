"""Comparison block against block: groups streamed from sorted partitions, pairs as index arrays, results as spanning forests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import tidy


def inner_pairs(starts: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs within consecutive groups, ``most`` or one row's at a time."""
    row = np.repeat(starts + sizes, sizes) - np.arange(starts[0], starts[0] + sizes.sum()) - 1
    index = np.arange(starts[0], starts[0] + sizes.sum())
    done = np.concatenate([[0], np.cumsum(row)])
    at = 0
    while at < len(index):
        end = max(at + 1, int(np.searchsorted(done, done[at] + most, "right")) - 1)
        many = row[at:end]
        left = np.repeat(index[at:end], many)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        yield left, right
        at = end


def group_starts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def labels_of(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph given by its edges, and for each the smallest node of its component."""
    ids, ends = np.unique(pairs, return_inverse=True)
    x, y = ends.reshape(pairs.shape)
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def forest(pairs: np.ndarray) -> pa.RecordBatch:
    """Spanning edges (a, b), b the smallest of its component, of a graph given by its edges."""
    ids, root = labels_of(pairs)
    at = ids != root
    return pa.record_batch([pa.array(ids[at], pa.int64()), pa.array(root[at], pa.int64())], names=["a", "b"])


def by_group(placed: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str = "a long, b long", keys: int = 3) -> DataFrame:
    """What ``work`` finds in whole groups; the first ``keys`` columns of ``placed`` name a row's group, ``id`` orders it.

    Groups are streamed from sorted partitions, many small ones at once, so a small group costs no call of its own.
    """
    names = placed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            own = [np.asarray(b.column(i)) for i in range(keys)]
            if held and last != tuple(k[0] for k in own):
                yield work(pa.Table.from_batches(held).combine_chunks())
                held = []
            cut = int(group_starts(*own)[-1])
            if cut:
                yield work(pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks())
                held = []
            held.append(b.slice(cut))
            last = tuple(k[-1] for k in own)
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return placed.repartition(*names[:keys]).sortWithinPartitions(*names[:keys], "id").mapInArrow(tidy(run), schema)
