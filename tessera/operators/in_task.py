"""A sparse table as arrays in one task, its entries in mapped files.

Methods that depend on the order of rows need the whole table at one place.
Its rows arrive sorted; entries go to unnamed files on the task's own disk and
are mapped, so memory holds the state of the rows only, whatever the number of
entries.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Spool:
    """Numbers appended to a file, then mapped; few of them may stay in memory."""

    def __init__(self, dtype, in_memory: bool = False):
        self.dtype, self.n, self.parts = np.dtype(dtype), 0, []
        self.file = None if in_memory else tempfile.TemporaryFile()

    def append(self, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x, self.dtype)
        self.n += len(x)
        if self.file is None:
            self.parts.append(x)
        else:
            self.file.write(x.data)

    def mapped(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, self.dtype)
        if self.file is None:
            return np.concatenate(self.parts)
        self.file.flush()
        return np.frombuffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), self.dtype)


def mapped_zeros(shape: tuple[int, int], in_memory: int = 1 << 25) -> np.ndarray:
    """Zeros that can be written, in a sparse file if there are more than ``in_memory``."""
    if shape[0] * shape[1] <= in_memory:
        return np.zeros(shape)
    file = tempfile.TemporaryFile()
    file.truncate(shape[0] * shape[1] * 8)
    return np.frombuffer(mmap.mmap(file.fileno(), 0), float).reshape(shape)


def mapped_empty(n: int, dtype, in_memory: int = 1 << 22) -> np.ndarray:
    """Room for n numbers, in a file if there are more than ``in_memory``."""
    if n <= in_memory:
        return np.empty(n, dtype)
    file, dtype = tempfile.TemporaryFile(), np.dtype(dtype)
    file.truncate(n * dtype.itemsize)
    return np.frombuffer(mmap.mmap(file.fileno(), 0), dtype)


@dataclass
class SparseRows:
    """Row i has the entries ``start[i]`` to ``start[i + 1]`` of ``v`` (position of the column) and ``w``; None means that all are 1."""

    ids: np.ndarray
    columns: np.ndarray
    start: np.ndarray
    v: np.ndarray
    w: np.ndarray | None = None
    own: np.ndarray | None = None

    def chunks(self, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, slice]]:
        """First row, row behind the last, entries of each and their place, for at most ``size`` entries at a time."""
        m = len(self.v)
        for a in range(0, m, size):
            b = min(m, a + size)
            first, behind = int(np.searchsorted(self.start, a, "right")) - 1, int(np.searchsorted(self.start, b, "left"))
            yield first, behind, np.diff(np.clip(self.start[first : behind + 1], a, b)), slice(a, b)

    def sums(self) -> np.ndarray:
        """Of the entries of every row."""
        if self.w is None:
            return np.diff(self.start).astype(float)
        out = np.zeros(len(self.ids))
        for first, behind, each, at in self.chunks():
            out[first:behind] += np.bincount(np.repeat(np.arange(behind - first), each), self.w[at], behind - first)
        return out

    def turned(self) -> SparseRows:
        """Rows and columns exchanged; a chunk of entries is sorted at a time."""
        n, size = len(self.columns), 1 << 21
        counts = np.zeros(n, np.int64)
        for _, _, _, at in self.chunks(max(size, n)):
            counts += np.bincount(self.v[at], minlength=n)
        start = np.concatenate([[0], np.cumsum(counts)])
        free = start[:-1].copy()
        v = mapped_empty(len(self.v), np.int32 if len(self.ids) < 1 << 31 else np.int64)
        w = None if self.w is None else mapped_empty(len(self.v), float)
        for first, behind, each, at in self.chunks(size):
            column = self.v[at]
            order = np.argsort(column, kind="stable")
            column = column[order]
            begins = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            lengths = np.diff(np.append(begins, len(column)))
            place = np.arange(len(column)) + np.repeat(free[column[begins]] - begins, lengths)
            v[place] = np.repeat(np.arange(first, behind), each)[order]
            if w is not None:
                w[place] = self.w[at][order]
            free[column[begins]] += lengths
        return SparseRows(self.columns, self.ids, start, v, w)

    def induced(self, keep: np.ndarray) -> SparseRows:
        """The entries between the rows ``keep`` (ascending positions) of a graph."""
        new = np.full(len(self.ids), -1, self.v.dtype)
        new[keep] = np.arange(len(keep))
        counts = np.zeros(len(keep), np.int64)
        small = len(self.v) <= 1 << 22
        v, w = Spool(self.v.dtype, small), None if self.w is None else Spool(float, small)
        for first, behind, each, at in self.chunks():
            row, column = new[np.repeat(np.arange(first, behind), each)], new[self.v[at]]
            ok = (row >= 0) & (column >= 0)
            row = row[ok]
            if len(row):
                counts[row[0] : row[-1] + 1] += np.bincount(row - row[0])
            v.append(column[ok])
            if w is not None:
                w.append(self.w[at][ok])
        ids = self.ids[keep]
        return SparseRows(ids, ids, np.concatenate([[0], np.cumsum(counts)]), v.mapped(), None if w is None else w.mapped())

    def quotient(self, label: np.ndarray) -> SparseRows:
        """The graph of clusters with loops, weighted by the number of entries; one entry per pair is held in memory."""
        ids, of = np.unique(label, return_inverse=True)
        k = len(ids)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for first, behind, each, at in self.chunks():
            more, n = np.unique(of[np.repeat(np.arange(first, behind), each)] * k + of[self.v[at]], return_counts=True)
            keys, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        start = np.searchsorted(keys // k if k else keys, np.arange(k + 1))
        return SparseRows(ids, ids, start, keys % max(k, 1), counts.astype(float))


class RowSums:
    """Products of a table with a few vectors at once.

    Rows are cut to segments of at most ``most`` entries.  Segments of one
    length lie side by side in a mapped file, first their first entries, then
    their second ones, so each step adds up whole arrays, however rows differ.
    """

    def __init__(self, table: SparseRows, most: int = 64, size: int = 4096):
        each = np.diff(table.start)
        parts = -(-each // most)
        row = np.repeat(np.arange(len(each)), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = table.start[row] + most * nth
        length = np.minimum(most, table.start[row + 1] - begin)
        # The nth segments of all rows together: where columns ascend, they need about the same vector entries.
        order = np.lexsort((nth, length))
        begin, length = begin[order], length[order]
        self.n, self.row, self.blocks = len(each), row[order], []
        small = len(table.v) <= 1 << 22
        v, w = Spool(table.v.dtype, small), None if table.w is None else Spool(float, small)
        bounds = np.searchsorted(length, np.arange(1, most + 2))
        for deep, a, b in zip(range(1, most + 1), bounds, bounds[1:]):
            for s in range(a, b, size):
                at = (begin[s : min(b, s + size)] + np.arange(deep)[:, None]).ravel()
                v.append(table.v[at])
                if w is not None:
                    w.append(table.w[at])
                self.blocks.append((s, min(b, s + size), deep))
        self.v, self.w = v.mapped(), None if w is None else w.mapped()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x, sums, at = np.ascontiguousarray(x), np.zeros((len(self.row), x.shape[1])), 0
        for first, behind, deep in self.blocks:
            out = sums[first:behind]
            for _ in range(deep):
                picked = x.take(self.v[at : at + len(out)], axis=0)
                if self.w is not None:
                    picked *= self.w[at : at + len(out), None]
                out += picked
                at += len(out)
        return np.stack([np.bincount(self.row, c, self.n) for c in sums.T], 1)


def _packed(batches: Iterable[pa.RecordBatch], size: int = 1 << 20, most: int = 512) -> Iterator[pa.RecordBatch]:
    """Entries of one row as lists of at most ``most``, of ``size`` entries at a time; null weights are ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield _pack(held, most)
            held, n = [], 0
    if n:
        yield _pack(held, most)


def _pack(held: list[pa.RecordBatch], most: int) -> pa.RecordBatch:
    src, dst, weight = (pa.Table.from_batches(held).column(c).to_numpy() for c in ("src", "dst", "weight"))
    order = np.lexsort((dst, src))
    src, dst, weight = src[order], dst[order], weight[order]
    begins = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
    parts = -(-np.diff(np.append(begins, len(src))) // most)
    begins = np.repeat(begins, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    offsets = pa.array(np.append(begins, len(src)).astype(np.int32))
    kind = pa.list_(pa.float64())
    weights = pa.nulls(len(begins), kind) if (weight == 1.0).all() else pa.ListArray.from_arrays(offsets, pa.array(weight))
    return pa.record_batch({"src": pa.array(src[begins]), "dst": pa.ListArray.from_arrays(offsets, pa.array(dst)), "weight": weights})


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dst, given = batch.column("dst"), batch.column("weight").is_valid().to_numpy(zero_copy_only=False)
        each = dst.value_lengths().to_numpy()
        weight = np.ones(each.sum())
        if given.any():
            weight[np.repeat(given, each)] = batch.column("weight").flatten().to_numpy()
        yield pa.record_batch({"src": pa.array(np.repeat(batch.column("src").to_numpy(), each)), "dst": dst.flatten(), "weight": pa.array(weight)})


def _read(batches: Iterable[pa.RecordBatch], square: bool) -> SparseRows:
    """Rows sorted by ``src`` and ``dst``; one with a null ``dst`` stands for a row of the table itself, its weight is ``own``."""
    nodes, own, rows, counts = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    raw, w, ones = Spool(np.int64), Spool(float), True
    for batch in batches:
        src = batch.column("src").to_numpy()
        edge = batch.column("dst").is_valid().to_numpy(zero_copy_only=False)
        weight = batch.column("weight").to_numpy(zero_copy_only=False) if "weight" in batch.schema.names else None
        if not edge.all():
            nodes.append(src[~edge])
            own.append(np.full(len(nodes[-1]), np.nan) if weight is None else weight[~edge])
        src, dst = src[edge], batch.column("dst").drop_null().to_numpy()
        if not len(src):
            continue
        begins = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        rows.append(src[begins])
        counts.append(np.diff(np.append(begins, len(src))))
        if weight is not None:
            weight = weight[edge]
            if ones and not (weight == 1.0).all():
                ones = False
                for _ in range(0, raw.n, 1 << 20):
                    w.append(np.ones(min(1 << 20, raw.n - w.n)))
            if not ones:
                w.append(weight)
        raw.append(dst)
    rows, counts = np.concatenate(rows), np.concatenate(counts)
    ids, at = np.unique(np.concatenate(nodes) if square else rows, return_index=True)
    each = np.zeros(len(ids), np.int64)
    np.add.at(each, np.searchsorted(ids, rows), counts)
    dst, columns = raw.mapped(), ids
    if not square:
        columns = np.zeros(0, np.int64)
        for s in range(0, len(dst), 1 << 22):
            columns = np.union1d(columns, dst[s : s + (1 << 22)])
    v = Spool(np.int32 if len(columns) < 1 << 31 else np.int64)
    for s in range(0, len(dst), 1 << 20):
        v.append(np.searchsorted(columns, dst[s : s + (1 << 20)]))
    labels = np.nan_to_num(np.concatenate(own)[at], nan=-1.0).astype(np.int64) if square else None
    return SparseRows(ids, columns, np.concatenate([[0], np.cumsum(each)]), v.mapped(), None if ones else w.mapped(), labels)


def in_one_task(rows: DataFrame, kernel: Callable[[SparseRows], Iterator[pa.RecordBatch]], schema: str, square: bool = True) -> DataFrame:
    """What ``kernel`` yields for the table ``src, dst[, weight]``.

    A ``square`` table is a graph: rows with a null ``dst`` name its nodes.
    One that is not has weights and no nulls; its entries come in any order
    within a row and are packed by many tasks, so the one task sorts lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(_read(batches if square else _unpacked(batches), square))

    if not square:
        lists = rows.repartition("src").mapInArrow(_packed, "src long, dst array<long>, weight array<double>")
        return lists.repartition(1).sortWithinPartitions("src", F.col("dst")[0]).mapInArrow(run, schema)
    return rows.repartition(1).sortWithinPartitions("src", F.col("dst").asc_nulls_first()).mapInArrow(run, schema)


def in_batches(columns: dict[str, np.ndarray | pa.Array], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    whole = pa.table({k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in columns.items()})
    yield from whole.to_batches(max_chunksize=size)
