"""Part of a matrix product from cells at hand; numpy only, runs inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Inner indices multiplied as one dense product, and rows of a batch that leaves the task.
_DENSE_KEYS, _OUT_ROWS = 128, 1 << 17
#: A dense product of a pair of cells costs about so much less than a listed one.
_DENSE_GAIN = 16


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of every row's id among the ids at hand, those ids, and which number is null (or -1)."""
    empty = column.is_null().to_numpy()
    known, codes = np.unique(column.fill_null(0).to_numpy()[~empty], return_inverse=True)
    if not empty.any():
        return codes, known, -1
    out = np.full(len(empty), len(known))
    out[~empty] = codes
    return out, np.append(known, 0), len(known)


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    there = ~column.is_null().to_numpy()
    return column.fill_null(0.0).to_numpy(), there


def products(batches: Iterator[pa.RecordBatch], rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cells ``(id_3, id_4, value)`` of the product of the cells ``(_side, _id, _k, _v)``, ``_side`` true on the right.

    At most ``rows`` rows and about ``most`` cells of the result are added up at a time. A product
    of a null value counts for the cell, not for its sum, as in SQL.
    """
    sides: tuple[list, list] = ([], [])
    for batch in batches:
        table = pa.Table.from_batches([batch])
        right = table.column("_side")
        for side, part in ((1, table.filter(right)), (0, table.filter(pa.compute.invert(right)))):
            if part.num_rows:
                sides[side].append(part.select(["_id", "_k", "_v"]))
    if not sides[0] or not sides[1]:
        return
    left, right = (pa.concat_tables(parts) for parts in sides)
    sides[0].clear(), sides[1].clear()
    i, id_i, null_i = _ids(left.column("_id"))
    j, id_j, null_j = _ids(right.column("_id"))
    va, there_a = _values(left.column("_v"))
    vb, there_b = _values(right.column("_v"))
    keys, kb = np.unique(right.column("_k").to_numpy(), return_inverse=True)
    ka = left.column("_k").to_numpy()
    del left, right
    order = np.argsort(kb, kind="stable")
    j, vb, there_b = j[order], vb[order], there_b[order]
    first = np.searchsorted(kb[order], np.arange(len(keys) + 1))
    at = np.minimum(np.searchsorted(keys, ka), len(keys) - 1)
    met = np.flatnonzero(keys[at] == ka)
    order = met[np.argsort(i[met], kind="stable")]
    i, ka, va, there_a = i[order], at[order], va[order], there_a[order]
    whole = bool(there_a.all() and there_b.all())
    finite = bool(np.isfinite(va).all() and np.isfinite(vb).all())

    def column(ids, codes, null):
        return pa.array(ids[codes], mask=codes == null if null >= 0 else None)

    def emit(low, cells, sums, known):
        for start in range(0, len(cells), _OUT_ROWS):
            part = slice(start, start + _OUT_ROWS)
            y, x = np.divmod(cells[part], width)
            mask = None if known is None else ~known[part]
            yield pa.RecordBatch.from_arrays(
                [column(id_i, y + low, null_i), column(id_j, x, null_j), pa.array(sums[part], mask=mask)],
                names=["id_3", "id_4", "value"],
            )

    def listed(cells):
        """Places, products and whether they hold, of the pairs of the left cells given, some at a time."""
        ends = np.cumsum(first[ka[cells] + 1] - first[ka[cells]])
        start = 0
        while start < len(cells):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            part = cells[start:stop]
            low, size = first[ka[part]], first[ka[part] + 1] - first[ka[part]]
            there = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            place = np.repeat((i[part] - base) * width, size) + j[there]
            holds = None if whole else np.repeat(there_a[part], size) & there_b[there]
            yield place, np.repeat(va[part], size) * vb[there], holds
            start = stop

    def few(cells):
        found = list(listed(cells))
        places, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        worth = np.concatenate([f[1] for f in found])
        if whole:
            return places, np.bincount(back, worth, len(places)), None
        holds = np.concatenate([f[2] for f in found])
        return places, np.bincount(back[holds], worth[holds], len(places)), np.bincount(back, holds, len(places)) > 0

    def many(cells, dense, high):
        total, count = np.zeros(high * width), np.zeros(high * width, dtype=np.float32)
        known = count if whole else np.zeros(high * width, dtype=np.float32)
        for start in range(0, len(dense), _DENSE_KEYS):
            some = dense[start : start + _DENSE_KEYS]
            mine = cells[np.isin(ka[cells], some)]
            y, k = i[mine] - base, np.searchsorted(some, ka[mine])
            size = first[some + 1] - first[some]
            there = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            z = np.repeat(np.arange(len(some)), size)
            a, b = np.zeros((high, len(some))), np.zeros((len(some), width))
            np.add.at(a, (y, k), va[mine])
            np.add.at(b, (z, j[there]), vb[there])
            total += (a @ b).ravel()
            a, b = np.zeros(a.shape, dtype=np.float32), np.zeros(b.shape, dtype=np.float32)
            a[y, k], b[z, j[there]] = 1, 1
            count += (a @ b).ravel()
            if not whole:
                a[:], b[:] = 0, 0
                np.maximum.at(a, (y, k), there_a[mine].astype(np.float32))
                np.maximum.at(b, (z, j[there]), there_b[there].astype(np.float32))
                known += (a @ b).ravel()
        for place, worth, holds in listed(cells[~np.isin(ka[cells], dense)] if len(dense) else cells):
            if not whole:
                known += np.bincount(place, holds, high * width).astype(np.float32)
                worth = np.where(holds, worth, 0.0)
            total += np.bincount(place, worth, high * width)
            count += np.bincount(place, minlength=high * width).astype(np.float32)
        places = np.flatnonzero(count)
        return places, total[places], None if whole else known[places] > 0

    width = len(id_j)
    step = max(1, min(rows, most // width))
    at_row = np.searchsorted(i, np.arange(0, len(id_i) + step, step))
    for n, base in enumerate(range(0, len(id_i), step)):
        cells = np.arange(at_row[n], at_row[n + 1])
        if not len(cells):
            continue
        high = min(step, len(id_i) - base)
        seen, times = np.unique(ka[cells], return_counts=True)
        meets = times * (first[seen + 1] - first[seen])
        dense = seen[meets * _DENSE_GAIN >= high * width] if finite else seen[:0]
        if not len(dense) and meets.sum() * 4 < high * width:
            found = few(cells)
        else:
            found = many(cells, dense, high)
        yield from emit(base, *found)


#: Bytes of a packed cell, cells packed at a time, and cells of a row at most.
_PACKED, _AT_ONCE, _BLOB = 25, 1 << 20, 1 << 18


def _pack(ids: np.ndarray, keys: np.ndarray, values: np.ndarray, nulls: np.ndarray) -> bytes:
    """Cells byte plane by byte plane, which leaves the shuffle's compression little to store."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in (ids, keys, values)]
    return b"".join([*planes, nulls.tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // _PACKED
    raw = np.frombuffer(blob, dtype=np.uint8)
    one, two, three = (np.ascontiguousarray(raw[8 * n * c : 8 * n * (c + 1)].reshape(8, n).T).reshape(-1) for c in range(3))
    return one.view(np.int64), two.view(np.int64), three.view(np.float64), raw[24 * n :]


def _blobs(task: np.ndarray, right: bool, cells: tuple) -> Iterator[pa.RecordBatch]:
    """Rows ``(_t, _side, _cells)`` of the cells of every task, in the order of inner index and id."""
    order = np.lexsort((cells[0], cells[1], task))
    task, cells = task[order], [c[order] for c in cells]
    edges = np.flatnonzero(np.diff(task, prepend=-1)) if len(task) else np.zeros(0, dtype=np.int64)
    tasks, packed = [], []
    for low, high in zip(edges, [*edges[1:], len(task)]):
        for at in range(low, high, _BLOB):
            tasks.append(task[low])
            packed.append(_pack(*[c[at : min(at + _BLOB, high)] for c in cells]))
    for at in range(0, len(tasks), 256):
        part = slice(at, at + 256)
        n = len(tasks[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(tasks[part], dtype=np.int32)), pa.array(np.full(n, right)), pa.array(packed[part], pa.binary())],
            names=["_t", "_side", "_cells"],
        )


def _scattered(keys: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Cells ``(_side, _id, _k, _v)`` side by side, as arrays of about ``_AT_ONCE`` cells."""

    def flat(parts):
        table = pa.Table.from_batches(parts)
        right = table.column("_side")
        for side, some in ((False, table.filter(pa.compute.invert(right))), (True, table.filter(right))):
            if some.num_rows:
                id_, v = some.column("_id"), some.column("_v")
                nulls = id_.is_null().to_numpy().astype(np.uint8) | v.is_null().to_numpy().astype(np.uint8) << 1
                yield side, (id_.fill_null(0).to_numpy(), some.column("_k").to_numpy(), v.fill_null(0.0).to_numpy(), nulls)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _AT_ONCE:
            yield from flat(held)
            held, n = [], 0
    if held:
        yield from flat(held)


def by_key(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed cells by bucket of their inner index."""
    for right, cells in _read(batches):
        yield from _blobs(_scattered(cells[1], buckets), right, cells)


class Stripes:
    """The tasks of a striped product: ranges of left rows (``down``) by ranges of right columns (``across``),
    each dealt to ``inner`` tasks by inner index."""

    def __init__(self, down: list[int], across: list[int], inner: int):
        self.bounds = (np.array(down, dtype=np.int64), np.array(across, dtype=np.int64))
        self.across, self.inner = len(across) + 1, inner

    def own(self, right: bool, ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        """Number of the stripe of every cell, the first for a null id."""
        return np.where(nulls & 1, 0, np.searchsorted(self.bounds[right], ids, side="left"))

    def sent(self, right: bool, cells: tuple, keys: np.ndarray, stripes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The cells, packed for every task in which the other side has their inner index: in ``stripes``
        of its own at each of the ascending ``keys``."""
        low, high = np.searchsorted(keys, cells[1], side="left"), np.searchsorted(keys, cells[1], side="right")
        size = high - low
        ends = np.cumsum(size)
        own = self.own(right, cells[0], cells[3])
        at = 0
        while at < len(size):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + 2 * _AT_ONCE, side="right")))
            n = size[at:stop]
            cell = np.repeat(np.arange(at, stop), n)
            other = stripes[np.repeat(low[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            r, c = (other, own[cell]) if right else (own[cell], other)
            task = (r * self.across + c) * self.inner + _scattered(cells[1][cell], self.inner)
            yield from _blobs(task, right, tuple(x[cell] for x in cells))
            at = stop

    def from_buckets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sends the packed cells of a bucket, which holds all cells of its inner indices."""
        held: tuple[list, list] = ([], [])
        for batch in batches:
            for right, blob in zip(batch.column("_side").to_pylist(), batch.column("_cells")):
                held[right].append(_unpack(blob.as_py()))
        if not held[0] or not held[1]:
            return
        sides = [tuple(np.concatenate(x) for x in zip(*h)) for h in held]
        held[0].clear(), held[1].clear()
        known = []
        for right, cells in enumerate(sides):
            own = self.own(bool(right), cells[0], cells[3])
            order = np.lexsort((own, cells[1]))
            k, o = cells[1][order], own[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
            known.append((k[new], o[new]))
        for right in (False, True):
            yield from self.sent(right, sides[right], *known[not right])

    def direct(self, batches: Iterator[pa.RecordBatch], known: tuple) -> Iterator[pa.RecordBatch]:
        """Sends cells of inner indices whose stripes are known, ``known[side]`` being ``(keys, stripes)``."""
        for right, cells in _read(batches):
            yield from self.sent(right, cells, *known[not right])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells ``(_side, _id, _k, _v)`` of packed rows."""
    for batch in batches:
        for right, blob in zip(batch.column("_side").to_pylist(), batch.column("_cells")):
            ids, keys, values, nulls = _unpack(blob.as_py())
            made = [pa.array(np.full(len(ids), right)), pa.array(ids, mask=(nulls & 1) > 0), pa.array(keys), pa.array(values, mask=(nulls & 2) > 0)]
            yield pa.RecordBatch.from_arrays(made, names=["_side", "_id", "_k", "_v"])


#: Pairs of a list looked up at a time.
_LOOKED_UP = 1 << 21


def closed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(n_1, n_2, n_3)``: pairs of ``above`` of a node, where the second lies in the own list of the first.

    Rows are ``(_own, node, above)``: own lists are looked up, the others are those whose pairs are formed.
    """
    sides: tuple[list, list] = ([], [])
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for side, part in ((1, table.filter(table.column("_own"))), (0, table.filter(pa.compute.invert(table.column("_own"))))):
            if part.num_rows:
                sides[side].append(part)

    def flat(parts):
        node = np.concatenate([p.column("node").to_numpy() for p in parts])
        above = np.concatenate([pa.compute.list_flatten(p.column("above")).to_numpy() for p in parts])
        return node, above, np.concatenate([pa.compute.list_value_length(p.column("above")).to_numpy() for p in parts]).astype(np.int64)

    if not sides[0] or not sides[1]:
        return
    node, above, size = flat(sides[1])
    sides[1].clear()
    own = np.unique(node)
    seen, high = np.unique(above, return_inverse=True)
    known = np.sort(np.searchsorted(own, np.repeat(node, size)) * len(seen) + high)
    del node, above, high
    first, lists, size = flat(sides[0])
    sides[0].clear()
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    # middles: the places in lists whose node has an own list here
    row = np.minimum(np.searchsorted(own, lists), len(own) - 1)
    middles = np.flatnonzero(own[row] == lists)
    code = np.minimum(np.searchsorted(seen, lists), len(seen) - 1)
    code[seen[code] != lists] = -1
    ends = np.cumsum(size[of[middles]])
    at = 0
    while at < len(middles):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + _LOOKED_UP, side="right")))
        part = middles[at:stop]
        count = size[of[part]]
        third = np.repeat(start[of[part]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        second = np.repeat(part, count)
        there = code[third] >= 0
        second, third = second[there], third[there]
        asked = row[second] * len(seen) + code[third]
        hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        second, third = second[hit], third[hit]
        if len(second):
            yield pa.RecordBatch.from_arrays([pa.array(first[of[second]]), pa.array(lists[second]), pa.array(lists[third])], names=["n_1", "n_2", "n_3"])
        at = stop
