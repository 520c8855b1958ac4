"""Arrow kernels on whole maps: resizing, masks, and labels under masks.

A batch of maps is one dense array; a map is resized by bilinear interpolation in the task that
needs its pixels, and only what is asked for leaves it: areas, label counts, or pixel rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Pixels resized in one go (16 MB of doubles).
PIXELS = 1 << 21


@lru_cache(maxsize=256)
def _between(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second source index of every output index, and the share of the second."""
    at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    low = np.floor(at)
    # clamped indices are the same as a filter normalised at the border
    return np.maximum(low, 0).astype(np.int64), np.minimum(low + 1, n_in - 1).astype(np.int64), at - low


@lru_cache(maxsize=256)
def _around(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """``(index, weight)[tap, output]`` of the widened triangle filter of a shrinking axis."""
    scale = n_in / n_out
    center = (np.arange(n_out) + 0.5) * scale
    low = np.maximum(np.floor(center - scale - 0.5), 0).astype(np.int64)
    high = np.minimum(np.ceil(center + scale + 0.5), n_in).astype(np.int64) - 1
    index = low + np.arange(int((high - low).max()) + 1)[:, None]
    weight = np.where(index <= high, np.maximum(0.0, 1 - np.abs(index + 0.5 - center) / scale), 0.0)
    total = np.zeros(n_out)
    for row in weight:
        total += row
    return np.minimum(index, n_in - 1), weight / total


def _along(values: np.ndarray, axis: int, n_out: int) -> np.ndarray:
    n_in = values.shape[axis]
    shape = [1] * values.ndim
    shape[axis] = n_out
    if n_in <= n_out:
        first, second, share = _between(n_in, n_out)
        a, b = values.take(first, axis), values.take(second, axis)
        return a + (b - a) * share.reshape(shape)
    index, weight = _around(n_in, n_out)
    out = 0.0
    for i, w in zip(index, weight):
        out = out + np.where((w > 0).reshape(shape), w.reshape(shape) * values.take(i, axis), 0.0)
    return out


def resize(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Maps ``[map, y, x]`` resized bilinearly; an axis that shrinks takes the widened filter."""
    with np.errstate(invalid="ignore"):
        return _along(_along(values, 1, height), 2, width)


def arrays(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the places where its rows start (and end); null is NaN."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    offsets = whole.offsets.to_numpy().astype(np.int64)
    flat = whole.values.slice(offsets[0], offsets[-1] - offsets[0])
    return flat.to_numpy(zero_copy_only=False), offsets - offsets[0]


def like_maps(table: pa.Table | pa.RecordBatch, oh: np.ndarray, ow: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, resized maps)`` of rows with one size before and after, a bounded number at a time.

    ``h``, ``w`` and ``values`` are columns; rows whose values do not fill their map are refused.
    """
    flat, at = arrays(table.column("values"))
    h, w = (table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "w"))
    if (np.diff(at) != h * w).any():
        raise ValueError("a map does not hold h × w values")
    shapes = np.stack([h, w, oh, ow], axis=1)
    for shape, rows in groups_of(shapes):
        sh, sw, th, tw = (int(x) for x in shape)
        step = max(1, PIXELS // max(th * tw, 1))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            cells = flat[at[part][:, None] + np.arange(sh * sw)]
            yield part, resize(cells.reshape(len(part), sh, sw).astype(np.float64), th, tw)


def groups_of(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct rows of ``keys`` and the places of each, in order."""
    if not len(keys):
        return
    own, inverse = np.unique(keys, axis=0, return_inverse=True)
    order = np.argsort(inverse.ravel(), kind="stable")
    borders = np.searchsorted(inverse.ravel()[order], np.arange(len(own) + 1))
    for i, key in enumerate(own):
        yield key, order[borders[i] : borders[i + 1]]


def count_over(limit: np.ndarray, table: pa.RecordBatch, height: int, width: int) -> np.ndarray:
    """Pixels over its limit of every map enlarged to ``height × width``; maps that cannot reach it are not enlarged."""
    flat, at = arrays(table.column("values"))
    out = np.zeros(table.num_rows, dtype=np.int64)
    filled = np.diff(at) > 0
    peak = np.full(table.num_rows, -np.inf)
    if filled.any():
        peak[filled] = np.fmax.reduceat(flat, at[:-1][filled])
    with np.errstate(invalid="ignore"):
        able = np.flatnonzero(peak > limit)
    some = table.take(pa.array(able)) if len(able) < table.num_rows else table
    size = np.full(len(able), 1)
    for rows, v in like_maps(some, size * height, size * width) if len(able) else ():
        out[able[rows]] = (v > limit[able[rows]][:, None, None]).sum(axis=(1, 2))
    return out


def labels_under(maps: pa.Table, facts: pa.Table, kind: pa.Schema) -> pa.Table:
    """Per map with a pixel over its threshold: the area of its mask and the labels under it.

    ``facts`` holds rows of some images: their size (``channel`` -1), their image-level labels (-2), and label
    maps (0 and up). Pixels that a label map lacks have no label.
    """
    size: dict = {}
    whole: dict = {}
    layers: dict = {}
    imgs, channel = facts["img"].to_pylist(), facts["channel"].to_numpy()
    flat, at = arrays(facts["labels"].fill_null([]) if facts["labels"].null_count else facts["labels"])
    sh, sw = facts["sh"].to_pylist(), facts["sw"].to_pylist()
    for i, img in enumerate(imgs):
        if channel[i] == -1:
            size[img] = (sh[i], sw[i])
        else:
            (whole if channel[i] == -2 else layers).setdefault(img, []).append(flat[at[i] : at[i + 1]])
    names = maps["img"].to_pylist()
    kept = [i for i, img in enumerate(names) if img in size]
    if not kept:
        return kind.empty_table()
    maps = maps.take(pa.array(kept)).combine_chunks()
    number: dict = {}
    image = np.array([number.setdefault(names[i], len(number)) for i in kept])
    name = list(number)
    target = np.array([size[img] for img in name], dtype=np.int64)[image]
    limit, unit = maps["thresh"].to_numpy(), maps["unit"]
    found_rows, areas, hit_map, hit_label, hit_count = [], [], [], [], []
    for rows, v in like_maps(maps, target[:, 0], target[:, 1]):
        pixels = v.shape[1] * v.shape[2]
        m, p = np.nonzero((v > limit[rows][:, None, None]).reshape(len(rows), pixels))
        area = np.bincount(m, minlength=len(rows))
        edges = np.concatenate([[0], np.cumsum(area)])
        for own, places in groups_of(image[rows][:, None]):
            img = name[own[0]]
            under = np.concatenate([p[edges[k] : edges[k + 1]] for k in places])
            owner = np.repeat(np.arange(len(places)), area[places])
            keys = [np.zeros(0, np.int64)]
            for layer in layers.get(img, ()):
                inside = under < len(layer)
                label = layer[under[inside]]
                label = np.where(np.isnan(label), 0, label).astype(np.int64) if label.dtype.kind == "f" else label.astype(np.int64)
                real = label > 0
                keys.append(owner[inside][real] << 32 | label[real])
            counted, times = np.unique(np.concatenate(keys), return_counts=True)
            hit_map.append(rows[places[counted >> 32]])
            hit_label.append(counted & 0xFFFFFFFF)
            hit_count.append(times)
            for labels in whole.get(img, ()):
                for label in labels[labels == labels].astype(np.int64).tolist():
                    some = places[area[places] > 0]
                    hit_map.append(rows[some])
                    hit_label.append(np.full(len(some), label))
                    hit_count.append(area[some])
        found_rows.append(rows[area > 0])
        areas.append(area[area > 0])
    rows, area = np.concatenate(found_rows), np.concatenate(areas)
    order = np.argsort(rows, kind="stable")
    rows, area = rows[order], area[order]
    of = np.concatenate(hit_map)
    order = np.argsort(of, kind="stable")
    of = of[order]
    offsets = np.append(np.searchsorted(of, rows), len(of))
    entry = kind.field("hits").type.value_type
    pairs = pa.StructArray.from_arrays(
        [pa.array(np.concatenate(c)[order]).cast(f.type) for c, f in zip((hit_label, hit_count), entry)], fields=list(entry)
    )
    hits = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)
    taken = pa.array(rows)
    return pa.table([maps["img"].take(taken), unit.take(taken), pa.array(area), hits.cast(kind.field("hits").type)], names=kind.names).cast(kind)


def pixel_rows(batch: pa.RecordBatch, oh: np.ndarray, ow: np.ndarray, limit: np.ndarray | None, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns ``kept`` and ``py, px, v`` for every pixel of the resized maps (or those over the limit)."""
    others = batch.select(kept)
    for rows, v in like_maps(batch, oh, ow):
        shape = v.shape
        chosen = np.nonzero(v > limit[rows][:, None, None]) if limit is not None else tuple(x.ravel() for x in np.indices(shape))
        left = others.take(pa.array(rows[chosen[0]]))
        columns = [left.column(i) for i in range(left.num_columns)]
        new = [pa.array(chosen[1].astype(np.int32)), pa.array(chosen[2].astype(np.int32)), pa.array(v[chosen])]
        yield pa.RecordBatch.from_arrays(columns + new, names=[*kept, "py", "px", "v"])


def gather(batches: Iterator[pa.RecordBatch], height: int, width: int) -> Iterator[pa.RecordBatch]:
    """Maps ``(img, unit, values, held)`` of cells ``(img, unit, y, x, v)`` that are sorted by map; a map may run over batches."""
    left: pa.Table | None = None
    for batch in batches:
        cells = pa.Table.from_batches([batch])
        cells = cells if left is None else pa.concat_tables([left, cells]).combine_chunks()
        if not cells.num_rows:
            continue
        first = _starts(cells)
        yield from _gather(cells.slice(0, first[-1]), first[:-1], height, width)
        left = cells.slice(first[-1])
    if left is not None:
        yield from _gather(left, np.zeros(1, np.int64), height, width)


def _starts(cells: pa.Table) -> np.ndarray:
    """Rows where another map begins; null is a value like others."""
    new = np.zeros(cells.num_rows, dtype=bool)
    new[0] = True
    for name in ("img", "unit"):
        code = cells[name].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        code = code.indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _gather(cells: pa.Table, first: np.ndarray, height: int, width: int) -> Iterator[pa.RecordBatch]:
    if not len(first):
        return
    size = height * width
    own = np.zeros(cells.num_rows, dtype=np.int64)
    own[first[1:]] = 1
    at = np.cumsum(own) * size + cells["y"].to_numpy() * width + cells["x"].to_numpy()
    v = cells["v"].combine_chunks()
    known = v.is_valid().to_numpy(zero_copy_only=False)
    held = np.zeros(len(first) * size, dtype=bool)
    held[at] = True
    lost = np.ones(len(held), dtype=bool)
    lost[at[known]] = False
    total = np.bincount(at[known], v.drop_null().to_numpy(zero_copy_only=False), len(held))
    ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * size)
    keys = [cells[c].take(pa.array(first)).combine_chunks() for c in ("img", "unit")]
    lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(total, mask=lost), pa.array(held))]
    yield pa.RecordBatch.from_arrays([*keys, *lists], names=["img", "unit", "values", "held"])


def _weigh(values: np.ndarray, axis: int, entries: list[tuple[int, int, float]], n_out: int) -> np.ndarray:
    """Weighted sums ``(o, i, w)`` along an axis, entry by entry, so that a NaN goes only where its weight does."""
    shape = list(values.shape)
    shape[axis] = n_out
    out = np.zeros(shape)
    source, target = np.moveaxis(values, axis, 0), np.moveaxis(out, axis, 0)
    with np.errstate(invalid="ignore", over="ignore"):
        for o, i, w in entries:
            target[o] += w * source[i]
    return out


def _weighted(batch: pa.RecordBatch, wy: list, wx: list, pixels: int, shape: tuple[int, int]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """``(maps, pixels, whether they have a number)`` of gathered maps, a bounded number at a time."""
    height, width = (max(i for _, i, _ in w) + 1 for w in (wy, wx))
    values = batch.column("values").flatten()
    known = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, height, width)
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, height, width)
    step = max(1, pixels // max(shape[0] * shape[1], 1))
    for lo in range(0, batch.num_rows, step):
        some = slice(lo, lo + step)
        # the maps on the last axis, where numpy runs along
        v = _grid(flat[some], wy, wx, shape)
        yield some, v, _reach(known[some], wy, wx, shape)


def _grid(some: np.ndarray, wy: list, wx: list, shape: tuple[int, int]) -> np.ndarray:
    inner = _weigh(np.ascontiguousarray(some.transpose(1, 2, 0)), 0, wy, shape[0])
    return np.ascontiguousarray(_weigh(inner, 1, wx, shape[1]).transpose(2, 0, 1))


def _reach(some: np.ndarray, wy: list, wx: list, shape: tuple[int, int]) -> np.ndarray:
    """Pixels to which a place that is set has an entry."""
    if some.all():
        one = np.zeros(shape, dtype=bool)
        one[np.ix_(sorted({o for o, _, _ in wy}), sorted({o for o, _, _ in wx}))] = True
        return np.broadcast_to(one, (len(some), *shape))
    plain = [[(o, i, 1.0) for o, i, _ in w] for w in (wy, wx)]
    return _grid(some.astype(np.float64), *plain, shape) > 0


def weighted_rows(batch: pa.RecordBatch, wy: list, wx: list, pixels: int) -> Iterator[pa.RecordBatch]:
    """Rows ``img, unit, py, px, v`` of gathered maps: the pixels that have an entry with a cell; null without any number."""
    if not (batch.num_rows and wy and wx):
        return
    shape = tuple(max(o for o, _, _ in w) + 1 for w in (wy, wx))
    held = batch.column("held").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, *(max(i for _, i, _ in w) + 1 for w in (wy, wx)))
    keys = batch.select(["img", "unit"])
    for some, v, known in _weighted(batch, wy, wx, pixels, shape):
        m, py, px = np.nonzero(_reach(held[some], wy, wx, shape))
        own = [c.take(pa.array(m)) for c in keys.slice(some.start, len(v)).columns]
        new = [pa.array(py.astype(np.int32)), pa.array(px.astype(np.int32)), pa.array(v[m, py, px], mask=~known[m, py, px])]
        yield pa.RecordBatch.from_arrays([*own, *new], names=["img", "unit", "py", "px", "v"])


def weighted_maps(batch: pa.RecordBatch, wy: list, wx: list, pixels: int, shape: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Whole maps ``img, unit, w, values`` of gathered maps; null where no number reaches."""
    if not (batch.num_rows and wy and wx):
        return
    for some, v, known in _weighted(batch, wy, wx, pixels, shape):
        ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * (shape[0] * shape[1]))
        values = pa.ListArray.from_arrays(ends, pa.array(v.ravel(), mask=~known.ravel()))
        keys = batch.select(["img", "unit"]).slice(some.start, len(v)).columns
        yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(v), shape[1], np.int32)), values], names=["img", "unit", "w", "values"])
