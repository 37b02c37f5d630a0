"""Points in the union of a group's discs, counted without a row a pair.

Points lie in strips of the plane, sorted along each. A disc covers a run of every strip that it meets: the inner part of the run, which the
disc covers over the whole height of the strip, counts as a run, and only points between inner and outer part are measured one by one. Runs of
a group are merged before they are counted, so that a point counts once.
"""

from __future__ import annotations

import numpy as np

#: Runs, and points measured one by one, that are held at once.
_RUNS, _MEASURED = 1 << 18, 1 << 20
#: Strips that the radius is cut into, at most.
_STRIPS = 64


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the slices [start, start + length) one after the other."""
    row = np.repeat(np.arange(len(starts)), lengths)
    return row, np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row] + starts[row]


def _merged(group: np.ndarray, start: np.ndarray, end: np.ndarray, n: int):
    """The runs (group, start, end) of places below n, those of a group that meet or overlap as one."""
    a, b = group * (n + 1) + start, group * (n + 1) + end
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])[: len(a)]
    first = np.flatnonzero(new)
    a, b = a[first], b[np.append(first[1:], len(b)) - 1] if len(first) else b
    group = a // (n + 1)
    return group, a - group * (n + 1), b - group * (n + 1)


def covered(px: np.ndarray, py: np.ndarray, tx: np.ndarray, ty: np.ndarray, group: np.ndarray, groups: int, radius: float) -> np.ndarray:
    """How many points lie at most `radius` from any target of each group. Targets are sorted by group, a number from 0; all places are finite."""
    out = np.zeros(groups, np.int64)
    if not len(px) or not len(tx):
        return out
    order = np.lexsort((px, py))
    px, py = px[order], py[order]
    first = np.flatnonzero(np.append(True, (px[1:] != px[:-1]) | (py[1:] != py[:-1])))
    weight, px, py = np.diff(np.append(first, len(px))), px[first], py[first]  # points of one place count together
    n, x0, y0 = len(px), px.min(), py.min()
    wide, high = px.max() - x0, py.max() - y0
    # strips so high that a disc meets about as many strips as points that are to be measured
    c = min(max(np.sqrt(wide * high / (2 * n)), radius / _STRIPS), radius)
    strip = np.floor((py - y0) / c).astype(np.int64)
    last = int(strip.max())
    order = np.lexsort((px, strip))
    px, py, weight, strip = px[order], py[order], weight[order], strip[order]
    size = wide + 3.0
    place, total = strip * size + (px - x0), np.append(0, np.cumsum(weight))
    # more than all sums above are off by
    slack = 1e-7 * radius + 1e-13 * (max(np.abs(px).max(), np.abs(py).max(), np.abs(tx).max(), np.abs(ty).max()) + place[-1] + size)
    low = np.clip(np.floor((ty - radius - slack - y0) / c), 0, last + 1).astype(np.int64)
    count = np.maximum(np.clip(np.floor((ty + radius + slack - y0) / c), -1, last).astype(np.int64) - low + 1, 0)
    sums = np.cumsum(count)
    held = (np.zeros(0, np.int64),) * 3

    def settle(runs, open_group: int):
        """Count the runs of all groups before `open_group`, keep the others."""
        group, start, end = runs
        k = int(np.searchsorted(group, open_group))
        np.add.at(out, group[:k], total[end[:k]] - total[start[:k]])
        return group[k:], start[k:], end[k:]

    done = 0
    while done < len(tx):
        until = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + _RUNS, side="right")))
        row, j = _ragged(low[done:until], count[done:until])
        row += done
        below = y0 + j * c - ty[row]
        near, far = np.maximum(np.maximum(below, -below - c) - slack, 0.0), np.maximum(-below, below + c) + slack
        outer = np.sqrt(np.maximum((radius + slack) ** 2 - near**2, 0.0)) + slack
        inner = np.sqrt(np.maximum(max(radius - slack, 0.0) ** 2 - far**2, 0.0)) - slack
        x, base = tx[row] - x0, j * size
        at = lambda value, side: np.searchsorted(place, base + np.clip(value, -1.0, wide + 1.0), side=side)  # noqa: E731, B023
        a, d = at(x - outer, "left"), at(x + outer, "right")
        some = d > a
        row, a, d, x, base, inner = row[some], a[some], d[some], x[some], base[some], inner[some]
        b = np.where(inner > 0, at(x - inner, "left"), a)
        e = np.where(inner > 0, np.maximum(at(x + inner, "right"), b), a)
        whole = e > b
        held = _merged(*(np.concatenate(v) for v in zip(held, (group[row[whole]], b[whole], e[whole]))), n)
        row, start, length = np.tile(row, 2), np.concatenate([a, e]), np.concatenate([b - a, d - e])
        use = np.flatnonzero(length > 0)
        row, start, length = row[use], start[use], length[use]
        ends, k = np.cumsum(length), 0
        while k < len(row):
            m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _MEASURED, side="right")))
            of, p = _ragged(start[k:m], length[k:m])
            of = row[k:m][of]
            dx, dy = px[p] - tx[of], py[p] - ty[of]
            hit = np.sqrt(dx * dx + dy * dy) <= radius
            p = p[hit]
            held = _merged(*(np.concatenate(v) for v in zip(held, (group[of[hit]], p, p + 1))), n)
            k = m
        held = settle(held, int(group[until]) if until < len(tx) else groups)
        done = until
    return out


def tiles(batches, radii: list[float]):
    """Batches (tile, block, other, key, x, y), sorted by the first three and with points, whose key is null and whose `is_point` is set, first: for
    each tile and key a row (key, counts), a count a radius."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def result(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        point = table.column("is_point").to_numpy(zero_copy_only=False)
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        n = int(point.sum())
        if not n or n == len(point):
            return None
        keys = pc.dictionary_encode(table.column("key").combine_chunks().slice(n), null_encoding="encode")
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        group = keys.indices.to_numpy().astype(np.int64)
        order = np.argsort(group, kind="stable")
        found = [covered(x[:n], y[:n], x[n:][order], y[n:][order], group[order], len(keys.dictionary), r) for r in radii]
        counts = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(found, axis=1).reshape(-1)), len(radii)).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([keys.dictionary, counts], ["key", "counts"])

    held, name = [], None
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "block", "other")], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)] if len(names) else []
        for a, b in zip(cuts, cuts[1:]):
            if name is not None and (names[a] != name).any():
                done = result(held)
                if done is not None:
                    yield done
                held = []
            name = names[a]
            held.append(batch.slice(a, b - a))
    done = result(held) if held else None
    if done is not None:
        yield done
