"""Kernels that meet track pieces with the origin polygons of a neighbourhood in one task, so that what is found of an incident needs no shuffle.

Incidents are dealt into blocks of bounded size by place and time, pieces go to every block whose polygons they may touch, and stream through it
vessel by vessel. Only what is met by cell, instant and box is looked at; the arithmetic is that of the column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CELL_DEG = 0.25
PAD = 1e-9
#: Horizontal bands of a ring under which its edges are listed.
BANDS = 16
#: Pairs looked at in one go, and places held for (vessel, polygon) answers.
PAIRS, PLACES = 300_000, 8_000_000
FLOATS = ("lat0", "lat1", "lon0", "lon1", "sog0", "sog1")


def spread_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` its index that many times, and 0, 1, ... within it."""
    who = np.repeat(np.arange(len(counts)), counts)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)


def grid(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First grid index of each range and how many there are."""
    a, b = np.floor((lo - PAD) / CELL_DEG).astype(np.int64), np.floor((hi + PAD) / CELL_DEG).astype(np.int64)
    return a, b - a + 1


class Rings:
    """The origin polygons of one block, ready to be asked which of them hold a vessel.

    Rings of one incident and hour are a group, which a vessel meets once: a probe of any of them is tested against each.
    """

    def __init__(self, ids: pa.Array, hours: np.ndarray, t_us: np.ndarray, xs: pa.ListArray, ys: pa.ListArray):
        codes = ids.dictionary_encode().indices.to_numpy()
        pair = np.stack([codes, hours])
        groups, first, of = np.unique(pair, axis=1, return_index=True, return_inverse=True)
        of = of.reshape(-1)
        self.n_groups, self.group_id, self.group_code, self.group_hour = groups.shape[1], ids.take(pa.array(first)), groups[0], groups[1]
        n = np.diff(xs.offsets.to_numpy())
        x, y = xs.flatten().to_numpy(zero_copy_only=False), ys.flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(n) - n
        with np.errstate(invalid="ignore", divide="ignore"):
            box = [f.reduceat(v, start) for v in (x, y) for f in (np.fmin, np.fmax)]
            at = np.arange(len(x)) + 1
            at[start + n - 1] = start
            gx, dy = x[at] - x, y[at] - y
            slope = np.where(dy == 0, np.nan, gx / dy)
        self.y0, height = box[2], box[3] - box[2]
        self.scale = np.where(height > 0, BANDS / np.where(height > 0, height, 1.0), 0.0)
        ring = np.repeat(np.arange(len(n)), n)
        good = np.flatnonzero(~np.isnan(slope) & ~np.isnan(x))  # level edges never cross
        low, high = np.fmin(y, y[at])[good], np.fmax(y, y[at])[good]
        b0, b1 = self.band(ring[good], low), self.band(ring[good], high)
        who, k = spread_out(b1 - b0 + 1)
        slot = ring[good][who] * BANDS + b0[who] + k
        order = np.argsort(slot, kind="stable")
        e = good[who[order]]
        self.ex, self.ey, self.ey2, self.eg = x[e], y[e], y[at][e], slope[e]
        self.slots = np.searchsorted(slot[order], np.arange(len(n) * BANDS + 1))
        # entries: a probing ring and a ring of its group that is tested
        size = np.bincount(of, minlength=self.n_groups)
        by_group, head = np.argsort(of, kind="stable"), np.cumsum(size) - size
        probe, k = spread_out(size[of])
        self.tested, self.entry_group = by_group[head[of[probe]] + k], of[probe]
        self.box = [b[probe] for b in box]
        gx0, nx = grid(self.box[0], self.box[1])
        gy0, ny = grid(self.box[2], self.box[3])
        who, k = spread_out(nx * ny)
        cx, cy, t = gx0[who] + k // ny[who], gy0[who] + k % ny[who], t_us[probe][who]
        self.cx0, self.cy0 = cx.min(), cy.min()
        self.wide, self.high = cx.max() - self.cx0 + 1, cy.max() - self.cy0 + 1
        self.times = np.unique(t)
        cell = (cx - self.cx0) * self.high + cy - self.cy0
        self.cells = np.unique(cell)
        key = np.searchsorted(self.cells, cell) * len(self.times) + np.searchsorted(self.times, t)
        order = np.argsort(key, kind="stable")
        self.listed = who[order]
        self.visits, first = np.unique(key[order], return_index=True)
        self.begin = np.append(first, len(order))

    def band(self, ring: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Band of a height; it never falls as the height grows, so an edge is listed wherever it can cross."""
        return np.clip(((y - self.y0[ring]) * self.scale[ring]).astype(np.int64), 0, BANDS - 1)

    def cell_rank(self, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        """Number of a cell among those that boxes touch, or -1."""
        x, y = cx - self.cx0, cy - self.cy0
        cell = x * self.high + y
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where((x >= 0) & (x < self.wide) & (y >= 0) & (y < self.high) & (self.cells[at] == cell), at, -1)

    def holds(self, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Crossing parity over the edges listed under the band of each point."""
        slot = ring * BANDS + self.band(ring, y)
        at, left = self.slots[slot], self.slots[slot + 1] - self.slots[slot]
        odd, todo = np.zeros(len(x), bool), np.flatnonzero(left)
        while len(todo):
            e, py = at[todo], y[todo]
            y1 = self.ey[e]
            odd[todo] ^= ((y1 > py) != (self.ey2[e] > py)) & (x[todo] < self.eg[e] * (py - y1) + self.ex[e])
            at[todo] += 1
            left[todo] -= 1
            todo = todo[left[todo] > 0]
        return odd

    def meet(self, p: dict[str, np.ndarray], vessel: np.ndarray, n_vessels: int, offsets_us: tuple[int, ...]) -> dict[str, np.ndarray]:
        """First matching offset of every (vessel, group): vessel, group, off, ts, lat, lon, sog and whether sog is known."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self._meet(p, vessel, n_vessels, offsets_us)

    def _meet(self, p: dict[str, np.ndarray], vessel: np.ndarray, n_vessels: int, offsets_us: tuple[int, ...]) -> dict[str, np.ndarray]:
        t0, t1 = p["t0"], p["t1"]
        lat0, lat1, lon0, lon1 = p["lat0"], p["lat1"], p["lon0"], p["lon1"]

        def lerp(a: np.ndarray, b: np.ndarray, k: np.ndarray, ts: np.ndarray) -> np.ndarray:
            span = t1[k] - t0[k]
            return a[k] + (b[k] - a[k]) * np.where(span > 0, (ts - t0[k]) / np.where(span > 0, span, 1), 0.0)

        # slices of a piece span a cell at most; each has the instants after its start up to its end, a piece without length its only one
        m = np.maximum(1, np.ceil(np.maximum(np.abs(lon1 - lon0), np.abs(lat1 - lat0)) / CELL_DEG)).astype(np.int64)
        k, j = spread_out(m)
        a, b = t0[k] + (t1[k] - t0[k]) * j // m[k], t0[k] + (t1[k] - t0[k]) * (j + 1) // m[k]
        xa, xb, ya, yb = lerp(lon0, lon1, k, a), lerp(lon0, lon1, k, b), lerp(lat0, lat1, k, a), lerp(lat0, lat1, k, b)
        gx, nx = grid(np.minimum(xa, xb), np.maximum(xa, xb))
        gy, ny = grid(np.minimum(ya, yb), np.maximum(ya, yb))
        s, c = spread_out(nx * ny)
        rank = self.cell_rank(gx[s] + c // ny[s], gy[s] + c % ny[s])
        s, rank = s[rank >= 0], rank[rank >= 0]
        k, a, b, zero = k[s], a[s], b[s], (t0 == t1)[k[s]]
        where = np.full(n_vessels * self.n_groups, -1, np.int32)
        got, count = [], 0
        for off, us in enumerate(offsets_us):
            lo = np.where(zero, np.searchsorted(self.times, a - us, "left"), np.searchsorted(self.times, a - us, "right"))
            hi = np.searchsorted(self.times, b - us, "right")
            v0, v1 = (np.searchsorted(self.visits, rank * len(self.times) + h, "left") for h in (lo, hi))
            w, i = spread_out(v1 - v0)
            v, kk = v0[w] + i, k[w]
            ts = self.times[self.visits[v] % len(self.times)] + us
            lon, lat = lerp(lon0, lon1, kk, ts), lerp(lat0, lat1, kk, ts)
            cell = self.cells[self.visits[v] // len(self.times)]
            keep = (np.floor(lon / CELL_DEG) == cell // self.high + self.cx0) & (np.floor(lat / CELL_DEG) == cell % self.high + self.cy0)
            v, kk, ts, lon, lat = v[keep], kk[keep], ts[keep], lon[keep], lat[keep]
            number = self.begin[v + 1] - self.begin[v]
            total = np.cumsum(number)
            at = 0
            while at < len(v):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
                w, i = spread_out(number[at:to])
                w += at
                entry = self.listed[self.begin[v[w]] + i]
                x, y = lon[w], lat[w]
                place = vessel[kk[w]] * self.n_groups + self.entry_group[entry]
                near = (x >= self.box[0][entry]) & (x <= self.box[1][entry]) & (y >= self.box[2][entry]) & (y <= self.box[3][entry]) & (where[place] < 0)
                near = np.flatnonzero(near)
                near = near[self.holds(self.tested[entry[near]], x[near], y[near])]
                w, place = w[near], place[near]
                where[place] = count + np.arange(len(w))
                got.append((kk[w], np.full(len(w), off, np.int8), ts[w], lat[w], lon[w]))
                count += len(w)
                at = to
        place = np.flatnonzero(where >= 0)
        first = where[place]
        if not len(first):
            kk, off, ts, lat, lon = (np.zeros(0, d) for d in (np.int64, np.int8, np.int64, float, float))
        else:
            kk, off, ts, lat, lon = (np.concatenate(col)[first] for col in zip(*got, strict=True))
        known = p["sog0_known"][kk] & p["sog1_known"][kk]
        return {"vessel": place // self.n_groups, "group": place % self.n_groups, "off": off, "ts": ts, "lat": lat, "lon": lon,
                "sog": lerp(p["sog0"], p["sog1"], kk, ts), "known": known}


def first_offsets(h: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One answer for each (vessel, group), that of the least offset, in the order of both."""
    order = np.lexsort((h["off"], h["group"], h["vessel"]))
    v, g = h["vessel"][order], h["group"][order]
    order = order[np.append(True, (v[1:] != v[:-1]) | (g[1:] != g[:-1]))] if len(order) else order
    return {c: a[order] for c, a in h.items()}


def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    p = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("t0", "t1", *FLOATS)}
    return p | {f"{c}_known": batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("sog0", "sog1")}


def meet_blocks(offsets_us: tuple[int, ...], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel over the rows of blocks, rings before pieces and pieces by vessel: envelope hits, those of a vessel with an incident side by side."""

    def put(rings: Rings, h: dict[str, np.ndarray], mmsi: pa.Array) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(h["group"]), 65_536):
            c = {k: a[i:i + 65_536] for k, a in h.items()}
            yield pa.RecordBatch.from_arrays([
                rings.group_id.take(pa.array(c["group"])), pa.array(rings.group_hour[c["group"]]), mmsi.take(pa.array(c["vessel"])),
                pa.array(c["ts"]), pa.array(c["lat"]), pa.array(c["lon"]), pa.array(c["sog"], mask=~c["known"])], schema=schema)

    def vessels(batch: pa.RecordBatch, n_groups: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """The batch in runs of whole vessels, few enough for their answers to have a place each."""
        codes = batch.column("mmsi").dictionary_encode().indices.to_numpy()  # vessels come one after the other, so codes rise
        most = max(1, PLACES // n_groups)
        for lo in range(0, int(codes[-1]) + 1, most):
            i, j = np.searchsorted(codes, [lo, lo + most])
            yield batch.slice(i, j - i), codes[i:j] - lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, heap, rings, held, last = None, [], None, None, None
        for whole in batches:
            keys = whole.column("_block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j == i:
                    continue
                batch, key = whole.slice(i, j - i), int(keys[i])
                if key // 2 != block:
                    if held is not None:
                        yield from put(rings, held, last)
                    block, heap, rings, held, last = key // 2, [], None, None, None
                if key % 2 == 0:
                    heap.append(batch)
                    continue
                if not heap and rings is None:
                    continue
                if rings is None:
                    t = pa.Table.from_batches(heap).combine_chunks()
                    one = {c: t.column(c).combine_chunks() for c in ("incident_id", "t0", "t1", "xs", "ys")}
                    rings, heap = Rings(one["incident_id"], one["t1"].to_numpy(), one["t0"].to_numpy(), one["xs"], one["ys"]), []
                for part, code in vessels(batch, rings.n_groups):
                    mmsi = part.column("mmsi")
                    if held is not None and mmsi[0] != last[0]:
                        yield from put(rings, held, last)
                        held = None
                    n = int(code[-1]) + 1
                    h = rings.meet(columns(part), code, n, offsets_us)
                    if held is not None:  # more of the vessel that the batch before ended with
                        h = first_offsets({c: np.concatenate([held[c], a]) for c, a in h.items()})
                    names = mmsi.take(pa.array(np.searchsorted(code, np.arange(n))))
                    open_ = h["vessel"] == n - 1
                    yield from put(rings, {c: a[~open_] for c, a in h.items()}, names)
                    held, last = {c: a[open_] for c, a in h.items()}, names.slice(n - 1, 1)
                    held["vessel"] = np.zeros_like(held["vessel"])
        if held is not None:
            yield from put(rings, held, last)

    return run


def changes(arrays: list[pa.Array]) -> np.ndarray:
    """Starts of the runs of rows with equal values in ``arrays``."""
    new = np.zeros(len(arrays[0]), bool)
    new[:1] = True
    for a in arrays:
        codes = a.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def roll_up(min_underway_kn: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel that sums up hits whose pairs of incident and vessel lie side by side."""
    folds = {"n_hits": np.add, "underway_hits": np.add, "first_hit_us": np.minimum, "last_hit_us": np.maximum, "min_hours_back": np.minimum, "max_hours_back": np.maximum}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            known, sog = b.column("sog").is_valid().to_numpy(zero_copy_only=False), b.column("sog").to_numpy(zero_copy_only=False)
            ts, hours = b.column("hit_us").to_numpy(), b.column("hours_back").to_numpy()
            values = [np.ones(len(ts), np.int64), (known & ~(sog < min_underway_kn)).astype(np.int64), ts, ts, hours, hours]
            keys = [b.column("incident_id"), b.column("mmsi")]
            if held is not None:
                keys = [pa.concat_arrays([held.column(i), k]) for i, k in enumerate(keys)]
                values = [np.append(held.column(2 + i).to_numpy(), v) for i, v in enumerate(values)]
            at = changes(keys)
            out = pa.RecordBatch.from_arrays([*(k.take(pa.array(at)) for k in keys), *(pa.array(f.reduceat(v, at)) for f, v in zip(folds.values(), values, strict=True))], schema=schema)
            held = out.slice(len(at) - 1)
            yield out.slice(0, len(at) - 1)
        if held is not None:
            yield held

    return run


def first_of_each(group: str, order: list[tuple[str, str]], keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel that keeps the first ``keep`` rows of each group of a partition, so the rest need not be sorted or sent."""

    def pruned(rows: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(rows).sort_by([(group, "ascending"), *order]).combine_chunks()
        at = changes([t.column(group).combine_chunks()])
        rank = np.arange(t.num_rows) - np.repeat(at, np.diff(np.append(at, t.num_rows)))
        return t.filter(pa.array(rank < keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, most = [], 0, 200_000
        for b in batches:
            if b.num_rows:
                rows.append(b)
                n += b.num_rows
            if n > most:
                t = pruned(rows)
                rows, n = t.to_batches(), t.num_rows
                most = 2 * n + 200_000
        if rows:
            yield from pruned(rows).to_batches(max_chunksize=65_536)

    return run
