"""What isn't a fold or a join: routing in time, priority flood, least-cost ways and two-dimensional flow, one group of cells a task.

A drainage tree or a flood box is the unit that has to advance together; groups are spread over
the executors, and inside one all cells of a level advance as arrays.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.plans.store import cut

#: Cells that a single group may hold.
MOST_CELLS = 5_000_000
#: Explicit schemes; the implicit one is in ``implicit``.
SCHEMES = ("kinematic", "diffusive", "muskingum", "dynamic")


def _positions(ids: np.ndarray, ds: np.ndarray) -> np.ndarray:
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids[order], ds), len(ids) - 1)
    return np.where(ids[order][at] == ds, order[at], -1)


def _levels(down: np.ndarray) -> list[np.ndarray]:
    """Cells by the longest way from a headwater, so that donors come before."""
    level = np.zeros(len(down), int)
    waiting = np.bincount(down[down >= 0], minlength=len(down))
    ready = list(np.flatnonzero(waiting == 0))
    while ready:
        k = ready.pop()
        d = down[k]
        if d >= 0:
            level[d] = max(level[d], level[k] + 1)
            waiting[d] -= 1
            if not waiting[d]:
                ready.append(d)
    order = np.argsort(level, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[order])) + 1)


def by_hops(down: np.ndarray) -> list[np.ndarray]:
    """Cells by their number of steps to a root, roots first, donors in the order of the cells below them; without cells that lead into a loop."""
    above = np.argsort(down, kind="stable")
    first = np.searchsorted(down[above], np.arange(len(down) + 1))
    now, levels = np.flatnonzero(down < 0), []
    while len(now):
        levels.append(now)
        sizes = first[now + 1] - first[now]
        starts = np.repeat(first[now] - (np.cumsum(sizes) - sizes), sizes)
        now = above[starts + np.arange(int(sizes.sum()))]
    return levels


def _waves(down: np.ndarray, levels: list[np.ndarray], s: np.ndarray, dist: np.ndarray, n: np.ndarray, rain: np.ndarray, dt: float, steps: int, every: int, size: float) -> list[tuple]:
    """Muskingum-Cunge steps of all levels at a time, each one step behind the level above it.

    A cell needs its own state of the step before and its donors' flow of the same step, so level j
    can take step d - j when all others take theirs: steps and levels add up and do not multiply.
    Levels lie one after the other from the farthest to the roots, so what is worked on is a slice.
    """
    order = np.concatenate(levels[::-1])
    starts = np.cumsum([0, *map(len, levels[::-1])])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    below = place[down[order]]  # of roots: anything
    level = np.repeat(np.arange(len(levels)), np.diff(starts))
    area, last = size * size, len(levels) - 1
    celerity, reach, dist = 5 / 3 * np.sqrt(s[order]) / n[order] * dt / dist[order], 0.6 / (s[order] * dist[order]), None
    given = rain[np.minimum(np.arange(steps), len(rain) - 1)] * area
    volume, q_old, in_old = (np.zeros(len(order)) for _ in range(3))
    leaving, stored = np.zeros(steps), np.zeros(steps)
    for d in range(steps + last):
        low, high = max(0, d - steps + 1), min(last, d)
        at = slice(starts[low], starts[high + 1])
        donors = slice(starts[max(low - 1, 0)], starts[high])
        # the flow of donors is that of the turn before, so of this step
        inflow = np.bincount(below[donors] - at.start, weights=q_old[donors], minlength=at.stop - at.start) if donors.stop > donors.start else np.zeros(at.stop - at.start)
        lateral = given[d - level[at]]
        v = volume[at]
        h = np.maximum(v, 0) / area
        courant, peclet = celerity[at] * h ** (2 / 3), reach[at] * h
        q = (courant - 1 + peclet) * inflow + (1 + courant - peclet) * in_old[at] + (1 - courant + peclet) * q_old[at] + 2 * courant * lateral
        q = np.maximum(q / (1 + courant + peclet), 0)
        more = v + (inflow + lateral) * dt
        q = np.minimum(q, np.maximum(more, 0) / dt)
        volume[at], q_old[at], in_old[at] = more - q * dt, q, inflow
        if high == last:
            leaving[d - last] = q_old[starts[last] :].sum() * dt
        for j in range(high - (every - 1 - (d - high)) % every, low - 1, -every):
            stored[d - j] += volume[starts[j] : starts[j + 1]].sum()
    into, out = np.cumsum(given * len(order) * dt), np.cumsum(leaving)
    ends = range(every - 1, steps, every)
    return [((k + 1) * dt, leaving[k + 1 - every : k + 1].sum() / (every * dt), into[k], out[k], stored[k]) for k in ends]


def route(cells: pd.DataFrame, rain: np.ndarray, dt: float, steps: int, every: int, scheme: str, size: float = 30.0) -> pd.DataFrame:
    """Outlet flow by output interval and the water balance of one tree; ``rain`` is m/s by step.

    Columns id, ds, z, slope, dist, n. Depth is volume by cell area; flows are limited to what is stored.
    """
    if scheme not in SCHEMES:
        scheme = "kinematic"
    down = _positions(cells["id"].to_numpy(), cells["ds"].fillna(-1).to_numpy().astype(np.int64))
    z, s, dist, n = (cells[c].to_numpy(float) for c in ("z", "slope", "dist", "n"))
    has, safe, area = down >= 0, np.maximum(down, 0), size * size
    columns = ["time_s", "q_m3s", "rain_m3", "out_m3", "stored_m3"]
    if scheme == "muskingum" and sum(map(len, hops := by_hops(down))) == len(down):
        return pd.DataFrame(_waves(down, hops, s, dist, n, rain, dt, steps, every, size), columns=columns)
    levels = _levels(down) if scheme == "muskingum" else []  # with loops
    volume, q_old, in_old = np.zeros(len(z)), np.zeros(len(z)), np.zeros(len(z))
    out, total_in, total_out, sum_out = [], 0.0, 0.0, 0.0
    for k in range(steps):
        lateral = np.full(len(z), rain[min(k, len(rain) - 1)] * area)
        h = np.maximum(volume, 0) / area
        if scheme == "kinematic":
            q = h ** (5 / 3) * np.sqrt(s) * size / n
        elif scheme == "diffusive":
            surface = np.where(has, np.maximum(s + (h - h[safe]) / dist, 0), s)
            over = np.where(has, np.maximum(z + h, z[safe] + h[safe]) - np.maximum(z, z[safe]), h)
            q = np.maximum(over, 0) ** (5 / 3) * np.sqrt(surface) * size / n
        elif scheme == "dynamic":
            surface = np.where(has, s + (h - h[safe]) / dist, s)
            deep = np.maximum(h, 1e-6)
            unit = (q_old / size + 9.81 * deep * dt * surface) / (1 + 9.81 * dt * n**2 * np.abs(q_old / size) / deep ** (7 / 3))
            q = np.where(h > 1e-6, np.maximum(unit, 0) * size, 0.0)
        elif scheme == "muskingum":
            q, inflow = np.zeros(len(z)), np.zeros(len(z))
            c = 5 / 3 * h ** (2 / 3) * np.sqrt(s) / n
            courant, peclet = c * dt / dist, 0.6 * h / (s * dist)
            under = 1 + courant + peclet
            for cells_ in levels:
                i = cells_
                q[i] = np.maximum(((courant - 1 + peclet) * inflow + (1 + courant - peclet) * in_old + (1 - courant + peclet) * q_old + 2 * courant * lateral)[i] / under[i], 0)
                q[i] = np.minimum(q[i], np.maximum(volume[i] + (inflow[i] + lateral[i]) * dt, 0) / dt)
                np.add.at(inflow, safe[i][has[i]], q[i][has[i]])
            in_old = inflow
        if scheme in ("kinematic", "diffusive", "dynamic"):
            q = np.minimum(q, np.maximum(volume, 0) / dt)
        volume = volume + (lateral - q) * dt
        np.add.at(volume, safe[has], q[has] * dt)
        q_old = q
        total_in += lateral.sum() * dt
        leaving = q[~has].sum() * dt
        total_out += leaving
        sum_out += leaving
        if (k + 1) % every == 0:
            out.append(((k + 1) * dt, sum_out / (every * dt), total_in, total_out, volume.sum()))
            sum_out = 0.0
    return pd.DataFrame(out, columns=columns)


def routed(net: DataFrame, rain: list[float], dt: float, steps: int, every: int, scheme: str) -> DataFrame:
    """Hydrographs and balances of all trees: a group for each root."""

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = route(rows, np.array(rain), dt, steps, every, scheme)
        found.insert(0, "root", key[0])
        return found

    return net.groupBy("root").applyInPandas(kernel, "root bigint, time_s double, q_m3s double, rain_m3 double, out_m3 double, stored_m3 double")


def filled(z: np.ndarray, epsilon: float = 0.0) -> np.ndarray:
    """Priority flood from the edge: no cell lies below all ways out of it. Missing cells are outside."""
    rows, columns = z.shape
    out, done = z.copy(), np.isnan(z)
    heap = []
    for r in range(rows):
        for c in range(columns):
            edge = r in (0, rows - 1) or c in (0, columns - 1) or np.isnan(z[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2]).any()
            if edge and not done[r, c]:
                heap.append((z[r, c], r, c))
                done[r, c] = True
    heapq.heapify(heap)
    while heap:
        level, r, c = heapq.heappop(heap)
        for i in range(max(r - 1, 0), min(r + 2, rows)):
            for j in range(max(c - 1, 0), min(c + 2, columns)):
                if not done[i, j]:
                    done[i, j] = True
                    out[i, j] = max(z[i, j], level + epsilon)
                    heapq.heappush(heap, (out[i, j], i, j))
    return out


def least_cost(z: np.ndarray) -> np.ndarray:
    """D8 codes from a flood that takes the lowest waiting cell first, first come first; each cell points to the one that reached it."""
    from tarnflow.operators.terrain import D8

    rows, columns = z.shape
    code, turn, heap = np.zeros(z.shape, int), 0, []
    seen = np.isnan(z)
    for r in range(rows):
        for c in range(columns):
            if not seen[r, c] and (r in (0, rows - 1) or c in (0, columns - 1)):
                heap.append((z[r, c], turn, r, c))
                turn += 1
                seen[r, c] = True
    heapq.heapify(heap)
    while heap:
        _, _, r, c = heapq.heappop(heap)
        for k, dr, dc in D8:
            i, j = r - dr, c - dc
            if 0 <= i < rows and 0 <= j < columns and not seen[i, j]:
                seen[i, j] = True
                code[i, j] = k
                heapq.heappush(heap, (z[i, j], turn, i, j))
                turn += 1
    return code


def _raster(rows: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    r0, c0 = rows["r"].min(), rows["c"].min()
    shape = (rows["r"].max() - r0 + 1, rows["c"].max() - c0 + 1)
    if shape[0] * shape[1] > MOST_CELLS:
        raise ValueError(f"a group of more than {MOST_CELLS} cells")
    grid = np.full(shape, np.nan)
    grid[rows["r"] - r0, rows["c"] - c0] = rows["z"]
    return grid, r0, c0


def lowered(z: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The lowest levels at which water can leave a tile with the rim of its neighbours around it (one row or column more on each side), from levels of the rim and of the edge that are known; unknown ones are infinite."""
    rows, columns = z.shape
    out = np.maximum(level, z)
    heap = [(out[r, c], r, c) for r, c in zip(*np.nonzero(np.isfinite(out)))]
    heapq.heapify(heap)
    while heap:
        at, r, c = heapq.heappop(heap)
        if at > out[r, c]:
            continue
        for i in range(max(r - 1, 0), min(r + 2, rows)):
            for j in range(max(c - 1, 0), min(c + 2, columns)):
                new = max(z[i, j], at)
                if new < out[i, j]:
                    out[i, j] = new
                    heapq.heappush(heap, (new, i, j))
    return out


def tiles_of(cells: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Cells (id, r, c, z) with their tile, and a written row for each tile: its heights as one array with an empty rim around."""
    keyed = cells.select("id", "r", "c", "z", F.floor(F.col("r") / tile).cast("bigint").alias("tr"), F.floor(F.col("c") / tile).cast("bigint").alias("tc"))
    side = tile + 2

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((side, side), np.nan)
        grid[rows["r"] - key[0] * tile + 1, rows["c"] - key[1] * tile + 1] = rows["z"]
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "z": [grid.tobytes()]})

    return keyed, cut(keyed.groupBy("tr", "tc").applyInPandas(gather, "tr bigint, tc bigint, z binary"))


def rims_of(frame: DataFrame, column: str, side: int) -> DataFrame:
    """What each tile sees of its neighbours' arrays: the sides and corners that touch it. Only these are exchanged."""
    part = {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}

    def spread(batches):
        for rows in batches:
            out = []
            for tr, tc, data in zip(rows["tr"], rows["tc"], rows[column]):
                inner = np.frombuffer(data).reshape(side, side)[1:-1, 1:-1]
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        if dr or dc:  # the neighbour there has this tile on its opposite side
                            out.append((tr + dr, tc + dc, -dr, -dc, np.ascontiguousarray(inner[part[dr], part[dc]]).tobytes()))
            yield pd.DataFrame(out, columns=["tr", "tc", "dr", "dc", "rim"])

    sent = frame.select("tr", "tc", column).mapInPandas(spread, "tr bigint, tc bigint, dr int, dc int, rim binary")
    return sent.groupBy("tr", "tc").agg(F.collect_list(F.struct("dr", "dc", "rim")).alias(f"{column}_rims"))


def put_rims(grid: np.ndarray, given) -> None:
    place = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
    for one in given if given is not None else ():
        part = grid[place[one["dr"]], place[one["dc"]]]
        part[...] = np.frombuffer(one["rim"]).reshape(part.shape)


def d8(cells: DataFrame, n: int, size: float = 30.0, by: str = "slope", tile: int = 128) -> DataFrame:
    """id, code, ds and dist of the steepest way down on an n by n lattice (id is r n + c), ties to the smallest code; null where there is none. ``by`` is slope or drop. Tiles see a rim of one cell around them, and nothing else is exchanged."""
    from tarnflow.operators.terrain import D8, ROOT2

    side = tile + 2
    _, base = tiles_of(cells, tile)
    order = sorted(D8)

    def steepest(batches):
        for rows in batches:
            out = []
            for tr, tc, data, given in zip(rows["tr"], rows["tc"], rows["z"], rows["z_rims"]):
                z = np.frombuffer(data).reshape(side, side).copy()
                put_rims(z, given)
                own = z[1:-1, 1:-1]
                best, code = np.zeros(own.shape), np.zeros(own.shape, np.int32)
                for k, dr, dc in order:
                    dist = size * ROOT2 if dr and dc else size
                    fall = own - z[1 + dr : side - 1 + dr, 1 + dc : side - 1 + dc]
                    measure = np.nan_to_num(fall / dist if by == "slope" else fall, nan=-1.0)
                    code = np.where(measure > best, k, code)
                    best = np.maximum(best, measure)
                r, c = np.nonzero(~np.isnan(own))
                found = code[r, c]
                step = {k: (dr * n + dc, size * ROOT2 if dr and dc else size) for k, dr, dc in D8}
                here = (r + tr * tile) * n + c + tc * tile
                flows = found > 0
                ds = [int(i + step[k][0]) if f else None for i, k, f in zip(here.tolist(), found.tolist(), flows.tolist())]
                out.append(pd.DataFrame({"id": here, "code": pd.array(np.where(flows, found, 0), "Int32").astype("Int32"), "ds": pd.array(ds, "Int64"), "dist": [step[k][1] if k else None for k in found.tolist()]}))
                out[-1].loc[~flows, "code"] = pd.NA
            if out:
                yield pd.concat(out)

    return base.join(rims_of(base, "z", side), ["tr", "tc"], "left").mapInPandas(steepest, "id bigint, code int, ds bigint, dist double")


def fill(cells: DataFrame, tile: int = 64) -> DataFrame:
    """Depression filling of a whole grid (id, r, c, z): no cell below all ways out of it. Water leaves at the grid's edge and beside missing cells.

    The grid is cut into tiles, and each is flooded from the levels around it; only its rim goes to its
    neighbours, until no rim changes, which takes as many rounds as tiles lie on the longest way out.
    """
    side = tile + 2
    keyed, base = tiles_of(cells, tile)

    def begin(batches):
        for rows in batches:
            out = []
            for tr, tc, data, given in zip(rows["tr"], rows["tc"], rows["z"], rows["z_rims"]):
                z = np.frombuffer(data).reshape(side, side).copy()
                put_rims(z, given)
                gap = np.isnan(z)
                beside = np.zeros(z.shape, bool)
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        beside[1:-1, 1:-1] |= gap[1 + i : side - 1 + i, 1 + j : side - 1 + j]
                level = np.where(beside & ~gap, z, np.inf)
                out.append((tr, tc, np.where(gap, np.inf, z).tobytes(), level.tobytes(), True))
            yield pd.DataFrame(out, columns=["tr", "tc", "z", "level", "changed"])

    def flood(batches):
        for rows in batches:
            out = []
            for tr, tc, data, held, given in zip(rows["tr"], rows["tc"], rows["z"], rows["level"], rows["level_rims"]):
                z, level = np.frombuffer(data).reshape(side, side), np.frombuffer(held).reshape(side, side).copy()
                before = level[1:-1, 1:-1].copy()
                put_rims(level, given)
                level = lowered(z, level)
                out.append((tr, tc, data, level.tobytes(), bool((level[1:-1, 1:-1] != before).any())))
            yield pd.DataFrame(out, columns=["tr", "tc", "z", "level", "changed"])

    schema = "tr bigint, tc bigint, z binary, level binary, changed boolean"
    now = cut(base.join(rims_of(base, "z", side), ["tr", "tc"], "left").mapInPandas(begin, schema))
    while not now.where("changed").isEmpty():
        now = cut(now.join(rims_of(now, "level", side), ["tr", "tc"], "left").mapInPandas(flood, schema))

    def spill(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        level = np.frombuffer(right["level"].iloc[0]).reshape(side, side)
        return pd.DataFrame({"id": left["id"], "z": level[left["r"] - key[0] * tile + 1, left["c"] - key[1] * tile + 1]})

    return keyed.groupBy("tr", "tc").cogroup(now.groupBy("tr", "tc")).applyInPandas(spill, "id bigint, z double")


def least_cost_groups(cells: DataFrame, group: str = "basin") -> DataFrame:
    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = _raster(rows)
        return pd.DataFrame({"id": rows["id"], "code": least_cost(grid)[rows["r"] - r0, rows["c"] - c0]})

    return cells.groupBy(group).applyInPandas(kernel, "id bigint, code int")


class Flood2D:
    """Local-inertial flow on a staggered grid, with a stable step, a Froude cap and no negative depths. Walls on all sides but open cells."""

    def __init__(self, z: np.ndarray, n: float = 0.03, size: float = 30.0, alpha: float = 0.7):
        self.z, self.n, self.size, self.alpha = z, n, size, alpha
        self.h = np.zeros_like(z)
        self.qx, self.qy = np.zeros((z.shape[0], z.shape[1] + 1)), np.zeros((z.shape[0] + 1, z.shape[1]))
        self.most = np.zeros_like(z)

    def _faces(self, q: np.ndarray, axis: int, dt: float) -> None:
        a = [slice(None)] * 2
        b = [slice(None)] * 2
        inner = [slice(None)] * 2
        a[axis], b[axis], inner[axis] = slice(None, -1), slice(1, None), slice(1, -1)
        za, zb, ha, hb = self.z[tuple(a)], self.z[tuple(b)], self.h[tuple(a)], self.h[tuple(b)]
        deep = np.maximum(za + ha, zb + hb) - np.maximum(za, zb)
        wet = deep > 1e-5
        safe = np.where(wet, deep, 1.0)
        slope = (za + ha - zb - hb) / self.size
        old = q[tuple(inner)]
        new = (old + 9.81 * safe * dt * slope) / (1 + 9.81 * dt * self.n**2 * np.abs(old) / safe ** (7 / 3))
        cap = 1.5 * safe * np.sqrt(9.81 * safe)
        q[tuple(inner)] = np.where(wet, np.clip(new, -cap, cap), 0.0)

    def step(self, source: np.ndarray, until: float) -> float:
        dt = min(until, self.alpha * self.size / np.sqrt(9.81 * max(self.h.max(), 1e-3)), 10.0)
        self._faces(self.qx, 1, dt)
        self._faces(self.qy, 0, dt)
        leaving = (np.maximum(-self.qx[:, :-1], 0) + np.maximum(self.qx[:, 1:], 0) + np.maximum(-self.qy[:-1], 0) + np.maximum(self.qy[1:], 0)) * dt / self.size
        share = np.where(leaving > self.h, self.h / np.maximum(leaving, 1e-300), 1.0)
        self.qx[:, 1:-1] *= np.where(self.qx[:, 1:-1] > 0, share[:, :-1], share[:, 1:])
        self.qy[1:-1] *= np.where(self.qy[1:-1] > 0, share[:-1], share[1:])
        self.h += dt / self.size * (self.qx[:, :-1] - self.qx[:, 1:] + self.qy[:-1] - self.qy[1:]) + source * dt
        self.h = np.maximum(self.h, 0)
        self.most = np.maximum(self.most, self.h)
        return dt


def flood_boxes(cells: DataFrame, seconds: float, group: str = "box") -> DataFrame:
    """Greatest and last depths of boxes (box, id, r, c, z, source m/s): a box is a group."""

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = _raster(rows)
        grid = np.where(np.isnan(grid), np.nanmax(grid) + 100, grid)
        source = np.zeros(grid.shape)
        source[rows["r"] - r0, rows["c"] - c0] = rows["source"]
        flow, t = Flood2D(grid), 0.0
        while t < seconds - 1e-9:
            t += flow.step(source, seconds - t)
        at = (rows["r"] - r0, rows["c"] - c0)
        return pd.DataFrame({"id": rows["id"], "most": flow.most[at], "last": flow.h[at]})

    return cells.groupBy(group).applyInPandas(kernel, "id bigint, most double, last double")


def hydrograph(routed_: DataFrame) -> DataFrame:
    return routed_.select("root", "time_s", (F.col("time_s") / 3600).alias("time_hr"), "q_m3s")
