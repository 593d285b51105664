"""Stencil and per-object kernels in NumPy, run by grouped maps over haloed tiles or over single objects."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from functools import lru_cache
from itertools import count, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .levels import gaussian_taps
from .raster import AXES, in_tiles

# ------------------------------------------------------------------------------------------------------ dense pieces


def dense(pdf: pd.DataFrame, columns: list[str], pad: int = 0, fill: float = 0.0) -> tuple[np.ndarray, tuple[np.ndarray, ...], list[np.ndarray]]:
    """Origin, index of each row and the columns as dense arrays around a piece's voxels."""
    at = pdf[list(AXES)].to_numpy(np.int64)
    low = at.min(axis=0) - np.array([pad if len(np.unique(at[:, 0])) > 1 else 0, pad, pad])
    shape = at.max(axis=0) - low + 1 + np.array([0 if low[0] == at[:, 0].min() else pad, pad, pad])
    index = tuple((at - low).T)
    out = []
    for c in columns:
        grid = np.full(shape, fill, np.float64)
        grid[index] = pdf[c].to_numpy(np.float64)
        out.append(grid)
    return low, index, out


def correlate(a: np.ndarray, taps: list[float], axis: int) -> np.ndarray:
    """Along one axis, the array being mirrored at its ends (the end voxel included)."""
    r = len(taps) // 2
    width = [(0, 0)] * a.ndim
    width[axis] = (r, r)
    padded = np.pad(a, width, mode="symmetric")
    n = a.shape[axis]
    out = np.zeros_like(a)
    for k, t in enumerate(taps):
        out += t * np.take(padded, range(k, k + n), axis=axis)
    return out


def _extreme(a: np.ndarray, r: int, f) -> np.ndarray:
    for axis in (1, 2):
        width = [(0, 0)] * 3
        width[axis] = (r, r)
        padded = np.pad(a, width, mode="symmetric")
        out = np.take(padded, range(a.shape[axis]), axis=axis)
        for k in range(1, 2 * r + 1):
            out = f(out, np.take(padded, range(k, k + a.shape[axis]), axis=axis))
        a = out
    return a


def over_tiles(df: DataFrame, value: str, kernel: Callable[[np.ndarray], np.ndarray], to: str, halo: tuple[int, int, int], tile: int = 256, depth: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """df's coordinates with ``to``: kernel(dense haloed tile) at the tile's own voxels. ``depth``: slices in a tile."""
    rows = in_tiles(df.select(*by, *(F.col(a).cast("long").alias(a) for a in AXES), F.col(value).cast("double").alias("_v")), (depth, tile, tile), halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, index, (grid,) = dense(pdf, ["_v"])
        own = pdf["own"].to_numpy()
        return pdf.loc[own, [*by, *AXES]].assign(**{to: kernel(grid)[index][own]})

    names = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return rows.groupBy(*by, "tz", "ty", "tx").applyInPandas(run, f"{names}z long, y long, x long, `{to}` double")


def gaussian_smooth(df: DataFrame, value: str, sigma: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), dims: int = 2, tile: int = 256, depth: int = 32, to: str = "smooth", by: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian with sigma in physical units, separable, cut at four sigma."""
    taps = [gaussian_taps(sigma / s) for s in spacing]
    axes = tuple(range(3)) if dims == 3 else (2, 1)

    def kernel(a: np.ndarray) -> np.ndarray:
        for k in axes:
            a = correlate(a, taps[k], k)
        return a

    halo = tuple(len(t) // 2 if k in axes else 0 for k, t in enumerate(taps))
    return over_tiles(df, value, kernel, to, halo, tile, depth if dims == 3 else 1, by)


def white_tophat(df: DataFrame, value: str, radius: int, tile: int = 256, to: str = "top", by: tuple[str, ...] = ()) -> DataFrame:
    """What a square opening of 2 * radius + 1 on each slice takes away."""
    return over_tiles(df, value, lambda a: a - _extreme(_extreme(a, radius, np.minimum), radius, np.maximum), to, (0, 2 * radius, 2 * radius), tile, 1, by)


def hessian_eigenvalues(a: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Per slice, scale-normalised, ordered by magnitude (smaller first)."""
    taps = gaussian_taps(sigma)
    s = correlate(correlate(a, taps, 1), taps, 2)
    slope = [-0.5, 0.0, 0.5]
    dy, dx = correlate(s, slope, 1), correlate(s, slope, 2)
    yy, xx, xy = (correlate(v, slope, k) * sigma**2 for v, k in ((dy, 1), (dx, 2), (dy, 2)))
    half, root = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + xy**2)
    a1, a2 = half - root, half + root
    swap = np.abs(a1) > np.abs(a2)
    return np.where(swap, a2, a1), np.where(swap, a1, a2)


def frangi(a: np.ndarray, sigma: float, beta: float | None = None, gamma: float = 2.0, black: bool = False) -> np.ndarray:
    """Frangi et al. (1998) in 2D, per slice; beta is 1 from two voxels on and 0.5 below."""
    beta = beta or (1.0 if sigma >= 2 else 0.5)
    small, large = hessian_eigenvalues(a, sigma)
    blob = np.divide(small, large, out=np.zeros_like(a), where=np.abs(large) > 1e-12) ** 2
    strength = small**2 + large**2
    out = np.exp(-blob / (2 * beta**2)) * (1 - np.exp(-strength / (2 * gamma**2)))
    return np.where(large > 0 if black else large < 0, out, 0.0)


def sato(a: np.ndarray, sigma: float, black: bool = False) -> np.ndarray:
    """Sato et al. (1998) in 2D, per slice: how far the strongest curvature points to a ridge."""
    small, large = hessian_eigenvalues(-a if black else a, sigma)
    return np.maximum(0.0, -np.minimum(small, large))


def vesselness(df: DataFrame, value: str, method: str, sigmas: list[float], black: bool = False, tile: int = 256, to: str = "response", by: tuple[str, ...] = ()) -> DataFrame:
    """The greatest response over scales; ``both`` takes the greater of the two methods, times the intensity from sigma 2 on."""
    f = {"frangi": frangi, "sato": sato}

    def kernel(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        for s in sigmas:
            if method == "both":
                r = np.maximum(frangi(a, s, black=black), sato(a, s, black))
                r = r * a if s >= 2 else r
            else:
                r = f[method](a, s, black=black)
            out = np.maximum(out, r)
        return out

    reach = max(16, math.ceil(4 * max(sigmas)) + 3)
    return over_tiles(df, value, kernel, to, (0, reach, reach), tile, 1, by)


# ------------------------------------------------------------------------------------------------------ single objects


def edt(mask: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Distance of each set voxel to the nearest unset one (outside the array counts as unset), exact, by separable passes."""
    d = np.where(np.pad(mask, 1), np.inf, 0.0)
    if mask.shape[0] == 1:  # a 2D piece: slices above and below are no background
        d = d[1:2]
    for axis in range(3):
        n, s = d.shape[axis], spacing[axis]
        moved = np.moveaxis(d, axis, 0)
        out = moved.copy()
        for k in range(1, n):  # all lines at once, by steps that can still shorten a distance
            cost = k**2 * s * s
            if cost >= out.max():
                break
            np.minimum(out[k:], moved[:-k] + cost, out=out[k:])
            np.minimum(out[:-k], moved[k:] + cost, out=out[:-k])
        d = np.moveaxis(out, 0, axis)
    return np.sqrt(d[:, 1:-1, 1:-1] if mask.shape[0] == 1 else d[1:-1, 1:-1, 1:-1])


def neighbours(full: bool, flat: bool) -> list[tuple[int, int, int]]:
    return [o for o in product([0] if flat else [-1, 0, 1], [-1, 0, 1], [-1, 0, 1]) if any(o) and (full or sum(map(abs, o)) == 1)]


def around(p: tuple[int, ...], moves: list[tuple[int, int, int]], shape: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """The voxels that the moves reach from p within the shape."""
    out = (tuple(int(a) + b for a, b in zip(p, d, strict=True)) for d in moves)
    return [q for q in out if all(0 <= c < n for c, n in zip(q, shape, strict=True))]


def label_components(mask: np.ndarray, full: bool = False) -> tuple[np.ndarray, int]:
    """Components numbered from 1 in order of their first voxel."""
    out = np.zeros(mask.shape, np.int64)
    moves, n = neighbours(full, mask.shape[0] == 1), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        out[start] = n
        stack = [start]
        while stack:
            for p in around(stack.pop(), moves, mask.shape):
                if mask[p] and not out[p]:
                    out[p] = n
                    stack.append(p)
    return out, n


def watershed(landscape: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Meyer's flooding from the markers over rank-1 neighbours, without lines; equal heights go first come, first served."""
    out = np.where(mask, markers, 0).astype(np.int64)
    height = np.nan_to_num(landscape, nan=np.inf, posinf=1e300, neginf=-1e300)
    moves, turn, heap = neighbours(False, mask.shape[0] == 1), 0, []
    for p in zip(*np.nonzero(out), strict=True):
        heap.append((height[p], turn, p))
        turn += 1
    heapq.heapify(heap)
    while heap:
        h, _, at = heapq.heappop(heap)
        for p in around(at, moves, mask.shape):
            if mask[p] and not out[p]:
                out[p] = out[at]
                heapq.heappush(heap, (max(h, height[p]), turn, p))
                turn += 1
    return out


def landscape(mask: np.ndarray, intensity: np.ndarray, weight: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Minus the distance transform, plus the weighted intensity scaled to the object's range."""
    d = np.where(mask, edt(mask, spacing), 0.0)
    if weight <= 0:
        return -d
    low, high = intensity[mask].min(), intensity[mask].max()
    return -d + weight * (intensity - low) / max(high - low, 1e-9) * d.max()


def peaks(field: np.ndarray, mask: np.ndarray, apart: int) -> list[tuple[int, int, int]]:
    """Local maxima of the field, highest first (then by position), none within ``apart`` voxels of a higher one along every axis."""
    moves = neighbours(True, mask.shape[0] == 1)
    wide = np.pad(np.where(mask, field, -np.inf), 1, constant_values=-np.inf)
    top = mask.copy()
    for dz, dy, dx in moves:
        top &= field >= wide[1 + dz : wide.shape[0] - 1 + dz, 1 + dy : wide.shape[1] - 1 + dy, 1 + dx : wide.shape[2] - 1 + dx]
    out: list[tuple[int, int, int]] = []
    for p in sorted(zip(*np.nonzero(top), strict=True), key=lambda p: (-field[p], p)):
        if all(max(abs(int(a) - int(b)) for a, b in zip(p, q, strict=True)) > apart for q in out):
            out.append(tuple(int(c) for c in p))
    return out


def peak_distance(spacing: tuple[float, ...], physical: float) -> int:
    return max(3, round(physical / min(spacing)))


def thin_2d(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen (1984) on a 2D mask."""
    a = np.pad(mask.astype(np.int8), 1)
    changed = True
    while changed:
        changed = False
        for first in (True, False):
            p = [a[:-2, 1:-1], a[:-2, 2:], a[1:-1, 2:], a[2:, 2:], a[2:, 1:-1], a[2:, :-2], a[1:-1, :-2], a[:-2, :-2]]  # clockwise from above
            n = sum(p)
            turns = sum(((p[k] == 0) & (p[(k + 1) % 8] == 1)).astype(np.int8) for k in range(8))
            up, right, down, left = p[0], p[2], p[4], p[6]
            gate = (up * right * down == 0) & (right * down * left == 0) if first else (up * right * left == 0) & (up * down * left == 0)
            gone = (a[1:-1, 1:-1] == 1) & (n >= 2) & (n <= 6) & (turns == 1) & gate
            if gone.any():
                a[1:-1, 1:-1][gone] = 0
                changed = True
    return a[1:-1, 1:-1].astype(bool)


@lru_cache(1 << 20)
def _simple(bits: bytes) -> bool:
    block = np.frombuffer(bits, bool).reshape(3, 3, 3)
    ring = block.copy()
    ring[1, 1, 1] = False
    if not ring.any() or label_components(ring, True)[1] != 1:
        return False
    near = np.zeros((3, 3, 3), bool)
    for p in product(range(3), repeat=3):
        near[p] = sum(abs(c - 1) for c in p) in (1, 2)
    parts, _ = label_components(near & ~block, False)
    return len({int(parts[1 + dz, 1 + dy, 1 + dx]) for dz, dy, dx in neighbours(False, False)} - {0}) == 1


def simple_point(block: np.ndarray) -> bool:
    """Whether the centre of a 3 x 3 x 3 block may go: its object neighbours are one 26-component and its background's 6-paths one.

    Worked out once for each of the blocks that occur.
    """
    return _simple(block.tobytes())


def thin_3d(mask: np.ndarray) -> np.ndarray:
    """Sequential thinning in six directions that keeps topology and end points (after Lee et al. 1994)."""
    a = np.pad(mask, 1)
    changed = True
    while changed:
        changed = False
        for d in neighbours(False, False):
            border = a & ~np.roll(a, d, (0, 1, 2))
            for z, y, x in zip(*np.nonzero(border), strict=True):
                block = a[z - 1 : z + 2, y - 1 : y + 2, x - 1 : x + 2]
                if block.sum() > 2 and simple_point(block):
                    a[z, y, x] = False
                    changed = True
    return a[1:-1, 1:-1, 1:-1]


def skeleton(mask: np.ndarray) -> np.ndarray:
    return thin_2d(mask[0])[None] if mask.shape[0] == 1 else thin_3d(mask)


def degrees(skel: np.ndarray) -> np.ndarray:
    wide = np.pad(skel, 1).astype(np.int64)
    n = sum(wide[1 + dz : wide.shape[0] - 1 + dz, 1 + dy : wide.shape[1] - 1 + dy, 1 + dx : wide.shape[2] - 1 + dx] for dz, dy, dx in neighbours(True, False))
    return np.where(skel, n, 0)


def prune_spurs(skel: np.ndarray, spacing: tuple[float, float, float], longest: float, border: np.ndarray | None = None, passes: int | None = 10) -> np.ndarray:
    """Takes off branches up to ``longest`` that run from an end point to a junction, the shortest first.

    The junction stays; ends on the image's border (a mask) and isolated segments are kept. All that a branch touches are
    its junction and itself, so the number of components stays without a look. passes None: until no such branch is left.
    """
    out = skel.copy()
    moves = neighbours(True, skel.shape[0] == 1)
    for _ in count() if passes is None else range(passes):
        deg = degrees(out)
        spurs = []
        for p in zip(*np.nonzero(out & (deg == 1)), strict=True):
            if border is not None and border[p]:
                continue
            path, length, before, now = [p], 0.0, None, p
            while True:
                ways = [q for q in around(now, moves, out.shape) if out[q] and q != before]
                if not ways:
                    path = []
                    break
                q = next((w for w in ways if deg[w] >= 3), ways[0])
                length += math.sqrt(sum(((a - b) * s) ** 2 for a, b, s in zip(now, q, spacing, strict=True)))
                if deg[q] >= 3 or length > longest:
                    break
                path.append(q)
                before, now = now, q
            if path and length <= longest:
                spurs.append((length, path))
        if not spurs:
            break
        for _, path in spurs:
            for q in path:
                out[q] = False
    return out


@lru_cache(1 << 20)
def _whole(bits: bytes) -> bool:
    return label_components(np.frombuffer(bits, bool).reshape(3, 3, 3), True)[1] == 1


def prune_elbows(skel: np.ndarray, passes: int | None = 3) -> np.ndarray:
    """Takes away voxels with two or more neighbours that hold together without them, in raster order (passes None: all)."""
    out = np.pad(skel, 1)
    for _ in count() if passes is None else range(passes):
        gone = 0
        for z, y, x in zip(*np.nonzero(out), strict=True):
            block = out[z - 1 : z + 2, y - 1 : y + 2, x - 1 : x + 2].copy()
            block[1, 1, 1] = False
            if block.sum() >= 2 and _whole(block.tobytes()):
                out[z, y, x] = False
                gone += 1
        if not gone:
            break
    return out[1:-1, 1:-1, 1:-1]


#: Around a voxel of a slice, clockwise from above; even ones touch its sides.
_RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


@lru_cache(256)
def _gaps(code: int) -> list[int]:
    """A side of each stretch of background around a voxel that touches it; code: which places of the ring are set."""
    unset = [not code >> k & 1 for k in range(8)]
    return [k for k in range(0, 8, 2) if unset[k] and not (unset[k + 1] and unset[(k + 2) % 8])]


def _regions(background: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """A number for each place of a 2D background's row-wise runs, and the union-find forest of its regions over sides."""
    starts = background.copy()
    starts[:, 1:] &= ~background[:, :-1]
    run = (np.cumsum(starts) - 1).reshape(background.shape)
    root = list(range(int(starts.sum())))
    both = background[1:] & background[:-1]
    for a, b in np.unique(np.stack([run[:-1][both], run[1:][both]], 1), axis=0).tolist():
        root[_find(root, a)] = _find(root, b)
    return run, root


def _find(root: list[int], k: int) -> int:
    while root[k] != k:
        root[k] = k = root[root[k]]
    return k


def break_cycles(skel: np.ndarray, thickness: np.ndarray, passes: int | None = 15) -> np.ndarray:
    """Opens loops: takes the thinnest voxel of a loop whose loss keeps the number of components, ``passes`` times (None: until none is left).

    A voxel that parts its component or lies in no loop still does when others have gone, so one look at each, the
    thinnest first, finds them all. In a slice the background tells: a loss joins the regions that meet at the voxel, and
    parts nothing if they are different ones. So the time is that of the voxels and of the box.
    """
    if skel.shape[0] > 1:
        return _break_by_search(skel, thickness, passes)
    wide = np.pad(skel[0], 1)
    run, root = _regions(~wide)
    width = wide.shape[1]
    steps = [dy * width + dx for dy, dx in _RING]
    place = np.flatnonzero(wide)
    order = place[np.argsort(thickness[skel], kind="stable")].tolist()
    fg, region, left = bytearray(wide.tobytes()), run.ravel(), len(order) if passes is None else passes
    for p in order:
        if left <= 0:
            break
        code = sum(fg[p + s] << k for k, s in enumerate(steps))
        if code.bit_count() < 2:
            continue
        gaps = _gaps(code)
        met = {_find(root, region[p + steps[k]]) for k in gaps}
        if len(gaps) > 1 and len(met) < len(gaps):
            continue
        fg[p] = 0
        region[p] = len(root)
        root.append(len(root))
        for r in met:
            root[r] = region[p]
        left -= 1
    return np.frombuffer(fg, bool).reshape(wide.shape)[None, 1:-1, 1:-1].copy()


def _break_by_search(skel: np.ndarray, thickness: np.ndarray, passes: int | None) -> np.ndarray:
    """break_cycles() of any skeleton: peels ends to find its loops, and a depth-first search before each loss finds the cut vertices."""
    out = skel.copy()
    moves = neighbours(True, skel.shape[0] == 1)
    at = [tuple(map(int, p)) for p in zip(*np.nonzero(skel), strict=True)]
    number = {p: k for k, p in enumerate(at)}
    near = [[number[q] for q in around(p, moves, skel.shape) if q in number] for p in at]
    rank = sorted(range(len(at)), key=lambda k: (thickness[at[k]], at[k]))
    for _ in count() if passes is None else range(passes):
        degree = list(map(len, near))
        core = [out[p] for p in at]
        tips = [k for k, d in enumerate(degree) if core[k] and d <= 1]
        while tips:
            k = tips.pop()
            core[k] = False
            for q in near[k]:
                degree[q] -= 1
                if core[q] and degree[q] == 1:
                    tips.append(q)
        if not any(core):
            break
        cut = cut_vertices(near)
        k = next((k for k in rank if core[k] and not cut[k]), None)
        if k is None:
            break
        out[at[k]] = False
        for q in near[k]:
            near[q].remove(k)
        near[k] = []
    return out


def cut_vertices(near: list[list[int]]) -> list[bool]:
    """Whether each vertex of a graph (its neighbours' numbers) parts its component when it goes (Hopcroft and Tarjan 1973)."""
    seen, low, cut, turn = [0] * len(near), [0] * len(near), [False] * len(near), 0
    for root in range(len(near)):
        if seen[root]:
            continue
        turn += 1
        seen[root] = low[root] = turn
        stack, children = [(root, -1, iter(near[root]))], 0
        while stack:
            p, up, ways = stack[-1]
            for q in ways:
                if not seen[q]:
                    turn += 1
                    seen[q] = low[q] = turn
                    stack.append((q, p, iter(near[q])))
                    break
                if q != up:
                    low[p] = min(low[p], seen[q])
            else:
                stack.pop()
                if up == root:
                    children += 1
                elif up >= 0:
                    cut[up] = cut[up] or low[p] >= seen[up]
                if up >= 0:
                    low[up] = min(low[up], low[p])
        cut[root] = children > 1
    return cut


def branches(skel: np.ndarray, spacing: tuple[float, float, float], thickness: np.ndarray | None = None) -> list[dict]:
    """Paths between end points and junction voxels: both ends, length, mean thickness."""
    deg = degrees(skel)
    moves = neighbours(True, skel.shape[0] == 1)
    near = lambda p: [q for q in around(p, moves, skel.shape) if skel[q]]
    step = lambda p, q: math.sqrt(sum(((a - b) * s) ** 2 for a, b, s in zip(p, q, spacing, strict=True)))
    nodes = [tuple(map(int, p)) for p in zip(*np.nonzero(skel & (deg != 2)), strict=True)]
    done, out = set(), []

    def walk(start, q):
        path = [start, q]
        while deg[path[-1]] == 2:
            on = [w for w in near(path[-1]) if w != path[-2]]
            if not on or on[0] in (path[0],):
                path += on[:1]
                break
            path.append(on[0])
        return path

    for p in nodes:
        for q in near(p):
            if (p, q) in done:
                continue
            path = walk(p, q)
            done |= {(path[0], path[1]), (path[-1], path[-2])}
            out.append({"u": path[0], "v": path[-1], "path": path, "length": sum(step(a, b) for a, b in zip(path, path[1:], strict=False)), "thickness": float(np.mean([thickness[w] for w in path])) if thickness is not None else 0.0})
    if not nodes and skel.any():  # a bare loop
        p = tuple(int(c[0]) for c in np.nonzero(skel))
        path = walk(p, near(p)[0])
        out.append({"u": p, "v": path[-1], "path": path, "length": sum(step(a, b) for a, b in zip(path, path[1:], strict=False)), "thickness": 0.0})
    return out


def spanning_tree(edges: list[dict]) -> list[dict]:
    """The maximum spanning forest by thickness (Kruskal)."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for e in sorted(edges, key=lambda e: (-e["thickness"], e["u"], e["v"])):
        a, b = find(e["u"]), find(e["v"])
        if a != b:
            root[a] = b
            out.append(e)
    return out


def cycle_basis(skel: np.ndarray) -> list[list[tuple[int, ...]]]:
    """A basis of the cycles of a skeleton's voxel graph: one for each pair of neighbours that a breadth-first forest leaves out."""
    moves = neighbours(True, skel.shape[0] == 1)
    up: dict = {}
    deep: dict = {}
    out = []
    for start in (tuple(map(int, p)) for p in zip(*np.nonzero(skel), strict=True)):
        if start in up:
            continue
        up[start], deep[start] = None, 0
        queue = [start]
        for p in queue:
            for q in around(p, moves, skel.shape):
                if skel[q] and q not in up:
                    up[q], deep[q] = p, deep[p] + 1
                    queue.append(q)
        for p in queue:
            for q in around(p, moves, skel.shape):
                if skel[q] and p < q and up[p] != q and up[q] != p:
                    left, right = [p], [q]
                    while left[-1] != right[-1]:
                        side = left if deep[left[-1]] >= deep[right[-1]] else right
                        side.append(up[side[-1]])
                    out.append(left + right[-2::-1])
    return out


def open_cycles(skel: np.ndarray, spacing: tuple[float, float, float], thickness: np.ndarray, passes: int = 5) -> np.ndarray:
    """Opens the loops of a 3D skeleton: branches outside the maximum spanning forest by thickness lose their inner voxels.

    Then, for what touches diagonally, the thinnest voxel of each cycle of a basis goes (the first by place on a tie), a
    cycle that has lost a voxel in this pass being open already.
    """
    out = skel.copy()
    edges = branches(out, spacing, thickness)
    tree = {id(e) for e in spanning_tree(edges)}
    for e in edges:
        if id(e) not in tree and e["u"] != e["v"]:  # a loop at one node is opened below
            for p in e["path"][1:-1]:
                out[p] = False
    for _ in range(passes):
        cycles = cycle_basis(out)
        if not cycles:
            break
        for cycle in cycles:
            if all(out[p] for p in cycle):
                out[min(cycle, key=lambda p: (thickness[p], p))] = False
    return out


def skeletonize(labels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), prune_um: float = 0.0, by: tuple[str, ...] = ("label",), id_extent: tuple[int, int, int] | None = None) -> DataFrame:
    """Skeleton voxels (by, z, y, x, branch_length): thinned, all loops opened, all spurs pruned; one grouped map an object.

    branch_length repeats the object's total on every row, and null where there is no branch.
    """
    schema = ", ".join(f"`{c}` {labels.schema[c].dataType.simpleString()}" for c in by) + ", z long, y long, x long, n_paths long, total_length double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, _, (grid,) = dense(pdf.assign(_v=1.0), ["_v"], pad=1)
        mask = grid > 0
        thick = edt(mask, spacing)
        skel = skeleton(mask)
        skel = prune_elbows(break_cycles(skel, thick, None), None) if mask.shape[0] == 1 else open_cycles(skel, spacing, thick)
        if prune_um > 0:
            border = np.zeros_like(skel)
            if id_extent:
                at = np.stack(np.meshgrid(*(np.arange(n) + o for n, o in zip(skel.shape, low, strict=True)), indexing="ij"))
                for k in (1, 2) if skel.shape[0] == 1 else (0, 1, 2):
                    border |= (at[k] <= 0) | (at[k] >= id_extent[k] - 1)
            skel = prune_spurs(skel, spacing, prune_um, border, None)
        paths = branches(skel, spacing, thick)
        at = np.argwhere(skel) + low
        first = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame({**{c: [v] * len(at) for c, v in first.items()}, "z": at[:, 0], "y": at[:, 1], "x": at[:, 2], "n_paths": len(paths), "total_length": sum(p["length"] for p in paths)})

    return labels.select(*by, *(F.col(a).cast("long").alias(a) for a in AXES)).groupBy(*by).applyInPandas(run, schema)


def split_cells(cells: DataFrame, value: str = "intensity", weight: float = 0.0, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Splits each cell by its seeds: rows (by, z, y, x, segment); segment is the seed that floods the voxel.

    cells: (by, z, y, x, value, seed) with null where no seed lies. A cell without seeds is its own segment 0; one with
    a single seed is all that seed's. One grouped map a cell: no chunk, so nothing to stitch.
    """
    schema = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by) + ", z long, y long, x long, segment long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, index, (mask, val, seed) = dense(pdf.assign(_m=1.0, seed=pdf["seed"].fillna(0)), ["_m", value, "seed"])
        mask, markers = mask > 0, seed.astype(np.int64)
        names = np.unique(markers[markers > 0])
        out = np.full(mask.shape, names[0] if len(names) else 0) if len(names) < 2 else watershed(landscape(mask, val, weight, spacing), markers, mask)
        return pdf[[*by, *AXES]].assign(segment=out[index])

    return cells.select(*by, *(F.col(a).cast("long").alias(a) for a in AXES), value, F.col("seed").cast("double").alias("seed")).groupBy(*by).applyInPandas(run, schema)
