"""Outlines of parts and holes as polygons through pixel centres, measured without walking them.

The outline of an eight-connected part runs through the centres of its border pixels. Seen from the
squares between four neighbouring centres it is simple: a square with four set corners lies inside, one
with three is cut along its diagonal, one with two has an edge of the outline or, corner to corner, a
bridge that the outline passes on either side. Area, length and moments of all polygons are therefore
sums over these squares, taken for all labels at once.
"""

from __future__ import annotations

import numpy as np

#: The corners of a square: top left, top right, bottom left, bottom right.
_CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def squares(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, four labels) of the squares in which a label ends or lies, with a clear margin around the image; all-clear squares are left out."""
    wide = np.pad(label, 1)
    four = np.stack([wide[dy : wide.shape[0] - 1 + dy, dx : wide.shape[1] - 1 + dx] for dy, dx in _CORNERS], -1)
    y, x = np.nonzero(four.any(-1))
    return y - 1, x - 1, four[y, x]


def polygons(label: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Area, length, and centre (cy, cx) of the outline of each part 1 to n; holes in a part have to be filled.

    A part without area, a dot or a thin line, has the mean of its pixels as its centre.
    """
    y, x, four = squares(label)
    area, length, my, mx = (np.zeros(n + 1) for _ in range(4))
    names = four.max(1)
    mine = four == names[:, None]  # eight-connected parts never share a square
    count = mine.sum(1)
    full, cut = count == 4, count == 3
    bridge = (count == 2) & (mine[:, 0] == mine[:, 3])
    edge = (count == 2) & ~bridge
    at = lambda w: np.bincount(names, w, n + 1)
    area += at(full + 0.5 * cut)
    length += at(edge + np.sqrt(2) * (cut + 2 * bridge))
    corner = np.array(_CORNERS, np.float64)
    inside = mine / np.maximum(count, 1)[:, None]
    weight = full + 0.5 * cut
    my += at(weight * (y + inside @ corner[:, 0]))
    mx += at(weight * (x + inside @ corner[:, 1]))
    py, px = np.nonzero(label)
    own = label[py, px]
    size = np.maximum(np.bincount(own, minlength=n + 1), 1)
    some = area > 0
    room = np.where(some, area, 1)
    cy = np.where(some, my / room, np.bincount(own, py, n + 1) / size)
    cx = np.where(some, mx / room, np.bincount(own, px, n + 1) / size)
    return {"area": area[1:], "length": length[1:], "cy": cy[1:], "cx": cx[1:]}


def hole_polygons(mask: np.ndarray, label: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Area and centre of the outline of each hole 1 to n (four-connected clear regions), through the set pixels around it."""
    area, my, mx = (np.zeros(n + 1) for _ in range(3))
    four = np.stack([label[dy : label.shape[0] - 1 + dy, dx : label.shape[1] - 1 + dx] for dy, dx in _CORNERS], -1)
    y, x = np.nonzero(four.any(-1))
    four = four[y, x]
    set_ = np.stack([mask[y + dy, x + dx] for dy, dx in _CORNERS], -1)
    corner = np.array(_CORNERS, np.float64)
    count = set_.sum(1)
    bridge = (count == 2) & (set_[:, 0] == set_[:, 3])
    # Corners that are cut off: one of three or of a bridge. The clear pixel's triangle belongs to its hole.
    for k in range(4):
        near = [(k ^ 1), (k ^ 2)]
        own = (four[:, k] > 0) & ((count == 3) | bridge)
        name, c = four[own, k], (corner[k] + corner[near[0]] + corner[near[1]]) / 3
        area += np.bincount(name, minlength=n + 1) * 0.5
        my += np.bincount(name, 0.5 * (y[own] + c[0]), n + 1)
        mx += np.bincount(name, 0.5 * (x[own] + c[1]), n + 1)
    whole = (count < 3) & ~bridge
    name = four[whole].max(1)
    area += np.bincount(name, minlength=n + 1)
    my += np.bincount(name, y[whole] + 0.5, n + 1)
    mx += np.bincount(name, x[whole] + 0.5, n + 1)
    room = np.where(area > 0, area, 1)
    return {"area": area[1:], "cy": (my / room)[1:], "cx": (mx / room)[1:]}


def hole_border(mask: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hole, y, x): the set pixels beside each hole, each once."""
    h, w = mask.shape
    y, x = np.nonzero(label)
    own = label[y, x]
    parts = []
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        yy, xx = y + dy, x + dx
        ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        ok[ok] = mask[yy[ok], xx[ok]]
        parts.append((own[ok].astype(np.int64) * h + yy[ok]) * w + xx[ok])
    code = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return code // (h * w), code // w % h, code % w


def hull(points: np.ndarray) -> np.ndarray:
    """Corners (x, y) of the convex hull of points (x, y), turning one way; of each row only the ends can be corners."""
    if not len(points):
        return np.zeros((0, 2))
    order = np.lexsort((points[:, 0], points[:, 1]))
    p = points[order]
    first = np.flatnonzero(np.diff(p[:, 1], prepend=p[0, 1] - 1))
    last = np.append(first[1:], len(p)) - 1

    left, right = _chain(p[first].tolist(), -1), _chain(p[last].tolist(), 1)
    ring = left + right[::-1]
    return np.array([q for i, q in enumerate(ring) if q != ring[i - 1]] or ring[:1], np.float64)


def _chain(rows: list, sign: int) -> list[tuple[float, float]]:
    """Of the ends (x, y) of rows, top to bottom, those at which the hull turns."""
    out: list[tuple[float, float]] = []
    for x, y in rows:
        while len(out) > 1 and sign * ((out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0])) <= 0:
            out.pop()
        out.append((x, y))
    return out


def rows_area(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """Area of the hull of rows y, each once and rising, that run from low to high, all whole numbers."""
    rows = y.tolist()
    ring = _chain(list(zip(low.tolist(), rows, strict=True)), -1) + _chain(list(zip(high.tolist(), rows, strict=True)), 1)[::-1]
    return abs(sum(x * v - y * u for (x, y), (u, v) in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring.T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def profile(y: np.ndarray, x: np.ndarray, cy: float, cx: float, bins: int = 360) -> np.ndarray:
    """Distance of border points from the centre at the middle of each of ``bins`` equal angles, linear in between and around."""
    angle = np.arctan2(y - cy, x - cx)
    order = np.argsort(angle, kind="stable")
    middles = (np.arange(bins) + 0.5) * (2 * np.pi / bins) - np.pi
    return np.interp(middles, angle[order], np.hypot(y - cy, x - cx)[order], period=2 * np.pi)
