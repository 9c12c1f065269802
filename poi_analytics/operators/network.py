"""Fitting the click network on every row of a training set: sums over cells, L-BFGS on the driver.

The network, its loss and its minimizer are those of Spark's ``MultilayerPerceptronClassifier`` (sigmoid layers, softmax on
top, mean log loss, L-BFGS with 10 corrections and a strong Wolfe line search, same first weights).  That class keeps
every row as a vector of doubles, user and item factors included; here a row is two places and a label, and the first
layer, which is linear, is taken once a user and once an item of a cell.  An evaluation is one job over the written cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .grid import Arrays, Grid

#: Rows of a cell taken at a time (their layers fit a core's cache).
TILE = 1_024
MEMORY, TOLERANCE = 10, 1e-6

Weights = list[tuple[np.ndarray, np.ndarray]]


def layers_of(weights: np.ndarray, sizes: list[int]) -> Weights:
    """(matrix, bias) of each layer, in the order of Spark's vector of weights."""
    out, at = [], 0
    for n_in, n_out in zip(sizes, sizes[1:]):
        cut = at + n_in * n_out
        out.append((weights[at:cut].reshape(n_in, n_out), weights[cut:cut + n_out]))
        at = cut + n_out
    return out


def _sigmoid_of(x: np.ndarray) -> np.ndarray:
    """In place."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def loss_and_gradient(cell: Arrays, users: Arrays, items: Arrays, weights: np.ndarray, sizes: list[int], rank: int,
                      kind: type = np.float32) -> np.ndarray:
    """(number of rows, their summed loss, its gradient by the weights) of one cell.

    Tiles are computed in ``kind`` and summed in double.  District and numbers stand at the items, or at the rows.
    """
    n = len(cell["u"])
    (first, b1), (second, b2), (third, b3) = layers = [(w.astype(kind), b.astype(kind)) for w, b in layers_of(weights, sizes)]
    sums = [(np.zeros(w.shape), np.zeros(b.shape)) for w, b in layers]
    districts = sizes[0] - 2 * rank - 3
    w_user, w_item, w_rest = first[:rank], first[rank:2 * rank], first[2 * rank:]
    loss = 0.0
    if n:
        uf, vf = users["features"].astype(kind, copy=False), items["features"].astype(kind, copy=False)
        own = "district_idx" in cell
        holder = cell if own else items
        numbers = np.column_stack([holder[c] for c in ("price", "heat", "score")]).astype(kind)
        district = holder["district_idx"].astype(np.int32)
        from_user, from_item = uf @ w_user, vf @ w_item + b1
        if not own:
            from_item += w_rest[:districts][district] + numbers @ w_rest[districts:]
        top = third[:, 1] - third[:, 0]
    for a in range(0, n, TILE):
        u, i = cell["u"][a:a + TILE], cell["i"][a:a + TILE]
        at = slice(a, a + TILE) if own else i
        label = cell["label"][a:a + TILE]
        y = from_user[u]
        y += from_item[i]
        if own:
            y += w_rest[:districts][district[at]] + numbers[at] @ w_rest[districts:]
        y = _sigmoid_of(y)
        z = _sigmoid_of(y @ second + b2)
        odds = (z @ top).astype(float) + float(b3[1] - b3[0])
        loss += float((np.logaddexp(0, odds) - label * odds).sum())
        with np.errstate(over="ignore"):
            off = 1 / (1 + np.exp(-odds)) - label
        g = off.astype(kind)
        by_top = z.T @ g
        sums[2][0][:, 1] += by_top
        sums[2][0][:, 0] -= by_top
        sums[2][1][:] += off.sum() * np.array([-1, 1])
        dz = g[:, None] * top
        dz *= z
        z -= 1
        dz *= z
        np.negative(dz, out=dz)
        sums[1][0][:] += y.T @ dz
        sums[1][1][:] += dz.sum(0)
        dy = dz @ second.T
        dy *= y
        y -= 1
        dy *= y
        np.negative(dy, out=dy)
        starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))  # rows are sorted by user
        if len(starts) * 4 < len(u):
            sums[0][0][:rank] += uf[u[starts]].T @ np.add.reduceat(dy, starts, axis=0)
        else:
            sums[0][0][:rank] += uf[u].T @ dy
        sums[0][0][rank:2 * rank] += vf[i].T @ dy
        rest = np.zeros((len(u), districts + 3), kind)
        rest[np.arange(len(u)), district[at]] = 1
        rest[:, districts:] = numbers[at]
        sums[0][0][2 * rank:] += rest.T @ dy
        sums[0][1][:] += dy.sum(0)
    return np.concatenate([[n, loss], *(x.ravel() for s in sums for x in s)])


def fit(grid: Grid, first: np.ndarray, sizes: list[int], rank: int, max_iter: int) -> np.ndarray:
    """The weights after at most ``max_iter`` steps of L-BFGS on the mean loss of all rows of ``grid``."""
    def mean(weights: np.ndarray) -> tuple[float, np.ndarray]:
        found = grid.map(lambda cell, users, items: loss_and_gradient(cell, users, items, weights, sizes, rank)).treeReduce(np.add)
        if not found[0]:
            raise ValueError("no row has both a user's and an item's factors, so there is nothing to fit")
        return found[1] / found[0], found[2:] / found[0]

    return minimized(mean, first, max_iter)


# ---- L-BFGS as in Breeze, which Spark's classifier uses -------------------------------

def minimized(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int) -> np.ndarray:
    """L-BFGS from ``x``; stops early where the gradient or 20 steps' gain is within TOLERANCE of the value."""
    value, gradient = f(x)
    steps, values, turn = [], [value], 0
    while turn < max_iter and np.linalg.norm(gradient) > max(TOLERANCE * value, 1e-8):
        direction = -_scaled(gradient, steps)
        found = _wolfe(f, x, value, gradient, direction, 1.0 if steps else 1 / np.linalg.norm(direction))
        if found is None:  # no lower point along this direction: once more along the gradient, then stop
            if not steps:
                break
            steps = []
            continue
        point, value, new = found
        steps = [*steps, (point - x, new - gradient)][-MEMORY:]
        x, gradient = point, new
        turn += 1
        if abs(value - max(values[-20:])) <= TOLERANCE * values[0]:
            break
        values.append(value)
    return x


def _scaled(gradient: np.ndarray, steps: list) -> np.ndarray:
    q, used = gradient.copy(), []
    for s, y in reversed(steps):
        rho = 1 / max(s @ y, 1e-300)
        a = rho * (s @ q)
        q -= a * y
        used.append((rho, a))
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), (rho, a) in zip(steps, reversed(used)):
        q += s * (a - rho * (y @ q))
    return q


def _wolfe(f, x: np.ndarray, value: float, gradient: np.ndarray, direction: np.ndarray, t: float,
           c1: float = 1e-4, c2: float = 0.9, most: int = 10):
    """(point, value, gradient) on the line where the strong Wolfe conditions hold, or None."""
    slope = float(gradient @ direction)
    if slope >= 0:
        return None
    seen: dict[float, tuple] = {}

    def phi(t: float) -> tuple[float, float, float]:
        point = x + t * direction
        v, g = f(point)
        seen[t] = (point, v, g)
        return t, v, float(g @ direction)

    def between(l, r) -> float:
        """The minimum of the cubic through two points, kept off the ends."""
        d1 = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
        under = d1 * d1 - l[2] * r[2]
        low, high = l[0] + 0.1 * (r[0] - l[0]), l[0] + 0.9 * (r[0] - l[0])
        if under < 0:
            return (low + high) / 2
        d2 = np.sqrt(under)
        return min(max(r[0] - (r[0] - l[0]) * (r[2] + d2 - d1) / (r[2] - l[2] + 2 * d2), low), high)

    def zoom(low, high):
        for _ in range(most):
            c = phi(between(high, low) if low[0] > high[0] else between(low, high))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(slope):
                    return seen[c[0]]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        return seen[low[0]] if low[0] else None

    low = (0.0, value, slope)
    for turn in range(most):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and turn):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return seen[t]
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    return seen[low[0]] if low[0] else None
