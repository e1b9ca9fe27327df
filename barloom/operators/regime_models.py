"""Per-series models: clusters and decoding as folds over a key's rows (at most one per calendar day) inside the JVM; the rounds
that estimate a hidden Markov model in NumPy, on the same arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, running, spread
from ..functions.matrices import cholesky, inverse_of, let, log_determinant, total

STATES = 3
LLOYD_STEPS, LLOYD_TOLERANCE = 300, 1e-10
EM_STEPS, EM_TOLERANCE = 200, 1e-3
COV_FLOOR = 1e-2
TINY = 1e-12
SCAN_BLOCK = 32
SIDE_BY_SIDE = 131_072  # points of the series that are estimated together
AT_ONCE = 8 * SIDE_BY_SIDE  # points that a task holds as arrays
P, M = ("p0", "p1", "p2"), ("_m0", "_m1", "_m2")  # posteriors and mean return of each state


def _packed(df: DataFrame, keys, *also: Column) -> DataFrame:
    """One row per key: `_rows`, its rows in order of date, and the aggregates `also`."""
    rest = [c for c in df.columns if c not in keys and c != "date"]
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", *rest))).alias("_rows"), *also)


def _unpacked(packed: DataFrame, df: DataFrame, keys, bound: Column, made: dict[str, Callable[[Column, Column, Column], Column]]) -> DataFrame:
    """The rows of `df` again, with the columns that `made` gets from a row, the number of used rows before it, and `bound`.

    `bound` is what a key's rows share; it is worked out once (a column would be inlined and worked out for every row).
    """
    names = [c for c in df.columns if c not in keys]
    # places are settled while the arrays are at hand, so that a row doesn't carry them
    at = F.aggregate(
        "_rows",
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda a, r: F.struct((a["n"] + r["_use"].cast("int")).alias("n"), F.array_append(a["at"], a["n"]).alias("at")),
        lambda a: a["at"],
    )

    def shaped(given: Column) -> Column:
        row = lambda r, k: F.struct(r.alias("row"), *[F.when(r["_use"], f(r, k, given)).alias(n) for n, f in made.items()])
        return F.zip_with("_rows", at, row)

    out = packed.select(*keys, F.explode(let(bound, shaped)).alias("_r"))
    return out.select(*keys, *[F.col(f"_r.row.{c}").alias(c) for c in names], *[F.col(f"_r.{n}").alias(n) for n in made])


# ---- clusters ----


def _nearest(x: Column, centers: Column, d: int) -> Column:
    """Number of the closest centre, the smaller one of two as close."""

    def gap(k: int) -> Column:
        center = F.get(centers, F.lit(k))
        parts = [F.get(x, F.lit(j)) - F.get(center, F.lit(j)) for j in range(d)]
        return sum((p * p for p in parts[1:]), parts[0] * parts[0])

    pick = lambda g: F.when((g[0] <= g[1]) & (g[0] <= g[2]), 0).when(g[1] <= g[2], 1).otherwise(2)
    return let(F.array(*[gap(k) for k in range(STATES)]), pick)


def _coordinate(j: int) -> Callable[[Column], Column]:
    return lambda x: F.get(x, F.lit(j))


def _mean(rows: Column, d: int, otherwise: Column) -> Column:
    sums = [total(F.transform(rows, _coordinate(j))) for j in range(d)]
    return F.when(F.size(rows) > 0, F.array(*[F.try_divide(s, F.size(rows)) for s in sums])).otherwise(otherwise)


def lloyd(xs: Column, d: int, steps: int = LLOYD_STEPS) -> Column:
    """Three cluster centres of an array of points; NULL without points.

    The start is the mean of each third of the points in order (by the first coordinate, then the next ones; the first thirds are
    longer by one where they can't be equal). It ends when no coordinate of a centre moves by `LLOYD_TOLERANCE`; a cluster
    without points keeps its centre.
    """
    none = F.array(*[F.lit(0.0)] * d)

    def thirds(ordered: Column) -> Column:
        n, q = F.size(ordered), F.floor(F.size(ordered) / STATES).cast("int")
        more = n - q * STATES
        parts = [F.slice(ordered, q * k + F.least(F.lit(k), more) + 1, q + (F.lit(k) < more).cast("int")) for k in range(STATES)]
        return F.array(*[_mean(p, d, none) for p in parts])

    def step(acc: Column, i: Column) -> Column:
        def moved(labels: Column) -> Column:
            def center(k: int) -> Column:
                own = F.filter(xs, lambda x, at: F.get(labels, at) == k)
                return let(own, lambda rows: _mean(rows, d, F.get(acc["centers"], F.lit(k))))

            return F.array(*[center(k) for k in range(STATES)])

        def judged(new: Column) -> Column:
            gaps = F.zip_with(F.flatten(new), F.flatten(acc["centers"]), lambda a, b: F.abs(a - b))
            return F.struct(new.alias("centers"), (F.array_max(gaps) < LLOYD_TOLERANCE).alias("done"))

        new = let(F.transform(xs, lambda x: _nearest(x, acc["centers"], d)), moved)
        return F.when(acc["done"], acc).otherwise(let(new, judged))

    start = F.struct(let(F.sort_array(xs), thirds).alias("centers"), F.lit(False).alias("done"))
    return F.when(F.size(xs) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["centers"]))


def cluster_states(df: DataFrame, columns, keys=KEYS, steps: int = LLOYD_STEPS) -> DataFrame:
    """Rows plus `state`, the closest of three centres fitted per key to its `_fit` rows; NULL where `_use` is false."""
    columns, d = list(columns), len(columns)
    point = lambda r: F.array(*[r[c] for c in columns])
    packed = _packed(df, keys)
    packed = packed.withColumn("_xs", F.transform(F.filter("_rows", lambda r: r["_fit"]), point))
    state = lambda r, at, centers: F.when(centers.isNotNull(), _nearest(point(r), centers, d))
    return _unpacked(packed, df, keys, lloyd(F.col("_xs"), d, steps), {"state": state})


# ---- Gaussian hidden Markov model: start (3), trans (3 x 3 in one array), mean (3 x d), cov (3 x d x d) ----


def _log_densities(xs: Column, mean: Column, cov: Column, d: int) -> Column:
    """Array of three log densities for each point."""

    def shape(k: int) -> Column:
        """Constant, mean, and the upper triangle of the precision with doubled off-diagonals."""
        whole = F.get(cov, F.lit(k))

        def of(factor: Column) -> Column:
            constant = -0.5 * log_determinant(factor) - 0.5 * d * log(2 * pi)
            entry = lambda p, i, j: F.get(F.get(p, F.lit(i)), F.lit(j)) * (1.0 if i == j else 2.0)
            upper = let(inverse_of(factor), lambda p: F.array(*[entry(p, i, j) for i in range(d) for j in range(i, d)]))
            return F.concat(F.array(constant), F.get(mean, F.lit(k)), upper)

        rows = F.array(*[F.slice(whole, i * d + 1, d) for i in range(d)])
        return let(cholesky(rows), of)

    def density(x: Column, p: Column) -> Column:
        gaps = F.array(*[F.get(x, F.lit(i)) - F.get(p, F.lit(1 + i)) for i in range(d)])

        def form(g: Column) -> Column:
            at, parts = 1 + d, []
            for i in range(d):
                inner = F.get(p, F.lit(at)) * g[i]
                for j in range(i + 1, d):
                    inner = inner + F.get(p, F.lit(at + j - i)) * g[j]
                parts.append(inner * g[i])
                at += d - i
            return F.get(p, F.lit(0)) - 0.5 * sum(parts[1:], parts[0])

        return let(gaps, form)

    shapes = F.array(*[shape(k) for k in range(STATES)])
    return let(shapes, lambda s: F.transform(xs, lambda x: F.array(*[density(x, F.get(s, F.lit(k))) for k in range(STATES)])))


def _scaled(logs: Column) -> Column:
    """Densities over the largest one of their row, and the log of that."""
    row = lambda b: let(F.array_max(b), lambda m: F.array(*[F.exp(b[k] - m) for k in range(STATES)], m))
    return F.transform(logs, row)


def _scan(rows: Column, first: Column, kept: str, step: Callable[[Column, Column], Column]) -> Column:
    """All states of a fold over `rows`: struct(path: those arrays of `kept` type, last: the last state).

    `step(last, row)` gives struct(out, last). An array can't be appended to in place, so blocks of rows are folded on their own: a
    row is copied about as often as a block has rows, not as often as its series has.
    """
    n = F.size(rows)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / SCAN_BLOCK).cast("int") - 1), lambda i: F.slice(rows, i * SCAN_BLOCK + 1, SCAN_BLOCK))

    def inside(last: Column, block: Column) -> Column:
        def one(acc: Column, row: Column) -> Column:
            return let(step(acc["last"], row), lambda s: F.struct(F.array_append(acc["path"], s["out"]).alias("path"), s["last"].alias("last")))

        return F.aggregate(block, F.struct(F.array().cast(f"array<{kept}>").alias("path"), last.alias("last")), one)

    def outside(acc: Column, block: Column) -> Column:
        return let(inside(acc["last"], block), lambda s: F.struct(F.array_append(acc["path"], s["path"]).alias("path"), s["last"].alias("last")))

    zero = F.struct(F.array().cast(f"array<array<{kept}>>").alias("path"), first.alias("last"))
    none = F.struct(F.array().cast(f"array<{kept}>").alias("path"), first.alias("last"))
    whole = F.aggregate(blocks, zero, outside, lambda a: F.struct(F.flatten(a["path"]).alias("path"), a["last"].alias("last")))
    return F.when(n > 0, whole).otherwise(none)


def _share(values: Column) -> Column:
    return let(total(values), lambda s: F.transform(values, lambda v: v / s))


def _forward(scaled: Column, start: Column, trans: Column) -> Column:
    """Filtered state shares by row."""

    def shares(r: Column) -> Column:
        return let(r[0] + r[1] + r[2], lambda size: F.array(*[r[j] / size for j in range(STATES)]))

    def step(last: Column, b: Column) -> Column:
        into = lambda j: sum((last[i] * trans[STATES * i + j] for i in range(1, STATES)), last[0] * trans[j])
        raw = F.array(*[into(j) * b[j] for j in range(STATES)])
        return let(let(raw, shares), lambda a: F.struct(a.alias("out"), a.alias("last")))

    def run(begin: Column) -> Column:
        rest = _scan(F.slice(scaled, 2, F.greatest(F.size(scaled) - 1, F.lit(0))), begin, "array<double>", step)
        return F.concat(F.array(begin), rest["path"])

    first = let(scaled[0], lambda b: F.array(*[start[j] * b[j] for j in range(STATES)]))
    return let(let(first, shares), run)


def _backward(scaled: Column, trans: Column) -> Column:
    """Shares of what is still to come, by row."""
    even = F.array(*[F.lit(1.0 / STATES)] * STATES)

    def step(last: Column, b: Column) -> Column:
        def back(w: Column) -> Column:
            out = lambda i: sum((trans[STATES * i + j] * w[j] for j in range(1, STATES)), trans[STATES * i] * w[0])
            return F.array(*[out(i) for i in range(STATES)])

        def shares(r: Column) -> Column:
            return let(r[0] + r[1] + r[2], lambda size: F.array(*[r[j] / size for j in range(STATES)]))

        raw = let(F.array(*[b[j] * last[j] for j in range(STATES)]), back)
        return let(let(raw, shares), lambda a: F.struct(a.alias("out"), a.alias("last")))

    later = F.slice(F.reverse(scaled), 1, F.size(scaled) - 1)
    return F.reverse(F.concat(F.array(even), _scan(later, even, "array<double>", step)["path"]))


def _posteriors(ahead: Column, back: Column) -> Column:
    return F.zip_with(ahead, back, lambda a, b: _share(F.array(*[a[k] * b[k] for k in range(STATES)])))


def posteriors(logs: Column, start: Column, trans: Column) -> Column:
    """State probabilities of each row given all rows."""
    of = lambda s: _posteriors(_forward(s, start, trans), _backward(s, trans))
    return F.when(F.size(logs) > 0, let(_scaled(logs), of))


def best_path(logs: Column, start: Column, trans: Column) -> Column:
    """Most likely state sequence: a fold that keeps back-pointers, then one that follows them from the end. Ties go to the smaller state."""
    safe = lambda p: F.when(p > 0, F.ln(p)).otherwise(float("-inf"))
    place = lambda c: F.when((c[0] >= c[1]) & (c[0] >= c[2]), 0).when(c[1] >= c[2], 1).otherwise(2)

    def run(steps: Column) -> Column:
        def step(score: Column, b: Column) -> Column:
            def later(came: Column) -> Column:
                """came: for each state the three scores of coming from each state."""
                best = [F.greatest(*[came[j][i] for i in range(STATES)]) + b[j] for j in range(STATES)]
                return F.struct(F.array(*[place(came[j]) for j in range(STATES)]).alias("out"), F.array(*best).alias("last"))

            return let(F.array(*[F.array(*[score[i] + steps[STATES * i + j] for i in range(STATES)]) for j in range(STATES)]), later)

        begin = let(logs[0], lambda b: F.array(*[safe(start[j]) + b[j] for j in range(STATES)]))
        return let(begin, lambda score: _scan(F.slice(logs, 2, F.greatest(F.size(logs) - 1, F.lit(0))), score, "array<int>", step))

    def follow(found: Column) -> Column:
        def step(at: Column, back: Column) -> Column:
            return let(F.get(back, at), lambda s: F.struct(s.alias("out"), s.alias("last")))

        def whole(last: Column) -> Column:
            return F.reverse(F.concat(F.array(last), _scan(F.reverse(found["path"]), last, "int", step)["path"]))

        return let(let(found["last"], place), whole)

    return F.when(F.size(logs) > 0, let(let(F.transform(trans, safe), run), follow))


def placed(rows: DataFrame, found: DataFrame, keys, whole=()) -> DataFrame:
    """The rows with the values that `found` lists per key for its `_use` rows, in order of date; those of `whole` are a key's own."""
    names = [c for c in found.columns if c not in keys and c not in whole]
    at = F.count_if("_use").over(running(keys)).cast("int") - 1
    joined = rows.withColumn("_at", at).join(found, list(keys), "left")
    listed = [F.when(F.col("_use"), F.get(F.col(n), F.col("_at"))).alias(n) for n in names]
    return joined.select(*[F.col(c) for c in rows.columns], *listed, *whole)


def _padded(points: list[np.ndarray], length: int) -> np.ndarray:
    """Series as one array (place in time, feature, series), zero after a series' end."""
    out = np.zeros((length, points[0].shape[1], len(points)))
    for k, x in enumerate(points):
        out[: len(x), :, k] = x
    return out


def _thirds(x: np.ndarray) -> np.ndarray:
    """The start of `lloyd` for one series: the means of the thirds of its points in order."""
    parts = np.array_split(x[np.lexsort(x.T[::-1])], STATES)
    return np.array([p.sum(0) / len(p) if len(p) else np.zeros(x.shape[1]) for p in parts])


def _centers(x: np.ndarray, n: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """`lloyd` for many series side by side: x as of `_padded`, n their lengths, centers (state, feature, series)."""
    out, own = np.empty_like(centers), np.arange(len(n))
    real = np.arange(len(x))[:, None] < n
    for _ in range(LLOYD_STEPS):
        gap = np.array([((x - c) ** 2).sum(1) for c in centers])
        label = np.where(real, gap.argmin(0), -1)
        moved = np.empty_like(centers)
        for k in range(STATES):
            held = label == k
            count = held.sum(0)
            moved[k] = np.where(count > 0, (x * held[:, None]).sum(0) / np.maximum(count, 1), centers[k])
        done = np.abs(moved - centers).max((0, 1)) < LLOYD_TOLERANCE
        centers = moved
        if done.any():
            out[..., own[done]] = centers[..., done]
            x, n, centers, own, real = x[..., ~done], n[~done], centers[..., ~done], own[~done], real[:, ~done]
            if not len(own):
                return out
    out[..., own] = centers
    return out


def _densities(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log densities (place in time, state, series)."""
    length, d, many = x.shape
    whole = cov.transpose(3, 0, 1, 2)
    inverse, constant = np.linalg.inv(whole).transpose(1, 2, 3, 0), np.linalg.slogdet(whole)[1].T + d * log(2 * pi)
    b = np.empty((length, STATES, many))
    for k in range(STATES):
        gap, form = x - mean[k], constant[k]
        for i in range(d):
            inner = inverse[k, i, i] * gap[:, i]
            for j in range(i + 1, d):
                inner += 2.0 * inverse[k, i, j] * gap[:, j]
            inner *= gap[:, i]
            form = form + inner
        np.multiply(form, -0.5, out=b[:, k])
    return b


def _expected(x: np.ndarray, n: np.ndarray, start: np.ndarray, trans: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple:
    """State posteriors, expected moves and the log likelihood of many series, the longest first."""
    length = len(x)
    real = np.arange(length)[:, None] < n
    b = _densities(x, mean, cov)
    shift = b.max(1)
    b -= shift[:, None]
    np.exp(b, out=b)
    alpha, beta, size = np.zeros_like(b), np.full_like(b, 1.0 / STATES), np.ones((length, len(n)))
    active = real.sum(1).tolist()
    turned, cells = np.ascontiguousarray(trans.transpose(1, 0, 2)), np.empty_like(trans)
    for t in range(length):
        m = active[t]
        here, into, held = alpha[t, :, :m], size[t, :m], cells[..., :m]
        if t == 0:
            np.multiply(start, b[0], out=here)
        else:
            np.multiply(trans[..., :m], alpha[t - 1, :, None, :m], out=held)
            np.add.reduce(held, 0, out=here)
            here *= b[t, :, :m]
        np.add.reduce(here, 0, out=into)
        here /= into
    scale = np.ones((length, len(n)))
    for t in range(length - 2, -1, -1):
        m = active[t + 1]
        here, into, held = beta[t, :, :m], scale[t, :m], cells[..., :m]
        worth = b[t + 1, :, :m] * beta[t + 1, :, :m]
        np.multiply(turned[..., :m], worth[:, None], out=held)
        np.add.reduce(held, 0, out=here)
        np.add.reduce(here, 0, out=into)
        here /= into
    gamma = alpha * beta
    weight = gamma.sum(1)
    weight += ~real
    # a move's share of its day: alpha, trans, and density and beta of the next day, over the sum of alpha and beta of that day
    ahead = b[1:] * beta[1:]
    ahead *= real[1:, None]
    ahead /= (scale[:-1] * weight[:-1])[:, None]
    moves = np.array([[np.einsum("ts,ts->s", alpha[:-1, i], ahead[:, j]) for j in range(STATES)] for i in range(STATES)]) * trans
    like = np.where(real, np.log(size) + shift, 0.0).sum(0)
    gamma /= weight[:, None]
    return gamma, moves, like


def _improved(x: np.ndarray, gamma: np.ndarray, moves: np.ndarray) -> tuple:
    """start, trans, mean and cov of the next round."""
    d = x.shape[1]
    weight = gamma.sum(0) + TINY
    trans = moves + TINY
    mean = np.array([[np.einsum("ts,ts->s", gamma[:, k], x[:, j]) for j in range(d)] for k in range(STATES)]) / weight[:, None]
    cov = np.empty((STATES, d, d, x.shape[2]))
    for k in range(STATES):
        gap = x - mean[k]
        for i in range(d):
            shared = gamma[:, k] * gap[:, i]
            for j in range(i, d):
                cov[k, i, j] = cov[k, j, i] = (np.einsum("ts,ts->s", shared, gap[:, j]) + (COV_FLOOR if i == j else 0.0)) / weight[k]
    return gamma[0], trans / trans.sum(1, keepdims=True), mean, cov


def _begin(points: list[np.ndarray]) -> tuple:
    """Arrays of some series before the first round: the centres, one shared covariance and even chances."""
    n, d = np.array([len(x) for x in points]), points[0].shape[1]
    x = _padded(points, n.max())
    mean = _centers(x, n, np.stack([_thirds(p) for p in points], -1))
    shared = np.stack([np.cov(p.T).reshape(d, d) if len(p) > 1 else np.zeros((d, d)) for p in points], -1)
    cov = np.broadcast_to(shared + COV_FLOOR * np.eye(d)[..., None], (STATES, d, d, len(n)))
    even = np.full((STATES, len(n)), 1 / STATES)
    return x, n, even, np.full((STATES, STATES, len(n)), 1 / STATES), mean, cov


def _estimate(points: list[np.ndarray], steps: int, tolerance: float) -> list[tuple]:
    """Per series start, trans, mean, cov, log likelihood and steps.

    Series of like length go through the rounds side by side (arrays end with the series); finished ones make room for the next.
    """
    queue = sorted(range(len(points)), key=lambda k: -len(points[k]))
    out: list = [None] * len(points)
    own, state, like, step = np.array([], int), None, np.array([]), np.array([], int)
    while queue or len(own):
        most = max(1, SIDE_BY_SIDE // max(len(points[queue[0]]) if queue else 1, 1))
        if queue and len(own) <= most * 3 // 4:  # newcomers are no longer than those at work, so the order stays
            new, queue = queue[: most - len(own)], queue[most - len(own) :]
            fresh = _begin([points[k] for k in new])
            if len(own):
                gap = len(state[0]) - len(fresh[0])
                fresh = (np.pad(fresh[0], ((0, gap), (0, 0), (0, 0))), *fresh[1:])
                state = tuple(np.concatenate([a, b], -1) for a, b in zip(state, fresh, strict=True))
            else:
                state = fresh
            own, like, step = np.append(own, new), np.append(like, np.full(len(new), -np.inf)), np.append(step, np.zeros(len(new), int))
        x, n, *model = state
        gamma, moves, now = _expected(x, n, *model)
        step = step + 1
        ended = now - like < tolerance
        better = _improved(x, gamma, moves)
        model = [np.where(ended, old, new) for old, new in zip(model, better, strict=True)]
        like, done = now, ended | (step == steps)
        for k in np.flatnonzero(done):
            out[own[k]] = (*(m[..., k] for m in model), like[k], step[k])
        keep = ~done
        own, like, step = own[keep], like[keep], step[keep]
        longest = n[keep].max() if len(own) else 0
        state = (x[:longest, :, keep] if done.any() else x, n[keep], *(m[..., keep] for m in model))
    return out


def _best_paths(b: np.ndarray, n: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """`best_path` of many series, the longest first: b log densities, states by (place in time, series)."""
    length, _, many = b.shape
    active = (np.arange(length)[:, None] < n).sum(1).tolist()
    safe = lambda p: np.log(p, out=np.full(p.shape, -np.inf), where=p > 0)
    steps, score, back = safe(trans), safe(start) + b[0], np.zeros((length, STATES, many), np.int8)
    for t in range(1, length):
        m = active[t]
        came = score[:, None, :m] + steps[..., :m]
        back[t, :, :m] = came.argmax(0)  # the smaller state of two as good
        score[:, :m] = came.max(0) + b[t, :, :m]
    path, at, own = np.zeros((length, many), np.int8), score.argmax(0), np.arange(many)
    for t in range(length - 1, -1, -1):
        m = active[t]
        path[t, :m] = at[:m]
        at[:m] = back[t, at[:m], own[:m]]
    return path


def _standard(x: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """Points over mean and population sigma of the learnt ones; a column that is constant there counts with a sigma of 1."""
    own = x[learnt]
    flat = own.max(0) == own.min(0)
    return (x - np.where(flat, own[0], own.mean(0))) / np.where(flat, 1.0, own.std(0))


def labels_of(pieces: list[tuple[np.ndarray, np.ndarray]], parameters: dict | None = None, steps: int = EM_STEPS) -> list[tuple]:
    """Per piece of a series, (points, which of them a model learns from), the best path and the posteriors of all its points.

    The model is estimated for every piece as in `fit_hmm`, or stated by `parameters`; pieces go through each step side by side.
    """
    if not pieces:
        return []
    scaled = [_standard(x, learnt) for x, learnt in pieces]
    d = scaled[0].shape[1]
    if parameters is None:
        found = _estimate([z[learnt] for z, (_, learnt) in zip(scaled, pieces, strict=True)], steps, EM_TOLERANCE)
    else:
        shapes = {"start": (STATES,), "trans": (STATES, STATES), "mean": (STATES, d), "cov": (STATES, d, d)}
        found = [[np.array(parameters[c], float).reshape(s) for c, s in shapes.items()]] * len(pieces)
    out: list = [None] * len(pieces)
    queue = sorted(range(len(pieces)), key=lambda k: -len(scaled[k]))
    while queue:
        most = max(1, SIDE_BY_SIDE // len(scaled[queue[0]]))
        some, queue = queue[:most], queue[most:]
        n = np.array([len(scaled[k]) for k in some])
        x = _padded([scaled[k] for k in some], n[0])
        start, trans, mean, cov = (np.stack([found[k][i] for k in some], -1) for i in range(4))
        share = _expected(x, n, start, trans, mean, cov)[0]
        path = _best_paths(_densities(x, mean, cov), n, start, trans)
        for at, k in enumerate(some):
            out[k] = path[: n[at], at], share[: n[at], :, at]
    return out


def state_means(values: np.ndarray, states: np.ndarray) -> list[float | None]:
    """Mean of the values in each state; None for a state without values."""
    counts, sums = np.bincount(states, minlength=STATES), np.bincount(states, values, STATES)
    return [s / c if c else None for s, c in zip(sums.tolist(), counts.tolist(), strict=True)]


def listed(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow list per array."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def unlisted(rows: pa.Array, columns) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a list of structs per series: where they begin and end, all structs, their `columns` as points, and which points are whole."""
    inner = rows.flatten()
    ends = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))])
    parts = [inner.field(c) for c in columns]
    points = np.column_stack([p.to_numpy(zero_copy_only=False) for p in parts])
    return ends, inner, points, np.logical_and.reduce([p.is_valid().to_numpy(zero_copy_only=False) for p in parts])


def shares_in_turn(batches, points_of: Callable[[pa.RecordBatch], int]):
    """The batches in parts of a bounded number of points, so that memory follows from neither batch nor window sizes."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, AT_ONCE * batch.num_rows // max(points_of(batch), 1))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def label_series(rows: DataFrame, columns, value: str, keys=KEYS, parameters: dict | None = None) -> DataFrame:
    """Per key of `rows`, all usable, `state` (best path) and p0..p2 (posteriors) of its rows in order of date, and `_m0`..`_m2`.

    Fit and decoding run on the same arrays of many keys side by side, so that a series is gathered once; the results are those of
    `fit_hmm` (or `stated_model`) and `decode`. `_m<s>` is the mean of `value` over the `_fit` rows of a state.
    """
    columns, keys = list(columns), list(keys)
    packed = _packed(rows.select(*keys, "date", "_fit", *columns), keys)
    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    at = columns.index(value)

    def run(batches):
        for batch in shares_in_turn(batches, lambda b: len(b.column("_rows").flatten())):
            ends, inner, points, _ = unlisted(batch.column("_rows"), columns)
            fit = inner.field("_fit").to_numpy(zero_copy_only=False).astype(bool)
            pieces = [(points[a:b], fit[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            found = labels_of(pieces, parameters)
            means = [state_means(x[learnt, at], states[learnt]) for (x, learnt), (states, _) in zip(pieces, found, strict=True)]
            out = [listed([s for s, _ in found], pa.int8()), *[listed([p[:, k] for _, p in found], pa.float64()) for k in range(STATES)]]
            out += [pa.array([m[k] for m in means], pa.float64()) for k in range(STATES)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *out], [*keys, "state", *P, *M])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", state array<tinyint>"
    schema += "".join(f", {c} array<double>" for c in P) + "".join(f", {c} double" for c in M)
    return packed.mapInArrow(run, schema)


def fit_hmm(rows: DataFrame, columns, keys=KEYS, steps: int = EM_STEPS, tolerance: float = EM_TOLERANCE) -> DataFrame:
    """Model table, one row per (key, state): start, trans, mean, cov, center, spread, log_likelihood, steps.

    Spark gathers one array of points per key and standardises it. Clusters and at most `steps` rounds of estimation then run on
    the arrays of many keys side by side, so that a NumPy call serves them all. A key's rounds end when its log likelihood gains
    less than `tolerance`. The rounds are NumPy because array folds took many times as long (README); SQL and a loop check them.
    """
    columns, keys, d = list(columns), list(keys), len(list(columns))
    stats = [F.array(*[F.avg(c) for c in columns]).alias("center"), F.array(*[F.stddev_pop(c) for c in columns]).alias("spread")]
    packed = _packed(rows.select(*keys, "date", *columns), keys, *stats)
    packed = packed.withColumn("spread", F.transform("spread", lambda s: F.when(s == 0, 1.0).otherwise(s)))
    points = F.flatten(F.transform("_rows", _point(columns, F.col("center"), F.col("spread"))))
    packed = packed.select(*keys, "center", "spread", points.alias("points"))
    made = {
        "state": pa.int32(), "start": pa.float64(), "trans": pa.list_(pa.float64()), "mean": pa.list_(pa.float64()),
        "cov": pa.list_(pa.float64()), "log_likelihood": pa.float64(), "steps": pa.int32(),
    }
    kept = [*keys, "center", "spread"]

    def run(batches):
        for batch in batches:
            out = {n: [] for n in made}
            points = batch.column("points")
            arrays = [points[k].values.to_numpy(zero_copy_only=False).reshape(-1, d) for k in range(batch.num_rows)]
            for start, trans, mean, cov, like, count in _estimate(arrays, steps, tolerance):
                values = (range(STATES), start, trans, mean, cov.reshape(STATES, -1), [like] * STATES, [count] * STATES)
                for n, v in zip(made, values, strict=True):
                    out[n] += list(v)
            at = pa.array(np.repeat(np.arange(batch.num_rows), STATES))
            columns_out = [batch.column(c).take(at) for c in kept] + [pa.array(out[n], t) for n, t in made.items()]
            yield pa.RecordBatch.from_arrays(columns_out, [*kept, *made])

    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept)
    rest = ", state int, start double, trans array<double>, mean array<double>, cov array<double>, log_likelihood double, steps int"
    return packed.mapInArrow(run, schema + rest)


def _point(columns, center: Column, spread: Column) -> Callable[[Column], Column]:
    return lambda r: F.array(*[(r[c] - center[i]) / spread[i] for i, c in enumerate(columns)])


def decode(rows: DataFrame, model: DataFrame, columns, keys=KEYS) -> DataFrame:
    """Rows plus `state` (best path) and p0..p2 (posteriors); NULL where `_use` is false or the key has no model."""
    columns, keys = list(columns), list(keys)
    state = F.struct("state", "start", "trans", "mean", "cov")
    whole = model.groupBy(*keys).agg(
        F.sort_array(F.collect_list(state)).alias("_s"), F.first("center").alias("_center"), F.first("spread").alias("_spread")
    )
    part = lambda name: F.transform("_s", lambda s: s[name])
    made = F.struct(part("start").alias("start"), F.flatten(part("trans")).alias("trans"), part("mean").alias("mean"), part("cov").alias("cov"))
    whole = whole.select(*keys, "_center", "_spread", made.alias("_model"))
    narrow = rows.filter("_use").select(*keys, "date", *columns)
    if len(keys) > 1:  # such rows rarely arrive together by all keys, and the folds need every task
        narrow = spread(narrow, *keys)
    packed = _packed(narrow, keys).join(whole, keys)
    return placed(rows, _decoded(packed, columns, keys), keys)


def _decoded(packed: DataFrame, columns, keys) -> DataFrame:
    """Per key `state` (best path) and p0..p2 (posteriors) of its rows by its `_model`, as arrays."""
    m = F.col("_model")
    xs = F.transform("_rows", _point(columns, F.col("_center"), F.col("_spread")))

    def both(logs: Column) -> Column:
        return F.struct(best_path(logs, m["start"], m["trans"]).alias("states"), posteriors(logs, m["start"], m["trans"]).alias("posts"))

    found = packed.select(*keys, F.explode(F.array(let(_log_densities(xs, m["mean"], m["cov"], len(columns)), both))).alias("_f"))
    share = lambda k: F.transform("_f.posts", lambda p: p[k])
    return found.select(*keys, F.col("_f.states").alias("state"), *[share(k).alias(f"p{k}") for k in range(STATES)])


def stated_model(df: DataFrame, columns, parameters: dict, keys=KEYS) -> DataFrame:
    """A model table with the same `parameters` (start, trans, mean, cov of standardised features) for every key that has `_fit` rows.

    Only the standardisation is the key's own.
    """
    number = lambda v: F.array(*[F.lit(float(x)) for x in v])
    states = [
        F.struct(
            F.lit(k).alias("state"),
            F.lit(float(parameters["start"][k])).alias("start"),
            number(parameters["trans"][STATES * k : STATES * (k + 1)]).alias("trans"),
            number(parameters["mean"][k]).alias("mean"),
            number(parameters["cov"][k]).alias("cov"),
        )
        for k in range(STATES)
    ]
    spread = F.array(*[F.stddev_pop(c) for c in columns])
    stats = df.filter("_fit").groupBy(*keys).agg(F.array(*[F.avg(c) for c in columns]).alias("center"), spread.alias("spread"))
    stats = stats.withColumn("spread", F.transform("spread", lambda x: F.when(x == 0, 1.0).otherwise(x)))
    return stats.withColumn("_s", F.explode(F.array(*states))).select(*keys, "_s.*", "center", "spread")
