"""Special functions and exact tests in numpy, for grouped pandas code.

Only what SQL can't express lives here: the incomplete beta function with the t
and F tails it gives, the normal tail, and Fisher's exact test with the
conditional maximum-likelihood odds ratio.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Tables of an exact test that are held at once.
AT_ONCE = 1 << 20


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def correlation_p(r: float, n: int) -> float:
    """P-value of a correlation of n pairs, by the F test on its square."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return f_tail(r * r * (n - 2) / (1 - r * r), 1, n - 2)


_LOGS = [np.zeros(1)]


def _log_factorials(n: int) -> np.ndarray:
    """ln k! for k from 0 to ``n`` at least; one table a process, which is doubled when it is too short."""
    if len(_LOGS[0]) <= n:
        logs = np.log(np.arange(1, max(n, 2 * len(_LOGS[0])) + 1, dtype=np.longdouble))
        _LOGS[0] = np.concatenate([[0.0], np.cumsum(logs)]).astype(float)
    return _LOGS[0]


def _hypergeometric(a: int, b: int, c: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(support of the first cell, its log weights) with the table's margins held."""
    row, other, col = a + b, c + d, a + c
    support = np.arange(max(0, col - other), min(row, col) + 1)
    log_factorial = _log_factorials(row + other)
    weights = -sum(log_factorial[x] for x in (support, row - support, col - support, other - col + support))
    return support, weights - weights.max()


@lru_cache(maxsize=100_000)
def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(conditional maximum-likelihood odds ratio, two-sided p) of the table [[a, b], [c, d]]."""
    support, weights = _hypergeometric(a, b, c, d)
    prob = np.exp(weights)
    prob /= prob.sum()
    here = prob[a - support[0]]
    p = min(1.0, float(prob[prob <= here * (1 + 1e-7)].sum()))
    if a == support[0]:
        return (0.0 if len(support) > 1 else float("nan")), p
    if a == support[-1]:
        return float("inf"), p

    falls = -np.diff(weights)  # weights rise to their mode and fall, so these rise

    def edge(log_odds: float, mode: int, end: int, least: float) -> int:
        """The place next to ``end`` whose tilted weight is ``least`` at least, from the mode outwards."""
        while mode != end:
            middle = (mode + end + (end > mode)) // 2
            if weights[middle] + support[middle] * log_odds >= least:
                mode = middle
            else:
                end = middle + (1 if end < mode else -1)
        return mode

    def mean(log_odds: float) -> float:
        # What is left out is below the last digit of the whole.
        mode = int(np.searchsorted(falls, log_odds))
        least = weights[mode] + support[mode] * log_odds - 41 - math.log(len(support))
        near = slice(edge(log_odds, mode, 0, least), edge(log_odds, mode, len(support) - 1, least) + 1)
        w = weights[near] + support[near] * log_odds
        w = np.exp(w - w.max())
        return float((support[near] * w).sum() / w.sum())

    low, high = -50.0, 50.0
    for _ in range(70):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < a else (low, middle)
    return math.exp((low + high) / 2), p


@lru_cache(maxsize=100_000)
def exact_rows(x: tuple[int, ...], y: tuple[int, ...]) -> float:
    """Two-sided exact p of a table of two rows with as many columns: the tables of its margins that are no likelier, summed.

    Only tables are gone through whose part in the sum is not below its last digit, so the
    work of three columns grows with the number of counts and not with its square; the
    last two columns are taken at once, AT_ONCE tables at a time.  A row or all but one
    column without counts leaves one table, and 1.
    """
    kept = [(a, a + b) for a, b in zip(x, y, strict=True) if a + b]
    columns = [c for _, c in kept]
    if len(columns) < 2 or not sum(x) or not sum(y):
        return 1.0
    log_f = _log_factorials(sum(columns))
    choose = lambda n, k: log_f[n] - log_f[k] - log_f[n - k]
    whole = choose(sum(columns), sum(x))
    here = sum(choose(c, a) for a, c in kept)
    tables = sum(math.log(c + 1) for c in columns[:-1])
    if here - whole + tables < -745:  # all tables as unlikely together are below the least double
        return 0.0
    # All tables below this together are less than the last digit of the observed one's probability.
    floor = here - 41 - tables
    limit, sums = np.exp(here - whole) * (1 + 1e-7), np.zeros(2)

    def last_two(left: np.ndarray, so_far: np.ndarray) -> None:
        """Adds the tables of each row of counts ``left`` for the last two columns whose log weight is ``floor`` at least."""
        one, two = columns[-2:]
        low, high = np.maximum(0, left - two), np.minimum(one, left)
        weight = lambda a: so_far + choose(one, a) + choose(two, left - a)
        # A row rises to its mode and falls, so what is above the floor is one stretch.
        mode = np.clip((left + 1) * (one + 1) // (one + two + 2), low, high)
        ends = []
        for end in (low, high):
            inner, outer = mode, end  # the end moves in until it is above the floor; the mode itself always counts
            while (apart := np.abs(inner - outer)).max(initial=0) > 0:
                middle = np.where(outer < inner, inner - (apart + 1) // 2, inner + (apart + 1) // 2)
                above = weight(middle) >= floor
                inner, outer = np.where(above, middle, inner), np.where(above, outer, middle - np.sign(middle - inner))
            ends.append(inner)
        first, width = ends[0], int((ends[1] - ends[0]).max(initial=-1)) + 1
        step = max(1, AT_ONCE // max(1, width))
        for k in range(0, len(left), step):
            rows = slice(k, k + step)
            a = first[rows, None] + np.arange(width)
            held = a <= ends[1][rows, None]
            a = np.where(held, a, first[rows, None])
            prob = np.where(held, np.exp(so_far[rows, None] + choose(one, a) + choose(two, left[rows, None] - a) - whole), 0.0)
            sums[:] += prob[prob <= limit].sum(), prob.sum()

    def walk(k: int, left: int, so_far: float) -> None:
        """Goes through the counts of column ``k``; what one leaves to all columns after it is weighed at once."""
        if k == len(columns) - 2:
            last_two(np.array([left]), np.array([so_far]))
            return
        rest = sum(columns[k + 1 :])
        a = np.arange(max(0, left - rest), min(columns[k], left) + 1)
        own = so_far + choose(columns[k], a)
        near = own + choose(rest, left - a) >= floor
        a, own = a[near], own[near]
        if k == len(columns) - 3:
            last_two(left - a, own)
            return
        for b, w in zip(a.tolist(), own.tolist(), strict=True):
            walk(k + 1, left - b, w)

    walk(0, sum(x), 0.0)
    return min(1.0, float(sums[0] / sums[1]))


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square > x) for a whole number of degrees of freedom, by its finite series."""
    if df <= 0 or x != x:
        return float("nan")
    if x <= 0:
        return 1.0
    half, start = x / 2, 1 if df % 2 else 2
    p = math.erfc(math.sqrt(half)) if df % 2 else math.exp(-half)
    for k in range(start, df, 2):
        p += math.exp(k / 2 * math.log(half) - half - math.lgamma(k / 2 + 1))
    return min(1.0, p)
