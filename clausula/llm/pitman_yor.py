"""Pitman-Yor restaurants with numpy: Gibbs seating of customers, and a hierarchy over the letters of words.

A restaurant seats each customer of a dish at a new table with a probability in proportion to
(strength + discount * tables) * parent's probability of the dish, else at a table of that dish in
proportion to its customers less the discount a table. Tables are customers of the parent. A Gibbs
step takes all customers of a dish out of the restaurant and seats them anew given all others: t
tables for c customers have the weight S(c, t) * prod((strength + discount * (others + k)) * parent,
k < t), where S is the generalised Stirling number of the discount. Restaurants whose contexts end
alike share a parent: the context without its first letter.

S is taken from its recurrence up to EXACT customers. Beyond, t - 1 is drawn from the Poisson law,
or the normal one where its mean is over 30, that has the moments of these weights at their saddle
point (tests compare both with the recurrence).
"""

from __future__ import annotations

import functools
from statistics import NormalDist

import numpy as np

from clausula.llm.texthash import mix

#: Letters of a context; symbols of the letter alphabet, 0 the end of a word (and what is before it).
DEPTH, SYMBOLS = 3, 47
STRENGTH = 1.0
EXACT = 256
#: Up to so many customers a size is by itself and its weights, at most a product of that many masses, are taken as they are; beyond, sizes up to an eighth apart are seated together.
PLAIN = 16
_BANDS = [*range(1, PLAIN + 1)]
while _BANDS[-1] < EXACT:
    _BANDS.append(min(EXACT, _BANDS[-1] + _BANDS[-1] // 8))


def classes(count: np.ndarray) -> np.ndarray:
    """The symbol of each byte: the 38 bytes with the highest counts have their own, the others share eight by kind."""
    of = np.full(256, 46, np.uint8)  # control characters and capitals
    of[32:65], of[91:97], of[123:127] = 40, 40, 40
    of[48:58] = 39
    of[0x80:0xA0], of[0xA0:0xC0], of[0xC0:0xE0], of[0xE0:0xF0], of[0xF0:] = 41, 42, 43, 44, 45
    top = np.argsort(-count[:256], kind="stable")[: SYMBOLS - 9]
    top = top[count[top] > 0]
    of[top] = 1 + np.arange(len(top))
    return of


def discount(ones: float, twos: float) -> float:
    """From the numbers of dishes with one and with two customers."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones else 0.5


def uniform(keys: np.ndarray, n: int) -> np.ndarray:
    """A number between 0 and 1 for each key, another one for each n."""
    with np.errstate(over="ignore"):
        return ((mix(keys + np.uint64(n) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


@functools.lru_cache(8)
def log_stirling(d: float, size: int = EXACT) -> np.ndarray:
    """log S(c, t) for c and t up to size: the weight of all ways to seat c customers at t tables."""
    s = np.full((size + 1, size + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(1, size + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        for c in range(1, size):
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], s[c, 1:] + np.log(np.maximum(c - t * d, 1e-300)))
    return s


def moments(c: np.ndarray, a: np.ndarray, b: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of t - 1 for many customers, at the saddle point of S(c, t) * prod(a + b k, k < t).

    For a fixed mass m a table, y solves m (1 - y) y**(d - 1) = c and the mean is m (1 - y**d) / d; m is a + b t.
    """
    mean, x = np.minimum(a / d, c - 1.0), np.zeros(len(c))
    for _ in range(10):
        m = a + b * (1 + mean)
        for _ in range(4):  # Newton's steps on the logit of y
            y = 1 / (1 + np.exp(-x))
            f = np.log(m) + np.log1p(-y) + (d - 1) * np.log(y) - np.log(c)
            x = np.clip(x + f / (y + (1 - d) * (1 - y)), -200, 30)
        y = 1 / (1 + np.exp(-x))
        fixed = m * (1 - y**d) / d
        var = np.clip(fixed - m * y**d / (y / (1 - y) + 1 - d), 1e-9, None)
        fixed = fixed * (1 - 1 / c)
        mean = np.clip(mean + (fixed - mean) / np.maximum(1 - b * var / m, 0.1), 0, c - 1.0)
    return mean, 1 / np.maximum(1 / var - b / m, 1e-12)


def _many(c: np.ndarray, a: np.ndarray, b: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    mean, var = moments(c.astype(float), a, b, d)
    t = np.zeros(len(c), np.int64)
    large = mean > 30
    if large.any():
        at = np.flatnonzero(large)
        z = np.interp(u[at], _Z[0], _Z[1])
        t[at] = np.round(mean[at] + np.sqrt(var[at]) * z)
    at = np.flatnonzero(~large)
    term = np.exp(-mean[at])
    total, k = term.copy(), 0
    while len(at):
        on = u[at] > total
        at, term, total = at[on], term[on], total[on]
        k += 1
        t[at] = k
        term = term * mean[at] / k
        total = total + term
        if k > 200:
            break
    return 1 + np.clip(t, 0, c - 1)


_Q = np.r_[1e-6, np.linspace(0.001, 0.999, 999), 1 - 1e-6]
_Z = (_Q, np.array([NormalDist().inv_cdf(x) for x in _Q]))


def reseat(c: np.ndarray, a: np.ndarray, b: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes of c customers each, seated anew given all other dishes; 0 where there are none.

    a: (strength + discount * tables of the others) * parent's probability; b: discount * parent's probability;
    u: a uniform number a dish.
    """
    t = (c > 0).astype(np.int64)
    some = np.flatnonzero(c > 1)
    some = some[np.argsort(c[some], kind="stable")]
    size, s = c[some], log_stirling(d)
    for below, n in zip(_BANDS, _BANDS[1:]):
        lo, hi = np.searchsorted(size, [below, n], side="right")
        step = (1 << 18) // n
        for x in range(lo, hi, step):
            at = some[x : min(x + step, hi)]
            if n == 2:
                w = a[at] + b[at]  # the second customer at a table of their own, or at the first one's
                t[at] += u[at] * (w + 1 - d) < w
            elif n <= PLAIN:  # weights over a, without logarithms
                w, more = np.empty((n, len(at))), np.ones(len(at))
                w[0] = np.exp(s[n, 1])
                for k in range(1, n):
                    more *= a[at] + b[at] * k
                    w[k] = w[k - 1] + np.exp(s[n, k + 1]) * more
                t[at] = 1 + (w < u[at] * w[-1]).sum(0)
            else:  # S is 0 where there are more tables than customers
                w = s[c[at], 1 : n + 1] + np.cumsum(np.log(a[at, None] + b[at, None] * np.arange(n)), 1)
                w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
                t[at] = 1 + (w < u[at, None] * w[:, -1:]).sum(1)
    at = some[np.searchsorted(size, EXACT, side="right") :]
    if len(at):
        t[at] = _many(c[at], a[at], b[at], d, u[at])
    return t


def grams(words: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words given as joined bytes with the end of each: gram of each letter and word end, its byte (256: an end), first place of each word. of: classes()."""
    n, length = len(ends), np.diff(np.r_[0, ends])
    place = np.r_[0, np.cumsum(length + 1)]
    byte = np.full(int(place[-1]), 256, np.int16)
    inside = np.ones(len(byte), bool)
    inside[place[1:] - 1] = False
    byte[inside] = words
    symbol = np.zeros(len(byte), np.int32)
    symbol[inside] = of[words]
    gram, before = symbol.copy(), symbol
    for back in range(1, DEPTH + 1):
        last, before = before, np.zeros(len(byte), np.int32)
        before[1:] = last[:-1]
        before[place[:n]] = 0  # nothing of the word before
        gram += before * SYMBOLS**back
    return gram.astype(np.int64), byte, place[:n]


class Letters:
    """Restaurants of all contexts of 0 to DEPTH letters. counts: customers of the longest contexts by gram."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.tables = [None] * (DEPTH + 1)  # by depth: tables of each gram after the last sweep
        self.below = [np.full((1, SYMBOLS), 1 / SYMBOLS)] * (DEPTH + 1)

    def sweep(self, counts: np.ndarray) -> np.ndarray:
        """Take out and seat all customers once; the predictive probability of every gram."""
        customers, ds = counts.reshape(-1, SYMBOLS), [0.5] * (DEPTH + 1)
        held = []
        for depth in range(DEPTH, -1, -1):
            at = np.flatnonzero(customers)
            c = customers.ravel()[at]
            ds[depth] = d = discount(float((c == 1).sum()), float((c == 2).sum()))
            context, dish = at // SYMBOLS, at % SYMBOLS
            parent = self.below[depth][context % len(self.below[depth]), dish]
            old = self.tables[depth] if self.tables[depth] is not None else (customers > 0).astype(np.int32)
            others = old.sum(1)[context] - old.ravel()[at]
            t = reseat(c, (STRENGTH + d * others) * parent, d * parent, d, self.rng.random(len(c)))
            tables = np.zeros(customers.shape, np.int32)
            tables.ravel()[at] = t
            self.tables[depth] = tables
            held.append((customers, tables))
            if depth:
                customers = tables.reshape(SYMBOLS, -1, SYMBOLS).sum(0)
        p = np.full((1, SYMBOLS), 1 / SYMBOLS)
        for depth in range(DEPTH + 1):
            self.below[depth] = p
            customers, tables = held.pop()
            d, n, total = ds[depth], customers.sum(1, keepdims=True), tables.sum(1, keepdims=True)
            q = np.maximum(customers - d * tables, 0)
            q.reshape(-1, *p.shape)[...] += ((STRENGTH + d * total).reshape(-1, len(p), 1)) * p
            p = np.divide(q, STRENGTH + n, out=q)
        return p.ravel()
