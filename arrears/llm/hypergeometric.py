"""Exact hypergeometric draws for the communication matrix of a distributed shuffle."""

from __future__ import annotations

from math import exp, lgamma
from random import Random


def _log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def draw(rng: Random, good: int, bad: int, draws: int) -> int:
    """Number of good items among ``draws`` taken without replacement.

    Inversion that starts at the mode and walks outwards, so a draw costs about one standard
    deviation of steps; counts above 10^9 are fine.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    u = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts of a uniformly random permutation that fills ``columns`` (exact sizes, same
    total) from ``rows``: entry [p][d] items go from partition p to destination d."""
    rng, left, out = Random(seed), list(columns), []
    for n in rows:
        rest, line = sum(left), []
        for d, room in enumerate(left):
            x = draw(rng, room, rest - room, n)
            line.append(x)
            rest, n, left[d] = rest - room, n - x, room - x
        out.append(line)
    return out
