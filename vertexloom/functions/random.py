"""Weights as the C library's generator draws them: additive feedback over 31 words, seeded by a linear congruence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEED = 23
RAND_MAX = 2**31 - 1


def c_rand(seed: int) -> Iterator[int]:
    """The outputs of ``rand`` after ``srand(seed)``."""
    state = [seed or 1]
    while len(state) < 31:
        state.append(16807 * state[-1] % RAND_MAX)
    state += state[:3]
    count = len(state)
    while True:
        state.append((state[-3] + state[-31]) & 0xFFFFFFFF)
        count += 1
        if count > 344:
            yield state[-1] >> 1
        if len(state) > 4096:
            del state[:-31]


def glorot(rows: int, columns: int, seed: int = SEED) -> np.ndarray:
    """Uniform within the root of 6 / (rows + columns). Each call seeds anew, so that equal shapes get equal weights."""
    draws, bound = c_rand(seed), (6 / (rows + columns)) ** 0.5
    return np.array([(next(draws) / RAND_MAX - 0.5) * 2 * bound for _ in range(rows * columns)]).reshape(rows, columns)
