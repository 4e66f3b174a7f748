"""Optimizers on the driver's matrices, gradient clipping, and a learning rate that falls on a plateau."""

from __future__ import annotations

import dataclasses

import numpy as np

CLIP = 2.0


def clipped(gradient: np.ndarray, bound: float = CLIP) -> np.ndarray:
    return np.clip(gradient, -bound, bound)


@dataclasses.dataclass
class SGD:
    rate: float

    def __post_init__(self) -> None:
        if self.rate <= 0:
            raise ValueError("the learning rate must be positive")

    def step(self, name: str, weight: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        return weight - self.rate * gradient


@dataclasses.dataclass
class Adam:
    """``bias_correction="frozen"`` corrects every step by the first step's constants; ``"standard"`` by the number of steps."""

    rate: float = 1e-3
    decay: float = 0.0
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    bias_correction: str = "frozen"
    state: dict[str, tuple[int, np.ndarray, np.ndarray]] = dataclasses.field(default_factory=dict)

    def step(self, name: str, weight: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        t, m, v = self.state.get(name, (0, np.zeros_like(weight), np.zeros_like(weight)))
        g = gradient + self.decay * weight
        t, m, v = t + 1, self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
        self.state[name] = (t, m, v)
        power = t if self.bias_correction == "standard" else 1
        return weight - self.rate * (m / (1 - self.beta1**power)) / (np.sqrt(v / (1 - self.beta2**power)) + self.epsilon)


@dataclasses.dataclass
class PlateauRate:
    """Lowers the rate by ``factor`` once more than ``patience`` losses in a row weren't below the best; then waits ``cooldown`` steps."""

    rate: float
    least: float = 0.0
    factor: float = 0.8
    epsilon: float = 1e-8
    patience: int = 10
    cooldown: int = 0
    best: float = float(np.finfo(np.float32).max)
    bad: int = 0
    waiting: int = 0

    def step(self, loss: float) -> float:
        better = loss < self.best
        self.best, self.bad = min(self.best, loss), 0 if better else self.bad + 1
        if self.waiting:
            self.waiting, self.bad = self.waiting - 1, 0
        if self.bad > self.patience:
            lower = max(self.rate * self.factor, self.least)
            self.rate = lower if self.rate - lower > self.epsilon else self.rate
            self.waiting, self.bad = self.cooldown, 0
        return self.rate
