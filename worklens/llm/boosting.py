"""Small gradient-boosted trees: fitted in numpy on a bounded table, applied as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Leaf:
    value: float

    def sql(self, feature: str) -> str:
        return f"{self.value:.9f}D"

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


@dataclass
class Split:
    column: int
    cut: float
    low: "Leaf | Split"
    high: "Leaf | Split"

    def sql(self, feature: str) -> str:
        at = f"{feature}[{self.column}]"
        return f"IF({at} <= {self.cut:.9f}D, {self.low.sql(feature)}, {self.high.sql(feature)})"

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[:, self.column] <= self.cut, self.low.apply(x), self.high.apply(x))


@dataclass
class Boosted:
    start: float
    trees: list[Leaf | Split] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.apply(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def sql(self, feature: str) -> str:
        """Probability as SQL over an array column or lambda variable of the features."""
        return f"1D / (1D + exp(-({' + '.join([f'{self.start:.9f}D', *(t.sql(feature) for t in self.trees)])})))"


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, least: int, ridge: float) -> Leaf | Split:
    best, gain = None, 1e-6
    total, weight = slope.sum(), curve.sum()
    if depth:
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            if len(values) < 2:
                continue
            if len(values) > 33:
                values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)))
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, j] <= cut
                n = low.sum()
                if n < least or len(low) - n < least:
                    continue
                g, h = slope[low].sum(), curve[low].sum()
                won = g * g / (h + ridge) + (total - g) ** 2 / (weight - h + ridge) - total**2 / (weight + ridge)
                if won > gain:
                    best, gain = (j, float(cut), low), won
    if best is None:
        return Leaf(float(-total / (weight + ridge)))
    j, cut, low = best
    args = (depth - 1, least, ridge)
    return Split(j, cut, _grow(x[low], slope[low], curve[low], *args), _grow(x[~low], slope[~low], curve[~low], *args))


def _shrink(tree: Leaf | Split, by: float) -> Leaf | Split:
    if isinstance(tree, Leaf):
        return Leaf(tree.value * by)
    return Split(tree.column, tree.cut, _shrink(tree.low, by), _shrink(tree.high, by))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, least: int = 5, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss. ``y``: 0 or 1."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    margin = np.full(len(y), model.start)
    for _ in range(trees if len(y) and y.min() < y.max() else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _shrink(_grow(x, p - y, p * (1 - p), depth, least, ridge), rate)
        model.trees.append(tree)
        margin += tree.apply(x)
    return model
