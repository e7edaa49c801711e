"""The label model estimated from co-vote moments instead of by EM.

For sources that err independently given the class, the share of rows on which two sources cast two votes is the
sum over classes of P(class) P(vote 1 | class) P(vote 2 | class). Spark counts these shares once, on the vote
patterns; gradient steps then fit the parameters to a table whose size depends on the sources alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..schemas import ABSTAIN, CARDINALITY
from ..session import stored
from .labelmodel import FLOOR, LabelModel, Source, initial_parameters, lm_moments, source_patterns, sources_of

# Parameters stay inside these limits after every step.
LOWEST, HIGHEST = 1e-3, 1 - 1e-3


@dataclass(frozen=True)
class MomentProblem:
    """Observed moments of the votes of all sources (without abstentions), and the start of the parameters."""

    sources: tuple[Source, ...]
    rows: tuple[tuple[str, int], ...]
    observed: np.ndarray = field(repr=False)
    start: np.ndarray = field(repr=False)

    @property
    def apart(self) -> np.ndarray:
        """1 where two votes belong to different sources: votes of one source exclude each other."""
        names = np.array([s for s, _ in self.rows])
        return (names[:, None] != names[None, :]).astype(float)

    def errors(self, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = (mu @ mu.T / CARDINALITY - self.observed) * self.apart
        return pairs, mu.mean(axis=1) - np.diag(self.observed)

    def loss(self, mu: np.ndarray, l2: float = 0.0) -> float:
        """Squared errors of the moments of two sources and of the votes' shares, and the distance from the start."""
        pairs, shares = self.errors(mu)
        return float((pairs**2).sum() + (shares**2).sum() + l2 * ((mu - self.start) ** 2).sum())

    def gradient(self, mu: np.ndarray, l2: float = 0.0) -> np.ndarray:
        pairs, shares = self.errors(mu)
        return (4 * pairs @ mu + 2 * shares[:, None]) / CARDINALITY + 2 * l2 * (mu - self.start)


def moment_problem(patterns: DataFrame, names: Sequence[str], prior_acc: float = 0.7) -> MomentProblem:
    """Moments of the sources of ``names``, counted by Spark on the vote patterns ``(names, n)``.

    A vote that no source of ``names`` can cast fails: it would be left out of every sum without a word.
    """
    sources = sources_of(names)
    table = stored(source_patterns(patterns, sources), "source_patterns")
    rows = tuple((s.name, o) for s in sources for o in s.labels)
    at = {r: i for i, r in enumerate(rows)}
    observed = np.zeros((len(rows), len(rows)))
    for m in lm_moments(table, [s.name for s in sources]).collect():
        a, b = (m["lf1"], m["vote1"]), (m["lf2"], m["vote2"])
        if a not in at or b not in at:
            raise ValueError(f"a source votes for a class that it does not have: {a if a not in at else b}")
        observed[at[a], at[b]] = m["moment"]
    counts = {s.name: {o: observed[at[s.name, o], at[s.name, o]] for o in s.labels} for s in sources}
    for s in sources:
        counts[s.name][ABSTAIN] = 1.0 - sum(counts[s.name].values())
    start = initial_parameters(counts, sources, prior_acc)
    return MomentProblem(sources, rows, observed, np.array([start[s][o] for s, o in rows]).clip(LOWEST, HIGHEST))


def sgd(rate: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda g: rate * g


def adam(rate: float, b1: float = 0.9, b2: float = 0.999, infinity: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Adam's step from running means of the gradient and its square, or (``infinity``) of its largest size."""
    mean, size, t = 0.0, 0.0, 0

    def step(g: np.ndarray) -> np.ndarray:
        nonlocal mean, size, t
        t += 1
        mean = b1 * mean + (1 - b1) * g
        if infinity:
            size = np.maximum(b2 * size, np.abs(g))
            return rate * mean / (1 - b1**t) / (size + 1e-8)
        size = b2 * size + (1 - b2) * g * g
        return rate * mean / (1 - b1**t) / (np.sqrt(size / (1 - b2**t)) + 1e-8)

    return step


OPTIMIZERS: dict[str, Callable[[float], Callable[[np.ndarray], np.ndarray]]] = {
    "sgd": sgd,
    "adam": adam,
    "adamax": lambda rate: adam(rate, infinity=True),
}


def descend(problem: MomentProblem, epochs: int = 500, rate: float = 0.2, l2: float = 0.0, optimizer: str = "sgd", log_every: int = 10) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """Parameters after ``epochs`` steps, and ``(epoch, loss)`` before the first step, every ``log_every`` and at the end."""
    mu, step = problem.start.copy(), OPTIMIZERS[optimizer](rate)
    history = [(0, problem.loss(mu, l2))]
    for epoch in range(1, epochs + 1):
        mu = (mu - step(problem.gradient(mu, l2))).clip(LOWEST, HIGHEST)
        if epoch % log_every == 0 or epoch == epochs:
            history.append((epoch, problem.loss(mu, l2)))
    return mu, history


def as_model(problem: MomentProblem, mu: np.ndarray, use_abstain: bool = False) -> LabelModel:
    """The label model of these parameters; a source abstains with what its votes leave."""
    table: dict = {}
    for s in problem.sources:
        votes = {o: mu[i] for i, (name, o) in enumerate(problem.rows) if name == s.name}
        silent = np.maximum(1 - sum(votes.values()), FLOOR)
        table[s.name] = {ABSTAIN: tuple(silent.tolist()), **{o: tuple(v.tolist()) for o, v in votes.items()}}
    return LabelModel(problem.sources, table, use_abstain)


def lm_fit_moments(
    patterns: DataFrame,
    names: Sequence[str],
    epochs: int = 500,
    rate: float = 0.2,
    l2: float = 0.0,
    optimizer: str = "sgd",
    log_every: int = 10,
    prior_acc: float = 0.7,
    use_abstain: bool = False,
) -> tuple[LabelModel, list[tuple[int, float]]]:
    """``(model, history)``: gradient steps on the moments' squared errors from the better-than-random start.

    Classes are taken as equally frequent, as in ``lm_fit``. ``optimizer``: one of ``OPTIMIZERS``; ``l2`` pulls the
    parameters towards their start; ``history`` holds ``(epoch, loss)``.
    """
    problem = moment_problem(patterns, names, prior_acc)
    mu, history = descend(problem, epochs, rate, l2, optimizer, log_every)
    return as_model(problem, mu, use_abstain), history


def compared(spark, models: dict[str, LabelModel]) -> DataFrame:
    """``(source, outcome, label, p_<name> ...)``: the parameters of several models side by side."""
    tables = [m.to_table(spark).withColumnRenamed("p", f"p_{name}") for name, m in models.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.join(F.broadcast(t), ["source", "outcome", "label"])
    return out
