"""Random search over ranges of parameters.

Trials are drawn by digests of the seed, the attempt and the parameter's name:
every run draws the same ones, and each one once. Trials are scored several
times where a fit depends on a draw of its own, and the mean counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.values import hash_unit
from gridcast.operators.gram import Penalised, gram_matrices, mean_squares, solve

DIGITS = 12


@dataclass(frozen=True)
class Steps:
    """Numbers from `low` to `high`, both included, in steps."""

    low: float
    high: float
    step: float

    def __len__(self) -> int:
        return int((self.high - self.low) / self.step + 1e-9) + 1

    def __getitem__(self, i: int):
        return self.low + i * self.step


@dataclass(frozen=True)
class Choice:
    values: tuple

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int):
        return self.values[i]


def draw(seed: int, attempt: int, name: str, n: int) -> int:
    """A number from 0 to n - 1."""
    digest = hashlib.md5(f"{seed}|{attempt}|{name}".encode()).hexdigest()
    return int(digest[:DIGITS], 16) * n >> 4 * DIGITS


def draw_trials(space: Mapping[str, Steps | Choice], trials: int, seed: int = 0) -> list[dict]:
    """`trials` different settings of the space, or all of them if there are fewer."""
    size = 1
    for values in space.values():
        size *= len(values)
    out: dict[tuple, dict] = {}
    attempt = 0
    while len(out) < min(trials, size):
        at = tuple(draw(seed, attempt, name, len(values)) for name, values in space.items())
        out.setdefault(at, {name: values[i] for (name, values), i in zip(space.items(), at)})
        attempt += 1
    return list(out.values())


def random_search(trials: Sequence[Mapping], score: Callable[[Mapping, int], float], executions: int = 1, parallelism: int = 4) -> list[dict]:
    """One record per trial: its settings, the mean error of its executions, and whether it is the best, the first of equals.

    `score` fits and scores one setting; executions run side by side.
    """
    runs = [(t, e) for t in trials for e in range(executions)]
    with ThreadPoolExecutor(parallelism) as pool:
        errors = list(pool.map(lambda r: score(*r), runs))
    means = [sum(errors[i * executions : (i + 1) * executions]) / executions for i in range(len(trials))]
    best = means.index(min(means)) if means else -1
    return [{"trial": i, **t, "error": m, "is_best": i == best} for i, (t, m) in enumerate(zip(trials, means))]


def linear_search(
    df: DataFrame, trials: Sequence[Mapping], features: Mapping[str, Column | str], label: str, key: Sequence[str],
    executions: int = 1, fraction: float = 0.2, seed: int = 7,
) -> list[dict]:
    """Random search of linear models, all trials from the sums of one scan.

    A trial may set `alpha`, `ratio` and `features` (names, separated by commas).
    In each execution another draw by `key` sets `fraction` of the rows aside,
    and the trial's error is its mean squared error there.
    """
    exprs = {f: F.col(c) if isinstance(c, str) else c for f, c in features.items()} | {"_y": F.col(label)}
    asides = [(hash_unit(list(key), seed + e) < fraction).cast("long") for e in range(executions)]
    grams = gram_matrices(df, exprs, asides)  # at most 2 ** executions groups, whatever the rows
    sides = {}
    for e in range(executions):
        for aside in (0, 1):
            parts = [g for k, g in grams.items() if k[e] == aside]
            sides[e, aside] = sum(parts[1:], parts[0]) if parts else None

    def score(trial: Mapping, e: int) -> float:
        train, test = sides[e, 0], sides[e, 1]
        if train is None or test is None:
            raise ValueError("no rows to fit on, or none set aside")
        names = str(trial["features"]).split(",") if "features" in trial else list(features)
        weights = solve(train, names, ["_y"], Penalised(trial.get("alpha", 0.0), trial.get("ratio", 0.0)))
        return float(mean_squares(test, names, ["_y"], weights)[0])

    return random_search(trials, score, executions, parallelism=1)  # small matrices on the driver
