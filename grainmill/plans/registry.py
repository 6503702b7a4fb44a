"""Rewards, judges and dataset readers by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame

from ..operators.advantages import total_reward

Reward = Callable[..., Column]
_REWARDS: dict[str, Reward] = {}
_READERS: dict[str, Callable[..., DataFrame]] = {}


def reward(name: str) -> Callable[[Reward], Reward]:
    """Registers a function from columns to a reward column; a pandas UDF is one."""

    def add(f: Reward) -> Reward:
        _REWARDS[name] = f
        return f

    return add


def reader(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _READERS[name] = f
        return f

    return add


def read(name: str, *args, **options) -> DataFrame:
    if name not in _READERS:
        raise ValueError(f"no reader {name!r}; there are {sorted(_READERS)}")
    return _READERS[name](*args, **options)


def score(rows: DataFrame, weights: Mapping[str, float], *columns: str) -> DataFrame:
    """Adds a column per reward and `reward`, their weighted sum."""
    missing = set(weights) - set(_REWARDS)
    if missing:
        raise ValueError(f"no rewards {sorted(missing)}")
    scored = rows.withColumns({f"reward_{n}": _REWARDS[n](*columns) for n in weights})
    return scored.withColumn("reward", total_reward({f"reward_{n}": w for n, w in weights.items()}))
