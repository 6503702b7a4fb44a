"""Multiplicities of concepts and samples as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    """Concepts from n_high on are thinned, those below n_low repeated, the band between kept as it is."""

    n_high: float = 1e5
    n_low: float = 2e4
    a_head: float = 2.5
    r_min: float = 0.1
    gamma: float = 0.5
    m_max: float = 4.0

    def __post_init__(self) -> None:
        if not 0 < self.n_low <= self.n_high:
            raise ValueError("0 < n_low <= n_high is required")
        if not 0 <= self.r_min <= 1:
            raise ValueError("r_min must be in [0, 1]")
        if self.m_max < 1 or self.gamma < 0:
            raise ValueError("m_max must be at least 1 and gamma at least 0")


def concept_multiplicity(n: Column, s: Schedule = Schedule()) -> Column:
    """m of a concept that n samples have; null or non-positive n count as 1."""
    log_n = F.log10(F.when(n > 1, n))
    head = F.coalesce(F.greatest(F.lit(float(s.r_min)), F.lit(2.0 * s.a_head) / log_n), F.lit(1.0))
    tail = F.least(F.lit(float(s.m_max)), F.pow(F.lit(float(s.n_low)) / F.when(n > 0, n), F.lit(float(s.gamma))))
    return F.when(n.isNull() | (n <= 0), 1.0).when(n >= s.n_high, head).when(n < s.n_low, tail).otherwise(1.0)


def band(n: Column, s: Schedule = Schedule()) -> Column:
    return F.when(n >= s.n_high, "head").when(n < s.n_low, "tail").otherwise("mid")


def realise(m: Column, h: Column) -> Column:
    """Whole copies of an intended multiplicity: the floor, and one more if the sample's draw is below the fraction."""
    whole = F.floor(m)
    return F.when(m.isNull() | (m <= 0), F.lit(0)).otherwise(whole + (h < F.round(m - whole, 12)).cast("int")).cast("int")


def keep_rate(n: Column, n_head: float = 1e5, a_head: float = 2.5, r_min: float = 0.1, base: str = "log10") -> Column:
    """Share of a concept's samples that stratified selection keeps; 1 below n_head."""
    log = {"log10": F.log10, "ln": F.ln}[base](F.when(n > 1, n))
    rate = F.greatest(F.lit(float(r_min)), F.least(F.lit(1.0), F.lit(2.0 * a_head) / log))
    return F.when(n < n_head, 1.0).otherwise(F.coalesce(rate, F.lit(1.0)))


def stratum_quota(n: Column, rate: Column, segment: Column | None = None, boost: Column | None = None) -> Column:
    """Between 1 and n, the half-even rounding of rate * segment * (1 + boost) * n."""
    wanted = rate * (F.lit(1.0) if segment is None else segment) * (F.lit(1.0) if boost is None else 1 + boost) * n
    return F.greatest(F.lit(1), F.least(n.cast("long"), F.rint(wanted).cast("long")))
