"""Penalties as expressions over a pair's two sites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import ClassVar, Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Penalty(Protocol):
    def column(self, left: str, right: str) -> Column:
        """The penalty of the pair whose sites' columns begin with ``left`` and ``right``."""

    #: Columns of the sites that it needs.
    columns: ClassVar[tuple[str, ...]]

    def running(self, values: dict[str, np.ndarray]) -> Callable[[int, int], np.ndarray]:
        """Of sites in order with these columns: a function of (i, end) that gives the penalties of site i with sites i to end - 1, as a running sum."""


@dataclass(frozen=True)
class Constant:
    """One number for all pairs: chi-square, background, or given."""

    value: float
    columns: ClassVar[tuple[str, ...]] = ()

    def column(self, left: str, right: str) -> Column:
        return F.lit(float(self.value))

    def running(self, values):
        return lambda i, end: self.value * np.arange(1.0, end - i + 1)


@dataclass(frozen=True)
class Modularity:
    """The product of both normalised degrees (k_norm of each site) and a coefficient: the chromosome's length over the longest block."""

    coefficient: float
    columns: ClassVar[tuple[str, ...]] = ("k_norm",)

    def column(self, left: str, right: str) -> Column:
        return F.lit(float(self.coefficient)) * F.col(f"{left}k_norm") * F.col(f"{right}k_norm")

    def running(self, values):
        k = values["k_norm"]
        before = np.concatenate([[0.0], np.cumsum(k)])
        return lambda i, end: self.coefficient * k[i] * (before[i + 1 : end + 1] - before[i])


@dataclass(frozen=True)
class OfChromosome:
    """The number in the sites' column ``penalty``: one for each chromosome."""

    columns: ClassVar[tuple[str, ...]] = ("penalty",)

    def column(self, left: str, right: str) -> Column:
        return F.col(f"{left}penalty")

    def running(self, values):
        return lambda i, end: values["penalty"][i] * np.arange(1.0, end - i + 1)


MODELS = ("modularity", "chi", "background", "constant")


def check_model(model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    return model
