"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import shared_folder, stored

__all__ = ["LOWER", "UPPER", "WORD", "Sent", "fresh", "lowered", "mixed64", "power_of_two", "shared_folder", "ship", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word, as the contracts define it: a run without blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Pickle what a module defines by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


class Sent:
    """An object for tasks, broadcast as bytes that hold its classes too: a broadcast of the object itself would name them only, and
    executors without this package could not read it. value: the object, read once in each process."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self, "_value"):
            self._value = pickle.loads(self._bytes.value)
        return self._value


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else untouched; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def power_of_two(x: float, least: int, most: int) -> int:
    n = least
    while n < x and n < most:
        n *= 2
    return n


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


ship(__name__)
