"""Caches of small results and of verified tables, each with its own rule for when an entry ends. Tables are held by Spark (memory, then disk), never by the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def hold(df: DataFrame) -> DataFrame:
    """df, kept by Spark once it has been computed; what is lost with an executor is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class Timed:
    """Values by key for `seconds`; a value that is older is made again. ended is called with each value that goes."""

    def __init__(self, seconds: float, ended: Callable[[Any], Any] = lambda value: None, clock: Callable[[], float] = time.monotonic):
        self._seconds, self._ended, self._clock = seconds, ended, clock
        self._held: dict[Hashable, tuple[float, Any]] = {}

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        now = self._clock()
        for k in [k for k, (at, _) in self._held.items() if now - at >= self._seconds]:
            self._ended(self._held.pop(k)[1])
        if key not in self._held:
            self._held[key] = (now, make())
        return self._held[key][1]


class Versioned:
    """One value for each name, for as long as its version stays the same; another version ends it."""

    def __init__(self, ended: Callable[[Any], Any] = lambda value: None):
        self._ended = ended
        self._held: dict[Hashable, tuple[Hashable, Any]] = {}

    def get(self, name: Hashable, version: Hashable, make: Callable[[], Any]) -> Any:
        if name in self._held and self._held[name][0] != version:
            self._ended(self._held.pop(name)[1])
        if name not in self._held:
            self._held[name] = (version, make())
        return self._held[name][1]

    def clear(self) -> None:
        """Ends all values."""
        for name in list(self._held):
            self._ended(self._held.pop(name)[1])
