"""Retrying calls to a source, on the driver; Spark retries tasks by itself."""

from __future__ import annotations

import random
import time
from collections.abc import Callable


class SourceError(Exception):
    """A failed call; `transient` ones may be tried again."""

    def __init__(self, message: str, transient: bool):
        super().__init__(message)
        self.transient = transient


def retried(call: Callable, attempts: int = 4, base: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, draw: Callable[[float, float], float] = random.uniform):
    """The call's result. Transient failures are tried again after a random wait below a bound that doubles."""
    for n in range(attempts):
        try:
            return call()
        except (SourceError, TimeoutError, ConnectionError) as e:
            if n == attempts - 1 or not getattr(e, "transient", True):
                raise
            sleep(draw(0.0, min(most, base * 2**n)))


class Cached:
    """DataFrames by key for a time; a newer load takes the place of one that has expired, which is unpersisted."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key, load: Callable):
        made, df = self.held.get(key, (None, None))
        if df is None or self.clock() - made > self.seconds:
            if df is not None:
                df.unpersist()
            df = load().persist()
            self.held[key] = (self.clock(), df)
        return df
